"""Redirect links of search result pages, unwrapped to their target (column expressions)."""

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions import fixed
from linkloom.functions.barrier import bind
from linkloom.functions.urls import clean_url, host_of, path_of, query_of, scheme_of, trim_space


def percent_decode(text: Column) -> Column:
    """Percent decoding that keeps ``+`` and stray ``%`` as they are."""
    plus_kept = F.replace(text, F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(F.regexp_replace(plus_kept, "%(?![0-9A-Fa-f]{2})", "%25"))


def form_decode(text: Column) -> Column:
    """Percent decoding of a query value, where ``+`` is a space."""
    return percent_decode(F.replace(text, F.lit("+"), F.lit(" ")))


def outward(url: Column) -> Column:
    """The URL itself when it is http(s) and leads away from the search engines, else NULL."""

    def check(cleaned: Column) -> Column:
        return scheme_of(cleaned).isin("http", "https") & ~host_of(cleaned).isin(*fixed.SEARCH_HOSTS)

    return F.when(bind(clean_url(url), check), url)


def unwrap_yahoo(href: Column) -> Column:
    """Target of a ``/RU=…/RK=`` wrapper; other links stay."""

    def target(raw: Column) -> Column:
        framed = F.regexp_extract(raw, r"(?i)/RU=([^/]+)/RK=", 1)
        rest = F.substring(raw, F.locate("/RU=", raw) + 4, F.length(raw))
        loose = F.substring_index(F.substring_index(rest, "/RK=", 1), "&", 1)
        return (
            F.when(~raw.contains("/RU="), raw)
            .when(framed != "", percent_decode(framed))
            .otherwise(percent_decode(loose))
        )

    return bind(bind(trim_space(href), target), outward)


def decode_bing_token(token: Column) -> Column:
    """URL in a Bing token: URL-safe base64 after an optional ``a1``; NULL when there is none.

    Characters outside the alphabet are skipped. The padding is the one the whole token calls for,
    and decoding fails where that is less than its valid characters need.
    """

    def decode(blob: Column) -> Column:
        letters = F.regexp_replace(F.translate(blob, "-_", "+/"), "[^A-Za-z0-9+/]", "")
        needed = F.pmod(-F.length(letters), F.lit(4))
        given = F.pmod(-F.length(blob), F.lit(4))
        padded = F.rpad(letters, F.length(letters) + needed, F.lit("="))
        binary = F.when((needed < 3) & (needed <= given), F.try_to_binary(padded, F.lit("base64")))
        return F.replace(F.make_valid_utf8(binary.cast("string")), F.lit("�"), F.lit(""))

    blob = F.when(token.startswith("a1"), F.substring(token, F.lit(3), F.length(token))).otherwise(token)
    return bind(
        bind(blob, decode),
        lambda url: F.when(url.startswith("http://") | url.startswith("https://"), url),
    )


def unwrap_bing(href: Column) -> Column:
    """Target of a ``/ck/`` click link of Bing; other links stay."""

    def target(raw: Column) -> Column:
        def wrapped(cleaned: Column) -> Column:
            return host_of(cleaned).isin(*fixed.BING_HOSTS) & path_of(cleaned).contains("/ck/")

        token = form_decode(
            F.regexp_extract(query_of(clean_url(raw)), r"(?:^|&)(?:u|%75)=([^&]+)", 1)
        )
        return F.when(
            bind(clean_url(raw), wrapped), F.coalesce(decode_bing_token(token), raw)
        ).otherwise(raw)

    return bind(bind(trim_space(href), target), outward)


def unwrap_href(href: Column, engine: Column) -> Column:
    """Target of a result link of the given engine, NULL when it is not an outward http(s) link."""
    plain = F.when(
        href.startswith("http") & ~bind(clean_url(href), host_of).isin(*fixed.SEARCH_HOSTS), href
    )
    return F.when(engine == "yahoo", unwrap_yahoo(href)).when(engine == "bing", unwrap_bing(href)).otherwise(plain)


def _table(pairs: dict[str, str]) -> Column:
    """A map made of two separators that no key or value holds; folded to a constant."""
    return F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in pairs.items())), F.lit("\x1e"), F.lit("\x1f"))


# Character references of HTML: all names, those that may stand without a semicolon, and the
# numbers that stand for a character of Windows' code page.
_NAMES = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
_BARE_NAMES = {k: v for k, v in html5.items() if not k.endswith(";")}
_CODE_PAGE = {str(c): bytes([c]).decode("cp1252", "replace") for c in range(0x80, 0xA0)}


def decode_entities(text: Column) -> Column:
    """Character references of an attribute's value: numbers and all names of HTML.

    Each ``&`` is looked at once, so no decoded text is decoded again. A name without a semicolon
    counts if it may stand alone and neither a letter, a digit nor ``=`` follows, as in a query.
    """

    def numbered(number: Column) -> Column:
        code = F.when(
            F.lower(number).startswith("x"), F.conv(F.substring(number, F.lit(2), F.length(number)), 16, 10)
        ).otherwise(number)
        code = code.cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        legal = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        of_page = F.try_element_at(_table(_CODE_PAGE), code.cast("string"))
        return F.when(code.between(0x80, 0x9F), of_page).when(legal, char).otherwise("\ufffd")

    def decoded(part: Column) -> Column:
        number = F.regexp_extract(part, "^#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6})(?![0-9A-Fa-f])", 1)
        name = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]*);", 1)
        bare = F.regexp_extract(part, "^([A-Za-z][A-Za-z0-9]*)(?![A-Za-z0-9=;])", 1)
        after = F.regexp_replace(part, "^#?[A-Za-z0-9]*;?", "")
        char = (
            F.when(number != "", numbered(number))
            .when(name != "", F.try_element_at(_table(_NAMES), name))
            .when(bare != "", F.try_element_at(_table(_BARE_NAMES), bare))
        )
        return F.coalesce(F.concat(char, after), F.concat(F.lit("&"), part))

    def whole(parts: Column) -> Column:
        rest = F.transform(F.slice(parts, 2, F.size(parts)), decoded)
        return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))

    return F.when(text.contains("&"), bind(F.split(text, "&"), whole)).otherwise(text)
