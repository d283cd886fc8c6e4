"""Splitting and normalising URLs."""

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions import fixed
from linkloom.functions.barrier import computed_once


def _rest(text: Column, taken: Column, skip: int = 1) -> Column:
    """What follows ``taken`` and ``skip`` separators in ``text``."""
    return F.substring(text, F.length(taken) + 1 + skip, F.lit(fixed.TO_THE_END))


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def clean_url(url: Column) -> Column:
    """White space and control characters around a URL, tabs and line breaks inside it."""
    return F.translate(F.ltrim(trim_space(url), F.lit(fixed.CONTROLS)), "\t\r\n", "")


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority_of(url: Column) -> Column:
    """User info, host and port: between ``//`` and the next ``/``, ``?`` or ``#``."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, empty when there is none."""
    place = F.substring_index(authority_of(url), "@", -1)
    return F.lower(
        F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(
            F.substring_index(place, ":", 1)
        )
    )


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def split_url(df: DataFrame, url: str) -> DataFrame:
    """Add the parts of ``url``: scheme, authority, userinfo, host, port_text, path, query, fragment.

    Written with substring functions only, one projection per step, so that the work stays in
    generated code and no part is computed twice.
    """
    u = F.col(url)
    rest, authority, place = F.col("rest"), F.col("authority"), F.col("place")
    after_slashes = F.substring(rest, F.lit(3), F.lit(fixed.TO_THE_END))
    for mark in "/?#":
        after_slashes = F.substring_index(after_slashes, mark, 1)
    return (
        df.withColumn("scheme", scheme_of(u))
        .withColumn("rest", F.when(F.col("scheme") == "", u).otherwise(_rest(u, F.col("scheme"))))
        .withColumn("authority", F.when(rest.startswith("//"), after_slashes).otherwise(""))
        .withColumns(
            {
                "rest": F.when(rest.startswith("//"), _rest(rest, authority, 2)).otherwise(rest),
                "place": F.substring_index(authority, "@", -1),
            }
        )
        .withColumns(
            {
                "before_fragment": F.substring_index(rest, "#", 1),
                "userinfo": F.left(authority, F.length(authority) - F.length(place) - 1),
                "bracketed": place.startswith("["),
            }
        )
        .withColumns(
            {
                "fragment": _rest(rest, F.col("before_fragment")),
                "path": F.substring_index("before_fragment", "?", 1),
                "host": F.when(
                    F.col("bracketed"), F.concat(F.substring_index(place, "]", 1), F.lit("]"))
                ).otherwise(F.substring_index(place, ":", 1)),
            }
        )
        .withColumns(
            {
                "query": _rest(F.col("before_fragment"), F.col("path")),
                "port_text": _rest(place, F.col("host")),
            }
        )
        .drop("rest", "before_fragment", "place")
    )


def is_normal(url: Column, schemes: Sequence[str] = fixed.DEFAULT_SCHEMES) -> Column:
    """Whether one pattern shows that a URL is valid and already what normalising would make of it."""
    named = "|".join(re.escape(s.lower()) for s in schemes if re.fullmatch(r"[a-z][a-z0-9+.\-]*", s.lower()))
    return url.rlike(f"^(?:{named}){fixed.NORMAL_REST}") if named else F.lit(False)


def _registry_names():
    """The Arrow function for hosts outside plain ASCII, closed over nothing but itself."""

    def lookup(host: pa.Array, authority: pa.Array) -> pa.Array:
        import pyarrow
        import unicodedata

        def registry_name(name: str, place: str) -> str | None:
            plain = place.translate({ord(c): None for c in "@:#?"})
            folded = unicodedata.normalize("NFKC", plain)
            if folded != plain and any(c in folded for c in "/?#@:"):
                return None
            import idna  # a host outside ASCII cannot be stored without it

            try:
                if name.startswith("xn--") or ".xn--" in name:
                    return idna.encode(idna.decode(name)).decode("ascii")
                return idna.encode(name).decode("ascii")
            except (idna.IDNAError, UnicodeError):
                return name

        if host.null_count == len(host):
            return pyarrow.nulls(len(host), pyarrow.string())
        pairs = list(zip(host.to_pylist(), authority.to_pylist()))
        known = {p: registry_name(*p) for p in set(pairs) if p[0] is not None and p[1] is not None}
        return pyarrow.array([known.get(p) for p in pairs], pyarrow.string())

    return F.arrow_udf(lookup, T.StringType())


def registry_name(host: Column, authority: Column) -> Column:
    """IDNA 2008 form of a host; NULL for NULL, and where the authority is not allowed.

    An authority is not allowed when its compatibility form contains a URL delimiter.
    """
    return _registry_names()(host, authority)


def normalize_urls(
    df: DataFrame,
    raw: str = "raw_url",
    schemes: Sequence[str] = fixed.DEFAULT_SCHEMES,
    international_hosts: bool = True,
    trimmed: bool = False,
    parts: bool = True,
) -> DataFrame:
    """Add normalized_url, scheme, hostname, port, path, query, fragment, valid and reason.

    Without ``parts`` just normalized_url, valid and reason: what one pattern shows to be normal already
    is not split then, which is most of the work.

    Scheme and host are lower-cased, the host loses outer dots and takes its IDNA form, default
    ports go; path, query and fragment stay as they are. ``reason`` of an invalid URL is one of
    ``empty``, ``scheme``, ``host``, ``port``, ``authority``.

    Hosts that are plain ASCII never need Python. ``international_hosts=False`` leaves the Python
    step out for data known to have no other hosts, ``trimmed`` the removal of white space for
    URLs that are matches of the extraction.
    """
    accepted = [s.lower() for s in schemes]
    host = F.col("host")
    port_text = F.col("port_text")
    number = F.col("port")
    default = F.lit(False)
    for scheme, port in fixed.DEFAULT_PORTS.items():
        default = default | ((F.col("scheme") == scheme) & (number == port))
    cleaned = df.withColumn("cleaned", F.col(raw) if trimmed else clean_url(F.col(raw)))
    if not parts:  # the functions below are not run for NULL
        cleaned = cleaned.withColumn("normal", F.coalesce(is_normal(F.col("cleaned"), accepted), F.lit(False)))
        cleaned = cleaned.withColumns({"kept": F.when(F.col("normal"), F.col("cleaned")), "cleaned": F.when(~F.col("normal"), F.col("cleaned"))})
    split = (
        split_url(cleaned, "cleaned")
        .withColumns(
            {
                "host": F.btrim(F.lower(host), F.lit(".")),
                "port": F.when(port_text.rlike("^0*[0-9]{1,5}$"), port_text.cast("int")),
            }
        )
        .withColumns(
            {
                "port_ok": (port_text == "") | F.coalesce(number <= 65535, F.lit(False)),
                "port": F.when(~default, number),
                "authority_ok": F.when(
                    F.col("bracketed"),
                    host.rlike(r"^\[(?:[0-9a-f]*:[0-9a-f:.]*(?:%.+)?|v[0-9a-f]+\..+)\]$"),
                ).otherwise(~F.contains("authority", F.lit("[")) & ~F.contains("authority", F.lit("]"))),
            }
        )
    )
    if international_hosts:
        special = (
            (F.length("authority") != F.octet_length("authority"))
            | host.startswith("xn--")
            | host.contains(".xn--")
        )
        split = (
            split.withColumn("special", special & ~F.col("bracketed"))
            .withColumn(
                "registry_name",
                registry_name(
                    F.when(F.col("special"), host), F.when(F.col("special"), F.col("authority"))
                ),
            )
            .withColumn(
                "authority_ok",
                F.col("authority_ok") & ~(F.col("special") & F.col("registry_name").isNull()),
            )
            .withColumn("host", F.coalesce("registry_name", host))
            .drop("special", "registry_name")
        )
    reason = (
        F.when(F.coalesce(F.col("cleaned"), F.lit("")) == "", "empty")
        .when(~F.col("authority_ok"), "authority")
        .when(~F.col("scheme").isin(accepted), "scheme")
        .when(host == "", "host")
        .when(~F.col("port_ok"), "port")
    )
    user = F.substring_index("userinfo", ":", 1)
    normalized = F.concat(
        F.col("scheme"),
        F.lit("://"),
        F.when(user != "", F.concat("userinfo", F.lit("@"))).otherwise(""),
        host,
        F.when(F.col("port").isNotNull(), F.concat(F.lit(":"), F.col("port").cast("string"))).otherwise(""),
        F.col("path"),
        F.when(F.col("query") != "", F.concat(F.lit("?"), "query")).otherwise(""),
        F.when(F.col("fragment") != "", F.concat(F.lit("#"), "fragment")).otherwise(""),
    )
    if not parts:
        checked = split.withColumn("reason", F.when(~F.col("normal"), reason)).withColumn("valid", F.col("reason").isNull())
        told = F.when(F.col("normal"), F.col("kept")).when(F.col("valid"), normalized).otherwise(F.col("cleaned"))
        return computed_once(checked, df.columns, [told.alias("normalized_url"), F.col("valid"), F.col("reason")])
    checked = split.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())

    def part(column: Column, name: str) -> Column:
        return F.when(F.col("valid"), column).alias(name)

    return computed_once(
        checked,
        df.columns,
        [
            F.when(F.col("valid"), normalized).otherwise(F.col("cleaned")).alias("normalized_url"),
            F.col("scheme"),
            part(host, "hostname"),
            part(F.col("port"), "port"),
            part(F.col("path"), "path"),
            part(F.col("query"), "query"),
            part(F.col("fragment"), "fragment"),
            F.col("valid"),
            F.col("reason"),
        ],
    )
