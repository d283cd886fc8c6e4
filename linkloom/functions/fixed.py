"""Patterns, word lists and constants the results depend on."""

# White space in the Unicode sense; Java's \s is ASCII only, so it is spelled out.
ASCII_WHITESPACE = (*range(0x09, 0x0E), *range(0x1C, 0x21))
WIDE_WHITESPACE = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# What else ends a URL.
DELIMITERS = "<>\"'{}|\\^`[]"


def _class(codes) -> str:
    return "".join(rf"\x{{{c:X}}}" for c in codes)


# Any run of characters that do not end a URL. ASCII is listed character by character, which
# Java matches by table; other characters are only looked at where an ASCII run stops.
_URL_ASCII = _class(c for c in range(0x80) if c not in ASCII_WHITESPACE and chr(c) not in DELIMITERS)
_URL_WIDE = r"^\x{00}-\x{7F}" + _class(WIDE_WHITESPACE)
URL_PATTERN = rf"([hH][tT][tT][pP][sS]?://(?:[{_URL_ASCII}]++|[{_URL_WIDE}]++)++)"

WHITESPACE_CLASS = _class((*ASCII_WHITESPACE, *WIDE_WHITESPACE))
HREF_PATTERN = (
    r"(?i)href[" + WHITESPACE_CLASS + r"]*=[" + WHITESPACE_CLASS + r"]*[\"']([^\"']+)[\"']"
)
# An anchor tag's href in any quoting; groups: double quoted, single quoted, bare.
ANCHOR_PATTERN = (
    r"(?is)<a\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*?\bhref\s*=\s*"
    r"(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))"
)
COMMENT_PATTERN = r"(?s)<!--.*?(?:-->|\z)"

# White space as characters, for trimming.
WHITESPACE = "".join(chr(c) for c in (*ASCII_WHITESPACE, *WIDE_WHITESPACE))
# C0 controls and space, dropped from the front of a URL before it is split.
CONTROLS = "".join(chr(i) for i in range(33))

# Prose punctuation dropped from the end of a match. Brackets, braces and quotes cannot occur in one.
TRAILING_PUNCTUATION = ".,;:!?)]}'\"”’»"
MAX_URL_LENGTH = 8192
# A length beyond any text's, so that what is left of one is taken without counting its characters.
TO_THE_END = 2**31 - 1

DEFAULT_SCHEMES = ("http", "https")
DEFAULT_PORTS = {"http": 80, "https": 443}
# After the scheme, a URL that normalising leaves as it is: a lower-case host with no two marks in a row, a port
# that no scheme has by default, and no mark for an empty query or fragment.
NORMAL_REST = (
    r"://[a-z0-9]++(?:[._-][a-z0-9]++)*+(?::(?:[1-5][0-9]{4}|[1-9][0-9]{3}))?+"
    r"(?:/[^?#\t\r\n]*+)?+(?:\?[^#\t\r\n]++)?+(?:#[^\t\r\n]++)?+\z"
)

# Result links that lead back to a search engine are not kept.
SEARCH_HOSTS = (
    "search.yahoo.com",
    "r.search.yahoo.com",
    "yahoo.com",
    "www.yahoo.com",
    "bing.com",
    "www.bing.com",
    "r.bing.com",
    "duckduckgo.com",
    "google.com",
    "www.google.com",
)
BING_HOSTS = ("bing.com", "www.bing.com")

TLD_BUCKETS = (".gov", ".edu", ".org", ".net", ".com")
PRIORITIES = ("LOW", "NORMAL", "HIGH")
IMPORT_SUFFIXES = (".txt", ".csv")
CSV_SAMPLE_CHARS = 65536
PAGE_LIMIT = 200
SOURCE_NAME_LENGTH = 240
