import random
import re

import pytest
from pyspark.sql import functions as F

from linkloom.functions.extract import extract_urls, strip_punctuation, with_stripped

LONG = "http://a.com/" + "x" * 8200
CASES = [
    ("tea https://leaf.example/oolong?cups=2 http://cup.test", ["https://leaf.example/oolong?cups=2", "http://cup.test"]),
    (
        "Minutes of May: https://council.example/may/minutes.odt; June: http://council.example/june!?",
        ["https://council.example/may/minutes.odt", "http://council.example/june"],
    ),
    ("https://one.test/1\thttps://two.test/2\nhttp://three.test", ["https://one.test/1", "https://two.test/2", "http://three.test"]),
    ("plain leaf.example, mailto:me@leaf.example gopher://old.test http:/half", []),
    ("http:// https://", []),
    ("[see http://wiki.test/Moss_(plant)_(old)]).", ["http://wiki.test/Moss_(plant)_(old)"]),
    ("http://list.test/end)/", ["http://list.test/end)"]),
    ("http://...", ["http://"]),
    ("xhttp://mid.word/ HTTPS://Caps.Example", ["http://mid.word/", "HTTPS://Caps.Example"]),
    ("http://a,http://b", ["http://a,http://b"]),
    ("http://a.com\u00a0http://b.com\u3000http://c.com\u2028x", ["http://a.com", "http://b.com", "http://c.com"]),
    ("<http://a.com>\"http://b.com\"'http://c.com'", ["http://a.com", "http://b.com", "http://c.com"]),
    ("http://stra\u00dfe.de/\u00fc\u00fc?\u20ac \u00bbhttp://q.de\u00ab\u00bb", ["http://stra\u00dfe.de/\u00fc\u00fc?\u20ac", "http://q.de\u00ab"]),
    (LONG, []),
    (LONG[:8192] + "...", [LONG[:8192]]),
    (None, []),
]


def test_cases(spark):
    rows = [(i, text) for i, (text, _) in enumerate(CASES)]
    found = extract_urls(spark.createDataFrame(rows, "id int, text string")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.id, r.match_idx)):
        got.setdefault(r.id, []).append(r.raw_url)
    assert got == {i: urls for i, (_, urls) in enumerate(CASES) if urls}


def longest_allowed(token):
    """The longest front of a match that may stand: only punctuation was cut off it, and it ends in
    something else, or in a closing parenthesis that has an opening one."""
    punctuation = ".,;:!?)]}'\"\u201d\u2019\u00bb"
    fronts = [token[:n] for n in range(len(token), -1, -1) if not token[n:].strip(punctuation)]
    paired = lambda t: t.endswith(")") and t.count(")") <= t.count("(")
    front = next(t for t in fronts if not t or t[-1] not in punctuation or paired(t))
    return front.removesuffix("/") if front.endswith(")/") else front


def test_stripping_keeps_the_longest_allowed_front(spark):
    rnd = random.Random(1)
    tokens = ["http://" + "".join(rnd.choices("a()./!,\u201d\u00bbb?", k=rnd.randint(0, 14))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in tokens], "u string")
    out = with_stripped(df, "u", "a").withColumn("b", strip_punctuation(F.col("u"))).collect()
    for r in out:
        assert r.a == r.b == longest_allowed(r.u)


def test_matches_equal_the_stated_pattern(spark):
    rnd = random.Random(2)
    alphabet = "htps:/HTPS:/ab.\t\n \x0b\x1c\x85\xa0\u2003\u200b\u20ac<>\"'{}|\\^`[]()\x01\x7f"
    texts = ["".join(rnd.choices(alphabet, k=20)) + "http://" + "".join(rnd.choices(alphabet, k=20)) for _ in range(3000)]
    rx = re.compile(r"""https?://[^\s<>"'{}|\\^`\[\]]+""", re.I)
    want = {}
    for i, t in enumerate(texts):
        for m in rx.finditer(t):
            want.setdefault(i, []).append(longest_allowed(m.group(0)))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in sorted(extract_urls(df).collect(), key=lambda r: (r.id, r.match_idx)):
        got.setdefault(r.id, []).append(r.raw_url)
    assert got == want


@pytest.mark.parametrize("name", ["id", "text"])
def test_filters_are_not_copied_below_the_extraction(spark, name):
    df = extract_urls(spark.createDataFrame([(1, "http://a.com")], "id int, text string").withColumn("t2", F.col("text")))
    plan = df.where(F.col("raw_url").contains("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    assert plan.count("trim(") == 1
