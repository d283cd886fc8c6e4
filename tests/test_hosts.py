import random

from linkloom.operators.hosts import ends_with_tld, tld_bucket, with_registered_domain
from linkloom.sources.suffix_rules import suffix_rules
from pyspark.sql import functions as F

CASES = {
    "tides.harbour.gov": ("tides", "harbour.gov", "gov"),
    "old.shop.quay.org.uk": ("old.shop", "quay.org.uk", "org.uk"),
    "moss.garden.k12.ca.us": ("moss", "garden.k12.ca.us", "k12.ca.us"),
    "harbour.me.us": ("", "harbour.me.us", "me.us"),
    "xn--9krt00a.xn--55qx5d.cn": ("", "xn--9krt00a.xn--55qx5d.cn", "xn--55qx5d.cn"),
    "1.2.3.4": ("", "1.2.3.4", ""),
    "localhost": ("", "localhost", ""),
    "a.b.unknown": ("a.b", "a.b.unknown", ""),
    "co.uk": ("", "co.uk", "co.uk"),
    "www.ck": ("", "www.ck", "ck"),
    "a.b.c.ck": ("a", "b.c.ck", "c.ck"),
    "x.city.kawasaki.jp": ("x", "city.kawasaki.jp", "kawasaki.jp"),
    "x.y.z.kawasaki.jp": ("x", "y.z.kawasaki.jp", "z.kawasaki.jp"),
}


def test_cases(spark):
    df = spark.createDataFrame([(h,) for h in CASES], "hostname string")
    for r in with_registered_domain(df, parts=True).collect():
        assert (r.subdomain, r.registered_domain, r.suffix) == CASES[r.hostname], r.hostname


def longest(host, rules):
    labels = host.split(".")
    best = 0
    for n in range(1, len(labels) + 1):
        tail = ".".join(labels[-n:])
        if "!" + tail in rules:
            return n - 1
        if tail in rules or "*." + ".".join(labels[-n + 1 :]) in rules and n > 1:
            best = n
    return best


def test_random_hosts_equal_longest_rule(spark):
    rules = ["a", "b.a", "c.b.a", "*.d", "!x.d", "*.b.e", "!y.b.e", "e", "d.c.b.a", "a.a.a.a.a.a", "*.b.b.b.b.b"]
    rnd = random.Random(4)
    hosts = {".".join(rnd.choices("abcdexy", k=rnd.randint(1, 6))) for _ in range(1500)}
    long = ["x.a.a.a.a.a.a", "x.y.b.b.b.b.b", "y.b.b.b.b.b", "z.x.y.b.b.b.b.b", "a.a.a.a.a.a", "b.a.a.a.a.a"]
    hosts = sorted(hosts | set(long))
    df = spark.createDataFrame([(h,) for h in hosts], "hostname string")
    for r in with_registered_domain(df, rules=suffix_rules(spark, rules)).collect():
        n = longest(r.hostname, rules)
        labels = r.hostname.split(".")
        want = ".".join(labels[-n - 1 :]) if 0 < n < len(labels) else r.hostname
        assert r.registered_domain == want, r.hostname


def test_buckets(spark):
    hosts = {"a.gov": ".gov", "a.gov.uk": ".gov", "a.edu": ".edu", "a.org": ".org", "a.net": ".net", "a.com": ".com", "a.uk": "other", "gov": "other"}
    df = spark.createDataFrame([(h,) for h in hosts], "hostname string")
    got = {r.hostname: (r.bucket, r.other, r.gov) for r in df.select(
        "hostname",
        tld_bucket(F.col("hostname")).alias("bucket"),
        ends_with_tld(F.col("hostname"), "other").alias("other"),
        ends_with_tld(F.col("hostname"), ".GOV").alias("gov"),
    ).collect()}
    assert {h: g[0] for h, g in got.items()} == hosts
    assert got["a.gov.uk"] == (".gov", True, False)
    assert got["a.gov"] == (".gov", False, True)


def test_classification_does_not_shuffle(spark):
    df = with_registered_domain(spark.range(10).selectExpr("concat('h', id, '.com') AS hostname"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_the_list_needs_no_other_package(spark, monkeypatch):
    import builtins

    from linkloom.sources import suffix_rules as module

    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: real(name, *a, **k) if name != "idna" else 1 / 0)
    module._own_lines.cache_clear()
    rules = suffix_rules(spark)
    assert rules.where("suffix = 'co.uk' AND is_rule").count() == 1
    assert rules.where("suffix = 'ck' AND is_wildcard").count() == rules.where("suffix = 'www.ck' AND is_exception").count() == 1


def test_large_tables_of_rules_are_not_broadcast(spark, monkeypatch):
    from linkloom.operators import hosts as module

    df = spark.createDataFrame([("x.y.co.uk",), ("a.b",)], "hostname string")
    rules = suffix_rules(spark, ["uk", "co.uk", "b"])
    monkeypatch.setattr(module, "MAX_BROADCAST_RULES", 1)
    found = with_registered_domain(df, rules=rules)
    assert {r.hostname: r.registered_domain for r in found.collect()} == {"x.y.co.uk": "y.co.uk", "a.b": "a.b"}
