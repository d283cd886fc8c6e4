import base64
import html
from html.entities import html5
from urllib.parse import quote

from pyspark.sql import functions as F

from linkloom.functions.unwrap import decode_entities, percent_decode, unwrap_href
from linkloom.sources.pages import hrefs, page_links

PLAN = "https://plans.harbour.example/2024/quay+east.pdf?sheet=3&scale=1:50"


def token(url):
    return "a1" + base64.urlsafe_b64encode(url.encode()).decode().rstrip("=")


CASES = [
    ("yahoo", f"https://r.search.yahoo.com/_ylt=Aw0;_ylu=Y29/RV=2/RE=17/RO=10/RU={quote(PLAN, safe='')}/RK=0/RS=k9-", PLAN),
    ("yahoo", f"/ru={quote(PLAN, safe='')}", None),
    ("yahoo", "https://search.yahoo.com/preferences?lang=fr", None),
    ("yahoo", "  /RU=http%3A%2F%2Fq.com/a%2Bb+c%zz&d/RK", "http://q.com/a+b+c%zz"),
    ("yahoo", " http://plain.com/ ", "http://plain.com/"),
    ("yahoo", "/RU=https%3A%2F%2Fwww.bing.com%2F/RK=2", None),
    ("bing", f"https://www.bing.com/ck/a?hsh=3&ntb=1&u={token(PLAN)}&fclid=2", PLAN),
    ("bing", f"HTTPS://BING.com/ck/a?u=&u={token('http://x.org/' + chr(228))}&z", "http://x.org/\u00e4"),
    ("bing", "https://www.bing.com/ck/a?ntb=1&u=a1%%%", None),
    ("bing", f"https://www.bing.com/ck/a?u={token('ftp://x.org/')}", None),
    ("bing", f"https://www.bing.com/other?u={token(PLAN)}", None),
    ("bing", "https://r.bing.com/rp/x.js", None),
    ("bing", "mailto:a@b.c", None),
    ("other", "http://google.com/x", None),
    ("other", "http://example.com/x", "http://example.com/x"),
    ("other", "//example.com/x", None),
    ("yahoo", "", None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(CASES)], "id int, engine string, href string")
    for r in df.withColumn("url", unwrap_href(F.col("href"), F.col("engine"))).collect():
        assert r.url == CASES[r.id][2], CASES[r.id]


def test_tokens_of_every_length(spark):
    urls = ["http://" + "x" * n for n in range(1, 40)]
    df = spark.createDataFrame([(u, f"https://bing.com/ck/a?u={token(u)}") for u in urls], "u string, href string")
    for r in df.withColumn("url", unwrap_href(F.col("href"), F.lit("bing"))).collect():
        assert r.url == r.u


def test_percent_decoding(spark):
    df = spark.createDataFrame([("a%20b+c%2",), ("%C3%A4%",), ("100%zz%41",)], "t string")
    assert [r[0] for r in df.select(percent_decode(F.col("t"))).collect()] == ["a b+c%2", "\u00e4%", "100%zzA"]


def test_entities(spark):
    df = spark.createDataFrame([("?a=1&amp;b&#38;c&#x20AC;&#65;&lt;&quot;",), ("plain",), ("&#0;",)], "t string")
    assert [r[0] for r in df.select(decode_entities(F.col("t"))).collect()] == ['?a=1&b&c\u20acA<"', "plain", "\ufffd"]


def test_names_of_entities(spark):
    names = sorted(n for n in html5 if n.endswith(";"))
    texts = [f"x&{n}y" for n in names] + [f"a&{n[:-1]} &{n}" for n in names[::7]] + ["&#150;&#X80;&#9;"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.withColumn("d", decode_entities(F.col("t"))).collect():
        assert r.d == (html.unescape(r.t) if r.t.startswith(("x", "&")) or r.t[2 : r.t.index(" ")] in html5 else r.t[: r.t.index(" ")] + " " + html.unescape(r.t.split(" ")[1])), r.t


def test_entities_that_are_none(spark):
    cases = {
        "?x=1&copy=2&lang=de": "?x=1&copy=2&lang=de", "&copy &copyx &nosuch; &": "\u00a9 &copyx &nosuch; &", "&amp;lt;": "&lt;",
        "&#38;lt;": "&lt;", "&#x26;#65;": "&#65;", "&&amp;&": "&&&", "caf&eacute": "caf\u00e9", "&#;&#x;": "&#;&#x;", "&#12345678;": "&#12345678;",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in df.withColumn("d", decode_entities(F.col("t"))).collect():
        assert r.d == cases[r.t], r.t


def test_anchors_in_comments(spark):
    page = "<!-- <a href=http://a.test/1>x</a> --><a href=http://b.test/?q&eacute;>y</a><!-- open <a href=http://c.test/>"
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert df.select(hrefs(F.col("html"))).first()[0] == ["http://b.test/?q\u00e9"]


def test_page_links(spark):
    wrapped = f"https://r.search.yahoo.com/RV=2/RU={quote(PLAN, safe='')}/RK=0/RS=q"
    page = (
        f"<ol><li><A id=1 title='a>b' HREF = '{wrapped}'>quay</a><li><a href=\"http://moss.test/?a=1&amp;b=2\">moss</a>"
        '<li><a href=http://un.quoted/x>bare</a>, or http://plain.test/Moss_(plant).<link href="http://style.test/s.css">'
        f"<li><a href='{wrapped}'>once more</a><a href='/help'>help</a></ol>"
    )
    df = spark.createDataFrame([(1, page, "yahoo"), (2, "", "yahoo"), (3, None, "bing")], "page_id int, html string, engine string")
    rows = page_links(df, "page_id").orderBy("position").collect()
    assert [r.url for r in rows] == [
        PLAN,
        "http://moss.test/?a=1&amp;b=2",
        "http://style.test/s.css",
        "http://moss.test/?a=1&b=2",
        "http://un.quoted/x",
        "http://plain.test/Moss_(plant)",
    ]
    assert [r.position for r in rows] == [1, 2, 3, 4, 5, 6]
    plan = page_links(df, "page_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
