"""Links of stored HTML pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import fixed
from linkloom.functions.extract import strip_punctuation, url_matches
from linkloom.functions.unwrap import decode_entities, unwrap_href
from linkloom.operators.numbering import with_dense_ids


def hrefs(html: Column) -> Column:
    """href values of a page: quoted ones as written, then those of anchors with entities decoded.

    Anchors in comments are none.
    """
    shown = F.regexp_replace(html, fixed.COMMENT_PATTERN, "")
    written = F.regexp_extract_all(html, F.lit(fixed.HREF_PATTERN), F.lit(1))
    anchors = F.transform(
        F.regexp_extract_all(shown, F.lit(fixed.ANCHOR_PATTERN), F.lit(0)),
        lambda tag: decode_entities(
            F.concat(*[F.regexp_extract(tag, fixed.ANCHOR_PATTERN, g) for g in (1, 2, 3)])
        ),
    )
    return F.concat(written, anchors)


def distinct_links(links: DataFrame, key: str) -> DataFrame:
    """The links of all pages once each, numbered by ``position`` in page and link order.

    A link most pages share is reduced on the map side.
    """
    first = links.groupBy("url").agg(F.min(F.struct(key, F.col("position").alias("place"))).alias("first"))
    return with_dense_ids(first.select("url", "first.*"), [key, "place"], "position").select("position", "url")


def page_links(pages: DataFrame, key: str, html: str = "html", engine: str = "engine") -> DataFrame:
    """Outward links of each page, distinct, in order of first appearance.

    Links in href attributes come first, then URLs in the text. ``position`` counts from 1 within
    the page. A page's links are sorted out within its own row, which is already as long as its
    text; nothing is shuffled.
    """
    found = F.concat(
        F.transform(hrefs(F.col(html)), lambda h: unwrap_href(h, F.col(engine))),
        F.transform(
            url_matches(F.col(html)), lambda m: unwrap_href(strip_punctuation(m), F.col(engine))
        ),
    )
    distinct = F.array_distinct(F.filter(found, lambda u: u.isNotNull() & (u != "")))
    return pages.select(key, engine, F.posexplode(distinct).alias("position", "url")).withColumn(
        "position", F.col("position").cast("long") + 1
    )
