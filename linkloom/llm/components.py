"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import stage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable, of every node with a link (a, b).

    Alternates two steps until nothing changes: every node hands its smallest neighbour to its larger
    neighbours, then to its smaller ones. Each is one aggregate with partial sums on the map side and
    one join, so a node with very many links is one row in the aggregate and can be split in the
    join. Links are written between rounds; nothing but two sums reaches the driver.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    links = stage(links)
    before = None
    while True:
        state = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before or not state[0]:
            break
        before = state
        # to larger neighbours
        edges = _both_ways(links)
        least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        least = least.select("node", F.least("node", "m").alias("m"))
        large = edges.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("m").alias("a"), "b")
        large = large.where("a < b")
        # to smaller neighbours: a < b, so b's neighbours below it are its a's
        least = large.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("m"))
        small = large.join(least, F.col("b") == F.col("node")).select(F.col("m"), F.explode(F.array("a", "b")).alias("b"))
        links = stage(small.select(F.col("m").alias("a"), "b").where("a < b").distinct())
    below = links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return below.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component"))).groupBy("node").agg(
        F.min("component").alias("component")
    )
