"""Connected parts of a graph in a number of rounds that grows with the logarithm of its length (SRC4, PRJ1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def connected_parts(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, part): every node of ``links`` and the smallest node of its connected part.

    Large-star and small-star steps (Kiveris et al. 2014) by turns: a node first hands its larger neighbours to the smallest
    one around it, then its smaller ones, itself included. Both are an aggregate and a join, so a node of many links is
    combined before the shuffle. Each round is written; it ends when links no longer change. A link of a node with itself
    makes it a part of its own; links with a null end are left out."""
    known = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    alone = known.filter("x = y").select(F.col("x").alias("node"))
    now = written(known.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links")
    mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    while mark[0]:
        around = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = around.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        handed = around.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        least = handed.groupBy("x").agg(F.min("y").alias("m"))
        smaller = handed.join(least, "x").filter("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        now = written(smaller.unionByName(least.select("x", F.col("m").alias("y"))).distinct(), "links")
        before, mark = mark, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if mark == before:
            break
    stars = now.select(F.col("x").alias("node"), F.col("y").alias("part"))
    return stars.unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("part"))).unionByName(alone.select("node", F.col("node").alias("part"))).groupBy("node").agg(F.min("part").alias("part"))
