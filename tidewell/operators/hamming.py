"""Nearest barcodes by Hamming distance (JON5, JON6)."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import sized_broadcast

#: At most so many variants of one part of a code are made.
VARIANTS = 4_000


def pack_bits(barcode: Column) -> Column:
    """A string of up to 62 zeros and ones as a long, first bit highest."""
    return F.conv(barcode, 2, 10).cast("long")


def _cuts(n_bits: int, n: int) -> list[tuple[int, int]]:
    edges = [round(i * n_bits / n) for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


def parts_for(n_bits: int, threshold: int, n_codes: int) -> int:
    """Into how many parts to cut codes: of codes at most ``threshold`` bits apart, one part differs in at most
    threshold // parts bits. Wide parts need more variants of each code, narrow ones meet more codes by chance."""

    def cost(n: int) -> float:
        width = n_bits // n
        made = sum(comb(-(-n_bits // n), k) for k in range(threshold // n + 1))
        return float("inf") if made > VARIANTS else n * (made * n_codes * 2.0**-width + made / 100)

    return min(range(1, threshold + 2), key=lambda n: (cost(n), n))


def nearest_within(queries: DataFrame, codebook: DataFrame, query_id: str, query_code: str, book_id: str, book_code: str, n_bits: int, threshold: int, other_than_self: bool = False) -> DataFrame:
    """query_id, book_id, distance: the nearest codebook entry at most ``threshold`` bits away, ties to the smaller id.

    Exact. Codes are cut into parts; the codebook names, part by part, all values a few bits away from its own, and
    queries meet them by equality, so few pairs are compared that are not near. Queries without an entry in reach give
    no row. Many entries behind one value are split by adaptive skew joins.
    """
    cuts = _cuts(n_bits, parts_for(n_bits, threshold, codebook.count()))
    part = lambda code, a, b: F.shiftright(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    asked = [F.struct(F.lit(i).alias("band"), part(F.col(query_code), a, b).alias("part")) for i, (a, b) in enumerate(cuts)]
    q = queries.select(F.col(query_id).alias("_q"), F.col(query_code).alias("_qc"), F.explode(F.array(*asked)).alias("_b")).select("_q", "_qc", "_b.*")
    c = None
    for i, (a, b) in enumerate(cuts):
        flips = [sum(1 << x for x in bits) for k in range(threshold // len(cuts) + 1) for bits in combinations(range(b - a), k)]
        masks = F.explode(F.array(*[F.lit(m).cast("long") for m in flips])).alias("_m")
        near = codebook.select(F.col(book_id).alias("_c"), F.col(book_code).alias("_cc"), masks)
        near = near.select("_c", "_cc", F.lit(i).alias("band"), part(F.col("_cc"), a, b).bitwiseXOR(F.col("_m")).alias("part"))
        c = near if c is None else c.unionByName(near)
    met = q.join(sized_broadcast(c), ["band", "part"])
    if other_than_self:
        met = met.filter("_q <> _c")
    met = met.withColumn("distance", F.bit_count(F.col("_qc").bitwiseXOR(F.col("_cc")))).filter(F.col("distance") <= threshold)
    best = met.groupBy("_q").agg(F.min(F.struct("distance", "_c")).alias("m"))
    return best.select(F.col("_q").alias(query_id), F.col("m._c").alias(book_id if book_id != query_id else f"nearest_{book_id}"), F.col("m.distance").cast("int").alias("distance"))
