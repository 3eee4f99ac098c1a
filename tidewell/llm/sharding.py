"""Sharding: rendezvous hashing of stable record keys over weighted shards. DataFrame functions only.

Every key scores every shard, ``-weight / ln(u)`` with u in (0, 1) drawn from a hash of key and shard, and goes to
the highest score. A shard's share follows its weight, and a new shard takes only the keys whose score it wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, hash60, running_total, written


def _winner(keys: Sequence[Column], shards: range, weights: Sequence[float]) -> Column:
    """struct(score, minus shard) of the best of these shards; ties go to the smaller shard number."""
    w = F.array(*[F.lit(float(weights[s])) for s in shards])

    def scored(s: Column) -> Column:
        u = (F.shiftright(hash60(*keys, s), 8).cast("double") + 0.5) * F.lit(2.0**-52)
        return F.struct((-F.get(w, s - shards.start) / F.ln(u)).alias("score"), (-s).alias("minus"))

    return F.array_max(F.transform(F.sequence(F.lit(shards.start), F.lit(shards.stop - 1)), scored))


def assign_shards(
    df: DataFrame,
    keys: Sequence[str],
    n_shards: int,
    weights: Sequence[float] | None = None,
    shard: str = "shard",
    grown: str | None = None,
    grown_weight: float = 1.0,
) -> DataFrame:
    """Adds ``shard`` (int, 0 to n_shards - 1), and as ``grown`` the shard that the key has with one shard more.

    No shuffle, and no state: the shard depends on the key values, the shard numbers and the weights alone. Null
    keys hash as a value of their own; equal keys share a shard; an empty table stays empty; other columns,
    whatever their names, stay as they are (a column of the name ``shard`` or ``grown`` is replaced).
    """
    weights = list(weights or [1.0] * n_shards)
    if len(weights) != n_shards or min(weights) <= 0:
        raise ValueError("one positive weight a shard")
    cols = [F.col(f"`{k}`") for k in keys]
    best = free_name(df, "_best")
    out = df.withColumn(best, _winner(cols, range(n_shards), weights))
    added = {shard: (-F.col(best)["minus"]).cast("int")}
    if grown:
        new = _winner(cols, range(n_shards, n_shards + 1), [*weights, grown_weight])
        added[grown] = (-F.greatest(F.col(best), new)["minus"]).cast("int")
    return out.withColumns(added).drop(best)


def with_slots(df: DataFrame, order: Sequence[str], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Adds ``slot``: a number from 0 without gaps within each shard, in order of a hash of the ``order`` columns.

    Rows are split by shard and hash bucket, so no shard is one task. ``df`` is read twice; hand in what comes from a
    written table by steps that give the same rows again.
    """
    one = free_name(df, "_one")
    return running_total(df.withColumn(one, F.lit(1).cast("long")), [shard], order, one, slot).drop(one)


def shard_documents(docs: DataFrame, n_shards: int, weights: Sequence[float] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard, copies.

    Null texts have size 8 and the crc32 of nothing, 0. Rows that repeat an id and a text are counted before the
    shuffle and get slots of their own after it; ``copies`` says how many such rows there are.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    grouped = digest.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    placed = written(assign_shards(grouped, ["doc_id"], n_shards, weights, grown="grown_shard"), "shards")
    slotted = running_total(placed, ["shard"], ["doc_id", "size", "text_crc32"], "copies", "first_slot")
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("first_slot"), F.col("first_slot") + F.col("copies") - 1)).alias("slot"),
        "grown_shard", "copies",
    )


def sharded_corpus(docs: DataFrame, n_shards: int, weights: Sequence[float] | None = None) -> DataFrame:
    """``docs`` with shard and slot beside its columns (columns of these names are replaced); rows as they are."""
    h = free_name(docs, "_text_hash")
    rows = assign_shards(docs.drop("slot"), ["doc_id"], n_shards, weights).withColumn(h, F.xxhash64("text"))
    return with_slots(rows, ["doc_id", h]).drop(h)
