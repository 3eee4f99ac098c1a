"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, hard_negatives, licenses, line_dedup, mixing, ngram_join, quality, sharding, token_counts, top_inner_products, toxicity, warc
from .common import table
from .oracles import ORACLES

SHARDS = 24


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archived(table(spark, sf_dir, "pages"), min_bytes=100)
    measured = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("digest"))
    return back.select(
        F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", measured.alias("payload_digest"),
        "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = ngram_join.jaccard_join(table(spark, sf_dir, "documents"), width=3, threshold=ngram_join.Threshold(90, 100))
    return members.select("doc_id", "n_shingles", "component_id", "class_size")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256.0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=13, share=20)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the decontamination index: where an item's three longest words stand within twenty words."""
    words = F.transform(F.filter(F.split("text", decontaminate.BREAKS), lambda w: w != ""), F.lower)
    longest = F.slice(F.array_sort(F.transform(F.array_distinct(words), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), 1, 3)
    items = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(longest, lambda x: x["w"]), " ").alias("text"))
    return decontaminate.proximity_matches(table(spark, sf_dir, "documents"), items, within=20).select("item_id", "doc_id", "first_pos", "last_pos")


LICENSE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"), LICENSE_PHRASES)
    own = F.array_distinct(F.col("base.label"))
    every = F.array_distinct(F.concat(F.col("base.label"), F.col("detections.label")))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        F.array_join(F.array_sort(own), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"), "score",
    )


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the phrases among op8's results."""
    return op8_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = token_counts.build_trees(table(spark, sf_dir, "documents").select("doc_id", "text"))
    edited = token_counts.apply_edits(trees.withColumn("edits", token_counts.scripted_edits()))
    return edited.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_edits", "n_recut", F.size(F.get("token_sums", F.lit(0))).cast("long").alias("n_leaves"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chars, judge = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), chars, judge)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    space, voters = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs.select("doc_id", "text"), space, voters)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"), least=100, longest=5, cover=100, first=2000)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.labelled_vectors(table(spark, sf_dir, "embeddings"), label), every=100, n_positives=5, k=10, low=30, high=90)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_warc, op3_ngram_join, op4_line_dedup, op5_top_inner_products, op6_mixing, op7_decontamination, proximity_matches, op8_license_scan, license_phrases, op9_token_counts, op10_toxicity, op11_quality, op12_collocations, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
