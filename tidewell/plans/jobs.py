"""The three workloads, end to end, as functions of tables; see each for its columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar, keys, paths
from ..operators import filters, groups, hamming, joins, pairing, stats, traces


def prepare_reads(reads: DataFrame, alignments: DataFrame, segment_lengths: DataFrame, forward: Sequence[str], ends: tuple[Sequence[str], Sequence[str]]) -> DataFrame:
    """Workload A, steps 1 to 4: reads with their paths turned forward, end-to-end and primary flags, duplex validity
    and the largest divergence of their segments."""
    cut = cigar.cut_by_segment(pairing.primary_alignments(alignments).filter("is_primary_alignment"), segment_lengths)
    off = filters.max_divergence(cut.filter(F.col("position").isNotNull()))
    joined = pairing.join_reads_and_alignments(reads, pairing.primary_alignments(alignments), include_unaligned=False)
    flagged = paths.flag_end_to_end(paths.normalize_paths(joined, forward), ends, "full_path")
    judged = flagged.filter("is_primary_alignment and end_to_end").withColumn("path_key", F.array_join("path", ""))
    valid = pairing.flag_valid_duplex(judged, "name", "path_key", "reverse_complement").select("name", "is_valid")
    return flagged.join(valid, "name", "left").join(off, "name", "left").withColumn("path_hash", keys.path_hash(F.col("path")))


def consensus(prepared: DataFrame, seq: str, quality: str, min_depth: int, max_group: int, max_divergence: float = 1.0) -> DataFrame:
    """Workload A, steps 5 to 7: one majority consensus per path of enough depth, over its best reads of its most
    frequent length: path_hash, depth, consensus."""
    good = prepared.filter(F.col("path").isNotNull() & F.coalesce("is_valid", F.lit(True)) & (F.coalesce("max_divergence", F.lit(0.0)) <= max_divergence))
    deep = groups.depth_by(good, ["path_hash"]).filter(F.col("depth") >= min_depth)
    narrow = good.select("name", "path_hash", seq, quality).join(deep, "path_hash")
    best = groups.best_rows(narrow, ["path_hash"], quality, max_group, ["name"], salt=8)
    size = best.groupBy("path_hash", F.length(seq).alias("len")).count().groupBy("path_hash").agg(F.max_by("len", F.struct("count", "len")).alias("len"))
    fitting = best.join(size, "path_hash").filter(F.length(seq) == F.col("len"))
    return groups.column_vote(fitting, ["path_hash"], seq).join(deep, "path_hash")


def mutation_spectrum(segments: DataFrame, by: Sequence[str]) -> DataFrame:
    """SEG3: reads, sums and means of mismatches, insertions and deletions per segment and sample or variant."""
    kinds = ("mismatches", "insertions", "deletions")
    return segments.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).cast("long").alias(f"{k}_total") for k in kinds], *[F.avg(k).alias(f"{k}_mean") for k in kinds])


def call_barcodes(signals: DataFrame, thresholds: Sequence[float], codebook: DataFrame, max_distance: int = 0, removed: Sequence[int] = ()) -> DataFrame:
    """Workload B, steps 3 to 5: trenchid, barcodeid, distance. ``signals``: trenchid, signal (array);
    ``codebook``: barcodeid, barcode."""
    called = signals.select("trenchid", paths.signal_barcode(F.col("signal"), thresholds, removed).alias("barcode"))
    if max_distance == 0:
        return joins.exact_lookup(called, codebook.select("barcodeid", "barcode"), "barcode").select("trenchid", "barcodeid", F.lit(0).alias("distance"))
    coded = lambda df: df.withColumn("code", hamming.pack_bits(F.col("barcode")))
    return hamming.nearest_within(coded(called), coded(codebook), "trenchid", "code", "barcodeid", "code", len(thresholds), max_distance)


def phenotype_by_barcode(phenotype: DataFrame, calls: DataFrame, mapping: DataFrame, value: str) -> DataFrame:
    """Workload B, steps 7 and 8: statistics of a phenotype per called barcode, through a map of trench ids."""
    joined = joins.barcode_phenotype(phenotype, calls.withColumnRenamed("trenchid", "barcode_trenchid"), mapping, "pheno_trenchid", "barcode_trenchid")
    return stats.group_stats(joined, ["barcodeid"], value, "pheno_trenchid")


def guide_traces(steps: DataFrame, guides: DataFrame, time: str, features: Sequence[str], grid: Sequence[float], bandwidth: float, early: Column, above: int = 0) -> DataFrame:
    """Workload C, steps 6 to 8: features made robust z scores, kernel traces per trench, mean trace per guide.

    ``steps``: trenchid, time and features; ``guides``: trenchid, guide. Out: guide, feature, n, mean (array).
    """
    rows = steps
    for f in features:
        rows = stats.robust_z(rows, f, early, f"{f}_z")
    z = [f"{f}_z" for f in features]
    traced = traces.kernel_traces(rows, ["trenchid"], time, z, grid, bandwidth)
    whole = traces.feature_matrix(traced, z).join(guides, "trenchid")
    long = whole.select("guide", F.posexplode("feature_vector").alias("feature", "trace"))
    return stats.vector_mean(long, ["guide", "feature"], "trace", above)
