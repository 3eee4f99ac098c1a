"""Queries on whole workloads, sampling and user functions, over the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import cigar, keys, paths, sequences, udf_surface
from ..operators import filters, groups, kernels, pairing, sampling, traces
from ..session import table
from . import jobs
from .registry import query


@query(
    "cigar_merge",
    "SELECT DISTINCT CAST(l_quantity AS INTEGER) AS q, (2 * CAST(l_quantity AS INTEGER)) || '=1X' || CAST(l_quantity AS INTEGER) || 'I' AS merged FROM lineitem",
)
def cigar_merge(spark, sf_dir):
    """SCL2: adjacent operations merged, empty ones dropped."""
    q = F.col("l_quantity").cast("int")
    s = F.concat(q.cast("string"), F.lit("="), q.cast("string"), F.lit("=0D1X"), q.cast("string"), F.lit("I"))
    return table(spark, sf_dir, "lineitem").select(q.alias("q"), cigar.encode(cigar.merge(cigar.decode(s))).alias("merged")).distinct()


@query("gapped_reads", "SELECT doc_id, '---' || s[1:10] || '--' || s[13:] || '-----' AS laid FROM (SELECT doc_id, rpad(regexp_replace(text, '[^ -~]', '?', 'g'), CAST(greatest(length(text), 17) AS INTEGER), '.') AS s FROM documents)")
def gapped_reads(spark, sf_dir):
    """SCL23: whole texts as reads laid on their reference."""
    s = F.rpad(F.regexp_replace("text", "[^ -~]", "?"), F.greatest(F.length("text"), F.lit(17)), F.lit("."))
    d = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    cg = F.concat(F.lit("10M2D2I"), (F.length("s") - 12).cast("string"), F.lit("M"))
    return d.select("doc_id", cigar.gapped(F.col("s"), cg, F.lit(3), F.length("s") + 8).alias("laid"))


@query("permuted_bits", "SELECT vec_id, b[3] || b[1] || '0' || b[4] AS bits FROM (SELECT vec_id, array_to_string(list_transform(embedding[1:4], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS b FROM embeddings)")
def permuted_bits(spark, sf_dir):
    """SCL5."""
    bits = F.array_join(F.transform(F.slice("embedding", 1, 4), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return table(spark, sf_dir, "embeddings").select("vec_id", paths.permute_bits(bits, [2, 0, 1, 3], removed=[1]).alias("bits"))


@query("assembled_paths", "SELECT o_orderkey, 'ACGGT' || CASE WHEN o_orderkey % 2 = 0 THEN 'TTGCA' ELSE 'TGCAA' END AS reference_seq FROM orders")
def assembled_paths(spark, sf_dir):
    """SCL7: sequences along paths, the second segment reversed on odd orders."""
    seg = spark.createDataFrame([("a", "ACGGT"), ("b", "TTGCA")], "name string, seq string")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.lit(">a"), F.when(F.col("o_orderkey") % 2 == 0, ">b").otherwise("<b")).alias("path"))
    return paths.assemble_sequence(o, "path", "o_orderkey", seg).select("o_orderkey", "reference_seq")


@query("mismatch_series", "SELECT doc_id, CAST(m AS INTEGER) AS mismatches, CAST(greatest(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')), 20) AS INTEGER) AS n FROM documents, (SELECT unnest(range(0, 4)) AS m)")
def mismatch_series(spark, sf_dir):
    """SCL18: variants with 0 to 3 leading substitutions, each of full length and so many mismatches away."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bases = F.regexp_replace(F.translate(F.regexp_replace("text", "[^a-zA-Z]", ""), letters, "ACGT" * 13), "[^ACGT]", "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.rpad(bases, F.greatest(F.length(bases), F.lit(20)), F.lit("A")).alias("seq"))
    out = sequences.mismatch_series(d, "seq", 3)
    return out.select("doc_id", sequences.hamming(F.col("seq"), F.col("variant")).alias("mismatches"), F.length("variant").alias("n"))


@query("traversal_barcodes", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderstatus = 'F' THEN '10' ELSE '01' END END AS barcode FROM orders")
def traversal_barcodes(spark, sf_dir):
    """SCL4: bits of traversals between two landmarks, either strand."""
    up = F.array(F.lit(">s"), F.lit(">BIT0ON"), F.lit(">BIT1OFF"), F.when(F.col("o_orderkey") % 3 != 0, ">t").otherwise(">u"))
    down = F.array(F.when(F.col("o_orderkey") % 3 != 0, "<t").otherwise("<u"), F.lit("<BIT0ON"), F.lit("<BIT1OFF"), F.lit("<s"))
    forward = F.col("o_orderstatus") == "F"
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(forward, up).otherwise(down).alias("p"), F.when(forward, "+").otherwise("-").alias("strand"))
    return o.select("o_orderkey", paths.traversal_barcode(F.col("p"), F.col("strand"), ("s", "t")).alias("barcode"))


@query("cell_geometry", "SELECT l_orderkey, l_linenumber, round(pi() * 0.25 * greatest(l_quantity - 1, 0) + 4.0 / 3 * pi() * 0.125, 6) AS volume, round(pi() * greatest(l_quantity - 1, 0) + pi(), 6) AS surface FROM lineitem")
def cell_geometry(spark, sf_dir):
    """SCL21: lines as rods of width 1."""
    volume, surface = keys.spherocylinder(F.col("l_quantity"), F.lit(1.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(volume, 6).alias("volume"), F.round(surface, 6).alias("surface"))


@query("variant_split", "SELECT event_id, event_type AS name, CAST(user_id AS INTEGER) AS variant FROM events")
def variant_split(spark, sf_dir):
    """SCL13: variants after the equals sign, as integers since all are."""
    seg = F.concat(F.lit(">"), "event_type", F.lit("="), F.col("user_id").cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", paths.segment_name(seg).alias("name"), paths.variant_of(seg).alias("variant"))
    return keys.integer_if_all(e, "variant")


@query("segment_filter", "SELECT name FROM (SELECT DISTINCT p_brand AS name FROM part) WHERE name LIKE 'Brand#1%' AND name <> 'Brand#11'")
def segment_filter(spark, sf_dir):
    """PRJ4."""
    return paths.filter_segments(table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct(), include_prefix=["Brand#1"], exclude=["Brand#11"])


@query("default_quality", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 100))) / 64, 6) AS qs FROM embeddings")
def default_quality(spark, sf_dir):
    """PRJ6: mean score where there is no quality."""
    scores = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("double"))
    return filters.default_quality(table(spark, sf_dir, "embeddings").select("vec_id", scores.alias("read_phred"))).select("vec_id", F.round("qs", 6).alias("qs"))


@query("length_filter", "SELECT doc_id FROM documents WHERE length(text) BETWEEN 750 AND 1500")
def length_filter(spark, sf_dir):
    """PRJ9."""
    return filters.length_between(table(spark, sf_dir, "documents"), "text", 750, 1500).select("doc_id")


@query("no_nan", "SELECT vec_id FROM embeddings")
def no_nan(spark, sf_dir):
    """PRJ12: vectors without NaN."""
    return filters.no_nan(table(spark, sf_dir, "embeddings"), ["embedding"]).select("vec_id")


@query("library_cap", "SELECT l_partkey, l_linenumber, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey, l_extendedprice) AS r FROM lineitem) WHERE r <= 3")
def library_cap(spark, sf_dir):
    """TOP2."""
    return sampling.first_per_group(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_linenumber"], ["l_orderkey", "l_extendedprice"], 3).select("l_partkey", "l_linenumber", "l_orderkey")


@query("sampled_groups", "SELECT o_custkey, least(count(*), 4) AS n FROM orders GROUP BY 1")
def sampled_groups(spark, sf_dir):
    """TOP3: four orders per customer without replacement, by hash."""
    return sampling.sample_n(table(spark, sf_dir, "orders"), ["o_orderkey"], 4, ["o_custkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "mutation_spectrum",
    """
    WITH c AS (SELECT l_orderkey, l_linenumber AS n, CAST(min(l_quantity) AS INTEGER) AS q FROM lineitem GROUP BY 1, 2)
    SELECT 's' || q AS segment, count(*) AS n, count(*) AS mismatches_total, CAST(sum(n) AS BIGINT) AS insertions_total, count(*) AS deletions_total, 1.0::DOUBLE AS mismatches_mean, round(avg(n), 6) AS insertions_mean, 1.0::DOUBLE AS deletions_mean FROM c GROUP BY 1
    UNION ALL SELECT 'tail', count(*), 0, 0, count(*), 0.0, 0.0, 1.0 FROM c UNION ALL SELECT 'upstream', count(*), 0, CAST(2 * count(*) AS BIGINT), 0, 0.0, 2.0, 0.0 FROM c
    """,
)
def mutation_spectrum(spark, sf_dir):
    """SEG3: over the alignments of segment_counts."""
    from .registry import queries

    return jobs.mutation_spectrum(queries()["segment_counts"](spark, sf_dir), ["segment"]).withColumn("insertions_mean", F.round("insertions_mean", 6))


@query(
    "duplex_census",
    "SELECT o_orderstatus, "
    + ", ".join(f"CAST(count(*) FILTER (p = '{i}' AND m) AS BIGINT) AS p{i}_match, CAST(count(*) FILTER (p = '{i}' AND NOT m) AS BIGINT) AS p{i}_mismatch" for i in range(1, 6))
    + " FROM (SELECT o_orderstatus, substring(o_orderpriority, 1, 1) AS p, o_totalprice > 100000 AS m FROM orders) GROUP BY 1",
)
def duplex_census(spark, sf_dir):
    """AGG37: order states against all priorities."""
    o = table(spark, sf_dir, "orders").withColumn("pair", F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)))
    return pairing.duplex_census(o, "o_orderstatus", "pair", [f"p{i}" for i in range(1, 6)], F.col("o_totalprice") > 100000)


def _vote(pdf):
    """The majority character at each place, ties to the smallest; counted in numpy."""
    texts = [t.encode("ascii") for t in pdf["seq"].dropna()]
    votes = np.zeros((max(map(len, texts), default=0), 128), np.int32)
    for t in texts:
        votes[np.arange(len(t)), np.frombuffer(t, np.uint8)] += 1
    return {"consensus": votes.argmax(1).astype(np.uint8).tobytes().decode("ascii"), "n_reads": len(pdf)}


@query(
    "consensus_groups",
    """
    WITH d AS (SELECT source, regexp_replace(text, '[^ -~]', '?', 'g') AS s, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, CAST(doc_id AS VARCHAR)) AS r FROM documents WHERE source IS NOT NULL),
    b AS (SELECT source, unnest(range(0, length(s))) AS position, unnest(string_split(s, '')) AS base FROM d WHERE r <= 20 AND length(s) > 0),
    t AS (SELECT source, position, base, row_number() OVER (PARTITION BY source, position ORDER BY count(*) DESC, base) AS k FROM b GROUP BY 1, 2, 3),
    c AS (SELECT source, string_agg(base, '' ORDER BY position) AS consensus FROM t WHERE k = 1 GROUP BY 1)
    SELECT source, consensus, n_reads FROM c JOIN (SELECT source, count(*) AS n_reads FROM d WHERE r <= 20 GROUP BY 1) USING (source)
    """,
)
def consensus_groups(spark, sf_dir):
    """AGG3, UDF1: a user's consensus of each source's twenty longest texts, whole."""
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("name"), "n_chars", F.regexp_replace("text", "[^ -~]", "?").alias("seq"))
    return groups.consensus_per_group(d, "source", _vote, "consensus string, n_reads long", 20, "n_chars").select("source", "consensus", "n_reads")


def _slope(pdf):
    x, y = pdf["event_id"].to_numpy(float), pdf["value"].to_numpy(float)
    dx = x - x.mean()
    return {"slope": float((dx * (y - y.mean())).sum() / (dx * dx).sum()) if len(x) > 1 else None}


@query("user_groups", "SELECT user_id, round(regr_slope(value, event_id), 6) AS slope, count(*) AS n, max(value) AS largest FROM events GROUP BY 1")
def user_groups(spark, sf_dir):
    """UDF1: a user's function of each group's rows, beside built-in aggregates."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    out = udf_surface.map_groups(e, ["user_id"], _slope, "slope double", F.count(F.lit(1)).alias("n"), F.max("value").alias("largest"))
    return out.withColumn("slope", F.round("slope", 6))


def _checksum(t):
    """Characters, and the sum of place times code, modulo a prime."""
    codes = np.frombuffer((t or "").encode("ascii"), np.uint8).astype(np.int64)
    return {"n": len(codes), "checksum": int((codes * np.arange(1, len(codes) + 1)).sum() % 65521)}


_SUM = "coalesce(list_sum(list_transform(string_split(s, ''), lambda c, i: ascii(c) * i)), 0) % 65521"


@query("user_rows", f"SELECT doc_id, length(s) AS n, CAST({_SUM} AS BIGINT) AS checksum FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', '?', 'g') AS s FROM documents)")
def user_rows(spark, sf_dir):
    """UDF2: a user's checksum of each text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "?").alias("text"))
    return udf_surface.map_rows(d, ["text"], _checksum, "n long, checksum long").drop("text")


def _each_batch(pdf):
    return pdf[["doc_id"]].assign(checksum=[_checksum(t)["checksum"] for t in pdf["text"]])


@query("user_partitions", f"SELECT doc_id, CAST({_SUM} AS BIGINT) AS checksum FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', '?', 'g') AS s FROM documents)")
def user_partitions(spark, sf_dir):
    """UDF4: a user's function over batches of each partition."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "?").alias("text"))
    return udf_surface.map_partitions(d, _each_batch, "doc_id long, checksum long")


@query("measured_vectors", "SELECT vec_id, round(CAST(list_max(embedding) - list_min(embedding) AS DOUBLE), 6) AS embedding_spread FROM embeddings")
def measured_vectors(spark, sf_dir):
    """UDF3: a measurement of each vector."""
    return udf_surface.measure_columns(table(spark, sf_dir, "embeddings"), ["embedding"], np.ptp, "spread").select("vec_id", F.round("embedding_spread", 6).alias("embedding_spread"))


@query(
    "user_vectors",
    """
    WITH e AS (SELECT label, unnest(range(0, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    SELECT label, CAST(pos AS INTEGER) AS pos, round(quantile_cont(x, 0.5), 6) AS median FROM e GROUP BY label, pos
    """,
)
def user_vectors(spark, sf_dir):
    """UDF5, TSR5: medians of vectors by label, one row a position."""
    out = udf_surface.median_vectors(table(spark, sf_dir, "embeddings").select("label", "embedding"), ["label"], "embedding")
    return out.select("label", F.posexplode("aggregate").alias("pos", "median")).withColumn("median", F.round("median", 6))


@query(
    "barcode_workload",
    """
    WITH b AS (SELECT vec_id, label, array_to_string(list_transform(embedding[1:12], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS barcode FROM embeddings),
    book AS (SELECT barcode, min(vec_id) AS barcodeid FROM b WHERE label < 5 GROUP BY 1), c AS (SELECT vec_id, barcodeid FROM b JOIN book USING (barcode))
    SELECT barcodeid, round(quantile_cont(o_totalprice, 0.5), 4) AS median, count(*) AS n FROM orders JOIN c ON vec_id = o_orderkey % 500 GROUP BY 1
    """,
)
def barcode_workload(spark, sf_dir):
    """Workload B: vectors called as barcodes, matched to a codebook, joined to orders, summed up by barcode."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trenchid"), "label", F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double")).alias("signal"))
    book = e.filter("label < 5").groupBy(paths.signal_barcode(F.col("signal"), [0.0] * 12).alias("barcode")).agg(F.min("trenchid").alias("barcodeid"))
    calls = jobs.call_barcodes(e, [0.0] * 12, book)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pheno_trenchid"), "o_totalprice")
    mapping = o.select("pheno_trenchid", (F.col("pheno_trenchid") % 500).alias("barcode_trenchid"))
    return jobs.phenotype_by_barcode(o, calls, mapping, "o_totalprice").select("barcodeid", F.round("median", 4).alias("median"), "n")


@query(
    "guide_workload",
    """
    WITH e AS (SELECT user_id, epoch(ts) - (SELECT min(epoch(ts)) FROM events) AS t, value FROM events),
    q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM e WHERE t < 864000),
    z AS (SELECT user_id, t, (value - b) * 1.35 / (c - a) AS z FROM e, q), g AS (SELECT unnest(range(0, 20)) AS k),
    y AS (SELECT user_id, k, sum(exp(-power((t - k * 86400.0) / 86400.0, 2) / 2) * z) / nullif(sum(exp(-power((t - k * 86400.0) / 86400.0, 2) / 2)), 0) AS y FROM z, g GROUP BY user_id, k),
    whole AS (SELECT user_id FROM y GROUP BY 1 HAVING count(y) = 20)
    SELECT user_id % 10 AS guide, CAST(0 AS INTEGER) AS feature, count(*) AS n, CAST(k AS INTEGER) AS k, round(avg(y), 5) AS mean FROM y JOIN whole USING (user_id) GROUP BY user_id % 10, k
    """,
)
def guide_workload(spark, sf_dir):
    """Workload C: events as steps, users as trenches, made z scores, traced and averaged by guide; one row a point."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("trenchid"), F.col("ts").cast("timestamp").cast("double").alias("sec"), "value")
    start = e.agg(F.min("sec").alias("t0"))
    e = e.join(F.broadcast(start)).select("trenchid", (F.col("sec") - F.col("t0")).alias("t"), "value")
    guides = e.select("trenchid", (F.col("trenchid") % 10).alias("guide")).distinct()
    out = jobs.guide_traces(e, guides, "t", ["value"], [k * 86400.0 for k in range(20)], 86400.0, F.col("t") < 10 * 86400.0)
    return out.select("guide", "feature", "n", F.posexplode("mean").alias("k", "mean")).withColumn("mean", F.round("mean", 5))


@query(
    "feature_rows",
    "SELECT vec_id, CAST(unnest(range(0, 2)) AS INTEGER) AS feature, unnest([a, b]) AS points FROM (SELECT vec_id, array_to_string(list_transform(embedding[1:20], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS INTEGER)), ',') AS a, array_to_string(list_transform(embedding[21:40], lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS INTEGER)), ',') AS b FROM embeddings WHERE vec_id % 7 <> 0)",
)
def feature_rows(spark, sf_dir):
    """TSR2: two stretches of each vector stacked in order; every seventh has a gap and goes."""
    v = F.col("embedding").cast("array<double>")
    gap = F.when(F.col("vec_id") % 7 == 0, F.concat(F.slice(v, 21, 19), F.array(F.lit(None).cast("double")))).otherwise(F.slice(v, 21, 20))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(v, 1, 20).alias("a"), gap.alias("b"))
    rows = traces.feature_matrix(e, ["a", "b"]).select("vec_id", F.posexplode("feature_vector").alias("feature", "x"))
    return rows.select("vec_id", "feature", F.array_join(F.transform("x", lambda x: F.round(x * 1000).cast("int").cast("string")), ",").alias("points"))


@query("perfect_reads", "SELECT l_orderkey || '-' || l_linenumber AS name FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING l_linenumber % 2 = 1")
def perfect_reads(spark, sf_dir):
    """PRJ11: reads without a mismatch on any segment; those of even lines have one."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"))
    n, q = F.col("l_linenumber"), F.col("q").cast("string")
    cg = F.when(n % 2 == 1, F.concat(q, F.lit("="))).otherwise(F.concat((F.col("q") - 1).cast("string"), F.lit("=1X")))
    zero = F.lit(0)
    reads = rows.select(F.concat_ws("-", "l_orderkey", n).alias("name"), F.array(F.concat(F.lit(">s"), q)).alias("path"), zero.alias("path_start"), F.col("q").alias("path_end"), F.col("q").alias("path_length"), zero.alias("query_start"), F.col("q").alias("query_end"), F.col("q").alias("query_length"), cg.alias("cg"))
    lengths = spark.range(1, 51).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"), F.col("id").cast("int").alias("length"))
    return filters.perfect_reads(cigar.cut_by_segment(reads, lengths))


@query(
    "segment_structs",
    """
    WITH c AS (SELECT l_orderkey || '-' || l_linenumber AS name, CAST(min(l_quantity) AS INTEGER) AS q, l_linenumber AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
    SELECT name, CAST(20 AS INTEGER) AS tail_matches, true AS tail_reverse, CAST(q + 3 + n AS INTEGER) AS tail_start, CASE WHEN q = 7 THEN CAST(n AS INTEGER) END AS s7_insertions FROM c
    """,
)
def segment_structs(spark, sf_dir):
    """SEG1: the struct form, one row a read."""
    from .barcode_queries import _cigar_reads, _segment_lengths

    cut = cigar.segment_structs(_cigar_reads(spark, sf_dir), _segment_lengths(spark), ["tail", "s7"], keep=["name"])
    return cut.select("name", F.col("tail.matches").alias("tail_matches"), F.col("tail.reverse_complement").alias("tail_reverse"), F.col("tail.query_start").alias("tail_start"), F.col("s7.insertions").alias("s7_insertions"))


@query("parsed_times", "SELECT event_id, epoch_us(date_trunc('milliseconds', ts)) AS start_us, epoch_us(date_trunc('milliseconds', ts)) + CAST(round(value * 1000000) AS BIGINT) AS end_us FROM events")
def parsed_times(spark, sf_dir):
    """SCL11: start times written in UTC to the millisecond and parsed, ends by adding seconds."""
    text = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00"))
    e = table(spark, sf_dir, "events").select("event_id", "value", keys.parse_utc(text).alias("start"))
    return e.select("event_id", keys.micros("start").alias("start_us"), keys.micros(keys.later(F.col("start"), F.col("value"))).alias("end_us"))


@query("duplex_names", "SELECT o_orderkey, o_orderkey % 3 = 0 AS is_duplex, CAST(o_orderkey AS VARCHAR) AS parent_1, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) END AS parent_2 FROM orders")
def duplex_names(spark, sf_dir):
    """SCL12: duplex names and their parents."""
    key, other = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws(";", key, other)).otherwise(key).alias("name"))
    split = keys.parents(F.col("name"))
    return o.select("o_orderkey", keys.is_duplex(F.col("name")).alias("is_duplex"), F.get(split, 0).alias("parent_1"), F.get(split, 1).alias("parent_2"))


@query(
    "interval_slices",
    """
    WITH r AS (SELECT regexp_replace(text, '[^ -~]', '?', 'g') AS s FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)),
    d AS (SELECT doc_id, regexp_replace(d.text, '[^ -~]', '?', 'g') AS s, r.s AS r FROM documents d, r),
    p AS (SELECT doc_id, i.name AS segment, CASE WHEN length(s) >= i.b THEN substring(s, i.a + 1, i.b - i.a) END AS slice, CASE WHEN length(r) >= i.b THEN substring(r, i.a + 1, i.b - i.a) END AS ref
          FROM d, (VALUES ('head', 0, 12), ('body', 12, 112), ('tail', 112, 140)) i(name, a, b))
    SELECT doc_id, segment, slice, CAST(list_sum(list_transform(range(1, length(slice) + 1), lambda i: CASE WHEN slice[i] = ref[i] OR slice[i] = 'N' OR ref[i] = 'N' THEN 0 ELSE 1 END)) AS INTEGER) AS distance FROM p
    """,
)
def interval_slices(spark, sf_dir):
    """SCL24: texts cut by named intervals, each part's distance to the reference's."""
    clean = lambda c: F.regexp_replace(c, "[^ -~]", "?")
    intervals = sequences.intervals_of([("head", 12), ("body", 100), ("tail", 28)])
    ref = table(spark, sf_dir, "benchmark").agg(F.min_by(clean("text"), "item_id").alias("ref"))
    d = table(spark, sf_dir, "documents").select("doc_id", clean("text").alias("s")).join(F.broadcast(ref))
    both = F.arrays_zip(sequences.slice_intervals(F.col("s"), intervals).alias("a"), sequences.segment_distances(F.col("s"), F.col("ref"), intervals).alias("b"))
    return d.select("doc_id", F.explode(both).alias("x")).select("doc_id", F.col("x.a.segment").alias("segment"), F.col("x.a.slice").alias("slice"), F.col("x.b.distance").alias("distance"))


@query(
    "normalised_series",
    """
    WITH e AS (SELECT vec_id, embedding[1:20] AS v FROM embeddings), s AS (SELECT vec_id, v, list_aggregate(list_transform(v, lambda x: CAST(x AS DOUBLE)), 'stddev_pop') AS sd FROM e)
    SELECT vec_id, CAST(unnest(range(0, 20)) AS INTEGER) AS pos, round(unnest(list_transform(v, lambda x: CAST(x AS DOUBLE))) * ((sqrt(sd + 1) - 1) / 0.5) / sd, 5) AS y FROM s
    """,
)
def normalised_series(spark, sf_dir):
    """SCL20: series divided by their spread over its transform."""
    v = F.slice(F.col("embedding").cast("array<double>"), 1, 20)
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return e.select("vec_id", F.posexplode(kernels.spread_normalised([F.col("v")])[0]).alias("pos", "y")).withColumn("y", F.round("y", 5))
