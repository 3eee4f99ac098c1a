"""Queries on statistics per group, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences
from ..operators import kernels, neighbours, off_targets, stats, traces, windows
from ..session import table
from .registry import query


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "group_stats",
    """
    SELECT l_partkey, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(avg(l_extendedprice), 6) AS mean, round(stddev_samp(l_extendedprice) / sqrt(count(l_extendedprice)), 6) AS sem,
           round(arg_min(l_extendedprice, l_orderkey * 100 + l_linenumber + l_extendedprice / 1000000000), 6) AS first, count(*) AS n FROM lineitem GROUP BY 1
    """,
)
def group_stats(spark, sf_dir):
    """AGG6."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice", (F.col("l_orderkey") * 100 + F.col("l_linenumber") + F.col("l_extendedprice") / 1_000_000_000).alias("k"))
    return _rounded(stats.group_stats(rows, ["l_partkey"], "l_extendedprice", "k").drop("members"), "median", "mean", "sem", "first")


@query("median_by", "SELECT l_suppkey, l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS median FROM lineitem GROUP BY 1, 2")
def median_by(spark, sf_dir):
    """AGG7."""
    return _rounded(stats.median_by(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_quantity"), "median")


@query(
    "mad_bands",
    """
    WITH m AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.5) AS mid FROM lineitem GROUP BY 1),
    d AS (SELECT l_suppkey, mid, quantile_cont(abs(l_extendedprice - mid), 0.5) AS mad FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1, 2)
    SELECT l_suppkey, round(mid, 5) AS median, round(mad, 5) AS mad, round(mid - mad, 5) AS low, round(mid + mad, 5) AS high FROM d
    """,
)
def mad_bands(spark, sf_dir):
    """AGG8."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice")
    return _rounded(stats.mad_bands(rows, ["l_suppkey"], "l_extendedprice"), "median", "mad", "low", "high", digits=5)


@query(
    "robust_z",
    """
    WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.75) AS c FROM lineitem WHERE l_linenumber <= 2)
    SELECT l_orderkey, l_linenumber, round((l_extendedprice - b) * 1.35 / (c - a), 6) AS z FROM lineitem, q
    """,
)
def robust_z(spark, sf_dir):
    """AGG9: the first two lines of orders as the reference."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return _rounded(stats.robust_z(rows, "l_extendedprice", F.col("l_linenumber") <= 2), "z").drop("l_extendedprice")


@query(
    "fov_correction",
    """
    WITH m AS (SELECT l_suppkey, quantile_cont(l_extendedprice, 0.5) AS mid, row_number() OVER (ORDER BY l_suppkey) AS i, count(*) OVER () AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1),
    x AS (SELECT i AS pos, mid FROM m UNION ALL SELECT 1 - i, mid FROM m WHERE i <= 2 UNION ALL SELECT 2 * n + 1 - i, mid FROM m WHERE i > n - 2),
    s AS (SELECT pos, quantile_cont(mid, 0.5) OVER (ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM x),
    r AS (SELECT l_suppkey, mid, mid - sm AS res FROM m JOIN s ON s.pos = m.i),
    ok AS (SELECT l_suppkey, mid FROM r, (SELECT avg(res) AS mu, stddev_pop(res) AS sd FROM r) WHERE abs(res - mu) <= 2 * sd),
    f AS (SELECT l_suppkey, mid / (SELECT max(mid) FROM ok) AS factor FROM ok)
    SELECT l_orderkey, l_linenumber, round(l_extendedprice / factor, 4) AS corrected FROM lineitem JOIN f USING (l_suppkey)
    """,
)
def fov_correction(spark, sf_dir):
    """AGG10, WIN9: suppliers as fields of view."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    out = stats.fov_correction(rows, "l_suppkey", "l_extendedprice", F.col("l_linenumber") <= 3)
    return _rounded(out.select("l_orderkey", "l_linenumber", "corrected"), "corrected", digits=4)


@query(
    "threshold_counts",
    """
    SELECT * FROM (SELECT user_id, CAST(sum(CASE WHEN value - 5 >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_ge_10_0, CAST(sum(CASE WHEN value - 5 >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_ge_50_0, CAST(sum(CASE WHEN value - 5 >= 90 THEN 1 ELSE 0 END) AS BIGINT) AS n_ge_90_0 FROM events GROUP BY 1)
    WHERE greatest(n_ge_10_0, n_ge_50_0, n_ge_90_0) >= 40
    """,
)
def threshold_counts(spark, sf_dir):
    """AGG12: events over three thresholds by user."""
    return stats.threshold_counts(table(spark, sf_dir, "events"), ["user_id"], F.col("value") - 5, [10.0, 50.0, 90.0], at_least=40)


@query(
    "confusion",
    """
    WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels)
    SELECT *, round(fp / (tp + fp + fn + tn), 9) AS fp_rate, round(fn / (tp + fp + fn + tn), 9) AS fn_rate, round((fp + fn) / (tp + fp + fn + tn), 9) AS error_rate FROM c
    """,
)
def confusion(spark, sf_dir):
    """AGG13: quality as truth, toxicity as call."""
    return _rounded(stats.confusion(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1), "fp_rate", "fn_rate", "error_rate", digits=9)


@query(
    "recovery",
    """
    SELECT count(*) AS n, count(*) FILTER (value > 20) AS n_called, round(count(*) FILTER (value > 20 AND event_type = 'click') / count(*) FILTER (value > 20), 9) AS correct_share,
           count(DISTINCT CASE WHEN value > 20 THEN event_type END) AS n_barcodes, count(DISTINCT user_id) AS n_trenches, round(100.0 * count(*) FILTER (value > 20) / count(*), 9) AS percent_called FROM events
    """,
)
def recovery(spark, sf_dir):
    """AGG14."""
    out = stats.recovery(table(spark, sf_dir, "events"), F.col("value") > 20, F.col("event_type") == "click", "event_type", "user_id")
    return _rounded(out, "correct_share", "percent_called", digits=9)


@query("value_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS share FROM lineitem GROUP BY 1, 2")
def value_counts(spark, sf_dir):
    """AGG15."""
    return _rounded(stats.value_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"]), "share", digits=9)


@query(
    "nested_value_counts",
    """
    WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT o_orderpriority, string_agg(n || ':' || o_orderstatus, ',' ORDER BY n DESC, o_orderstatus) AS counts FROM c GROUP BY 1
    """,
)
def nested_value_counts(spark, sf_dir):
    """AGG16."""
    out = stats.nested_value_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderstatus"])
    return out.withColumn("counts", F.array_join(F.transform("counts", lambda x: F.concat_ws(":", x["n"].cast("string"), x["o_orderstatus"])), ","))


@query(
    "column_quantiles",
    """
    SELECT 'l_quantity' AS name, round(quantile_cont(l_quantity, 0.99), 6) AS value FROM lineitem UNION ALL SELECT 'l_discount', round(quantile_cont(l_discount, 0.99), 6) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', round(quantile_cont(l_extendedprice, 0.99), 6) FROM lineitem
    """,
)
def column_quantiles(spark, sf_dir):
    """AGG17."""
    return _rounded(stats.column_quantiles(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], 0.99), "value")


@query(
    "hist_linear",
    "SELECT event_type, CAST(CASE WHEN value = 100 THEN 19 ELSE floor((value - 0) / 5.0) END AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1, 2",
)
def hist_linear(spark, sf_dir):
    """AGG18, equal bins."""
    return stats.histogram(table(spark, sf_dir, "events"), ["event_type"], "value", 0.0, 100.0, 20)


@query(
    "hist_log",
    "SELECT o_orderpriority, CAST(CASE WHEN o_totalprice = 1000000 THEN 15 ELSE floor((ln(o_totalprice) - ln(100)) / ((ln(1000000) - ln(100)) / 16)) END AS INTEGER) AS bin, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 100 AND 1000000 GROUP BY 1, 2",
)
def hist_log(spark, sf_dir):
    """AGG18, log-spaced bins."""
    return stats.histogram(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 100.0, 1_000_000.0, 16, log=True)


@query(
    "pearson_by_group",
    "SELECT l_partkey, round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 6",
)
def pearson_by_group(spark, sf_dir):
    """AGG19."""
    return _rounded(stats.pearson_by(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity", "l_extendedprice"), "r")


@query(
    "pearson_p_values",
    """
    WITH r AS (SELECT l_partkey, corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 6),
    t AS (SELECT *, r * sqrt(n - 2.0) / sqrt(1 - r * r) AS t, n - 2 AS v, atan(r / sqrt(1 - r * r)) AS th FROM r),
    a AS (  -- Student's distribution for whole degrees of freedom, as a finite sum
      SELECT *, CASE WHEN v % 2 = 0 THEN sin(th) * list_sum(list_transform(range(0, v // 2), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda j: (2 * j - 1.0) / (2 * j))), 1) * power(cos(th), 2 * k)))
                     ELSE 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range(0, (v - 1) // 2), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda j: (2.0 * j) / (2 * j + 1))), 1) * power(cos(th), 2 * k + 1))), 0)) END AS inside FROM t)
    SELECT l_partkey, round(r, 6) AS r, n, round(t, 6) AS t, round(1 - abs(inside), 6) AS p FROM a
    """,
)
def pearson_p_values(spark, sf_dir):
    """AGG19 with p values by the t distribution."""
    r = stats.pearson_by(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity", "l_extendedprice")
    out = kernels.with_p_value(r.withColumn("t", stats.pearson_t(F.col("r"), F.col("n"))), "t", F.col("n") - 2)
    return _rounded(out, "r", "t", "p")


@query(
    "bh_fdr",
    """
    WITH t AS (SELECT l_suppkey, round(avg(l_discount) * 10, 6) AS p FROM lineitem GROUP BY 1),
    k AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS m FROM t)
    SELECT l_suppkey, p, round(least(min(p * m / r) OVER (ORDER BY p DESC), 1.0), 9) AS p_adjusted, least(min(p * m / r) OVER (ORDER BY p DESC), 1.0) <= 0.5 AS significant FROM k
    """,
)
def bh_fdr(spark, sf_dir):
    """AGG20: mean discounts taken as p values."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount") * 10, 6).alias("p"))
    return _rounded(stats.benjamini_hochberg(t, "p", 0.5), "p_adjusted", digits=9)


@query(
    "one_sample_t",
    """
    SELECT l_partkey, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, count(l_quantity) AS n,
           round((avg(l_quantity) - (SELECT avg(l_quantity) FROM lineitem)) / (stddev_samp(l_quantity) / sqrt(count(l_quantity))), 6) AS t FROM lineitem GROUP BY 1
    """,
)
def one_sample_t(spark, sf_dir):
    """AGG21."""
    return _rounded(stats.one_sample_t(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity"), "mean", "sd", "t")


@query(
    "vector_mean",
    """
    WITH e AS (SELECT label, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    SELECT label, count(*) AS n, round(avg(x), 6) AS m, CAST(pos AS INTEGER) AS pos FROM e GROUP BY label, pos
    """,
)
def vector_mean(spark, sf_dir):
    """AGG24: elementwise means by label, one row a position."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return stats.vector_mean(rows, ["label"], "v").select("label", "n", F.posexplode("mean").alias("pos", "m")).withColumn("m", F.round("m", 6))


@query(
    "effect_integral",
    """
    WITH e AS (SELECT vec_id, unnest(range(0, 5)) AS k, unnest([embedding[1:11], embedding[12:22], embedding[23:33], embedding[34:44], embedding[45:55]]) AS v FROM embeddings),
    i AS (SELECT vec_id, k, list_sum(list_transform(range(1, 12), lambda j: abs(CAST(v[j] AS DOUBLE)) * CASE WHEN j IN (1, 11) THEN 1 WHEN j % 2 = 0 THEN 4 ELSE 2 END)) * 0.5 / 3 AS part FROM e)
    SELECT vec_id, round(max(part), 6) AS largest, round(sqrt(sum(part * part)), 6) AS norm FROM i GROUP BY vec_id
    """,
)
def effect_integral(spark, sf_dir):
    """AGG25: Simpson integrals of five features of eleven points."""
    v = F.col("embedding").cast("array<double>")
    parts, largest, norm = stats.integrated_effect([F.slice(v, 1 + 11 * k, 11) for k in range(5)], 11, 0.5)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(largest, 6).alias("largest"), F.round(norm, 6).alias("norm"))


@query(
    "representative",
    """
    SELECT l_partkey, l_orderkey, l_extendedprice, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_quantity) AS r FROM lineitem) WHERE r = 1
    """,
)
def representative(spark, sf_dir):
    """AGG26: the dearest line of every part."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_extendedprice", "l_quantity")
    return stats.representative(rows, ["l_partkey"], ["l_quantity"], "l_extendedprice", "l_orderkey")


@query(
    "jaccard_clusters",
    """
    WITH b AS (SELECT lang, source, count(*) AS n_both FROM documents GROUP BY 1, 2), j AS (
      SELECT lang, source, n_both, n_both / (sum(n_both) OVER (PARTITION BY lang) + sum(n_both) OVER (PARTITION BY source) - n_both) AS jaccard FROM b)
    SELECT lang, source, n_both, round(jaccard, 9) AS jaccard, row_number() OVER (PARTITION BY lang ORDER BY jaccard DESC, source) = 1 AND row_number() OVER (PARTITION BY source ORDER BY jaccard DESC, lang) = 1 AS mutual FROM j
    """,
)
def jaccard_clusters(spark, sf_dir):
    """AGG27: languages against sources."""
    return _rounded(stats.cluster_jaccard(table(spark, sf_dir, "documents"), "lang", "source"), "jaccard", digits=9)


@query(
    "replicate_agreement",
    """
    WITH d AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders), k AS (SELECT o_custkey, count(*) AS k FROM d GROUP BY 1)
    SELECT o_orderstatus, round(avg(CASE WHEN k = 1 THEN 1.0 ELSE 0.0 END), 9) AS share_together, count(*) AS n_guides FROM d JOIN k USING (o_custkey) GROUP BY 1
    """,
)
def replicate_agreement(spark, sf_dir):
    """AGG28: customers as guides, order states as clusters."""
    return _rounded(stats.replicate_agreement(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus"), "share_together", digits=9)


@query(
    "pair_distances",
    "SELECT a.label, round(avg(abs(CAST(a.embedding[1] AS DOUBLE) - CAST(b.embedding[1] AS DOUBLE))), 6) AS mean_distance, count(*) AS n_pairs FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.label = b.label GROUP BY 1",
)
def pair_distances(spark, sf_dir):
    """AGG29: distances of neighbours with one label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("x"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), "label", F.col("x").alias("y"))
    return _rounded(stats.pair_distance_means(e.join(other, ["vec_id", "label"]).withColumn("d", F.abs(F.col("x") - F.col("y"))), ["label"], "d"), "mean_distance")


@query(
    "pixel_measure",
    """
    SELECT l_orderkey % 7 AS roi, l_suppkey % 5 AS label, count(*) AS area, round(avg(l_linenumber), 6) AS centroid_y, round(avg(l_partkey), 6) AS centroid_x, min(l_linenumber) AS min_y, max(l_linenumber) AS max_y, min(l_partkey) AS min_x, max(l_partkey) AS max_x,
           round(avg(l_quantity), 6) AS mean_intensity, round(quantile_cont(l_quantity, 0.5), 6) AS median_intensity, max(l_quantity) AS max_intensity FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2
    """,
)
def pixel_measure(spark, sf_dir):
    """AGG31: order lines as pixels."""
    px = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 7).alias("roi"), (F.col("l_suppkey") % 5).alias("label"), "l_linenumber", "l_partkey", "l_quantity")
    return _rounded(stats.measure_objects(px, ["roi"], "label", "l_linenumber", "l_partkey", "l_quantity"), "centroid_y", "centroid_x", "mean_intensity", "median_intensity")


@query(
    "percentile_profile",
    """
    SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.005), 6) AS p0_5, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.995), 6) AS p99_5,
      round(avg(value) FILTER (value >= 30), 6) AS mean_above, round(quantile_cont(value, 0.5) FILTER (value >= 30), 6) AS median_above, round(avg(value) FILTER (value < 30), 6) AS mean_below, round(quantile_cont(value, 0.5) FILTER (value < 30), 6) AS median_below FROM events GROUP BY 1
    """,
)
def percentile_profile(spark, sf_dir):
    """AGG32."""
    out = stats.percentile_profile(table(spark, sf_dir, "events"), ["event_type"], "value", 30.0, few_groups=True)
    return _rounded(out, *[c for c in out.columns if c != "event_type"])


@query(
    "kymograph_report",
    "SELECT count(DISTINCT l_returnflag) AS n_l_returnflag, count(DISTINCT (l_returnflag, l_linestatus)) AS n_l_linestatus, count(DISTINCT (l_returnflag, l_linestatus, l_linenumber)) AS n_l_linenumber, count(DISTINCT (l_returnflag, l_linestatus)) / count(DISTINCT l_returnflag) AS l_linestatus_per_l_returnflag, count(DISTINCT (l_returnflag, l_linestatus, l_linenumber)) / count(DISTINCT (l_returnflag, l_linestatus)) AS l_linenumber_per_l_linestatus FROM lineitem",
)
def kymograph_report(spark, sf_dir):
    """AGG36."""
    return stats.kymograph_report(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query(
    "loglik_filter",
    """
    WITH f AS (SELECT avg(o_totalprice) AS mu, stddev_pop(o_totalprice) AS sd FROM orders WHERE o_orderkey % 2 = 0),
    p AS (SELECT o_custkey, exp(avg(-((o_totalprice - mu) / sd) * ((o_totalprice - mu) / sd) / 2 - ln(sd) - 0.5 * ln(2 * pi()))) AS likelihood FROM orders, f GROUP BY 1)
    SELECT o_custkey, round(likelihood * 1000000, 6) AS likelihood FROM p WHERE likelihood >= (SELECT quantile_cont(likelihood, 0.1) FROM p)
    """,
)
def loglik_filter(spark, sf_dir):
    """AGG38: customers whose orders are likely under the even orders' Gaussian."""
    out = stats.loglik_filter(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", F.col("o_orderkey") % 2 == 0, 0.1)
    return out.withColumn("likelihood", F.round(F.col("likelihood") * 1_000_000, 6))


@query(
    "trench_keep",
    "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (value > 30 AND event_type <> 'error') > round(60 * 0.3))",
)
def trench_keep(spark, sf_dir):
    """AGG39."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    return stats.keep_trenches(rows, ["user_id"], (F.col("value") > 30) & (F.col("event_type") != "error"), 60, 0.3).select("event_id", "user_id")


_PR = """s AS (SELECT n_chars AS threshold, sum(quality) AS tp, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1),
    c AS (SELECT threshold, sum(tp) OVER (ORDER BY threshold DESC) / sum(n) OVER (ORDER BY threshold DESC) AS precision, sum(tp) OVER (ORDER BY threshold DESC) / (SELECT sum(tp) FROM s) AS recall FROM s)"""


@query("pr_curve", f"WITH {_PR} SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM c")
def pr_curve(spark, sf_dir):
    """AGG42: quality against length."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return _rounded(stats.precision_recall(rows, "n_chars", F.col("quality") == 1), "precision", "recall", digits=9)


@query(
    "pr_threshold",
    f"WITH {_PR} SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM c WHERE recall > 0.8 ORDER BY precision DESC, threshold DESC LIMIT 1",
)
def pr_threshold(spark, sf_dir):
    """AGG42: the best precision at a recall above 0.8."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return _rounded(stats.threshold_at_recall(stats.precision_recall(rows, "n_chars", F.col("quality") == 1), 0.8), "precision", "recall", digits=9)


@query(
    "fluctuation_bins",
    """
    WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, value AS y FROM events),
    s AS (SELECT user_id, arg_min(y, r.t) AS y0, CAST(floor(arg_min(y, r.t) / 25.0) AS BIGINT) AS bin FROM r GROUP BY 1),
    l AS (SELECT bin, count(*) AS k, avg(y0) AS mean0 FROM s GROUP BY 1 HAVING count(*) > 3),
    g AS (SELECT bin, r.t AS t, count(*) AS n, avg(y) AS mean, var_pop(y) AS variance, avg(y / nullif(y0, 0)) AS p, any_value(mean0) AS mean0 FROM r JOIN s USING (user_id) JOIN l USING (bin) GROUP BY bin, r.t)
    SELECT bin, t, n, round(mean, 5) AS mean, round(variance, 5) AS variance, round(p, 5) AS p, round(variance / mean0, 5) AS scaled_variance, round(variance / mean0 / nullif(p * (1 - p), 0), 4) + 0.0 AS ratio FROM g
    """,
)
def fluctuation_bins(spark, sf_dir):
    """AGG22: all users' events as traces, with the ratio that the analysis is for."""
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "events").withColumn("t", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long"))
    out = traces.fluctuation_bins(rows.select("user_id", "t", F.col("value").alias("y")), "user_id", "t", "y", 25.0, 3)
    return _rounded(out, "mean", "variance", "p", "scaled_variance", digits=5).withColumn("ratio", F.round("ratio", 4) + 0.0)  # no negative zero


@query(
    "robust_variance",
    """
    WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS mid FROM events GROUP BY 1)
    SELECT event_type, round(mid, 6) AS median, round(power(quantile_cont(abs(value - mid), 0.5) * 1.4826, 2), 5) AS robust_variance FROM events JOIN m USING (event_type) GROUP BY 1, mid
    """,
)
def robust_variance(spark, sf_dir):
    """AGG23."""
    out = traces.robust_variance(table(spark, sf_dir, "events"), ["event_type"], "value", few_groups=True)
    return out.withColumns({"median": F.round("median", 6), "robust_variance": F.round("robust_variance", 5)})


@query(
    "kernel_trace",
    """
    WITH e AS (SELECT user_id, epoch(ts) - (SELECT min(epoch(ts)) FROM events) AS t, value FROM events), g AS (SELECT unnest(range(0, 20)) AS k)
    SELECT user_id, CAST(k AS INTEGER) AS k, round(sum(exp(-power((t - k * 86400.0) / 43200.0, 2) / 2) * value) / nullif(sum(exp(-power((t - k * 86400.0) / 43200.0, 2) / 2)), 0), 5) AS y FROM e, g GROUP BY user_id, k
    """,
)
def kernel_trace(spark, sf_dir):
    """TSR1: events onto twenty daily points, one row a point."""
    events = table(spark, sf_dir, "events")
    start = events.agg(F.min(F.col("ts").cast("timestamp").cast("double")).alias("t0"))
    rows = events.join(F.broadcast(start)).select("user_id", (F.col("ts").cast("timestamp").cast("double") - F.col("t0")).alias("t"), "value")
    out = traces.kernel_traces(rows, ["user_id"], "t", ["value"], [k * 86400.0 for k in range(20)], 43200.0)
    return out.select("user_id", F.posexplode("value").alias("k", "y")).withColumn("y", F.round("y", 5))


@query(
    "knn",
    """
    WITH d AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
    SELECT vec_id, CAST(r AS INTEGER) AS rank, neighbour, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS r FROM d) WHERE r <= 15
    """,
)
def knn(spark, sf_dir):
    """TSR3, TSR4: the fifteen nearest vectors of every vector, by pivots."""
    return neighbours.nearest_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 15).withColumn("distance", F.round("distance", 6))


@query(
    "half_range_mode",
    """
    WITH RECURSIVE s AS (
      SELECT o_orderstatus AS g, list(o_totalprice) AS x, 0 AS i, CAST(NULL AS DOUBLE) AS last, false AS done FROM orders GROUP BY 1
      UNION ALL SELECT g, half, i + 1, middle, i > 0 AND (len(half) < 50 OR coalesce(last = middle, false)) FROM (
        SELECT g, i, last, middle, CASE WHEN len(up) > len(down) THEN up ELSE down END AS half FROM (
          SELECT *, list_filter(x, lambda v: v > middle) AS up, list_filter(x, lambda v: v <= middle) AS down FROM (SELECT *, (list_max(x) + list_min(x)) / 2 AS middle FROM s WHERE NOT done)))
    ) SELECT g AS o_orderstatus, round(list_avg(x), 6) AS mode FROM s WHERE done
    """,
)
def half_range_mode(spark, sf_dir):
    """AGG11: modes of prices by order state; groups above a thousand values are halved by aggregates."""
    return _rounded(kernels.mode_by(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", max_rows=1_000), "mode")


@query("bit_thresholds")
def bit_thresholds(spark, sf_dir):
    """AGG33: on/off thresholds of thirty positions."""
    rows = table(spark, sf_dir, "embeddings").select(F.posexplode(F.slice("embedding", 1, 30)).alias("position", "x")).withColumn("x", F.col("x").cast("double"))
    return kernels.bit_thresholds(rows, "position", "x")


@query(
    "background_threshold",
    """
    WITH e AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 200 AS w FROM lineitem),
    h AS (SELECT CAST(least(floor((l_extendedprice - lo) / w), 199) AS BIGINT) AS b, count(*) AS n FROM lineitem, e GROUP BY 1),
    f AS (SELECT i AS b, coalesce(n, 0) AS n FROM range(0, 200) t(i) LEFT JOIN h ON h.b = i),
    s AS (SELECT b, n + coalesce(lag(n) OVER w, 0) + coalesce(lead(n) OVER w, 0) AS s FROM f WINDOW w AS (ORDER BY b)),
    p AS (SELECT min(b) AS b FROM (SELECT b, s, coalesce(lag(s) OVER (ORDER BY b), s) AS l, coalesce(lead(s) OVER (ORDER BY b), s) AS r FROM s) WHERE s > 0 AND s >= l AND s >= r),
    m AS (SELECT lo + (b + 0.5) * w AS mu FROM p, e)
    SELECT round(mu, 6) AS mu, round(sqrt(avg(power(mu - l_extendedprice, 2)) FILTER (l_extendedprice <= mu)), 6) AS sigma, round(mu + 10 * sqrt(avg(power(mu - l_extendedprice, 2)) FILTER (l_extendedprice <= mu)), 6) AS threshold FROM lineitem, m GROUP BY mu
    """,
)
def background_threshold(spark, sf_dir):
    """AGG34: the first peak of prices and its spread."""
    return _rounded(kernels.background_threshold(table(spark, sf_dir, "lineitem"), "l_extendedprice"), "mu", "sigma", "threshold")


@query("yeo_johnson")
def yeo_johnson(spark, sf_dir):
    """SCL20: order prices, made normal."""
    return kernels.apply_yeo_johnson(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("x")), "x", "y")


_SITES = """
  SELECT {key}, strand, substring(s, i + 4, 20) AS site, CAST(CASE strand WHEN '+' THEN i + 3 ELSE n - i - 23 END AS INTEGER) AS start FROM (
    SELECT {key}, strand, s, length(s) AS n, unnest(list_filter(range(0, length(s) - 22), lambda i: s[i + 1] = 'C' AND s[i + 2] = 'C')) AS i FROM (
      SELECT {key}, '+' AS strand, {nt} AS s FROM {table} UNION ALL SELECT {key}, '-', translate(reverse({nt}), 'ACGT', 'TGCA') FROM {table}) WHERE length(s) >= 23)
"""
_LETTERS = "regexp_replace(translate(regexp_replace(text, '[^a-zA-Z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', '" + "ACGT" * 13 + "'), '[^ACGT]', '', 'g')"


@query(
    "off_target",
    f"""
    WITH t AS (SELECT site, min(start % 32) AS start FROM ({_SITES.format(key="item_id", nt=_LETTERS, table="benchmark")}) GROUP BY site),
    r AS (SELECT DISTINCT site, start % 32 AS start FROM ({_SITES.format(key="doc_id", nt=_LETTERS, table="documents")})),
    code AS (SELECT *, list_reduce(list_transform(range(1, 21), lambda i: CAST(instr('ACGT', site[i]) - 1 AS BIGINT)), lambda a, x: a * 4 + x) AS c FROM (SELECT site FROM t UNION SELECT site FROM r)),
    a AS (SELECT t.*, c FROM t JOIN code USING (site)), b AS (SELECT r.*, c FROM r JOIN code USING (site))
    SELECT a.site, max(CASE WHEN a.start = b.start THEN 0 ELSE 20 - bit_count((xor(a.c, b.c) | (xor(a.c, b.c) >> 1)) & 366503875925) END)::BIGINT AS best_match FROM a, b GROUP BY a.site
    """,
)
def off_target(spark, sf_dir):
    """JON21: targets behind PAMs of whole items against the sites behind PAMs of all whole documents; a start is the place
    within a lane of 32, so that targets meet sites at their own start."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    bases = lambda c: F.regexp_replace(F.translate(F.regexp_replace(c, "[^a-zA-Z]", ""), letters, "ACGT" * 13), "[^ACGT]", "")
    items = table(spark, sf_dir, "benchmark").select("item_id", bases("text").alias("seq"))
    targets = sequences.pam_sites(items, "seq").groupBy(F.col("target").alias("site")).agg(F.min(F.col("start") % 32).alias("start")).withColumn("seq", F.col("site"))
    refs = sequences.pam_sites(table(spark, sf_dir, "documents").select("doc_id", bases("text").alias("seq")), "seq")
    refs = refs.select(F.col("target").alias("ref"), (F.col("start") % 32).alias("ref_start"))
    return off_targets.off_target_scan(targets, refs, "site", "seq", "start", "ref", "ref_start")
