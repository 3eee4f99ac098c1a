"""Queries on cells, objects, families and time (workload C), over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import filters as flt
from ..operators import groups, joins, numbering, traces, windows
from ..session import table
from .registry import query


def _line_steps(spark, sf_dir):
    """Order lines as steps of a cell: one row per order and line number."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("size"), F.min("l_quantity").alias("q"))


_STEPS = "steps AS (SELECT l_orderkey, l_linenumber, min(l_extendedprice) AS size, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


@query(
    "first_last",
    f"WITH {_STEPS} SELECT l_orderkey, arg_min(size, l_linenumber) AS first_size, arg_max(size, l_linenumber) AS last_size FROM steps GROUP BY 1",
)
def first_last(spark, sf_dir):
    """WIN1."""
    return joins.first_last(_line_steps(spark, sf_dir), ["l_orderkey"], ["l_linenumber"], ["size"])


@query("elapsed", f"WITH {_STEPS} SELECT l_orderkey, l_linenumber, CAST(l_linenumber - min(l_linenumber) OVER (PARTITION BY l_orderkey) AS INTEGER) AS elapsed FROM steps")
def elapsed(spark, sf_dir):
    """WIN2."""
    return windows.elapsed(_line_steps(spark, sf_dir), ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "elapsed")


@query(
    "step_rates",
    f"""
    WITH {_STEPS}, s AS (SELECT l_orderkey, l_linenumber, l_linenumber * 600.0 AS t, size, lag(l_linenumber * 600.0) OVER w AS t0, lag(size) OVER w AS s0 FROM steps WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
    SELECT l_orderkey, l_linenumber, CAST(t - t0 AS DOUBLE) AS dt, CAST((t + t0) / 2 AS DOUBLE) AS mid_time, round((size - s0) * 3600.0 / (t - t0), 4) AS linear_rate, round(ln(2) * (t - t0) / 3600.0 / nullif(ln(size / s0), 0), 4) AS doubling_time FROM s
    """,
)
def step_rates(spark, sf_dir):
    """WIN3: growth between lines, ten minutes apart."""
    rows = _line_steps(spark, sf_dir).withColumn("t", F.col("l_linenumber") * F.lit(600.0))
    out = windows.step_rates(rows, ["l_orderkey"], ["l_linenumber"], "t", "size")
    return out.select("l_orderkey", "l_linenumber", "dt", "mid_time", F.round("linear_rate", 4).alias("linear_rate"), F.round("doubling_time", 4).alias("doubling_time"))


@query(
    "relative_pixels",
    f"WITH {_STEPS} SELECT l_orderkey, l_linenumber, CAST(trunc((q - first_value(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)) / 0.65) AS INTEGER) AS q_px FROM steps",
)
def relative_pixels(spark, sf_dir):
    """WIN4."""
    return windows.relative_pixels(_line_steps(spark, sf_dir), ["l_orderkey"], ["l_linenumber"], ["q"], 0.65).select("l_orderkey", "l_linenumber", "q_px")


@query(
    "background_sub",
    f"WITH {_STEPS}, b AS (SELECT *, max(CASE WHEN l_linenumber = 1 THEN size END) OVER (PARTITION BY l_orderkey) AS bg FROM steps) SELECT l_orderkey, l_linenumber, round(size - bg, 4) AS size_sub FROM b WHERE l_linenumber <> 1",
)
def background_sub(spark, sf_dir):
    """WIN5: the first line as background."""
    out = windows.background_subtract(_line_steps(spark, sf_dir), ["l_orderkey"], F.col("l_linenumber") == 1, ["size"])
    return out.select("l_orderkey", "l_linenumber", F.round("size_sub", 4).alias("size_sub"))


@query(
    "dense_ids",
    "WITH k AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), n AS (SELECT *, row_number() OVER (ORDER BY l_suppkey, l_partkey) - 1 AS trenchid FROM k) SELECT l_suppkey, l_partkey, trenchid, trenchid // 100 AS file_index, trenchid % 100 AS file_place FROM n".replace("trenchid // 100", "CAST(floor(trenchid / 100) AS BIGINT)"),
)
def dense_ids(spark, sf_dir):
    """WIN6, WIN8: pairs numbered in key order, a hundred a file."""
    ids = numbering.dense_index(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct(), ["l_suppkey", "l_partkey"], "trenchid")
    chunk, place = windows.chunk_of(F.col("trenchid"), 100)
    return ids.withColumns({"file_index": chunk, "file_place": place})


@query("reindexed", "SELECT DISTINCT l_suppkey, l_partkey, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) - 1 AS trench FROM lineitem")
def reindexed(spark, sf_dir):
    """WIN7."""
    return windows.reindex_within(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct(), ["l_suppkey"], "l_partkey", "trench")


@query(
    "coverage_curve",
    """
    WITH g AS (SELECT l_partkey, count(*) AS depth FROM lineitem GROUP BY 1), d AS (SELECT depth, count(*) AS k FROM g GROUP BY 1)
    SELECT depth, round(sum(k) OVER (ORDER BY depth) / sum(k) OVER (), 9) AS group_share, round(sum(k * depth) OVER (ORDER BY depth) / sum(k * depth) OVER (), 9) AS row_share, CAST(sum(k) OVER () - sum(k) OVER (ORDER BY depth) + k AS BIGINT) AS groups_at_least FROM d
    """,
)
def coverage_curve(spark, sf_dir):
    """WIN10."""
    out = windows.coverage_curve(table(spark, sf_dir, "lineitem"), ["l_partkey"])
    return out.select("depth", F.round("group_share", 9).alias("group_share"), F.round("row_share", 9).alias("row_share"), F.col("groups_at_least").cast("long").alias("groups_at_least"))


@query("large_groups", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)")
def large_groups(spark, sf_dir):
    """WIN11: rows of large groups."""
    return windows.in_large_groups(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], 12).select("o_orderkey")


@query("group_ranks", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, dense_rank() OVER (ORDER BY avg(o_totalprice)) AS mean_rank FROM orders GROUP BY 1")
def group_ranks(spark, sf_dir):
    """WIN11: groups ranked by mean."""
    return windows.rank_groups(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice").withColumn("mean", F.round("mean", 4))


@query(
    "shift_correction",
    """
    WITH r AS (SELECT l_suppkey, l_linenumber, l_partkey % 4 AS trench, min(l_quantity) AS x FROM lineitem GROUP BY 1, 2, 3)
    SELECT l_suppkey, l_linenumber, trench, trench + CASE WHEN max(CASE WHEN trench = 0 THEN x END) OVER (PARTITION BY l_suppkey, l_linenumber) - min(x) OVER (PARTITION BY l_suppkey) >= 2 THEN 1 ELSE 0 END AS corrected FROM r
    """,
)
def shift_correction(spark, sf_dir):
    """WIN13."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber", (F.col("l_partkey") % 4).alias("trench")).agg(F.min("l_quantity").alias("x"))
    return windows.shift_correction(rows, ["l_suppkey"], "l_linenumber", "trench", "x", 2.0).drop("x")


@query(
    "drift",
    f"""
    WITH {_STEPS}, m AS (SELECT a.l_orderkey % 50 AS fov, a.l_linenumber AS t, b.q - a.q AS shift FROM steps a JOIN steps b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
    s AS (SELECT fov, t, quantile_cont(shift, 0.5) AS step FROM m GROUP BY 1, 2) SELECT fov, t, round(step, 6) AS step, round(sum(step) OVER (PARTITION BY fov ORDER BY t), 6) AS drift FROM s
    """,
)
def drift(spark, sf_dir):
    """WIN14."""
    s = _line_steps(spark, sf_dir)
    later = s.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("q").alias("q2"))
    m = s.join(later, ["l_orderkey", "l_linenumber"]).select((F.col("l_orderkey") % 50).alias("fov"), F.col("l_linenumber").alias("t"), (F.col("q2") - F.col("q")).alias("shift"))
    return windows.drift(m, ["fov"], "t", "shift").select("fov", "t", F.round("step", 6).alias("step"), F.round("drift", 6).alias("drift"))


@query(
    "ratio_filter",
    f"WITH {_STEPS}, r AS (SELECT l_orderkey, q / lead(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM steps) SELECT l_orderkey, round(min(r), 6) AS min_ratio, round(max(r), 6) AS max_ratio FROM r GROUP BY 1 HAVING min(r) >= 0.5 AND max(r) <= 2",
)
def ratio_filter(spark, sf_dir):
    """WIN15."""
    out = windows.ratio_filter(_line_steps(spark, sf_dir), ["l_orderkey"], "l_linenumber", "q", 1, 0.5, 2.0)
    return out.select("l_orderkey", F.round("min_ratio", 6).alias("min_ratio"), F.round("max_ratio", 6).alias("max_ratio"))


@query(
    "gap_fill",
    f"""
    WITH {_STEPS}, v AS (SELECT l_orderkey, l_linenumber AS t, CASE WHEN q < 25 THEN q END AS y FROM steps),
    w AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER p AS t0, last_value(y IGNORE NULLS) OVER p AS y0, first_value(CASE WHEN y IS NOT NULL THEN t END IGNORE NULLS) OVER n AS t1, first_value(y IGNORE NULLS) OVER n AS y1 FROM v
      WINDOW p AS (PARTITION BY l_orderkey ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY l_orderkey ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT l_orderkey, t, round(coalesce(y, y0 + (y1 - y0) * (t - t0) / nullif(t1 - t0, 0)), 6) AS filled FROM w
    """,
)
def gap_fill(spark, sf_dir):
    """WIN16."""
    rows = _line_steps(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("t"), F.when(F.col("q") < 25, F.col("q")).alias("y"))
    return windows.gap_fill(rows, ["l_orderkey"], "t", "y").select("l_orderkey", "t", F.round("filled", 6).alias("filled"))


@query("delta_from_min", "SELECT o_orderkey, round(o_totalprice - min(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS delta FROM orders")
def delta_from_min(spark, sf_dir):
    """WIN17."""
    return windows.delta_from_min(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice").select("o_orderkey", F.round("delta", 4).alias("delta"))


@query(
    "last_good_cycle",
    f"WITH {_STEPS}, s AS (SELECT l_orderkey, l_linenumber, CASE WHEN floor(q / 20) - lag(floor(q / 20)) OVER w = 0 THEN lag(l_linenumber) OVER w END AS s FROM steps WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) SELECT l_orderkey, coalesce(min(s), max(l_linenumber)) AS last_good FROM s GROUP BY 1",
)
def last_good_cycle(spark, sf_dir):
    """WIN18: the last line before a coarse clock stands still."""
    return windows.last_good_cycle(_line_steps(spark, sf_dir).withColumn("clock", F.floor(F.col("q") / 20)), ["l_orderkey"], "l_linenumber", "clock")


@query(
    "first_row_with_ids",
    "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1",
)
def first_row_with_ids(spark, sf_dir):
    """WIN20."""
    out = windows.first_row_with_ids(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", ["o_totalprice"], "o_orderkey")
    return out.withColumn("ids", F.concat_ws(",", F.col("ids").cast("array<string>")))


@query(
    "mutual_nearest",
    """
    WITH p AS (SELECT c_nationkey AS nation, c_custkey, s_suppkey, (c_acctbal + 50 - s_acctbal) * (c_acctbal + 50 - s_acctbal) AS d FROM customer JOIN supplier ON c_nationkey = s_nationkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY nation, c_custkey ORDER BY d, s_suppkey) AS a, row_number() OVER (PARTITION BY nation, s_suppkey ORDER BY d, c_custkey) AS b FROM p)
    SELECT nation, c_custkey, s_suppkey, round(d, 3) AS distance2 FROM r WHERE a = 1 AND b = 1
    """,
)
def mutual_nearest(spark, sf_dir):
    """JON7: customers and suppliers of a nation that are each other's nearest by balance."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("bal"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.col("s_acctbal").alias("bal"))
    return joins.mutual_nearest(c, s, ["nation"], "c_custkey", "s_suppkey", ["bal"], offset=[50.0]).withColumn("distance2", F.round("distance2", 3))


@query(
    "plane_neighbours",
    """
    WITH o AS (SELECT o_orderkey, o_orderkey % 2 AS fov, o_totalprice / 1000 AS x, epoch(o_orderdate) / 864000 AS y, o_orderstatus FROM orders),
    p AS (SELECT a.fov, a.o_orderkey AS a, b.o_orderkey AS b, (a.x + 3 - b.x) * (a.x + 3 - b.x) + (a.y - 1 - b.y) * (a.y - 1 - b.y) AS d FROM o a JOIN o b ON a.fov = b.fov AND a.o_orderstatus = 'F' AND b.o_orderstatus <> 'F'),
    f AS (SELECT fov, a, min({'d': d, 'b': b}) AS m FROM p GROUP BY fov, a), g AS (SELECT fov, b, min({'d': d, 'a': a}) AS m FROM p GROUP BY fov, b)
    SELECT f.fov, f.a AS finished, f.m.b AS other, round(f.m.d, 4) AS distance2 FROM f JOIN g ON f.fov = g.fov AND f.m.b = g.b AND g.m.a = f.a
    """,
)
def plane_neighbours(spark, sf_dir):
    """JON7 in the plane: finished and other orders that are each other's nearest by price and date, after a shift."""
    y = F.col("o_orderdate").cast("timestamp").cast("double") / 864000
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 2).alias("fov"), (F.col("o_totalprice") / 1000).alias("x"), y.alias("y"), "o_orderstatus")
    a, b = o.filter("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "finished"), o.filter("o_orderstatus <> 'F'").withColumnRenamed("o_orderkey", "other")
    return joins.mutual_nearest(a, b, ["fov"], "finished", "other", ["x", "y"], offset=[3.0, -1.0]).withColumn("distance2", F.round("distance2", 4))


@query(
    "midpoints",
    """
    WITH p AS (SELECT c_nationkey AS nation, c_custkey, s_suppkey, (c_acctbal - s_acctbal) * (c_acctbal - s_acctbal) AS d FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE abs(c_acctbal - s_acctbal) <= 200),
    r AS (SELECT *, row_number() OVER (PARTITION BY nation, c_custkey ORDER BY d, s_suppkey) AS a, row_number() OVER (PARTITION BY nation, s_suppkey ORDER BY d, c_custkey) AS b FROM p)
    SELECT nation, c_custkey, s_suppkey FROM r WHERE a = 1 AND b = 1
    """,
)
def midpoints(spark, sf_dir):
    """JON23: the same on a line, within a tolerance."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("bal"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", F.col("s_acctbal").alias("bal"))
    return joins.mutual_nearest(c, s, ["nation"], "c_custkey", "s_suppkey", ["bal"], within=200.0).drop("distance2")


@query(
    "barcode_pheno_join",
    "SELECT o_orderkey, o_totalprice, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0",
)
def barcode_pheno_join(spark, sf_dir):
    """JON8: orders as phenotypes, customers as barcodes, through a map of ids."""
    pheno = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pheno_id"), "o_orderkey", "o_totalprice")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    mapping = cust.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("pheno_id"), "c_custkey")
    return joins.barcode_phenotype(pheno, cust, mapping, "pheno_id", "c_custkey", drop=["c_acctbal"]).drop("pheno_id")


@query("lookup_default", "SELECT o_orderkey, coalesce(c_mktsegment, 'Unknown') AS c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON o_custkey = c_custkey")
def lookup_default(spark, sf_dir):
    """JON9."""
    cust = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return joins.lookup_or(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), cust, "o_custkey", "c_mktsegment").drop("o_custkey")


@query(
    "family_join",
    """
    WITH f AS (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_size, arg_max(o_totalprice, o_orderkey) AS last_size FROM orders GROUP BY 1)
    SELECT c.o_custkey, m.last_size AS mother_last_size, d1.first_size AS d1_first_size, round(sqrt((c.first_size + d1.first_size) * m.last_size) * c.first_size / (c.first_size + d1.first_size), 4) AS birth_size
    FROM f c LEFT JOIN f m ON m.o_custkey = c.o_custkey // 2 LEFT JOIN f d1 ON d1.o_custkey = c.o_custkey * 2
    """.replace("c.o_custkey // 2", "(c.o_custkey >> 1)"),
)
def family_join(spark, sf_dir):
    """JON10, SCL22: customers as a binary family; sizes at birth between mother and daughter."""
    f = joins.first_last(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["o_totalprice"]).withColumnsRenamed({"first_o_totalprice": "first_size", "last_o_totalprice": "last_size"})
    cells = f.withColumns({"mother": F.shiftright("o_custkey", 1), "d1": F.col("o_custkey") * 2})
    out = joins.family_join(cells, f.select("o_custkey", "last_size"), "o_custkey", {"mother": "mother"}, ["last_size"])
    out = joins.family_join(out, f.select("o_custkey", "first_size"), "o_custkey", {"d1": "d1"}, ["first_size"])
    birth = keys.size_between(F.col("first_size"), F.col("d1_first_size"), F.col("mother_last_size"))
    return out.select("o_custkey", "mother_last_size", "d1_first_size", F.round(birth, 4).alias("birth_size"))


@query("attach_time", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def attach_time(spark, sf_dir):
    """JON11: order columns beside lines."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return joins.attach(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), o, ["l_orderkey"], ["o_orderpriority"])


@query(
    "attach_metadata",
    "SELECT l_orderkey, l_linenumber, o.user_id, o.n FROM lineitem LEFT JOIN (SELECT user_id, event_id % 7 + 1 AS k, count(*) AS n FROM events GROUP BY 1, 2) o ON o.user_id = l_suppkey AND o.k = l_linenumber".replace("o.user_id, o.n", "l_suppkey AS user_id, o.n"),
)
def attach_metadata(spark, sf_dir):
    """JON13: objects beside their trench's metadata by a key of two columns; objects without stay."""
    meta = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 7 + 1).cast("int").alias("l_linenumber")).agg(F.count(F.lit(1)).alias("n"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("user_id"))
    return joins.attach(line, meta, ["user_id", "l_linenumber"], ["n"], "left")


@query(
    "placed_regions",
    """
    WITH r AS (SELECT p_partkey, p_size, p_retailprice + coalesce(s_acctbal, 0) AS x FROM part LEFT JOIN supplier ON s_suppkey = p_size)
    SELECT l_orderkey, l_linenumber, p_size, round(x, 4) AS x FROM lineitem JOIN r ON p_partkey = l_partkey
    """,
)
def placed_regions(spark, sf_dir):
    """JON14: parts as regions, suppliers as stage offsets, lines as cells."""
    regions = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("x"))
    offsets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_size"), F.col("s_acctbal").alias("dx"))
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return joins.place_regions(regions, offsets, cells, ["p_size"], ["p_partkey"], {"x": "dx"}).select("l_orderkey", "l_linenumber", "p_size", F.round("x", 4).alias("x"))


@query(
    "median_outliers",
    """
    WITH m AS (SELECT o_custkey, avg(o_totalprice) AS v, row_number() OVER (ORDER BY o_custkey) AS i, count(*) OVER () AS n FROM orders GROUP BY 1),
    x AS (SELECT i AS pos, v FROM m UNION ALL SELECT 1 - i, v FROM m WHERE i <= 2 UNION ALL SELECT 2 * n + 1 - i, v FROM m WHERE i > n - 2),
    s AS (SELECT pos, quantile_cont(v, 0.5) OVER (ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sm FROM x), r AS (SELECT o_custkey, v - sm AS res FROM m JOIN s ON s.pos = m.i)
    SELECT o_custkey, round(res, 4) AS residual, abs(res - avg(res) OVER ()) <= 2 * stddev_pop(res) OVER () AS normal FROM r
    """,
)
def median_outliers(spark, sf_dir):
    """WIN9: customers' mean prices against the running median, numbered and cut into buckets."""
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("v"))
    return windows.median_filter_outliers(per, "o_custkey", "v", per_bucket=1_000).select("o_custkey", F.round("residual", 4).alias("residual"), "normal")


@query("replaced_times", "SELECT o.o_orderkey, coalesce(l.p, o.o_totalprice) AS o_totalprice FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS p FROM lineitem WHERE l_linenumber = 3 GROUP BY 1) l ON l_orderkey = o_orderkey")
def replaced_times(spark, sf_dir):
    """JON12."""
    new = table(spark, sf_dir, "lineitem").filter("l_linenumber = 3").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("o_totalprice"))
    return joins.replace_from(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), new, ["o_orderkey"], "o_totalprice")


@query(
    "library_overlap",
    """
    WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 5 AND l_quantity > 20),
    f AS (SELECT a.l_partkey IS NOT NULL AS in_a, b.l_partkey IS NOT NULL AS in_b FROM a FULL JOIN b USING (l_partkey)) SELECT in_a, in_b, count(*) AS n, round(count(*) / (SELECT count(*) FROM f), 9) AS share FROM f GROUP BY 1, 2
    """,
)
def library_overlap(spark, sf_dir):
    """JON15: parts in first lines against parts in fifth lines."""
    line = table(spark, sf_dir, "lineitem")
    a, b = line.filter("l_linenumber = 1").select("l_partkey").distinct(), line.filter("l_linenumber = 5 AND l_quantity > 20").select("l_partkey").distinct()
    return joins.overlap_summary(a, b, "l_partkey").withColumn("share", F.round("share", 9))


@query("three_way_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def three_way_semi(spark, sf_dir):
    """JON16, SET2."""
    o = table(spark, sf_dir, "orders")
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.in_all(o.select("o_orderkey", "o_custkey"), [rich, o.filter("o_totalprice > 100000"), o.filter("o_orderstatus = 'F'")], "o_custkey").select("o_orderkey")


@query("failed_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def failed_anti(spark, sf_dir):
    """JON17, SET3."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return joins.in_none(table(spark, sf_dir, "customer").select("c_custkey"), [o.filter("o_totalprice > 200000"), o.filter("o_orderstatus = 'P'")], "c_custkey")


@query("codebook_assembly", "SELECT o_orderkey, o_totalprice, n_lines FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) USING (o_orderkey) ")
def codebook_assembly(spark, sf_dir):
    """JON18: orders with lines, put together by key; a missing part would raise."""
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(counts, "o_orderkey", "left_semi")
    return joins.assemble_codebook([orders, counts.join(orders, "o_orderkey", "left_semi")], "o_orderkey")


@query("guide_annotation", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size NOT IN (1, 2, 3)")
def guide_annotation(spark, sf_dir):
    """JON19."""
    design = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return joins.annotate_guides(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), design, "l_partkey", "p_size", [1, 2, 3]).select("l_orderkey", "l_linenumber", "p_brand")


@query(
    "lone_points",
    """
    WITH p AS (SELECT c_nationkey, c_custkey, c_acctbal AS x, c_custkey % 500 AS y FROM customer), m AS (SELECT c_nationkey, quantile_cont(x, 0.5) AS mid FROM p GROUP BY 1)
    SELECT c_nationkey, c_custkey FROM p JOIN m USING (c_nationkey) WHERE x <= 1.5 * mid AND NOT EXISTS (SELECT 1 FROM p q WHERE q.c_nationkey = p.c_nationkey AND q.c_custkey <> p.c_custkey AND sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) < 90)
    """,
)
def lone_points(spark, sf_dir):
    """JON20: customers without a neighbour near by."""
    p = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 500).alias("y"))
    return joins.lone_points(p, ["c_nationkey"], "c_custkey", "x", "y", 90.0, "x", 1.5).select("c_nationkey", "c_custkey")


@query(
    "nearest_reference",
    """
    WITH t AS (SELECT doc_id, doc_id % 2 AS position, string_split(md5(coalesce(text, '')), '') AS s FROM documents),
    r AS (SELECT item_id % 2 AS position, item_id AS name, string_split(md5(coalesce(text, '')), '') AS ref FROM benchmark),
    p AS (SELECT t.doc_id, name, list_sum(list_transform(list_zip(s, ref), lambda z: CASE WHEN z[1] = z[2] THEN 0 ELSE 1 END)) AS k FROM t JOIN r USING (position))
    SELECT doc_id, arg_min(name, k * 1000000 + name) AS call, CAST(min(k) AS INTEGER) AS mismatches FROM p GROUP BY 1
    """,
)
def nearest_reference(spark, sf_dir):
    """JON22, SCL8: codes of whole documents against those of all items of their position."""
    code = F.md5(F.coalesce("text", F.lit("")))
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2).alias("position"), code.alias("s"))
    refs = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 2).alias("position"), F.col("item_id").alias("name"), code.alias("ref"))
    return joins.nearest_reference(d, "s", refs, "position").select("doc_id", "call", "mismatches")


@query("range_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity < 30 AND l_discount > 0.02 AND l_discount < 0.08")
def range_filter(spark, sf_dir):
    """PRJ7."""
    return flt.in_ranges(table(spark, sf_dir, "lineitem"), {"l_quantity": (10, 30), "l_discount": (0.02, 0.08)}).select("l_orderkey", "l_linenumber")


@query("shift_and_clip", "SELECT l_orderkey, l_linenumber, l_quantity + 2 AS a_x, l_linenumber - 1 AS a_y FROM lineitem WHERE l_quantity + 2 BETWEEN 5 AND 40 AND l_linenumber - 1 BETWEEN 0 AND 4")
def shift_and_clip(spark, sf_dir):
    """PRJ8."""
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a_x"), F.col("l_linenumber").alias("a_y"))
    return flt.shift_and_clip(boxes, 2, -1, (5, 40, 0, 4))


@query("complete_families", "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey % 7 <> 0 AND o_totalprice < 150000")
def complete_families(spark, sf_dir):
    """PRJ10."""
    known = lambda c, k: F.when(F.col(c) % k == 0, -1).otherwise(F.col(c))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", known("o_orderkey", 5).alias("mother"), known("o_custkey", 7).alias("sister"), "o_totalprice")
    return flt.complete_families(rows, ["mother", "sister"], "o_totalprice", 150000.0).select("o_orderkey")


@query("tag_pivot", "SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS \"view\" FROM events GROUP BY 1 HAVING count(*) > 0")
def tag_pivot(spark, sf_dir):
    """PRJ13: event types as tags."""
    top = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    tags = top.groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("tag"), F.col("v").alias("value"))).alias("tags"))
    return flt.pivot_tags(tags, "user_id", "tags", ["click", "view"])


@query("flat_field", "SELECT l_orderkey, l_linenumber, round((l_quantity - 1) / (p - 1), 6) AS value FROM lineitem JOIN (SELECT p_partkey, p_retailprice AS p FROM part) ON p_partkey = l_partkey")
def flat_field(spark, sf_dir):
    """PRJ15: quantities as pixels, parts as their calibration."""
    px = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("channel"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.col("l_quantity").alias("value"))
    cal = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("channel"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.lit(1.0).alias("dark"), F.col("p_retailprice").alias("flat"))
    return flt.flat_field(px, cal).select("l_orderkey", "l_linenumber", F.round("value", 6).alias("value"))


@query("grid_index", "SELECT DISTINCT l_suppkey, l_partkey, dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_partkey DESC) - 1 AS l_partkey_index FROM lineitem")
def grid_index(spark, sf_dir):
    """PRJ16."""
    return flt.grid_index(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct(), ["l_suppkey"], ["l_partkey"], reverse=["l_partkey"])


@query(
    "tolerance_grid",
    "WITH g AS (SELECT c_nationkey, c_custkey, c_acctbal, CASE WHEN c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) > 100 THEN 1 ELSE 0 END AS n FROM customer) SELECT c_custkey, CAST(sum(n) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS BIGINT) AS island FROM g",
)
def tolerance_grid(spark, sf_dir):
    """PRJ17."""
    return flt.tolerance_grid(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", 100.0, "island").select("c_custkey", "island")


@query("diagonal_union", "SELECT c_custkey AS k, c_name AS name, NULL AS extra FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def diagonal_union(spark, sf_dir):
    """SET1."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return flt.widened_union([c, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("extra"))])


@query("common_keys", "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey IN (SELECT s_suppkey FROM supplier)")
def common_keys(spark, sf_dir):
    """SET2."""
    c, o, s = (table(spark, sf_dir, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_custkey"), ("orders", "o_custkey"), ("supplier", "s_suppkey")))
    return flt.common_keys([c, o, s], ["k"])


@query("missing_keys", "SELECT DISTINCT p_partkey AS k FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def missing_keys(spark, sf_dir):
    """SET3."""
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return flt.missing_keys(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), done, ["k"])


@query(
    "neighbour_steps",
    f"""
    WITH {_STEPS}, o AS (SELECT CAST(floor(l_orderkey / 40) AS BIGINT) AS fov, l_linenumber AS t, l_orderkey AS k, q AS x, size / 1000 AS y, size AS s FROM steps),
    p AS (SELECT a.fov, a.t, a.k, b.k AS neighbour, a.s, b.s AS s2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM o a JOIN o b ON a.fov = b.fov AND b.t = a.t + 1)
    SELECT fov, t, k, neighbour, round(d / sqrt(s), 5) AS distance, round((s2 - s) / s, 5) AS size_change FROM (SELECT *, row_number() OVER (PARTITION BY fov, t, k ORDER BY d, neighbour) AS r FROM p) WHERE r = 1
    """,
)
def neighbour_steps(spark, sf_dir):
    """TSR7: order lines as objects, their nearest at the next line number."""
    o = _line_steps(spark, sf_dir).select(F.floor(F.col("l_orderkey") / 40).alias("fov"), F.col("l_linenumber").alias("t"), F.col("l_orderkey").alias("k"), F.col("q").alias("x"), (F.col("size") / 1000).alias("y"), F.col("size").alias("s"))
    return traces.neighbour_steps(o, ["fov"], "t", "k", "x", "y", "s").select("fov", "t", "k", "neighbour", F.round("distance", 5).alias("distance"), F.round("size_change", 5).alias("size_change"))


@query("trench_lineages")
def trench_lineages(spark, sf_dir):
    """TSR6: lines of an order's customer as cells along a trench; a state machine, tested by hand-made cells."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cells = _line_steps(spark, sf_dir).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("l_linenumber").alias("t"), F.col("l_orderkey").alias("place"), F.col("q").alias("length"))
    return traces.trench_lineages(cells, ["o_custkey"], "t", "place", "length")
