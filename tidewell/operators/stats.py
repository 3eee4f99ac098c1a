"""Statistics per group (AGG6-10, AGG12-21, AGG24-32, AGG36, AGG38, AGG39, AGG42)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import sized_broadcast, written
from .numbering import exact_quantiles, running


def median(x: Column | str) -> Column:
    return F.percentile(x, 0.5)


def group_stats(df: DataFrame, group: Sequence[str], value: str, member: str) -> DataFrame:
    """median, mean, sem, first value and sorted list of members, and n per group (AGG6)."""
    return df.groupBy(*group).agg(
        median(value).alias("median"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
        F.min_by(value, member).alias("first"), F.array_sort(F.collect_list(member)).alias("members"), F.count(F.lit(1)).alias("n"),
    )


def median_by(df: DataFrame, group: Sequence[str], value: str, into: str = "median", approximate: bool = False, few_groups: bool = False) -> DataFrame:
    """Median per group (AGG7). Nulls do not count. A group's distinct values are held by one reducer; for few groups too
    large for that, ``few_groups`` finds exact medians over ranges of their values, ``approximate`` near ones."""
    if few_groups:
        found = exact_quantiles(df, value, [0.5], group).select(*group, F.get("quantiles", F.lit(0)).alias(into))
        same = [F.col(f"g.`{g}`").eqNullSafe(F.col(f"q.`{g}`")) for g in group]
        return df.select(*group).distinct().alias("g").join(found.alias("q"), same, "left").select("g.*", f"q.{into}")
    return df.groupBy(*group).agg((F.percentile_approx(value, 0.5, 10_000) if approximate else median(value)).alias(into))


def mad_bands(df: DataFrame, group: Sequence[str], value: str, few_groups: bool = False) -> DataFrame:
    """Median and median absolute deviation per group, with the band around it (AGG8); ``few_groups`` as in ``median_by``."""
    mid = median_by(df, group, value, "mid", few_groups=few_groups)
    away = df.join(mid, list(group)).withColumn("_off", F.abs(F.col(value) - F.col("mid")))
    off = median_by(away, [*group, "mid"], "_off", "mad", few_groups=few_groups)
    return off.select(*group, F.col("mid").alias("median"), "mad", (F.col("mid") - F.col("mad")).alias("low"), (F.col("mid") + F.col("mad")).alias("high"))


def robust_z(df: DataFrame, value: str, reference: Column, into: str = "z") -> DataFrame:
    """1.35 (x - median) / IQR, both from the reference rows; null where the IQR is 0 (AGG9)."""
    q = exact_quantiles(df.filter(reference), value, [0.25, 0.5, 0.75], into="_q")
    out = df.join(F.broadcast(q))
    return out.withColumn(into, F.try_divide((F.col(value) - F.col("_q")[1]) * 1.35, F.col("_q")[2] - F.col("_q")[0])).drop("_q")


def fov_correction(df: DataFrame, fov: str, value: str, early: Column, n_sigma: float = 2.0, into: str = "corrected") -> DataFrame:
    """Values over their field's illumination: early medians per field, outlying fields dropped, over the largest (AGG10)."""
    from .windows import median_filter_outliers

    mid = median_by(df.filter(early), [fov], value, "mid")
    normal = median_filter_outliers(mid, fov, "mid", n_sigma=n_sigma).filter("normal").select(fov, "mid")
    top = normal.agg(F.max("mid").alias("top"))
    factors = normal.join(F.broadcast(top)).select(fov, F.try_divide("mid", "top").alias("factor"))
    return df.join(sized_broadcast(factors), fov).withColumn(into, F.try_divide(value, "factor"))


def threshold_counts(df: DataFrame, group: Sequence[str], x: Column, thresholds: Sequence[float], at_least: int = 0) -> DataFrame:
    """Rows at or above each threshold, a column each; groups with ``at_least`` such rows at the lowest (AGG12)."""
    names = [f"n_ge_{str(t).replace('.', '_')}" for t in thresholds]
    out = df.groupBy(*group).agg(*[F.sum(F.when(x >= t, 1).otherwise(0)).cast("long").alias(n) for t, n in zip(thresholds, names)])
    return out.filter(F.greatest(*names, F.lit(0)) >= at_least)


def confusion(df: DataFrame, truth: Column, call: Column) -> DataFrame:
    """tp, fp, fn, tn and the error rates over all rows (AGG13); rates are null without rows."""
    cell = lambda t, c: F.coalesce(F.sum(F.when((truth == t) & (call == c), 1).otherwise(0)), F.lit(0)).cast("long")
    counts = df.agg(cell(True, True).alias("tp"), cell(False, True).alias("fp"), cell(True, False).alias("fn"), cell(False, False).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.withColumns({"fp_rate": F.try_divide("fp", n), "fn_rate": F.try_divide("fn", n), "error_rate": F.try_divide(F.col("fp") + F.col("fn"), n)})


def recovery(df: DataFrame, called: Column, correct: Column, barcode: str, trench: str, approximate: bool = False) -> DataFrame:
    """Rows, called, correct of called, distinct barcodes and trenches, percent called (AGG14)."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    n = F.count(F.lit(1))
    n_called, n_correct = F.sum(F.when(called, 1).otherwise(0)), F.sum(F.when(called & correct, 1).otherwise(0))
    return df.agg(
        n.alias("n"), n_called.cast("long").alias("n_called"), F.try_divide(n_correct, n_called).alias("correct_share"),
        distinct(F.when(called, F.col(barcode))).alias("n_barcodes"), distinct(trench).alias("n_trenches"), F.try_divide(100.0 * n_called, n).alias("percent_called"),
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per combination, and their share (AGG15)."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def nested_value_counts(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per group a list of (n, values), most frequent first (AGG16)."""
    counts = df.groupBy(*group, *columns).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), *columns)))
    return counts.groupBy(*group).agg(F.transform(listed, lambda x: F.struct((-x["m"]).alias("n"), *[x[c].alias(c) for c in columns])).alias("counts"))


def column_quantiles(df: DataFrame, columns: Sequence[str], q: float) -> DataFrame:
    """A row per column: name, value of the quantile; NaN as null (AGG17). Columns are groups of one long table."""
    known = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]
    long = df.select(*known).unpivot([], list(columns), "name", "value")
    found = exact_quantiles(long, "value", [q], ["name"])
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "name string")
    return F.broadcast(names).join(found, "name", "left").select("name", F.get("quantiles", F.lit(0)).alias("value"))


def histogram(df: DataFrame, group: Sequence[str], value: str, low: float, high: float, bins: int, log: bool = False) -> DataFrame:
    """Rows per group and bin, bins from 0; the last is closed on the right, values outside do not count (AGG18)."""
    x, a, b = (F.ln(F.col(value)), math.log(low), math.log(high)) if log else (F.col(value), low, high)
    k = F.when(F.col(value) == high, bins - 1).otherwise(F.floor((x - a) / ((b - a) / bins))).cast("int")
    inside = df.filter((F.col(value) >= low) & (F.col(value) <= high))
    return inside.groupBy(*group, k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def pearson_by(df: DataFrame, group: Sequence[str], x: str, y: str, at_least: int = 6) -> DataFrame:
    """r and n per group of at least so many rows; null for a constant side (AGG19)."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group).agg(F.nanvl(F.corr(x, y), F.lit(None).cast("double")).alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)


def pearson_t(r: Column, n: Column) -> Column:
    """The t statistic of a correlation."""
    return F.try_divide(r * F.sqrt(n - 2.0), F.sqrt(1 - r * r))


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = 0.05, family: Sequence[str] = (), key: str | None = None) -> DataFrame:
    """Adjusted p and whether it is at most ``alpha``, within each family of tests (AGG20).

    Equal p values have equal ranks, the largest, so distinct values are ranked, not rows. The tests are written once: p
    values found anew may differ in the last digit and would not meet their own rank.
    """
    tests = written(df.filter(F.col(p).isNotNull()), "tests")
    per = tests.groupBy(*family, p).agg(F.count(F.lit(1)).alias("_k"))
    ranked = written(running(per, p, {"_rank": "_k"}, group=family), "ranked")
    whole = ranked.groupBy(*[F.col(f).alias(f"_own_{f}") for f in family]).agg(F.max("_rank").alias("_m"))
    same = F.lit(True)
    for f in family:
        same = same & F.col(f).eqNullSafe(F.col(f"_own_{f}"))
    raised = ranked.join(sized_broadcast(whole), same).drop(*[f"_own_{f}" for f in family]).withColumn("_raised", F.col(p) * F.col("_m") / F.col("_rank"))
    ranked = running(raised, p, mins={"_least": "_raised"}, group=family, descending=True).withColumn("p_adjusted", F.least("_least", F.lit(1.0)))
    return tests.join(ranked.select(*family, p, "p_adjusted"), [*family, p]).withColumn("significant", F.col("p_adjusted") <= alpha)


def one_sample_t(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """t of each group's mean against the mean of all rows (AGG21); null below two rows or without spread."""
    all_ = df.agg(F.avg(value).alias("_mu"))
    per = df.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    return per.join(F.broadcast(all_)).withColumn("t", F.try_divide(F.col("mean") - F.col("_mu"), F.col("sd") / F.sqrt("n"))).drop("_mu")


def vector_mean(df: DataFrame, group: Sequence[str], vector: str, above: int = 0) -> DataFrame:
    """Elementwise mean of a group's vectors, null for groups of at most ``above`` (AGG24). Sums per position combine
    before the shuffle, so no group is held as a list."""
    each = df.select(*group, F.posexplode(vector).alias("pos", "x"))
    means = each.groupBy(*group, "pos").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("k"))
    joined = means.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("parts"), F.max("k").alias("n"))
    return joined.select(*group, "n", F.when(F.col("n") > above, F.col("parts.m")).alias("mean"))


def simpson_weights(n: int, step: float) -> list[float]:
    """Composite Simpson weights for ``n`` points; for an even number the last interval is a trapezoid."""
    m = n if n % 2 else n - 1
    w = [0.0] * n
    for i in range(0, m - 2, 2):
        for k, c in enumerate((1.0, 4.0, 1.0)):
            w[i + k] += c * step / 3
    if m != n:
        w[n - 2] += step / 2
        w[n - 1] += step / 2
    return w


def integrated_effect(features: Sequence[Column], n: int, step: float) -> tuple[list[Column], Column, Column]:
    """Per feature the integral of its absolute value, the largest of them, and their Euclidean norm (AGG25)."""
    w = F.array(*map(F.lit, simpson_weights(n, step)))
    parts = [F.aggregate(F.zip_with(f, w, lambda x, k: F.abs(x) * k), F.lit(0.0), lambda a, x: a + x) for f in features]
    norm = F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    return parts, F.greatest(*parts, parts[0]), norm


def representative(df: DataFrame, group: Sequence[str], columns: Sequence[str], score: str, key: str, largest: bool = True) -> DataFrame:
    """The row with the largest or smallest score per group, ties to the smaller key (AGG26)."""
    o = F.struct((-F.col(score) if largest else F.col(score)).alias("s"), key)
    return df.groupBy(*group).agg(*[F.min_by(c, o).alias(c) for c in [key, score, *columns]])


def cluster_jaccard(df: DataFrame, a: str, b: str) -> DataFrame:
    """Jaccard of every pair of clusters that share a row, and whether each is the other's best (AGG27)."""
    both = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n_both"))
    size = lambda c, n: both.groupBy(c).agg(F.sum("n_both").alias(n))
    out = both.join(size(a, "n_a"), a).join(size(b, "n_b"), b).withColumn("jaccard", F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")))
    rank = lambda c, other: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("jaccard"), other)) == 1
    return out.withColumn("mutual", rank(a, b) & rank(b, a)).drop("n_a", "n_b")


def replicate_agreement(df: DataFrame, guide: str, cluster: str) -> DataFrame:
    """Per cluster the share of its guides all of whose replicates are there (AGG28)."""
    per = df.groupBy(guide).agg(F.countDistinct(cluster).alias("k"))
    return df.select(guide, cluster).distinct().join(per, guide).groupBy(cluster).agg(F.avg(F.when(F.col("k") == 1, 1.0).otherwise(0.0)).alias("share_together"), F.count(F.lit(1)).alias("n_guides"))


def pair_distance_means(pairs: DataFrame, group: Sequence[str], distance: str) -> DataFrame:
    """Mean distance and number of pairs per group (AGG29)."""
    return pairs.groupBy(*group).agg(F.avg(distance).alias("mean_distance"), F.count(F.lit(1)).alias("n_pairs"))


def bit_frequency(df: DataFrame, barcode: str) -> DataFrame:
    """Share of ones at each barcode position (AGG30)."""
    bits = df.select(F.posexplode(F.filter(F.split(barcode, ""), lambda c: c != "")).alias("position", "bit"))
    return bits.groupBy("position").agg(F.avg(F.when(F.col("bit") == "1", 1.0).otherwise(0.0)).alias("frequency"))


def measure_objects(pixels: DataFrame, group: Sequence[str], label: str, y: str, x: str, value: str, background: bool = False) -> DataFrame:
    """Area, centroid, box and intensity of labelled objects; label 0 is background (AGG31)."""
    rows = pixels if background else pixels.filter(F.col(label) != 0)
    return rows.groupBy(*group, label).agg(
        F.count(F.lit(1)).alias("area"), F.avg(y).alias("centroid_y"), F.avg(x).alias("centroid_x"),
        F.min(y).alias("min_y"), F.max(y).alias("max_y"), F.min(x).alias("min_x"), F.max(x).alias("max_x"),
        F.avg(value).alias("mean_intensity"), median(value).alias("median_intensity"), F.max(value).alias("max_intensity"),
    )


#: The percentiles of an intensity profile.
PROFILE = (0.005, 0.05, 0.25, 0.75, 0.95, 0.995)


def percentile_profile(df: DataFrame, group: Sequence[str], value: str, threshold: float, few_groups: bool = False) -> DataFrame:
    """Mean, median and percentiles of a crop, and mean and median above and below a threshold (AGG32); ``few_groups`` as in
    ``median_by``."""
    v = F.col(value)
    if few_groups:
        out = df.groupBy(*group).agg(F.avg(v).alias("mean"), F.avg(F.when(v >= threshold, v)).alias("mean_above"), F.avg(F.when(v < threshold, v)).alias("mean_below"))
        named = [f"p{str(p * 100).rstrip('0').rstrip('.').replace('.', '_')}" for p in PROFILE]
        parts = ((df, [0.5, *PROFILE], ["median", *named]), (df.filter(v >= threshold), [0.5], ["median_above"]), (df.filter(v < threshold), [0.5], ["median_below"]))
        for rows, shares, names in parts:
            found = exact_quantiles(rows, value, shares, group).select(*[F.col(g).alias(f"_own_{g}") for g in group], "quantiles")
            same = [F.col(g).eqNullSafe(F.col(f"_own_{g}")) for g in group]
            out = out.join(sized_broadcast(found), same, "left").withColumns({n: F.get("quantiles", F.lit(i)) for i, n in enumerate(names)}).drop("quantiles", *[f"_own_{g}" for g in group])
        return out.select(*group, "mean", "median", *named, "mean_above", "median_above", "mean_below", "median_below")
    aggs = [F.avg(v).alias("mean"), median(v).alias("median")]
    aggs += [F.percentile(v, p).alias(f"p{str(p * 100).rstrip('0').rstrip('.').replace('.', '_')}") for p in PROFILE]
    for side, part in (("above", F.when(v >= threshold, v)), ("below", F.when(v < threshold, v))):
        aggs += [F.avg(part).alias(f"mean_{side}"), median(part).alias(f"median_{side}")]
    return df.groupBy(*group).agg(*aggs)


def signal_sum(df: DataFrame, group: str, position: str, value: str, length: int, removed: Sequence[int] = (), eps: float = 1e-9) -> DataFrame:
    """Per group the sum of its signals, each over its position's median (AGG35); short groups sum to 0."""
    rows = df.withColumn("_v", F.when(F.col(position).isin(*removed), 0.0).otherwise(F.col(value))) if removed else df.withColumn("_v", F.col(value).cast("double"))
    size = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(size, group).withColumn("_v", F.when(F.col("_n") < length, 0.0).otherwise(F.col("_v")))
    mid = exact_quantiles(rows, "_v", [0.5], [position]).select(position, F.get("quantiles", F.lit(0)).alias("_mid"))
    return rows.join(sized_broadcast(mid), position).groupBy(group).agg(F.sum(F.col("_v") / (F.col("_mid") + eps)).alias("signal_sum"))


def kymograph_report(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Distinct prefixes of the levels: n_<level> and the ratio of each to the one above (AGG36)."""
    counts = df.agg(*[F.countDistinct(*levels[: i + 1]).alias(f"n_{c}") for i, c in enumerate(levels)])
    return counts.withColumns({f"{b}_per_{a}": F.try_divide(F.col(f"n_{b}"), F.col(f"n_{a}")) for a, b in zip(levels, levels[1:])})


def loglik_filter(df: DataFrame, group: Sequence[str], value: str, early: Column, drop_share: float) -> DataFrame:
    """Groups whose geometric mean likelihood under the early rows' Gaussian is not among the lowest share (AGG38)."""
    fit = df.filter(early).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    z = (F.col(value) - F.col("_mu")) / F.col("_sd")
    per = df.join(F.broadcast(fit)).groupBy(*group).agg(F.exp(F.avg(-z * z / 2 - F.ln(F.col("_sd")) - 0.5 * math.log(2 * math.pi))).alias("likelihood"))
    per = written(per, "likelihoods")
    cut = exact_quantiles(per, "likelihood", [drop_share]).select(F.get("quantiles", F.lit(0)).alias("_cut"))
    return per.join(F.broadcast(cut)).filter(F.col("likelihood") >= F.col("_cut")).drop("_cut")


def keep_trenches(df: DataFrame, group: Sequence[str], good: Column, n_times: int, share: float) -> DataFrame:
    """Rows of groups with more than round(n_times * share) good rows (AGG39)."""
    kept = df.groupBy(*group).agg(F.sum(F.when(good, 1).otherwise(0)).alias("_n")).filter(F.col("_n") > round(n_times * share))
    return df.join(kept.select(*group), list(group), "left_semi")


def precision_recall(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """threshold, precision, recall at every distinct score, counting scores at or above it (AGG42)."""
    per = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.when(positive, 1).otherwise(0)).alias("_tp"), F.count(F.lit(1)).alias("_n"))
    from .windows import cumulative

    run = cumulative(per, "threshold", {"tp": "_tp", "n": "_n"}, descending=True)
    total = per.agg(F.sum("_tp").alias("_all"))
    return run.join(F.broadcast(total)).select("threshold", F.try_divide("tp", "n").alias("precision"), F.try_divide("tp", "_all").alias("recall"))


def threshold_at_recall(curve: DataFrame, recall: float) -> DataFrame:
    """The point of highest precision whose recall is above ``recall``."""
    return curve.filter(F.col("recall") > recall).agg(*[F.max_by(c, F.struct("precision", "threshold")).alias(c) for c in ("threshold", "precision", "recall")])
