"""Small numpy helpers for what Spark has no function for, and the operators on them (AGG11, AGG19, AGG33, AGG34, SCL20, JON21)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import sized_broadcast, written


def half_range_mode(v: np.ndarray, n: np.ndarray | None = None, least: int = 50, rounds: int = 0, last: float = math.nan) -> float:
    """The mean of what is left when the range is halved at its middle, round by round, the fuller half kept (the lower
    one of equal halves), until fewer than ``least`` rows are left or the middle stays; at least two rounds.

    ``v``: rising values, each of which stands ``n`` times; ``rounds`` and ``last`` (middle) are what was done before.
    """
    n = np.ones(len(v), np.int64) if n is None else n
    if not len(v):
        return math.nan
    for i in range(rounds, 1000):
        if i == rounds > 1 and n.sum() < least:  # the last round before was the last
            break
        middle = (v[0] + v[-1]) / 2
        cut = int(np.searchsorted(v, middle, "right"))
        part = slice(cut, None) if n[cut:].sum() > n[:cut].sum() else slice(0, cut)
        v, n = v[part], n[part]
        if i > 0 and (n.sum() < least or last == middle):
            break
        last = middle
    return float(np.average(v, weights=n))


def draws_by(counts: DataFrame, boots: int, boot_rows: int, seed: int = 0, per_part: int = 100_000) -> DataFrame:
    """(g, boot, v, n): for each group ``boots`` draws of ``boot_rows`` rows (all, if fewer) without replacement, as how often
    each value was drawn. ``counts``: g, v, n, a row for each distinct value.

    A group's values are dealt to parts by their hash. How many of a draw fall in each part is one multivariate
    hypergeometric draw over the parts' totals, a row a part; each part then draws as many of its own rows. So no task
    holds a group, and as parts and seeds depend on the values alone, reruns agree."""
    kind = counts.schema["g"].dataType.simpleString()
    parts = counts.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / per_part).cast("int").alias("parts"))
    dealt = written(counts.join(sized_broadcast(parts), "g").select("g", "v", "n", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part")), "dealt")
    source = lambda *key: np.random.default_rng([seed, *[zlib.crc32(str(k).encode()) for k in key]])

    def shares(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        total = pdf["total"].to_numpy()
        falls = source(pdf["g"].iloc[0]).multivariate_hypergeometric(total, min(boot_rows, int(total.sum())), size=boots, method="marginals")
        return pd.DataFrame({"g": pdf["g"], "part": pdf["part"], "takes": list(falls.T)})

    takes = dealt.groupBy("g", "part").agg(F.sum("n").alias("total")).groupBy("g").applyInPandas(shares, f"g {kind}, part int, takes array<long>")

    def draw(key: tuple, values: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if values.empty or asked.empty:
            return pd.DataFrame({"g": [], "boot": [], "v": [], "n": []})
        values = values.sort_values("v")
        v, ends, rng, out = values["v"].to_numpy(), np.cumsum(values["n"].to_numpy()), source(*key), []
        for boot, k in enumerate(asked["takes"].iloc[0]):
            if k:
                at, n = np.unique(np.searchsorted(ends, rng.choice(int(ends[-1]), int(k), replace=False, shuffle=False), "right"), return_counts=True)
                out.append(pd.DataFrame({"g": key[0], "boot": boot, "v": v[at], "n": n}))
        return pd.concat(out) if out else pd.DataFrame({"g": [], "boot": [], "v": [], "n": []})

    return dealt.groupBy("g", "part").cogroup(takes.groupBy("g", "part")).applyInPandas(draw, f"g {kind}, boot int, v double, n long")


def mode_by(df: DataFrame, group: str, value: str, boots: int = 0, boot_rows: int = 100, seed: int = 0, least: int = 50, max_rows: int = 100_000) -> DataFrame:
    """Half-range mode per group; with ``boots``, the mean over so many draws of ``boot_rows`` rows (AGG11). All rows count.

    Groups of more than ``max_rows`` distinct values are halved by aggregates until so few are left, then finished in
    one call a group. Draws are made in parts of a group's values (``draws_by``); only what is drawn meets, a draw at a
    time. Null and NaN values do not count; groups without others have a null mode; rows without a group are left out.
    """
    x = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("g is not null")
    counts = x.filter("v is not null and not isnan(v)").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    kind = df.schema[group].dataType.simpleString()
    if boots:

        def drawn(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("v")
            return pd.DataFrame({"g": [pdf["g"].iloc[0]], "mode": [half_range_mode(pdf["v"].to_numpy(), pdf["n"].to_numpy(), least)]})

        each = draws_by(counts, boots, boot_rows, seed, max_rows).groupBy("g", "boot").applyInPandas(drawn, f"g {kind}, mode double")
        modes = each.groupBy("g").agg(F.avg("mode").alias("mode"))
        return x.select("g").distinct().join(modes, "g", "left").withColumnRenamed("g", group)
    max_rows = max(max_rows, least)
    left = written(counts.select("g", "v", "n", F.lit(0).alias("rounds"), F.lit(None).cast("double").alias("last")), "modes")
    done: list[DataFrame] = []
    while True:
        spans = left.groupBy("g").agg(F.count(F.lit(1)).alias("k"), ((F.max("v") + F.min("v")) / 2).alias("middle"))
        large = written(spans.filter(F.col("k") > max_rows), "large")
        if not large.take(1):
            break
        done.append(left.join(large.select("g"), "g", "left_anti"))
        split = left.join(sized_broadcast(large.drop("k")), "g").withColumn("up", F.col("v") > F.col("middle"))
        fuller = split.groupBy("g").agg((F.sum(F.when(F.col("up"), F.col("n")).otherwise(0)) > F.sum(F.when(F.col("up"), 0).otherwise(F.col("n")))).alias("half"))
        kept = split.join(sized_broadcast(fuller), "g").filter(F.col("up") == F.col("half"))
        left = written(kept.select("g", "v", "n", (F.col("rounds") + 1).alias("rounds"), F.col("middle").alias("last")), "modes")
    for part in done:
        left = left.unionByName(part)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        mode = half_range_mode(pdf["v"].to_numpy(), pdf["n"].to_numpy(), least, int(pdf["rounds"].iloc[0]), float(pdf["last"].iloc[0]))
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "mode": [mode]})

    modes = left.groupBy("g").applyInPandas(run, f"g {kind}, mode double")
    return x.select("g").distinct().join(modes, "g", "left").withColumnRenamed("g", group)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    return h


_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) of Student's t, for whole columns; NaN where t is not finite or there are no degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    good = np.isfinite(t) & (df > 0)
    safe_t, safe_df = np.where(good, t, 0.0), np.where(good, df, 1.0)
    x, a, b = safe_df / (safe_df + safe_t * safe_t), safe_df / 2, np.full(t.shape, 0.5)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_LGAMMA(a + b) - _LGAMMA(a) - _LGAMMA(b) + a * np.log(inside) + b * np.log1p(-inside))
    near = inside < (a + 1) / (a + b + 2)
    p = np.where(near, front * _beta_fraction(a, b, inside) / a, 1 - front * _beta_fraction(b, a, 1 - inside) / b)
    return np.where(good, np.where(safe_t == 0, 1.0, p), np.nan)


def with_p_value(df: DataFrame, t: str, dof: Column, one_sided: bool = False, into: str = "p") -> DataFrame:
    """The p value of a t statistic: two-sided, or that of a greater mean (AGG19, AGG21)."""

    @F.pandas_udf("double")
    def p(t: pd.Series, d: pd.Series) -> pd.Series:
        two = t_two_sided(t.to_numpy(float), d.to_numpy(float))
        return pd.Series(two if not one_sided else np.where(np.isnan(two), two, np.where(t.to_numpy(float) > 0, two / 2, 1 - two / 2)))

    return df.withColumn(into, F.nanvl(p(F.col(t).cast("double"), dof.cast("double")), F.lit(None).cast("double")))


def two_class_threshold(counts: np.ndarray, centers: np.ndarray, rounds: int = 100) -> float:
    """Two Gaussians fitted to a histogram by expectation maximisation; the middle between the classes' nearest values."""
    n = counts.sum()
    if n == 0:
        return math.nan
    mean = (counts * centers).sum() / n
    mu = np.array([np.average(centers[centers <= mean], weights=counts[centers <= mean] + 1e-12), np.average(centers[centers >= mean], weights=counts[centers >= mean] + 1e-12)])
    sd = np.full(2, max(np.sqrt((counts * (centers - mean) ** 2).sum() / n) / 2, 1e-9))
    share = np.array([0.5, 0.5])
    for _ in range(rounds):
        logp = -0.5 * ((centers[:, None] - mu) / sd) ** 2 - np.log(sd) + np.log(share + 1e-12)
        p = np.exp(logp - logp.max(1, keepdims=True))
        p = p / p.sum(1, keepdims=True) * counts[:, None]
        w = p.sum(0) + 1e-12
        mu, share = (p * centers[:, None]).sum(0) / w, w / w.sum()
        sd = np.sqrt((p * (centers[:, None] - mu) ** 2).sum(0) / w) + 1e-9
    on = int(np.argmax(mu))
    held = counts > 0
    is_on = p[:, on] > p[:, 1 - on]
    low, high = centers[held & ~is_on], centers[held & is_on]
    return float((low.max() + high.min()) / 2) if len(low) and len(high) else float(mu.mean())


def bit_thresholds(df: DataFrame, position: str, value: str, bins: int = 200) -> DataFrame:
    """position, threshold between off and on values (AGG33). Spark makes one histogram of ``bins`` bins a position;
    only those reach the fit."""
    ends = df.groupBy(position).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    binned = df.join(sized_broadcast(ends), position).withColumn("bin", F.least(F.coalesce(F.floor(F.try_divide((F.col(value) - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(0)), F.lit(bins - 1)).cast("int"))
    hist = binned.groupBy(position, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        counts = np.zeros(bins)
        counts[pdf["bin"]] = pdf["n"]
        return pd.DataFrame({position: [pdf[position].iloc[0]], "threshold": [two_class_threshold(counts, lo + (np.arange(bins) + 0.5) * (hi - lo) / bins)]})

    return hist.groupBy(position).applyInPandas(run, f"{position} {df.schema[position].dataType.simpleString()}, threshold double")


def background_threshold(df: DataFrame, value: str, bins: int = 200, n_sigma: float = 10.0) -> DataFrame:
    """mu, sigma, threshold: the first histogram peak, the half-normal spread below it, mu + n_sigma sigma (AGG34)."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if ends["lo"] is None:
        return df.sparkSession.createDataFrame([], "mu double, sigma double, threshold double")
    lo, hi = float(ends["lo"]), float(ends["hi"])
    width = (hi - lo) / bins or 1.0
    at = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    counts = np.zeros(bins)
    for r in df.filter(F.col(value).isNotNull()).groupBy(at.alias("bin")).count().collect():
        counts[r["bin"]] = r["count"]
    smooth = np.convolve(counts, np.ones(3) / 3, "same")
    peaks = [i for i in range(bins) if smooth[i] > 0 and smooth[i] >= smooth[max(0, i - 1)] and smooth[i] >= smooth[min(bins - 1, i + 1)]]
    mu = lo + (peaks[0] + 0.5) * width
    below = F.when(F.col(value) <= mu, F.pow(F.lit(mu) - F.col(value), 2))
    out = df.agg(F.lit(mu).alias("mu"), F.coalesce(F.sqrt(F.avg(below)), F.lit(0.0)).alias("sigma"))
    return out.withColumn("threshold", F.col("mu") + n_sigma * F.col("sigma"))


def yeo_johnson(x: Column, lam: float) -> Column:
    """The transform for one lambda, built in."""
    up = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_lambda(x: np.ndarray) -> float:
    """The most likely lambda, by golden-section search on [-3, 5]."""
    x = x[~np.isnan(x)]
    if len(x) < 2 or x.min() == x.max():
        return 1.0
    sign = (np.sign(x) * np.log1p(np.abs(x))).sum()

    def cost(lam: float) -> float:
        y = np.empty_like(x)
        p = x >= 0
        y[p] = np.log1p(x[p]) if abs(lam) < 1e-9 else ((x[p] + 1) ** lam - 1) / lam
        y[~p] = -np.log1p(-x[~p]) if abs(lam - 2) < 1e-9 else -((1 - x[~p]) ** (2 - lam) - 1) / (2 - lam)
        return len(x) / 2 * math.log(y.var() + 1e-300) - (lam - 1) * sign

    g, a, b = (math.sqrt(5) - 1) / 2, -3.0, 5.0
    while b - a > 1e-6:
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if cost(c) < cost(d) else (c, b)
    return (a + b) / 2


def apply_yeo_johnson(df: DataFrame, column: str, into: str, sample_rows: int = 100_000, seed: int = 0) -> DataFrame:
    """The column transformed with the lambda of a hash sample of about ``sample_rows`` values (SCL20)."""
    n = df.count()
    rows = df.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    if n > sample_rows:
        rows = rows.filter(F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    return df.withColumn(into, yeo_johnson(F.col(column), yeo_johnson_lambda(np.sort(rows.toPandas()["x"].to_numpy()))))


def spread_normalised(vectors: Sequence[Column], lam: float = 0.5) -> list[Column]:
    """Series divided by sigma / sigma', where sigma' = ((sigma + 1)**lam - 1) / lam is the transformed spread of each
    (SCL20); for lam = 0, sigma' = ln(sigma + 1). A series without spread is null. Built in."""
    if lam < 0:
        raise ValueError("lam is not negative")
    out = []
    for v in vectors:
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x, lambda a: F.try_divide(a, F.size(v)))
        sigma = F.sqrt(F.aggregate(v, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")), lambda a: F.greatest(F.try_divide(a["q"], F.size(v)) - mean * mean, F.lit(0.0))))
        changed = F.log1p(sigma) if lam == 0 else (F.pow(sigma + 1, F.lit(float(lam))) - 1) / lam
        factor = F.try_divide(changed, sigma)
        out.append(F.when(factor.isNotNull(), F.transform(v, lambda x: x * factor)))
    return out
