"""Off-target scans by an inverted index of parts at their place (JON21)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: (mismatches that a round finds for certain, parts a site is cut into, parts that agree): with d mismatches in p parts,
#: p - d parts at least are free of any.
ROUNDS = ((0, 1, 1), (2, 4, 2), (4, 6, 2), (6, 8, 2))
#: Characters in a packed number, so that sums within it keep their sign.
LANE = 7
LOW, HIGH = int("7f" * LANE, 16), int("80" * LANE, 16)


def packed(seq: Column, length: int) -> Column:
    """A text of ASCII characters as numbers of seven each."""
    number = lambda at: F.conv(F.hex(F.substring(seq, at + 1, min(LANE, length - at))), 16, 10).cast("long")
    return F.array(*[number(at) for at in range(0, length, LANE)])


def matches(a: Column, b: Column, length: int) -> Column:
    """In how many places two packed texts agree: characters without a differing bit."""
    differing = F.lit(0)
    for i in range(-(-length // LANE)):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        some = (x.bitwiseAND(F.lit(LOW)) + F.lit(LOW)).bitwiseOR(x).bitwiseAND(F.lit(HIGH))
        differing = differing + F.bit_count(some)
    return F.lit(length) - differing


def seeds(seq: str, length: int, parts: int, agree: int) -> Column:
    """(which parts, their text) for every choice of ``agree`` of so many parts of a site."""
    cuts = [round(i * length / parts) for i in range(parts + 1)]
    piece = [F.substring(seq, a + 1, b - a) for a, b in zip(cuts, cuts[1:])]
    return F.array(*[F.struct(F.lit(n).alias("which"), F.concat(*[piece[i] for i in of]).alias("text")) for n, of in enumerate(combinations(range(parts), agree))])


def seed_pairs(targets: DataFrame, references: DataFrame, length: int, parts: int, agree: int) -> DataFrame:
    """Pairs of (s, start, w) and (r, lo, hi, rw) that agree in the text of a choice of parts, once for each choice."""
    t = targets.select("s", "start", "w", F.explode(seeds("s", length, parts, agree)).alias("k"))
    r = references.select(F.col("w").alias("rw"), "lo", "hi", F.explode(seeds("r", length, parts, agree)).alias("k"))
    return t.join(r, "k").drop("k")


def _other_start() -> Column:
    """Whether a reference of that text stands anywhere but at the target's own start."""
    return F.coalesce((F.col("lo") != F.col("start")) | (F.col("hi") != F.col("start")), F.lit(True))


def off_target_scan(targets: DataFrame, references: DataFrame, key: str, seq: str, start: str, ref_seq: str, ref_start: str, sub: tuple[int, int] | None = None, rounds: Sequence[tuple[int, int, int]] = ROUNDS, block: int = 4_096) -> DataFrame:
    """key, best_match: the most bases in which a reference site equals the target (JON21); sites at the target's own start
    do not count, and 0 stands where none is left. ``sub`` compares bases [a, b) only. All sites have one length.

    From the best reachable count down: the first round finds equal sites, every later one all sites with some mismatches
    more, through an index of parts at their place (a pigeonhole argument), and only for targets that no earlier round
    settled. Targets whose best site differs in more than the last round finds meet all references, in blocks. Equal
    sites stand for one. Sites are ASCII. Null sites take no part; a null start equals none.
    """
    a, b = sub or (0, 1 << 30)
    cut = lambda c: F.substring(c, a + 1, b - a)
    sites = written(references.filter(F.col(ref_seq).isNotNull()).groupBy(cut(F.col(ref_seq)).alias("r")).agg(F.min(ref_start).alias("lo"), F.max(ref_start).alias("hi"), F.count(F.when(F.col(ref_start).isNull(), 1)).alias("unplaced")), "sites")
    asked = targets.filter(F.col(seq).isNotNull()).select(key, cut(F.col(seq)).alias("s"), F.col(start).alias("start"))
    asked = written(asked, "targets")
    lengths = asked.select(F.length("s").alias("n"), F.octet_length("s").alias("b")).unionByName(sites.select(F.length("r").alias("n"), F.octet_length("r").alias("b")))
    span = lengths.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("b").alias("bytes")).first()
    if span["lo"] != span["hi"] or span["bytes"] != span["hi"]:
        raise ValueError("sites have one length, in ASCII")
    length = span["hi"]
    if not length:
        return asked.select(key, F.lit(0).cast("long").alias("best_match"))
    nowhere = F.col("unplaced") > 0  # counts for any start
    sites = sites.select("r", packed(F.col("r"), length).alias("w"), *[F.when(~nowhere, F.col(c)).alias(c) for c in ("lo", "hi")])
    open_ = asked.select("s", "start").distinct().withColumn("w", packed(F.col("s"), length))
    found = []
    for mismatches, parts, agree in rounds:
        if parts > length:
            break
        pairs = seed_pairs(open_, sites, length, parts, agree).filter(_other_start())
        best = pairs.groupBy("s", "start").agg(F.max(matches(F.col("w"), F.col("rw"), length)).alias("best"))
        found.append(written(best.filter(F.col("best") >= length - mismatches), "best"))
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("s", "start")]
        open_ = written(open_.alias("o").join(found[-1].alias("f"), same, "left_anti"), "open")
        if open_.isEmpty():
            break
    found.append(_against_all(open_, sites, length, block))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("s", "start")]
    return asked.alias("a").join(best.alias("b"), same, "left").select(f"a.{key}", F.coalesce("b.best", F.lit(0)).cast("long").alias("best_match"))


def _against_all(targets: DataFrame, sites: DataFrame, length: int, block: int) -> DataFrame:
    """The best of all references for each target, in blocks of targets and of references; maxima alone are shuffled on."""
    n_targets, n_sites = targets.count(), sites.count()
    turns, parts = max(1, -(-n_targets // block)), max(1, -(-n_sites // (16 * block)))
    t = targets.select("s", "start", F.pmod(F.xxhash64("s", "start"), F.lit(turns)).cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    r = sites.select("r", "lo", "hi", F.pmod(F.xxhash64("r"), F.lit(parts)).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("t"))
    kind = targets.schema["start"].dataType.simpleString()

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.frombuffer("".join(v).encode(), np.uint8).reshape(-1, length) for v in (q["s"], c["r"]))
        best = np.zeros(len(q), np.int32)
        own, lo, hi = q["start"].to_numpy(), c["lo"].to_numpy(), c["hi"].to_numpy()
        for s in range(0, len(c), 2048):
            same = np.zeros((len(q), min(2048, len(c) - s)), np.int16)
            for k in range(length):
                same += x[:, k, None] == y[None, s : s + 2048, k]
            same[(lo[None, s : s + 2048] == own[:, None]) & (hi[None, s : s + 2048] == own[:, None])] = 0
            best = np.maximum(best, same.max(1, initial=0))
        return pd.DataFrame({"s": q["s"], "start": q["start"], "best": best})

    met = t.groupBy("t", "p").cogroup(r.groupBy("t", "p")).applyInPandas(meet, f"s string, start {kind}, best int")
    return met.groupBy("s", "start").agg(F.max("best").alias("best"))
