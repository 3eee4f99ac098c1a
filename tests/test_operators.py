"""Operators on hand-made rows: nulls, ties, empty groups, exact bounds."""

from __future__ import annotations

import datetime as dt
import math
import random
import re
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.functions import cigar, distances, keys, paths, sequences, udf_surface
from tidewell.operators import components, filters, groups, hamming, joins, kernels, matrices, neighbours, numbering, off_targets, pairing, sampling, stats, traces, windows
from tidewell.plans import registry


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_normalize_paths(spark):
    df = spark.createDataFrame([(1, [">a", ">x", ">b"]), (2, ["<b", "<a"]), (3, [">a", "<b"]), (4, None), (5, [">x"])], "id int, path array<string>")
    out = {r["id"]: (r["path"], r["reverse_complement"]) for r in paths.normalize_paths(df, ["a", "b"]).collect()}
    assert out == {1: ([">a", ">b"], False), 2: ([">a", ">b"], True), 3: (None, None), 4: (None, None), 5: (None, None)}
    with pytest.raises(ValueError):
        paths.flag_end_to_end(df, ([], ["a"]))


def test_barcode_string_and_hamming(spark):
    df = spark.createDataFrame([([">b0=1", "<b1=1", ">b2=0"], "ACGN", "ACTA")], "p array<string>, a string, b string")
    r = df.select(paths.barcode_string(F.col("p"), ["b0", "b1", "b2"]).alias("s"), sequences.hamming(F.col("a"), F.col("b")).alias("d")).first()
    assert (r["s"], r["d"]) == ("110", 1)
    with pytest.raises(Exception, match="unequal"):
        spark.createDataFrame([("A", "AC")], "a string, b string").select(sequences.hamming(F.col("a"), F.col("b"))).collect()


ALN = "name string, path array<string>, path_start int, path_end int, path_length int, query_start int, query_end int, query_length int, cg string"


def test_segments_cut(spark):
    lengths = spark.createDataFrame([("s=1", 4), ("t", 3)], "name string, length int")
    # insertion exactly on the boundary of s and t, one base of the query before and two after
    df = spark.createDataFrame([("r", [">s=1", "<t"], 0, 7, 7, 1, 10, 12, "3=1X2I2=1D"), ("n", None, 0, 7, 7, 0, 7, 7, "7="), ("m", [">s=1"], 0, 4, 4, 0, 4, 4, None)], ALN)
    out = {r["segment"]: r.asDict() for r in cigar.cut_by_segment(df, lengths).collect()}
    assert set(out) == {"s", "t", "upstream", "downstream"} or set(out) == {"s=1", "t", "upstream", "downstream"}
    s = out.get("s") or out["s=1"]
    assert (s["matches"], s["mismatches"], s["insertions"], s["deletions"], s["variant"]) == (3, 1, 0, 0, 1)
    t = out["t"]
    assert (t["matches"], t["insertions"], t["deletions"], t["reverse_complement"]) == (2, 2, 1, True)
    assert out["upstream"]["insertions"] == 1 and out["downstream"]["insertions"] == 2
    bad = spark.createDataFrame([("r", [">s=1"], 0, 4, 4, 0, 4, 4, "4M")], ALN)
    with pytest.raises(Exception, match="only ="):
        cigar.cut_by_segment(bad, lengths).collect()


@pytest.mark.parametrize("path,cg,why", [([">s=1", ">x", ">t"], "7=", "not in the segment table"), ([">s=1", ">t"], "30=", "fewer bases"), ([">s=1", ">t"], "3=", "more bases"), ([">t", "<t"], "6=", "twice")])
def test_alignments_that_cannot_be_cut(spark, path, cg, why):
    lengths = spark.createDataFrame([("s=1", 4), ("t", 3)], "name string, length int")
    n = int(cg[:-1])
    bad = spark.createDataFrame([("r", path, 0, n, n, 0, n, n, cg)], ALN)
    with pytest.raises(Exception, match=why):
        cigar.cut_by_segment(bad, lengths).collect()


def brute_cuts(path, lengths, ops):
    """Base by base: ops as (op, n), already padded; counts, query span, bases per segment position or side."""
    bounds, at = [], 0
    for s in path:
        at += lengths[s[1:]]
        bounds.append(at)
    r = q = 0
    out = {}
    for op, n in ops:
        for _ in range(n):
            if op == "I":
                where = "upstream" if r == 0 else "downstream" if r == at else next(i for i, b in enumerate(bounds) if r < b)
            else:
                where = next(i for i, b in enumerate(bounds) if r < b)
            e = out.setdefault(where, {"n": {}, "lo": q, "hi": q, "ops": ""})
            e["n"][op] = e["n"].get(op, 0) + 1
            e["ops"] += op
            q += op in "=XI"
            r += op in "=XD"
            e["hi"] = max(e["hi"], q)
    return out


def test_cuts_equal_walking_base_by_base(spark):
    rng = random.Random(11)
    lengths = {"a": 5, "b=1": 1, "b=2": 9, "c": 3, "d=x": 12}
    data, want = [], {}
    for k in range(120):
        some = rng.sample(sorted(lengths), rng.randrange(1, 6))
        some = [s for s in some if s != "b=2" or "b=1" not in some]  # one variant of a segment in a path
        path = [rng.choice("<>") + s for s in some]
        total, ops, left = sum(lengths[s[1:]] for s in path), [], 0
        while left < total:
            op, n = rng.choice("==XID"), rng.randrange(1, 7)
            n = min(n, total - left) if op != "I" else n
            left += n if op != "I" else 0
            ops.append((op, n))
        head, tail = rng.randrange(3), rng.randrange(3)
        p0 = rng.randrange(0, 2) if ops[0][0] == "D" and ops[0][1] > 2 else 0
        body = [(ops[0][0], ops[0][1] - p0), *ops[1:]]
        n_query = head + tail + sum(n for op, n in ops if op != "D")
        seq = "".join(rng.choices("ACGT", k=n_query))
        data.append((f"r{k}", path, p0, total, total, head, n_query - tail, n_query, "".join(f"{n}{op}" for op, n in body), seq, list(range(n_query))))
        want[f"r{k}"] = brute_cuts(path, lengths, [("I", head), ("D", p0), *body, ("I", tail)]), path
    df = spark.createDataFrame([*data, ("n", None, 0, 7, 7, 0, 7, 7, "7=", "A", [1])], ALN + ", seq string, phred array<int>").repartition(3)
    table = spark.createDataFrame(list(lengths.items()), "name string, length int")
    got = {}
    for r in cigar.cut_by_segment(df, table, with_cigar=True, seq="seq", phred="phred").collect():
        where = r["segment"] if r["position"] is None else r["position"]
        got.setdefault(r["name"], {})[where] = r
    assert set(got) == {k for k, (w, _) in want.items() if w}
    reads = {d[0]: d for d in data}
    for name, (cuts, path) in want.items():
        assert set(cuts) == set(got.get(name, {}))
        for where, e in cuts.items():
            r = got[name][where]
            assert [r[c] for c in ("matches", "mismatches", "insertions", "deletions")] == [e["n"].get(o, 0) for o in "=XID"]
            assert (r["query_start"], r["query_end"]) == (e["lo"], e["hi"])
            back = isinstance(where, int) and path[where][0] == "<"
            part, scores, ops = reads[name][9][e["lo"] : e["hi"]], reads[name][10][e["lo"] : e["hi"]], e["ops"]
            if back:
                part, scores, ops = "".join({"A": "T", "C": "G", "G": "C", "T": "A"}[c] for c in reversed(part)), scores[::-1], ops[::-1]
            assert r["seq"] == part and r["phred"] == scores
            assert "".join(c * int(n) for n, c in re.findall(r"(\d+)(\D)", r["cigar"])) == ops
            if isinstance(where, int):
                assert r["segment"] == path[where][1:].split("=")[0] and r["reverse_complement"] == path[where].startswith("<")
    wide = {r["name"]: r for r in cigar.segment_structs(df, table, ["a", "b", "upstream"]).collect()}
    for name, (cuts, path) in want.items():
        names = {p[1:].split("=")[0]: i for i, p in enumerate(path)}
        assert (wide[name]["b"] is None) == ("b" not in names) and (wide[name]["upstream"] is None) == ("upstream" not in cuts)
        if "a" in names:
            assert wide[name]["a"]["matches"] == cuts[names["a"]]["n"].get("=", 0)
    assert wide["n"]["a"] is None
    some = cigar.cut_by_segment(df, table, segments=["b"], separate_ends=False)
    assert {r["segment"] for r in some.collect()} == {"b"} and dict(some.dtypes)["variant"] == "string"
    one = segment_struct_types(cigar.segment_structs(df, table, ["b", "d"]))
    assert one == {"b": "int", "d": "string"}


def segment_struct_types(df):
    return {f.name: f.dataType["variant"].dataType.simpleString() for f in df.schema.fields if f.name in ("b", "d")}


def test_a_cut_by_hand(spark):
    """A path of a forward and a reverse segment, worked out by hand."""
    df = spark.createDataFrame([("r", [">a", "<b"], 0, 9, 9, 0, 9, 9, "4=1X4=", "AAAACGGTT", list(range(1, 10)))], ALN + ", seq string, phred array<int>")
    table = spark.createDataFrame([("a", 4), ("b", 5)], "name string, length int")
    a, b = cigar.cut_by_segment(df, table, with_cigar=True, seq="seq", phred="phred").orderBy("position").collect()
    assert (a["seq"], a["phred"], a["cigar"]) == ("AAAA", [1, 2, 3, 4], "4=")
    assert (b["seq"], b["phred"], b["cigar"]) == ("AACCG", [9, 8, 7, 6, 5], "4=1X")


def test_two_variants_in_one_path_are_an_error(spark):
    df = spark.createDataFrame([("r", [">bc=0", ">bc=1", ">a"], 0, 3, 3, 0, 3, 3, "3=")], ALN)
    table = spark.createDataFrame([("bc=0", 1), ("bc=1", 1), ("a", 1)], "name string, length int")
    for cut in (lambda: cigar.cut_by_segment(df, table), lambda: cigar.segment_structs(df, table, ["bc"])):
        with pytest.raises(Exception, match="twice"):
            cut().collect()
    assert cigar.cut_by_segment(df, table, segments=["a"]).count() == 1  # what is not asked for may repeat


@pytest.mark.parametrize("held", [64_000_000, 0])
def test_assembled_paths(spark, held):
    segments = spark.createDataFrame([("a", "ACGGN"), ("b=1", "TT"), ("c", "")], "name string, seq string")
    rows = [(1, [">a", "<b=1"], "acggnaa"), (2, ["<a"], "NCCGT"), (3, None, "A"), (4, [], "A"), (5, ["<c"], "A"), (6, [">c", ">b=1"], None), (7, [">b=1"], "")]
    df = spark.createDataFrame(rows, "id int, path array<string>, seq string")
    got = {r["id"]: r["reference_seq"] for r in paths.assemble_sequence(df, "path", "id", segments, held_bytes=held).collect()}
    assert got == {1: "ACGGNAA", 2: "NCCGT", 3: None, 4: None, 5: "", 6: "TT", 7: "TT"}
    far = {r["id"]: r["distance"] for r in paths.reference_distance(df, "path", "id", "seq", segments).collect()}
    assert far == {1: 0, 2: 0, 3: None, 4: None, 5: None, 6: None, 7: None}
    unknown = spark.createDataFrame([(1, [">a", ">x", ">b=1"])], "id int, path array<string>")
    with pytest.raises(Exception, match="not among the segments"):
        paths.assemble_sequence(unknown, "path", "id", segments, held_bytes=held).collect()


def test_bit_distances(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcé𝄞", k=n))
    pairs = [(word(rng.randrange(90)), word(rng.randrange(90))) for _ in range(300)]
    for _ in range(40):
        a = word(200)
        b = list(a)
        for _ in range(rng.randrange(20)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = word(rng.randrange(3))
        pairs.append((a, "".join(b)))
    pairs += [("", ""), ("", "abc"), ("a", "a"), ("abc", "abcd")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("a", "b", F.levenshtein("a", "b").alias("want")).collect():
        assert distances.bit_distance(r["a"], r["b"]) == distances.bit_distance(r["b"], r["a"]) == r["want"]
        for most in (0, 3, 15, 60):
            assert distances.bit_distance(r["a"], r["b"], most) == (r["want"] if r["want"] <= most else -1)
    wide = spark.createDataFrame([(word(700), word(900)), ("ab", "ac"), (None, "a"), (word(3000), None)], "a string, b string")
    got = wide.select(distances.edit_distance(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("e"), distances.edit_distance(F.col("a"), F.col("b"), 5).alias("near")).collect()
    assert all(r["d"] == r["e"] for r in got) and [r["near"] for r in got] == [-1, 1, None, None]


def test_long_distances_are_fast(spark):
    """Texts of 10,000 characters, at least five times as fast as the built-in function."""
    rng = random.Random(9)
    pairs = [tuple("".join(rng.choices("ACGT", k=10_000)) for _ in "ab") for _ in range(6)]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1).cache()
    df.select(distances.edit_distance(F.col("a"), F.col("b"))).collect()  # workers have started
    took, got = [], []
    for c in (distances.edit_distance(F.col("a"), F.col("b")), F.levenshtein("a", "b")):
        began = time.perf_counter()
        got.append(df.select(c).collect())
        took.append(time.perf_counter() - began)
    df.unpersist()
    print("bit vectors, built-in:", took)
    assert got[0] == got[1] and 5 * took[0] < took[1]


def test_cigar_round_trip(spark):
    df = spark.createDataFrame([("3=2=0D1X", "5=1X"), ("", "")], "c string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", cigar.encode(cigar.merge(cigar.decode(F.col("c")))).alias("got")).collect())


def test_asof_bounds(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    left = spark.createDataFrame([(1, "a", t(0)), (1, "b", t(10)), (2, "c", t(0))], "k int, id string, t timestamp")
    right = spark.createDataFrame([(1, "x", t(0)), (1, "y", t(13)), (1, "z", t(13))], "k int, rid string, s timestamp")
    out = {r["id"]: r["match_rid"] for r in pairing.asof_forward(left, right, ["k"], "t", "s", "rid", 3_000_000).collect()}
    assert out == {"a": "x", "b": "y", "c": None}  # zero gap, exactly the tolerance with a tie, no partner
    assert pairing.asof_forward(left, right, ["k"], "t", "s", "rid", 2_999_999).filter("id = 'b'").first()["match_rid"] is None


def test_asof_across_ranges(spark, monkeypatch):
    """One channel with nine tenths of all rows, in many ranges; ties, null times, null channels, a long silence."""
    monkeypatch.setattr(numbering, "in_ranges", lambda df, order, rows_per_part=None, f=numbering.in_ranges: f(df, order, 40))
    rng = random.Random(5)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.choice([rng.randrange(400), rng.randrange(400), 90_000]))
    left = [(1 if rng.random() < 0.9 else rng.choice([2, None]), i, rng.choice([at(), at(), at(), None])) for i in range(400)]
    right = [(1 if rng.random() < 0.9 else rng.choice([2, 3, None]), i, rng.choice([at(), at(), None])) for i in range(200)]
    l, r = spark.createDataFrame(left, "k int, i int, t timestamp"), spark.createDataFrame(right, "k int, j int, s timestamp")  # noqa: E741
    got = {x["i"]: (x["match_j"], x["match_time"]) for x in pairing.asof_forward(l, r, ["k"], "t", "s", "j", 5_000_000).collect()}
    want = {}
    for k, i, t in left:
        near = min(((s, j) for q, j, s in right if q == k and s is not None and t is not None and s >= t), default=None)
        want[i] = (near[1], near[0]) if near and near[0] - t <= dt.timedelta(seconds=5) else (None, None)
    assert got == want and sum(j is not None for j, _ in want.values()) > 100
    plan = pairing.asof_forward(l, r, ["k"], "t", "s", "j", 5)._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan


def test_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 1,000 segments, in any order of names, in at most 15 rounds; rings, lone loops and null ends."""
    rounds = []
    monkeypatch.setattr(components, "written", lambda df, name, f=components.written: (rounds.append(name), f(df, name))[1])
    names = [f"s{i}" for i in range(1000)]
    random.Random(3).shuffle(names)
    links = [*zip(names, names[1:]), ("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "y"), ("z", None), (None, None)]
    got = {r["node"]: r["part"] for r in components.connected_parts(spark.createDataFrame(links, "a string, b string"), "a", "b").collect()}
    assert got == {**{n: "s0" for n in names}, **{f"x{i}": "x1" for i in (1, 2, 3)}, "y": "y"}
    assert len(rounds) <= 16, len(rounds)  # one before the first round
    assert components.connected_parts(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_duplex_validity(spark):
    data = [("a", "p", False), ("b", "p", True), ("a;b", "p", False), ("c", "p", False), ("c;d", "p", False), ("e", "q", False), ("f", "q", False), ("e;f", "q", False), ("a;c", "p", False)]
    out = {r["name"]: r["is_valid"] for r in pairing.flag_valid_duplex(spark.createDataFrame(data, "name string, path string, rc boolean"), "name", "path", "rc").collect()}
    assert out["a;b"] and not out["c;d"] and not out["e;f"] and not out["a;c"]
    assert not out["a"] and not out["b"] and out["c"] and out["e"]


def test_unknown_alignment_raises(spark):
    reads = spark.createDataFrame([("a",), ("b",)], "name string")
    good = spark.createDataFrame([("a", 1)], "name string, x int")
    assert rows(pairing.join_reads_and_alignments(reads, good), "name") == [("a", 1), ("b", None)]
    bad = spark.createDataFrame([("z", 1)], "name string, x int")
    with pytest.raises(Exception, match="no read named"):
        pairing.join_reads_and_alignments(reads, good.union(bad), include_unaligned=False).collect()


def test_nearest_within_is_exact(spark):
    rng = np.random.default_rng(1)
    book, asked = rng.integers(0, 1 << 16, 60), rng.integers(0, 1 << 16, 80)
    c = spark.createDataFrame([(i, int(x)) for i, x in enumerate(book)], "b long, code long")
    q = spark.createDataFrame([(i, int(x)) for i, x in enumerate(asked)], "q long, code long")
    for thr in (0, 2, 4):
        want = {}
        for i, x in enumerate(asked):
            d, j = min((int(x ^ y).bit_count(), j) for j, y in enumerate(book))
            if d <= thr:
                want[i] = (j, d)
        got = {r["q"]: (r["b"], r["distance"]) for r in hamming.nearest_within(q, c, "q", "code", "b", "code", 16, thr).collect()}
        assert got == want


def test_mutual_nearest_ties_and_empty(spark):
    a = spark.createDataFrame([(1, 1, 0.0), (1, 2, 10.0), (2, 3, 0.0)], "f int, a int, x double")
    b = spark.createDataFrame([(1, 7, 1.0), (1, 8, -1.0)], "f int, b int, x double")
    assert rows(joins.mutual_nearest(a, b, ["f"], "a", "b", ["x"]).select("a", "b"), "a") == [(1, 7)]
    assert joins.mutual_nearest(a.limit(0), b, ["f"], "a", "b", ["x"]).count() == 0


def test_overlap_rejects_repeats(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    assert {(r["in_a"], r["in_b"]): r["n"] for r in joins.overlap_summary(a, a.filter("k = 1"), "k").collect()} == {(True, True): 1, (True, False): 1}
    with pytest.raises(Exception, match="twice"):
        joins.overlap_summary(a.union(a), a, "k").collect()


def test_best_rows_salted_equals_plain(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.col("id") % 11).alias("q"))
    plain = rows(groups.best_rows(df, ["g"], "q", 4, ["id"]), "g", "rank")
    assert plain == rows(groups.best_rows(df, ["g"], "q", 4, ["id"], salt=5), "g", "rank")


def test_dense_index_over_bounds(spark):
    df = spark.createDataFrame([(k,) for k in ("b", "a", "d", "c")], "k string")
    assert rows(numbering.dense_index(df, ["k"], "i"), "i") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    large = spark.range(250_000).select((F.col("id") * 7919 % 250_007).alias("k"))
    out = numbering.dense_index(large, ["k"], "i")
    assert out.agg(F.max("i"), F.countDistinct("i")).first() == (249_999, 250_000)
    assert out.selectExpr("corr(k, i)").first()[0] > 0.999


@pytest.mark.parametrize("per", [7, 1_000_000])
def test_running_values_and_quantiles_over_ranges(spark, per):
    df = spark.range(300).select((F.col("id") * 37 % 301).alias("k"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"), (F.col("id") * 7 % 13).alias("v"))
    got = {r["k"]: r for r in numbering.running(df, "k", {"s": "v"}, {"m": "v"}, group=["g"], descending=True, rows_per_part=per).collect()}
    data = df.collect()
    for r in data:
        before = [x["v"] for x in data if x["g"] == r["g"] and x["k"] >= r["k"]]
        assert (got[r["k"]]["s"], got[r["k"]]["m"]) == (sum(before), min(before))
    found = {r["g"]: r["quantiles"] for r in numbering.exact_quantiles(df, "k", [0.0, 0.25, 0.5, 0.99, 1.0], ["g"], rows_per_part=per).collect()}
    for g in (None, 1, 2, 3):
        want = np.quantile([r["k"] for r in data if r["g"] == g], [0.0, 0.25, 0.5, 0.99, 1.0])
        assert np.allclose(found[g], want)
    assert numbering.exact_quantiles(df.limit(0), "k", [0.5]).collect()[0]["quantiles"] == [None]
    assert numbering.exact_quantiles(df.limit(0), "k", [0.5], ["g"]).count() == 0
    ids = numbering.dense_index(df, ["k"], "i", rows_per_part=per).orderBy("k").collect()
    assert [r["i"] for r in ids] == list(range(300))


@pytest.mark.parametrize("per", [6, 100_000])
def test_outliers_by_buckets(spark, per):
    values = [float(10 + i % 3 + (90 if i in (7, 23) else 0)) for i in range(40)]
    out = windows.median_filter_outliers(spark.createDataFrame(list(enumerate(values)), "f int, v double"), "f", "v", per_bucket=per)
    padded = [values[1], values[0], *values, values[-1], values[-2]]
    residual = np.array(values) - [np.median(padded[i : i + 5]) for i in range(40)]
    want = np.abs(residual - residual.mean()) <= 2 * residual.std()
    assert [r["normal"] for r in out.orderBy("f").collect()] == want.tolist() and not want[7]


def test_column_vote_ties(spark):
    df = spark.createDataFrame([("g", "ACT"), ("g", "ATT"), ("g", "GCA"), ("h", "")], "g string, s string")
    assert rows(groups.column_vote(df, ["g"], "s")) == [("g", "ACT")]


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.03, None, 0.5]
    out = {r["i"]: (round(r["p_adjusted"], 4), r["significant"]) for r in stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p").collect()}
    assert out == {0: (0.05, True), 1: (0.05, True), 2: (0.05, True), 3: (0.05, True), 5: (0.5, False)}


def test_zero_denominators_are_null(spark):
    empty = spark.createDataFrame([], "q int, t int")
    assert stats.confusion(empty, F.col("q") == 1, F.col("t") == 1).first()["error_rate"] is None
    one = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert stats.robust_z(one, "x", F.lit(True)).first()["z"] is None


def test_gap_fill_ends_stay_null(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 1.0), (1, 2, None), (1, 4, 4.0), (1, 5, None)], "g int, t int, y double")
    assert [r["filled"] for r in windows.gap_fill(df, ["g"], "t", "y").orderBy("t").collect()] == [None, 1.0, 2.0, 4.0, None]


def test_cumulative_equals_window(spark):
    df = spark.range(1, 200).select("id", (F.col("id") % 5).alias("v"))
    out = windows.cumulative(df, "id", {"c": "v"}, descending=True).orderBy("id").collect()
    want = np.cumsum([r["v"] for r in out][::-1])[::-1]
    assert [r["c"] for r in out] == want.tolist()


def test_kernel_trace_against_numpy(spark):
    data = [(1, float(t), float(t % 3)) for t in range(20)]
    out = traces.kernel_traces(spark.createDataFrame(data, "g int, t double, y double"), ["g"], "t", ["y"], [0.0, 5.0], 2.0).first()["y"]
    t, y = np.arange(20.0), np.arange(20) % 3
    want = [(np.exp(-((t - g) / 2) ** 2 / 2) * y).sum() / np.exp(-((t - g) / 2) ** 2 / 2).sum() for g in (0.0, 5.0)]
    assert np.allclose(out, want)


def test_nearest_vectors_across_blocks(spark):
    x = np.random.default_rng(3).normal(size=(70, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.nearest_vectors(df, "id", "v", 3, block=16).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(-1) + np.diag([np.inf] * 70)
    assert got == {(i, k + 1): int(j) for i in range(70) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    some = neighbours.nearest_vectors(df, "id", "v", 3, block=2, queries=df.filter("id % 9 = 0")).collect()
    assert {(r["id"], r["rank"]): r["neighbour"] for r in some} == {k: v for k, v in got.items() if k[0] % 9 == 0}
    assert neighbours.nearest_vectors(df.limit(0), "id", "v", 3).count() == 0


def test_trench_lineage_division(spark):
    cells = [(1, 0, 0, 10.0), (1, 0, 1, 8.0), (1, 1, 0, 5.0), (1, 1, 1, 5.0), (1, 1, 2, 8.5)]
    out = {(r["t"], r["p"]): (r["lineage"], r["progeny_id"]) for r in traces.trench_lineages(spark.createDataFrame(cells, "g int, t int, p int, len double"), ["g"], "t", "p", "len").collect()}
    assert out == {(0, 0): (0, 1), (0, 1): (1, 1), (1, 0): (0, 2), (1, 1): (0, 3), (1, 2): (1, 1)}
    shrunk = [(1, 0, 0, 10.0, False), (1, 0, 1, 9.0, True), (1, 1, 0, 9.5, False), (1, 1, 1, 4.0, False)]
    df = spark.createDataFrame(shrunk, "g int, t int, p int, len double, edge boolean")
    ids = lambda **how: {(r["t"], r["p"]): (r["lineage"], r["progeny_id"]) for r in traces.trench_lineages(df, ["g"], "t", "p", "len", **how).collect()}
    assert ids(buffer=1.0, at_edge="edge") == {(0, 0): (0, 1), (0, 1): (1, 1), (1, 0): (0, 1), (1, 1): (1, 1)}
    assert ids(buffer=1.0)[(1, 1)] == (1, 2) and ids()[(1, 1)] == (0, 3)


def plain_lineages(cells, buffer):
    """Ids of one trench's cells {(t, p): (lineage, node)}: each frame takes the one before as a queue of expected cells."""
    ids, queue, fresh = {}, [], 0
    for t in sorted({c[0] for c in cells}):
        frame = sorted(c for c in cells if c[0] == t)
        waiting, sizes, expected = list(queue), [c[2] for c in frame], []
        queue = []
        for _, p, size, edge in frame:
            if not expected and waiting:
                lineage, node, was, at_edge = waiting.pop(0)
                divided = size + buffer < was and not at_edge
                expected = [(lineage, 2 * node), (lineage, 2 * node + 1)] if divided else [(lineage, node)]
            if not expected:
                expected, fresh = [(fresh, 1)], fresh + 1
            ids[t, p] = expected.pop(0)
            queue.append((*ids[t, p], size, edge))
        assert len(sizes) == len(queue)
    return ids


@pytest.mark.parametrize("buffer", [0.0, 1.5])
def test_lineages_of_random_trenches(spark, buffer):
    rng = random.Random(int(buffer * 2))
    trenches = {g: [(t, p, float(rng.randrange(1, 12)), rng.random() < 0.2) for t in range(12) for p in range(rng.randrange(6))] for g in range(40)}
    df = spark.createDataFrame([(g, *c) for g, cells in trenches.items() for c in cells], "g int, t int, p int, len double, edge boolean").repartition(5)
    out = traces.trench_lineages(df, ["g"], "t", "p", "len", buffer=buffer, at_edge="edge").collect()
    got = {(r["g"], r["t"], r["p"]): (r["lineage"], r["progeny_id"]) for r in out}
    assert got == {(g, *k): v for g, cells in trenches.items() for k, v in plain_lineages(cells, buffer).items()}


def test_lineages_across_batches_without_a_table_a_trench(spark):
    cells = [(g, t, p, float(9 - t + p % 2)) for g in (None, 1, 2) for t in range(4) for p in range(3)]
    df = spark.createDataFrame([*cells, (1, None, 0, 5.0)], "g int, t int, p int, len double").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = traces.trench_lineages(df, ["g"], "t", "p", "len")
        got = {(r["g"], r["t"], r["p"]): (r["lineage"], r["progeny_id"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = plain_lineages([(*c[1:], False) for c in cells if c[0] == 1], 0.0)
    assert got == {(g, *k): v for g in (None, 1, 2) for k, v in plain.items()}
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_bit_thresholds_equal_the_likeliest_split(spark):
    """Against all splits of the values into two normal classes, each tried."""
    rng = np.random.default_rng(12)
    data = {p: np.concatenate([rng.normal(0, s, n), rng.normal(d, 1.5 * s, m)]) for p, (s, d, n, m) in enumerate(((0.5, 8, 400, 300), (1.0, 15, 200, 600), (2.0, 60, 500, 100)))}
    df = spark.createDataFrame([(p, float(v)) for p, x in data.items() for v in x], "p int, v double")
    got = {r["p"]: r["threshold"] for r in kernels.bit_thresholds(df, "p", "v").collect()}
    for p, x in data.items():
        x = np.sort(x)
        cost = [sum(len(y) * np.log(y.std() * len(x) / len(y)) for y in (x[:i], x[i:])) for i in range(5, len(x) - 5)]
        at = int(np.argmin(cost)) + 5
        width = (x[-1] - x[0]) / 200
        assert x[at - 1] - 2 * width <= got[p] <= x[at] + 2 * width


def test_quality_to_rank_by(spark):
    df = spark.createDataFrame([("a", 5.0, 1.0, [10, 20])], "name string, qs double, rq double, read_phred array<int>")
    got = [t.select(groups.read_quality(t).alias("q")).first()["q"] for t in (df, df.drop("rq"), df.drop("rq", "qs"))]
    assert got == [1.0, 5.0, 15.0]


def test_members_as_rows(spark):
    df = spark.createDataFrame([("b", 1), ("b", 2), ("a", 3), ("a", 4), ("c", 5)], "k string, m int")
    book = groups.threshold_codebook(df, "k", "m", 2).collect()
    assert sorted((r["k"], r["depth"], tuple(r["members"]), r["barcodeid"]) for r in book) == [("a", 2, (3, 4), 0), ("b", 2, (1, 2), 1)]
    assert rows(groups.barcode_members(df, "k", "m", 2), "m") == [(1, 1), (1, 2), (0, 3), (0, 4)]


def test_descendants_need_every_node_between(spark):
    nodes = spark.createDataFrame([("g", n) for n in (1, 2, 5, 12)], "g string, node long")
    assert rows(keys.descendants(nodes, ["g"]).select("ancestor", "descendant"), "ancestor", "descendant") == [(1, 2), (1, 5), (2, 5)]


def test_remove_bits_drops_collisions(spark):
    book = spark.createDataFrame([("101", 0), ("111", 1), ("001", 2)], "barcode string, barcodeid long")
    assert rows(filters.remove_bits(book, "barcode", [1])) == [("01", 0)]


def test_student_t_and_mode():
    assert math.isclose(kernels.t_two_sided(2.228, 10), 0.05, abs_tol=1e-4)
    assert math.isclose(kernels.t_two_sided(0.0, 5), 1.0)
    assert math.isnan(kernels.t_two_sided(float("inf"), 5))
    x = np.concatenate([np.random.default_rng(0).normal(5, 0.1, 500), np.random.default_rng(1).uniform(0, 20, 100)])
    assert abs(kernels.half_range_mode(np.sort(x)) - 5) < 0.5


def test_mode_counts_all_rows(spark):
    rng = np.random.default_rng(4)
    values = {
        "a": np.round(np.concatenate([rng.normal(5, 1, 900), rng.uniform(-50, 50, 500)]), 2), "b": rng.exponential(3, 700), "c": np.array([1.0, 1.0, 2.0, 9.0]), "d": np.array([3.0]),
        "e": np.repeat([1.0, 1e6, 1e6 + 1, 2e6], [3, 5, 5, 4]), "f": np.arange(64.0),
    }
    data = [(g, float(v)) for g, x in values.items() for v in x] + [("a", None), ("n", None)]
    df = spark.createDataFrame(data, "g string, x double")
    want = {g: kernels.half_range_mode(np.sort(x)) for g, x in values.items()}
    assert 4 < want["a"] < 6 and want["d"] == 3 and want["f"] == np.arange(16).mean()
    for few in (60, 100_000):
        got = {r["g"]: r["mode"] for r in kernels.mode_by(df.repartition(few % 7 + 1), "g", "x", max_rows=few).collect()}
        assert got.pop("n") is None and got.keys() == want.keys()
        assert all(math.isclose(got[g], want[g], rel_tol=1e-12) for g in want)


def test_bit_thresholds_split(spark):
    rng = np.random.default_rng(2)
    data = [(0, float(v)) for v in np.concatenate([rng.normal(1, 0.1, 300), rng.normal(5, 0.2, 300)])]
    assert 1.5 < kernels.bit_thresholds(spark.createDataFrame(data, "p int, x double"), "p", "x").first()["threshold"] < 4.5


def test_sampling_repeats_itself(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 4)
    assert rows(sampling.sample_n(df, ["id"], 5, ["g"]), "id") == rows(sampling.sample_n(df, ["id"], 5, ["g"]), "id")
    assert sampling.sample_n(df, ["id"], 5, ["g"]).count() == 20
    assert abs(sampling.sample_share(df, ["id"], 0.3).count() - 300) < 80


def test_tolerance_grid_at_delta(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 2.5), (1, 2.5)], "g int, x double")
    assert [r["i"] for r in filters.tolerance_grid(df, ["g"], "x", 1.0, "i").orderBy("x").collect()] == [0, 0, 1, 1]


def test_median_vectors(spark, sf_dir):
    rng = np.random.default_rng(5)
    data = [(int(label), [float(x) for x in rng.integers(0, 9, 3)]) for label in [*[1] * 301, 2, *[3] * 40]]
    got = {r["label"]: r["aggregate"] for r in udf_surface.median_vectors(spark.createDataFrame(data, "label int, v array<float>"), ["label"], "v").collect()}
    assert got == {k: np.median([v for i, v in data if i == k], axis=0).tolist() for k in (1, 2, 3)}
    plan = registry.queries()["user_vectors"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "AggregateInPandas" not in plan and "ArrowAggregatePython" not in plan


def test_ranks_of_means_that_change_when_found_anew(spark):
    anew = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    df = spark.range(20).select((F.col("id") % 5).alias("g"), anew().alias("v"))
    out = windows.rank_groups(df, ["g"], "v").collect()
    assert [r["mean_rank"] for r in sorted(out, key=lambda r: r["mean"])] == [1, 2, 3, 4, 5]


def test_lone_points_equal_all_pairs_and_dense_cells_stay_small(spark):
    rng = random.Random(9)
    pts = [(rng.choice("ab"), i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(120)]
    pts += [("a", 200 + i, 10.0, 10.0) for i in range(2000)] + [("b", 3000, 10.0, 12.1), ("b", 3000, 10.0, 12.2), ("b", 3001, None, 1.0), ("b", 3002, float("nan"), 1.0), (None, 3003, 1.0, 1.0), (None, 3004, 1.0, 1.0)]
    df = spark.createDataFrame(pts, "g string, k long, x double, y double")
    out = joins.lone_points(df, ["g"], "k", "x", "y", 6.0)
    near = lambda p, q: p[0] is not None and p[0] == q[0] and p[1] != q[1] and None not in (p[2], q[2]) and math.hypot(p[2] - q[2], p[3] - q[3]) < 6.0
    lone = [p[1] for p in pts if not any(near(p, q) for q in pts)]
    assert sorted(r["k"] for r in out.collect()) == sorted(lone) and 3000 in lone


def test_adjusted_p_values_that_change_when_found_anew(spark):
    anew = F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()
    out = stats.benjamini_hochberg(spark.range(20).select("id", anew().alias("p")), "p").collect()
    p = sorted(r["p"] for r in out)
    adjusted = [min(min(p[j] * 20 / (j + 1) for j in range(i, 20)), 1.0) for i in range(20)]
    assert sorted(r["p_adjusted"] for r in out) == pytest.approx(adjusted)


def test_packed_counts_are_added_up_some_bytes_at_a_time(spark, monkeypatch):
    pdf = pd.DataFrame({"block": 0, "cells": [b"\0" * n for n in (400, 400, 4000, 4, 4)]})
    monkeypatch.setattr(matrices, "MERGED", 3000)
    pieces = list(matrices._pieces(pdf))
    assert pd.concat(pieces).equals(pdf) and max(len(p) for p in pieces) < 5
    assert max(p["cells"].iloc[1:].map(len).sum() * 3 for p in pieces) <= 3000
    assert list(matrices._pieces(pdf.iloc[:0])) == []


def test_marks_on_a_line_without_frames_to_the_last_row(spark):
    """Such a frame is added up anew for each row of a range."""
    df = spark.createDataFrame([(1, 1, 2.0)], "g int, id long, x double")
    plan = numbering.around_on_line(df, df.select("g", "x", F.col("id").alias("m")), ["g"], "x", "m")._jdf.queryExecution().toString()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan


@pytest.mark.parametrize("dims,within", [(1, None), (1, 4.0), (2, None), (2, 3.0), (3, None)])
def test_mutual_nearest_equals_all_pairs(spark, dims, within):
    rng = random.Random(dims)
    coords = ["x", "y", "z"][:dims]
    point = lambda: [rng.choice([rng.randrange(40) * 1.0, rng.random() * 40, 900.0]) for _ in coords]
    a = [(rng.choice("gh"), i, *point()) for i in range(120)] + [("lone", 500, *point())]
    b = [(rng.choice("gh"), i, *point()) for i in range(90)] + [("other", 600, *point()), ("g", 601, *[None] * dims)]
    kind = "grp string, {} long, " + ", ".join(f"{c} double" for c in coords)
    out = joins.mutual_nearest(spark.createDataFrame(a, kind.format("a")), spark.createDataFrame(b, kind.format("b")), ["grp"], "a", "b", coords, offset=[0.5] * dims, within=within)
    got = {(r["grp"], r["a"], r["b"]) for r in out.collect()}

    def best(p, others, sign):
        near = [(sum((s + sign * 0.5 - t) ** 2 for s, t in zip(p[2:], q[2:])), q[1]) for q in others if q[0] == p[0] and None not in q]
        near = [n for n in near if within is None or n[0] <= within * within]
        return min(near)[1] if near else None

    of_a = {(p[0], p[1]): best(p, b, 1) for p in a}
    of_b = {(p[0], p[1]): best(p, a, -1) for p in b if None not in p}
    assert got == {(g, i, j) for (g, i), j in of_a.items() if j is not None and of_b.get((g, j)) == i}


@pytest.mark.parametrize("group", [["grp"], []])
def test_leaves_equal_all_pairs(spark, monkeypatch, group):
    """Small leaves, copies of places on either side, one far point, groups of one and of many."""
    for name, n in (("LEAF", 16), ("JOINED", 3), ("ASKING", 40)):
        monkeypatch.setattr(neighbours, name, n)
    rng = np.random.default_rng(3)
    a = [("g", i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 9, (400, 2)).round(1))] + [("g", 1000, -1e6, 2e6), ("h", 1001, 0.0, 0.0)] + [("g", 1002 + i, 1.5, 1.5) for i in range(100)]
    b = [("g", i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(2, 9, (500, 2)).round(1))] + [("g", 900, 1e6, 1e6), ("h", 901, 1.0, 1.0), ("k", 902, 0.0, 0.0)] + [("g", 903 + i, 2.5, 0.5) for i in range(200)]
    kind = "grp string, {} long, x double, y double"
    out = joins.nearest(spark.createDataFrame(a, kind.format("a")), spark.createDataFrame(b, kind.format("b")), group, "a", "b", ["x", "y"]).collect()
    want = {p[1]: min(((p[2] - q[2]) * (p[2] - q[2]) + (p[3] - q[3]) * (p[3] - q[3]), q[1]) for q in b if not group or q[0] == p[0]) for p in a}
    assert {r["a"]: (r["distance2"], r["b"]) for r in out} == want


def test_a_far_point_costs_nothing(spark, tmp_path):
    """20,000 points a side in the plane, with and without one point far away on the right side."""
    kind = "f int, {0} long, x double, y double"
    took = []
    for far in (False, True, False, True):
        rng = np.random.default_rng(4)
        sides = []
        for name in "ab":
            points = rng.random((20_000, 2)) * 100
            if far and name == "b":
                points[7] = 1e6
            sides.append(spark.createDataFrame(pd.DataFrame({"f": np.zeros(len(points), np.int32), name: np.arange(len(points)), "x": points[:, 0], "y": points[:, 1]}), kind.format(name)))
        began = time.perf_counter()
        assert joins.nearest(*sides, ["f"], "a", "b", ["x", "y"]).count() == 20_000
        took.append(time.perf_counter() - began)
    print("without and with a far point:", took)
    assert took[3] < 2 * took[2] + 1


def test_balls_touch_the_right_leaves():
    rng = np.random.default_rng(7)
    points = np.concatenate([rng.normal(0, 1, (3000, 3)), np.ones((500, 3)), [[1e7, 0, 0]]])
    tree = neighbours.Tree.over(points, 40)
    leaf = tree.leaf(points)
    assert np.bincount(leaf).max() < 4 * 3000 / 40 + 500
    asked, radius = rng.normal(0, 2, (50, 3)), rng.random(50) * 2
    who, what = tree.reached(asked, radius)
    touched = set(zip(who.tolist(), what.tolist()))
    for i, (p, r) in enumerate(zip(asked, radius)):
        inside = ((points - p) ** 2).sum(1) <= r * r
        assert {(i, int(x)) for x in leaf[inside]} <= touched
    assert len(touched) < 50 * 40 / 2


def test_blocks_are_sent_once(spark, tmp_path):
    """Copies of a block do not grow with the queries, and blocks that nobody asks for stay; near clusters rule far ones out."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 100, (20, 8))
    vectors = (centres[np.arange(4000) % 20] + rng.normal(0, 1, (4000, 8))).tolist()
    path = str(tmp_path / "vectors")
    spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, v array<double>").write.parquet(path)
    rows = spark.read.parquet(path)
    blocks, boxes, pivots = neighbours.blocks_by_pivots(rows, 200, 8)
    sent = {}
    for share in (10, 1):
        asking = blocks.filter(F.col("id") % share == 0)
        found, copies = neighbours.meet_blocks(asking, blocks, 3, "bigint")
        sent[share] = copies.agg(F.sum("copies"), F.max("copies")).first()
        assert found.count() == 3 * asking.count()
    assert len(boxes) >= 20 and sent[1][1] == sent[10][1] == 1 and sent[1][0] == len(boxes)
    assert neighbours.meet_blocks(blocks.filter("b = 0"), blocks, 3, "bigint")[1].count() == 1
    x = np.array(vectors)
    low, high = (np.array([b[i] for b in boxes]) for i in (1, 2))
    d = neighbours._distances(x, pivots)
    gap = np.maximum(low[None] - d[:, None], d[:, None] - high[None]).max(2)
    assert (gap < 10).sum(1).mean() < len(boxes) / 4
    got = {(r["id"], r["rank"]): r["neighbour"] for r in neighbours.nearest_vectors(rows, "id", "v", 3, block=200).collect()}
    for i in range(0, 4000, 97):
        near = np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[1:4]
        assert [got[i, r] for r in (1, 2, 3)] == near.tolist()


@pytest.mark.parametrize("threshold,n_bits", [(0, 12), (2, 12), (5, 30), (6, 30), (3, 62)])
def test_nearest_codes_equal_all_pairs(spark, threshold, n_bits):
    rng = random.Random(threshold)
    book = [(i, rng.getrandbits(n_bits)) for i in range(60)]
    asked = [(i, book[rng.randrange(60)][1] ^ sum(1 << b for b in rng.sample(range(n_bits), rng.randrange(0, 8)))) for i in range(150)]
    out = hamming.nearest_within(spark.createDataFrame(asked, "q long, code long"), spark.createDataFrame(book, "c long, code long"), "q", "code", "c", "code", n_bits, threshold)
    want = {}
    for i, x in asked:
        d, j = min((bin(x ^ y).count("1"), j) for j, y in book)
        if d <= threshold:
            want[i] = (j, d)
    assert {r["q"]: (r["c"], r["distance"]) for r in out.collect()} == want


def test_parts_of_codes_leave_few_chance_pairs():
    assert [hamming.parts_for(30, t, 100_000) for t in (0, 5, 6)][0] == 1
    n = hamming.parts_for(30, 5, 100_000)
    made = sum(math.comb(30 // n, k) for k in range(5 // n + 1))
    assert n * made * 100_000 / 2 ** (30 // n) < 5_000  # of 100,000


@pytest.mark.parametrize("sub", [None, (4, 15)])
def test_off_targets_equal_all_pairs(spark, sub):
    """Targets with copies, near copies and nothing near, at equal starts, and null ones."""
    rng = random.Random(2)
    site = lambda: "".join(rng.choices("ACGT", k=20))
    near = lambda s, n: "".join(rng.choice("ACGT") if i in set(rng.sample(range(20), n)) else c for i, c in enumerate(s))
    targets = [(i, site(), i * 10) for i in range(60)] + [(60, "A" * 20, None)]
    refs = [(site(), rng.choice([rng.randrange(300), -1, None])) for _ in range(200)] + [(near(s, i % 9), rng.choice([at, at, 7])) for i, s, at in targets]
    refs += [(targets[0][1], 0), (targets[1][1], 10), (targets[1][1], 11), ("A" * 20, 5), ("A" * 20, None)]
    t, r = spark.createDataFrame([*targets, (99, None, 1)], "k long, s string, at long"), spark.createDataFrame([*refs, (None, 3)], "r string, rat long").repartition(3)
    out = off_targets.off_target_scan(t, r, "k", "s", "at", "r", "rat", sub=sub, block=16)
    a, b = sub or (0, 20)
    want = {k: max((sum(x == y for x, y in zip(s[a:b], r[a:b])) for r, rat in refs if rat is None or at is None or rat != at), default=0) for k, s, at in targets}
    assert {r["k"]: r["best_match"] for r in out.collect()} == want
    assert off_targets.off_target_scan(t, r.limit(0), "k", "s", "at", "r", "rat").agg(F.sum("best_match")).first()[0] == 0
    assert off_targets.off_target_scan(t.limit(0), r, "k", "s", "at", "r", "rat").count() == 0
    with pytest.raises(ValueError):
        off_targets.off_target_scan(t, spark.createDataFrame([("ACG", 1)], "r string, rat long"), "k", "s", "at", "r", "rat")


def test_off_target_pairs_grow_with_the_targets(spark):
    """Pairs that the index makes: a small share of all, in proportion to targets and to sites."""
    rng = np.random.default_rng(1)
    made = {}
    for n, m in ((200, 4000), (400, 4000), (200, 8000)):
        side = lambda k, name: pd.DataFrame({name: ["".join(x) for x in np.array(list("ACGT"))[rng.integers(0, 4, (k, 20))]]})
        t = spark.createDataFrame(side(n, "s")).selectExpr("s", "1L start").withColumn("w", off_targets.packed(F.col("s"), 20))
        r = spark.createDataFrame(side(m, "r")).selectExpr("r", "2L lo", "2L hi").withColumn("w", off_targets.packed(F.col("r"), 20))
        made[n, m] = off_targets.seed_pairs(t, r, 20, 6, 2).count()
    assert made[200, 4000] < 0.01 * 200 * 4000 and made[400, 4000] < 2.5 * made[200, 4000] and made[200, 8000] < 2.5 * made[200, 4000]


@pytest.mark.parametrize("held", [None, 500])
def test_votes_equal_counting(spark, monkeypatch, held):
    """Groups that are null, hot or hold one base; texts longer than a run of positions; counts handed on early."""
    monkeypatch.setattr(matrices, "SPAN", 16 if held else 1024)
    if held:
        monkeypatch.setattr(matrices, "CHARS", held)
        monkeypatch.setattr(matrices, "MERGED", held)
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i % 2, "".join(rng.choices("ACé𝄞", k=rng.randrange(60)))) for i in range(300)] + [("z", 0, "G"), ("y", 1, ""), ("x", 1, None)]
    rows += [("long", 0, "".join(rng.choices("AC", k=3000))) for _ in range(3)]
    df = spark.createDataFrame(rows, "g string, h int, s string").repartition(3)
    votes, shares = {}, {}
    for key in {r[:2] for r in rows}:
        texts = [s for g, h, s in rows if (g, h) == key and s]
        columns = [[t[i] for t in texts if i < len(t)] for i in range(max(map(len, texts), default=0))]
        if columns:
            votes[key] = "".join(min(set(c), key=lambda x: (-c.count(x), x)) for c in columns)
            second = [sorted((c.count(x) for x in set(c)), reverse=True)[1:2] for c in columns]
            shares[key] = sum(((s or [0])[0] + 0.001) / (len(c) + 0.001) > 0.1 for s, c in zip(second, columns)) / len(columns)
    assert {(r["g"], r["h"]): r["consensus"] for r in groups.column_vote(df, ["g", "h"], "s").collect()} == votes
    got = {(r["g"], r["h"]): r["ambiguous_share"] for r in groups.ambiguous_positions(df, ["g", "h"], "s").collect()}
    assert got.keys() == shares.keys() and all(abs(got[k] - shares[k]) < 1e-12 for k in got)
    parts = matrices.count_matrices(df, ["g", "h"], "s")
    assert parts.count() < (3000 / 16 * 40 if held else 60)
    many = matrices.over_matrices(parts.repartition(300), ["g", "h"], matrices.majority, "text string")
    assert "".join(r["text"] for r in sorted((r for r in many.collect() if (r["g"], r["h"]) == ("long", 0)), key=lambda r: r["block"])) == votes["long", 0]


def test_draws_in_parts_of_a_group(spark):
    """A group of a million values and one of few, drawn in parts: sizes, no value more often than it stands, even chances,
    and the same draws again however the rows come."""
    big = spark.range(1_000_000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).cast("long").alias("n"))
    few = spark.createDataFrame([("b", float(i), i % 3 + 1) for i in range(20)] + [("c", 7.0, 2)], "g string, v double, n long")
    counts = big.unionByName(few)
    out = kernels.draws_by(counts, 30, 200, seed=5, per_part=20_000)
    rows = out.toPandas()
    sizes = rows.groupby(["g", "boot"])["n"].sum()
    assert (sizes["a"] == 200).all() and len(sizes["a"]) == 30 and (sizes["b"] == sum(i % 3 + 1 for i in range(20))).all() and (sizes["c"] == 2).all()
    a = rows[rows.g == "a"]
    assert a.groupby("boot")["v"].nunique().min() == 200 and abs(a["v"].mean() - 500_000) < 12_000 and abs(a["v"].std() - 288_675) < 8_000
    again = kernels.draws_by(counts.repartition(7), 30, 200, seed=5, per_part=20_000).toPandas()
    key = ["g", "boot", "v"]
    assert rows.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    hits = np.zeros(20)
    for seed in range(12):
        d = kernels.draws_by(few, 50, 5, seed=seed, per_part=4).filter("g = 'b'").groupBy("v").agg(F.sum("n").alias("n")).collect()
        for r in d:
            hits[int(r["v"])] += r["n"]
    weight = np.array([i % 3 + 1 for i in range(20)])
    want = hits.sum() * weight / weight.sum()
    assert (np.abs(hits - want) < 5 * np.sqrt(want)).all()


def test_bootstrapped_modes(spark):
    rng = np.random.default_rng(8)
    data = [(g, float(x)) for g, m in (("a", 3.0), ("b", 40.0)) for x in np.concatenate([rng.normal(m, 0.5, 2000), rng.uniform(0, 100, 500)])] + [("c", None)]
    out = {r["g"]: r["mode"] for r in kernels.mode_by(spark.createDataFrame(data, "g string, x double"), "g", "x", boots=20, boot_rows=800, max_rows=300).collect()}
    assert abs(out["a"] - 3) < 1.5 and abs(out["b"] - 40) < 1.5 and out["c"] is None


def test_hot_groups_are_capped_in_parts(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", None]), i, rng.randrange(50), "x") for i in range(600)]
    df = spark.createDataFrame(rows, "g string, i int, q int, c string").repartition(4)
    order = lambda r: (r[2], r[1])
    first = {g: {r[1] for r in sorted((r for r in rows if r[0] == g), key=order)[:7]} for g in ("hot", "a", None)}
    assert {r["i"] for r in sampling.first_per_group(df, ["g"], ["q", "i"], 7).collect()} == set.union(*first.values())
    out = groups.limit_group_content(df, ["g"], ["q", "i"], ["c"], 7).collect()
    assert len(out) == 600 and out[0].asDict().keys() == {"g", "i", "q", "c"}
    assert {r["i"] for r in out if r["c"]} == set.union(*first.values())


def test_medians_of_few_groups(spark):
    rng = np.random.default_rng(2)
    data = [(g, float(x)) for g in "abc" for x in rng.integers(0, 50, 400)] + [("d", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(data, "g string, x double")
    for f in (lambda few: stats.median_by(df, ["g"], "x", few_groups=few), lambda few: stats.mad_bands(df.filter("g is not null"), ["g"], "x", few), lambda few: stats.percentile_profile(df, ["g"], "x", 20.0, few)):
        a, b = ({r[0]: tuple(r) for r in f(few).collect()} for few in (True, False))
        assert f(True).columns == f(False).columns and a.keys() == b.keys()
        assert all((x is None) == (y is None) and (x is None or x == y or abs(x - y) < 1e-9) for k in a for x, y in zip(a[k], b[k]))


def test_yeo_johnson_is_the_likeliest(spark):
    rng = np.random.default_rng(3)
    x = np.expm1(np.abs(rng.normal(1.0, 0.2, 800)))
    lam = kernels.yeo_johnson_lambda(np.sort(x))
    change = lambda v, m: np.log1p(v) if abs(m) < 1e-9 else ((v + 1) ** m - 1) / m
    like = lambda m: -len(x) / 2 * np.log(change(x, m).var()) + (m - 1) * np.log1p(x).sum()
    grid = np.linspace(-3, 5, 1601)
    assert abs(lam - grid[np.argmax([like(m) for m in grid])]) < 0.01 and abs(lam) < 1
    out = kernels.apply_yeo_johnson(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double"), "x", "y").filter("x is not null").collect()
    assert np.allclose([r["y"] for r in out], [change(r["x"], lam) for r in out], atol=1e-6)


def test_bit_thresholds_part_two_classes(spark):
    rng = np.random.default_rng(5)
    data = [(p, float(v)) for p, (lo, hi) in enumerate(((1, 9), (20, 80))) for v in np.concatenate([rng.normal(lo, 0.5, 300), rng.normal(hi, 1.0, 200)])]
    out = {r["p"]: r["threshold"] for r in kernels.bit_thresholds(spark.createDataFrame(data, "p int, v double"), "p", "v").collect()}
    for p, (lo, hi) in enumerate(((1, 9), (20, 80))):
        values = np.array([v for q, v in data if q == p])
        middle = (values[values < (lo + hi) / 2].max() + values[values > (lo + hi) / 2].min()) / 2
        assert abs(out[p] - middle) < (hi - lo) / 100


def test_neighbour_steps_shuffle_objects_once_a_side(spark):
    """Small and large groups by brute force; where all are small, objects go to their group once as each side, with their sizes."""
    rng = random.Random(12)
    rows = [(f, t, k, rng.randrange(40) / 4, rng.randrange(40) / 4, rng.random() + 1) for f, n in ((0, 5), (1, 200), (2, 9)) for t in range(3) for k in range(n)]
    rows += [(0, 1, 77, None, 1.0, 1.0), (0, 1, 78, float("nan"), 1.0, 1.0)]
    df = spark.createDataFrame(rows, "f int, t int, k int, x double, y double, s double")
    want = {}
    for f, t, k, x, y, s in rows[:-2]:
        if t < 2:
            d, n, s2 = min(((x - x2) * (x - x2) + (y - y2) * (y - y2), k2, s2) for f2, t2, k2, x2, y2, s2 in rows[:-2] if (f2, t2) == (f, t + 1))
            want[f, t, k] = (n, round(d**0.5 / s**0.5, 9), round((s2 - s) / s, 9))
    got = {(r["f"], r["t"], r["k"]): (r["neighbour"], round(r["distance"], 9), round(r["size_change"], 9)) for r in traces.neighbour_steps(df, ["f"], "t", "k", "x", "y", "s").collect()}
    assert got == want
    plan = traces.neighbour_steps(df.filter("f <> 1"), ["f"], "t", "k", "x", "y", "s")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange", plan)) <= 3, plan


def test_bit_vectors_run_over_the_longer_text():
    """A text of 40,000 characters and an item of 300: one column a character of the item, not of the text."""
    rng = random.Random(13)
    text, item = ("".join(rng.choices("abcdefgh ", k=k)) for k in (40_000, 300))
    began = time.perf_counter()
    assert distances.bit_distance(text, item) == distances.bit_distance(item, text) == 40_000 - 300
    columns = 0

    class Counted(str):
        def __iter__(self):
            nonlocal columns
            for c in str(self):
                columns += 1
                yield c

        def __getitem__(self, at):
            return Counted(str(self)[at])

    distances.bit_distance(Counted(text), Counted(item))
    print("seconds:", time.perf_counter() - began)
    assert columns <= 2 * len(item)


def test_long_strings_are_compared_by_blocks(spark):
    """Exact at any length, N and wide characters included; strings that differ in few places cost few characters."""
    rng = random.Random(14)
    rows = []
    for n in (0, 1, 63, 64, 65, 128, 700):
        a = [*rng.choices("ACGTNé𝄞\n", k=n)]
        b = [rng.choice("ACGTNé𝄞\n") if rng.random() < 0.1 else c for c in a]
        rows.append(("".join(a), "".join(b), sum(x != y and "N" not in (x, y) for x, y in zip(a, b))))
    df = spark.createDataFrame([*rows, (None, "A", None)], "a string, b string, want int")
    assert all(r["d"] == r["want"] for r in df.select("want", sequences.hamming(F.col("a"), F.col("b")).alias("d")).collect())
    long = spark.createDataFrame([("ACGT" * 100_000, "TCGT" + "ACGT" * 99_999)] * 8, "a string, b string").coalesce(1).cache()
    by_char = F.aggregate(F.zip_with(sequences.chars(F.col("a")), sequences.chars(F.col("b")), lambda x, y: F.when((x == y) | (x == "N") | (y == "N"), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    took = []
    for c in (by_char, sequences.hamming(F.col("a"), F.col("b"))) * 2:
        began = time.perf_counter()
        assert [r[0] for r in long.select(c).collect()] == [1] * 8
        took.append(time.perf_counter() - began)
    long.unpersist()
    print("by character, by block:", took)
    assert 2 * took[3] < took[2]


def test_operations_of_a_batch_are_those_decoded(spark):
    texts = ["3=1X2I", "", None, "=3=", "12", "5Q6=", "é4D7", "0=00000000000012X", "2147483647=", "3==X 4N", "M1", "10M9S8H7P6B"]
    rng = random.Random(4)
    texts += ["".join(rng.choices("0123456789=XIDMNSHPBé Q", k=rng.randrange(30))) for _ in range(300)]
    texts = [t for t in texts if t is None or not re.search(r"[1-9]\d{9}", t) or t == "2147483647="]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, cg string").select("i", cigar.decode(F.col("cg")).alias("ops"))
    want = [(r["i"], ord(o["op"]), o["len"]) for r in df.collect() for o in r["ops"] or []]
    for part in (pa.array(texts), pa.array(["7=", *texts], pa.large_string()).slice(1)):
        assert sorted(zip(*(x.tolist() for x in cigar._operations(part)))) == sorted(want)
    assert [len(x) for x in cigar._operations(pa.array([], pa.string()))] == [0, 0, 0]
    with pytest.raises(ValueError, match="32 bits"):
        cigar._operations(pa.array(["2147483648="]))


def test_structs_of_segments_parse_cigars_once_a_batch(spark):
    """CIGARs are not decoded by functions of single rows, and columns that are not kept do not pass through Python."""
    df = spark.createDataFrame([("r", [">a=1", "<b"], 0, 9, 9, 1, 10, 12, "4=1X4=", "x"), ("n", [">b"], 0, 5, 5, 0, 5, 5, None, "x")], ALN + ", more string").repartition(1)
    table = spark.createDataFrame([("a=1", 4), ("b", 5)], "name string, length int")
    out = cigar.segment_structs(df, table, ["a", "b", "downstream", "c"], keep=["name"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and "lambda" not in plan and "more" not in plan.split("MapInArrow")[1].split("\n")[0]
    r, n = out.orderBy(F.desc("name")).collect()
    assert tuple(r) == ("r", ("a", 1, False, 4, 0, 0, 0, 1, 5), ("b", None, True, 4, 1, 0, 0, 5, 10), ("downstream", None, None, 0, 0, 2, 0, 10, 12), None)
    assert tuple(n) == ("n", None, None, None, None)


def test_closest_in_cells_meets_few_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    pairs, plain = [], neighbours._closest_of_all
    monkeypatch.setattr(neighbours, "_closest_of_all", lambda q, c: pairs.append(len(q) * len(c)) or plain(q, c))
    for n, digits, dims in ((2_048, 9, 2), (2_048, 1, 2), (700, 1, 3), (600, 0, 2), (40, 1, 2), (1_500, 0, 1), (600, 9, 2)):
        q, c = (np.round(rng.normal(size=(m, dims)) * [9.0, 2.0, 5.0][:dims], digits) for m in (1_000, n))
        d2 = sum((q[:, k, None] - c[:, k]) ** 2 for k in range(dims))
        pairs.clear()
        best, d = neighbours._closest(q, c)
        assert (best == d2.argmin(1)).all() and (d == d2.min(1)).all()
        if n == 2_048:
            assert sum(pairs) < 1_000 * n / 4
    q[0], c[5] = np.inf, -np.inf
    assert neighbours._closest(q, c)[0][1:].tolist() == plain(q, c)[0][1:].tolist()


def test_nearest_points_find_touched_leaves_once(spark, monkeypatch):
    """Points on leaves' borders, leaves of a stretched sample, groups without a point: as by all pairs; what is found in
    a point's own leaf is not joined back to it."""
    monkeypatch.setattr(neighbours, "LEAF", 32)
    tables, write = [], neighbours.written
    monkeypatch.setattr(neighbours, "written", lambda df, name="table": tables.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    rng = random.Random(5)
    at = lambda: (rng.randrange(2), float(rng.randrange(40)), round(rng.expovariate(0.1), 1))
    a, b = ([(i, *at()) for i in range(n)] for n in (600, 900))
    a.append((9_999, 7, 0.0, 0.0))
    for within in (None, 1.0):
        l, r = (spark.createDataFrame(t, f"{k} int, g int, x double, y double") for t, k in ((a, "i"), (b, "j")))
        got = {p["i"]: (p["j"], p["distance2"]) for p in neighbours.nearest_points(l, r, ["g"], "i", "j", ["x", "y"], within).collect()}
        want = {}
        for i, g, x, y in a:
            d, j = min((((x - u) * (x - u) + (y - v) * (y - v), j) for j, h, u, v in b if h == g), default=(math.inf, None))
            if j is not None and (within is None or d <= within):
                want[i] = (j, d)
        assert got == want
    plans = dict(tables)
    assert "Join" not in plans["own"].split("FlatMapCoGroups")[0] and "ArrowEvalPython" not in plans["sent"] and "Join" not in plans["sent"]
