"""Formats read back as written; streams equal to batches."""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from tidewell.sources import formats, sinks, text_formats
from tidewell.streaming import measurements


def test_gaf_tags_found_on_the_first_line(spark, tmp_path):
    (tmp_path / "a.gaf").write_text("r1 qs:f:9.5\t40\t0\t40\t+\t>s0=1<s1=0\t40\t0\t40\t38\t40\t60\tNM:i:2\tcg:Z:20=1X19=\tml:B:C,1,200\nr2\t4\t0\t4\t-\t*\t0\t0\t0\t0\t0\t0\n")
    out = {r["name"]: r.asDict() for r in text_formats.read_gaf(spark, str(tmp_path / "a.gaf")).collect()}
    assert out["r1"]["path"] == [">s0=1", "<s1=0"] and out["r1"]["NM"] == 2 and out["r1"]["ml"] == [1, 200] and out["r1"]["qs"] == 9.5
    assert out["r2"]["path"] is None and out["r2"]["cg"] is None
    assert out["r1"]["aln_rank"] < out["r2"]["aln_rank"]


def test_fastq_is_checked(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("@a b\nACGT\n+\nIIII\n@c\nA\n+\n!\n")
    out = text_formats.read_fastq(spark, str(tmp_path / "x.fastq")).withColumn("q", text_formats.phred(F.col("qual"))).orderBy("id").collect()
    assert [(r["id"], r["seq"], r["q"]) for r in out] == [("a", "ACGT", [40] * 4), ("c", "A", [0])]
    (tmp_path / "bad.fastq").write_text("@a\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="four-line"):
        text_formats.read_fastq(spark, str(tmp_path / "bad.fastq")).collect()


def test_one_way_of_chunking(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_chunked(spark.range(3), str(tmp_path / "x"), rows=1, files=2)


def test_partitions_written_twice_stay(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 1.0), (2, 0, 2.0)], "fov_num int, t int, value double")
    for _ in range(2):
        sinks.replace_partitions(df, str(tmp_path / "p"), ["fov_num", "t"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_stream_shifts_to_the_first_frame(spark, tmp_path):
    rows = [("image", 1, 5, 10.0), ("image", 1, 6, 12.0), ("image", 2, 1, 3.0), ("image", 1, 4, 9.0)]
    spark.createDataFrame(rows, "type string, fov_num int, t int, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("type string, fov_num int, t int, value double").parquet(str(tmp_path / "in"))
    run = measurements.shift_to_first_frame(stream).writeStream.format("memory").queryName("shifted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    out = {(r["fov_num"], r["t"]): (r["shifted"], r["last_t"]) for r in spark.sql("select * from shifted").collect()}
    assert out == {(1, 4): (0.0, 4), (1, 5): (1.0, 5), (1, 6): (3.0, 6), (2, 1): (0.0, 1)}


def test_stream_shifts_of_a_field_in_several_batches(spark, tmp_path):
    kind = "type string, fov_num int, t int, value double"
    rows = [("done" if t == 20 else "image", 1, t, float(t * t)) for t in range(40, 0, -1)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        run = measurements.shift_to_first_frame(stream).writeStream.format("memory").queryName("shifted_batches").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = {r["t"]: (r["shifted"], r["last_t"]) for r in spark.sql("select * from shifted_batches").collect()}
    assert out == {t: (float(t * t - (1 if t < 20 else 21 * 21)), t) for t in range(1, 41) if t != 20}


def test_routes_and_dead_letters(spark, tmp_path):
    spark.createDataFrame([("image", 1), ("done", 2), ("odd", 3), (None, 4)], "type string, x int").write.parquet(str(tmp_path / "in"))
    stream, seen = spark.readStream.schema("type string, x int").parquet(str(tmp_path / "in")), {}
    keep = lambda k: lambda df, _: seen.setdefault(k, []).extend(r["x"] for r in df.collect())
    measurements.route(stream, {"image": keep("image"), "done": keep("done")}, keep("dead"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert {k: sorted(v) for k, v in seen.items()} == {"image": [1], "done": [2], "dead": [3, 4]}


def test_interval_stats_batch(spark):
    t = dt.datetime(2024, 1, 1, 0, 9, 59)
    df = spark.createDataFrame([(1, 60.0, t), (1, 40.0, t + dt.timedelta(seconds=1))], "fov_num int, value double, event_time timestamp")
    assert [(r["n"], r["n_over"]) for r in measurements.interval_stats(df).orderBy("interval_start").collect()] == [(1, 1), (1, 0)]


def frames(spark, where, *runs, idle_s=3600):
    """Runs the stream once for each list of rows: a restart between them, state in one place."""
    schema = "type string, f int, t int, value double, event_time timestamp, n int"
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
        stream = spark.readStream.schema(schema).parquet(f"{where}/in")
        out = measurements.frame_states(stream, "f", keep=["n"], order=["event_time", "n"], idle_s=idle_s, late="10 seconds")
        with measurements.rocksdb_state(spark):
            out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
    return {r["n"]: (r["t"], r["shifted"], r["newest_t"], r["held"]) for r in spark.read.parquet(f"{where}/out").collect()}


def test_newer_frames_drop_older_ones(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    got = frames(
        spark, tmp_path,
        [("image", 1, 0, 5.0, at(0), 1), ("image", 1, 0, 7.0, at(1), 2), ("image", 2, 3, 1.0, at(1), 3)],
        [("image", 1, 0, 8.0, at(2), 4), ("image", 1, 1, 9.0, at(3), 5), ("image", 2, 2, 9.0, at(3), 6)],
        [("image", 1, 0, 6.0, at(4), 7), ("image", 1, 1, 6.0, at(5), 8), ("done", 1, 9, 0.0, at(6), 9), ("image", 1, 0, 4.0, at(7), 10), ("image", 2, 4, 3.0, at(7), 11)],
    )
    assert got == {
        1: (0, 0.0, 0, 1), 2: (0, 2.0, 0, 2), 3: (3, 0.0, 3, 1), 4: (0, 3.0, 0, 3), 5: (1, 4.0, 1, 1),  # 6 is before its field's first frame
        7: (0, 1.0, 1, 0), 8: (1, 1.0, 1, 2), 10: (0, 0.0, 0, 1), 11: (4, 2.0, 4, 1),
    }


def test_silent_fields_lose_their_state(spark, tmp_path):
    """By the next row's time, and by a timer once the watermark has passed."""
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    got = frames(
        spark, tmp_path,
        [("image", 1, 0, 5.0, at(0), 1), ("image", 2, 0, 5.0, at(0), 2)],
        [("image", 1, 1, 6.0, at(3000), 3)],
        [("image", 1, 2, 7.0, at(9000), 4)],  # silent for longer than an hour
        [("image", 1, 3, 9.0, at(9100), 5)],
    )
    assert got == {1: (0, 0.0, 0, 1), 2: (0, 0.0, 0, 1), 3: (1, 1.0, 1, 1), 4: (2, 0.0, 2, 1), 5: (3, 2.0, 3, 1)}
    state = spark.read.format("statestore").option("stateVarName", "newest").load(f"{tmp_path}/state")
    assert [r["key"]["f"] for r in state.collect()] == [1]  # field 2 never came again


def test_formats_of_the_reader(spark, tmp_path):
    """Ranges of any size give each line once; the schema is the first line's or what is asked; filters are pushed down."""
    formats.register(spark)
    lines = [f"r{i} qs:f:{i}.5\t{i}\t0\t40\t+\t{'*' if i % 7 == 0 else f'>s{i}<t=1'}\t40\t0\t40\t38\t40\t{i % 60}\tNM:i:{i % 5}\tml:B:C,1,{i}" for i in range(500)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gaf").write_text("\n".join(lines[:300]) + "\n\n")
    (tmp_path / "in" / "b.gaf").write_text("\n".join(lines[300:]))
    (tmp_path / "in" / "_SUCCESS").write_text("x")
    for size in (50, 977, 1 << 20):
        rows = spark.read.format("gaf").option("splitBytes", size).load(str(tmp_path / "in"))
        out = {r["name"]: r for r in rows.collect()}
        assert rows.count() == len(out) == 500
        r = out["r8"]
        assert (r["query_length"], r["path"], r["NM"], r["qs"], r["ml"]) == (8, [">s8", "<t=1"], 3, 8.5, [1, 8]) and out["r7"]["path"] is None
    some = spark.read.format("gaf").schema("name string, NM int").load(str(tmp_path / "in"))
    assert some.columns == ["name", "NM"] and some.filter("NM = 4").count() == 100
    near = rows.filter("mapping_quality >= 50 and NM in (1, 2) and name like 'r1%' and qs > 3")
    assert near.count() == sum(i % 60 >= 50 and i % 5 in (1, 2) and str(i)[0] == "1" and i + 0.5 > 3 for i in range(500))
    left = re.findall(r"Filter \((.*)\)", near._jdf.queryExecution().executedPlan().toString())
    assert left and "qs" in left[0] and not re.search("mapping_quality|NM|name", left[0])  # the others went to the lines
    reader = formats.GafReader({"path": str(tmp_path / "in"), "splitBytes": "400"}, rows.schema)
    assert list(reader.pushFilters([EqualTo(("NM",), 1), EqualTo(("qs",), 1.5)])) == [EqualTo(("qs",), 1.5)]
    made = [b.num_rows for part in reader.partitions() for b in reader.read(part)]
    assert sum(made) == 100 and len(reader.partitions()) > 20


def test_fastq_format(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "x.fastq").write_text("".join(f"@q{i} b\n{'ACGT' * (i % 9 + 1)}\n+\n{'@+I!' * (i % 9 + 1)}\n" for i in range(200)))
    for size in (64, 1 << 20):
        rows = spark.read.format("fastq").option("splitBytes", size).load(str(tmp_path / "x.fastq"))
        assert {r["id"]: len(r["qual"]) for r in rows.collect()} == {f"q{i}": 4 * (i % 9 + 1) for i in range(200)}
    assert rows.filter("id = 'q17'").select("seq").first()[0] == "ACGT" * 9


def test_key_ranges_open_few_files(spark, tmp_path):
    df = spark.createDataFrame([(i % 37, i, str(i)) for i in range(2000)], "a int, b int, s string").repartition(5)
    sinks.write_key_ranges(df, str(tmp_path / "t"), ["a", "b"], 12)
    for lo, hi, most in (((5,), (8,), 4), ((5, 100), (5, 900), 2), ((36, 1999), (99,), 1), ((50,), (60,), 12)):
        got = sinks.read_key_range(spark, str(tmp_path / "t"), lo, hi)
        want = {(i % 37, i) for i in range(2000) if (i % 37, i)[: len(lo)] >= lo and (i % 37, i)[: len(hi)] <= hi}
        assert {(r["a"], r["b"]) for r in got.collect()} == want
        assert len(got.inputFiles()) <= most and (len(want) > 0 or hi == (60,) or lo == (36, 1999))
    index = spark.read.parquet(str(tmp_path / "t" / sinks.KEY_INDEX)).collect()
    assert sum(r["rows"] for r in index) == 2000 == spark.read.parquet(str(tmp_path / "t")).count()


def test_small_ranges_grow_with_the_input(spark, tmp_path):
    """Ranges as small as asked are kept while they are few; every record comes once whatever their size."""
    formats.register(spark)
    (tmp_path / "x.fastq").write_text("".join(f"@q{i} b\n{'ACGT' * (i % 9 + 1)}\n+\n{'@+I!' * (i % 9 + 1)}\n" for i in range(3000)))
    rows = text_formats.read_fastq(spark, str(tmp_path / "x.fastq"), split_bytes=64)
    assert {r["id"]: len(r["qual"]) for r in rows.collect()} == {f"q{i}": 4 * (i % 9 + 1) for i in range(3000)}
    read = spark.read.format("fastq").option("splitBytes", 64).load(str(tmp_path / "x.fastq"))
    assert read.count() == 3000 and max(rows.rdd.getNumPartitions(), read.rdd.getNumPartitions()) <= 257
    assert [text_formats.range_bytes(*x) for x in ((100, 2_000), (100, 256_000), (200_000, 1 << 40), (1 << 30, 1 << 40))] == [100, 1000, 32 << 20, 1 << 30]


@pytest.mark.parametrize("wide", [False, True])
def test_a_task_writes_many_files_by_bytes(spark, tmp_path, wide):
    """Even rows, and rows of which some are larger than a file may be."""
    df = spark.range(4000).withColumn("s", F.repeat(F.lit("x"), (F.col("id") % 17 + F.when((F.col("id") % 500 == 0) & F.lit(wide), 3000).otherwise(0)).cast("int")))
    sinks.write_chunked(df, str(tmp_path / "t"), max_bytes=2_000)
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(r["id"] for r in rows.select("id").collect()) == list(range(4000))
    size = F.octet_length(F.to_json(F.struct("id", "s"))) + 1
    per = rows.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()
    assert all(r["bytes"] <= 2_000 or r["n"] == 1 for r in per)
    least = df.agg(F.sum(size)).first()[0] / 2_000
    assert len(per) <= 3 * least and len({r["f"][: len("part-00000-")] for r in per}) <= len(per) / 4


def test_few_calls_on_state():
    """A field's batch reads its state once, writes it once and leaves its timer, which is set anew when it runs out."""
    calls, timers = [], []

    class Value:
        held = None

        def __getattr__(self, name):
            raise AssertionError(name)

        def get(self):
            calls.append("get")
            return self.held

        def update(self, x):
            calls.append("update")
            self.held = x

        def clear(self):
            calls.append("clear")
            self.held = None

    class Handle:
        def getValueState(self, name, kind):
            return Value()

        def registerTimer(self, at):
            calls.append("register")
            timers.append(at)

        def listTimers(self):
            calls.append("list")
            return iter(list(timers))

        def deleteTimer(self, at):
            timers.remove(at)

    class Times:
        def __init__(self, watermark):
            self.getCurrentWatermarkInMs = lambda: watermark

    state = measurements.FrameStates("f", "type", "t", "value", "event_time", ["n"], ["event_time", "n"], 3_600_000)
    state.init(Handle())
    at = lambda s: pd.Timestamp("1970-01-01") + pd.Timedelta(seconds=s)
    batch = lambda *rows: iter([pd.DataFrame(rows, columns=["type", "f", "t", "value", "event_time", "n"])])
    one = next(state.handleInputRows((1,), batch(("image", 1, 0, 5.0, at(0), 1), ("image", 1, 0, 7.0, at(1), 2)), None))
    assert one.values.tolist() == [[1, 1, 0, 0.0, 0, 1], [1, 2, 0, 2.0, 0, 2]] and calls == ["get", "update", "register"] and timers == [3_601_001]
    calls.clear()
    two = next(state.handleInputRows((1,), batch(("image", 1, 1, 9.0, at(100), 3)), None))
    assert two.values.tolist() == [[1, 3, 1, 4.0, 1, 1]] and calls == ["get", "update"]
    timers.clear()
    list(state.handleExpiredTimer((1,), Times(3_650_000), None))
    assert timers == [3_700_001] and state.newest.held is not None
    timers.clear()
    list(state.handleExpiredTimer((1,), Times(3_700_001), None))
    assert not timers and state.newest.held is None
