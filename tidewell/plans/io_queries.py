"""Queries that write tables in a format and read them back, and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import formats, sinks, text_formats
from ..streaming import measurements
from ..session import scratch, sized_broadcast, table
from .registry import query


@query(
    "gaf_source",
    """
    SELECT 'r' || event_id AS name, user_id AS query_length, '>' || event_type || '<s' || user_id AS path, CAST(floor(value) AS INTEGER) AS "NM", event_type || '=' AS cg FROM events
    """,
)
def gaf_source(spark, sf_dir):
    """SRC1: events as alignments with tags."""
    where, num = scratch(spark, "gaf"), lambda c: F.col(c).cast("string")
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit(">"), "event_type", F.lit("<s"), num("user_id"))
    fields = [F.concat(F.lit("r"), num("event_id")), num("user_id"), F.lit("0"), F.lit("9"), F.lit("+"), path, *[F.lit("9")] * 5, F.lit("60"), F.concat(F.lit("NM:i:"), F.floor("value").cast("string")), F.concat(F.lit("cg:Z:"), F.col("event_type"), F.lit("="))]
    e.select(F.concat_ws("\t", *fields).alias("value")).write.text(where)
    back = text_formats.read_gaf(spark, where, tags=[("NM", "i", None), ("cg", "Z", None)])
    return back.select("name", "query_length", F.array_join("path", "").alias("path"), "NM", "cg")


@query("fasta_source", "SELECT 'd' || doc_id AS id, regexp_replace(text, '[^a-zA-Z]', 'N', 'g') AS seq FROM documents")
def fasta_source(spark, sf_dir):
    """SRC2, SNK2: documents as FASTA."""
    where = scratch(spark, "fasta")
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(" about")).alias("name"), F.regexp_replace("text", "[^a-zA-Z]", "N").alias("seq"))
    sinks.write_fastx(d, where)
    return text_formats.read_fasta(spark, where)


@query("fastq_source", "SELECT 'd' || doc_id AS id, regexp_replace(text, '[^a-zA-Z]', 'N', 'g') AS seq, repeat(chr(CAST(33 + doc_id % 40 AS INTEGER)), length(regexp_replace(text, '[^a-zA-Z]', 'N', 'g'))) AS qual FROM documents")
def fastq_source(spark, sf_dir):
    """SRC2, SNK2: documents as FASTQ."""
    where = scratch(spark, "fastq")
    seq = F.regexp_replace("text", "[^a-zA-Z]", "N")
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), seq.alias("seq"), F.array_repeat((F.col("doc_id") % 40).cast("int"), F.length(seq)).alias("q"))
    sinks.write_fastx(d, where, scores="q")
    return text_formats.read_fastq(spark, where, split_bytes=200_000)


@query("sam_source", "SELECT 'r' || event_id AS name, CAST(user_id AS INTEGER) AS pos, CAST(floor(value) AS INTEGER) || 'M' AS cigar FROM events")
def sam_source(spark, sf_dir):
    """SRC3: events as SAM lines under headers."""
    where = scratch(spark, "sam")
    e = table(spark, sf_dir, "events")
    line = F.concat_ws("\t", F.concat(F.lit("r"), F.col("event_id").cast("string")), F.lit("0"), F.lit("ref"), F.col("user_id").cast("string"), F.lit("60"), F.concat(F.floor("value").cast("string"), F.lit("M")))
    head = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("@CO\tabove\n"), line)).otherwise(line)
    e.select(head.alias("value")).write.text(where)
    return text_formats.read_sam(spark, where)


@query(
    "graph_source",
    """
    SELECT 'S' AS kind, 's' || l_linenumber AS a, repeat('ACGT', l_linenumber) AS b, NULL AS ao, NULL AS bo, 1 AS n FROM (SELECT DISTINCT l_linenumber FROM lineitem)
    UNION ALL SELECT 'L', 's' || l_linenumber, 'p' || l_partkey, '+', CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END, count(*) FROM lineitem GROUP BY ALL
    """,
)
def graph_source(spark, sf_dir):
    """SRC4: lines as links of a graph; every segment with its sequence, every link with its ends."""
    where = scratch(spark, "gfa")
    line = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("s"), F.col("l_linenumber").cast("string"))
    seg = F.concat_ws("\t", F.lit("S"), name, F.repeat(F.lit("ACGT"), F.col("l_linenumber")))
    link = F.concat_ws("\t", F.lit("L"), name, F.lit("+"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.when(F.col("l_returnflag") == "R", "-").otherwise("+"), F.lit("0M"))
    line.select(seg.alias("value")).distinct().unionByName(line.select(link.alias("value"))).write.text(where)
    segments, links = text_formats.read_gfa(spark, where)
    no = F.lit(None).cast("string")
    found = segments.select(F.lit("S").alias("kind"), F.col("name").alias("a"), F.col("seq").alias("b"), no.alias("ao"), no.alias("bo"))
    found = found.unionByName(links.select(F.lit("L").alias("kind"), F.col("from_name").alias("a"), F.col("to_name").alias("b"), F.col("from_orient").alias("ao"), F.col("to_orient").alias("bo")))
    return found.groupBy("kind", "a", "b", "ao", "bo").agg(F.count(F.lit(1)).alias("n"))


_LINKS = """links AS (SELECT DISTINCT o_custkey AS f, o_custkey - o_custkey % 40 + (o_custkey % 40 * 7 + 1) % 40 AS t, CASE WHEN o_custkey % 4 = 1 THEN '-' ELSE '+' END AS bo FROM orders),
    fwd AS (SELECT '>' || f AS a, CASE bo WHEN '+' THEN '>' ELSE '<' END || t AS b FROM links UNION SELECT '<' || f, CASE bo WHEN '+' THEN '<' ELSE '>' END || t FROM links)"""


def _links(spark, sf_dir):
    """All customers with orders as segments, each linked to another one of its forty, some in reverse."""
    c = F.col("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    return o.select(c.cast("string").alias("from_name"), F.lit("+").alias("from_orient"), (c - c % 40 + (c % 40 * 7 + 1) % 40).cast("string").alias("to_name"), F.when(c % 4 == 1, "-").otherwise("+").alias("to_orient"))


@query(
    "graph_endpoints",
    f"""
    WITH {_LINKS}, e AS (SELECT a AS segment, 1 AS o, 0 AS i FROM fwd UNION ALL SELECT b, 0, 1 FROM fwd)
    SELECT segment, CASE WHEN max(o) = 1 THEN 'first' ELSE 'last' END AS "end" FROM e GROUP BY 1 HAVING max(o) + max(i) = 1
    """,
)
def graph_endpoints(spark, sf_dir):
    """SRC4 for PRJ2: oriented segments at which paths can begin and end."""
    return text_formats.graph_endpoints(_links(spark, sf_dir))


@query(
    "forward_segments",
    f"""
    WITH RECURSIVE {_LINKS}, u AS (SELECT a, b FROM fwd UNION SELECT b, a FROM fwd), w(s, r) AS (SELECT a, a FROM u UNION SELECT w.s, u.b FROM w JOIN u ON u.a = w.r),
    part AS (SELECT s AS segment, min(r) AS part FROM w GROUP BY 1), best AS (SELECT part FROM part GROUP BY 1 ORDER BY count(*) FILTER (segment[1] = '>') DESC, part LIMIT 1)
    SELECT segment FROM part JOIN best USING (part)
    """,
)
def forward_segments(spark, sf_dir):
    """SRC4 for PRJ1: the oriented segments of the part with the most forward ones."""
    return text_formats.forward_segments(_links(spark, sf_dir))


@query("widened_parquet", "SELECT c_custkey AS k, c_acctbal AS bal, NULL AS name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def widened_parquet(spark, sf_dir):
    """SRC5, SNK1: files of differing schemas read as one table."""
    a, b = scratch(spark, "wide-a"), scratch(spark, "wide-b")
    sinks.write_parquet(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), a)
    sinks.write_parquet(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")), b)
    return text_formats.read_parquet_widened(spark, a, b).select("k", "bal", "name")


@query("tsv_source", "SELECT n_nationkey AS key, n_name AS name, CAST(n_regionkey AS VARCHAR) AS subsample FROM nation")
def tsv_source(spark, sf_dir):
    """SRC6: tables in files by region, the region drawn from the file's path."""
    where = scratch(spark, "tsv")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("part"))
    n.write.partitionBy("part").option("sep", "\t").option("header", True).csv(where)
    return text_formats.read_tables(spark, f"{where}/part=*", "part=s(\\d+)", "subsample", "key int, name string")


@query("file_names", "SELECT DISTINCT CAST(user_id % 40 AS INTEGER) AS fov, CAST(event_id % 3 AS INTEGER) AS t FROM events")
def file_names(spark, sf_dir):
    """SRC7: numbers parsed out of the names of the files that events were written to, fields counted from 0."""
    where = scratch(spark, "frames")
    e = table(spark, sf_dir, "events").select("event_id", F.format_string("xy%03d", F.col("user_id") % 40 + 1).alias("fov"), F.format_string("t%d", F.col("event_id") % 3).alias("t"))
    e.repartition("fov", "t").write.partitionBy("fov", "t").json(where)  # a folder's rows by one task
    files = text_formats.file_metadata(spark, where, "fov=xy(\\d+)/t=t(\\d+)/", ["fov", "t"], one_based=["fov"], first_by=["fov", "t"])
    return files.select("fov", "t")


@query("pair_list", "SELECT o_custkey AS a, o_orderkey AS b FROM orders")
def pair_list(spark, sf_dir):
    """SNK3: pairs of keys, space separated."""
    where = scratch(spark, "pairs")
    sinks.write_pairs(table(spark, sf_dir, "orders"), where, "o_custkey", "o_orderkey")
    return spark.read.schema("a long, b long").option("sep", " ").csv(where)


@query("split_by_hash", "SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, CAST(1 AS BIGINT) AS n_chunks FROM orders GROUP BY 1")
def split_by_hash(spark, sf_dir):
    """SNK4: rows by hash bucket of their key; every key stands whole in one bucket."""
    where = scratch(spark, "split")
    sinks.write_split(table(spark, sf_dir, "orders"), where, ["o_custkey"], 16)
    return spark.read.parquet(where).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"), F.countDistinct("chunk").alias("n_chunks"))


@query(
    "chunked_rows",
    "SELECT o_orderkey, true AS rows_fit, true AS bytes_fit, true AS files_fit FROM orders",
)
def chunked_rows(spark, sf_dir):
    """SNK5: every row once in files of at most a thousand rows, of at most 50,000 bytes, and in seven files."""
    o = table(spark, sf_dir, "orders")
    out = o.select("o_orderkey")
    for kind, how in (("rows", {"rows": 1000}), ("bytes", {"max_bytes": 50_000}), ("files", {"files": 7})):
        where = scratch(spark, "chunks")
        sinks.write_chunked(o, where, **how)
        rows = spark.read.parquet(where).select("o_orderkey", F.xxhash64("_metadata.file_name").alias("f"), F.col("_metadata.file_size").alias("b"))
        if kind == "bytes":
            rows = rows.withColumn("fit", F.col("b") <= 50_000)
        else:
            per = rows.groupBy("f").agg(F.count(F.lit(1)).alias("k"))
            fits = F.col("k") <= 1000 if kind == "rows" else F.lit(per.count() == 7)
            rows = rows.join(sized_broadcast(per.select("f", fits.alias("fit"))), "f")
        out = out.join(rows.select("o_orderkey", F.col("fit").alias(f"{kind}_fit")), "o_orderkey", "full")
    return out


@query("replaced_partitions", "SELECT o_orderstatus, sum(CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END)::BIGINT AS n FROM orders GROUP BY 1")
def replaced_partitions(spark, sf_dir):
    """SNK6: one partition written anew, the others untouched."""
    where, o = scratch(spark, "replaced"), table(spark, sf_dir, "orders")
    sinks.replace_partitions(o.select("o_orderkey", F.lit(1).alias("w"), "o_orderstatus"), where, ["o_orderstatus"])
    sinks.replace_partitions(o.filter("o_orderstatus = 'F'").select("o_orderkey", F.lit(2).alias("w"), "o_orderstatus"), where, ["o_orderstatus"])
    return spark.read.parquet(where).groupBy("o_orderstatus").agg(F.sum("w").alias("n"))


@query("key_ranges", "SELECT o_orderkey, o_custkey, CAST(1 AS BIGINT) AS n_files FROM orders")
def key_ranges(spark, sf_dir):
    """SNK7: files that hold disjoint ranges of the key: of each row, the files whose range its key lies in."""
    where = scratch(spark, "ranges")
    sinks.write_key_ranges(table(spark, sf_dir, "orders"), where, ["o_orderkey"], 8)
    rows = spark.read.parquet(where)
    per = rows.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    held = per.agg(F.collect_list(F.struct("lo", "hi")).alias("files"))  # eight files
    inside = F.size(F.filter("files", lambda x: (x["lo"] <= F.col("o_orderkey")) & (F.col("o_orderkey") <= x["hi"])))
    return rows.join(F.broadcast(held)).select("o_orderkey", "o_custkey", inside.cast("long").alias("n_files"))


@query("key_range_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE (o_custkey, o_orderkey) BETWEEN (SELECT (max(o_custkey) // 3, 0) FROM orders) AND (SELECT (max(o_custkey) // 2, 0) FROM orders)")
def key_range_scan(spark, sf_dir):
    """SNK7: orders written in ranges of customer and order, and a range of them read by the file index."""
    where, orders = scratch(spark, "ranges"), table(spark, sf_dir, "orders")
    sinks.write_key_ranges(orders, where, ["o_custkey", "o_orderkey"], 16)
    last = orders.agg(F.max("o_custkey")).first()[0]
    return sinks.read_key_range(spark, where, (last // 3, 0), (last // 2, 0)).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "gaf_format",
    """
    SELECT 'r' || event_id AS name, user_id AS query_length, '>' || event_type || '<s' || user_id AS path, CAST(floor(value) AS INTEGER) AS "NM" FROM events WHERE user_id >= 10 AND floor(value) < 60 AND event_type || '=' LIKE 'c%'
    """,
)
def gaf_format(spark, sf_dir):
    """SRC1: alignments by way of the reader's format, with filters pushed down to the lines."""
    formats.register(spark)
    where, num = scratch(spark, "gaf"), lambda c: F.col(c).cast("string")
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit(">"), "event_type", F.lit("<s"), num("user_id"))
    fields = [F.concat(F.lit("r"), num("event_id")), num("user_id"), F.lit("0"), F.lit("9"), F.lit("+"), path, *[F.lit("9")] * 5, F.lit("60"), F.concat(F.lit("NM:i:"), F.floor("value").cast("string")), F.concat(F.lit("cg:Z:"), F.col("event_type"), F.lit("="))]
    e.select(F.concat_ws("\t", *fields).alias("value")).write.text(where)
    rows = spark.read.format("gaf").option("splitBytes", 100_000).load(where)
    return rows.filter("query_length >= 10 and NM < 60 and cg like 'c%'").select("name", "query_length", F.array_join("path", "").alias("path"), "NM")


@query("fastq_format", "SELECT 'd' || doc_id AS id, regexp_replace(text, '[^a-zA-Z]', 'N', 'g') AS seq FROM documents WHERE length(text) > 0 AND CAST('d' || doc_id AS VARCHAR) LIKE 'd1%'")
def fastq_format(spark, sf_dir):
    """SRC2: reads by way of the reader's format: two of three columns made, names filtered as lines are read."""
    formats.register(spark)
    where = scratch(spark, "fastq")
    seq = F.regexp_replace("text", "[^a-zA-Z]", "N")
    d = table(spark, sf_dir, "documents").filter("length(text) > 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), seq.alias("seq"), F.array_repeat((F.col("doc_id") % 40).cast("int"), F.length(seq)).alias("q"))
    sinks.write_fastx(d, where, scores="q")
    return spark.read.format("fastq").schema("id string, seq string").option("splitBytes", 200_000).load(where).filter(F.col("id").startswith("d1"))


@query(
    "interval_stats",
    """
    SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS interval_start, user_id, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS largest, count(*) FILTER (value >= 50) AS n_over FROM events GROUP BY 1, 2
    """,
)
def interval_stats(spark, sf_dir):
    """STR6 as a batch: the aggregate that the stream emits."""
    e = table(spark, sf_dir, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    out = measurements.interval_stats(e, "6 hours", group="user_id")
    return out.withColumns({"interval_start": F.unix_micros("interval_start"), "mean": F.round("mean", 6)})


@query(
    "stream_interval_stats",
    """
    WITH w AS (SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS interval_start, user_id, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS largest, count(*) FILTER (value >= 50) AS n_over FROM events GROUP BY 1, 2)
    SELECT * FROM w WHERE interval_start + 6 * 3600000000 <= (SELECT epoch_us(max(ts)) FROM events) - 1800000000
    """,
)
def stream_interval_stats(spark, sf_dir):
    """STR6 as a stream over the events file: the intervals that the watermark has closed."""
    where = scratch(spark, "stream")
    static = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(static.schema).parquet(f"{sf_dir}/events.parq*t").withColumn("event_time", F.col("ts").cast("timestamp"))
    out = measurements.interval_stats(stream, "6 hours", "30 minutes", group="user_id")
    run = out.writeStream.format("parquet").outputMode("append").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{where}/out").withColumns({"interval_start": F.unix_micros("interval_start"), "mean": F.round("mean", 6)})


def _stream(spark, sf_dir, name):
    static = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.readStream.schema(static.schema).parquet(f"{sf_dir}/{name}.parq*t")


def _ran(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


@query("stream_routes", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'dead' END AS route FROM events")
def stream_routes(spark, sf_dir):
    """STR1: events by type to their handlers, other types to the dead letters."""
    where = scratch(spark, "routes")
    put = lambda name: lambda df, epoch: df.select("event_id").write.mode("append").parquet(f"{where}/out/route={name}")
    rows = _stream(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"))
    _ran(measurements.route(rows, {"click": put("click"), "view": put("view")}, put("dead"), f"{where}/state"))
    return spark.read.parquet(f"{where}/out").select("event_id", "route")


@query(
    "stream_shifts",
    """
    WITH s AS (SELECT user_id, event_id, value, event_type = 'error' AS done, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
    SELECT user_id, CAST(event_id AS INTEGER) AS t, round(value - first_value(value) OVER (PARTITION BY user_id, k ORDER BY event_id), 6) AS shifted, CAST(event_id AS INTEGER) AS last_t FROM s WHERE NOT done
    """,
)
def stream_shifts(spark, sf_dir):
    """STR2, STR5: values less those of the first frame since the user's state was last dropped by a done row."""
    where = scratch(spark, "shifts")
    kind = F.when(F.col("event_type") == "error", "done").otherwise("image")
    rows = _stream(spark, sf_dir, "events").select(kind.alias("type"), "user_id", F.col("event_id").cast("int").alias("t"), "value")
    _ran(measurements.shift_to_first_frame(rows, "user_id").writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state"))
    return spark.read.parquet(f"{where}/out").withColumn("shifted", F.round("shifted", 6))


@query(
    "stream_frames",
    """
    WITH e AS (SELECT user_id, event_id, ts, value, event_type = 'error' AS done, CAST(floor(epoch(ts) / 43200) AS INTEGER) AS t FROM events),
    g AS (SELECT *, coalesce(lag(done) OVER w, true) OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 172800000000 AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, event_id, t, round(value - first_value(value) OVER (PARTITION BY user_id, k ORDER BY ts, event_id), 6) AS shifted, t AS newest_t, row_number() OVER (PARTITION BY user_id, k, t ORDER BY ts, event_id) AS held FROM s WHERE NOT done
    """,
)
def stream_frames(spark, sf_dir):
    """STR2, STR5: events in three parts by time, a restart before each: shifts to the first frame, what is held of the
    newest frame, and state that goes with a done row or after two silent days."""
    where = scratch(spark, "frames")
    events = table(spark, sf_dir, "events").withColumn("event_time", F.col("ts").cast("timestamp"))
    ends = events.agg(F.min("event_time").alias("a"), F.max("event_time").alias("z")).first()
    cuts = [ends["a"] + (ends["z"] - ends["a"]) * k / 3 for k in (1, 2)]
    parts = [F.col("event_time") < cuts[0], (F.col("event_time") >= cuts[0]) & (F.col("event_time") < cuts[1]), F.col("event_time") >= cuts[1]]
    for part in parts:
        events.filter(part).write.mode("append").parquet(f"{where}/in")
        rows = spark.readStream.schema(events.schema).parquet(f"{where}/in")
        kind = F.when(F.col("event_type") == "error", "done").otherwise("image")
        rows = rows.select(kind.alias("type"), "user_id", "event_id", F.floor(F.col("event_time").cast("double") / 43200).cast("int").alias("t"), "value", "event_time")
        out = measurements.frame_states(rows, "user_id", keep=["event_id"], order=["event_time", "event_id"], idle_s=172_800)
        with measurements.rocksdb_state(spark):
            _ran(out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state"))
    return spark.read.parquet(f"{where}/out").withColumn("shifted", F.round("shifted", 6))


@query("stream_calibrated", "SELECT l_orderkey, l_linenumber, round((l_quantity - 1) / (p_retailprice - 1), 6) AS value FROM lineitem JOIN part ON p_partkey = l_partkey")
def stream_calibrated(spark, sf_dir):
    """STR3: a stream of lines as pixels against the static calibration of their part."""
    where, zero = scratch(spark, "calibrated"), F.lit(0)
    px = _stream(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("channel"), zero.alias("y"), zero.alias("x"), F.col("l_quantity").alias("value"))
    cal = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("channel"), zero.alias("y"), zero.alias("x"), F.lit(1.0).alias("dark"), F.col("p_retailprice").alias("flat"))
    out = measurements.calibrated(px, cal).select("l_orderkey", "l_linenumber", "value")
    _ran(out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state"))
    return spark.read.parquet(f"{where}/out").withColumn("value", F.round("value", 6))


@query("stream_idempotent", "SELECT event_id, value, CAST(user_id % 8 AS INTEGER) AS fov_num, event_type FROM events")
def stream_idempotent(spark, sf_dir):
    """STR4: the same batch written twice leaves every partition once."""
    where = scratch(spark, "idempotent")
    rows = _stream(spark, sf_dir, "events").select("event_id", "value", (F.col("user_id") % 8).alias("fov_num"), "event_type")
    for run in range(2):
        _ran(measurements.idempotent_sink(rows, f"{where}/out", f"{where}/state{run}", by=("fov_num", "event_type")))
    return spark.read.parquet(f"{where}/out")
