"""Queries on reads, barcodes and codebooks (workloads A and B), over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar, distances, keys, paths, sequences
from ..operators import groups, hamming, joins, numbering, pairing, stats
from ..operators import filters as flt
from ..session import table
from .registry import query


@query(
    "barcode_depth",
    """
    WITH g AS (SELECT concat(user_id, ':', event_type) AS barcode, count(*) AS depth, list_sort(list(event_id)) AS members
               FROM events GROUP BY 1 HAVING count(*) >= 3)
    SELECT barcode, depth, array_to_string(members, ',') AS members, row_number() OVER (ORDER BY barcode) - 1 AS barcodeid FROM g
    """,
)
def barcode_depth(spark, sf_dir):
    """AGG1: groups of at least 3 rows, densely numbered, with their members."""
    reads = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", "event_type").alias("barcode"), "event_id")
    book = groups.threshold_codebook(reads, "barcode", "event_id", 3)
    return book.withColumn("members", F.concat_ws(",", F.col("members").cast("array<string>")))


@query(
    "depth_columns",
    """
    SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey) AS path_depth,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey) AS BIGINT) AS path_duplex_depth FROM lineitem
    """,
)
def depth_columns(spark, sf_dir):
    """AGG2: depth and duplex depth of each row's group."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return groups.with_depth(rows, ["l_partkey"], F.col("l_returnflag") == "R", prefix="path_").select("l_orderkey", "l_linenumber", "path_depth", "path_duplex_depth")


@query(
    "best_rows_per_group",
    """
    SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 5
    """,
)
def best_rows_per_group(spark, sf_dir):
    """TOP1: the best five rows of each group, in two stages."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return groups.best_rows(rows, ["l_partkey"], "l_extendedprice", 5, ["l_orderkey", "l_linenumber"], salt=4)


@query(
    "limited_group_content",
    """
    SELECT event_id, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 10 THEN props END AS props FROM events
    """,
)
def limited_group_content(spark, sf_dir):
    """PRJ14: heavy columns beyond the first ten rows of a group are null."""
    return groups.limit_group_content(table(spark, sf_dir, "events").select("event_id", "user_id", "props"), ["user_id"], ["event_id"], ["props"], 10)


@query(
    "asof_pairs",
    """
    WITH l AS (SELECT user_id, event_id, ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS t FROM events),
    r AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2)
    SELECT l.user_id, l.event_id, CASE WHEN epoch_us(r.ts) - epoch_us(l.t) <= 3600000000 THEN r.event_id END AS match_event_id
    FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND r.ts >= l.t
    """,
)
def asof_pairs(spark, sf_dir):
    """JON2: the first event of the same user after an event's end, within an hour."""
    events = table(spark, sf_dir, "events")
    left = events.select("user_id", "event_id", keys.later(F.col("ts"), F.col("value")).alias("t"))
    return pairing.asof_forward(left, events.select("user_id", F.col("event_id"), "ts"), ["user_id"], "t", "ts", "event_id", 3_600_000_000).select("user_id", "event_id", "match_event_id")


@query(
    "parent_validity",
    """
    WITH line AS MATERIALIZED (SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag AS path, l_linestatus = 'F' AS rc FROM lineitem),
    dup AS MATERIALIZED (SELECT o_orderkey AS k, 1 AS a, o_orderstatus AS path FROM orders UNION ALL SELECT o_orderkey, 2, 'A' FROM orders WHERE o_orderkey % 3 = 0),
    judged AS MATERIALIZED (
      SELECT d.k, d.a, count(l.path) = 2 AND coalesce(bool_and(l.path = d.path), false) AND coalesce(sum(CAST(l.rc AS INT)), 0) = 1 AS ok
      FROM dup d LEFT JOIN line l ON l.k = d.k AND l.n BETWEEN d.a AND d.a + 1 GROUP BY d.k, d.a),
    used AS MATERIALIZED (SELECT k, n, bool_or(ok) AS ok FROM (SELECT k, a AS n, ok FROM judged UNION ALL SELECT k, a + 1, ok FROM judged) GROUP BY k, n)
    SELECT k || '-' || l.n AS name, NOT coalesce(u.ok, false) AS is_valid FROM line l LEFT JOIN used u USING (k, n)
    UNION ALL SELECT k || '-' || a || ';' || k || '-' || (a + 1), ok FROM judged
    """,
)
def parent_validity(spark, sf_dir):
    """JON3: orders as duplex reads of their first lines."""
    line = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name"), F.col("l_returnflag").alias("path"), (F.col("l_linestatus") == "F").alias("rc"))
    orders = table(spark, sf_dir, "orders")
    pair = lambda a, b: F.concat(F.col("o_orderkey").cast("string"), F.lit(f"-{a};"), F.col("o_orderkey").cast("string"), F.lit(f"-{b}"))
    one = orders.select(pair(1, 2).alias("name"), F.col("o_orderstatus").alias("path"), F.lit(False).alias("rc"))
    two = orders.filter("o_orderkey % 3 = 0").select(pair(2, 3).alias("name"), F.lit("A").alias("path"), F.lit(False).alias("rc"))
    return pairing.flag_valid_duplex(line.unionByName(one).unionByName(two), "name", "path", "rc").select("name", "is_valid")


@query(
    "primary_rows",
    """
    SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AND props IS NOT NULL AS is_primary_alignment, count(*) OVER (PARTITION BY user_id) > 1 AS is_duplicated FROM events
    """,
)
def primary_rows(spark, sf_dir):
    """WIN12: the first row of each name."""
    return pairing.primary_alignments(table(spark, sf_dir, "events").select("event_id", "user_id", "props"), "user_id", "event_id", "props").select("event_id", "is_primary_alignment", "is_duplicated")


@query(
    "reads_and_alignments",
    "SELECT o_orderkey, o_orderpriority, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey",
)
def reads_and_alignments(spark, sf_dir):
    """JON1: orders as reads, lines as alignments; an unknown name would raise."""
    reads = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return pairing.join_reads_and_alignments(reads, lines, "o_orderkey")


_CODES = """codes AS (SELECT vec_id, label, array_to_string(list_transform(embedding[1:30], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS barcode FROM embeddings)"""


def _codes(spark, sf_dir):
    bits = F.array_join(F.transform(F.slice("embedding", 1, 30), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", bits.alias("barcode"))


@query(
    "nearest_hamming",
    f"""
    WITH {_CODES}, d AS (
      SELECT q.vec_id AS query_id, c.vec_id, hamming(q.barcode, c.barcode) AS distance FROM codes q JOIN codes c ON q.vec_id % 2 = 1 AND c.vec_id % 2 = 0
    )
    SELECT query_id, vec_id, CAST(distance AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM d WHERE distance <= 5) WHERE r = 1
    """,
)
def nearest_hamming(spark, sf_dir):
    """JON5: odd vectors as decoded barcodes, even ones as the codebook, at most 5 of 30 bits apart."""
    codes = _codes(spark, sf_dir).withColumn("code", hamming.pack_bits(F.col("barcode")))
    q = codes.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("query_id"), "code")
    return hamming.nearest_within(q, codes.filter("vec_id % 2 = 0"), "query_id", "code", "vec_id", "code", 30, 5)


@query(
    "closest_other",
    f"""
    WITH {_CODES}, d AS (SELECT q.vec_id, c.vec_id AS nearest_vec_id, hamming(q.barcode, c.barcode) AS distance FROM codes q JOIN codes c ON q.vec_id <> c.vec_id)
    SELECT vec_id, nearest_vec_id, CAST(distance AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, nearest_vec_id) AS r FROM d WHERE distance <= 6) WHERE r = 1
    """,
)
def closest_other(spark, sf_dir):
    """JON6: the closest other barcode of the codebook."""
    codes = _codes(spark, sf_dir).withColumn("code", hamming.pack_bits(F.col("barcode")))
    return hamming.nearest_within(codes, codes, "vec_id", "code", "vec_id", "code", 30, 6, other_than_self=True)


@query(
    "exact_lookup",
    f"""
    WITH {_CODES.replace('[1:30]', '[1:8]')}, book AS (SELECT barcode, min(vec_id) AS barcodeid FROM codes WHERE label = 0 GROUP BY barcode)
    SELECT vec_id, barcode, barcodeid FROM codes JOIN book USING (barcode)
    """,
)
def exact_lookup(spark, sf_dir):
    """JON4: barcodes of eight bits that the codebook holds."""
    codes = _codes(spark, sf_dir).withColumn("barcode", F.substring("barcode", 1, 8))
    book = codes.filter("label = 0").groupBy("barcode").agg(F.min("vec_id").alias("barcodeid"))
    return joins.exact_lookup(codes.select("vec_id", "barcode"), book, "barcode")


@query(
    "bits_removed",
    f"""
    WITH {_CODES.replace('[1:30]', '[1:12]')}, cut AS (SELECT vec_id, barcode[1:3] || barcode[6:12] AS barcode FROM codes), lone AS (SELECT barcode FROM cut GROUP BY barcode HAVING count(*) = 1)
    SELECT vec_id, barcode, row_number() OVER (ORDER BY barcode) - 1 AS barcodeid FROM cut JOIN lone USING (barcode)
    """,
)
def bits_removed(spark, sf_dir):
    """SET5: two bits removed, barcodes that coincide dropped, the rest numbered."""
    codes = _codes(spark, sf_dir).select("vec_id", F.substring("barcode", 1, 12).alias("barcode"))
    return flt.remove_bits(codes, "barcode", [3, 4])


@query(
    "signal_barcode",
    """
    SELECT vec_id, array_to_string(list_transform(range(1, 31), lambda i: CASE WHEN i <> 3 AND embedding[i] > 0.05 THEN '1' ELSE '0' END), '') AS barcode FROM embeddings
    """,
)
def signal_barcode(spark, sf_dir):
    """SCL6: signals over thresholds, one cycle removed."""
    signal = F.transform(F.slice("embedding", 1, 30), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", paths.signal_barcode(signal, [0.05] * 30, removed=[2]).alias("barcode"))


@query(
    "signal_sum",
    """
    WITH v AS (SELECT vec_id, unnest(range(1, 31)) AS p, unnest(embedding[1:30]) AS x FROM embeddings),
    w AS (SELECT vec_id, p, CASE WHEN p = 3 THEN 0.0 ELSE CAST(x AS DOUBLE) END AS x FROM v),
    m AS (SELECT p, quantile_cont(x, 0.5) AS mid FROM w GROUP BY p)
    SELECT vec_id, round(sum(x / (mid + 1)), 6) AS signal_sum FROM w JOIN m USING (p) GROUP BY vec_id
    """,
)
def signal_sum(spark, sf_dir):
    """AGG35: signals over their position's median, summed."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 30)).alias("p", "x")).select("vec_id", (F.col("p") + 1).alias("p"), F.col("x").cast("double").alias("x"))
    return stats.signal_sum(rows, "vec_id", "p", "x", 30, removed=[3], eps=1.0).withColumn("signal_sum", F.round("signal_sum", 6))


_PATHS = """p AS (SELECT user_id, list(CASE WHEN user_id % 3 = 0 OR (user_id % 3 = 1 AND value > 60) THEN '<' ELSE '>' END || event_type ORDER BY event_id) AS path FROM events GROUP BY user_id)"""


def _paths(spark, sf_dir):
    """Per user all events as an oriented path: backward for a third of the users, mixed for another."""
    back = (F.col("user_id") % 3 == 0) | ((F.col("user_id") % 3 == 1) & (F.col("value") > 60))
    step = F.concat(F.when(back, "<").otherwise(">"), "event_type")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", step.alias("s")))).alias("x"))
    return rows.select("user_id", F.col("x.s").alias("path"))


@query(
    "path_normalize",
    f"""
    WITH {_PATHS}, f AS (
      SELECT user_id, path, list_has_any(path, ['>click', '>view', '>purchase']) AS f, list_has_any(path, ['<click', '<view', '<purchase']) AS b,
             list_filter(path, lambda s: s[2:] IN ('click', 'view', 'purchase')) AS kept FROM p)
    SELECT user_id, CASE WHEN b AND NOT f THEN true WHEN f AND NOT b THEN false END AS reverse_complement,
           CASE WHEN b AND NOT f THEN array_to_string(list_reverse(list_transform(kept, lambda s: translate(s[1], '<>', '><') || s[2:])), '') WHEN f AND NOT b THEN array_to_string(kept, '') END AS path,
           array_to_string(path, '') AS full_path FROM f
    """,
)
def path_normalize(spark, sf_dir):
    """PRJ1: paths of three kinds of segment, turned forward."""
    out = paths.normalize_paths(_paths(spark, sf_dir), ["click", "view", "purchase"])
    return out.select("user_id", "reverse_complement", F.when(F.col("path").isNotNull(), F.array_join("path", "")).alias("path"), F.array_join("full_path", "").alias("full_path"))


@query(
    "end_to_end",
    f"WITH {_PATHS} SELECT user_id, list_has_any(path, ['>click', '<click']) AND list_has_any(path, ['>view', '<view', '>error', '<error']) AS end_to_end FROM p",
)
def end_to_end(spark, sf_dir):
    """PRJ2: paths that hold a segment of each end."""
    return paths.flag_end_to_end(_paths(spark, sf_dir), (["click"], ["view", "error"])).select("user_id", "end_to_end")


@query("unique_segments", f"WITH {_PATHS} SELECT DISTINCT unnest(list_transform(path, lambda s: s[2:])) AS segment FROM p")
def unique_segments(spark, sf_dir):
    """PRJ5: segments that the paths use."""
    return paths.unique_segments(_paths(spark, sf_dir), "path")


@query(
    "barcode_string",
    f"WITH {_PATHS}, q AS (SELECT user_id, list_transform(path, lambda s: s || CASE WHEN s[1] = '>' THEN '=1' ELSE '=0' END) AS path FROM p) SELECT user_id, CASE WHEN list_contains(path, '>click=1') THEN '1' ELSE '0' END || CASE WHEN list_contains(path, '>view=1') THEN '1' ELSE '0' END || CASE WHEN list_contains(path, '>error=1') THEN '1' ELSE '0' END AS barcode FROM q",
)
def barcode_string(spark, sf_dir):
    """SCL3: forward segments as ones."""
    marked = F.transform("path", lambda s: F.concat(s, F.when(s.startswith(">"), "=1").otherwise("=0")))
    return _paths(spark, sf_dir).select("user_id", paths.barcode_string(marked, ["click", "view", "error"]).alias("barcode"))


@query(
    "mismatched_bits",
    f"""
    WITH {_PATHS}, v AS (SELECT user_id, list_distinct(list_transform(path, lambda s: '>' || s[2:] || CASE WHEN s[1] = '>' THEN '=1' ELSE '=0' END)) AS v FROM p),
    a AS (SELECT x.user_id, list_transform(list_filter(x.v, lambda s: NOT list_contains(y.v, s)), lambda s: string_split(s[2:], '=')[1]) AS l, list_transform(list_filter(y.v, lambda s: NOT list_contains(x.v, s)), lambda s: string_split(s[2:], '=')[1]) AS r FROM v x JOIN v y ON y.user_id = x.user_id + 1)
    SELECT user_id, array_to_string(list_sort(list_distinct(list_intersect(l, r))), ',') AS bits FROM a
    """,
)
def mismatched_bits(spark, sf_dir):
    """SET4: bits that two users' paths hold with different values."""
    own = F.transform("path", lambda s: F.concat(F.lit(">"), F.substring(s, F.lit(2), F.length(s)), F.when(s.startswith(">"), "=1").otherwise("=0")))
    a = _paths(spark, sf_dir).select("user_id", own.alias("a"))
    b = a.select((F.col("user_id") - 1).alias("user_id"), F.col("a").alias("b"))
    return a.join(b, "user_id").select("user_id", F.array_join(paths.mismatched_bits(F.col("a"), F.col("b")), ",").alias("bits"))


@query(
    "column_vote",
    """
    WITH b AS (SELECT source, unnest(range(0, length(s))) AS position, unnest(string_split(s, '')) AS base FROM (SELECT source, regexp_replace(text, '[^ -~]', '?', 'g') AS s FROM documents) WHERE length(s) > 0),
    c AS (SELECT source, position, base, count(*) AS n FROM b GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY source, position ORDER BY n DESC, base) AS r FROM c)
    SELECT source, string_agg(base, '' ORDER BY position) AS consensus FROM t WHERE r = 1 GROUP BY source
    """,
)
def column_vote(spark, sf_dir):
    """AGG4: the majority character at each place of whole texts, by source."""
    reads = table(spark, sf_dir, "documents").select("source", F.regexp_replace("text", "[^ -~]", "?").alias("seq"))
    return groups.column_vote(reads, ["source"], "seq")


@query(
    "ambiguous_positions",
    """
    WITH b AS (SELECT source, unnest(range(0, length(s))) AS position, unnest(string_split(s, '')) AS base FROM (SELECT source, regexp_replace(text, '[^ -~]', '?', 'g') AS s FROM documents) WHERE length(s) > 0),
    c AS (SELECT source, position, base, count(*) AS n FROM b GROUP BY ALL),
    t AS (SELECT source, position, sum(n) AS total, list_sort(list(n), 'DESC') AS ns FROM c GROUP BY 1, 2)
    SELECT source, round(avg(CASE WHEN (coalesce(ns[2], 0) + 0.001) / (total + 0.001) > 0.1 THEN 1.0 ELSE 0.0 END), 6) AS ambiguous_share FROM t GROUP BY source
    """,
)
def ambiguous_positions(spark, sf_dir):
    """AGG5: share of places with a strong second character."""
    reads = table(spark, sf_dir, "documents").select("source", F.regexp_replace("text", "[^ -~]", "?").alias("seq"))
    return groups.ambiguous_positions(reads, ["source"], "seq").withColumn("ambiguous_share", F.round("ambiguous_share", 6))


_NT = "translate(regexp_replace(text, '[^ -~]', '?', 'g'), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTAC')"


def _nucleotides(spark, sf_dir):
    """Documents as nucleotide strings: letters onto ACGT, other characters as they are."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return table(spark, sf_dir, "documents").select("doc_id", F.translate(F.regexp_replace("text", "[^ -~]", "?"), letters, "ACGT" * 6 + "AC" + "ACGT" * 6 + "AC").alias("seq"))


@query("reverse_complement", f"SELECT doc_id, translate(reverse(s), 'ACGTacgtNn', 'TGCAtgcaNn') AS rc FROM (SELECT doc_id, {_NT} AS s FROM documents)")
def reverse_complement(spark, sf_dir):
    """SCL1."""
    return _nucleotides(spark, sf_dir).select("doc_id", sequences.reverse_complement(F.col("seq")).alias("rc"))


@query(
    "umi_by_handle",
    f"SELECT doc_id, CASE WHEN instr(s, 'GTA') > 1 AND instr(s, 'GTA') + 3 + 8 - 1 <= length(s) THEN substring(s, instr(s, 'GTA') + 3, 8) END AS umi FROM (SELECT doc_id, {_NT} AS s FROM documents)",
)
def umi_by_handle(spark, sf_dir):
    """SCL14: eight bases after a handle."""
    return _nucleotides(spark, sf_dir).select("doc_id", sequences.umi_by_handle(F.col("seq"), "GTA", 8).alias("umi"))


@query(
    "motif_sites",
    f"""
    WITH d AS (SELECT doc_id, {_NT} AS s FROM documents), e AS (SELECT doc_id, length(s) AS n, string_split(s, '') AS s, string_split(translate(reverse(s), 'ACGTacgtNn', 'TGCAtgcaNn'), '') AS r FROM d WHERE length(s) >= 4)
    SELECT doc_id, '+' AS strand, CAST(unnest(list_filter(range(0, n - 3), lambda i: s[i + 1] = 'G' AND s[i + 2] = 'A' AND s[i + 3] = 'T' AND s[i + 4] = 'C')) AS INTEGER) AS start FROM e UNION ALL
    SELECT doc_id, '-', CAST(n - unnest(list_filter(range(0, n - 3), lambda i: r[i + 1] = 'G' AND r[i + 2] = 'A' AND r[i + 3] = 'T' AND r[i + 4] = 'C')) - 4 AS INTEGER) FROM e
    """,
)
def motif_sites(spark, sf_dir):
    """SCL17: a motif on both strands."""
    return sequences.motif_sites(_nucleotides(spark, sf_dir), "seq", "GATC").select("doc_id", "strand", "start")


@query(
    "pam_sites",
    f"""
    WITH d AS (SELECT doc_id, {_NT} AS s FROM documents), e AS (SELECT doc_id, '+' AS strand, s FROM d WHERE length(s) >= 23 UNION ALL SELECT doc_id, '-', translate(reverse(s), 'ACGTacgtNn', 'TGCAtgcaNn') FROM d WHERE length(s) >= 23),
    l AS (SELECT *, length(s) AS n, string_split(s, '') AS l FROM e), f AS (SELECT doc_id, strand, s, n, unnest(list_filter(range(0, n - 22), lambda i: l[i + 1] = 'C' AND l[i + 2] = 'C')) AS i FROM l)
    SELECT doc_id, strand, CAST(CASE strand WHEN '+' THEN i + 3 ELSE n - i - 23 END AS INTEGER) AS start, CAST(CASE strand WHEN '+' THEN i + 23 ELSE n - i - 3 END AS INTEGER) AS "end", substring(s, i + 4, 20) AS target FROM f
    """,
)
def pam_sites(spark, sf_dir):
    """SCL16: targets behind PAMs on both strands."""
    return sequences.pam_sites(_nucleotides(spark, sf_dir), "seq").select("doc_id", "strand", "start", "end", "target")


@query(
    "site_flags",
    f"SELECT doc_id, contains(s, 'GAGC') OR contains(translate(reverse(s), 'ACGTacgtNn', 'TGCAtgcaNn'), 'GAGC') OR contains(s, 'CGCT') OR contains(translate(reverse(s), 'ACGTacgtNn', 'TGCAtgcaNn'), 'CGCT') AS has_site, s[-5:] NOT IN ('ACGTA', 'CACAC') AS good_seed FROM (SELECT doc_id, {_NT} AS s FROM documents)",
)
def site_flags(spark, sf_dir):
    """SCL15, SCL19: restriction sites and bad seeds."""
    s = F.col("seq")
    return _nucleotides(spark, sf_dir).select("doc_id", sequences.has_any_site(s, ["GAGC", "CGCT"]).alias("has_site"), sequences.good_seed(s, ["ACGTA", "CACAC"]).alias("good_seed"))


def _cigar_reads(spark, sf_dir):
    """Alignments made from order lines: (q)= (1)X (n)I (2)D 20= over two segments of fitting length, the second one in
    reverse, with reads and scores."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"))
    rows = rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name"), "q", F.col("l_linenumber").alias("n"))
    ref = F.col("q") + 1 + 2 + 20
    length = F.col("q") + 1 + F.col("n") + 20 + 2
    return rows.select(
        "name", F.array(F.concat(F.lit(">s"), F.col("q").cast("string")), F.lit("<tail")).alias("path"), F.lit(0).alias("path_start"), ref.alias("path_end"), ref.alias("path_length"),
        F.lit(2).alias("query_start"), length.alias("query_end"), length.alias("query_length"),
        F.concat(F.col("q").cast("string"), F.lit("=1X"), F.col("n").cast("string"), F.lit("I2D20=")).alias("cg"),
        F.substring(F.repeat(F.lit("ACGGTTAC"), 12), F.lit(1), length).alias("seq"), F.sequence(F.lit(1), length).alias("phred"),
    )


def _segment_lengths(spark):
    lengths = spark.range(1, 51).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"), (F.col("id") + 2).cast("int").alias("length"))
    return lengths.unionByName(spark.range(1).select(F.lit("tail").alias("name"), F.lit(21).alias("length")))


@query(
    "segment_counts",
    """
    WITH c AS (SELECT l_orderkey || '-' || l_linenumber AS name, CAST(min(l_quantity) AS INTEGER) AS q, CAST(l_linenumber AS INTEGER) AS n, repeat('ACGGTTAC', 12) AS r FROM lineitem GROUP BY l_orderkey, l_linenumber),
    u AS (
      SELECT name, CAST(0 AS INTEGER) AS position, 's' || q AS segment, q AS matches, CAST(1 AS INTEGER) AS mismatches, n AS insertions, CAST(1 AS INTEGER) AS deletions, CAST(2 AS INTEGER) AS query_start, q + 3 + n AS query_end, q || '=1X' || n || 'I1D' AS cigar, false AS rc, r FROM c UNION ALL
      SELECT name, 1, 'tail', 20, 0, 0, 1, q + 3 + n, q + 3 + n + 20, '20=1D', true, r FROM c UNION ALL
      SELECT name, NULL, 'upstream', 0, 0, 2, 0, 0, 2, '2I', false, r FROM c
    )
    SELECT name, position, segment, matches, mismatches, insertions, deletions, query_start, query_end, cigar,
           CASE WHEN rc THEN translate(reverse(substring(r, query_start + 1, query_end - query_start)), 'ACGT', 'TGCA') ELSE substring(r, query_start + 1, query_end - query_start) END AS seq,
           array_to_string(CASE WHEN rc THEN list_reverse(range(query_start + 1, query_end + 1)) ELSE range(query_start + 1, query_end + 1) END, ',') AS phred
    FROM u
    """,
)
def segment_counts(spark, sf_dir):
    """SEG1: alignments cut at a boundary that runs through a deletion; the reverse segment's sequence, scores and
    operations in its own direction."""
    cut = cigar.cut_by_segment(_cigar_reads(spark, sf_dir), _segment_lengths(spark), with_cigar=True, seq="seq", phred="phred")
    scores = F.array_join(F.col("phred").cast("array<string>"), ",")
    return cut.select("name", "position", "segment", "matches", "mismatches", "insertions", "deletions", "query_start", "query_end", "cigar", "seq", scores.alias("phred"))


@query(
    "divergence",
    """
    SELECT l_orderkey || '-' || l_linenumber AS name, round(greatest((1 + l_linenumber + 1) / CAST(CAST(min(l_quantity) AS INTEGER) + 2 + l_linenumber AS DOUBLE), 1.0 / 21), 9) AS max_divergence FROM lineitem GROUP BY l_orderkey, l_linenumber
    """,
)
def divergence(spark, sf_dir):
    """PRJ3: the largest divergence over a read's segments."""
    cut = cigar.cut_by_segment(_cigar_reads(spark, sf_dir), _segment_lengths(spark)).filter(F.col("position").isNotNull())
    return flt.max_divergence(cut).withColumn("max_divergence", F.round("max_divergence", 9))


@query(
    "edit_distance",
    """
    WITH b AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS k, regexp_replace(text, '[^ -~]', '?', 'g') AS t FROM benchmark)
    SELECT d.doc_id, CAST(levenshtein(regexp_replace(d.text, '[^ -~]', '?', 'g'), b.t) AS INTEGER) AS distance
    FROM documents d JOIN b ON b.k = d.doc_id % (SELECT count(*) FROM benchmark)
    """,
)
def edit_distance(spark, sf_dir):
    """SEG2: edit distance of whole texts to an item each; all items serve."""
    items = numbering.dense_index(table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "?").alias("b")), ["item_id"], "k")
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % items.count()).alias("k"), F.regexp_replace("text", "[^ -~]", "?").alias("a"))
    return d.join(joins.sized_broadcast(items), "k").select("doc_id", distances.edit_distance(F.col("a"), F.col("b")).alias("distance"))


_ACGT = "translate({0}, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ -0123456789', 'ACGTACGTACGTACGTACGTACGTACACGTACGTACGTACGTACGTACGTACACACGTACGTAC')"


def _acgt(c):
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ -0123456789"
    return F.translate(c, letters, "ACGT" * 6 + "AC" + "ACGT" * 6 + "AC" + "AC" + "ACGT" * 2 + "AC")


@query(
    "reference_distance",
    f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(levenshtein({_ACGT.format('o_orderpriority')}, 'ACGGT' || CASE WHEN o_orderkey % 2 = 0 THEN 'TTGCA' ELSE 'TGCAA' END) AS INTEGER) END AS distance FROM orders
    """,
)
def reference_distance(spark, sf_dir):
    """SEG2: reads against the reference assembled along their path; empty reads have none."""
    seg = spark.createDataFrame([("a", "ACGGT"), ("b", "TTGCA")], "name string, seq string")
    read = F.when(F.col("o_orderkey") % 5 != 0, F.lower(_acgt(F.col("o_orderpriority")))).otherwise("")
    o = table(spark, sf_dir, "orders").select("o_orderkey", read.alias("read"), F.array(F.lit(">a"), F.when(F.col("o_orderkey") % 2 == 0, ">b").otherwise("<b")).alias("path"))
    return paths.reference_distance(o, "path", "o_orderkey", "read", seg).select("o_orderkey", "distance")


@query(
    "cross_run_error",
    f"""
    WITH a AS (SELECT o_custkey AS h, min({_ACGT.format('o_orderpriority')}) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS h, max({_ACGT.format('o_orderpriority')}) AS s FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1),
    d AS (SELECT CAST(levenshtein(a.s, b.s) AS INTEGER) AS distance FROM a JOIN b USING (h))
    SELECT distance, count(*) AS n, round(count(*) / (SELECT count(*) FROM d), 9) AS share FROM d GROUP BY 1
    """,
)
def cross_run_error(spark, sf_dir):
    """SEG4: even and odd orders as two runs, customers as paths."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("h"), "o_orderkey", _acgt(F.col("o_orderpriority")).alias("s"))
    run = lambda r, f: o.filter(F.col("o_orderkey") % 2 == r).groupBy("h").agg(f("s").alias("s"))
    return paths.cross_run_error(run(0, F.min), run(1, F.max), "h", "s").withColumn("share", F.round("share", 9))


@query(
    "path_hash_groups",
    f"WITH {_PATHS} SELECT user_id, CAST(CAST('0x' || substr(md5(array_to_string(path, '')), 1, 15) AS BIGINT) % 8 AS INTEGER) AS hash_group FROM p",
)
def path_hash_groups(spark, sf_dir):
    """TOP5: the hash group of every path, one of eight."""
    return _paths(spark, sf_dir).select("user_id", keys.hash_group(F.col("path"), 8).alias("hash_group"))


@query(
    "lineage_pairs",
    """
    WITH RECURSIVE n AS (SELECT o_custkey AS g, 1 + o_orderkey % 31 AS node FROM orders GROUP BY ALL),
    up AS (SELECT g, node AS descendant, node AS anc FROM n UNION ALL SELECT up.g, descendant, anc >> 1 FROM up JOIN n ON n.g = up.g AND n.node = (up.anc >> 1) WHERE anc > 1)
    SELECT g, anc AS ancestor, descendant FROM up WHERE anc <> descendant
    """,
)
def lineage_pairs(spark, sf_dir):
    """SCL27: ancestors through existing nodes of a binary lineage, per customer."""
    nodes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), (1 + F.col("o_orderkey") % 31).alias("node"))
    return keys.descendants(nodes, ["g"])


@query(
    "bit_frequency",
    f"WITH {_CODES}, b AS (SELECT unnest(range(0, 30)) AS position, unnest(string_split(barcode, '')) AS bit FROM codes) SELECT CAST(position AS INTEGER) AS position, round(avg(CASE WHEN bit = '1' THEN 1.0 ELSE 0.0 END), 9) AS frequency FROM b GROUP BY 1",
)
def bit_frequency(spark, sf_dir):
    """AGG30."""
    return stats.bit_frequency(_codes(spark, sf_dir), "barcode").withColumn("frequency", F.round("frequency", 9))


@query(
    "composite_keys",
    "SELECT lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') || lpad(CAST(l_suppkey AS VARCHAR), 4, '0') AS key, sha256(l_returnflag || l_linestatus) AS digest FROM lineitem",
)
def composite_keys(spark, sf_dir):
    """SCL9, SCL10."""
    parts = [(F.col("l_orderkey"), 8), (F.col("l_linenumber"), 4), (F.col("l_suppkey"), 4)]
    return table(spark, sf_dir, "lineitem").select(keys.composite_key(parts).alias("key"), keys.names_digest(F.array("l_returnflag", "l_linestatus")).alias("digest"))
