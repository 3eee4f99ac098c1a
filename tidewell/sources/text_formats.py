"""Readers of alignment, read and graph text formats (SRC1-7)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import parse_path
from ..operators.components import connected_parts
from ..session import written

#: The twelve columns of the graph alignment format.
GAF_COLUMNS = (
    ("name", "string"), ("query_length", "long"), ("query_start", "long"), ("query_end", "long"), ("strand", "string"), ("path", "path"),
    ("path_length", "long"), ("path_start", "long"), ("path_end", "long"), ("residue_matches", "long"), ("block_length", "long"), ("mapping_quality", "smallint"),
)
#: Tag type letters, and the element types of B arrays; unsigned ones widen.
TAG_TYPES = {"A": "string", "i": "int", "f": "float", "Z": "string", "H": "string"}
ARRAY_TYPES = {"c": "tinyint", "C": "smallint", "s": "smallint", "S": "int", "i": "int", "I": "bigint", "f": "float"}


def tag_column(fields: Column, tag: str, kind: str, subtype: str | None = None) -> Column:
    """The value of ``tag:kind:value`` among the fields, cast; null where it is missing."""
    head = f"{tag}:{kind}:"
    raw = F.get(F.filter(fields, lambda f: f.startswith(head)), 0)
    value = F.substring(raw, len(head) + 1, 1 << 30)
    if kind == "B":
        parts = F.split(F.substring(value, 3, 1 << 30), ",")
        return F.transform(parts, lambda x: x.cast(ARRAY_TYPES[subtype or "i"]))
    return value.cast(TAG_TYPES[kind])


def discover_tags(line: str, n_fixed: int) -> list[tuple[str, str, str | None]]:
    """(tag, type, array element type) of the optional fields of a line, also those that follow the read's name."""
    fields = line.split("\t")
    found = []
    for f in [*fields[0].split(" ")[1:], *fields[n_fixed:]]:
        tag, _, rest = f.partition(":")
        kind, _, value = rest.partition(":")
        if len(tag) == 2 and kind and (kind in TAG_TYPES or kind == "B"):
            found.append((tag, kind, value[0] if kind == "B" else None))
    return found


def read_gaf(spark: SparkSession, paths: str | Sequence[str], tags: Sequence[tuple[str, str, str | None]] | None = None) -> DataFrame:
    """Alignments with the fixed columns typed, one column a tag, and ``aln_rank``, which sorts as the input does: by
    file name, split and line (SRC1).

    Tags are those of the first line unless given. ``*`` paths are null.
    """
    read = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    # files in the order of their names, lines by where their split starts and by their place in it
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("line"))
    lines = read.select("value", place.alias("aln_rank")).filter("value <> ''")
    if tags is None:
        first = lines.head(1)
        tags = discover_tags(first[0]["value"], len(GAF_COLUMNS)) if first else []
    fields = F.split("value", "\t")
    rows = lines.withColumn("f", fields)
    rest = lambda array, start: F.slice(array, start, F.greatest(F.size(array), F.lit(1)))
    extra = F.concat(rest(F.split(F.get("f", 0), " "), 2), rest(F.col("f"), len(GAF_COLUMNS) + 1))
    out = []
    for i, (name, kind) in enumerate(GAF_COLUMNS):
        c = F.get("f", i)
        if name == "name":
            c = F.split_part(c, F.lit(" "), F.lit(1))
        out.append((F.when(c != "*", parse_path(c)) if kind == "path" else c.cast(kind)).alias(name))
    return rows.select(*out, *[tag_column(extra, *t).alias(t[0]) for t in tags], "aln_rank")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id (up to the first space), seq of FASTA records (SRC2). Records split the files, not lines."""
    rows = spark.read.option("lineSep", "\n>").text(path).filter("trim(value) <> ''")
    lines = F.split(F.regexp_replace("value", "^>", ""), "\r?\n")
    return rows.select(F.split_part(F.get(lines, 0), F.lit(" "), F.lit(1)).alias("id"), F.array_join(F.slice(lines, 2, 1 << 30), "").alias("seq"))


#: Bytes of a range by default and at most, unless more are asked for, and the tasks up to which smaller ranges are cut.
RANGE_BYTES, RANGES = 32 << 20, 256


def range_bytes(asked: int, total: int) -> int:
    """What a range measures: as asked, but where input of this size would be cut into more than 256 ranges, ranges grow
    with it, up to 32 MB, so that tasks do not stay tiny and multiply."""
    return max(asked, min(RANGE_BYTES, -(-total // RANGES)))


def read_fastq(spark: SparkSession, path: str, split_bytes: int = RANGE_BYTES) -> DataFrame:
    """id, seq, qual of four-line FASTQ records (SRC2). Files are cut into byte ranges (``range_bytes``), each a task's: it
    starts at the first line that begins with @ and whose next but one begins with +, and owns the records that start in
    it. Gzipped files are one range each. Ranges are opened by pyarrow's file systems."""
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "length")
    split_bytes = range_bytes(split_bytes, files.agg(F.sum("length")).first()[0] or 0)
    whole = F.col("path").endswith(".gz")
    starts = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.select("path", F.explode(starts).alias("start"), F.when(whole, F.lit(None).cast("long")).otherwise(F.lit(split_bytes).cast("long")).alias("size"))
    ranges = ranges.repartitionByRange(max(1, ranges.count()), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, name = pa.fs.FileSystem.from_uri(r["path"] if "://" in r["path"] else re.sub(r"^(\w+):/+", r"\1:///", r["path"]))
                with system.open_input_stream(name) if r["size"] is None else system.open_input_file(name) as file:
                    yield from _fastq_batches(_lines(file, r["start"], r["size"]), r["start"], None if r["size"] is None else r["start"] + r["size"])

    return ranges.mapInArrow(run, "id string, seq string, qual string")


def _lines(file, start: int, size: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin at or after ``start``, without their ends. ``size``: bytes that the range
    holds; what is read beyond them, for its last record, comes in smaller pieces."""
    at, rest = start, b""
    if start:
        file.seek(start - 1)
        at -= 1
    skip, left = start > 0, size
    while piece := file.read(1 << 20 if left is None else max(1 << 16, min(1 << 20, left))):
        left = None if left is None else left - len(piece)
        *lines, rest = (rest + piece).split(b"\n")
        for line in lines:
            if not skip:
                yield at, line.removesuffix(b"\r")
            skip, at = False, at + len(line) + 1
    if rest and not skip:
        yield at, rest.removesuffix(b"\r")


def _fastq_batches(lines: Iterator[tuple[int, bytes]], start: int, end: int | None, size: int = 10_000, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, out, n_bytes = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i].decode("ascii") for x in out], pa.string()) for i in range(3)], names=["id", "seq", "qual"])

    synced = start == 0
    for place, line in lines:
        held.append((place, line))
        if not synced:
            if len(held) < 3:
                continue
            if not (held[0][1].startswith(b"@") and held[2][1].startswith(b"+")):
                held.pop(0)
                continue
            synced = True
        if end is not None and held and held[0][0] >= end:
            break
        if len(held) == 4:
            (_, head), (_, seq), (_, plus), (_, qual) = held
            if not head.startswith(b"@") or not plus.startswith(b"+") or len(seq) != len(qual):
                raise ValueError("not a FASTQ file of four-line records")
            out.append((head[1:].split(b" ")[0], seq, qual))
            n_bytes += 2 * len(seq)
            held = []
            if len(out) == size or n_bytes >= most_bytes:
                yield batch()
                out, n_bytes = [], 0
    else:
        if synced and any(line for _, line in held):
            raise ValueError("not a FASTQ file of four-line records")
    if out:
        yield batch()


def phred(qual: Column) -> Column:
    """Quality characters as Phred scores."""
    return F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), lambda c: (F.ascii(c) - 33).cast("smallint"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """name, pos, cigar of SAM text; header lines are dropped (SRC3)."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != "")).select(F.split("value", "\t").alias("f"))
    return rows.select(F.get("f", 0).alias("name"), F.get("f", 3).cast("int").alias("pos"), F.get("f", 5).alias("cigar"))


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """segments (name, seq) and links (from_name, from_orient, to_name, to_orient) of a segment graph (SRC4)."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    segments = rows.filter(F.get("f", 0) == "S").select(F.get("f", 1).alias("name"), F.get("f", 2).alias("seq"))
    links = rows.filter(F.get("f", 0) == "L").select(*[F.get("f", i + 1).alias(c) for i, c in enumerate(("from_name", "from_orient", "to_name", "to_orient"))])
    return segments, links


def oriented_edges(links: DataFrame) -> DataFrame:
    """(a, b) between oriented segments ``>name`` and ``<name``: each link as it is read forward and backward."""
    side = lambda name, orient, plus, minus: F.concat(F.when(F.col(orient) == "+", plus).otherwise(minus), F.col(name))
    forward = links.select(side("from_name", "from_orient", ">", "<").alias("a"), side("to_name", "to_orient", ">", "<").alias("b"))
    backward = links.select(side("from_name", "from_orient", "<", ">").alias("a"), side("to_name", "to_orient", "<", ">").alias("b"))
    return forward.unionByName(backward).distinct()


def graph_endpoints(links: DataFrame) -> DataFrame:
    """(segment, end): oriented segments that links only reach (``last``) or only leave (``first``); what PRJ2 asks for."""
    edges = oriented_edges(links)
    ends = edges.select(F.col("a").alias("segment"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("b").alias("segment"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    per = ends.groupBy("segment").agg(F.max("out").alias("out"), F.max("in").alias("in"))
    return per.filter("out + in = 1").select("segment", F.when(F.col("out") == 1, "first").otherwise("last").alias("end"))


def forward_segments(links: DataFrame) -> DataFrame:
    """(segment): the oriented segments of the connected part that holds the most forward ones, ties to the part of the
    smallest name; what PRJ1 asks for. Rounds grow with the logarithm of the graph's length (``connected_parts``)."""
    part = written(connected_parts(oriented_edges(links), "a", "b").withColumnRenamed("node", "segment"), "parts")
    sizes = part.groupBy("part").agg(F.sum(F.when(F.col("segment").startswith(">"), 1).otherwise(0)).alias("n"))
    best = sizes.agg(F.min(F.struct((-F.col("n")).alias("m"), "part")).alias("best")).select(F.col("best.part").alias("part"))
    return part.join(F.broadcast(best), "part", "left_semi").select("segment")


def read_parquet_widened(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files of differing schemas, their columns merged (SRC5)."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def read_tables(spark: SparkSession, path: str, pattern: str, into: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Tab-separated tables with a header, and a column drawn from the file's name (SRC6)."""
    reader = spark.read.option("sep", "\t").option("header", True)
    reader = reader.schema(schema) if schema else reader
    return reader.csv(path).withColumn(into, F.regexp_extract(F.input_file_name(), pattern, 1))


def file_metadata(spark: SparkSession, path: str, pattern: str, names: Sequence[str], one_based: Sequence[str] = (), first_by: Sequence[str] = ()) -> DataFrame:
    """Numbers parsed out of file names, rebased to 0 where asked, and the first path per key (SRC7). No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    cols = {n: (F.regexp_extract("path", pattern, i + 1).try_cast("int") - (1 if n in set(one_based) else 0)) for i, n in enumerate(names)}
    rows = files.withColumns(cols).filter(F.regexp_like("path", F.lit(pattern)))
    return rows.groupBy(*first_by).agg(*[F.min_by(c, "path").alias(c) for c in [n for n in names if n not in set(first_by)]], F.min("path").alias("path")) if first_by else rows
