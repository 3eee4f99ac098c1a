"""Writers (SNK1-7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def fastx_record(name: Column, seq: Column, scores: Column | None = None) -> Column:
    """A FASTA record, or FASTQ with Phred scores; without a name, seq_<hash of the sequence>."""
    name = F.coalesce(name, F.concat(F.lit("seq_"), F.hex(F.xxhash64(seq))))
    if scores is None:
        return F.concat_ws("\n", F.concat(F.lit(">"), name), seq)
    qual = F.array_join(F.transform(scores, lambda q: F.char(q + 33)), "")
    return F.concat_ws("\n", F.concat(F.lit("@"), name), seq, F.lit("+"), qual)


def write_fastx(df: DataFrame, path: str, name: str = "name", seq: str = "seq", scores: str | None = None) -> None:
    """Text files of records (SNK2)."""
    df.select(fastx_record(F.col(name), F.col(seq), F.col(scores) if scores else None).alias("value")).write.text(path)


def write_pairs(df: DataFrame, path: str, a: str, b: str) -> None:
    """Two names a line, a space between (SNK3)."""
    df.select(a, b).write.option("sep", " ").csv(path, header=False)


def write_split(df: DataFrame, path: str, keys: Sequence[str], chunks: int = 0) -> None:
    """Rows in a folder per key tuple, or per hash bucket of it (SNK4). Rows go to their bucket's task by key, and hot
    buckets are split by adaptive rebalancing."""
    if chunks:
        df = df.withColumn("chunk", F.pmod(F.xxhash64(*keys), F.lit(chunks)).cast("int"))
    by = ["chunk"] if chunks else list(keys)
    df.hint("rebalance", *by).write.partitionBy(*by).parquet(path)


#: Files by bytes that one task writes.
FILES_PER_TASK = 64


def write_chunked(df: DataFrame, path: str, rows: int | None = None, files: int | None = None, max_bytes: int | None = None) -> None:
    """Files of so many rows, so many files, or files of so many bytes at most as JSON text, but for rows larger than that
    (Parquet is smaller): one of the three (SNK5). By bytes, a task writes many files one after the other, each of as many
    of the largest rows as fit; where rows are of uneven size, those of one power of two are written together."""
    if sum(x is not None for x in (rows, files, max_bytes)) != 1:
        raise ValueError("give rows, files or max_bytes")
    if rows:
        df.write.option("maxRecordsPerFile", rows).parquet(path)
        return
    if files:
        df.repartition(files).write.parquet(path)
        return
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + 1  # a line
    power = F.floor(F.log2(size.cast("double"))).cast("int")
    sizes = df.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("largest"), F.sum(size).alias("total")).collect()  # at most 31 rows
    n, largest, total = sum(r["n"] for r in sizes), max((r["largest"] for r in sizes), default=1), sum(r["total"] for r in sizes)
    df.limit(0).write.parquet(path)
    even = n * largest <= 2 * total
    for p, n, largest in [(None, n, largest)] if even else sorted((r["p"], r["n"], r["largest"]) for r in sizes):
        per = max(1, max_bytes // largest)
        part = df if even else df.filter(power == p)
        part.repartition(max(1, -(-n // (per * FILES_PER_TASK)))).write.mode("append").option("maxRecordsPerFile", per).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Only the partitions that ``df`` has are replaced (SNK6, STR4)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


#: The folder of a table's file index; readers pass over names that begin with an underscore.
KEY_INDEX = "_key_index"


def write_key_ranges(df: DataFrame, path: str, key: Sequence[str], files: int) -> None:
    """Files that each hold a range of the key, in order, and beside them an index of the files: name, rows, smallest and
    largest key (SNK7). ``read_key_range`` opens only the files that a range of keys asks for."""
    df.repartitionByRange(files, *key).sortWithinPartitions(*key).write.parquet(path)
    keys = F.struct(*key)
    rows = df.sparkSession.read.parquet(path).select(F.regexp_extract("_metadata.file_path", "[^/]+$", 0).alias("file"), keys.alias("k"))
    rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("k").alias("lo"), F.max("k").alias("hi")).coalesce(1).write.parquet(f"{path}/{KEY_INDEX}")  # a row a file


def read_key_range(spark: SparkSession, path: str, lo: Sequence, hi: Sequence) -> DataFrame:
    """Rows of a table that ``write_key_ranges`` wrote whose key is from ``lo`` to ``hi``, both included (SNK7). The index
    names the files to open; no other is listed or read. ``lo`` and ``hi`` may be the first parts of a longer key."""
    index = spark.read.parquet(f"{path}/{KEY_INDEX}")
    key = index.schema["lo"].dataType.names
    part = lambda c, n: F.struct(*[F.col(f"{c}.`{k}`") if c else F.col(f"`{k}`") for k in key[:n]])
    given = lambda values: F.struct(*[F.lit(v).cast(index.schema["lo"].dataType[k].dataType).alias(k) for k, v in zip(key, values)])
    wanted = index.filter((part("hi", len(lo)) >= given(lo)) & (part("lo", len(hi)) <= given(hi)))
    files = sorted(r["file"] for r in wanted.select("file").collect())
    rows = spark.read.parquet(*[f"{path}/{f}" for f in files]) if files else spark.read.parquet(path).limit(0)
    rows = rows.filter((F.col(f"`{key[0]}`") >= F.lit(lo[0])) & (F.col(f"`{key[0]}`") <= F.lit(hi[0])))  # the scan can skip row groups by this
    return rows.filter((part("", len(lo)) >= given(lo)) & (part("", len(hi)) <= given(hi)))
