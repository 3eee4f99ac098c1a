"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Tasks of one shuffle, at most, as a power of two: ranges beyond that are dealt to them, several each.
MOST_TASK_BITS = 14
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master takes a new
    local one; a cluster has no such folder, so that is an error there."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, and survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z only; lower() would also fold other scripts."""
    return F.translate(text, UPPER, UPPER.lower())


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or the same with underscores before it, so that it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def hash60(*keys: Column) -> Column:
    """60 bits of the md5 of these values as text, as a long; nulls have a text of their own. Other engines can follow."""
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("\\N")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def json_bytes(df: DataFrame) -> int:
    """What the rows measure as JSON text, with 64 bytes for each row besides: a size to decide broadcasts by."""
    return df.agg(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + 64)).first()[0] or 0


def small(df: DataFrame, limit_bytes: int = 32_000_000) -> DataFrame:
    """``df`` with a hint to broadcast it where it measures at most so many bytes; joins shuffle it otherwise."""
    return F.broadcast(df) if json_bytes(df) <= limit_bytes else df


def running_total(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: str,
    into: str,
    rows_per_bucket: int = 4_000,
    ties: Sequence[str] = (),
    most_buckets: int = 1_000_000,
) -> DataFrame:
    """Adds ``into``: the sum of ``value`` over the rows that come before within ``group``.

    The order is by ``hash60`` of the ``order`` columns, then by those columns and ``ties``. Each group is cut into as many equal
    parts of the hash's range as its rows ask for, so a group that holds most rows still spreads over tasks: bucket sums
    are added up first (one row a bucket), then each bucket adds up its own rows from there. Beyond about
    ``most_buckets`` the buckets grow. ``df`` is read twice; hand in a written table.
    """
    h, b, n = (free_name(df, x) for x in ("_h", "_b", "_n"))
    share = max(rows_per_bucket, -(-df.count() // most_buckets))
    loads = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / share).cast("long").alias(n))
    same = lambda left, right, names: [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in names]
    rows = df.withColumn(h, hash60(*[F.col(f"`{c}`") for c in order])).alias("r").join(small(loads).alias("l"), same("r", "l", group))
    rows = rows.select("r.*", F.shiftright(F.shiftright(F.col(f"r.{h}"), 30) * F.col(f"l.{n}"), 30).alias(b))
    base = free_name(df, "_base")
    sums = rows.groupBy(*group, b).agg(F.sum(value).alias(base))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    inside = Window.partitionBy(*group, b).orderBy(h, *order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(into, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = rows.alias("r").join(sums.alias("s"), same("r", "s", [*group, b]), "inner")
    kept = [F.col(f"r.`{c}`") for c in df.columns]
    return joined.select(*kept, (F.col(f"r.{into}") + F.col(f"s.{base}")).alias(into))


def integral_type(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
