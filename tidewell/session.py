"""Session and table helpers shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read lazily by path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir. Where it is unset, a local master
    takes a new local one; a cluster has no such folder, so that is an error there."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def json_bytes(df: DataFrame) -> int:
    """What the rows measure as JSON text, with 64 bytes for each row besides: a size to decide broadcasts by."""
    return df.agg(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + 64)).first()[0] or 0


def sized_broadcast(df: DataFrame, limit_bytes: int = 32_000_000) -> DataFrame:
    """``df`` marked for broadcast where it measures at most so many bytes; else as it is, for a shuffled join."""
    return F.broadcast(df) if json_bytes(df) <= limit_bytes else df
