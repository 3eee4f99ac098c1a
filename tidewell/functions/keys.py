"""Keys, hashes, times and ids (SCL9-13, SCL21, SCL27, TOP5)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def composite_key(parts: Sequence[tuple[Column, int]]) -> Column:
    """Zero-padded parts one after another, as text: up to 20 digits, more than a long holds."""
    return F.concat(*[F.lpad(c.cast("string"), n, "0") for c, n in parts])


def path_hash(path: Column) -> Column:
    return F.xxhash64(F.array_join(path, ""))


def hash_group(path: Column, n: int) -> Column:
    """The group of a path among ``n``, from its md5: equal paths share it, and other engines find the same one."""
    return F.pmod(F.conv(F.substring(F.md5(F.array_join(path, "")), 1, 15), 16, 10).cast("long"), F.lit(n)).cast("int")


def names_digest(names: Column) -> Column:
    return F.sha2(F.concat_ws("", names), 256)


def micros(time: Column | str) -> Column:
    """Microseconds since the epoch; a time without a zone counts as one of the session's."""
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def later(time: Column, seconds: Column) -> Column:
    """A timestamp moved by a number of seconds, to the microsecond."""
    return F.timestamp_micros(micros(time) + F.round(seconds * 1_000_000).cast("long"))


def parse_utc(text: Column) -> Column:
    """``2024-01-31T08:00:00.123+00:00`` as a timestamp (SCL11); null where it is not of that form."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX"))


def is_duplex(name: Column) -> Column:
    return name.contains(";")


def parents(name: Column) -> Column:
    return F.split(name, ";")


def integer_if_all(df: DataFrame, column: str) -> DataFrame:
    """The column as int if every value is one, else as it is."""
    odd = df.filter(F.col(column).isNotNull() & F.col(column).try_cast("int").isNull()).limit(1).count()
    return df if odd else df.withColumn(column, F.col(column).try_cast("int"))


def size_between(size: Column, sister: Column, mother: Column) -> Column:
    """A cell's size at birth, between frames: the geometric mean of its mother's last size and of what the mother's
    daughters measure together, as far as the cell has a share in it (SCL22)."""
    both = size + sister
    return F.sqrt(both * mother) * F.try_divide(size, both)


def spherocylinder(length: Column, width: Column) -> tuple[Column, Column]:
    """Volume and surface of a rod with round ends; a length below the width counts as a sphere's."""
    r, rod = width / 2, F.greatest(length - width, F.lit(0.0))
    return math.pi * r * r * rod + 4 / 3 * math.pi * r * r * r, 2 * math.pi * r * rod + 4 * math.pi * r * r


def ancestors(node: Column) -> Column:
    """Ids above a node of a binary lineage whose children are 2n and 2n + 1, nearest first, down to 1."""
    depth = F.floor(F.log2(node.cast("double"))).cast("int")
    steps = F.when(depth >= 1, F.sequence(F.lit(1), depth)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(steps, lambda k: F.floor(node / F.pow(F.lit(2.0), k)).cast("long"))


def descendants(nodes: DataFrame, group: Sequence[str], node: str = "node") -> DataFrame:
    """(group, ancestor, descendant) pairs whose every node in between exists too (SCL27).

    Each node names its ancestors, at most 62 of them; a chain counts as far up as it is unbroken.
    """
    have = nodes.select(*group, node).distinct()
    up = have.select(*group, node, F.posexplode(ancestors(F.col(node))).alias("depth", "ancestor"))
    known = up.join(have.withColumnRenamed(node, "ancestor").withColumn("there", F.lit(True)), [*group, "ancestor"], "left")
    chain = known.groupBy(*group, node).agg(F.array_sort(F.collect_list(F.struct("depth", "ancestor", F.coalesce("there", F.lit(False)).alias("there")))).alias("chain"))
    gap = F.array_min(F.transform(F.filter("chain", lambda x: ~x["there"]), lambda x: x["depth"]))
    linked = F.filter("chain", lambda x: x["depth"] < F.coalesce(F.col("gap"), F.lit(99)))
    return chain.withColumn("gap", gap).select(*group, F.explode(linked).alias("x"), F.col(node).alias("descendant")).select(*group, F.col("x.ancestor").alias("ancestor"), "descendant")
