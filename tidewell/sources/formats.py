"""Alignments and reads as formats of Spark's reader: ``spark.read.format("gaf")`` and ``format("fastq")`` (SRC1, SRC2).

``register(spark)`` makes both known. Files are cut into byte ranges (``range_bytes``), each a task's. The schema is found on the first line;
a schema that is given names the columns to make, and no others are parsed. Comparisons with constants are pushed down to
the lines, where ``spark.sql.python.filterPushdown.enabled`` is set, which ``register`` does.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.pandas.types import to_arrow_schema

from .text_formats import ARRAY_TYPES, GAF_COLUMNS, TAG_TYPES, RANGE_BYTES, _fastq_batches, _lines, discover_tags, range_bytes

ROWS = 10_000
_CHECKS: dict[type, Callable] = {
    EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le,
    In: lambda x, among: x in among, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__, IsNotNull: lambda x, _: True,
}


class Range(InputPartition):
    """The bytes [start, end) of a file; end is None for files that cannot be cut."""

    def __init__(self, path: str, start: int, end: int | None) -> None:
        self.path, self.start, self.end = path, start, end


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^(\w+):/+", r"\1:///", path) if re.match(r"\w+:/", path) else f"file://{path}")


def _files(path: str) -> Iterator[tuple[pa.fs.FileSystem, str, int]]:
    """The files at a path or below it, by name; names that begin with _ or . are not data."""
    system, name = _open(path)
    info = system.get_file_info(name)
    found = [info] if info.is_file else system.get_file_info(pa.fs.FileSelector(name, recursive=True))
    for f in sorted(found, key=lambda f: f.path):
        if f.is_file and f.size and f.base_name[0] not in "_.":
            yield system, f.path, f.size


def _first_line(path: str) -> str | None:
    for system, name, _ in _files(path):
        with system.open_input_stream(name) as file:
            for _, line in _lines(file, 0):
                if line:
                    return line.decode()
    return None


class RangeReader(DataSourceReader):
    """Reads ranges of text files; a format says how a range becomes records, and how a record gives a column."""

    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.path, self.schema = options["path"], schema
        self.split = int(options.get("splitBytes", RANGE_BYTES))
        self.checks: list[tuple[str, Callable, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _CHECKS and name in self.schema.names and not isinstance(self.schema[name].dataType, (T.ArrayType, T.FloatType, T.DoubleType)):
                self.checks.append((name, _CHECKS[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        out, files = [], list(_files(self.path))
        split = range_bytes(self.split, sum(size for _, _, size in files))
        for _, name, size in files:
            whole = name.endswith(".gz")
            out += [Range(name, 0, None)] if whole else [Range(name, s, s + split) for s in range(0, size, split)]
        return out

    def records(self, part: Range) -> Iterator:
        raise NotImplementedError

    def getter(self, name: str, kind: T.DataType) -> Callable:
        raise NotImplementedError

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        getters = {f.name: self.getter(f.name, f.dataType) for f in self.schema.fields}
        checks = [(getters[name], check, value) for name, check, value in self.checks]
        rows: list[list] = []
        for r in self.records(part):
            values = [get(r) for get, _, _ in checks]
            if any(x is None or not check(x, value) for x, (_, check, value) in zip(values, checks)):
                continue
            rows.append([get(r) for get in getters.values()])
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def lines(self, part: Range) -> Iterator[tuple[int, bytes]]:
        system, _ = _open(self.path)
        with system.open_input_stream(part.path) if part.end is None else system.open_input_file(part.path) as file:
            yield from _lines(file, part.start, None if part.end is None else part.end - part.start)


class GafReader(RangeReader):
    """Lines are records; a range owns those that begin in it."""

    def records(self, part: Range) -> Iterator[tuple[list[str], list[str]]]:
        for at, line in self.lines(part):
            if part.end is not None and at >= part.end:
                return
            if line:
                fields = line.decode().split("\t")
                yield fields, [*fields[0].split(" ")[1:], *fields[len(GAF_COLUMNS) :]]

    def getter(self, name: str, kind: T.DataType) -> Callable:
        fixed = {n: (i, k) for i, (n, k) in enumerate(GAF_COLUMNS)}
        if name in fixed:
            i, of = fixed[name]
            if name == "name":
                return lambda r: r[0][0].split(" ")[0]
            if of == "path":
                return lambda r: re.findall(r"[<>][^<>]+", r[0][i]) if r[0][i] != "*" else None
            return (lambda r: int(r[0][i])) if isinstance(kind, T.IntegralType) else lambda r: r[0][i]
        head = f"{name}:"
        make = float if isinstance(kind, T.FractionalType) else int if isinstance(kind, T.IntegralType) else str
        if isinstance(kind, T.ArrayType):
            item = float if isinstance(kind.elementType, T.FractionalType) else int
            make = lambda x: [item(v) for v in x.split(",")[1:]]
        return lambda r: next((make(f.split(":", 2)[2]) for f in r[1] if f.startswith(head)), None)


class FastqReader(RangeReader):
    """Records of four lines; a range owns those that begin in it."""

    def records(self, part: Range) -> Iterator[tuple[str, str, str]]:
        for batch in _fastq_batches(self.lines(part), part.start, part.end):
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def getter(self, name: str, kind: T.DataType) -> Callable:
        return operator.itemgetter(("id", "seq", "qual").index(name))


class GafSource(DataSource):
    """Graph alignments: the fixed columns, and a column for each tag of the first line. Options: splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "gaf"

    def schema(self) -> str:
        line = _first_line(self.options["path"])
        out = [f"`{name}` {'array<string>' if kind == 'path' else kind}" for name, kind in GAF_COLUMNS]
        for tag, kind, of in discover_tags(line, len(GAF_COLUMNS)) if line else ():
            out.append(f"`{tag}` array<{ARRAY_TYPES[of]}>" if kind == "B" else f"`{tag}` {TAG_TYPES[kind]}")
        return ", ".join(out)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return GafReader(self.options, schema)


class FastqSource(DataSource):
    """Reads: id, seq, qual. Options: splitBytes. Gzipped files are one range each."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "id string, seq string, qual string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FastqReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the formats ``gaf`` and ``fastq`` known to a session, and has it push filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GafSource, FastqSource):
        spark.dataSource.register(source)
