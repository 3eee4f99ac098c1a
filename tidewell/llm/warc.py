"""WARC archives: written from pages, read back by a splittable reader.

Each record is a gzip member of its own. Readers are given byte ranges of the files: a task looks for the gzip magic in
its range, takes a place for a member only if the bytes there decode to a WARC header, and owns the records that start
inside its range, reading past its end to finish the last one.

Archives are written by Spark's own writer, so task attempts commit or vanish whole; its line separator is an empty
gzip member, which any gzip reader passes over.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, written

MAGIC = b"\x1f\x8b\x08"
#: A gzip member of no bytes, as ISO-8859-1 text.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + bytes(8)
READ = 1 << 20
#: Up to so many revisits (about 200 bytes each) are broadcast to the pages; beyond that, pages meet them in a join.
BROADCAST_COPIES = 100_000
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.I)


def header_value(text: str | None) -> str:
    """A value on one line: control characters become spaces."""
    return re.sub(r"[\x00-\x1f\x7f]", " ", text or "")


def record(kind: str, headers: list[tuple[str, str]], payload: bytes, level: int = 6) -> bytes:
    """One gzip member that holds one WARC record."""
    lines = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), *(f"{k}: {header_value(v)}".encode() for k, v in headers), b"Content-Length: %d" % len(payload)]
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress(b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n") + gz.flush()


def write_warc(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of ``records`` (record_id string, uri, record_type, refers_to, payload binary, payload_bytes, digest).

    Revisits keep no payload, only its digest and length. Null payloads are empty; null uris are empty.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                headers = [("WARC-Record-ID", f"<urn:record:{r['record_id']}>"), ("WARC-Date", date), ("WARC-Target-URI", r["uri"])]
                headers += [("WARC-Payload-Digest", f"sha256:{r['digest']}"), ("WARC-Payload-Length", str(r["payload_bytes"]))]
                revisit = r["record_type"] == "revisit"
                if revisit:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:record:{r['refers_to']}>")]
                out.append(record(r["record_type"], headers, b"" if revisit else r["payload"] or b""))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    packed = records.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    packed.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(folder)


class Range:
    """Bytes of a file from a place on, read in pieces; what lies before ``pos`` of the buffer is done with."""

    def __init__(self, file, start: int) -> None:
        self.file, self.base, self.buffer, self.pos = file, start, bytearray(), 0
        file.seek(start)

    @property
    def at(self) -> int:
        return self.base + self.pos

    def more(self) -> bool:
        if self.pos > 4 * READ:
            del self.buffer[: self.pos]
            self.base, self.pos = self.at, 0
        got = self.file.read(READ)
        self.buffer += got
        return bool(got)

    def find(self, what: bytes) -> bool:
        """Goes to the next place of ``what``; False at the end of the file."""
        while (found := self.buffer.find(what, self.pos)) < 0:
            self.pos = max(self.pos, len(self.buffer) - len(what) + 1)
            if not self.more():
                return False
        self.pos = found
        return True


def _member(source: Range) -> tuple[bytes, int] | None | bool:
    """The member at the range's place and its length. None if there is none: only a WARC header or nothing counts.
    False where the file ends inside it."""
    gz, out, seen = zlib.decompressobj(31), [], b""
    fed = 0
    while True:
        piece = bytes(memoryview(source.buffer)[source.pos + fed : source.pos + fed + READ])
        if not piece:
            if not source.more():
                return False
            continue
        fed += len(piece)
        try:
            got = gz.decompress(piece)
        except zlib.error:
            return None
        if len(seen) < 7:
            seen += got[: 7 - len(seen)]
            if not b"WARC/1.".startswith(seen):
                return None
        out.append(got)
        if gz.eof:
            return b"".join(out), fed - len(gz.unused_data)


def members_in(file, start: int, end: int) -> Iterator[bytes]:
    """The decoded members that start in [start, end).

    Members follow each other without gaps, up to the end of the file. A candidate found by its magic may stand within
    the payload of a record that holds an archive itself; the chain of members from there breaks where that payload
    ends. So what is found by magic is given out once its chain has reached the range's end and one member beyond, or
    the file's end. An archive within a record is told apart where it ends inside the range.
    """
    source, sure = Range(file, start), start == 0
    chain: list[bytes] = []
    linked = start == 0
    while source.at < end:
        if not linked:
            if not source.find(MAGIC) or source.at >= end:
                break
        member = _member(source)
        if member is False and linked and source.at < end:  # the file ends inside a member that a chain led to
            break
        if not member:
            if linked:  # the chain broke: all of it lay within a payload, unless it began the file
                yield from chain if sure else ()
                chain, linked, sure = [], False, False
            else:
                source.pos += 1
            continue
        linked = True
        source.pos += member[1]
        if member[0]:
            if sure:
                yield member[0]
            else:
                chain.append(member[0])
    if chain and not sure and linked and (source.at >= end):
        rest = _member(source) if source.buffer[source.pos :] or source.more() else True
        if rest is None:
            chain = []
    yield from chain


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes


def parse(member: bytes) -> Record | None:
    """A record, or None where the block is shorter than its header says."""
    head, sep, block = member.partition(b"\r\n\r\n")
    length = _LENGTH.search(head)
    if not sep or not length or len(block) < int(length[1]):
        return None
    pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return Record({k.strip().lower(): v.strip() for k, _, v in pairs}, block[: int(length[1])])


def read_warc(spark: SparkSession, folder: str, split_bytes: int = 4 << 20, glob: str = "part-*") -> DataFrame:
    """Records of all files of a folder: record_id, uri, record_type, refers_to, digest, payload_bytes, payload.

    Files are cut into ranges of ``split_bytes``, which are dealt out over the tasks. Ranges are opened by pyarrow's
    file systems. An empty folder gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length")
    splits = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes))).alias("start"))
    splits = splits.withColumn("end", F.least(F.col("start") + split_bytes, F.col("length")))
    splits = splits.repartitionByRange(max(1, splits.count()), "path", "start")  # a task a range

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "uri", "record_type", "refers_to", "digest", "payload_bytes", "payload"]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for s in batch.to_pylist():
                system, path = pa.fs.FileSystem.from_uri(s["path"] if "://" in s["path"] else re.sub(r"^(\w+):/+", r"\1:///", s["path"]))
                rows, volume = [], 0
                with system.open_input_file(path) as file:
                    for member in members_in(file, s["start"], s["end"]):
                        r = parse(member)
                        if r is None:
                            continue
                        h = r.headers
                        size = h.get("warc-payload-length")
                        rows.append((
                            _id(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), _id(h.get("warc-refers-to")),
                            h.get("warc-payload-digest", "").removeprefix("sha256:") or None, int(size) if size else len(r.payload), r.payload,
                        ))
                        volume += len(r.payload)
                        if volume > 8 * READ:
                            yield batch_of(rows)
                            rows, volume = [], 0
                if rows:
                    yield batch_of(rows)

    return splits.select("path", "start", "end").mapInArrow(read, "record_id string, uri string, record_type string, refers_to string, digest string, payload_bytes long, payload binary")


def _id(value: str | None) -> str | None:
    return value.removeprefix("<urn:record:").removesuffix(">") if value else None


def deduplicated(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Records for ``write_warc`` from pages (page_id, url, html).

    Of equal payloads of at least ``min_bytes`` bytes, the record of the smallest page_id is the response and the
    others revisit it. Smaller payloads, and pages without an id, are all responses; so are rows that repeat the
    smallest id. Null html is an empty payload.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    narrow = pages.filter("page_id is not null").select("page_id", F.sha2(payload, 256).alias("d"), F.octet_length(payload).alias("n")).filter(F.col("n") >= min_bytes)
    first = narrow.groupBy("d").agg(F.min("page_id").alias("first_id"), F.count("page_id").alias("copies")).filter("copies > 1").drop("copies")
    copies = written(narrow.join(first, "d").filter("page_id <> first_id").select(F.col("page_id").alias("p"), "d", "first_id").distinct(), "revisits")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    # payloads go by page, not by digest: no copy that is common makes a large group of payloads
    joined = rows.join(copies, (rows["page_id"] == copies["p"]) & (rows["digest"] == copies["d"]), "left")
    revisit = F.col("first_id").isNotNull()
    return joined.select(
        F.col("page_id").cast("string").alias("record_id"), F.col("url").alias("uri"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id").cast("string")).alias("refers_to"), "payload", "payload_bytes", "digest",
    )


def archived(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """The pages as records, through archives in the shared folder: what ``read_warc`` finds in them."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_warc(deduplicated(pages, min_bytes), folder)
    return read_warc(spark, folder)
