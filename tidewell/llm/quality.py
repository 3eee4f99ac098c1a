"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text becomes hashed counts of byte trigrams, once as written (case folded) and once by the shape of each byte (small or
capital letter, digit, each sign of its own), and of repeated words. Rarity weights are counted over all documents, and
the latent directions are those of all documents: each task adds its rows up against a fixed random matrix, and the sums,
of a fixed size, give the leading directions (Nystroem's approximation of the Gram matrix). Labelled documents are sent to
all tasks as latent vectors; every document meets all of them in blocked cosine products, and its nearest ones vote with
the weight of their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collocations import _KIND, tokens
from .common import free_name, written
from .toxicity import held_out

#: Hashed terms of each of the two kinds of trigrams; terms for repetition; latent directions, and random ones tried for them.
TERMS = 1024
REPEATS = 3
WIDTH = 2 * TERMS + REPEATS
LATENT = 48
TRIED = 80
#: Weight of written trigrams, shapes and repetition, each of which has length one.
WEIGHTS = (0.6, 1.0, 1.0)
#: Bytes and rows that are cut at a time, and rows that meet all labelled vectors at a time.
CHUNK = 4_000_000
ROWS = 1024
BLOCK = 256


def _shapes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for chars, kind in ((range(ord("a"), ord("z") + 1), ord("a")), (range(ord("A"), ord("Z") + 1), ord("A")), (range(ord("0"), ord("9") + 1), ord("0")), (range(128, 256), 128)):
        table[list(chars)] = kind
    return table


_SHAPE = _shapes()
_FOLDED = np.arange(256, dtype=np.uint32)
_FOLDED[ord("A") : ord("Z") + 1] += 32


def _trigrams(codes: np.ndarray, doc: np.ndarray, inside: np.ndarray, n: int) -> np.ndarray:
    """Counts of hashed trigrams, a row for each document."""
    at = (codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA6B)) ^ (codes[2:] * np.uint32(0xC2B2AE35))
    at = (at * np.uint32(0x27D4EB2F)) >> np.uint32(22)
    return np.bincount((doc * TERMS + at)[inside], minlength=n * TERMS).reshape(n, TERMS)


def term_rows(texts: pa.Array) -> np.ndarray:
    """One row for each text: the square roots of its terms' shares, each kind of length one (zero for texts without any)."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    out = np.zeros((n, WIDTH), np.float32)
    if offsets[-1] == offsets[0]:
        return out
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    doc = np.repeat(np.arange(n), np.diff(offsets))
    if len(data) > 2:
        inside = doc[2:] == doc[:-2]
        for k, table in enumerate((_FOLDED, _SHAPE)):
            out[:, k * TERMS : (k + 1) * TERMS] = _trigrams(table[data], doc[:-2], inside, n)
    coded, _ = tokens(texts)
    words = coded.indices.to_numpy()
    if len(words):
        of = _documents_of_words(data, offsets - offsets[0])
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        total = np.bincount(of, minlength=n)
        same = np.bincount(of[again], minlength=n)
        kinds = np.unique(of * np.int64(len(coded.dictionary)) + words)
        different = np.bincount(kinds // len(coded.dictionary), minlength=n)
        out[:, 2 * TERMS :] = np.stack([total - same, same, np.maximum(total - different - same, 0) * (total > 1)], 1)
    for a, b in ((0, TERMS), (TERMS, 2 * TERMS), (2 * TERMS, WIDTH)):
        part = out[:, a:b]
        np.sqrt(part / np.maximum(part.sum(1, keepdims=True), 1), out=part)
    return out


def _documents_of_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each word that ``tokens`` finds, the text it is of."""
    word = _KIND[data] == 0
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | begins[1:-1]
    return np.searchsorted(offsets, np.flatnonzero(start), "right") - 1


def _runs(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of at most ROWS texts and about CHUNK bytes; null texts are empty."""
    texts = texts.fill_null("")
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64))
    at = np.cumsum(size) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        for s in range(a, b, ROWS):
            yield texts.slice(s, min(ROWS, b - s))


def _summed(partial: DataFrame, shape: tuple[int, ...], at_once: int = 256) -> np.ndarray:
    """Sums of arrays of one shape, one packed row a task, in rounds of ``at_once``; one array reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), "<f8").reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    rows = written(partial, "sums")
    n = rows.count()
    while n > 1:
        n = -(-n // at_once)
        rows = written(rows.repartition(n).mapInArrow(add, "sums binary"), "sums")
    found = rows.first()
    return np.frombuffer(found["sums"], "<f8").reshape(shape) if found else np.zeros(shape)


@dataclass
class Space:
    """What all documents give: weights of terms, and the latent directions."""

    weight: np.ndarray
    basis: np.ndarray

    def weighted(self, rows: np.ndarray) -> np.ndarray:
        return unit(rows * self.weight)

    def latent(self, texts: pa.Array) -> np.ndarray:
        return unit(self.weighted(term_rows(texts)) @ self.basis)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows**2).sum(1, keepdims=True)), np.float32(1e-12))


def directions(sketch: np.ndarray, tried: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` leading eigenvectors of a Gram matrix from its product with ``tried``."""
    core = tried.T @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-9
    if not good.any():
        return np.zeros((len(sketch), n), np.float32)
    left, _, _ = np.linalg.svd(sketch @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    out = np.zeros((len(sketch), n), np.float32)
    out[:, : min(n, left.shape[1])] = left[:, :n]
    return out


def fit_space(docs: DataFrame) -> Space:
    """Term weights and latent directions over all documents; arrays of fixed sizes reach the driver."""
    spark, texts = docs.sparkSession, docs.select("text")

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WIDTH + 1)
        for batch in batches:
            for run in _runs(batch.column(0)):
                total[:-1] += (term_rows(run) > 0).sum(0)
                total[-1] += len(run)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    counts = _summed(texts.mapInArrow(present, "sums binary"), (WIDTH + 1,))
    weight = np.log1p(counts[-1] / (1 + counts[:-1])) * np.repeat(WEIGHTS, (TERMS, TERMS, REPEATS))
    weight[2 * TERMS :] = WEIGHTS[2] * np.log1p(1)  # repetition is no matter of rarity
    tried = np.linalg.qr(np.random.default_rng(7).standard_normal((WIDTH, TRIED)))[0]
    shared = spark.sparkContext.broadcast((weight.astype(np.float32), tried.astype(np.float32)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, total = Space(*shared.value), np.zeros((WIDTH, TRIED))
        for batch in batches:
            for run in _runs(batch.column(0)):
                rows = space.weighted(term_rows(run))
                total += rows.T @ (rows @ space.basis)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = _summed(texts.mapInArrow(sketch, "sums binary"), (WIDTH, TRIED))
    return Space(weight.astype(np.float32), directions(sums, tried, LATENT))


@dataclass
class Voters:
    """Labelled documents as latent vectors of length one, with their labels, and the share of label one."""

    vectors: np.ndarray
    labels: np.ndarray

    def scores(self, rows: np.ndarray, k: int = 25, power: int = 8) -> np.ndarray:
        """The nearest ``k`` vote with their cosine to this power; rows without a direction get the share of label one."""
        share = self.labels.mean() if len(self.labels) else 0.5
        out = np.full(len(rows), share)
        for s in range(0, len(rows) if len(self.labels) else 0, BLOCK):
            cosine = rows[s : s + BLOCK] @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:] if k < cosine.shape[1] else np.broadcast_to(np.arange(cosine.shape[1]), cosine.shape)
            w = np.clip(np.take_along_axis(cosine, near, 1).astype(float), 0, 1) ** power
            out[s : s + BLOCK] = ((w * self.labels[near]).sum(1) + 1e-9 * share) / (w.sum(1) + 1e-9)
        return np.round(out, 6)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 10_000) -> tuple[Space, Voters]:
    """The space of all documents, and the voters: of the labelled documents outside the held-out fold a hash sample of
    about ``max_labelled`` at most, each text once with the mean of its labels. Their vectors reach the driver."""
    space = fit_space(docs)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    n = known.count()
    if n > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").filter(F.length("text") > 0).select("text", "label")
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [v.tobytes() for run in _runs(batch.column(0)) for v in shared.value.latent(run).astype("<f4")]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(packed, pa.binary())], names=["key", "label", "vector"])

    coded = sample.select("text", F.sha2("text", 256).alias("key"), "label").mapInArrow(vectors, "key string, label double, vector binary")
    rows = coded.groupBy("key").agg(F.avg("label").alias("label"), F.max("vector").alias("vector")).orderBy("key").collect()
    found = np.array([np.frombuffer(r["vector"], "<f4") for r in rows], np.float32).reshape(-1, LATENT)
    return space, Voters(found, np.array([r["label"] for r in rows], float))


def score_documents(docs: DataFrame, space: Space, voters: Voters, into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``: from 0 to 1, higher where neighbours have label one. Whole texts count; null and
    empty ones get the share of label one among the voters (a half without any). Other columns stay as they are."""
    models = docs.sparkSession.sparkContext.broadcast((space, voters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, voters = models.value
        for batch in batches:
            scores = [voters.scores(space.latent(x)) for x in _runs(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([np.empty(0), *scores]), pa.float64())], names=[*batch.schema.names, own])

    own = free_name(docs, "_score")
    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own, T.DoubleType())]))
    return out.drop(into).withColumnRenamed(own, into)  # a column of that name, in upper or lower case, is replaced
