"""Counts of bases by position, as packed matrices (AGG4, AGG5)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions in a row of the matrix table, characters counted at a time, bytes of packed counts merged at a time.
SPAN = 1024
CHARS = 1_000_000
MERGED = 6_000_000


def _summed(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        return np.unique(key, return_counts=True)
    key, at = np.unique(key, return_inverse=True)
    return key, np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)


def count_matrices(df: DataFrame, group: Sequence[str], seq: str) -> DataFrame:
    """group, block, cells, counts: of each task, group and run of SPAN positions how often each character stands at each
    place. ``cells`` packs (place in the run << 21 | code point) as int32, ``counts`` int64. Counts of one group and block
    from several rows add up. Null and empty sequences count nowhere."""
    group = list(group)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            pdf = pdf[pdf[seq].str.len() > 0]
            chars = np.cumsum(pdf[seq].str.len().to_numpy(np.int64)) // CHARS
            for _, part in pdf.groupby(chars, sort=False):
                size = part[seq].str.len().to_numpy(np.int64)
                code = np.frombuffer("".join(part[seq]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
                of = part.groupby(group, sort=False, dropna=False).ngroup().to_numpy(np.int64) if group else np.zeros(len(part), np.int64)
                blocks = int(place.max()) // SPAN + 1
                run, at = np.unique(np.repeat(of, size) * blocks + place // SPAN, return_inverse=True)
                key, n = _summed(at.astype(np.int64) << 31 | (place % SPAN) << 21 | code)
                cut = np.searchsorted(key >> 31, np.arange(len(run) + 1))
                cells = (key & ((1 << 31) - 1)).astype("<i4")
                out = part[group].iloc[np.unique(of, return_index=True)[1][run // blocks]].reset_index(drop=True)
                out["block"] = (run % blocks).astype(np.int32)
                out["cells"] = [cells[a:b].tobytes() for a, b in zip(cut, cut[1:])]
                out["counts"] = [n[a:b].astype("<i8").tobytes() for a, b in zip(cut, cut[1:])]
                held.append(out)
                if sum(map(len, chain.from_iterable(x["cells"] for x in held))) > MERGED:
                    yield _packed(pd.concat(held, ignore_index=True), [*group, "block"])
                    held = []
        if held:
            yield _packed(pd.concat(held, ignore_index=True), [*group, "block"])

    kinds = ", ".join([*[f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group], "block int, cells binary, counts binary"])
    return df.select(*group, seq).mapInPandas(count, kinds)


def _merged(pdf: pd.DataFrame, key: Sequence[str]) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The rows' distinct keys, and for all their cells (row << 31 | cell) and counts, in order."""
    of = pdf.groupby(list(key), sort=False, dropna=False).ngroup().to_numpy(np.int64)
    size = pdf["cells"].map(len).to_numpy() // 4
    cells = np.frombuffer(b"".join(pdf["cells"]), "<i4").astype(np.int64)
    cell, n = _summed(np.repeat(of, size) << 31 | cells, np.frombuffer(b"".join(pdf["counts"]), "<i8"))
    return pdf[list(key)].iloc[np.unique(of, return_index=True)[1]].reset_index(drop=True), cell, n


def _packed(pdf: pd.DataFrame, key: Sequence[str]) -> pd.DataFrame:
    out, cell, n = _merged(pdf, key)
    cut = np.searchsorted(cell >> 31, np.arange(len(out) + 1))
    cells, n = (cell & ((1 << 31) - 1)).astype("<i4"), n.astype("<i8")
    return out.assign(cells=[cells[a:b].tobytes() for a, b in zip(cut, cut[1:])], counts=[n[a:b].tobytes() for a, b in zip(cut, cut[1:])])


def _pieces(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows in turn, some MERGED bytes of packed counts at a time."""
    piece = np.cumsum(pdf["cells"].map(len).to_numpy(np.int64) * 3) // MERGED
    cut = [0, *(np.flatnonzero(np.diff(piece)) + 1), len(pdf)]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield pdf.iloc[a:b]


def _by_key(matrices: DataFrame, key: Sequence[str], make, schema: str) -> DataFrame:
    """``make`` of the rows of whole keys, some MERGED bytes at a time. A key's rows are added up as they come, some MERGED
    bytes at a time too: a batch counts rows, and each may hold a megabyte."""
    key = list(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in chain.from_iterable(map(_pieces, batches)):
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            number = pdf.groupby(key, sort=False, dropna=False).ngroup().to_numpy()  # rows come by key
            weight = np.cumsum(np.bincount(number, weights=pdf["cells"].map(len) * 3))[number] // MERGED
            open_ = number == number[-1]
            for w in np.unique(weight[~open_]):
                yield make(pdf[~open_ & (weight == w)])
            held = _packed(pdf[open_], key)
        if held is not None:
            yield make(held)

    return matrices.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, schema)


def over_matrices(matrices: DataFrame, group: Sequence[str], reduce, schema: str) -> DataFrame:
    """group, block and what ``reduce(row, place, code, n)`` makes of each group and block: it gets the cells of several
    blocks at once, in order of row, place and code point, and returns columns with an entry for each row. Where many
    tasks have counted, rows of a group and block are first added up in 256 parts of the tasks."""
    key = [*group, "block"]
    kinds = ", ".join(f"`{c}` {matrices.schema[c].dataType.simpleString()}" for c in key)
    if matrices.rdd.getNumPartitions() > 256:
        salted = matrices.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(256)))
        matrices = _by_key(salted, [*key, "_salt"], lambda pdf: _packed(pdf, [*key, "_salt"]), f"{kinds}, _salt int, cells binary, counts binary").drop("_salt")

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        out, cell, n = _merged(pdf, key)
        return out.assign(**reduce(cell >> 31, cell >> 21 & (SPAN - 1), cell & ((1 << 21) - 1), n))

    return _by_key(matrices, key, reduced, f"{kinds}, {schema}")


def majority(row: np.ndarray, place: np.ndarray, code: np.ndarray, n: np.ndarray) -> dict:
    """The most frequent character at each place, ties to the smaller code point, as one text a block."""
    at = row * SPAN + place
    order = np.lexsort((code, -n, at))
    first = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
    text = code[first].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    cut = np.searchsorted(row[first], np.arange(row[-1] + 2))
    return {"text": [text[a:b] for a, b in zip(cut, cut[1:])]}


def ambiguous(share: float, pseudo: float):
    """How many places a block has, and at how many the second most frequent character is above ``share``."""

    def reduce(row: np.ndarray, place: np.ndarray, code: np.ndarray, n: np.ndarray) -> dict:
        at = row * SPAN + place
        order = np.lexsort((-n, at))
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        end = np.append(first[1:], len(order))
        second = np.where(end - first > 1, n[order][np.minimum(first + 1, len(order) - 1)], 0)
        f = (second + pseudo) / (np.add.reduceat(n[order], first) + pseudo)
        rows = row[order][first]
        return {"places": np.bincount(rows), "ambiguous": np.bincount(rows, weights=f > share).astype(np.int64)}

    return reduce
