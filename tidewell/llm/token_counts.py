"""Edit-aware token counts.

A document's pre-tokens stand in segments, the leaves of a tree whose nodes hold the characters and tokens below them.
An edit finds its leaves by descending on characters; pre-tokens are cut anew from the leaf that holds the text just
before the edit (the pattern looks at most two characters past a pre-token) until a cut falls on an old leaf's end again.
Only that stretch is encoded, and only the sums above it change.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens in a leaf, and how far before an edit the cutting starts.
LEAF = 32
CONTEXT = 3
#: A leaf that edits have filled to so many times LEAF is split.
WIDEST = 4
#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder(dict):
    """Token counts of pre-tokens: a bounded memory in front of the byte-pair encoder. ``ranks``: a vocabulary file's bytes."""

    def __init__(self, ranks: bytes, pattern: str, size: int = 400_000) -> None:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.bpe = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.cut, self.size = regex.compile(pattern), size

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.size:
            self.clear()
        n = self[piece] = len(self.bpe.encode_ordinary(piece))
        return n


@lru_cache(2)
def encoder(ranks: bytes, pattern: str) -> Encoder:
    return Encoder(ranks, pattern)


def vocabulary_bytes(path: str | None = None) -> bytes:
    """The vocabulary file, read on the driver; tasks get its bytes, not its path."""
    with open(path or default_vocabulary(), "rb") as f:
        return f.read()


class TokenTree:
    """Leaves of one document, and the sums over them, level by level up to the root. Built from stored levels as is."""

    def __init__(self, chars: Sequence[Sequence[int]] = (), tokens: Sequence[Sequence[int]] = ()) -> None:
        self.chars, self.tokens = ([np.array(x, np.int64) for x in levels] or [np.empty(0, np.int64)] for levels in (chars, tokens))

    @classmethod
    def of_leaves(cls, chars: Sequence[int], tokens: Sequence[int]) -> TokenTree:
        tree = cls([chars], [tokens])
        tree._raise()
        return tree

    def _raise(self) -> None:
        for levels in (self.chars, self.tokens):
            del levels[1:]
            while len(levels[-1]) > 1:
                x = levels[-1]
                levels.append(np.add.reduceat(x, np.arange(0, len(x), 2)))

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[-1].sum())

    @property
    def n_chars(self) -> int:
        return int(self.chars[-1].sum())

    def leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and the leaf's first character; at the end of the text, the last leaf."""
        i = start = 0
        for level in reversed(self.chars[:-1]):
            i *= 2
            if i + 1 < len(level) and at >= start + level[i]:
                start += int(level[i])
                i += 1
        return i, start

    def replace(self, first: int, last: int, enc: Encoder, pieces: list[str]) -> None:
        """Puts these pre-tokens for the leaves first to last - 1.

        The leaves share them evenly, so their number stays and only the sums above them change. Where they would hold
        more than WIDEST times what a new leaf holds, they are split and the levels built anew.
        """
        n = last - first
        if not n or len(pieces) > WIDEST * LEAF * n:
            chars, tokens = leaves_of(enc, pieces)
            for levels, new in ((self.chars, chars), (self.tokens, tokens)):
                levels[0] = np.concatenate([levels[0][:first], np.asarray(new, np.int64), levels[0][last:]])
            self._raise()
            return
        chars, tokens = leaves_of(enc, pieces, max(1, -(-len(pieces) // n)))
        for levels, new in ((self.chars, chars), (self.tokens, tokens)):
            levels[0][first:last] = [*new, *[0] * (n - len(new))]
            a, b = first, last
            for below, level in zip(levels, levels[1:]):
                a, b = a // 2, (b + 1) // 2
                for i in range(a, b):
                    level[i] = below[2 * i : 2 * i + 2].sum()


def leaves_of(enc: Encoder, pieces: list[str], size: int = LEAF) -> tuple[list[int], list[int]]:
    chars, tokens = [], []
    for i in range(0, len(pieces), size):
        part = pieces[i : i + size]
        chars.append(sum(map(len, part)))
        tokens.append(sum(map(enc.__getitem__, part)))
    return chars, tokens


def edit(enc: Encoder, tree: TokenTree, text: str, start: int, end: int, put: str) -> tuple[str, int]:
    """Puts ``put`` for text[start:end], offsets held within the text; the new text and the number of pre-tokens cut anew."""
    start = min(max(start, 0), len(text))
    end = min(max(end, start), len(text))
    new = text[:start] + put + text[end:]
    if not len(tree.chars[0]):
        pieces = enc.cut.findall(new)
        tree.replace(0, 0, enc, pieces)
        return new, len(pieces)
    first, at = tree.leaf_at(max(0, start - CONTEXT))
    shift = len(put) - (end - start)
    last, boundary = first, at
    pieces: list[str] = []
    cut = at
    for m in enc.cut.finditer(new, at):
        pieces.append(m.group())
        cut = m.end()
        while last < len(tree.chars[0]) and (boundary < end or boundary + shift < cut):
            boundary += int(tree.chars[0][last])
            last += 1
        if boundary >= end and boundary + shift == cut and cut >= start + len(put):
            break
    else:
        last = len(tree.chars[0])
    tree.replace(first, last, enc, pieces)
    return new, len(pieces)


LEVELS = pa.list_(pa.list_(pa.int32()))


def build_trees(docs: DataFrame, vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with ``char_sums`` and ``token_sums``: the levels of each text's tree, leaves first, root last. Null and
    empty texts have one empty level. Columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for batch in batches:
            trees = [TokenTree.of_leaves(*leaves_of(enc, enc.cut.findall(t.as_py() or ""))) for t in batch.column("text")]
            lists = [pa.array(x, LEVELS) for x in ([t.chars for t in trees], [t.tokens for t in trees])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "char_sums", "token_sums"])

    base = docs.drop("char_sums", "token_sums")
    return base.mapInArrow(build, f"{_ddl(base)}, char_sums array<array<int>>, token_sums array<array<int>>")


def apply_edits(trees: DataFrame, edits: str = "edits", vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``trees`` after its column ``edits``, array<struct<start:int,end:int,put:string>>, done one after another.

    text, char_sums and token_sums are the new ones; beside them n_tokens_before, n_tokens, n_edits, n_recut
    (pre-tokens cut anew); columns of these names are replaced. Null edits are none, null offsets 0, null insertions
    empty; a null text counts as empty.
    """
    shared = trees.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))
    added = ["n_tokens_before", "n_tokens", "n_edits", "n_recut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("text", "char_sums", "token_sums", edits)}
            texts, chars, tokens, counts = [], [], [], []
            for text, c, t, es in zip(*cols.values()):
                tree, out, recut = TokenTree(c or (), t or ()), text or "", 0
                before = tree.n_tokens
                for e in es or ():
                    out, n = edit(enc, tree, out, e["start"] or 0, e["end"] or 0, e["put"] or "")
                    recut += n
                texts.append(out)
                chars.append(tree.chars)
                tokens.append(tree.tokens)
                counts.append((before, tree.n_tokens, len(es or ()), recut))
            new = {"text": pa.array(texts, pa.string()), "char_sums": pa.array(chars, LEVELS), "token_sums": pa.array(tokens, LEVELS)}
            kept = [new.get(n, batch.column(n)) for n in batch.schema.names]
            counted = [pa.array(x, pa.int64()) for x in zip(*counts)] if counts else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*kept, *counted], names=[*batch.schema.names, *added])

    base = trees.drop(*added)
    return base.mapInArrow(run, f"{_ddl(base)}, {', '.join(f'{a} long' for a in added)}")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def scripted_edits(key: str = "doc_id") -> F.Column:
    """Three edits that follow from a document's id and length: a redaction, an insertion and a deletion."""
    n = F.coalesce(F.length("text"), F.lit(0))
    at = [F.pmod(F.xxhash64(F.col(key), F.lit(i)), n + 1).cast("int") for i in range(3)]
    one = F.struct(at[0].alias("start"), (at[0] + 24).alias("end"), F.lit("[redacted]").alias("put"))
    two = F.struct(at[1].alias("start"), at[1].alias("end"), F.concat(F.lit(" (revised: "), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(")\n")).alias("put"))
    three = F.struct(at[2].alias("start"), (at[2] + 40).alias("end"), F.lit("").alias("put"))
    return F.array(one, two, three)
