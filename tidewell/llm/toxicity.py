"""Toxicity scores after noisy-channel deobfuscation.

A token that hides its letters (digits and signs for letters, separators, drawn-out repeats), or a window of neighbouring
pieces that may be one word, whatever blanks part them, is a lattice of what each character, blanks included, may stand
for. Viterbi decoding under a character trigram model, counted over all documents, restores it. A logistic model over
restored words and word beginnings, learnt from labelled documents, scores the restored text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, written

#: The letters of the character model; others count as one more symbol.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöùúûü"
#: What signs and digits may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
BASE = 64
EDGE, OTHER = 0, 1
_CODE = {c: i + 2 for i, c in enumerate(LETTERS)}
_EDGES = ".,;:?\"'()[]{}<>|*#%&~`^=…—–-/\\_«»"
_TAIL = re.compile(r"[^\w\s]{2,}$|!+$")
_DRAWN = re.compile(r"(.)\1\1")
_APART = re.compile(r"(?<!\S)(?:[^\s][ .\-_*]){3,}[^\s](?!\S)")


def _table() -> np.ndarray:
    table = np.full(0x3000, OTHER, np.int64)
    for c, i in _CODE.items():
        table[ord(c)] = i
    table[32] = EDGE
    return table


def trigram_counts(texts: Iterable[str | None]) -> np.ndarray:
    """Counts of character trigrams in the words of these texts, each word once per occurrence; words of letters only."""
    words: Counter[str] = Counter()
    for t in texts:
        if t:
            words.update(t.lower().split())
    kept = [(w, n) for w, n in ((w.strip(_EDGES), n) for w, n in words.items()) if w.isalpha()]
    if not kept:
        return np.zeros(BASE**3)
    joined = "".join(f"  {w} " for w, _ in kept)
    weight = np.repeat([n for _, n in kept], [len(w) + 3 for w, _ in kept])
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    codes = _TABLE[np.minimum(points, len(_TABLE) - 1)]
    at = codes[:-2] * BASE * BASE + codes[1:-1] * BASE + codes[2:]
    ends = codes[2:] + codes[1:-1] > 0
    return np.bincount(at[ends], weights=weight[:-2][ends], minlength=BASE**3)


_TABLE = _table()


@dataclass
class CharModel:
    """Interpolated character trigrams as log probabilities, [first, second, third]."""

    logp: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray) -> CharModel:
        c3 = counts.reshape(BASE, BASE, BASE)
        c2 = c3.sum(0)
        c1 = c2.sum(0)
        p1 = (c1 + 1) / (c1.sum() + BASE)
        p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2) / (c3.sum(2, keepdims=True) + 5)
        return cls(np.log(p3).astype(np.float32))

    def decode(self, token: str) -> str:
        """The most likely words behind ``token``: best path through the lattice of what its characters may stand for.

        A letter stands for itself, or for nothing after its like; a sign or digit for its letters or nothing; a space
        for nothing, or for the end of a word, so that letters set apart are put together into words.
        """
        logp = self.logp
        best: dict[tuple[int, int], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}
        before = ""
        for c in token:
            arcs: list[tuple[str, float]] = []
            if c == " ":
                arcs = [("", 0.0), (" ", 0.0)]
            elif c in _CODE or c.isalpha():
                arcs.append((c, 0.0 if c != before else -0.7))
                if c == before:
                    arcs.append(("", -0.7))
            else:
                arcs += [(x, -0.5 - 0.4 * i) for i, x in enumerate(STANDS_FOR.get(c, ""))]
                arcs.append(("", -1.0 if not arcs else -8.0))
                if c == before:
                    arcs.append(("", -0.7))
            step: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in best.items():
                for x, cost in arcs:
                    if x == " ":
                        if (a, b) == (EDGE, EDGE):
                            continue
                        s, key, way = score + cost + float(logp[a, b, EDGE]), (EDGE, EDGE), (path, x)
                    elif x:
                        k = _CODE.get(x, OTHER)
                        s, key, way = score + cost + float(logp[a, b, k]), (b, k), (path, x)
                    else:
                        s, key, way = score + cost, (a, b), path
                    if key not in step or s > step[key][0]:
                        step[key] = (s, way)
            best, before = step, c if c != " " else before
        _, path = max(((s + float(logp[a, b, EDGE]), p) for (a, b), (s, p) in best.items()), key=lambda x: x[0])
        letters = []
        while path:
            path, x = path
            letters.append(x)
        return "".join(reversed(letters)).strip()

    def restore(self, token: str) -> str:
        """A token as it is meant: clean ones lose the signs at their ends, others are decoded."""
        t = _TAIL.sub("", token.strip(_EDGES)) or token
        if t.isalpha() and not _DRAWN.search(t):
            return t
        return self.decode(t) if any(map(str.isalpha, t)) else ""


def raw_tokens(text: str | None) -> set[str]:
    """The distinct tokens of a text, in lower case; a run of letters set apart also stands as one token."""
    if not text:
        return set()
    low = text.lower()
    return {*low.split(), *_APART.findall(low)}


#: Signs at the ends of pieces, which part no word from the next.
_LOOSE = dict.fromkeys(map(ord, ".,;:?\"'()[]{}«»"), " ")
#: Runs of three or more pieces of one or two characters.
_PIECES = re.compile(r"(?<!\S)(?:\S{1,2}\s+){2,}\S{1,2}(?!\S)")
#: Pieces of a word that is cut anywhere, at most; more only where all are of one or two characters, up to LONGEST together.
CUTS, LONGEST = 3, 16


def cut_words(text: str | None, model: CharModel, known: frozenset[str], memory: dict[str, str]) -> set[str]:
    """Words of ``known`` that stand in ``text`` in pieces, with any blanks between them: ``id iot``, ``i  d  i  o  t``.

    Windows of neighbouring pieces that spell such a word, as they are or restored, are decoded as one lattice in which
    each blank is nothing or the end of a word; a word counts if the most likely path holds it. So two words that are
    common on their own stay apart. ``memory`` keeps decoded windows."""
    if not text or not known:
        return set()
    pieces = text.lower().translate(_LOOSE).split()
    windows, joined = {}, pieces
    for n in range(1, CUTS):
        joined = list(map(add, joined, pieces[n:]))
        for word in known.intersection(joined):
            at = -1
            for _ in range(joined.count(word)):
                at = joined.index(word, at + 1)
                windows.setdefault(" ".join(pieces[at : at + n + 1]), word)
    for run in _PIECES.findall(text.lower()):
        short = [x.strip(_EDGES) or x for x in run.split()]
        for a in range(len(short)):
            word = short[a]
            for z in range(a + 1, len(short)):
                word += short[z]
                if len(word) > LONGEST:
                    break
                if z - a >= 2:
                    window = " ".join(short[a : z + 1])
                    if word in known:
                        windows.setdefault(window, word)
                    elif not word.isalpha() and any(map(str.isalpha, word)) and _decoded(word, model, memory) in known:
                        windows.setdefault(window, _decoded(word, model, memory))
    return {word for window, word in windows.items() if word in _decoded(window, model, memory).split()}


def _decoded(token: str, model: CharModel, memory: dict[str, str]) -> str:
    if token not in memory:
        if len(memory) >= 100_000:
            memory.clear()
        memory[token] = model.decode(token)
    return memory[token]


def features(words: str) -> list[str]:
    """Each word, and its beginnings of three to eight letters."""
    return [f for word in words.split() for f in (f"={word}", *(word[:k] for k in range(3, min(len(word), 8) + 1)))]


class Restorer:
    """Features of texts by way of a bounded memory of tokens seen before."""

    def __init__(self, model: CharModel, size: int = 60_000) -> None:
        self.model, self.size, self.seen = model, size, {}

    def of(self, token: str) -> list[str]:
        if token not in self.seen:
            if len(self.seen) >= self.size:
                self.seen.clear()
            word = self.model.restore(token)
            self.seen[token] = features(word) if word else []
        return self.seen[token]

    def of_text(self, text: str | None) -> set[str]:
        return {f for t in raw_tokens(text) for f in self.of(t)}


def log_odds(t: np.ndarray, d: np.ndarray, n_t: int, n_d: int) -> np.ndarray:
    """Lower bound, two standard errors down, of the log ratio of a feature's share in toxic and other documents."""
    a, b = t + 0.5, d + 0.5
    return np.log(a / (n_t + 1.0)) - np.log(b / (n_d + 1.0)) - 2 * np.sqrt(1 / a + 1 / b)


@dataclass
class Judge:
    """A logistic model over the presence of features; only features that speak for toxicity have weights."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0

    def words(self, least: int = 4) -> frozenset[str]:
        """Whole words that speak for toxicity, of so many letters at least."""
        return frozenset(f[1:] for f in self.weights if f[0] == "=" and len(f) > least)

    def score(self, found: Iterable[str]) -> float:
        z = self.bias + sum(sorted(self.weights[f] for f in found if f in self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_judge(found: Sequence[Sequence[str]], toxic: np.ndarray, ridge: float = 0.3, rounds: int = 400) -> Judge:
    """Logistic regression by diagonally scaled gradient steps with momentum; weights stay positive."""
    names = sorted({f for fs in found for f in fs})
    number = {f: i for i, f in enumerate(names)}
    doc = np.repeat(np.arange(len(found)), [len(fs) for fs in found])
    feat = np.array([number[f] for fs in found for f in fs], np.int64)
    y, n = toxic.astype(float), max(1, len(found))
    per_doc = np.bincount(doc, minlength=n)
    scale = 0.25 * np.bincount(feat, weights=per_doc[doc] + 1.0, minlength=len(names)) + ridge
    w, ahead, bias = np.zeros(len(names)), np.zeros(len(names)), math.log((y.sum() + 1) / (n - y.sum() + 1))
    bias_ahead = bias
    for k in range(rounds):
        z = bias_ahead + np.bincount(doc, weights=ahead[feat], minlength=n)
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        new = np.maximum(ahead - (np.bincount(feat, weights=off[doc], minlength=len(names)) + ridge * ahead) / scale, 0)
        new_bias = bias_ahead - off.sum() / (0.25 * (n + per_doc.sum()))
        m = k / (k + 3)
        ahead, bias_ahead = new + m * (new - w), new_bias + m * (new_bias - bias)
        w, bias = new, new_bias
    return Judge({f: float(x) for f, x in zip(names, w) if x > 1e-3}, float(bias))


def char_model(docs: DataFrame) -> CharModel:
    """The character model over all documents; at most 64**3 sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BASE**3)
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                total += trigram_counts(batch.column(0).slice(s, 1000).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64))], names=["at", "n"])

    sums = docs.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BASE**3)
    counts[[r["at"] for r in sums]] = [r["n"] for r in sums]
    return CharModel.fit(counts)


def held_out(doc_id) -> F.Column:
    """The fold that no model learns from: crc32 of the id as text, divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, least_docs: int = 4, least_evidence: float = 1.5) -> tuple[CharModel, Judge]:
    """Both models. Of the labelled documents outside the held-out fold, a hash sample of about ``max_labelled`` at
    most is learnt from, each text once; what its features count to is all that reaches the driver. A feature enters the
    model if at least ``least_docs`` toxic texts of the sample have it and ``least_evidence`` is surely below the log
    ratio of its shares in toxic and other texts."""
    spark = docs.sparkSession
    chars = spark.sparkContext.broadcast(char_model(docs))
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > max_labelled:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", (F.col("toxic") > 0).alias("toxic"))
    sample = written(sample.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "labelled")

    def counts(wanted, toxic: bool) -> dict[str, int]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer, total = Restorer(chars.value), Counter()

            def counted() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["f", "n"])

            for batch in batches:
                for t in batch.column(0):
                    found = restorer.of_text(t.as_py())
                    total.update(found & wanted.value if wanted else found)
                    if len(total) > 200_000:
                        yield counted()
                        total.clear()
            yield counted()

        rows = sample.filter(F.col("toxic") == toxic).select("text").mapInArrow(run, "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
        return {r["f"]: r["n"] for r in rows.filter(F.col("n") >= (1 if wanted else least_docs)).collect()}

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_t, n_d = sizes.get(True, 0), sizes.get(False, 0)
    toxic = counts(None, True)
    other = counts(spark.sparkContext.broadcast(frozenset(toxic)), False) if toxic else {}
    names = sorted(toxic)
    w = log_odds(np.array([toxic[f] for f in names], float), np.array([other.get(f, 0) for f in names], float), n_t, n_d) if names else []
    strong = spark.sparkContext.broadcast(frozenset(f for f, x in zip(names, w) if x > least_evidence))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(chars.value)
        for batch in batches:
            found = [sorted(restorer.of_text(t) & strong.value) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["toxic", "found"])

    rows = sample.select("text", "toxic").mapInArrow(match, "toxic boolean, found array<string>").collect()
    judge = fit_judge([r["found"] for r in rows], np.array([r["toxic"] for r in rows])) if n_t and n_d else Judge()
    return chars.value, judge


def score_documents(docs: DataFrame, chars: CharModel, judge: Judge, into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``: a score from 0 to 1 of the whole text, restored. Null and empty texts have
    the score of no evidence. Equal texts have equal scores; other columns stay as they are."""
    spark = docs.sparkSession
    models = spark.sparkContext.broadcast((chars, judge))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, judge = models.value
        seen: dict[str, tuple[str, ...]] = {}
        known, memory = judge.words(), {}
        for batch in batches:
            scores = []
            for t in batch.column("text"):
                found = set()
                for token in raw_tokens(t.as_py()):
                    hit = seen.get(token)
                    if hit is None:
                        if len(seen) >= 400_000:
                            seen.clear()
                        word = chars.restore(token)
                        hit = seen[token] = tuple(f for f in features(word) if f in judge.weights) if word else ()
                    if hit:
                        found.update(hit)
                for word in cut_words(t.as_py(), chars, known, memory):
                    found.update(features(word))
                scores.append(judge.score(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, own])

    own = free_name(docs, "_score")
    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(own, T.DoubleType())]))
    return out.drop(into).withColumnRenamed(own, into)  # a column of that name, in upper or lower case, is replaced

