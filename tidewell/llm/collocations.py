"""Phrase collocations by Toivonen's sampling.

A sample of the documents, mined level by level at a lowered threshold, proposes the frequent phrases of each language.
One pass over all documents counts them exactly, and with them their negative border: phrases that were not proposed
though all their parts were. A border phrase that proves frequent is a failure of the sample; what it makes possible is
counted in a further pass, until a pass finds none. Few failures take one such pass: phrases built on them are counted
whatever their length. So the sample decides how many passes there are, never the result.

Tasks cut texts in numpy over Arrow batches and add phrases up as pairs of numbers (the phrase without its last word,
the last word); only those sums are shuffled. Proposed phrases are sent to the tasks while what a task holds of them is
at most ``slice_bytes``; beyond that by some languages at a time, each with a pass over the texts of these. Only those of
a language that is larger alone are dealt into slices by their first word, with a pass for each slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Bytes of text that are cut at a time; sums a task holds before it passes them on.
CHUNK = 1_500_000
HELD = 1_000_000
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
COUNTED = "lang string, level int, key long, word string, n long"


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word: its bytes times a number of their place, added up."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    at, size = at - at[0], np.diff(at)
    with np.errstate(over="ignore"):
        factors = np.cumprod(np.full(int(size.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64))
        products = (data.astype(np.uint64) + np.uint64(1)) * factors[np.arange(len(data)) - np.repeat(at[:-1], size)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(products, dtype=np.uint64)])
        h = total[at[1:]] - total[at[:-1]]
        return (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)


@dataclass
class Phrases:
    """Phrases of one language. A phrase of two words or more is a key: the number of the phrase without its last word,
    times the number of words, plus the number of its last word; its own number is the key's place in its level."""

    words: pa.Array
    own: np.ndarray
    old: list[np.ndarray]
    keys: list[np.ndarray] = field(default_factory=list)
    hashes: np.ndarray | None = None  # of the words, in order; None if two are equal
    order: np.ndarray | None = None

    @classmethod
    def of(cls, table: pa.Table, longest: int) -> Phrases:
        """From rows of words (list of string) and old (boolean); the part without the last word must be there, too."""
        lists, old = table["words"].combine_chunks(), table["old"].combine_chunks().to_numpy(zero_copy_only=False)
        size = pc.list_value_length(lists).to_numpy()
        single = lists.filter(pa.array(size == 1)).flatten()
        first = single.dictionary_encode().dictionary
        more = lists.flatten().unique()
        more = more.filter(pc.is_null(pc.index_in(more, value_set=first)))
        words = pa.concat_arrays([first, more]).cast(pa.string())
        known = np.zeros(len(words), bool)
        known[pc.index_in(single, value_set=words).to_numpy()] = old[size == 1]
        out = cls(words, np.arange(len(words)) < len(first), [known])
        h = word_hashes(words)
        order = np.argsort(h).astype(np.int32)
        if (np.diff(h[order]) > 0).all():
            out.hashes, out.order = h[order], order
        for k in range(2, longest + 1):
            of = np.flatnonzero(size == k)
            w = pc.index_in(lists.take(pa.array(of)).flatten(), value_set=words).to_numpy().astype(np.int64).reshape(-1, k)
            keys = out.number(w[:, :-1]) * len(words) + w[:, -1]
            order = np.argsort(keys)
            out.keys.append(keys[order])
            out.old.append(old[of][order])
        return out

    def place(self, words: pa.Array) -> np.ndarray:
        """Numbers of these words, or -1. They are looked up by their hashes, so that no table of all words that are held
        is built for each run of texts, and compared then."""
        if self.hashes is None or not len(self.hashes):
            return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        h = word_hashes(words)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        hit = np.flatnonzero(self.hashes[at] == h)
        number = self.order[at[hit]]
        same = pc.equal(self.words.take(pa.array(number)), words.take(pa.array(hit))).to_numpy(zero_copy_only=False)
        out = np.full(len(words), -1)
        out[hit[same]] = number[same]
        return out

    def number(self, w: np.ndarray) -> np.ndarray:
        """Numbers of phrases that are held, from rows of word numbers."""
        at = w[:, 0]
        for j in range(1, w.shape[1]):
            at = np.searchsorted(self.keys[j - 1], at * len(self.words) + w[:, j])
        return at

    def find(self, level: int, keys: np.ndarray) -> np.ndarray:
        """Numbers of the phrases of ``level`` words that have these keys, or -1."""
        held = self.keys[level - 2]
        at = np.searchsorted(held, keys)
        at[at == len(held)] = 0
        return np.where(held[at] == keys, at, -1) if len(held) else np.full(len(keys), -1)

    def spelled(self, level: int, numbers: np.ndarray, last: pa.Array | None) -> pa.Array:
        """Lists of words: of phrases of ``level`` words if ``last`` is None, or of these and one more word each."""
        columns = []
        for j in range(level, 1, -1):
            key = self.keys[j - 2][numbers]
            columns.append(key % len(self.words))
            numbers = key // len(self.words)
        at = np.stack([numbers, *reversed(columns)], 1)
        values = self.words.take(pa.array(at.ravel()))
        if last is not None:
            at = np.arange(at.size).reshape(at.shape)
            at = np.concatenate([at, at.size + np.arange(len(at))[:, None]], 1)
            values = pa.concat_arrays([values, last]).take(pa.array(at.ravel()))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * at.shape[1]), values)


def tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts as one array, A-Z in lower case, and for each the number of the piece it stands in."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    kind = _KIND[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets - offsets[0]] = True
    word = kind == 0
    gap = np.ones(len(data) + 1, bool)  # between one byte and the next
    gap[1:-1] = ~(word[1:] & word[:-1]) | begins[1:-1]
    start, end = np.flatnonzero(word & gap[:-1]), np.flatnonzero(word & gap[1:]) + 1
    piece = np.cumsum((kind == 2) | begins[:-1], dtype=np.int32)[start]
    where = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(start), pa.py_buffer(where), pa.py_buffer(_LOWER[data[word]]))
    return flat.dictionary_encode(), piece


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of about CHUNK bytes; a longer text is one run."""
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64))
    at = np.cumsum(size) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield texts.slice(a, b - a)


class Sums:
    """Counts of the phrases and words of a task, by language and level; passed on when they grow."""

    def __init__(self) -> None:
        self.parts: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        self.words: dict[str, list[pa.Table]] = {}
        self.n = 0

    def add_words(self, lang: str, words: pa.Array, n: np.ndarray) -> None:
        self.words.setdefault(lang, []).append(pa.table({"word": words, "n": n}))
        self.n += len(words)

    def add(self, lang: str, level: int, keys: np.ndarray, n: np.ndarray) -> None:
        if len(keys):
            self.parts.setdefault((lang, level), []).append((keys, n))
            self.n += len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for (lang, level), parts in self.parts.items():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)
            for s in range(0, len(keys), 100_000):
                yield _row_batch(lang, level, keys[s : s + 100_000], None, n[s : s + 100_000])
        for lang, tables in self.words.items():
            summed = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
            for s in range(0, len(summed), 100_000):
                part = summed.slice(s, 100_000).combine_chunks()
                n = part["n_sum"].to_numpy()
                yield _row_batch(lang, 1, np.full(len(n), -1), part["word"].combine_chunks(), n)
        self.parts, self.words, self.n = {}, {}, 0
        pa.default_memory_pool().release_unused()


def _row_batch(lang: str, level: int, keys: np.ndarray, words: pa.Array | None, n: np.ndarray) -> pa.RecordBatch:
    size = len(n)
    columns = [pa.repeat(pa.scalar(lang), size), pa.repeat(pa.scalar(level, pa.int32()), size), pa.array(keys, pa.int64()), pa.nulls(size, pa.string()) if words is None else words, pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "level", "key", "word", "n"])


def _counted(texts: pa.Array, lang: str, held: Phrases | None, longest: int, words: bool, whole: bool, further: bool, sums: Sums) -> Iterator[pa.RecordBatch]:
    """Counts one run of texts: level 0 is the number of words, level 1 each word (both if ``words``), beyond that the
    phrases whose parts are held and were not all counted before. With ``further``, phrases counted here for the first
    time serve as parts, too; they have numbers beyond those held, and longer ones on them go by their words."""
    coded, piece = tokens(texts)
    local, names = coded.indices.to_numpy(), coded.dictionary
    if words and len(local):
        n = np.bincount(local, minlength=len(names))
        yield _row_batch(lang, 0, np.array([-1]), None, np.array([len(local)]))
        sums.add_words(lang, names, n)
    if held is None or len(local) < 2:
        return
    w = held.place(names)[local]
    at = np.where(held.own[w], w, -1) if len(held.own) else np.full(len(w), -1)
    at[w < 0] = -1
    size, known = len(held.words), len(held.words)
    for level in range(2, longest + 1):
        n = len(local) - level + 1
        if n < 1:
            return
        fits = (at[:n] >= 0) & ((at[1 : n + 1] >= 0) if whole else True) & ((piece[:n] == piece[level - 1 :]) if level == 2 or not whole else True)
        here = np.flatnonzero(fits)
        last = here + level - 1
        keys, first, which, count = np.unique(at[here] * (size if whole else len(names)) + (w if whole else local)[last], return_index=True, return_inverse=True, return_counts=True)
        start = here[first]
        follows = w[start + level - 1]
        found = np.where(follows >= 0, held.find(level, at[start] * size + follows), -1)
        if whole:
            counted = np.append(held.old[level - 2], False)  # numbers beyond those held are of phrases not counted before
            new = ~(counted[np.minimum(at[start], known)] & counted[np.minimum(at[start + 1], known)])
            named = at[start] < known
            sums.add(lang, level, keys[new & named], count[new & named])
            if (new & ~named).any():
                of = start[new & ~named]
                spelled = names.take(pa.array(local[(of[:, None] + np.arange(level)).ravel()])).to_numpy(zero_copy_only=False).reshape(-1, level)
                yield _row_batch(lang, level, np.full(len(of), -2), pa.array([" ".join(x) for x in spelled], pa.string()), count[new & ~named])
            known = len(held.keys[level - 2])
            if further:
                found = np.where(new & (found < 0), known + np.arange(len(found)), found)
        elif len(keys):
            yield _row_batch(lang, level, at[start], names.take(pa.array(local[start + level - 1])), count)
        at = np.full(n, -1)
        at[here] = found[which]


def count_phrases(docs: DataFrame, proposed: dict[str, Phrases] | None, longest: int, least: int, words: bool, whole: bool = True, further: bool = False) -> DataFrame:
    """(lang, words, n) of all counted phrases, each at least ``least`` times there; the number of words of a language has
    no words. ``docs``: lang, text."""
    held = docs.sparkSession.sparkContext.broadcast(proposed or {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(1).filter(pc.equal(langs.indices, i)) if len(langs.dictionary) > 1 else batch.column(1)
                for run in _chunks(texts):
                    yield from _counted(run, lang, held.value.get(lang), longest, words, whole, further, sums)
                    if sums.n > HELD:
                        yield from sums.rows()
        yield from sums.rows()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for lang, level in {(x["lang"], x["level"]) for x in table.select(["lang", "level"]).group_by(["lang", "level"]).aggregate([]).to_pylist()}:
                part = table.filter((pc.field("lang") == lang) & (pc.field("level") == level))
                plain = part.filter(pc.field("key") == -2)
                if len(plain):  # by its words
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(plain)), pc.split_pattern(plain["word"].combine_chunks(), " "), plain["n"].combine_chunks()], names=["lang", "words", "n"])
                    part = part.filter(pc.field("key") != -2)
                key, word, n = part["key"].to_numpy(), part["word"].combine_chunks(), part["n"].combine_chunks()
                if level < 2:
                    of = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * level), word if level else pa.array([], pa.string()))
                else:
                    p = held.value[lang]
                    of = p.spelled(level - 1, key // len(p.words) if whole else key, p.words.take(pa.array(key % len(p.words))) if whole else word)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(n)), of, n], names=["lang", "words", "n"])

    counts = docs.select("lang", "text").mapInArrow(count, COUNTED).groupBy("lang", "level", "key", "word").agg(F.sum("n").alias("n"))
    return counts.filter((F.col("n") >= least) | (F.col("level") == 0)).mapInArrow(spell, "lang string, words array<string>, n long")


def _slices(proposed: DataFrame, slice_bytes: int) -> list[tuple[list[str], int]]:
    """Languages whose phrases are sent together, and into how many slices: what a task holds of phrases is a number and a
    mark for each one, and of words their text, too. A language alone may have several slices; others share one."""
    size = F.when(F.size("words") == 1, F.octet_length(F.col("words")[0]) + 18).otherwise(9)
    sizes = sorted(((r["size"], r["lang"]) for r in proposed.groupBy("lang").agg(F.sum(size).alias("size")).collect()), reverse=True)
    out, held = [], slice_bytes
    for n, lang in sizes:
        if n > slice_bytes:
            out.append(([lang], -(-n // slice_bytes)))
        elif held + n > slice_bytes:
            out.append(([lang], 1))
            held = n
        else:
            out[-1][0].append(lang)
            held += n
    return out or [([], 1)]


def _pass(docs: DataFrame, proposed: DataFrame | None, longest: int, least: int, words: bool, slice_bytes: int, further: bool = False) -> DataFrame:
    """One pass, or one for each slice of what is proposed (lang, words, old) over the texts of its languages, written."""
    if proposed is None:
        return written(count_phrases(docs, None, longest, least, words), "phrases")
    shares = _slices(proposed, slice_bytes)
    out = None
    for j, (langs, slices) in enumerate(shares):
        if j:
            some, own = docs.filter(F.col("lang").isin(langs)), proposed.filter(F.col("lang").isin(langs))
        else:  # along with the languages of which nothing is proposed
            others = [lang for x, _ in shares[1:] for lang in x]
            some, own = (x.filter(~F.col("lang").isin(others)) if others else x for x in (docs, proposed))
        for i in range(slices):
            part = own if slices == 1 else own.filter(F.pmod(F.xxhash64("lang", F.col("words")[0]), F.lit(slices)) == i)
            table = part.select("lang", "words", "old").toArrow()
            held = {lang: Phrases.of(table.filter(pc.field("lang") == lang), longest) for lang in table["lang"].unique().to_pylist()}
            found = written(count_phrases(some, held, longest, least, words and i == 0, slices == 1, further and slices == 1), "phrases")
            out = found if out is None else out.unionByName(found)
    return out


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, share: float = 0.1, lowered: float = 0.5, slice_bytes: int = 64_000_000) -> tuple[DataFrame, int]:
    """(lang, words, n) of every phrase of 1 to ``longest`` words that stands at least ``least`` times in the pieces of its
    language's texts, and with no words each language's number of words; and how many full passes it took.

    ``docs``: lang, text. Null texts have no words; texts whose language is null are of ``und``. ``share`` of the rows
    are the sample, in which phrases are proposed from ``lowered`` of their expected count on."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    sample = written(docs.filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) < int(share * (1 << 20))), "sample")
    low = max(2, int(least * share * lowered))
    found = _pass(sample, None, longest, low, True, slice_bytes).filter(F.size("words") > 0).select("lang", "words")
    proposed = found.withColumn("old", F.lit(False))
    for _ in range(2, longest + 1):
        new = _pass(sample, proposed, longest, low, False, slice_bytes).select("lang", "words").distinct()
        proposed = proposed.select("lang", "words").withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))
    proposed = proposed.select("lang", "words").distinct().withColumn("old", F.lit(False))
    exact, passes, closed = _pass(docs, proposed, longest, least, True, slice_bytes), 1, False
    while True:
        exact = exact.distinct()  # slices may count a phrase twice, each time in full
        known = proposed.select("lang", "words").withColumn("old", F.lit(True))
        several = exact.filter(F.size("words") > 0).select("lang", "words").join(known, ["lang", "words"], "left").select("lang", "words", F.coalesce("old", F.lit(False)).alias("old"))
        proposed = written(several, "proposed")
        failed = F.col("old") == F.lit(False)
        sizes = proposed.agg(F.count(F.when(failed & (F.size("words") < longest), 1)).alias("new"), F.count(F.lit(1)).alias("all")).first()
        if closed or not sizes["new"]:
            return exact, passes
        # few failures: what builds on them, and on that in turn, is counted in one go, which closes the search
        closed = sizes["new"] * 10 <= sizes["all"] and all(n == 1 for _, n in _slices(proposed, slice_bytes))
        exact, passes = exact.unionByName(_pass(docs, proposed, longest, least, False, slice_bytes, closed)), passes + 1


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, cover: int = 100, first: int = 2000, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``first`` phrases of 2 words or more.

    a is how often the phrase stands, n the language's number of words. Cut after its first words, l and r are how often
    its two parts stand; the score is floor(1000 * a * n / (l * r)) of the cut where that is least, the earliest one among
    equals. A phrase that lies in a longer frequent one standing at least ``cover`` percent as often is left out. Order:
    score and a descending, then the phrase. Empty tables give no rows; repeated rows count each time; ``how`` goes to
    ``frequent_phrases``.
    """
    frequent, _ = frequent_phrases(docs, least, longest, **how)
    frequent = written(frequent.select("lang", "words", F.array_join("words", " ").alias("phrase"), "n"), "frequent")
    total = frequent.filter(F.size("words") == 0).select("lang", F.col("n").alias("total"))
    known = frequent.filter(F.size("words") > 0)
    several = known.filter(F.size("words") > 1)
    # of the longer phrases around one, those with one more word stand most often
    parts = several.filter(F.size("words") > 2).select("lang", "n", F.explode(F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))).alias("part"))
    around = parts.groupBy("lang", F.array_join("part", " ").alias("phrase")).agg(F.max("n").alias("most"))
    kept = several.join(around, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(cover) * F.col("n")))
    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.expr("sequence(1, size(words) - 1)")).alias("cut"))
    cuts = cuts.withColumns({"head": F.array_join(F.expr("slice(words, 1, cut)"), " "), "rest": F.array_join(F.expr("slice(words, cut + 1, size(words))"), " ")})
    count = lambda part, name: known.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    cuts = cuts.join(count("head", "l"), ["lang", "head"]).join(count("rest", "r"), ["lang", "rest"]).join(total, "lang")
    cuts = cuts.withColumn("score", F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(17, 0)) * cast(total as decimal(17, 0))) div (cast(l as decimal(17, 0)) * cast(r as decimal(17, 0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", F.col("total").alias("n"))).alias("b"))
    best = best.select("lang", "phrase", *[F.col(f"b.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= first)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
