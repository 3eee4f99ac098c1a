"""Lattice decoding against all paths, words in pieces, and ranges of hashes on few tasks."""

from __future__ import annotations

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import line_dedup, ngram_join, toxicity

CORPUS = ["the idiot and the clown are stupid people", "an idea of it is not the same as a tide", "do not be stupid, idiot", "he said that it was his own idea", "clowns live in the town", "a pid is not a stub", "I did it again"] * 30


@pytest.fixture(scope="module")
def model():
    return toxicity.CharModel.fit(toxicity.trigram_counts(CORPUS))


def arcs(c, before):
    if c == " ":
        return [("", 0.0), (" ", 0.0)]
    if c in toxicity._CODE or c.isalpha():
        return [(c, 0.0 if c != before else -0.7), *([("", -0.7)] if c == before else [])]
    out = [(x, -0.5 - 0.4 * i) for i, x in enumerate(toxicity.STANDS_FOR.get(c, ""))]
    return [*out, ("", -1.0 if not out else -8.0), *([("", -0.7)] if c == before else [])]


def best_of_all_paths(model, token):
    """The scores of all ways to read a token, one by one."""
    choices, before = [], ""
    for c in token:
        choices.append(arcs(c, before))
        before = c if c != " " else before
    found = {}
    for path in product(*choices):
        a, b, score = 0, 0, 0.0
        for x, cost in path:
            score += cost
            if x == " ":
                if (a, b) == (0, 0):
                    break
                score += float(model.logp[a, b, 0])
                a, b = 0, 0
            elif x:
                k = toxicity._CODE.get(x, toxicity.OTHER)
                score += float(model.logp[a, b, k])
                a, b = b, k
        else:
            word = "".join(x for x, _ in path).strip()
            found[word] = max(found.get(word, -1e9), score + float(model.logp[a, b, 0]))
    return found


def test_decode_finds_the_best_of_all_paths(model):
    rng = random.Random(3)
    tokens = ["1d10t", "st00pid", "i d i o t", "id iot", "cl0wn", "s7up1d", "|d|ot", "iidioot", "!!", "a", "4 5", "cl  own"]
    tokens += ["".join(rng.choices("idots10 !$e", k=rng.randrange(1, 10))).strip() or "i" for _ in range(60)]
    for token in tokens:
        ways = best_of_all_paths(model, token)
        got = model.decode(token)
        assert got in ways and ways[got] > max(ways.values()) - 1e-4, token


@pytest.mark.parametrize("text,word", [
    ("you id iot", "idiot"), ("you i  d  i  o  t !", "idiot"), ("i\nd\ni\no\nt", "idiot"), ("such a stu pid thing", "stupid"), ("an i d iot", "idiot"), ("s tupid", "stupid"),
    ("Stu\t Pid, he said", "stupid"), ("a clow n.", "clown"), ("the c l 0 w n", "clown"), ("1 d 1 0 t", "idiot"), ("st up id", "stupid"), ("i d i o t i d i o t", "idiot"),
])
def test_words_in_pieces(model, text, word):
    assert toxicity.cut_words(text, model, frozenset(["idiot", "stupid", "clown"]), {}) == {word}


@pytest.mark.parametrize("text", [None, "", "the idiot", "id is it", "he is an id of it", "a b c d e f g", "own town", "st. Paul", "1 2 3 4"])
def test_what_is_not_in_pieces(model, text):
    assert toxicity.cut_words(text, model, frozenset(["idiot", "stupid", "clown"]), {}) == set()


def test_words_that_stand_on_their_own_stay_apart(model):
    """The lattice decides: two common words that spell a third one are left alone."""
    spoken = toxicity.CharModel.fit(toxicity.trigram_counts(["the be that he is", "an is of the be", "is the an of that"] * 100))
    assert toxicity.cut_words("the is of", spoken, frozenset(["theis"]), {}) == set()


def test_many_ranges_on_few_tasks(spark):
    """2**12 ranges of line hashes in 4 tasks name the same suspects as one range does."""
    rng = random.Random(1)
    lines = [f"line {rng.randrange(600)}" for _ in range(3000)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 9])) for i in range(900)], "doc_id long, text string").repartition(5)
    rows = {}
    for bits, tasks in ((0, 14), (12, 14), (12, 2), (20, 6)):
        found = line_dedup.suspected_hashes(docs, 1, bits, tasks)
        assert found.rdd.getNumPartitions() <= 1 << min(bits, tasks)
        rows[bits, tasks] = {r["h"] for r in found.collect()}
    keys = {k for t in docs.select("text").collect() for k in line_dedup.line_keys(t["text"].encode())}
    seen = [k for k in keys if sum(k in set(line_dedup.line_keys(r["text"].encode())) for r in docs.collect()) > 1]
    must = set(line_dedup._hashes(seen).view(np.int64).tolist())
    assert all(must <= found for found in rows.values()) and rows[12, 14] == rows[12, 2] == rows[20, 6]
    whole = [sorted(map(tuple, line_dedup.dedup_lines(docs, 3, text_per_range=n, most_task_bits=b).select("doc_id", "kept_text").collect())) for n, b in ((16_000_000, 14), (50, 3))]
    assert whole[0] == whole[1]


def test_many_buckets_on_few_tasks(spark):
    """2**20 buckets of shingles, and of signatures, in 64 tasks: counts and meetings as with a bucket a task."""
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(40)) for _ in range(60)]
    texts = [*base, *[b.replace(b.split()[3], "other") for b in base], *[b + " tail" for b in base]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    t = ngram_join.Threshold(80, 100)
    alone, met = [], []
    for per, tasks in ((10**9, 14), (1 / 200, 6), (1 / 200, 3)):
        found = ngram_join._unshared(docs, 3, 6000, per, tasks)
        alone.append({tuple(r) for r in found.collect()})
        met.append({tuple(r) for r in ngram_join._meetings(docs, 3, t, 6000, per, tasks).collect()})
    assert alone[0] == alone[1] == alone[2] and len(alone[0]) > 20
    assert met[0] == met[1] == met[2] and len(met[0]) >= 60
    made = ngram_join._dealt(docs.select(F.lit(1).alias("bucket"), F.lit(b"").alias("classes"), F.lit(b"").alias("counts"), F.lit(b"").alias("signs")), 20, 6, "bucket")
    assert made.rdd.getNumPartitions() == 64
