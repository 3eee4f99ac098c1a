"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import io
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import components, decontaminate, licenses, line_dedup, mixing, ngram_join, sharding, token_counts, top_inner_products, toxicity, warc
from tidewell.llm.common import running_total

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog again and again today"), (2, "the quick brown fox jumps over the lazy dog again and again today"),
    (3, "The quick brown fox jumps over the lazy dog again and again today"), (4, None), (5, ""), (6, " \n\t"), (7, "one"), (8, "one two"), (9, LONG), (10, LONG + " tail"),
    (None, "no id here at all"), (11, "a\nb\nA \n b"), (11, "a\nb\nA \n b"),
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    rows = [(i, t, "en", f"src{(i or 0) % 3}" if i != 7 else None, len(t or ""), i, "x") for i, t in TEXTS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, kept_text string").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_sharding(docs, none):
    out = sharding.shard_documents(docs, 5).collect()
    assert len(out) == len(TEXTS)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 5 and r["grown_shard"] in (r["shard"], 5) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = {r["doc_id"]: r for r in out}
    assert by[4]["size"] == 8 and by[4]["text_crc32"] == 0 and by[7]["text_crc32"] == zlib.crc32(b"one") and by[7]["size"] == 11
    assert sharding.shard_documents(none, 5).count() == 0
    assert len(sharding.sharded_corpus(docs, 5).columns) == len(docs.columns) + 2
    grown = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 6).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in out)


def test_weights_shape_shares(spark):
    counts = dict(sharding.assign_shards(spark.range(20_000), ["id"], 3, [1.0, 2.0, 1.0]).groupBy("shard").count().collect())
    assert abs(counts[1] / 20_000 - 0.5) < 0.02
    with pytest.raises(ValueError):
        sharding.assign_shards(spark.range(3), ["id"], 2, [1.0, 0.0])


def test_running_total_over_buckets(spark, tmp_path):
    spark.range(500).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"), (F.col("id") % 7).alias("v")).write.parquet(str(tmp_path / "r"))
    out = running_total(spark.read.parquet(str(tmp_path / "r")), ["g"], ["id"], "v", "before", rows_per_bucket=20).collect()
    for g in (0, 1):
        rows = sorted((r["before"], r["v"]) for r in out if r["g"] == g)
        spans = [(b, b + v) for b, v in rows if v]
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))


def html(n):
    return "".join(random.Random(n).choices("abcdef<>/é", k=400 + n % 50))


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", html(1)), (3, "http://c\r\nX: y", html(1)), (2, None, html(1)), (4, "http://d", None), (5, "http://e", "short"), (6, "http://f", "short"), (None, "http://n", html(1)), (7, "http://g", "\x1f" + "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["record_id"]: r for r in warc.archived(pages).collect()}
    assert len(out) == len(rows)
    assert (out["1"]["record_type"], out["2"]["refers_to"], out["3"]["record_type"], out["3"]["payload"]) == ("response", "1", "revisit", b"")
    assert out["5"]["record_type"] == out["6"]["record_type"] == "response" and out["4"]["payload_bytes"] == 0
    assert hashlib.sha256(out["1"]["payload"]).hexdigest() == out["2"]["digest"] and out["2"]["payload_bytes"] == len(html(1).encode())
    assert warc.archived(pages.limit(0)).count() == 0


def test_every_byte_range_owns_its_records():
    rng = random.Random(5)
    # payloads of raw bytes hold false magic numbers, some stored uncompressed
    payloads = [warc.MAGIC * rng.randrange(3) + rng.randbytes(rng.randrange(1, 4000)) for _ in range(40)]
    members = [warc.record("response", [("WARC-Record-ID", f"<urn:record:{i}>")], p, level=i % 2 * 6) for i, p in enumerate(payloads)]
    blob = warc.EMPTY_MEMBER.join(members)
    for step in (97, 1000, len(blob)):
        got = [m for s in range(0, len(blob), step) for m in warc.members_in(io.BytesIO(blob), s, min(s + step, len(blob)))]
        assert [warc.parse(m).payload for m in got] == payloads
    inner = warc.EMPTY_MEMBER.join(warc.record("response", [("WARC-Record-ID", f"<urn:record:in{i}>")], rng.randbytes(300)) for i in range(9))
    stored = [warc.record("resource", [("WARC-Record-ID", "<urn:record:outer>")], inner, level=0), *members[:5]]
    blob = warc.EMPTY_MEMBER.join([members[0], *stored, stored[0]])
    for step in range(4500, 9000, 500):  # ranges longer than the stored archive: none of its records comes out
        got = [m for s in range(0, len(blob), step) for m in warc.members_in(io.BytesIO(blob), s, min(s + step, len(blob)))]
        assert [warc.parse(m).payload for m in got] == [payloads[0], inner, *payloads[:5], inner]
    assert warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort") is None


def brute_components(rows, width, num):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [b if p == a else p for p in parent]
    low = {p: min((rows[i][0] for i in range(len(rows)) if parent[i] == p and rows[i][0] is not None), default=None) for p in set(parent)}
    return Counter((rows[i][0], len(sets[i]), low[parent[i]]) for i in range(len(rows)))


def near_copies():
    rng = random.Random(3)
    base, out = [[f"v{rng.randrange(400)}" for _ in range(n)] for n in (12, 40, 150, 151)], []
    for i in range(160):
        w = list(base[i % 4])
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        out.append((i, " ".join(w[: len(w) - rng.randrange(3)])))
    return out


@pytest.mark.parametrize("width,num,block", [(3, 90, 100_000), (5, 80, 300), (2, 80, 2_000)])
def test_join_equals_brute_force(spark, docs, none, tmp_path, width, num, block):
    rows = [*near_copies(), *[(i if i is None else 1000 + i, t) for i, t in TEXTS]]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    out, _ = ngram_join.jaccard_join(spark.read.parquet(str(tmp_path / "d")), width, ngram_join.Threshold(num, 100), block)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()) == brute_components(rows, width, num)
    assert ngram_join.jaccard_join(none, width)[0].count() == 0


def test_signatures_meet():
    rng, t = np.random.default_rng(7), ngram_join.Threshold(80, 100)
    for n in (1, 4, 5, 9, 30, 200, 777):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            keep = a[rng.random(len(a)) > rng.random() * 0.2]
            b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, n // 8 + 1)).astype(np.uint64)]))
            o = len(np.intersect1d(a, b))
            if len(b) and t.linked(o, len(a), len(b)) and not np.array_equal(a, b):
                assert len(np.intersect1d(ngram_join.signatures(a, t), ngram_join.signatures(b, t)))


def test_signatures_of_unlike_sets_do_not_meet():
    """Parts that are empty in both said that two long sets meet, and made signatures as the square of their length."""
    rng, t = np.random.default_rng(5), ngram_join.Threshold(80, 100)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (40, 900, 3000, 3000, 3100, 3200)]
    signs = [ngram_join.signatures(s, t) for s in sets]
    assert all(0 < len(x) < len(s) for x, s in zip(signs, sets))
    assert not any(len(np.intersect1d(a, b)) for i, a in enumerate(signs) for b in signs[:i])


@pytest.mark.parametrize("num", [30, 50, 80, 95])
def test_signatures_of_sets_with_empty_parts_meet(num):
    """Hashes that lie close leave most parts empty; for low thresholds there are more parts than shingles."""
    rng, t, linked = np.random.default_rng(num), ngram_join.Threshold(num, 100), 0
    for n in (2, 3, 6, 12, 25, 60, 300):
        for spread in (40, 56, 63):
            for _ in range(15):
                a = np.unique(rng.integers(0, 1 << spread, n).astype(np.uint64))
                b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * (1 - num / 100)], rng.integers(0, 1 << spread, rng.integers(0, 1 + n * (100 - num) // 200)).astype(np.uint64)]))
                if len(b) and t.linked(len(np.intersect1d(a, b)), len(a), len(b)) and not np.array_equal(a, b):
                    linked += 1
                    assert len(np.intersect1d(ngram_join.signatures(a, t), ngram_join.signatures(b, t)))
    assert linked > 5


def test_unshared_by_slices(spark):
    """Slices of all hashes add up to the whole, and a task keeps several buckets, so that packed rows hold many shingles."""
    docs = spark.createDataFrame([(" ".join(f"w{i % 7}x{j}" if j % 3 else f"all{j}" for j in range(30 + i)),) for i in range(40)], "text string").repartition(2)
    count = lambda **how: Counter({r["cls"]: r["unshared"] for r in ngram_join._unshared(docs, 2, 4000, **how).collect()})
    whole = count()
    assert sum(whole.values()) > 40 and whole == count(low=0, high=20_000) + count(low=20_000, high=1 << 16)
    assert ngram_join._unshared(docs, 2, 4000, per_bucket=4, high=20_000).rdd.getNumPartitions() <= 1 << 7


def test_join_of_negative_ids_and_long_sets(spark, tmp_path):
    text = " ".join(f"n{i}" for i in range(50))
    rows = [(-5, text), (7, text), (-9, text + " more"), (None, text), (3, "alone")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    out, _ = ngram_join.jaccard_join(spark.read.parquet(str(tmp_path / "d")), 3, ngram_join.Threshold(90, 100))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()) == brute_components(rows, 3, 90)
    sign = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5_000_000).astype(np.uint64))
    back = [ngram_join._unpacked(dict(zip(("bucket", "classes", "counts", "signs"), r))) for r in ngram_join._packed(sign, np.full(len(sign), 4), 4)]
    assert sum(len(s) for s, _ in back) == sum(len(n) for _, n in back) == len(sign)


def test_one_of_each(docs):
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in ngram_join.one_of_each(docs, 3, ngram_join.Threshold(90, 100)).collect())
    assert [i for i, _ in kept] == [0, 1, 4, 5, 6, 7, 8, 9, 11]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    out = {r["node"]: r["component"] for r in components.connected_components(links, "a", "b").collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.connected_components(links.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("room", [32_000_000, 0])
@pytest.mark.parametrize("first", [False, True])
def test_line_dedup(docs, none, room, first):
    out = line_dedup.dedup_lines(docs, min_docs=2, keep_first=first, max_broadcast_bytes=room)
    assert out.columns.count("kept_text") == 1 and out.count() == len(TEXTS)
    key = lambda x: x.strip(" \t\n\v\f\r").lower()
    per = Counter(k for _, t in TEXTS for k in {key(x) for x in (t or "").split("\n")} if k)
    # the smallest id; TEXTS has no two texts of one id that share a line, but for one that is repeated whole
    owner = {k: min((i is None, i or 0) for i, t in TEXTS if k in map(key, (t or "").split("\n"))) for k in per}
    want = Counter()
    for i, t in TEXTS:
        lines, kept, seen = (t or "").split("\n"), [], set()
        for x in lines:
            k = key(x)
            if per[k] >= 2 and not (first and owner[k] == (i is None, i or 0) and k not in seen):
                continue
            seen.add(k)
            kept.append(x)
        want[(i, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    assert Counter((r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in out.collect()) == want
    assert line_dedup.dedup_lines(none).count() == 0


def test_ranges_miss_no_repeated_line(spark):
    rows = [(f"line {i % 700}\nonly {i}",) for i in range(1500)]
    found = {r["h"] % (1 << 64) for r in line_dedup.suspected_hashes(spark.createDataFrame(rows, "text string").repartition(5), 1, 3).collect()}
    assert set(line_dedup._hashes([f"line {i}".encode() for i in range(700)]).tolist()) <= found and len(found) < 720


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.1 + (i % 9) / 9, 12).astype(np.float32).tolist()) for i in range(1, 301)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), (450, None), (500, [1.0, None] * 6), (550, [float("nan")] * 12), (600, [float("inf")] * 12), (None, [1.0] * 12), (650, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, np.floor(np.array(v, np.float64) * 256).astype(int)) for i, v in rows if i and v and None not in v and np.isfinite(np.array(v, float)).all()]
    want = []
    for q, x in good:
        if q % 50 == 0:
            scored = sorted((-int(x @ y), i) for i, y in good if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, top_inner_products.top_k(df).collect())) == sorted(want)
    assert top_inner_products.top_k(df.limit(0)).count() == 0
    assert top_inner_products.top_k(df.filter("vec_id in (50, 1)")).count() == 1


def test_top_k_of_large_components(spark):
    rng = random.Random(6)
    rows = [(i, [float(rng.choice([0, 1, -3, 1e8, -1e8, 3e37, 7e200]) * rng.random()) for _ in range(6)]) for i in range(1, 131)]
    rows += [(150, [1e8] * 6), (151, [1e8] * 6), (200, [0.0] * 6), (250, [1e308] * 6)]  # the last is infinite once scaled
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i != 250]
    want = []
    for q, x in good:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q)[:5]
            want += [(q, k + 1, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for k, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, top_inner_products.top_k(df).collect())) == sorted(want)


@pytest.mark.parametrize("blocks", [2_000, 64_000_000])
def test_top_k_over_many_blocks(spark, monkeypatch, blocks):
    for name, value in (("BLOCK_BYTES", blocks), ("STEP", 16), ("QUERIES", 3), ("BATCHES", 2), ("FIRST_BATCHES", 1)):
        monkeypatch.setattr(top_inner_products, name, value)
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(0, rng.gamma(2, 0.4, (700, 1)), (700, 8)) * 256)
    df = spark.createDataFrame([(i, (x / 256).tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    score = v @ v.T
    want = [(q, k + 1, int(i), int(score[q, i])) for q in range(0, 700, 50) for k, i in enumerate(sorted((i for i in range(700) if i != q), key=lambda i: (-score[q, i], i))[:5])]
    assert sorted(map(tuple, top_inner_products.top_k(df).collect())) == sorted(want)


def test_share_out():
    assert mixing.share_out([10, 10], [3, 1], 20, 2) == [15.0, 5.0]
    assert mixing.share_out([5, 100, 0], [3, 1, 2], 60, 2) == [10.0, 50.0, 0.0]
    assert mixing.share_out([], [], 0, 2) == []


def test_mixing(docs, none):
    out = mixing.mix_documents(docs).collect()
    assert len(out) == len(TEXTS)
    by = defaultdict(list)
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
        by[r["source"]].append(r)
    assert all(abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 1 for rows in by.values())
    assert abs(sum(rows[0]["target"] for rows in by.values()) - 1.5 * sum(r["size"] for r in out)) < 1e-6
    assert [r["position"] for r in out if r["position"] is not None] == sorted(r["position"] for r in out if r["position"] is not None)
    assert mixing.mix_documents(none).count() == 0
    corpus = mixing.mixed_corpus(docs)
    assert corpus.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in corpus.collect()) == sum(r["taken"] for r in out)


def test_mixing_keeps_texts_whole(spark, tmp_path):
    rng = random.Random(3)
    names = [*(f"s{i}" for i in range(40)), None, "\uffff", "\U0001f600", ""]
    rows = [(i, " ".join(f"w{j}" for j in range(rng.randint(1, 60))) + " end\n", name) for i, name in enumerate(names)]
    rows += [(99, "same row again " * 5, names[0])] * 9
    rows += [(100 + i, " ".join(f"v{j}" for j in range(rng.randint(1, 60))), rng.choice(names[:3])) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = mixing.mix_documents(docs).collect()
    sizes = {n: sum(r["size"] for r in out if r["source"] == n) for n in names}
    order = sorted(names, key=lambda n: (n is None, n or ""))
    want = dict(zip(order, mixing.share_out([sizes[n] for n in order], [[3, 1, 2][i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2)))
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] for r in out)
    for n in names:
        own = [r for r in out if r["source"] == n]
        assert abs(sum(r["taken"] for r in own) - want[n]) <= max(r["size"] for r in own) / 2 + 1
    texts = {i: t for i, t, _ in rows}
    read = Counter((r["doc_id"], r["text"]) for r in mixing.mixed_corpus(docs).collect())
    want = Counter()
    for r in out:
        want[(r["doc_id"], texts[r["doc_id"]])] += r["taken"] // max(1, r["size"])
    assert read == +want


def test_schedules_invert(spark):
    with pytest.raises(ValueError):
        mixing.checked([(0.0, 1.0), (0.5, 1.0)])
    segs = [(0.0, 0.0, 1.0, 0.0, 2.0)]  # weight grows from 0: half of it is reached at the root of one half
    df = spark.createDataFrame([(50, 100, 1.0, segs)], "o long, d long, w double, s array<struct<f:double,t:double,dt:double,w0:double,w1:double>>")
    assert abs(df.select(mixing._position(F.col("o"), F.col("d"), F.col("w"), F.col("s"))).first()[0] - 0.5**0.5) < 1e-9


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda s: "".join(c.lower() if c.isascii() else c for c in s or "")


def brute_contamination(texts, items, window=13):
    out = Counter()
    for i, t in texts:
        words, hit, names = WORD.findall(lower(t)), set(), set()
        for item, it in items:
            w = WORD.findall(lower(it))
            k = min(window, len(w))
            for s in range(len(w) - k + 1 if w else 0):
                for p in range(len(words) - k + 1):
                    if words[p : p + k] == w[s : s + k]:
                        hit.update(range(p, p + k))
                        names.add(str(item))
        out[(i, len(words), len(hit), tuple(sorted(names)), bool(hit) and 20 * len(hit) >= len(words))] += 1
    return out


def test_contamination(spark, docs, none, tmp_path):
    p = [f"t{i}" for i in range(40)]
    items = [(1, " ".join(p[:20])), (2, "Lazy-DOG again"), (3, None), (4, ""), (5, "É one's İx"), (10, " ".join(p[:20])), (6, "a a a a a a a a a a a a a a")]
    texts = [*TEXTS, (20, "x " + " ".join(p[3:18]) + " y " + " ".join(p[5:19])), (21, " ".join(p[:12])), (22, "é ONE S İX É one s i̇x"), (23, "a " * 30), (24, " ".join(p) * 2)]
    texts = [(i, t) for i, t in texts if t is None or len(t) < 10_000]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(spark.read.parquet(str(tmp_path / "d")), bench)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in got.collect()) == brute_contamination(texts, items)
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.without_contaminated(docs, bench).columns == docs.columns


def test_contamination_where_what_met_is_not_broadcast(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(2, "Lazy-DOG again"), (3, "a b a b"), (4, "one two")], "item_id long, text string")
    plain = Counter(map(str, decontaminate.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert Counter(map(str, decontaminate.contamination(docs, bench).collect())) == plain
    assert decontaminate.without_contaminated(docs, bench).columns == docs.columns


def test_contamination_of_texts_that_start_inside_an_item(spark, tmp_path):
    common = ["of", "the", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on"]
    words = [*common, *(f"rare{i}" for i in range(20))]
    items = [(1, " ".join(words)), (2, " ".join([*common[:6], *(f"odd{i}" for i in range(9)), *common, "end"]))]
    texts = [(100 * item + k, " ".join(it.split()[k:]) + tail) for item, it in items for k in range(1, 13) for tail in ("", " and more")]
    texts += [(900 + i, " ".join(common[i:] + common[:i])) for i in range(12)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = decontaminate.contamination(spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(items, "item_id long, text string"))
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"]), r["contaminated"]) for r in got.collect())
    assert got == brute_contamination(texts, items)
    assert sum(n for row, n in got.items() if row[0] < 200 and row[2] >= 20) == 24


def test_proximity(spark, docs):
    q = spark.createDataFrame([(1, "fox lazy"), (2, "fox today"), (3, None)], "item_id long, text string")
    out = {(r["item_id"], r["doc_id"], r["first_pos"], r["last_pos"]) for r in decontaminate.proximity_matches(docs, q, within=5).collect()}
    assert out == {(1, i, 3, 7) for i in (1, 2, 3)}


def test_licenses(spark, docs, none):
    assert 200 < len(licenses.rules()) < 2000
    texts = [(1, "Released under the MIT License. Released under-the mit\nlicense"), (2, "CC-BY-NC 4.0"), (3, "SPDX-License-Identifier: Apache-2.0"), (4, "mit dem hund"), (5, None), (6, "Apache License, Version 2.0 and all rights reserved")]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"), [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]).collect()}
    assert [b["word"] for b in found[1]["base"]] == [1, 6] and {d["label"] for d in found[1]["detections"]} == {"mit"}
    assert {d["label"] for d in found[2]["detections"]} == {"cc-by-nc"} and found[2]["base"][0]["label"] == "cc-by-nc"
    assert {d["label"] for d in found[3]["detections"]} == {"apache-2"}
    assert found[4]["detections"] == [] and found[4]["score"] == 0 and found[5]["n_words"] == 0
    assert {d["label"] for d in found[6]["detections"]} == {"apache-2", "proprietary"}
    assert licenses.scan_licenses(docs, []).count() == len(TEXTS) and licenses.scan_licenses(none, []).count() == 0


def test_phrase_places_overlap():
    assert licenses.detect("a a a b".split(), (("a a", "x"),))[0] == [("x", 0), ("x", 1)]
    assert licenses.detect([], (("a", "x"),)) == ([], [])


LICENSE_WORDS = (
    "released under the mit license", "apache license version 2 0", "cc by nc sa 4 0", "gnu general public license version 3", "all rights reserved", "gplv2", "mit", "the", "version 2",
    "redistribution and use in source and binary forms with or without modification are permitted", "spdx license identifier mpl 2 0", "under the mit", "license", "cc by nc", "zlib license",
    "licensed under the apache license version 2 0 the license", "not licensed under the", "gpl 2 0 or later", "lgpl version 2 1 only", "public domain", "never released under gpl version 3", "bsd 3 clause license", "permission is hereby granted free of charge to any person obtaining a copy",
)


def brute_licenses(words, phrases):
    """Every rule over the whole text, no keyword gate; each detection against all others."""
    joined = " ".join(words)
    number = lambda at: joined.count(" ", 0, at)
    raw = {(r.priority, m.start(), m.end(), r.label) for r in licenses.rules(phrases) if not r.phrase for m in r.pattern.finditer(joined)}
    order = lambda d: (-d[0], d[1] - d[2], d[1], d[3])
    kept = [d for d in raw if not any(order(k) < order(d) and k[1] <= d[1] and d[2] <= k[2] for k in raw)]
    places = [(label, i) for p, label in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return sorted(places), sorted((number(s), number(e) + 1, label) for _, s, e, label in kept if label)


def test_licenses_equal_brute_force():
    rng, phrases = random.Random(8), (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
    for _ in range(60):
        words = " ".join(rng.choices(LICENSE_WORDS, k=rng.randrange(30))).split()
        places, found = licenses.detect(words, phrases)
        assert (sorted(places), sorted((d.start, d.end, d.label) for d in found)) == brute_licenses(words, phrases)


@pytest.mark.parametrize("text,labels", [
    ("SPDX-License-Identifier: GPL-2.0-only", {"gpl-2-only"}), ("SPDX-License-Identifier: GPL-2.0-or-later", {"gpl-2-or-later"}), ("SPDX-License-Identifier: GPL-2.0", {"gpl-2"}),
    ("GPL version 2 only", {"gpl-2-only"}), ("the GNU GPL v3 or any later version", {"gpl-3-or-later"}), ("LGPL 2.1+", {"lgpl-2.1"}), ("under the LGPL 2.1 or later", {"lgpl-2.1-or-later"}),
    ("either version 2 of the License, or (at your option) any later version", {"gpl-2-or-later"}), ("Apache License 2.0 or later", {"apache-2"}),
    ("This code is not licensed under the MIT license", set()), ("not released under the terms of the GNU General Public License version 3 or later", set()),
    ("no longer available under the BSD license; licensed under the Apache License, Version 2.0", {"apache-2"}), ("It is not so bad. Licensed under the MIT License.", {"mit"}),
    ("public domain", {"public-domain"}), ("released into the public domain", {"public-domain"}), ("a public house, a domain", set()), ("not a license", set()),
    ("Mulan Permissive Software License v2", {"mulan"}), ("Use of this work for training: may not be used to train any AI models", {"no-ai-training"}),
])
def test_licenses_told_apart(text, labels):
    words = [w.decode() for w in licenses.normalised(text.encode())]
    assert {d.label for d in licenses.detect(words)[1]} == labels


def test_many_rules_by_hand():
    """Every keyword stands in what its rule matches: the gate hides nothing."""
    assert len(licenses.SENTENCES) > 220 and len({s[3] for s in licenses.SENTENCES}) > 220
    assert all(p < licenses.DENIED for _, p, _, _ in licenses.SENTENCES)
    for label, _, keyword, pattern in licenses.SENTENCES:
        every, depth = [""], 0
        for c in pattern:
            depth += (c == "(") - (c == ")")
            every = [*every, ""] if c == "|" and not depth else [*every[:-1], every[-1] + c]
        assert all(any(k in way for k in keyword.split("|")) for way in every), (label, keyword, pattern)


def test_licenses_of_long_texts():
    text = b"Released under the MIT License. Apache License, Version 2.0. All rights reserved.\n" * 60_000
    began = time.perf_counter()
    places, found = licenses.detect([w.decode() for w in licenses.normalised(text)], (("under the mit license", "mit"),))
    assert len(places) == 60_000 and len(found) >= 180_000 and time.perf_counter() - began < 30


def test_edits_equal_counting_anew(docs, none):
    enc = token_counts.encoder(token_counts.vocabulary_bytes(), token_counts.PATTERN)
    rng = random.Random(2)
    for text in ["", "a", "it's  fine\n\n  now", "été 2024!!! " * 60, "    " * 40]:
        tree, now = token_counts.TokenTree.of_leaves(*token_counts.leaves_of(enc, enc.cut.findall(text))), text
        for _ in range(60):
            a = rng.randrange(len(now) + 1)
            now, _ = token_counts.edit(enc, tree, now, a, a + rng.choice([0, 1, 5, 90]), rng.choice(["", " ", "x", "\n ", "'s", "wörld 12", "  "]))
            assert tree.n_tokens == len(enc.bpe.encode_ordinary(now)) and tree.n_chars == len(now)
            assert all(list(a) == list(b) for a, b in zip(tree.tokens, token_counts.TokenTree.of_leaves(tree.chars[0], tree.tokens[0]).tokens))
    trees = token_counts.build_trees(docs.select("doc_id", "text"))
    out = token_counts.apply_edits(trees.withColumn("edits", token_counts.scripted_edits())).collect()
    assert len(out) == len(TEXTS)
    assert all(r["n_tokens"] == len(enc.bpe.encode_ordinary(r["text"])) == sum(r["token_sums"][0]) for r in out)
    assert token_counts.build_trees(none).count() == 0


def test_deobfuscation():
    counts = toxicity.trigram_counts(["you idiot loser moron stupid pathetic the dog ran home and sat worthless"] * 50)
    model = toxicity.CharModel.fit(counts)
    for token, word in (("1d10t", "idiot"), ("l0ser", "loser"), ("m0r0n", "moron"), ("idioooot", "idiot"), ("s.t.u.p.i.d", "stupid"), ("word,", "word"), ("12345", "")):
        assert model.restore(token) == word
    assert "i d i o t" in toxicity.raw_tokens("you i d i o t there") and toxicity.raw_tokens(None) == set()
    assert model.restore("y o u i d i o t") == "you idiot" and model.restore("t h e d 0 g r a n") == "the dog ran"
    began = time.perf_counter()
    assert len(model.restore("a1" * 100_000)) > 100_000 and time.perf_counter() - began < 20


def test_toxicity_learns(spark, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice('aeiou')}t" for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["scumbag", "moronic", "sc0mbag" if i % 2 else "scumb@g"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1), (9000, None)], "doc_id long, toxic int")
    chars, judge = toxicity.fit(docs, marks)
    out = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, chars, judge).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((out[i] >= 0.5) == (i % 5 == 0) for i in held)
    assert right / len(held) > 0.95 and out[9000] == out[9001] < 0.5
    shouted = docs.withColumn("SCORE", F.lit("kept not"))
    assert toxicity.score_documents(shouted, chars, judge).columns == ["doc_id", "text", "score"]
    chars, judge = toxicity.fit(none.select("doc_id", "text"), marks.limit(0))
    assert toxicity.score_documents(none, chars, judge).count() == 0
