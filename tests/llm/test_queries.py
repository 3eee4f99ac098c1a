"""The registered queries of the subpackage against SQL, and the pipeline's stages against plain Python."""

from __future__ import annotations

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_small_cases import brute_components, brute_contamination
from tests.test_queries import canonical
from tidewell.llm import mixing, toxicity
from tidewell.llm import queries as llm

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_query(name, spark, sf_dir):
    got = llm.queries()[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    if name in SQL:
        con = duckdb.connect()
        for f in os.listdir(sf_dir):
            con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{Path(sf_dir) / f}'")
        want = con.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_held_out_fold(spark, sf_dir):
    out = llm.op10_toxicity(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in out)


def test_held_out_labels(spark):
    """Scores of labelled documents that no model has seen: ranked right, most toxic ones found, few false alarms."""
    where = os.environ.get("TEST_LABELS_DIR", "/root/testdata/sf0.1")
    known = dict(map(tuple, spark.read.parquet(f"{where}/labels.parquet").filter("toxic is not null").select("doc_id", "toxic").collect()))
    out = [(r["score"], known[r["doc_id"]]) for r in llm.op10_toxicity(spark, where).filter("held_out").collect() if r["doc_id"] in known]
    toxic, clean = [[s for s, t in out if t == k] for k in (1, 0)]
    wins = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    recall, alarms = sum(s >= 0.5 for s in toxic) / len(toxic), sum(s >= 0.5 for s in clean) / len(clean)
    print("held out:", len(toxic), len(clean), "AUC", wins, "recall", recall, "false alarms", alarms)
    assert wins > 0.95 and recall > 0.85 and alarms < 0.01


def rendezvous(key, n):
    def score(s):
        u = ((int(hashlib.md5(f"{key}|{s}".encode()).hexdigest()[:15], 16) >> 8) + 0.5) * 2.0**-52
        return -1 / math.log(u)

    return max(range(n), key=lambda s: (score(s), -s))


def test_pipeline_stages_equal_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    chars, judge = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        got = Counter((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect())
        rows = Counter((i, t) for i, t, _ in before)
        if name == "toxicity":
            want = Counter({k: n for k, n in rows.items() if judge.score({f for x in {*map(chars.restore, toxicity.raw_tokens(k[1])), *toxicity.cut_words(k[1], chars, judge.words(), {})} for f in toxicity.features(x)}) < 0.5})
        elif name == "ngram_join":
            parts = brute_components([(i, t) for i, t, _ in before], 5, 80)
            want = Counter({k: 1 for k in rows if any(i == k[0] == c or (i == k[0] and not n) for i, n, c in parts)})
        elif name == "decontamination":
            dirty = {i for i, _, _, _, bad in brute_contamination([(i, t) for i, t, _ in before], bench) if bad}
            want = Counter({k: n for k, n in rows.items() if k[0] not in dirty})
        elif name == "mixing":
            sizes = defaultdict(int)
            for _, t, s in before:
                sizes[s] += len((t or "").encode().split())
            order = sorted(sizes, key=lambda s: (s is None, s or ""))
            target = dict(zip(order, mixing.share_out([sizes[s] for s in order], [[3, 1, 2][i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2)))
            want, first = Counter(), defaultdict(int)
            at = lambda i, t: (int(hashlib.md5(f"{i}|{hashlib.md5((t or '').encode()).hexdigest()}|{len((t or '').encode().split())}".encode()).hexdigest()[:15], 16), i)
            for i, t, s in sorted(before, key=lambda r: at(r[0], r[1])):
                n, demand = len((t or "").encode().split()), round(target[s])
                if n:
                    full = demand // sizes[s]
                    more = 2 * (demand - full * sizes[s] - first[s]) >= n and full * sizes[s] + first[s] + n <= 2 * sizes[s]
                    want[(i, t)] += full + more
                    first[s] += n
            want = +want
        else:
            want = rows
            assert out.columns == [*docs.columns, "shard", "slot"]
            assert all(r["shard"] == rendezvous(r["doc_id"], corpus_pipeline.SHARDS) for r in out.collect())
            assert all(sorted(s) == list(range(len(s))) for _, s in out.toPandas().groupby("shard")["slot"])
        assert got == want, name
        kept.append(sum(got.values()))
        docs = out
    assert len(kept) == 5 and all(kept)


def test_pipeline_of_nothing_and_with_clashing_columns(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = docs.withColumns({"size": F.lit("s"), "toxicity_score_": F.lit("t"), "node": F.lit(1), "shard": F.lit("old"), "slot": F.lit("old"), "h": F.lit(2), "rows": F.lit(None).cast("int")})
    for n, (name, table) in enumerate((("empty", docs.limit(0)), ("odd", odd))):
        for stage, run in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{name}-{stage}"
            run(spark, table, sf_dir).write.parquet(path)
            table = spark.read.parquet(path)
        assert set(table.columns) == {*(docs if not n else odd).columns, "shard", "slot"}
        assert (table.count() > 0) == bool(n)


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.toPandas()
    known = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(known[i].startswith(t) for i, t in zip(rows["doc_id"], rows["text"]))
    assert all(sorted(s) == list(range(len(s))) for _, s in rows.groupby("shard")["slot"])
