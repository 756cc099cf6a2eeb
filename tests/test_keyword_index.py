"""The stored keyword index and hybrid search against brute force; changes, odd texts, skipping."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import keyword_index as K
from quillspark.operators import retrieval as R
from quillspark.plans import catalog, views
from quillspark.plans import retrieval as PR

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[^\w]+", (text or "").lower()) if w]


def brute(docs, queries, k):
    """Scores of (id, text) rows for (query, terms)."""
    held = {i: Counter(words(t)) for i, t in docs if words(t)}
    size = {i: sum(c.values()) for i, c in held.items()}
    mean = sum(size.values()) / len(size) if size else 1
    out = {}
    for q, terms in queries:
        rows = []
        for i, c in held.items():
            s = 0.0
            for t in dict.fromkeys(terms):
                if tf := c.get(t):
                    df = sum(t in x for x in held.values())
                    s += math.log((len(held) - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[i] / mean))
            if s:
                rows.append((-round(s, 9), i))
        out[q] = [(i, -s) for s, i in sorted(rows)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query", F.desc("score"), "id").collect():
        out.setdefault(r.query, []).append((r.id, r.score))
    return out


def same(got, want):
    assert set(got) == {q for q, r in want.items() if r}
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-7)


@pytest.fixture(scope="module")
def world():
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    docs = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 80)), p=p / p.sum()))) for i in range(150)]
    docs += [(500 + i, "w1 w2, w3! the same text") for i in range(60)]  # one group of copies
    docs += [(900, None), (901, ""), (902, " .,! "), (903, "w1 " * 3000), (904, "Ünï W1 wörd 日本")]
    queries = [(q, [vocabulary[int(x)] for x in rng.integers(0, 60, 4)]) for q in range(12)] + [(50, ["w1"]), (51, ["missing"]), (52, []), (53, ["ünï", "w1", "w1"])]
    return docs, queries


def frames(spark, docs, queries):
    rows = spark.createDataFrame(docs, "id long, text string")
    return rows, spark.createDataFrame(queries, "query long, terms array<string>")


def test_search_skips_groups_and_loses_nothing(spark, world, tmp_path, monkeypatch):
    docs, queries = world
    monkeypatch.setattr(K, "GROUP", 10)
    monkeypatch.setattr(K, "FIRST", 1)
    rows, asked = frames(spark, docs, queries)
    index = K.KeywordIndex.build(rows, str(tmp_path / "i"), buckets=4)
    same(found(index.search(asked, 5)), brute(docs, queries, 5))
    terms = index._asked(asked)
    bound = {(r.query, r.grp): r.bound for r in index.bounds(terms, index.stats()[1]).collect()}
    groups = index._read("postings").select("grp", F.explode("rows.id").alias("id")).distinct()
    every = index._scores(terms, index.bounds(terms, index.stats()[1]).select("query", "grp"), index.stats()[1]).join(groups, "id")
    assert all(r.score <= bound[r.query, r.grp] + 1e-8 for r in every.collect())


def test_changes_and_compaction(spark, world, tmp_path):
    docs, queries = world
    rows, asked = frames(spark, docs, queries)
    index = K.KeywordIndex.build(rows, str(tmp_path / "i"), buckets=4)
    state = dict(docs)
    for i in (1, 2, 500, 903):
        del state[i]
    index.remove(spark.createDataFrame([(1,), (2,), (500,), (903,)], "id long"))
    for i, t in ((3, "w1 w1 changed"), (2, "w5 back again"), (4, None)):
        state[i] = t
    changed = spark.createDataFrame([(3, 3, "w1 w1 changed"), (2, 2, "w5 back again"), (4, 4, None)], "owner long, id long, text string")
    index.add(changed)
    index.add(changed)  # as when it is run again
    want = brute(list(state.items()), queries, 5)
    same(found(index.search(asked, 5)), want)
    again = index.compact(str(tmp_path / "j"))
    same(found(again.search(asked, 5)), want)
    assert again.stats() == pytest.approx(index.stats())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_many_queries_are_added_up_by_group(spark, world, tmp_path, monkeypatch, kind):
    docs, queries = world
    monkeypatch.setattr(K, "GROUP", 10)
    monkeypatch.setattr(K, "FEW", 0)
    monkeypatch.setattr(K, "SENT", 20)  # in several parts
    rows, asked = frames(spark, docs, queries)
    index = K.KeywordIndex.build(rows.withColumn("id", F.col("id").cast(kind)), str(tmp_path / "i"), buckets=4)
    index.remove(spark.createDataFrame([(1,), (500,), (903,)], "id long").select(F.col("id").cast(kind)))
    left = [(i if kind == "long" else str(i), t) for i, t in docs if i not in (1, 500, 903)]
    same(found(index.search(asked, 5)), brute(left, queries, 5))
    kept = index._many(index._asked(asked), index.stats()[1], 5)
    assert kept.groupBy("query", F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 5


def test_an_owner_stands_once_and_no_word_is_shuffled(spark, world, tmp_path):
    docs, _ = world
    rows = spark.createDataFrame([(f"path {i}", i, t) for i, t in docs], "owner string, id long, text string")
    index = K.KeywordIndex.build(rows, str(tmp_path / "i"), owner="owner", buckets=4)
    n, _ = index.stats()
    names = index._read("postings").select(F.explode("rows.owner"))
    assert names.count() == n == len([1 for _, t in docs if words(t)])
    assert "Exchange" not in K._grouped(rows, 0)._jdf.queryExecution().executedPlan().toString()


def test_sync_of_chunks(spark, tmp_path):
    files = {"a": "w1 one", "b": "w1 w1 two", "c": "gone"}
    old = spark.createDataFrame(list(files.items()), "path string, text string")
    chunk = lambda df: R.chunks(df, tokens=32, overlap=0).select(F.col("path").alias("owner"), F.concat_ws("#", "path", "idx").alias("id"), "text")
    index = K.KeywordIndex.build(chunk(old), str(tmp_path / "i"), owner="owner", buckets=2)
    long = "w1 " * 200
    new = spark.createDataFrame([("a", "w1 one"), ("b", long)], "path string, text string")
    plan = spark.createDataFrame([("a", "skip"), ("b", "index"), ("c", "delete")], "path string, action string")
    index.sync(plan, chunk(new))
    got = {r.id for r in index.scores(["w1", "gone", "two"]).collect()}
    assert got == {"a#0"} | {f"b#{i}" for i in range(len(R.chunk_text(long, 32, 0)))} and len(got) > 4


def test_no_texts(spark, tmp_path):
    rows, asked = frames(spark, [], [(1, ["a"])])
    index = K.KeywordIndex.build(rows, str(tmp_path / "i"), buckets=2)
    assert not index.search(asked, 3).collect() and not index.scores(["a"]).collect()
    assert not R.bm25_scan(rows, "id", "text", ["a"]).collect()


def greedy(rows, limit):
    """Maximal marginal relevance by its definition."""
    sets = {i: {t for t in re.split(r"[^A-Za-z0-9_]+", x.lower()) if len(t) > 1} for i, _, x in rows}
    left, out = sorted(rows, key=lambda r: (-r[1], r[0])), []
    while left and len(out) < limit:
        def worth(r):
            near = max((len(sets[r[0]] & sets[o]) / len(sets[r[0]] | sets[o]) if sets[r[0]] | sets[o] else 0.0 for o in out), default=0.0)
            return 0.7 * r[1] - 0.3 * near
        best = left[0] if not out else max(left, key=worth)
        out.append(best[0])
        left.remove(best)
    return out


def test_diversity_of_every_query(spark):
    texts = {r.id: r.text for r in views.file(spark, SF).collect()}
    got = {}
    for r in catalog.QUERIES["r11_mmr"](spark, SF).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.id)
    n = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert len(got) == n > 3
    k = R.rank_scale(PR._by_keyword(spark, SF, 30).withColumn("rank", -F.col("score")), by=("query",))
    v = PR._near(spark, SF, 30)
    merged = R.decayed(R.merged_legs(v, k).join(views.file(spark, SF).select("id", "path"), "id"), F.lit("2025-12-01").cast("timestamp")).toPandas()
    for q, rows in merged.groupby("query"):
        assert got[q] == greedy([(i, s, texts[i]) for i, s in zip(rows["id"], rows["score"], strict=True)], 10), q


def test_pipeline_takes_every_step(spark):
    texts = {r.id: r.text for r in views.file(spark, SF).collect()}
    k = R.rank_scale(PR._by_keyword(spark, SF, 30).withColumn("rank", -F.col("score")), by=("query",))
    legs, files, now = (PR._near(spark, SF, 30), k), views.file(spark, SF).select("id", "path", "text"), F.lit("2025-12-01").cast("timestamp")
    merged = R.decayed(R.merged_legs(*legs).join(files.select("id", "path"), "id"), now).where("score >= 0.05").toPandas()
    kept = {q: [(i, s, texts[i]) for i, s in zip(rows["id"], rows["score"], strict=True)] for q, rows in merged.groupby("query")}
    order = lambda df: {q: rows.sort_values("rank")["id"].tolist() for q, rows in df.toPandas().groupby("query")}
    diverse, plain = order(catalog.QUERIES["r12_pipeline"](spark, SF)), order(R.hybrid(*legs, files, now, min_score=0.05, mmr=False))
    assert diverse == {q: greedy(rows, 10) for q, rows in kept.items()}
    assert plain == {q: [i for i, _, _ in sorted(rows, key=lambda r: (-r[1], r[0]))][:10] for q, rows in kept.items()}
    assert diverse != plain  # the last step is more than a slice
