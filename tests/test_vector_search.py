"""Vector search against brute force: blocks, parts, index, recall, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import retrieval as R
from quillspark.operators import vector_search as V
from quillspark.plans import catalog


def brute(vectors, queries, k):
    out = {}
    for q, e in queries:
        rows = []
        for i, v in vectors:
            if v is None or len(v) != len(e) or any(x is None for x in v):
                continue
            a, b = np.array(v, float), np.array(e, float)
            d = np.linalg.norm(a) * np.linalg.norm(b)
            rows.append((-(round(float(a @ b / d), 9) if d > 1e-10 else 0.0), i))
        out[q] = [(i, -s) for s, i in sorted(rows)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query", F.desc("score"), "id").collect():
        out.setdefault(r.query, []).append((r.id, round(r.score, 9)))
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(8, 12))
    rows = [(int(i), [float(x) for x in np.float32(centre[i % 8] + 0.3 * rng.normal(size=12))]) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # one common vector, a quarter of all rows
    rows += [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [1.0, 2.0]), (2004, [None] * 12), (2005, [3.0, -1.0])]
    queries = [(i, e) for i, e in rows[:600:50]] + [(2003, [1.0, 2.0]), (7000, [0.0] * 12)]
    return rows, queries, spark.createDataFrame(rows, "id long, embedding array<float>"), spark.createDataFrame(queries, "query long, query_embedding array<float>")


def same(got, want):
    assert set(got) == {q for q, r in want.items() if r}
    for q, rows in got.items():
        assert [i for i, _ in rows] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in rows], [s for _, s in want[q]], atol=1e-6)


def test_blocks_sent_to_the_vectors(world):
    rows, queries, v, q = world
    same(found(V.block_scores(v, q, k=5)), brute(rows, queries, 5))


def test_parts_that_meet_by_a_shuffle(world, monkeypatch):
    rows, queries, v, q = world
    for name, value in (("QUERY_BYTES", 1), ("VECTOR_PART", 90), ("QUERY_PART", 3), ("BLOCK", 64)):
        monkeypatch.setattr(V, name, value)
    same(found(V.block_scores(v, q, k=5)), brute(rows, queries, 5))
    near = V.block_scores(v, q, above=0.9)
    want = sum(s > 0.9 for r in brute(rows, queries, 10_000).values() for _, s in r)
    assert near.count() == want == near.select("query", "id").distinct().count()


@pytest.mark.parametrize("few", [True, False])
def test_pairs_of_few_digits_are_those_that_sql_rounds(world, monkeypatch, few):
    _, _, v, q = world
    for name, value in (("QUERY_BYTES", V.QUERY_BYTES if few else 1), ("VECTOR_PART", 90), ("QUERY_PART", 3), ("PAIRS", 64), ("STRIP", 10), ("TASK_PAIRS", 100)):
        monkeypatch.setattr(V, name, value)
    for above in (None, 0.25):
        for digits in (2, 6):
            got = V.block_scores(v, q, above=above, digits=digits).select("query", "id", "score")
            want = V.block_scores(v, q, above=above).select("query", "id", F.round("score", digits))
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        V.block_scores(v, q, k=3, digits=6)


def test_halves_are_rounded_as_sql_rounds_them(spark):
    values = [0.5, -0.5, 0.125, 0.0000005, -0.0000005, 0.1234565, -0.1234565, 0.1234575, 0.000001, 0.0]
    v = spark.createDataFrame([(i, [x, (1 - x * x) ** 0.5]) for i, x in enumerate(values)], "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query long, query_embedding array<double>")
    got = dict(V.block_scores(v, q, digits=6).select("id", "score").collect())
    want = dict(spark.createDataFrame(list(enumerate(values)), "id long, x double").select("id", F.round("x", 6)).collect())
    assert got == want and str(got[4]) == str(want[4])  # and no negative zero where SQL has none


def test_all_pairs_take_little_room_and_no_task_makes_too_many(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(4000, 16)).astype(np.float32))]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").coalesce(1)
    q = v.where("id % 5 = 0").select(F.col("id").alias("query"), F.col("embedding").alias("query_embedding"))
    pairs = R.similarities(v, q, digits=6)
    pairs.write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 4000 * 800
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 6.5 * 4000 * 800  # 8 bytes and more in any other order
    monkeypatch.setattr(V, "TASK_PAIRS", 400_000)
    share = R.similarities(v, q, digits=6).groupBy(F.spark_partition_id()).count().select("count").collect()
    assert len(share) == 8 and max(r[0] for r in share) <= 1.1 * 400_000


def test_registered_pairs_are_sorted_blocks(spark):
    rows = catalog.QUERIES["j15_similarity"](spark, "/root/testdata/sf0.1").where("id < 500").select("score").collect()
    assert all(a.score >= b.score for a, b in zip(rows, rows[1:], strict=False))  # one file, one block


def test_index_is_exact_and_its_search_finds_nearly_all(spark, world, tmp_path, monkeypatch):
    rows, queries, v, q = world
    monkeypatch.setattr(V, "VECTOR_PART", 60)  # the common vector's cell is several tasks
    V.VectorIndex.build(v.where("id < 300 OR id >= 1000"), str(tmp_path / "x"), cells=12)
    index = V.VectorIndex.open(spark, str(tmp_path / "x"))
    index.add(v.where("id >= 300 AND id < 1000"))
    want = brute(rows, queries, 5)
    same(found(index.search_exact(q, 5, probes=2)), want)
    same(found(index.search(q, 5, probes=12)), want)
    truth = V.block_scores(v, q, k=5)
    probes = index.probes_for(q, 5, 0.95)
    assert probes < 12
    assert V.recall(index.search(q, 5, probes), truth, 5).agg(F.avg("recall")).first()[0] >= 0.9


def test_recall_of_the_registered_index(spark):
    d = "/root/testdata/sf0.1"
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_embedding"))
    got = catalog.QUERIES["r06_index_search"](spark, d)
    assert V.recall(got, V.block_scores(v, q, "vec_id", k=10), 10).agg(F.avg("recall")).first()[0] >= 0.9


def test_nothing_to_search(spark, tmp_path):
    v = spark.createDataFrame([], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0])], "query long, query_embedding array<float>")
    assert not V.block_scores(v, q, k=3).collect()
    assert not V.block_scores(q.toDF("id", "embedding"), q.where("query < 0"), k=3).collect()
    assert not V.VectorIndex.build(v, str(tmp_path / "y")).search(q, 3).collect()
