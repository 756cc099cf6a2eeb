"""Many patterns against many texts by trying all pairs; medians of large groups."""

import re
import statistics

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions.text import wildcard
from quillspark.operators import aggregates as A
from quillspark.operators import patterns as P
from quillspark.operators import scan as S


def world():
    rng = np.random.default_rng(9)
    name = lambda: "".join(rng.choice(list("ab/. -"), int(rng.integers(0, 9))))
    texts = [(i, name()) for i in range(150)] + [(900, "git"), (901, "git status"), (902, ""), (903, "a\nb"), (904, "x" * 90), (905, None), (906, "a(b)[c]+$")]
    made = ["".join(rng.choice(list("ab/.*?* "), int(rng.integers(0, 7)))) for _ in range(400)]
    made += ["git *", "*", "?", "??", "**", "*?", "a\\b*", "", "x*x", "*" + "x" * 70, "x" * 70 + "*", "a(b)*", "*[c]+$", "*b*b*", "*ab.a*"]
    return texts, [(i, p, f"v{i}") for i, p in enumerate(made)]


def test_all_pairs(spark):
    texts, rules = world()
    t, r = spark.createDataFrame(texts, "id long, path string"), spark.createDataFrame(rules, "ord long, pattern string, v string")
    want = {(i, o) for i, x in texts if x is not None for o, p, _ in rules if re.search(wildcard(p), x)}
    got = [(x.id, x.ord) for x in P.matches(t, r, "path").collect()]
    assert set(got) == want and len(got) == len(want)
    last = {x.id: x.v for x in P.last_rule(t, r, "path", "id", F.col("ord"), "v", "ask").collect()}
    assert last == {i: next((f"v{o}" for o in range(len(rules) - 1, -1, -1) if (i, o) in want), "ask") for i, _ in texts}


def test_no_rules(spark):
    t, r = spark.createDataFrame([(1, "a")], "id long, path string"), spark.createDataFrame([], "ord long, pattern string, v string")
    assert [tuple(x) for x in P.last_rule(t, r, "path", "id", F.col("ord"), "v", "ask").collect()] == [(1, "ask")]


def test_a_hundred_thousand_rules_meet_by_an_equi_join(spark):
    t = spark.range(20_000).select("id", F.concat(F.lit("notes/"), F.col("id") % 500, F.lit("/file-"), "id", F.lit(".md")).alias("path"))
    r = spark.range(100_000).select(F.col("id").alias("ord"), F.concat(F.lit("notes/"), F.col("id") % 500, F.lit("/file-"), "id", F.lit("*")).alias("pattern"), F.col("id").alias("v"))
    out = P.last_rule(t, r, "path", "id", F.col("ord"), "v")
    got = {x.id: x.v for x in out.where("id % 1000 = 7").collect()}
    want = lambda i: max(n for n in {int(str(i)[:k]) for k in range(1, len(str(i)) + 1)} if n % 500 == i % 500)
    assert got == {i: want(i) for i in got} and len(got) == 20
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"(HashJoin|SortMergeJoin).*_anchor", plan)


def test_medians(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("hot", None if rng.random() < 0.1 else int(rng.integers(60))) for _ in range(501)] + [("a", 5), ("b", 1), ("b", 2), ("none", None), (None, 3), (None, 9), (None, 4)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(3)
    want = {k: float(statistics.median([v for g, v in rows if g == k and v is not None] or [0])) for k in {k for k, _ in rows}}
    for limit in (1_000_000, 10):
        monkeypatch.setattr(S, "LIMIT", limit)
        assert {r.k: r.median for r in A.medians(df, ["k"], "v").collect()} == want
