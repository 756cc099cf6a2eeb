"""Running values with a hot key dealt into cells: against plain folds and the DuckDB twins; closures of chains and cycles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import aggregates as A
from quillspark.operators import joins as J
from quillspark.operators import scan as S
from quillspark.operators import windows as W
from quillspark.plans import catalog
from tests.oracle import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(S, "LIMIT", 8)
    monkeypatch.setattr(S, "PER_CELL", 4)


@pytest.mark.parametrize("name", ["w01_prune", "w06_since_boundary", "w09_budget", "j20_as_of", "e15_daily_limit"])
def test_twins_hold_with_every_key_in_cells(spark, small, name):
    assert differences(spark, name, catalog.QUERIES[name], catalog.ORACLE[name], SF, duck(SF)) is None


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    got = [("hot" if i % 3 else f"k{i % 7}" if i % 5 else None, int(i), None if rng.random() < 0.2 else int(rng.integers(-9, 9))) for i in range(400)]
    return got, spark.createDataFrame(got, "k string, o long, v long").repartition(5)


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_every_running_value(rows, small, reverse, exclusive):
    plain, df = rows
    scan = S.Scan(df, ["k"], ["o"], reverse)
    assert scan.split and scan.rows.where("k = 'hot'").select("_cell").distinct().count() > 20
    assert scan.rows.where("k = 'hot'").groupBy("_cell").count().agg(F.max("count")).first()[0] < 100
    kinds = ("sum", "count", "min", "max", "last")
    got = {(r.k, r.o): tuple(r[x] for x in kinds) for r in scan.running(scan.rows, {x: (x, F.col("v")) for x in kinds}, exclusive).collect()}
    want, so_far = {}, {}
    for k, o, v in sorted(plain, key=lambda r: r[1], reverse=reverse):
        seen = so_far.setdefault(k, [])
        if not exclusive and v is not None:
            seen.append(v)
        want[k, o] = (sum(seen), len(seen), min(seen), max(seen), seen[-1]) if seen else (None, 0, None, None, None)
        if exclusive and v is not None:
            seen.append(v)
    assert {x: (y[0], y[1] or 0, *y[2:]) for x, y in got.items()} == want


def fold(rows):
    """The sequence of reverts by its definition."""
    standing = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        undone = standing.get(t[8:-1]) if t and t.startswith('Revert "') and t.endswith('"') and len(t) > 8 else None
        if undone:
            undone.pop()
        else:
            standing.setdefault(t, []).append(i)
    return sorted(i for kept in standing.values() for i in kept)


def test_reverts_of_a_hot_title(spark, small):
    rng = np.random.default_rng(6)
    wrap = lambda t, n: t if n == 0 else wrap(f'Revert "{t}"', n - 1)
    rows = [("g", i, wrap("a" if rng.random() < 0.8 else 'say "hi"', int(rng.choice([0, 0, 0, 1, 1, 2, 3])))) for i in range(300)]
    rows += [("h", i, t) for i, t in enumerate([None, "", "x", 'Revert "x"', 'Revert "Revert "x""', "Revert x", 'y "', 'Revert "y ""', None])]
    got = {}
    for r in A.without_reverts(spark.createDataFrame(rows, "g string, i long, t string"), "g", "i", "t").collect():
        got.setdefault(r.g, []).append(r.i)
    for g in ("g", "h"):
        assert sorted(got[g]) == fold([(i, t) for k, i, t in rows if k == g])


def test_escalation_and_budget_agree_with_one_window(rows, monkeypatch):
    _, df = rows
    df = df.withColumn("d", F.col("o") % 4 > 0)
    run = lambda: sorted((r.o, r.total, r.consecutive, r.escalate) for r in W.escalations(df, ["k"], "o", F.col("d")).collect())
    whole = run()
    monkeypatch.setattr(S, "LIMIT", 8)
    assert run() == whole


def below(edges, roots):
    out, todo = set(roots), list(roots)
    kids = {}
    for i, p in edges:
        kids.setdefault(p, []).append(i)
    while todo:
        for k in kids.get(todo.pop(), []):
            if k not in out:
                out.add(k)
                todo.append(k)
    return out


@pytest.mark.parametrize("edges, roots", [
    ([(i, i - 1 if i else None) for i in range(10_000)], [9_000, 20_000]),  # a chain, and a root outside the tree
    ([(1, 2), (2, 3), (3, 1), (4, 3), (5, 5), (6, 5), (7, None)], [2, 7]),  # cycles
    ([(1, 2), (2, 1), (3, 9), (4, 3)], [9]),  # a cycle without a root; a parent that isn't a node
    ([(i, 0) for i in range(1, 500)] + [(0, None)], [0]),
    ([], [1]),
])
def test_closure(spark, edges, roots):
    tree = spark.createDataFrame(edges, "id long, parent_id long")
    got = [r.id for r in J.descendants(tree, spark.createDataFrame([(r,) for r in roots], "id long")).collect()]
    assert sorted(got) == sorted(below(edges, roots))
