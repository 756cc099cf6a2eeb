"""Streams cut into many micro-batches, out of order and started again, against the batch forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.streaming import counters, eventlog, timers

SCHEMA = "g string, item string, at long, id long, cost long"


@pytest.fixture(scope="module")
def parts():
    """Nine files of rows, shuffled by up to half a minute; a last file lets the watermark pass them all."""
    rng = np.random.default_rng(8)
    at = np.sort(rng.integers(0, 600_000, 240)) + 1_000_000
    rows = [("hot" if i % 3 else f"g{i % 5}", f"i{int(rng.integers(4))}", int(t), i, int(rng.integers(1, 50))) for i, t in enumerate(at)]
    late = sorted(rows, key=lambda r: r[2] + int(rng.integers(0, 30_000)))
    return rows, [late[i:i + 30] for i in range(0, 240, 30)] + [[("end", "x", 900_000_000, 999, 0)]]


def run(spark, parts, make, root):
    """All files, in two queries one after the other: the second goes on from the first's checkpoint."""
    timers.prepare(spark)
    for some in (parts[:4], parts[4:]):
        for p in some:
            spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        out = make(stream)
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


def test_debounce(spark, parts, tmp_path):
    rows, files = parts
    got = run(spark, files, lambda s: timers.debounced_stream(s, "g", "item", "at", 20_000, ("id",)), str(tmp_path))
    want = eventlog.debounced(spark.createDataFrame(rows, SCHEMA), "g", "item", "at", 20_000, "id")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_anchored_window(spark, parts, tmp_path):
    rows, files = parts
    got = run(spark, files, lambda s: timers.anchored_stream(s, "g", "at", "cost", 50_000, ("id",)), str(tmp_path))
    want = counters.anchored(spark.createDataFrame(rows, SCHEMA), "g", "at", "cost", 50_000, "id")
    assert sorted(map(tuple, got.where("g <> 'end'").select(want.columns).collect())) == sorted(map(tuple, want.collect()))


class _State:
    """A state that counts what is read from it and written to it."""

    def __init__(self):
        self.held, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.held if not isinstance(self.held, list) else iter(self.held)

    def exists(self):
        return self.held is not None

    def update(self, x):
        self.held = x

    def put(self, x):
        self.calls.append("put")
        self.held = list(x)

    def appendValue(self, x):
        self.held = [*(self.held or []), x]

    def clear(self):
        self.held = None


def test_waiting_rows_are_read_once_and_as_blocks():
    from types import SimpleNamespace as Some

    from pyspark.sql.types import LongType, StructField, StructType

    states, woken = {}, []
    handle = Some(getListState=lambda n, s: states.setdefault(n, _State()), getValueState=lambda n, s: states.setdefault(n, _State()), registerTimer=woken.append)
    p = timers.Anchored(StructType([StructField(c, LongType()) for c in ("at", "id", "cost")]), "at", ("id",), "cost", 50)
    p.init(handle)
    out = []
    at = lambda t: Some(getCurrentWatermarkInMs=lambda: t)
    for k in range(5):
        rows = pd.DataFrame({"at": np.arange(100) + 100 * (4 - k), "id": np.arange(100), "cost": 1})
        out += list(p.handleInputRows(("g",), iter([rows]), at(-1)))
    assert not out and not states["waiting"].calls and len(states["waiting"].held) == 5
    first = pd.concat(p.handleExpiredTimer(("g",), at(250), None))
    rest = pd.concat(p.handleExpiredTimer(("g",), at(10_000), None))
    assert states["waiting"].calls == ["get", "put", "get"] and states["waiting"].held is None
    both = pd.concat([first, rest])
    assert len(first) == 250 and both["at"].tolist() == list(range(500))
    assert both["used"].tolist() == [t % 51 + 1 for t in range(500)] and both["anchor"].tolist() == [t // 51 * 51 for t in range(500)]
    assert not list(p.handleExpiredTimer(("g",), at(20_000), None)) and woken[0] == 401 and woken[-1] == 251


def test_sticky_values_expire(spark, parts, tmp_path):
    rows, files = parts
    rows = rows + [("early", "e", 1_000_500, 500, 0)]
    files = [files[0] + rows[-1:], *files[1:-1], [("late", "x", 1_000_000 + 3_700_000, 999, 0)]]
    got = run(spark, files, lambda s: timers.sticky_stream(s, "g", "item", "at", 1), str(tmp_path))
    now = 1_000_000 + 3_700_000 - 60_000  # the watermark
    held = {}
    for r in got.orderBy("at", F.col("change").desc()).collect():
        held[r.key] = r.value if r.change == "set" else None
    want = {g: max((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])) for g in {r[0] for r in rows}}
    assert {g: held[g] for g in want} == {g: r[1] if r[2] + 3_600_000 > now else None for g, r in want.items()}
    assert None in held.values() and any(held.values())


def test_state_log_grows_with_its_batches(spark, tmp_path):
    rng = np.random.default_rng(1)
    root, schema = str(tmp_path / "log"), spark.createDataFrame([], "k string, seq long, v string").schema
    log = eventlog.StateLog(spark, root, schema, "k", "seq", ratio=1.0, buckets=4)
    want, sizes = {}, []
    for epoch in range(5):
        n = 200 if epoch == 0 else 20
        rows = [(f"k{int(rng.integers(150))}" if rng.random() < 0.7 else None if rng.random() < 0.1 else "hot", int(rng.integers(50)), f"{epoch}.{i}") for i in range(n)]
        df = spark.createDataFrame(rows, schema)
        log.append(df, epoch)
        log.append(df, epoch)  # a batch that is run again changes nothing
        sizes.append(spark.read.parquet(f"{root}/deltas").where(F.col("epoch") == epoch).count())
        for k, s, _ in rows:
            want[k] = max(want.get(k, (-1, -1)), (s, epoch))
        got = {r.k: (r.seq, int(r.v.split(".")[0])) for r in log.read().collect()}
        assert got == want
    assert sizes[0] > 80 and all(n <= 20 for n in sizes[1:])
    assert 1 <= log._pointers().count() <= 3  # bases are rare
    again = eventlog.StateLog(spark, root, schema, "k", "seq")
    log.compact(4)
    assert {r.k: (r.seq, int(r.v.split(".")[0])) for r in again.read().collect()} == want
    assert again.deltas(again._newest()[0]).isEmpty() and f"{root}/base/v0" in again.obsolete()
