"""Event logs: ordered, deduplicated, projected. Batch forms are exact; streams
use the same rules with keyed state, or per-batch folds into the current tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from quillspark.operators.writes import upsert

REPLAY = "aggregate_id string, seq long, id string, type string, data string, outcome string, expected long"


def numbered(events: DataFrame, heads: DataFrame, order: str) -> DataFrame:
    """Next sequence numbers after each aggregate's head; the first is 0."""
    n = F.row_number().over(Window.partitionBy("aggregate_id").orderBy(order))
    return events.join(heads, "aggregate_id", "left").withColumn("seq", F.coalesce("head", F.lit(-1)) + n).drop("head")


def replay(events: DataFrame, heads: DataFrame, known: list[str] | None = None, arrived: str = "arrived") -> DataFrame:
    """Outcome of each arriving event (E02): 'apply', 'ignore' (seq at or below the head), 'gap' or
    'unknown'. The head is the running maximum of what was applied; after a gap or an unknown type
    nothing more of that aggregate is applied."""
    w = Window.partitionBy("aggregate_id").orderBy(arrived).rowsBetween(Window.unboundedPreceding, -1)
    rows = events.join(heads, "aggregate_id", "left").withColumn("_head", F.coalesce("head", F.lit(-1)))
    top = F.greatest("_head", F.coalesce(F.max("seq").over(w), F.lit(-1)))
    strange = ~F.col("type").isin(known) if known is not None else F.lit(False)
    rows = rows.withColumn("expected", top + 1)
    one = F.when(F.col("seq") < F.col("expected"), "ignore").when(strange, "unknown").when(F.col("seq") > F.col("expected"), "gap").otherwise("apply")
    rows = rows.withColumn("_one", one).withColumn("_broken", F.max(F.col("_one").isin("gap", "unknown").cast("int")).over(w))
    out = F.when(F.coalesce("_broken", F.lit(0)) == 1, "halted").otherwise(F.col("_one"))
    return rows.withColumn("outcome", out).drop("head", "_head", "_one", "_broken")


def replay_stream(events: DataFrame, known: list[str] | None = None, arrived: str = "seq") -> DataFrame:
    """The same over a stream, with the head of each aggregate as state. An aggregate's events of one
    micro-batch are put in the order of their arrival."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head, broken = state.get if state.exists else (-1, False)
        out = []
        for r in pd.concat(batches).sort_values(arrived, kind="stable").itertuples(index=False):
            if broken:
                outcome = "halted"
            elif r.seq <= head:
                outcome = "ignore"
            elif known is not None and r.type not in known:
                outcome = "unknown"
            else:
                outcome = "gap" if r.seq > head + 1 else "apply"
            out.append((key[0], r.seq, r.id, r.type, r.data, outcome, head + 1))
            broken = broken or outcome in ("gap", "unknown")
            head = max(head, r.seq)
        state.update((head, broken))
        yield pd.DataFrame(out, columns=["aggregate_id", "seq", "id", "type", "data", "outcome", "expected"])

    return events.groupBy("aggregate_id").applyInPandasWithState(step, REPLAY, "head long, broken boolean", "append", GroupStateTimeout.NoTimeout)


def latest_versions(registry: dict[str, int]) -> list[str]:
    """Types that may still be emitted (E03): 'name.version' of each name's newest version."""
    return [f"{name}.{version}" for name, version in sorted(registry.items())]


def project(base: DataFrame, events: DataFrame, key: str, values: list[str], parents: DataFrame | None = None, parent: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(next state, dropped events) of created, updated and removed events.

    The last event of a key decides; ``time_created`` stays as it first was, in ``base`` or in the first
    event, but a row that is put again after its removal is new. An event whose parent is gone is dropped. ``events`` has the key, seq, kind ('put' or 'remove') and the values."""
    dropped = events.limit(0)
    if parents is not None:
        ids = parents.select(F.col(parents.columns[0]).alias(parent))
        dropped = events.join(ids, parent, "left_anti")
        events = events.join(ids, parent, "left_semi")
    gone = events.where("kind = 'remove'").groupBy(key).agg(F.max("seq").alias("_gone"))
    live = events.where("kind = 'put'").join(gone, key, "left").where("_gone IS NULL OR seq > _gone")
    last = live.groupBy(key).agg(F.max_by(F.struct(*values), "seq").alias("_l"), F.min_by("time_created", "seq").alias("_first"))
    put = last.select(key, "_l.*", "_first").withColumn("time_created", F.col("_first")).select(key, *values)
    return upsert(base.select(key, *values).join(gone, key, "left_anti"), put, [key], keep=("time_created",)), dropped


def with_deltas(parts: DataFrame, deltas: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Appends ordered text deltas to existing parts; deltas of unknown parts are ignored."""
    joined = deltas.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "").alias("_more"))
    return parts.join(joined, key, "left").withColumn(text, F.concat(F.coalesce(text, F.lit("")), F.coalesce("_more", F.lit("")))).drop("_more")


def debounced(items: DataFrame, group: str, key: str, time_ms: str, wait_ms: int = 1000, *ties: str) -> DataFrame:
    """Batches that open at their first item and close ``wait_ms`` later (E08): in a batch the last
    item of a key counts, of equal times the one with the greatest ``ties``. When a batch opens depends
    on the one before, so rows stream past in order of group and time, and only the last opening is
    carried; the last item is a partial aggregate. Items without a time are in no batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opened = None, None
        for b in batches:
            starts = []
            for g, t in zip(b.column(group).to_pylist(), b.column(time_ms).to_pylist(), strict=True):
                if opened is None or g != last or t >= opened + wait_ms:
                    last, opened = g, t
                starts.append(opened)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts, pa.int64())], [*b.schema.names, "batch_start"])

    schema = StructType([*items.schema.fields, StructField("batch_start", LongType())])
    timed = items.where(F.col(time_ms).isNotNull()).repartition(group).sortWithinPartitions(group, time_ms)
    newest = F.max_by(F.struct(*items.columns), F.struct(time_ms, *ties)).alias("_last")
    return timed.mapInArrow(run, schema).groupBy(group, "batch_start", key).agg(newest).select("_last.*", "batch_start")


def retained(df: DataFrame, time: str, now: Column, days: int = 7) -> DataFrame:
    """Rows not older than a number of days."""
    return df.where(F.col(time) >= now - F.expr(f"INTERVAL {days} DAYS"))


def of_type(stream: DataFrame, kind: str | None) -> DataFrame:
    """A typed subscription, or all events for None."""
    return stream if kind is None else stream.where(F.col("type") == kind)


class StateLog:
    """The latest row of each key, kept as a base and the deltas after it.

    A batch writes its own latest rows, by bucket of the key, in a folder named by its number: the bytes
    written grow with the batch, and a batch that is run again writes the same folder. Once the deltas hold
    more rows than ``ratio`` bases, base and deltas are merged into a new base, so a row is rewritten a
    bounded number of times for each doubling of the state. A base counts from when its pointer is written,
    after its rows; readers use the newest pointer and the deltas after it. Equal orders go to the later
    batch. Files that no reader needs any more are left to ``obsolete``."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str, order: str, ratio: float = 1.0, buckets: int = 16):
        self.spark, self.root, self.schema, self.key, self.order, self.ratio, self.buckets = spark, root.rstrip("/"), schema, key, order, ratio, buckets
        self.rest = [c for c in schema.names if c != key]

    def _latest(self, rows: DataFrame) -> DataFrame:
        last = F.max_by(F.struct(*self.rest, "_epoch"), F.struct(self.order, "_epoch", F.xxhash64(*self.rest)))
        return rows.groupBy(self.key).agg(last.alias("_r")).select(self.key, "_r.*").select(*self.schema.names, "_epoch")

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema("epoch long, rows long").json(f"{self.root}/bases")

    def _start(self) -> None:
        self.spark.createDataFrame([], "epoch long, rows long").coalesce(1).write.mode("append").json(f"{self.root}/bases")
        empty = self.spark.createDataFrame([], StructType([*self.schema.fields, StructField("_epoch", LongType())]))
        empty.coalesce(1).write.mode("ignore").parquet(f"{self.root}/deltas/epoch=-1/bucket=-1")

    def _newest(self) -> tuple[int, int]:
        at = self._pointers().orderBy(F.desc("epoch")).first()
        return (at.epoch, at.rows) if at else (-1, 0)

    def deltas(self, after: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/deltas").where((F.col("epoch") > after) & (F.col("bucket") >= 0)).select(*self.schema.names, "_epoch")

    def append(self, batch: DataFrame, epoch: int) -> None:
        if epoch == 0:
            self._start()
        new = self._latest(batch.select(*self.schema.names).withColumn("_epoch", F.lit(epoch).cast("long")))
        bucketed = new.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/deltas/epoch={epoch}")
        base, rows = self._newest()
        if base < epoch and self.deltas(base).count() > self.ratio * rows:
            self.compact(epoch)

    def compact(self, epoch: int) -> None:
        whole = self._merged(epoch)
        whole.write.mode("overwrite").parquet(f"{self.root}/base/v{epoch}")
        rows = self.spark.read.parquet(f"{self.root}/base/v{epoch}").count()
        self.spark.createDataFrame([(epoch, rows)], "epoch long, rows long").coalesce(1).write.mode("append").json(f"{self.root}/bases")

    def _merged(self, upto: int | None = None) -> DataFrame:
        at, _ = self._newest()
        rows = self.deltas(at) if upto is None else self.deltas(at).where(F.col("_epoch") <= upto)
        if at >= 0:
            rows = self.spark.read.parquet(f"{self.root}/base/v{at}").unionByName(rows)
        return self._latest(rows)

    def read(self) -> DataFrame:
        """The state as of the last batch."""
        return self._merged().select(*self.schema.names)

    def obsolete(self) -> list[str]:
        """Folders of bases before the newest; their deltas are below ``deltas/epoch=`` up to its number."""
        at, _ = self._newest()
        return [f"{self.root}/base/v{r.epoch}" for r in self._pointers().where(F.col("epoch") < at).distinct().collect()]  # one each doubling


def write_latest(stream: DataFrame, root: str, key: str, order: str, checkpoint: str, ratio: float = 1.0):
    """A stream folded into its latest row by key, as a ``StateLog``."""
    schema = stream.schema

    def fold(batch: DataFrame, epoch: int) -> None:
        StateLog(batch.sparkSession, root, schema, key, order, ratio).append(batch, epoch)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
