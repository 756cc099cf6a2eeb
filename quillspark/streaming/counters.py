"""Counters over usage events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.calendar import monthly_bounds
from quillspark.operators.scan import Scan


def in_window(df: DataFrame, key: str, time: str, cost: str, start: Column, *ties: str) -> DataFrame:
    """Running cost within a calendar window; a new window starts from its first cost."""
    rows = df.withColumn("window_start", start)
    scan = Scan(rows, [key, "window_start"], [time, *ties])
    return scan.running(scan.rows, {"used": ("sum", F.col(cost))}).drop("_cell")


def weekly(df: DataFrame, key: str, time: str, cost: str, *ties: str) -> DataFrame:
    return in_window(df, key, time, cost, F.date_trunc("week", time), *ties)


def monthly(df: DataFrame, key: str, time: str, cost: str, *ties: str) -> DataFrame:
    return in_window(df, key, time, cost, F.date_trunc("month", time), *ties)


def since_subscription(df: DataFrame, key: str, time: str, cost: str, subscribed: str, *ties: str) -> DataFrame:
    return in_window(df, key, time, cost, monthly_bounds(F.col(time), F.col(subscribed))[0], *ties)


def anchored(df: DataFrame, key: str, time_s: str, cost: str, window_s: int, *ties: str) -> DataFrame:
    """Running cost since an anchor (E12): the anchor is the first use, and moves to the first use
    after the window has passed. Which events are anchors depends on the anchors before, so rows
    stream past in order of key and time; three values are carried from row to row, and no key's
    rows are ever held together."""
    from pyspark.sql.types import LongType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor, total, begun = None, 0, 0, False
        for b in batches:
            anchors, used = [], []
            for k, t, c in zip(*(b.column(x).to_pylist() for x in (key, time_s, cost)), strict=True):
                if not begun or k != last or anchor < t - window_s:
                    last, anchor, total, begun = k, t, 0, True
                total += c
                anchors.append(anchor)
                used.append(total)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(anchors, pa.int64()), pa.array(used, pa.int64())], [*b.schema.names, "anchor", "used"])

    schema = StructType([*df.schema.fields, StructField("anchor", LongType()), StructField("used", LongType())])
    return df.repartition(key).sortWithinPartitions(key, time_s, *ties).mapInArrow(run, schema)


def daily_limit(df: DataFrame, ip: str, time: str, limit: int, *ties: str) -> DataFrame:
    """Requests so far today, and whether one is refused (E15): a caller with fewer than 7 * limit
    tracked requests in all may make twice the daily limit. Requests that stay within the plain
    limit are always tracked, so the lifetime count is what came before, up to the limits."""
    rows = df.withColumn("day", F.to_date(time))
    scan = Scan(rows, [ip, "day"], [time, *ties])
    rows = scan.running(scan.rows, {"today": ("count", F.lit(1))}).withColumn("today", F.col("today") - 1).drop("_cell")
    scan = Scan(rows, [ip], [time, *ties])
    rows = scan.running(scan.rows, {"lifetime": ("count", F.lit(1))}, exclusive=True).withColumn("lifetime", F.coalesce("lifetime", F.lit(0))).drop("_cell")
    rows = rows.withColumn("is_new", F.col("lifetime") < 7 * limit)
    return rows.withColumn("refused", F.when(F.col("is_new"), F.col("today") >= 2 * limit).otherwise(F.col("today") >= limit))


def trial(df: DataFrame, key: str, time: str, tokens: str, limit: int, *ties: str) -> DataFrame:
    """Whether a request is still within the lifetime trial: tokens before it are under the limit."""
    scan = Scan(df, [key], [time, *ties])
    rows = scan.running(scan.rows, {"spent": ("sum", F.col(tokens))}, exclusive=True).withColumn("spent", F.coalesce("spent", F.lit(0))).drop("_cell")
    return rows.withColumn("in_trial", F.col("spent") < limit)


def sticky(df: DataFrame, key: str, value: str, time: str, now: Column, hours: int = 24) -> DataFrame:
    """The last value of a key, if it was written within the time to live."""
    last = df.groupBy(key).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))
    return last.where(F.col(time) >= now - F.expr(f"INTERVAL {hours} HOURS"))


def latency(df: DataFrame, key: str, start: str, time: str) -> DataFrame:
    """Milliseconds to the first and to the last chunk."""
    since = lambda t: F.floor((F.unix_micros(t) - F.unix_micros(F.min(start))) / 1000).cast("long")
    return df.groupBy(key).agg(since(F.min(time)).alias("first_ms"), since(F.max(time)).alias("last_ms"))
