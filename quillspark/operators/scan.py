"""Running values over ordered rows of a key, however many rows one key has.

A window by key brings all rows of a key into one task. Here the rows of a key with more than
``LIMIT`` rows are first dealt into cells, ranges of the order; a window by key and cell gives
each row what its cell has so far, and each cell is reduced to a carried value. The carries of
a key, a row a cell, are combined in order by a second, small window and brought back to the
cell's rows; both sides of that join are already dealt by key and cell. Every running value is
an associative operation with a neutral null: sum, count, least, greatest, last known value.

Keys below the limit have one cell and no carry, so without large keys the plan is one window.
With large keys each call writes its rows once, so chains of running values stay linear.
Which keys are large is counted first. Their cells are cut at quantiles of a sample taken by
a hash of the rows (about ``PER_CELL`` rows a cell), which is written down, so a task that is
run again deals its rows as before. Rows that tie in the whole order can't be told apart and
stay in one cell: orders should be total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import scratch

#: Rows of a key that one task takes; sampled rows for each cell of a larger key.
LIMIT, PER_CELL = 1_000_000, 64


def _at_most(splits: Column, o: Column) -> Column:
    """How many of the sorted splits are <= o, by binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: at + F.when((at + s <= F.size(splits)) & (F.try_element_at(splits, at + s) <= o), s).otherwise(F.lit(0)))


class Scan:
    """The rows of ``df`` as ``rows``, with their cell; ``order`` is ascending, or all descending (nulls last) with ``reverse``."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str | Column], reverse: bool = False):
        self.keys, self.reverse = list(keys), reverse
        self.order = [F.col(c) if isinstance(c, str) else c for c in order]
        many = df.groupBy(*keys).agg(F.count("*").alias("_many")).where(F.col("_many") > LIMIT)
        self.split = not many.isEmpty()
        self.rows = self._dealt(df, many) if self.split else df.withColumn("_cell", F.lit(0))

    def _same(self, a: DataFrame, b: DataFrame, *more: str) -> Column:
        on = F.lit(True)
        for c in (*self.keys, *more):
            on = on & a[c].eqNullSafe(b[f"_{c}_"])
        return on

    def _named(self, df: DataFrame, *more: str) -> DataFrame:
        for c in (*self.keys, *more):
            df = df.withColumnRenamed(c, f"_{c}_")
        return df

    def _dealt(self, df: DataFrame, many: DataFrame) -> DataFrame:
        o = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.order)])
        spark, path = df.sparkSession, scratch(df.sparkSession, "splits")
        some = df.withColumn("_o", o).where(F.pmod(F.xxhash64(*self.keys, "_o"), F.lit(LIMIT)) < PER_CELL)
        large = self._named(many)
        sample = some.join(large, self._same(some, large)).groupBy(*self.keys).agg(F.sort_array(F.collect_list("_o")).alias("_s"), F.first("_many").alias("_many"))
        cells = F.ceil(2 * F.col("_many") / LIMIT).cast("int")
        cut = F.transform(F.sequence(F.lit(1), cells - 1), lambda i: F.try_element_at("_s", (i * F.size("_s") / cells).cast("int") + 1))
        sample.select(*self.keys, F.filter(cut, lambda x: x.isNotNull()).alias("_splits")).write.parquet(path)
        splits = self._named(spark.read.parquet(path))
        out = df.join(splits, self._same(df, splits), "left").withColumn("_cell", F.coalesce(_at_most(F.col("_splits"), o), F.lit(0)))
        return out.select(*df.columns, "_cell")

    def running(self, df: DataFrame, values: dict[str, tuple[str, Column]], exclusive: bool = False, reverse: bool | None = None) -> DataFrame:
        """``df``, made from ``rows``, with a column for each value: (sum, count, min, max or last, of what).

        ``last`` is the last known (not null) value; ``exclusive`` leaves the row itself out. Sums of nothing
        are null, counts 0."""
        keys, reverse = self.keys, self.reverse if reverse is None else reverse
        if self.split:  # read twice below, and again by every running value made from this one
            path = scratch(df.sparkSession, "scan")
            df.write.parquet(path)
            df = df.sparkSession.read.parquet(path)
        ordered = [c.desc_nulls_last() for c in self.order] if reverse else self.order
        own = Window.partitionBy(*keys, "_cell").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
        kinds = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
        out = df.withColumns({name: kinds[kind](what).over(own) for name, (kind, what) in values.items()})
        if not self.split:
            return out
        o = F.struct(*self.order)
        last = F.min_by if reverse else F.max_by
        whole = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "last": lambda c: last(c, F.when(c.isNotNull(), o))}
        carried = df.groupBy(*keys, "_cell").agg(*[whole[kind](what).alias(f"_{name}") for name, (kind, what) in values.items()])
        before = Window.partitionBy(*keys).orderBy(F.desc("_cell") if reverse else "_cell").rowsBetween(Window.unboundedPreceding, -1)
        over = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "last": kinds["last"]}
        carried = carried.withColumns({f"_{name}": over[kind](F.col(f"_{name}")).over(before) for name, (kind, _) in values.items()})
        carried = self._named(carried, "_cell")
        joined = out.join(carried, self._same(out, carried, "_cell"), "left")

        def both(name: str, kind: str) -> Column:
            a, b = F.col(f"_{name}"), F.col(name)
            if kind in ("sum", "count"):
                return F.when(a.isNotNull() & b.isNotNull(), a + b).otherwise(F.coalesce(b, a))
            return {"min": F.least(a, b), "max": F.greatest(a, b), "last": F.coalesce(b, a)}[kind]

        return joined.withColumns({name: both(name, kind) for name, (kind, _) in values.items()}).select(*out.columns)
