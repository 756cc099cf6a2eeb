"""Set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.windows import latest_per_key


def distinct_union(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Union of two lists, distinct and sorted."""
    return a.select(col).union(b.select(col)).distinct().orderBy(col)


def concatenated(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def last_wins(base: DataFrame, log: DataFrame, key: str, order: str) -> DataFrame:
    """Keyed union in which the last entry of a key wins, sorted by key."""
    return latest_per_key(base.unionByName(log), [key], F.col(order)).orderBy(key)


def vanished(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the old list that the new one lacks."""
    return old.join(new.select(key), key, "left_anti")


def overlap(a: Column, b: Column) -> Column:
    """(common, all) of two arrays taken as sets."""
    return F.struct(F.size(F.array_intersect(a, b)).alias("common"), F.size(F.array_union(a, b)).alias("all"))
