"""Joins whose children crowd at one key."""

from pyspark.sql import functions as F

from quillspark.operators import joins as J


def test_rows_of_one_missing_parent_are_not_sorted(spark):
    children = spark.range(20_000).select(F.when(F.col("id") % 4 > 0, F.col("id")).otherwise(-1).alias("k"))
    parents = spark.range(15_000).withColumnRenamed("id", "k").unionByName(spark.range(5).withColumnRenamed("id", "k"))
    kept, lost = J.split_orphans(children, parents, "k")
    for side in (kept, lost):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort " not in plan
    assert (kept.count(), lost.count()) == (11_250, 8_750)
    nulls = spark.sql("SELECT CAST(NULL AS LONG) AS k")
    assert [x.count() for x in J.split_orphans(nulls, parents, "k")] == [0, 1]
