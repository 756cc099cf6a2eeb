"""Usage statistics over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.plans.registry import query
from quillspark.session import table


@query(
    "a02_model_usage",
    """SELECT event_type AS model, count(*) AS messages, round(sum(value), 4) AS cost
       FROM events GROUP BY event_type""",
)
def model_usage(spark, sf_dir):
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("model"))
        .agg(F.count("*").alias("messages"), F.round(F.sum("value"), 4).alias("cost"))
    )
