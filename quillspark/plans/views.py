"""The conversation and usage model, laid over the synthetic tables, in Spark and in DuckDB.

``usage`` rows come from events, ``session`` rows from orders, ``message`` rows from
conversations and ``file`` rows from documents. Each view is a narrow projection, so
predicates and column pruning reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import table


def usage(spark, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select(
        i.alias("id"), (F.col("user_id") % 40).alias("ws"), F.col("user_id").alias("key_id"), F.col("event_type").alias("model"),
        F.concat(F.lit("p"), F.col("user_id") % 3).alias("provider"), F.floor(F.col("value") * 1000).cast("long").alias("cost"),
        F.get_json_object("props", "$.k").cast("long").alias("input"), (i % 500).alias("output"),
        F.when(i % 3 != 0, i % 50).alias("reasoning"), F.when(i % 4 != 0, i % 1000).alias("cache_read"),
        F.when(i % 4 == 1, "{}").when(i % 4 == 2, '{"plan":"sub"}').when(i % 4 == 3, '{"plan":"byok"}').alias("enrichment"),
        F.col("ts").cast("timestamp").alias("t"),
    )


USAGE = """usage AS (SELECT event_id AS id, user_id % 40 AS ws, user_id AS key_id, event_type AS model, 'p' || (user_id % 3) AS provider,
  CAST(floor(value * 1000) AS BIGINT) AS cost, CAST(props->>'$.k' AS BIGINT) AS input, event_id % 500 AS output,
  CASE WHEN event_id % 3 <> 0 THEN event_id % 50 END AS reasoning, CASE WHEN event_id % 4 <> 0 THEN event_id % 1000 END AS cache_read,
  CASE event_id % 4 WHEN 1 THEN '{}' WHEN 2 THEN '{"plan":"sub"}' WHEN 3 THEN '{"plan":"byok"}' END AS enrichment, ts AS t FROM events)"""


def session(spark, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    created = F.datediff("o_orderdate", F.lit("1970-01-01")).cast("long") * 86_400_000
    return table(spark, d, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("title"),
        F.when(k % 3 == 0, F.floor(k / 10)).alias("parent_id"), created.alias("time_created"),
        (created + (k % 97) * 86_400_000).alias("time_updated"), F.when(F.col("o_orderstatus") == "F", created).alias("time_archived"),
        F.col("o_totalprice").alias("price"),
    )


SESSION = """session AS (SELECT o_orderkey AS id, o_custkey AS project_id, o_orderpriority AS title,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 10 END AS parent_id, epoch_ms(o_orderdate) AS time_created,
  epoch_ms(o_orderdate) + (o_orderkey % 97) * 86400000 AS time_updated, CASE WHEN o_orderstatus = 'F' THEN epoch_ms(o_orderdate) END AS time_archived,
  o_totalprice AS price FROM orders)"""


def message(spark, d: str) -> DataFrame:
    at = F.col("conv_id") * 100 + F.col("turn")
    own = F.col("role") == "assistant"
    return table(spark, d, "conversations").select(
        at.alias("id"), F.col("conv_id").alias("session_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"),
        (F.lit(1_700_000_000_000) + F.col("conv_id") * 3_600_000 + F.col("turn") * 60_000).alias("time_created"),
        F.when(own, at % 977).alias("cost"), F.when(own, at % 3001).alias("input"), F.when(own, at % 701).alias("output"),
        F.when(own & (at % 2 == 0), at % 97).alias("reasoning"), F.when(own, at % 5003).alias("cache_read"), F.when(own, F.lit(0).cast("long")).alias("cache_write"),
        F.when(own, F.concat(F.lit("p"), F.col("conv_id") % 3)).alias("provider"), F.when(own, F.concat(F.lit("m"), F.col("conv_id") % 5)).alias("model"),
    )


MESSAGE = """message AS (SELECT conv_id * 100 + turn AS id, conv_id AS session_id, turn, role, coalesce(text, '') AS text,
  1700000000000 + conv_id * 3600000 + turn * 60000 AS time_created,
  CASE WHEN role = 'assistant' THEN (conv_id * 100 + turn) % 977 END AS cost, CASE WHEN role = 'assistant' THEN (conv_id * 100 + turn) % 3001 END AS input,
  CASE WHEN role = 'assistant' THEN (conv_id * 100 + turn) % 701 END AS output,
  CASE WHEN role = 'assistant' AND (conv_id * 100 + turn) % 2 = 0 THEN (conv_id * 100 + turn) % 97 END AS reasoning,
  CASE WHEN role = 'assistant' THEN (conv_id * 100 + turn) % 5003 END AS cache_read, CASE WHEN role = 'assistant' THEN 0 END AS cache_write,
  CASE WHEN role = 'assistant' THEN 'p' || (conv_id % 3) END AS provider, CASE WHEN role = 'assistant' THEN 'm' || (conv_id % 5) END AS model FROM conversations)"""


def file(spark, d: str) -> DataFrame:
    i = F.col("doc_id")
    day = F.date_add(F.lit("2025-01-01").cast("date"), (i % 300).cast("int")).cast("string")
    return table(spark, d, "documents").select(
        i.alias("id"), F.concat(F.lit("notes/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.when(i % 4 == 0, F.lit(".hidden/")).otherwise(""), F.when(i % 5 == 0, F.lit("plain")).otherwise(day), F.lit("-"), i, F.lit(".md")).alias("path"),
        (F.lit(1_700_000_000_000) + (i * 7919) % 86_400_000).alias("mtime"), F.coalesce("text", F.lit("")).alias("text"),
    )


FILE = """file AS (SELECT doc_id AS id, 'notes/' || coalesce(source, 'none') || '/' || CASE WHEN doc_id % 4 = 0 THEN '.hidden/' ELSE '' END ||
  CASE WHEN doc_id % 5 = 0 THEN 'plain' ELSE strftime(DATE '2025-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') END || '-' || doc_id || '.md' AS path,
  1700000000000 + (doc_id * 7919) % 86400000 AS mtime, coalesce(text, '') AS text FROM documents)"""
