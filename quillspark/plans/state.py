"""Event logs, counters and writes over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import writes as W
from quillspark.plans.registry import query
from quillspark.plans.views import MESSAGE, SESSION, USAGE, message, session, usage
from quillspark.session import scratch, table
from quillspark.streaming import assembly, counters, eventlog, timers


@query("e01_append", "SELECT event_id AS id, user_id % 5 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events")
def append(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("aggregate_id"), F.col("event_id").alias("id"))
    heads = e.select("aggregate_id").distinct().withColumn("head", F.col("aggregate_id") % 5)
    return eventlog.numbered(e, heads, "id").select("id", F.col("seq").cast("long").alias("seq"))


def _log(spark, d):
    """Per user: sequence numbers with every 11th event sent twice and every 17th lost."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("aggregate_id"), F.col("event_id").alias("arrived"), F.col("event_type").alias("type"), F.col("props").alias("data"))
    n = (F.row_number().over(Window.partitionBy("aggregate_id").orderBy("arrived")) - 1).cast("long")
    e = e.withColumn("n", n).where("n % 17 <> 16")
    again = e.where("n % 11 = 0").withColumn("arrived", F.col("arrived") + 0.5)
    return e.withColumn("arrived", F.col("arrived") + 0.0).unionByName(again).select("aggregate_id", F.col("n").alias("seq"), F.col("arrived").cast("string").alias("id"), "type", "data", "arrived")


_SENT = "sent AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)"


@query(
    "e02_replay",
    f"""WITH {_SENT}, k AS (SELECT * FROM sent WHERE n % 17 <> 16) SELECT outcome, count(*) AS n FROM (
    SELECT CASE WHEN n < 16 THEN 'apply' WHEN n = 17 THEN 'gap' ELSE 'halted' END AS outcome FROM k UNION ALL SELECT CASE WHEN n < 16 THEN 'ignore' ELSE 'halted' END FROM k WHERE n % 11 = 0) GROUP BY 1""",
)
def replay(spark, d):
    log = _log(spark, d)
    heads = log.select("aggregate_id").distinct().withColumn("head", F.lit(-1).cast("long"))
    return eventlog.replay(log, heads).groupBy("outcome").agg(F.count("*").alias("n"))


@query("e03_versions", "SELECT event_type || '.2' AS type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def versions(spark, d):
    latest = eventlog.latest_versions({"click": 2, "view": 2})
    e = table(spark, d, "events").select(F.concat("event_type", F.lit(".2")).alias("type"))
    return e.where(F.col("type").isin(latest)).groupBy("type").agg(F.count("*").alias("n"))


_PUT = "p AS (SELECT o_custkey AS id, o_orderkey AS seq, o_orderpriority AS title, CASE WHEN o_orderstatus = 'P' THEN 'remove' ELSE 'put' END AS kind, o_orderkey AS time_created FROM orders WHERE o_custkey % 10 <> 0)"


def _projected(spark, d):
    o = table(spark, d, "orders")
    ev = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "P", "remove").otherwise("put").alias("kind"), F.col("o_orderpriority").alias("title"), F.col("o_orderkey").alias("time_created"), F.col("o_custkey").alias("project_id"))
    base = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("old").alias("title"), F.lit(-1).cast("long").alias("time_created"))
    parents = table(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("project_id"))
    return eventlog.project(base, ev, "id", ["title", "time_created"], parents, "project_id")


@query("e04_project", f"""WITH {_PUT}, g AS (SELECT id, max(seq) AS gone FROM p WHERE kind = 'remove' GROUP BY 1), b AS (SELECT c_custkey AS id, 'old' AS title, -1 AS time_created FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT id FROM g)),
    n AS (SELECT id, arg_max(title, seq) AS title, arg_min(time_created, seq) AS time_created FROM p LEFT JOIN g USING (id) WHERE kind = 'put' AND (gone IS NULL OR seq > gone) GROUP BY id)
    SELECT id, coalesce(n.title, b.title) AS title, coalesce(b.time_created, n.time_created) AS time_created FROM b FULL JOIN n USING (id)""")
def project(spark, d):
    return _projected(spark, d)[0]


@query("e05_dropped", "SELECT o_orderkey AS seq FROM orders WHERE o_custkey % 10 = 0")
def dropped(spark, d):
    return _projected(spark, d)[1].select("seq")


@query("e06_keep_created", "SELECT user_id AS id, CASE WHEN user_id % 2 = 0 THEN -5 ELSE min(event_id) END AS time_created, arg_max(event_type, event_id) AS data FROM events GROUP BY 1")
def keep_created(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("time_created"), F.col("event_type").alias("data"), F.col("event_id").alias("seq"))
    base = e.where("id % 2 = 0").select("id", F.lit(-5).cast("long").alias("time_created"), F.lit("old").alias("data")).distinct()
    return W.upsert(base, e, ["id"], "seq", keep=("time_created",))


@query("e07_deltas", "SELECT c_custkey AS id, c_mktsegment || coalesce(string_agg(o_orderstatus, '' ORDER BY o_orderkey), '') AS text FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment")
def deltas(spark, d):
    parts = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("text"))
    more = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("delta"))
    return eventlog.with_deltas(parts, more)


_DEBOUNCED = f"""WITH RECURSIVE {USAGE}, e AS (SELECT key_id, model, epoch_us(t) // 1000 AS ms, id FROM usage),
    o AS (SELECT key_id, min(ms) AS batch_start FROM e GROUP BY 1 UNION ALL
      SELECT o.key_id, min(e.ms) FROM o JOIN e ON e.key_id = o.key_id AND e.ms >= o.batch_start + 3600000 GROUP BY o.key_id, o.batch_start)
    SELECT e.key_id, e.model, max(e.ms) AS "at", arg_max(e.id, (e.ms, e.id)) AS id, o.batch_start FROM e ASOF JOIN o ON e.key_id = o.key_id AND e.ms >= o.batch_start GROUP BY 1, 2, 5"""


@query("e08_debounce", _DEBOUNCED)
def debounce(spark, d):
    e = usage(spark, d).select("key_id", "model", F.unix_millis("t").alias("at"), "id")
    return eventlog.debounced(e, "key_id", "model", "at", 3_600_000, "id")


@query("e09_compaction", "SELECT user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 1")
def compaction(spark, d):
    from quillspark.operators.sets import last_wins

    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    snapshot = last_wins(e.where("seq < 500"), e.limit(0), "key", "seq")
    return last_wins(snapshot, e.where("seq >= 500"), "key", "seq").select("key", "value")


@query("e10_assembly", f"WITH {MESSAGE} SELECT id AS message_id, text, turn % 2 = 1 AS complete FROM message")
def stream_assembly(spark, d):
    m = message(spark, d)
    ev = lambda seq, kind, delta: m.select(F.col("id").alias("message_id"), F.lit(0).alias("part_id"), F.lit(seq).alias("seq"), F.lit(kind).alias("type"), delta.alias("delta"))
    none = F.lit(None).cast("string")
    n = F.greatest(F.ceil(F.length("text") / 20), F.lit(1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substr("text", k * 20 + 1, F.lit(20)))
    deltas = m.select("id", F.posexplode(pieces).alias("at", "delta")).select(F.col("id").alias("message_id"), F.lit(0).alias("part_id"), (F.col("at") + 1).alias("seq"), F.lit("delta").alias("type"), "delta")
    log = ev(0, "start", none).unionByName(deltas)
    log = log.unionByName(m.where("turn % 2 = 1").select(F.col("id").alias("message_id"), F.lit(0).alias("part_id"), (n + 1).alias("seq"), F.lit("end").alias("type"), none.alias("delta")))
    return assembly.text_parts(log).select("message_id", "text", "complete")


@query("e10_tool_states", "SELECT c_custkey AS call_id, CASE c_custkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN c_custkey % 4 = 3 THEN 1 ELSE 0 END AS invalid FROM customer")
def tool_states(spark, d):
    k = F.col("c_custkey")
    flow = (
        F.when(k % 4 == 0, F.array(F.lit("pending"))).when(k % 4 == 1, F.array(F.lit("pending"), F.lit("running")))
        .when(k % 4 == 2, F.array(F.lit("pending"), F.lit("running"), F.lit("completed"))).otherwise(F.array(F.lit("pending"), F.lit("completed")))
    )
    ev = table(spark, d, "customer").select(k.alias("call_id"), F.posexplode(flow).alias("seq", "status"))
    return assembly.tool_states(ev).select("call_id", "status", F.col("invalid").cast("int").alias("invalid"))


def _use(spark, d):
    return usage(spark, d).select("id", "key_id", "t", "cost", F.floor(F.unix_micros("t") / 1_000_000).alias("s"), "input")


@query("e11_week_counter", f"WITH {USAGE} SELECT id, CAST(sum(cost) OVER (PARTITION BY key_id, date_trunc('week', t) ORDER BY t, id) AS BIGINT) AS used FROM usage")
def week_counter(spark, d):
    return counters.weekly(_use(spark, d), "key_id", "t", "cost", "id").select("id", "used")


_ANCHORED = f"""WITH RECURSIVE {USAGE}, e AS (SELECT id, key_id, epoch_us(t) // 1000000 AS s, cost FROM usage),
    o AS (SELECT key_id, min(s) AS anchor FROM e GROUP BY 1 UNION ALL
      SELECT o.key_id, min(e.s) FROM o JOIN e ON e.key_id = o.key_id AND e.s > o.anchor + 18000 GROUP BY o.key_id, o.anchor)
    SELECT e.id, o.anchor, CAST(sum(e.cost) OVER (PARTITION BY e.key_id, o.anchor ORDER BY e.s, e.id) AS BIGINT) AS used FROM e ASOF JOIN o ON e.key_id = o.key_id AND e.s >= o.anchor"""


@query("e12_anchored_window", _ANCHORED)
def anchored_window(spark, d):
    return counters.anchored(_use(spark, d).select("id", "key_id", "s", "cost"), "key_id", "s", "cost", 18_000, "id").select("id", "anchor", "used")


@query("e13_month_counter", f"WITH {USAGE} SELECT id, CAST(sum(cost) OVER (PARTITION BY key_id, date_trunc('month', t) ORDER BY t, id) AS BIGINT) AS used FROM usage")
def month_counter(spark, d):
    return counters.monthly(_use(spark, d), "key_id", "t", "cost", "id").select("id", "used")


@query("e14_subscription_month", f"WITH {USAGE} SELECT id, CAST(sum(cost) OVER (PARTITION BY key_id, t >= TIMESTAMP '2024-01-11 08:00:00' ORDER BY t, id) AS BIGINT) AS used FROM usage")
def subscription_month(spark, d):
    rows = _use(spark, d).withColumn("subscribed", F.lit("2023-12-11 08:00:00").cast("timestamp"))
    return counters.since_subscription(rows, "key_id", "t", "cost", "subscribed", "id").select("id", "used")


@query("e15_daily_limit", f"WITH {USAGE}, r AS (SELECT id, row_number() OVER (PARTITION BY key_id, CAST(t AS DATE) ORDER BY t, id) - 1 AS today, row_number() OVER (PARTITION BY key_id ORDER BY t, id) - 1 AS life FROM usage) SELECT id, CASE WHEN life < 14 THEN today >= 4 ELSE today >= 2 END AS refused FROM r")
def daily_limit(spark, d):
    return counters.daily_limit(_use(spark, d), "key_id", "t", 2, "id").select("id", "refused")


@query("e16_trial", f"WITH {USAGE} SELECT id, coalesce(sum(input) OVER (PARTITION BY key_id ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 500 AS in_trial FROM usage")
def trial(spark, d):
    return counters.trial(_use(spark, d), "key_id", "t", "input", 500, "id").select("id", "in_trial")


@query("e17_sse_chunks", "SELECT c_custkey AS id, c_custkey % 4 + 1 AS n, CAST(c_custkey AS VARCHAR) AS total FROM customer")
def sse_chunks(spark, d):
    k = F.col("c_custkey")
    body = F.concat(F.repeat(F.lit("data: a\n\n"), (k % 4).cast("int")), F.lit('data: {"usage": {"total": '), k, F.lit("}}\n\ndata: unfinished"))
    chunks = assembly.sse_chunks(body)
    return table(spark, d, "customer").select(k.alias("id"), F.size(chunks).cast("long").alias("n"), F.get_json_object(assembly.stream_usage(chunks), "$.total").alias("total"))


@query("e18_latency", f"WITH {USAGE} SELECT key_id, CAST((epoch_us(min(t)) - epoch_us(min(t - to_seconds(id % 7)))) // 1000 AS BIGINT) AS first_ms, CAST((epoch_us(max(t)) - epoch_us(min(t - to_seconds(id % 7)))) // 1000 AS BIGINT) AS last_ms FROM usage GROUP BY 1")
def latency(spark, d):
    return counters.latency(_use(spark, d).withColumn("start", F.timestamp_add("SECOND", -(F.col("id") % 7).cast("int"), "t")), "key_id", "start", "t").select("key_id", "first_ms", "last_ms")


@query("e19_ordered", "SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_name")
def ordered(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).orderBy("name")


@query(
    "e02_replay_stream",
    f"""WITH s AS (SELECT *, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)), k AS (SELECT *, least(17, min(CASE WHEN event_type = 'error' AND n < 17 THEN n ELSE 17 END) OVER (PARTITION BY user_id)) AS b FROM s WHERE n % 17 <> 16),
    o AS (SELECT user_id, n, event_type, CASE WHEN n < b THEN 'apply' WHEN n > b THEN 'halted' WHEN event_type = 'error' THEN 'unknown' ELSE 'gap' END AS outcome FROM k
    UNION ALL SELECT user_id, n, event_type, CASE WHEN n < b THEN 'ignore' ELSE 'halted' END FROM k WHERE n % 11 = 0)
    SELECT CAST(user_id AS VARCHAR) AS aggregate_id, outcome, count(*) AS n FROM o GROUP BY ALL""",
)
def replay_stream(spark, d):
    root = scratch(spark, "replay")
    log = _log(spark, d)
    log.write.parquet(f"{root}/in")
    out = eventlog.replay_stream(spark.readStream.schema(log.schema).parquet(f"{root}/in"), ["click", "view", "purchase", "signup"], "arrived")
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out").groupBy("aggregate_id", "outcome").agg(F.count("*").alias("n"))


def _streamed(spark, rows, time_ms, make):
    """What a stream over the rows, in several micro-batches, has given out once its watermark is past them all."""
    timers.prepare(spark)
    root = scratch(spark, "stream")
    rows.repartitionByRange(4, time_ms).write.parquet(f"{root}/in")
    day = 86_400_000
    rows.select(*[(F.max(time_ms) + 4000 * day if c == time_ms else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns]).coalesce(1).write.mode("append").parquet(f"{root}/in")
    out = make(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in"))
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query("e08_debounce_stream", _DEBOUNCED)
def debounce_stream(spark, d):
    e = usage(spark, d).select("key_id", "model", F.unix_millis("t").alias("at"), "id")
    return _streamed(spark, e, "at", lambda s: timers.debounced_stream(s, "key_id", "model", "at", 3_600_000, ("id",), "2000 days"))


@query("e12_anchored_stream", _ANCHORED)
def anchored_stream(spark, d):
    e = _use(spark, d).select("id", "key_id", (F.col("s") * 1000).alias("ms"), "cost")
    out = _streamed(spark, e, "ms", lambda s: timers.anchored_stream(s, "key_id", "ms", "cost", 18_000_000, ("id",), "2000 days"))
    return out.select("id", F.floor(F.col("anchor") / 1000).alias("anchor"), "used")


@query("e04_state_log", "SELECT user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS value FROM events GROUP BY 1")
def state_log(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    root = scratch(spark, "log")
    e.repartitionByRange(5, "seq").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    eventlog.write_latest(stream, f"{root}/state", "key", "seq", f"{root}/cp").awaitTermination()
    return eventlog.StateLog(spark, f"{root}/state", e.schema, "key", "seq").read()


@query("e20_subscribe", "SELECT event_id AS id FROM events WHERE event_type = 'error'")
def subscribe(spark, d):
    return eventlog.of_type(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type")), "error").select("id")


@query("e21_retention", f"WITH {USAGE} SELECT id FROM usage WHERE t >= TIMESTAMP '2024-01-23 00:00:00'")
def retention(spark, d):
    return eventlog.retained(usage(spark, d), "t", F.lit("2024-01-30 00:00:00").cast("timestamp")).select("id")


@query("e22_sticky", f"WITH {USAGE} SELECT key_id, arg_max(provider || model, t) AS provider FROM usage WHERE t <= TIMESTAMP '2024-01-28' GROUP BY 1 HAVING max(t) >= TIMESTAMP '2024-01-27'")
def sticky(spark, d):
    rows = usage(spark, d).where("t <= TIMESTAMP '2024-01-28'").select("key_id", F.concat("provider", "model").alias("provider"), "t")
    return counters.sticky(rows, "key_id", "provider", "t", F.lit("2024-01-28").cast("timestamp")).select("key_id", "provider")


@query("d01_upsert", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'X' ELSE c_mktsegment END AS segment FROM customer")
def upsert(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return W.upsert(c, c.where("id % 2 = 0").withColumn("segment", F.lit("X")), ["id"])


@query("d02_increment", "SELECT c_nationkey AS nation, 10 + count(*) AS n FROM customer GROUP BY 1")
def increment(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.lit(1).alias("n"))
    return W.add_up(c.select("nation").distinct().withColumn("n", F.lit(10)), c, ["nation"], "n")


@query("d03_insert_ignore", "SELECT c_custkey AS id, CASE WHEN c_custkey < 50 THEN 'old' ELSE 'new' END AS v FROM customer")
def insert_ignore(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return W.insert_ignore(c.where("id < 50").withColumn("v", F.lit("old")), c.withColumn("v", F.lit("new")), ["id"])


@query("d04_replace_children", "SELECT o_custkey AS parent, CAST(o_orderkey AS VARCHAR) AS content, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS position FROM orders WHERE o_custkey % 2 = 1 UNION ALL SELECT c_custkey, x, CAST(i AS INTEGER) FROM customer, (VALUES ('a', 0), ('b', 1)) t(x, i) WHERE c_custkey % 2 = 0")
def replace_children(spark, d):
    from pyspark.sql import Window

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").cast("string").alias("content"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("position"))
    lists = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("parent"), F.array(F.struct(F.lit("a").alias("content")), F.struct(F.lit("b").alias("content"))).alias("items"))
    return W.replace_children(o, "parent", lists, "items")


@query("d05_soft_delete", "SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 99 WHEN c_custkey % 5 = 0 THEN 1 END AS time_deleted FROM customer WHERE NOT (c_acctbal < 0 AND c_custkey % 5 = 0) UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_acctbal < 0 AND c_custkey % 5 = 0")
def soft_delete(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", F.when(F.col("c_custkey") % 5 == 0, 1).alias("time_deleted"))
    return W.soft_delete(c, F.col("c_acctbal") < 0, F.lit(99)).select("id", "time_deleted")


_LEDGER = "SELECT user_id AS ws, CASE event_type WHEN 'purchase' THEN 'credit' WHEN 'view' THEN 'debit' WHEN 'error' THEN 'refund' ELSE 'note' END AS kind, CAST(floor(value * 1000) AS BIGINT) AS amount, event_id % 2 = 0 AS reversible FROM events"


@query("d06_balance", f"SELECT ws, CAST(sum(CASE kind WHEN 'credit' THEN amount WHEN 'debit' THEN -amount WHEN 'refund' THEN CASE WHEN reversible THEN -amount ELSE 0 END ELSE 0 END) AS BIGINT) AS balance FROM ({_LEDGER}) GROUP BY 1")
def balance(spark, d):
    kind = F.when(F.col("model") == "purchase", "credit").when(F.col("model") == "view", "debit").when(F.col("model") == "error", "refund").otherwise("note")
    ledger = usage(spark, d).select(F.col("key_id").alias("ws"), kind.alias("kind"), F.col("cost").alias("amount"), (F.col("id") % 2 == 0).alias("reversible"))
    return W.balances(ledger, "ws", "amount", "kind", F.col("reversible"))


@query("d07_refunds", f"SELECT ws, CAST(sum(amount) AS BIGINT) AS refunded FROM ({_LEDGER}) WHERE kind = 'refund' AND reversible GROUP BY 1")
def refunds(spark, d):
    rows = usage(spark, d).where("model = 'error' AND id % 2 = 0")
    return rows.groupBy(F.col("key_id").alias("ws")).agg(F.sum("cost").alias("refunded"))


@query("d09_correlated_update", "SELECT c_custkey AS id, (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) AS nation FROM customer")
def correlated_update(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return table(spark, d, "customer").join(F.broadcast(n), "c_nationkey", "left").select(F.col("c_custkey").alias("id"), "nation")


@query("d10_migration", "SELECT 'session' AS kind, count(*) AS kept, 0 AS orphans FROM orders UNION ALL SELECT 'part', count(*) FILTER (l_orderkey % 4 > 0), count(*) FILTER (l_orderkey % 4 = 0) FROM lineitem")
def migration(spark, d):
    from quillspark.operators.joins import split_orphans

    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"))
    parts = table(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 4 > 0, F.col("l_orderkey")).otherwise(-1).alias("session_id"))
    kept, lost = split_orphans(parts, s, "session_id")
    n = lambda df, kind, as_: df.agg(F.lit(kind).alias("kind"), F.count("*").alias(as_))
    both = n(kept, "part", "kept").join(n(lost, "part", "orphans"), "kind")
    return both.unionByName(n(s, "session", "kept").withColumn("orphans", F.lit(0).cast("long")))


@query("d11_revert", f"WITH {MESSAGE} SELECT id FROM message WHERE id < session_id * 100 + 2")
def revert(spark, d):
    m = message(spark, d).select("id", "session_id")
    parts = m.select(F.col("id").alias("message_id"), (F.col("id") * 10).alias("id"))
    return W.reverted(m, parts, F.col("session_id") * 100 + 2)[1].select(F.col("message_id").alias("id"))


@query("d12_undelete", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 1 END AS time_deleted FROM customer")
def undelete(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, 1).alias("time_deleted"))
    return W.undelete(c, c.where("id % 3 = 0").select("id"), ["id"])


@query("x01_registered_function", f"WITH {SESSION} SELECT id, upper(title) AS shown FROM session")
def registered_function(spark, d):
    from quillspark.plans import plugins

    plugins.register(spark, plugins.Tool("shout_x01", "string", lambda s: s.str.upper(), ("string",)))
    return session(spark, d).selectExpr("id", "shout_x01(title) AS shown")


@query("x02_discovered", "SELECT r_regionkey AS id, upper(r_name) AS shown FROM region")
def discovered(spark, d):
    import tempfile
    from pathlib import Path

    from quillspark.plans import plugins

    root = tempfile.mkdtemp(prefix="quillspark-plugins-")  # read by the driver alone
    Path(root, "tools").mkdir()
    Path(root, "tools", "x02.py").write_text("from quillspark.plans.plugins import tool\n\nloud = tool('string', 'string')(lambda s: s.str.upper())\n")
    plugins.discover(spark, root)
    return table(spark, d, "region").selectExpr("r_regionkey AS id", "x02_loud(r_name) AS shown")


@query("x04_decorated", "SELECT n_nationkey AS id, n_name || '-' || n_regionkey AS shown FROM nation")
def decorated(spark, d):
    from quillspark.plans import plugins

    @plugins.tool("string", "string", "string")
    def joined_x04(a, b):
        return a + "-" + b

    plugins.register(spark, joined_x04)
    return table(spark, d, "nation").selectExpr("n_nationkey AS id", "joined_x04(n_name, string(n_regionkey)) AS shown")


@query("x03_reregistered", "SELECT r_regionkey AS id, r_name || '2' AS shown FROM region")
def reregistered(spark, d):
    from quillspark.plans import plugins

    plugins.register(spark, plugins.Tool("mark_x03", "string", lambda s: s + "1", ("string",)))
    plugins.register(spark, plugins.Tool("mark_x03", "string", lambda s: s + "2", ("string",)))
    return table(spark, d, "region").selectExpr("r_regionkey AS id", "mark_x03(r_name) AS shown")


@query("x05_hooked", "SELECT r_regionkey AS id FROM region WHERE r_regionkey < 3")
def hooked(spark, d):
    from quillspark.plans import plugins

    run = plugins.with_hooks(lambda s, p: table(s, p, "region").select(F.col("r_regionkey").alias("id")), after=[lambda df: df.where("id < 3")])
    return run(spark, d)
