"""Aggregations and windows over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.calendar import iso_yearweek
from quillspark.functions.text import token_estimate
from quillspark.operators import aggregates as A
from quillspark.operators import windows as W
from quillspark.plans.registry import query
from quillspark.plans.views import MESSAGE, SESSION, USAGE, message, session, usage
from quillspark.session import table

_KINDS = "coalesce(sum(input), 0) AS input, coalesce(sum(output), 0) AS output, coalesce(sum(reasoning), 0) AS reasoning, coalesce(sum(cache_read), 0) AS cache_read, coalesce(sum(cache_write), 0) AS cache_write"


@query("a01_totals", f"WITH {MESSAGE} SELECT count(*) AS messages, coalesce(sum(cost), 0) AS cost, {_KINDS} FROM message")
def totals(spark, d):
    return A.totals(message(spark, d))


@query("a02_message_models", f"WITH {MESSAGE} SELECT provider || '/' || model AS model, count(*) AS messages, sum(cost) AS cost, sum(input) AS input, sum(coalesce(output, 0) + coalesce(reasoning, 0)) AS output, sum(cache_read) AS cache_read, sum(cache_write) AS cache_write FROM message WHERE role = 'assistant' GROUP BY 1")
def message_models(spark, d):
    return A.model_usage(message(spark, d))


@query("a03_tool_counts", "SELECT tool, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tool FROM part) GROUP BY tool")
def tool_counts(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("tool")).groupBy("tool").agg(F.count("*").alias("n"))


@query("a04_two_levels", f"WITH {USAGE}, s AS (SELECT key_id, sum(cost) AS cost, count(*) AS n FROM usage GROUP BY key_id) SELECT count(*) AS sessions, sum(n) AS messages, sum(cost) AS cost, max(cost) AS most FROM s")
def two_levels(spark, d):
    s = usage(spark, d).groupBy("key_id").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"))
    return s.agg(F.count("*").alias("sessions"), F.sum("n").alias("messages"), F.sum("cost").alias("cost"), F.max("cost").alias("most"))


@query("a05_median", f"WITH {USAGE}, s AS (SELECT ws, key_id, sum(input + output) AS tokens FROM usage GROUP BY ws, key_id) SELECT ws, coalesce(quantile_cont(tokens, 0.5), 0) AS median FROM s GROUP BY ws")
def median(spark, d):
    s = usage(spark, d).groupBy("ws", "key_id").agg(F.sum(F.col("input") + F.col("output")).alias("tokens"))
    return A.medians(s, ["ws"], "tokens")


@query("a06_per_day", f"WITH {SESSION}, s AS (SELECT project_id, greatest(1, ceil((max(time_updated) - min(time_created)) / 86400000.0)) AS days, count(*) AS n, sum(price) AS cost FROM session GROUP BY 1) SELECT project_id, CAST(days AS BIGINT) AS days, round(cost / days, 4) AS cost_per_day, n FROM s")
def per_day(spark, d):
    s = session(spark, d).groupBy("project_id").agg(A.per_day(F.min("time_created"), F.max("time_updated"), None).alias("days"), F.count("*").alias("n"), F.sum("price").alias("cost"))
    return s.select("project_id", "days", F.round(F.col("cost") / F.col("days"), 4).alias("cost_per_day"), "n")


@query("a07_range", f"WITH {SESSION} SELECT min(time_updated) AS earliest, max(time_updated) AS latest FROM session WHERE time_updated >= 900000000000")
def date_range(spark, d):
    cutoff = 900_000_000_000
    rows = session(spark, d).where(F.col("time_updated") >= cutoff) if cutoff else session(spark, d)
    return rows.agg(F.min("time_updated" if cutoff else "time_created").alias("earliest"), F.max("time_updated").alias("latest"))


_PLAN = "coalesce(enrichment->>'$.plan', 'none')"


@query("a08_by_day", f"WITH {USAGE} SELECT strftime(t, '%Y-%m-%d') AS day, model, key_id, {_PLAN} AS plan, sum(cost) AS cost FROM usage GROUP BY ALL")
def by_day(spark, d):
    plan = F.coalesce(F.get_json_object("enrichment", "$.plan"), F.lit("none"))
    return usage(spark, d).groupBy(F.date_format("t", "yyyy-MM-dd").alias("day"), "model", "key_id", plan.alias("plan")).agg(F.sum("cost").alias("cost"))


@query("a09_dense_spine", f"WITH {USAGE}, g AS (SELECT ws, CAST(t AS DATE) AS day, model, sum(cost) AS cost FROM usage GROUP BY ALL), s AS (SELECT CAST(range AS DATE) AS day, ws, model FROM range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY), (SELECT DISTINCT ws, model FROM usage)) SELECT ws, CAST(day AS VARCHAR) AS day, model, coalesce(cost, 0) AS cost FROM s LEFT JOIN g USING (ws, day, model)")
def dense_spine(spark, d):
    u = usage(spark, d)
    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-01-31')) AS day")
    spine = u.select("ws", "model").distinct().join(F.broadcast(days))  # a month of days for each model
    sums = u.groupBy("ws", F.to_date("t").alias("day"), "model").agg(F.sum("cost").alias("cost"))
    return A.dense(sums, spine, ["ws", "day", "model"], "cost").withColumn("day", F.col("day").cast("string"))


@query("a10_iso_week", f"WITH {USAGE} SELECT ws, CAST(isoyear(t) * 100 + week(t) AS BIGINT) AS week, coalesce(sum(cost), 0) AS amount FROM usage GROUP BY ALL")
def iso_week(spark, d):
    return usage(spark, d).groupBy("ws", iso_yearweek(F.col("t")).alias("week")).agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("amount"))


@query("a11_conditional_sums", f"WITH {USAGE} SELECT ws, coalesce(sum(cost) FILTER ((enrichment->>'$.plan') = 'sub'), 0) AS sub, coalesce(sum(cost) FILTER (enrichment IS NULL OR (enrichment->>'$.plan') <> 'sub'), 0) AS ppu FROM usage GROUP BY ws")
def conditional_sums(spark, d):
    plan = F.get_json_object("enrichment", "$.plan")
    return usage(spark, d).groupBy("ws").agg(F.coalesce(F.sum(F.when(plan == "sub", F.col("cost"))), F.lit(0)).alias("sub"), F.coalesce(F.sum(F.when(F.col("enrichment").isNull() | (plan != "sub"), F.col("cost"))), F.lit(0)).alias("ppu"))


@query("a12_null_safe_add", f"WITH {USAGE} SELECT ws, coalesce(sum(input), 0) AS input, coalesce(sum(cache_read), 0) AS cache, coalesce(sum(output), 0) + coalesce(sum(reasoning), 0) AS output FROM usage GROUP BY ws")
def null_safe_add(spark, d):
    z = A.null_zero
    return usage(spark, d).groupBy("ws").agg(z("input").alias("input"), z("cache_read").alias("cache"), (z("output") + z("reasoning")).alias("output"))


@query(
    "a13_top_models",
    f"""WITH {USAGE}, g AS (SELECT ws, model, sum(cost) AS amount FROM usage GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY amount DESC, model) AS n, sum(amount) OVER (PARTITION BY ws) AS total FROM g)
    SELECT ws, {', '.join(f"coalesce(max(model) FILTER (n = {k}), '-') AS model{k}, coalesce(max(CASE WHEN total > 0 THEN format('{{:.1f}}', amount * 100.0 / total) || '%' ELSE '0.0%' END) FILTER (n = {k}), '-') AS percent{k}" for k in (1, 2, 3))} FROM r GROUP BY ws""",
)
def top_models(spark, d):
    g = usage(spark, d).groupBy("ws", "model").agg(F.sum("cost").alias("amount"))
    return A.top_models(g, "ws", "model", "amount")


@query("a14_week_pivot", f"WITH {USAGE}, g AS (SELECT ws, CAST(isoyear(t) * 100 + week(t) AS BIGINT) AS w, sum(cost) AS c FROM usage GROUP BY ALL) SELECT ws, {', '.join(f'coalesce(max(c) FILTER (w = {w}), 0) AS w{w}' for w in range(202401, 202406))} FROM g GROUP BY ws")
def week_pivot(spark, d):
    weeks = list(range(202401, 202406))
    out = usage(spark, d).withColumn("week", iso_yearweek(F.col("t"))).groupBy("ws").pivot("week", weeks).agg(F.sum("cost"))
    return out.select("ws", *[F.coalesce(F.col(f"`{w}`"), F.lit(0)).alias(f"w{w}") for w in weeks])


@query("a15_group_count", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1")
def group_count(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("a16_rollup_total", f"WITH {USAGE}, g AS (SELECT strftime(t, '%Y-%m-%d') AS day, count(*) AS requests, sum(input) AS input, sum(cost) AS cost FROM usage WHERE t >= TIMESTAMP '2024-01-03' GROUP BY 1) SELECT * FROM g UNION ALL SELECT 'TOTAL', NULL, NULL, sum(cost) FROM g")
def rollup_total(spark, d):
    g = usage(spark, d).where("t >= TIMESTAMP '2024-01-03'").groupBy(F.date_format("t", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("requests"), F.sum("input").alias("input"), F.sum("cost").alias("cost"))
    return A.with_total(g, "day", "TOTAL", ["cost"])


@query("a17_mean", "SELECT c_nationkey AS nation, coalesce(round(avg(c_acctbal), 6), 0) AS mean FROM customer GROUP BY 1")
def mean(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.coalesce(F.round(F.avg("c_acctbal"), 6), F.lit(0.0)).alias("mean"))


@query("a18_count", "SELECT count(*) AS n FROM embeddings")
def count(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"))


@query("a19_distinct", f"WITH {USAGE} SELECT ws, count(DISTINCT key_id) AS keys, count(DISTINCT model) AS models FROM usage GROUP BY ws")
def distinct(spark, d):
    return usage(spark, d).groupBy("ws").agg(F.countDistinct("key_id").alias("keys"), F.countDistinct("model").alias("models"))


@query("a20_diff_totals", "SELECT l_orderkey AS id, sum(CAST(l_quantity AS BIGINT)) AS additions, sum(l_linenumber) AS deletions, count(*) AS files FROM lineitem GROUP BY 1")
def diff_totals(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(F.col("l_quantity").cast("long")).alias("additions"), F.sum("l_linenumber").alias("deletions"), F.count("*").alias("files"))


@query(
    "a21_context_share",
    f"""WITH {MESSAGE}, e AS (SELECT session_id, role, CAST(ceil(sum(length(text)) / 4.0) AS BIGINT) AS tokens FROM message GROUP BY ALL), w AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id) AS whole FROM e),
    s AS (SELECT session_id, role, CASE WHEN whole > 300 THEN CAST(floor(tokens * 300.0 / whole) AS BIGINT) ELSE tokens END AS tokens FROM w),
    b AS (SELECT * FROM s UNION ALL SELECT session_id, 'other', 300 - sum(tokens) FROM s GROUP BY session_id)
    SELECT session_id, role, CAST(tokens AS BIGINT) AS tokens, round(tokens / 300.0 * 100, 1) AS percent FROM b WHERE tokens > 0""",
)
def context_share(spark, d):
    m = message(spark, d).select("session_id", "role", F.length("text").alias("size"), F.lit(300).alias("limit"))
    return A.context_share(m, "session_id", "role", "size", "limit")


@query("a22_last_assistant", f"WITH {MESSAGE} SELECT session_id, arg_max(id, id) AS id, arg_max(input, id) AS input FROM message WHERE role = 'assistant' AND input + output > 0 GROUP BY 1")
def last_assistant(spark, d):
    return A.last_where(message(spark, d), "session_id", (F.col("role") == "assistant") & (F.col("input") + F.col("output") > 0), F.col("id"), "id", "input")


@query("a23_first_last", "SELECT user_id AS id, arg_min(event_type, ts) FILTER (event_type <> 'view') AS first, arg_max(props, ts) AS last FROM events GROUP BY 1")
def first_last(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("first"), F.col("props").alias("last"), "ts")
    return A.first_and_last(e, "id", "first", "last", F.col("ts"))


@query("a24_score_matrix", "SELECT CAST(l_suppkey AS VARCHAR) AS model, 1.0 AS average, max(l_quantity) FILTER (l_linenumber = 1) AS t1, max(l_quantity) FILTER (l_linenumber = 2) AS t2 FROM lineitem GROUP BY 1")
def score_matrix(spark, d):
    tasks = F.collect_list(F.struct(F.concat(F.lit("t"), "l_linenumber").alias("task"), F.col("l_quantity").alias("score")))
    results = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("model")).agg(F.to_json(F.struct(F.lit(1.0).alias("averageScore"), tasks.alias("tasks"))).alias("result"))
    return A.score_matrix(results, ["t1", "t2"])


@query("a25_sections", "SELECT *, row_number() OVER (PARTITION BY section ORDER BY item) AS position FROM (SELECT CASE WHEN p_name LIKE '%red%' THEN 'red' WHEN p_name LIKE '%ring%' THEN 'ring' ELSE 'other' END AS section, p_partkey AS item FROM part)")
def sections(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.split("p_name", " ").alias("areas"))
    return A.by_section(p, "item", "areas", ["red", "ring"])


@query("a26_reverts", "SELECT c_nationkey AS nation, count(*) FILTER (c_custkey % 4 > 1) AS n FROM customer WHERE c_custkey < (SELECT max(c_custkey) + 1 - (max(c_custkey) + 1) % 4 FROM customer) GROUP BY 1 HAVING count(*) FILTER (c_custkey % 4 > 1) > 0")
def reverts(spark, d):
    c = table(spark, d, "customer")
    top = c.agg(F.max("c_custkey").alias("top"))
    c = c.join(F.broadcast(top)).where((F.col("c_custkey") < F.col("top") + 1 - (F.col("top") + 1) % 4))
    k = F.col("c_custkey")
    own = c.where(k % 4 > 1).select("c_nationkey", k.alias("pos"), F.concat(F.lit("fix "), k).alias("title"))
    pair = c.where(k % 4 == 0).select("c_nationkey", k.alias("pos"), F.concat(F.lit("add "), k).alias("title"))
    undo = c.where(k % 4 == 0).select("c_nationkey", (k + 1).alias("pos"), F.concat(F.lit('Revert "add '), k, F.lit('"')).alias("title"))
    kept = A.without_reverts(own.unionByName(pair).unionByName(undo), "c_nationkey", "pos", "title")
    return kept.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))


@query("a27_contributor_sets", "SELECT o_custkey AS id, len(list(DISTINCT o_orderpriority)) AS n, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS kinds FROM orders GROUP BY 1")
def contributor_sets(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("s"))
    return s.select("id", F.size("s").cast("long").alias("n"), F.array_join("s", ",").alias("kinds"))


@query("a28_nested_sum", "SELECT o_orderkey AS id, coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS downloads FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nested_sum(spark, d):
    from quillspark.operators.joins import nest

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_quantity").cast("long").alias("count"))
    return nest(o, li, "id", ["l_linenumber"], "assets").select("id", A.nested_sum("assets", "count").alias("downloads"))


@query("a29_dedup", "SELECT user_id AS id, event_type AS kind, min(event_id) AS first_at, arg_max(props, event_id) AS props FROM events GROUP BY 1, 2")
def dedup(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("kind"), "event_id", "props")
    return A.deduplicated(e, ["id", "kind"], F.col("event_id")).select("id", "kind", "first_at", "props")


@query("a30_grouped_lists", "SELECT n_regionkey AS region, n_name AS item, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS position FROM nation WHERE n_nationkey > 3")
def grouped_lists(spark, d):
    out = A.grouped_lists(table(spark, d, "nation"), F.col("n_nationkey") > 3, "n_regionkey", "n_name")
    return out.select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("item"), "position")


@query("a31_role_counts", "SELECT conv_id AS id, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'assistant') AS assistants FROM conversations GROUP BY 1")
def role_counts(spark, d):
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"))


@query("a32_context_used", f"WITH {MESSAGE} SELECT session_id, arg_max(input + cache_read, id) AS used, sum(cost) AS cost FROM message WHERE role = 'assistant' GROUP BY 1")
def context_used(spark, d):
    own = message(spark, d).where("role = 'assistant'")
    return own.groupBy("session_id").agg(F.max_by(F.col("input") + F.col("cache_read"), "id").alias("used"), F.sum("cost").alias("cost"))


@query(
    "w01_prune",
    """WITH p AS (SELECT user_id AS session_id, event_id // 3 AS msg, event_id AS pos, event_type, CAST(props->>'$.k' AS BIGINT) * 40 AS tokens, event_id % 97 = 0 AS is_compacted FROM events),
    h AS (SELECT *, CASE WHEN event_type = 'click' AND row_number() OVER (PARTITION BY session_id, msg ORDER BY pos DESC) = 1 THEN 1 ELSE 0 END AS u FROM p),
    t AS (SELECT *, sum(u) OVER (PARTITION BY session_id ORDER BY msg DESC, pos DESC) AS turns FROM h), a AS (SELECT * FROM t WHERE turns >= 2),
    s AS (SELECT *, max(CASE WHEN event_type <> 'view' AND is_compacted THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY msg DESC, pos DESC) AS stop FROM a),
    r AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id ORDER BY msg DESC, pos DESC) AS total FROM s WHERE stop = 0 AND event_type <> 'view'),
    q AS (SELECT *, sum(tokens) OVER (PARTITION BY session_id) AS pruned FROM r WHERE total > 4000) SELECT session_id, pos FROM q WHERE pruned > 2000""",
)
def prune(spark, d):
    e, kind = table(spark, d, "events"), F.col("event_type")
    parts = e.select(
        F.col("user_id").alias("session_id"), F.floor(F.col("event_id") / 3).alias("msg"), F.col("event_id").alias("pos"), F.when(kind == "click", "user").otherwise("assistant").alias("role"),
        F.when(kind == "view", "text").otherwise("tool").alias("part_type"), F.lit("completed").alias("status"), (F.get_json_object("props", "$.k").cast("long") * 40).alias("tokens"),
        F.lit(False).alias("is_summary"), (F.col("event_id") % 97 == 0).alias("is_compacted"), F.lit(False).alias("is_protected"))
    return W.prunable(parts, protect=4000, minimum=2000).select("session_id", "pos")


@query("w02_delta", "WITH g AS (SELECT CAST(ts AS DATE) AS day, event_type AS model, count(*) AS n FROM events GROUP BY ALL) SELECT CAST(day AS VARCHAR) AS day, model, n, n - coalesce(lag(n) OVER (PARTITION BY model ORDER BY day), 0) AS delta FROM g")
def delta(spark, d):
    g = table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("model")).agg(F.count("*").alias("n"))
    return W.delta(g, ["model"], "day", "n")


@query(
    "w03_denials",
    """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('error', 'click', 'view') THEN 1 ELSE 0 END AS d FROM events), r AS (SELECT *, sum(1 - d) OVER (PARTITION BY user_id ORDER BY event_id) AS run, sum(d) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM e),
    c AS (SELECT *, sum(d) OVER (PARTITION BY user_id, run ORDER BY event_id) AS consecutive FROM r) SELECT event_id AS id, CAST(consecutive AS BIGINT) AS consecutive, CAST(total AS BIGINT) AS total, consecutive >= 3 OR total >= 20 AS escalate FROM c""",
)
def denials(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "event_type")
    return W.escalations(e, ["user_id"], "id", F.col("event_type").isin("error", "click", "view")).select("id", "consecutive", "total", "escalate")


@query("w04_doom_loop", "SELECT event_id AS id, coalesce(event_type = lag(event_type, 1) OVER w AND event_type = lag(event_type, 2) OVER w, false) AS loop FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def doom_loop(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "event_type", F.lit(False).alias("pending"))
    return W.repeated_calls(e, ["user_id"], ["id"], ["event_type"]).select("id", "loop")


@query("w05_latest", "SELECT user_id AS key, max(event_id) AS id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def latest(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "value")
    return W.latest_per_key(e, ["key"], F.col("id"))


@query("w06_since_boundary", "SELECT event_id AS id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'signup' AND f.event_id > e.event_id)")
def since_boundary(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "event_type")
    return W.since_compaction(e, "user_id", "id", F.col("event_type") == "signup").select("id")


@query("w07_last_n", "SELECT id FROM (SELECT event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 30")
def last_n(spark, d):
    from quillspark.operators.paging import top_per_group

    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"))
    return top_per_group(e, ["user_id"], 30, F.desc("id")).select("id")


@query("w08_first_three", "SELECT id FROM (SELECT event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'signup') WHERE n <= 3")
def first_three(spark, d):
    from quillspark.operators.paging import top_per_group

    e = table(spark, d, "events").where("event_type = 'signup'").select("user_id", F.col("event_id").alias("id"))
    return top_per_group(e, ["user_id"], 3, F.col("id")).select("id")


@query("w09_budget", "WITH r AS (SELECT o_custkey AS c, o_orderkey AS id, o_orderkey % 700 AS size, sum(o_orderkey % 700) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS s FROM orders) SELECT id, CASE WHEN s <= 1500 THEN size ELSE 1500 - (s - size) END AS taken FROM r WHERE s <= 1500 OR 1500 - (s - size) > 100")
def budget(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("id"), "o_orderdate", (F.col("o_orderkey") % 700).alias("size"))
    return W.within_budget(o, ["c"], [-F.unix_date(F.to_date("o_orderdate")), F.col("id")], "size", 1500).select("id", F.col("taken").cast("long").alias("taken"))


@query("w11_truncate", "SELECT id FROM (SELECT o_custkey, o_orderkey AS id, row_number() OVER w AS n, sum(o_orderkey % 700) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE n <= 5 AND s <= 2000")
def truncate(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 700).alias("size"))
    return W.head_within(o, ["o_custkey"], [F.col("id")], "size", 5, 2000).select("id")


@query("w12_cap", f"WITH {MESSAGE} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS n FROM message) WHERE n <= 2")
def cap(spark, d):
    from quillspark.operators.paging import top_per_group

    return top_per_group(message(spark, d).select("session_id", "id"), ["session_id"], 2, F.desc("id")).select("id")


@query("f02_token_estimate", f"WITH {MESSAGE} SELECT session_id, CAST(sum(floor(length(text) / 4.0 + 0.5)) AS BIGINT) AS tokens FROM message GROUP BY 1")
def token_estimates(spark, d):
    return message(spark, d).groupBy("session_id").agg(F.sum(token_estimate(F.col("text"))).alias("tokens"))
