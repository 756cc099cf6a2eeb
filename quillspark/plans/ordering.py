"""Sorts, limits and pages over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import paging as P
from quillspark.plans.registry import query
from quillspark.plans.views import FILE, MESSAGE, SESSION, USAGE, file, message, session, usage
from quillspark.session import table


@query("t01_newest", f"WITH {SESSION} SELECT id, time_updated FROM session ORDER BY time_updated DESC, id DESC LIMIT 100")
def newest(spark, d):
    return P.newest(session(spark, d), 100).select("id", "time_updated")


@query("t02_tie_break", f"WITH {SESSION} SELECT id, title FROM session ORDER BY title DESC, id DESC LIMIT 40")
def tie_break(spark, d):
    return P.newest(session(spark, d), 40, "title").select("id", "title")


@query("t03_keyset_page", f"WITH {SESSION} SELECT id FROM session WHERE (time_created, id) < (SELECT (time_created, id) FROM session ORDER BY time_created DESC, id DESC LIMIT 1 OFFSET 24) ORDER BY time_created DESC, id DESC LIMIT 25")
def keyset_page(spark, d):
    rows = session(spark, d).select("id", "time_created")
    _, _, cursor = P.keyset_page(rows, 25)
    page, _, _ = P.keyset_page(rows, 25, cursor)
    return page.select("id")


@query("t04_time_cursor", f"WITH {SESSION}, p AS (SELECT time_updated FROM session ORDER BY time_updated DESC, id DESC LIMIT 30) SELECT id FROM session WHERE time_updated < (SELECT min(time_updated) FROM p) ORDER BY time_updated DESC, id DESC LIMIT 30")
def time_cursor(spark, d):
    rows = session(spark, d).select("id", "time_updated")
    last = P.updated_before(rows, None, 30).agg(F.min("time_updated")).first()[0]
    return P.updated_before(rows, last, 30).select("id")


@query("t05_full_backward", f"WITH {MESSAGE} SELECT id, n, (n - 1) // 4 AS page FROM (SELECT id, row_number() OVER (PARTITION BY session_id ORDER BY time_created DESC, id DESC) AS n FROM message)")
def full_backward(spark, d):
    return P.backward_pages(message(spark, d), "session_id", 4).select("id", "page", "n")


@query("t06_offset_page", "SELECT c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 50")
def offset_page(spark, d):
    return P.offset_page(table(spark, d, "customer"), 1, 50, F.desc("c_acctbal"), F.col("c_custkey")).select(F.col("c_custkey").alias("id"))


@query("t07_top_score", "SELECT event_id AS id, value FROM events ORDER BY value DESC, event_id DESC LIMIT 20")
def top_score(spark, d):
    return P.newest(table(spark, d, "events").select(F.col("event_id").alias("id"), "value"), 20, "value")


@query("t08_newest_matches", f"WITH {FILE} SELECT path FROM file WHERE regexp_matches(text, 'idiot|Idiot|the ') ORDER BY mtime DESC, path DESC LIMIT 100")
def newest_matches(spark, d):
    return P.newest(file(spark, d).where(F.col("text").rlike("idiot|Idiot|the ")), 100, "mtime", "path").select("path")


@query("t09_first_then_sort", f"WITH {FILE} SELECT path, mtime FROM (SELECT path, mtime FROM file ORDER BY path LIMIT 100) ORDER BY mtime DESC")
def first_then_sort(spark, d):
    return P.first_then_sort(file(spark, d).select("path", "mtime"), 100)


@query("t10_random_sample", "SELECT c_custkey AS id FROM customer ORDER BY md5('7:' || c_custkey), c_custkey LIMIT 100")
def random_sample(spark, d):
    return P.sample(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), 100, 7, "id")


@query("t11_multi_key", "SELECT n_regionkey AS region, n_name AS name FROM nation ORDER BY n_regionkey, n_name LIMIT 10")
def multi_key(spark, d):
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("name")).orderBy("region", "name").limit(10)


@query("t12_keep_newest", "SELECT event_id AS id FROM events ORDER BY ts DESC, event_id LIMIT 500")
def keep_newest(spark, d):
    return P.keep_newest(table(spark, d, "events").select(F.col("event_id").alias("id"), "ts"), 500, "ts", "id").select("id")


@query("t13_top_share", "SELECT event_type AS kind, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM events) * 100, 1) AS percent FROM events GROUP BY 1 ORDER BY n DESC, kind LIMIT 3")
def top_share(spark, d):
    return P.top_share(table(spark, d, "events").select(F.col("event_type").alias("kind")), "kind", 3)


@query("t14_listing_order", f"WITH {FILE}, x AS (SELECT path AS name, 'file' AS kind FROM file UNION ALL SELECT DISTINCT 'dir' || (id % 5), 'directory' FROM file) SELECT name, kind FROM x ORDER BY kind <> 'directory', name")
def listing_order(spark, d):
    f = file(spark, d)
    x = f.select(F.col("path").alias("name"), F.lit("file").alias("kind")).union(f.select(F.concat(F.lit("dir"), F.col("id") % 5), F.lit("directory")).distinct())
    return P.listing_order(x)


@query("t15_hidden_last", f"WITH {FILE} SELECT path FROM file ORDER BY contains(path, '/.hidden/'), path LIMIT 60")
def hidden_last(spark, d):
    return P.hidden_last(file(spark, d).select("path")).limit(60)


@query("t16_join_newest", "SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def join_newest(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'"), F.col("o_custkey") == F.col("c_custkey"))
    return P.newest(j, 1, "o_orderdate", "o_orderkey").select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"))


@query("t17_priority_rank", "SELECT p_partkey AS id FROM part ORDER BY CASE WHEN p_name LIKE '%red%' THEN 0 WHEN p_name LIKE '%ring%' THEN 1 ELSE -1 END DESC, CASE WHEN p_name LIKE '%latest%' THEN 0 ELSE 1 END, p_name || p_partkey DESC LIMIT 30")
def priority_rank(spark, d):
    p = table(spark, d, "part").select(F.concat("p_name", "p_partkey").alias("id"), "p_partkey")
    return P.ranked_models(p, ["red", "ring"]).limit(30).select(F.col("p_partkey").alias("id"))


@query("t18_score_fusion", f"WITH {USAGE} SELECT id, round(cost * CASE WHEN model LIKE 'c%' THEN 2 ELSE 1 END * (1 + input / 10.0), 4) AS score FROM usage ORDER BY cost * CASE WHEN model LIKE 'c%' THEN 2 ELSE 1 END * (1 + input / 10.0) DESC, id LIMIT 10")
def score_fusion(spark, d):
    u = usage(spark, d).select("id", F.col("cost").alias("fuzzy"), F.col("model").startswith("c").alias("is_prefix"), (F.col("input") / 10).alias("frecency"))
    return P.fused(u, 10).select("id", F.round("score", 4).alias("score"))
