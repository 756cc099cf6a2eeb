"""Joins and set operators over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import joins as J
from quillspark.operators import sets as U
from quillspark.operators.patterns import matches
from quillspark.operators.retrieval import similarities
from quillspark.plans.registry import query
from quillspark.plans.views import MESSAGE, SESSION, USAGE, message, session, usage
from quillspark.session import table


@query("j01_inner_keys", "SELECT s_suppkey AS id, s_name AS name, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey AND r_name = 'ASIA'")
def inner_keys(spark, d):
    r = table(spark, d, "region").where("r_name = 'ASIA'")
    n = table(spark, d, "nation").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("r_name").alias("region"))


@query(
    "j02_star",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, c_name, cn.n_name AS customer_nation, p_brand, s_name, sn.n_name AS supplier_nation, r_name
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey
    LEFT JOIN part ON l_partkey = p_partkey AND p_size > 20 LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0
    LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey LEFT JOIN region ON sn.n_regionkey = r_regionkey""",
)
def star(spark, d):
    t = lambda n: table(spark, d, n)
    nation = t("nation")
    out = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(F.broadcast(nation.select(F.col("n_nationkey").alias("ck"), F.col("n_name").alias("customer_nation"))), F.col("c_nationkey") == F.col("ck"))
    out = out.join(t("part").where("p_size > 20"), F.col("l_partkey") == F.col("p_partkey"), "left")
    out = out.join(t("supplier").where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    out = out.join(F.broadcast(nation.select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("supplier_nation"), "n_regionkey")), F.col("s_nationkey") == F.col("sk"), "left")
    out = out.join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "c_name", "customer_nation", "p_brand", "s_name", "supplier_nation", "r_name")


@query("j03_left_constant", "SELECT c_custkey AS id, o_orderkey AS urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'")
def left_constant(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("urgent"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(urgent, "id", "left")


@query("j04_right_outer", "SELECT o_orderkey AS id, c_name AS name, n_name AS nation FROM customer RIGHT JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
def right_outer(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    out = c.join(o, F.col("o_custkey") == F.col("c_custkey"), "right").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.where("c_mktsegment = 'BUILDING'").select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("nation"))


@query("j05_constant_join", "SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON c_custkey = 7 WHERE o_custkey = 7")
def constant_join(spark, d):
    one = table(spark, d, "customer").where("c_custkey = 7").select(F.col("c_name").alias("name"))
    return table(spark, d, "orders").where("o_custkey = 7").select(F.col("o_orderkey").alias("id")).join(F.broadcast(one))


@query("j06_inner_cutoff", "SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate <= TIMESTAMP '1996-06-30'")
def inner_cutoff(spark, d):
    o = table(spark, d, "orders").where("o_orderdate <= TIMESTAMP_NTZ '1996-06-30'")
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"))


@query("j07_lookup", f"WITH {SESSION} SELECT id, c_name AS project FROM (SELECT * FROM session ORDER BY time_updated DESC, id DESC LIMIT 100) LEFT JOIN customer ON c_custkey = project_id AND c_custkey % 2 = 0")
def lookup(spark, d):
    page = session(spark, d).orderBy(F.desc("time_updated"), F.desc("id")).limit(100)
    names = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("project"))
    return names.join(F.broadcast(page), "project_id", "right").select("id", "project")


@query("j08_nest", "SELECT o_orderkey AS id, count(l_orderkey) AS n, coalesce(sum(l_quantity), 0) AS quantity, coalesce(min(l_linenumber), 0) AS first FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def nest(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", "l_quantity")
    out = J.nest(o, li, "id", ["l_linenumber"], "parts")
    return out.select("id", F.size("parts").cast("long").alias("n"), F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["l_quantity"]).alias("quantity"), F.coalesce(F.get("parts", 0)["l_linenumber"], F.lit(0)).alias("first"))


@query("j09_left_coalesce", "SELECT p_partkey AS id, coalesce(s_name, 'none') AS supplier FROM part LEFT JOIN supplier ON s_suppkey = p_partkey")
def left_coalesce(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    return p.join(s, "id", "left").select("id", F.coalesce("s_name", F.lit("none")).alias("supplier"))


@query(
    "j10_full_outer_merge",
    """WITH v AS (SELECT user_id AS id, max(value) / 1000 AS score FROM events WHERE user_id % 3 <> 0 GROUP BY 1), k AS (SELECT user_id AS id, avg(value) / 100 AS score FROM events WHERE user_id % 2 = 0 GROUP BY 1)
    SELECT id, round(coalesce(v.score, 0) * 0.7 + coalesce(k.score, 0) * 0.3, 9) AS score, CASE WHEN coalesce(v.score, 0) >= coalesce(k.score, 0) THEN 'vector' ELSE 'keyword' END AS source FROM v FULL JOIN k USING (id)""",
)
def full_outer_merge(spark, d):
    e = table(spark, d, "events").withColumn("id", F.col("user_id"))
    v = e.where("id % 3 <> 0").groupBy("id").agg((F.max("value") / 1000).alias("score"))
    k = e.where("id % 2 = 0").groupBy("id").agg((F.avg("value") / 100).alias("score"))
    return J.merge_scores(v, k).withColumn("score", F.round("score", 9))


@query("j11_orphans", "SELECT 'kept' AS side, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'orphan', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def orphans(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    kept, lost = J.split_orphans(li, table(spark, d, "orders").where("o_orderstatus = 'F'"), "o_orderkey")
    n = lambda df, side: df.agg(F.lit(side).alias("side"), F.count("*").alias("n"))
    return n(kept, "kept").unionByName(n(lost, "orphan"))


@query("j12_anti", "SELECT p_partkey AS id FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3')")
def anti(spark, d):
    off = table(spark, d, "part").where("p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')").select("p_brand").distinct()
    return table(spark, d, "part").join(F.broadcast(off), "p_brand", "left_anti").select(F.col("p_partkey").alias("id"))


@query("j13_insert_absent", "SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW')")
def insert_absent(spark, d):
    new = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return J.absent_only(new, table(spark, d, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("id")), ["id"])


@query("j14_theta_pattern", "SELECT p_partkey AS id, pattern FROM part JOIN (VALUES ('%ring'), ('red%'), ('small %')) t(pattern) ON p_name LIKE pattern")
def theta_pattern(spark, d):
    pats = spark.sql("SELECT * FROM VALUES ('*ring'), ('red*'), ('small *') AS t(pattern)").where("pattern NOT LIKE '% *'").unionByName(spark.sql("SELECT 'small ?*' AS pattern"))
    hit = matches(table(spark, d, "part"), pats, "p_name")
    return hit.select(F.col("p_partkey").alias("id"), F.replace(F.replace("pattern", F.lit("?"), F.lit("")), F.lit("*"), F.lit("%")).alias("pattern"))


@query("j15_similarity", "SELECT v.vec_id AS id, q.vec_id AS query, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0")
def similarity(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_embedding"))
    return similarities(v, q, "vec_id", digits=6).select("id", "query", "score")


@query("j16_self_join", f"WITH {MESSAGE} SELECT u.id, count(a.id) AS replies, coalesce(sum(a.cost), 0) AS cost FROM message u LEFT JOIN message a ON a.id - 1 = u.id AND a.role = 'assistant' WHERE u.role = 'user' GROUP BY u.id")
def self_join(spark, d):
    m = message(spark, d)
    replies = m.where("role = 'assistant'").select((F.col("id") - 1).alias("parent"), F.col("id").alias("reply"), "cost")
    own = m.where("role = 'user'").select("id")
    return own.join(replies, F.col("id") == F.col("parent"), "left").groupBy("id").agg(F.count("reply").alias("replies"), F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"))


@query("j17_fork", f"WITH {MESSAGE} SELECT id + 1000000 AS id, CASE WHEN turn > 0 THEN id - 1 + 1000000 END AS parent_id FROM message WHERE turn < 3")
def fork(spark, d):
    m = message(spark, d).where("turn < 3").select("id", F.when(F.col("turn") > 0, F.col("id") - 1).alias("parent_id"))
    mapping = m.select(F.col("id").alias("old"), (F.col("id") + 1_000_000).alias("new"))
    return J.remapped(m, mapping, "id", "parent_id")


@query("j18_share_of_limit", "SELECT p_partkey AS id, CASE WHEN lim > 0 THEN CAST(round(CAST(p_size AS DOUBLE) / lim * 100) AS BIGINT) END AS percent FROM part LEFT JOIN (VALUES ('ECONOMY', 50), ('STANDARD', 40), ('PROMO', 0)) l(kind, lim) ON kind = p_type")
def share_of_limit(spark, d):
    limits = spark.sql("SELECT * FROM VALUES ('ECONOMY', 50), ('STANDARD', 40), ('PROMO', 0) AS l(p_type, lim)")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_size")
    return J.share_of_limit(rows, F.broadcast(limits), ["p_type"], "p_size", "lim").select("id", "percent")


@query("j19_cascade_delete", f"WITH RECURSIVE {SESSION}, r AS (SELECT id FROM session WHERE id IN (1, 2, 40) UNION SELECT s.id FROM session s JOIN r ON s.parent_id = r.id) SELECT id FROM session WHERE id NOT IN (SELECT id FROM r)")
def cascade_delete(spark, d):
    s = session(spark, d)
    gone = J.descendants(s, s.where("id IN (1, 2, 40)"))
    return s.join(gone, "id", "left_anti").select("id")


@query(
    "j20_as_of",
    f"WITH {USAGE} SELECT id, (SELECT u.id FROM usage u WHERE u.key_id = p.key_id AND u.model = 'signup' AND u.t < p.t ORDER BY u.t DESC LIMIT 1) AS signup FROM usage p WHERE model = 'purchase'",
)
def as_of(spark, d):
    u = usage(spark, d)
    left = u.where("model = 'purchase'").select("id", "key_id", "t")
    right = u.where("model = 'signup'").select("key_id", F.col("t").alias("at"), F.col("id").alias("signup_id"))
    return J.latest_before(left, right, "key_id", "t", "at", "signup_id", "signup").select("id", "signup")


@query("j21_constant_on", "SELECT c_custkey AS id, c_name AS name, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = 2")
def constant_on(spark, d):
    r = table(spark, d, "region").where("r_regionkey = 2").select(F.col("r_name").alias("region"))
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return c.join(F.broadcast(r)).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "region")


@query("u01_distinct_union", "SELECT DISTINCT w FROM (SELECT event_id % 60 AS w FROM events UNION ALL SELECT o_orderkey % 70 FROM orders) ORDER BY w")
def distinct_union(spark, d):
    return U.distinct_union(table(spark, d, "events").select((F.col("event_id") % 60).alias("w")), table(spark, d, "orders").select((F.col("o_orderkey") % 70).alias("w")), "w")


@query("u02_concat", "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, NULL FROM region")
def concat(spark, d):
    return U.concatenated(table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")), table(spark, d, "region").select(F.col("r_name").alias("name")))


@query("u03_last_wins", "SELECT user_id AS key, arg_max(event_type, event_id) AS value, max(event_id) AS seq FROM events GROUP BY user_id")
def last_wins(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))
    return U.last_wins(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"), "key", "seq")


@query("u04_difference", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def difference(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return U.vanished(c.select("id"), c.where("c_mktsegment = 'MACHINERY'"), "id")


@query("u05_overlap", "SELECT p_partkey AS id, len(list_intersect(a, b)) AS common, len(list_distinct(list_concat(a, b))) AS all_ FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, ['red', 'ring', 'small'] AS b FROM part)")
def overlap(spark, d):
    both = U.overlap(F.split("p_name", " "), F.array(F.lit("red"), F.lit("ring"), F.lit("small")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), both.alias("o")).select("id", F.col("o.common").cast("long").alias("common"), F.col("o.all").cast("long").alias("all_"))
