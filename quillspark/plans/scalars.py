"""Scalar functions over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import calendar as C
from quillspark.functions import documents as D
from quillspark.functions import keywords as K
from quillspark.functions import money as M
from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.plans.registry import query
from quillspark.plans.views import FILE, MESSAGE, SESSION, USAGE, file, message, session, usage
from quillspark.session import table


@query("f01_utf16_length", f"WITH {FILE} SELECT id, length(text) + length(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS n FROM file")
def utf16_length(spark, d):
    return file(spark, d).select("id", T.utf16_length(F.col("text")).cast("long").alias("n"))


@query("f03_token_ceiling", f"WITH {MESSAGE} SELECT id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n FROM message")
def token_ceiling(spark, d):
    return message(spark, d).select("id", T.token_ceiling(F.col("text")).alias("n"))


@query("f04_weighted_size", "SELECT p_partkey AS id, length(p_name) + 8 AS n FROM part")
def weighted_size(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.weighted_size(F.concat("p_name", F.lit("中文"))).cast("long").alias("n"))


@query("f05_half_up", "SELECT event_id AS id, CAST(floor((value - 50) * 4 + 0.5) AS BIGINT) AS n FROM events")
def half_up(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), T.half_up((F.col("value") - 50) * 4).cast("long").alias("n"))


@query("f06_sha_prefix", f"WITH {FILE} SELECT id, left(sha256(text), 16) AS chunk, left(sha256(path || ':' || id), 24) AS place FROM file")
def sha_prefix(spark, d):
    return file(spark, d).select("id", T.sha_prefix(F.col("text"), 16).alias("chunk"), T.sha_prefix(F.concat("path", F.lit(":"), "id"), 24).alias("place"))


@query("f07_context_hash", f"WITH {MESSAGE}, l AS (SELECT session_id, text, id, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS r FROM message) SELECT session_id, sha256(string_agg(text, chr(31) ORDER BY id) || chr(31) || max(n)) AS hash FROM l WHERE r <= 3 GROUP BY 1")
def context_hash(spark, d):
    m = message(spark, d).groupBy("session_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("id", "text"))).alias("l"))
    last = F.transform(F.slice("l", F.greatest(F.size("l") - 2, F.lit(1)), 3), lambda x: x["text"])
    return m.select("session_id", F.sha2(F.concat(F.array_join(last, "\x1f"), F.lit("\x1f"), "n"), 256).alias("hash"))


@query("f08_bucket_hash", "SELECT c_custkey AS id, ((((ascii(s[1]) * 31 + ascii(s[2])) * 31 + ascii(s[3])) * 31 + ascii(s[4])) % 4294967296) % 7 AS bucket FROM (SELECT c_custkey, right(c_name, 4) AS s FROM customer)")
def bucket_hash(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (T.bucket_hash(F.col("c_name")) % 7).alias("bucket"))


@query("f09_cursor", "SELECT c_custkey AS id, rtrim(replace(replace(base64(encode('{\"id\":\"' || c_name || '\"}')), '+', '-'), '/', '_'), '=') AS cursor FROM customer")
def cursor(spark, d):
    raw = F.concat(F.lit('{"id":"'), "c_name", F.lit('"}'))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.rtrim(F.translate(F.base64(F.encode(raw, "utf-8")), "+/=", "-_"), F.lit("=")).alias("cursor"))


@query("f10_date", "SELECT event_id AS id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def date(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.to_date("ts").cast("string").alias("day"))


@query("f11_yearweek", "SELECT o_orderkey AS id, CAST(isoyear(o_orderdate) * 100 + week(o_orderdate) AS BIGINT) AS week FROM orders")
def yearweek(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), C.iso_yearweek(F.col("o_orderdate")).alias("week"))


@query("f12_week_bounds", "SELECT o_orderkey AS id, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday, strftime(date_trunc('week', o_orderdate) + INTERVAL 7 DAY, '%Y-%m-%d') AS until FROM orders")
def week_bounds(spark, d):
    t = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(C.week_start(t), "yyyy-MM-dd").alias("monday"), F.date_format(C.week_end(t), "yyyy-MM-dd").alias("until"))


@query("f13_week_span", "SELECT o_orderkey AS id, CAST(date_diff('day', o_orderdate, date_trunc('week', o_orderdate) + INTERVAL 7 DAY) AS INTEGER) AS days_left FROM orders")
def week_span(spark, d):
    t = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.datediff(C.week_end(t), t).alias("days_left"))


@query(
    "f14_monthly_bounds",
    """WITH b AS (SELECT o_orderkey AS id, o_orderdate AS s, date_trunc('month', o_orderdate) + INTERVAL 16 MONTH + INTERVAL (o_orderkey % 28) DAY AS now FROM orders),
    a AS (SELECT *, date_trunc('month', now) AS m FROM b), c AS (SELECT *, m + INTERVAL 1 DAY * (least(day(s), day(last_day(m))) - 1) AS this,
    (m - INTERVAL 1 MONTH) + INTERVAL 1 DAY * (least(day(s), day(last_day(m - INTERVAL 1 MONTH))) - 1) AS prev, (m + INTERVAL 1 MONTH) + INTERVAL 1 DAY * (least(day(s), day(last_day(m + INTERVAL 1 MONTH))) - 1) AS next FROM a)
    SELECT id, strftime(CASE WHEN this <= now THEN this ELSE prev END, '%Y-%m-%d') AS start, strftime(CASE WHEN this <= now THEN next ELSE this END, '%Y-%m-%d') AS until FROM c""",
)
def monthly_bounds(spark, d):
    s = F.col("o_orderdate").cast("timestamp")
    now = F.add_months(F.date_trunc("month", s), 16).cast("timestamp") + F.make_dt_interval((F.col("o_orderkey") % 28).cast("int"))
    start, end = C.monthly_bounds(now, s)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(start, "yyyy-MM-dd").alias("start"), F.date_format(end, "yyyy-MM-dd").alias("until"))


@query("f15_month_start", "SELECT o_orderkey AS id, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month FROM orders")
def month_start(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(C.month_start(F.col("o_orderdate").cast("timestamp")), "yyyy-MM-dd").alias("month"))


@query("f16_same_month", "SELECT o_orderkey AS id FROM orders WHERE month(o_orderdate) = 5 AND year(o_orderdate) = 1997")
def same_month(spark, d):
    return table(spark, d, "orders").where(C.same_month(F.col("o_orderdate"), F.lit("1997-05-20").cast("date"))).select(F.col("o_orderkey").alias("id"))


@query("f17_unix_window", "SELECT event_id AS id FROM events WHERE epoch(ts) >= epoch(TIMESTAMP '2024-01-20') - 86400")
def unix_window(spark, d):
    u = lambda c: F.unix_micros(c) / 1_000_000
    return usage(spark, d).where(u(F.col("t")) >= u(F.lit("2024-01-20 00:00:00").cast("timestamp")) - 86400).select("id")


@query("f18_to_next_day", f"WITH {MESSAGE} SELECT id, CAST(ceil((86400000 - time_created % 86400000) / 1000.0) AS BIGINT) AS seconds FROM message")
def to_next_day(spark, d):
    return message(spark, d).select("id", C.seconds_to_next_day(F.col("time_created")).alias("seconds"))


@query("f19_day_key", "SELECT event_id AS id, strftime(ts, '%Y%m%d') AS day FROM events")
def day_key(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), C.day_key(F.col("ts")).alias("day"))


@query("f20_path_date", f"WITH {FILE} SELECT id, CAST(TRY_CAST(nullif(regexp_extract(path, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS DATE) AS VARCHAR) AS day FROM file")
def path_date(spark, d):
    return file(spark, d).select("id", C.path_date(F.col("path")).cast("string").alias("day"))


@query("f21_id_time", f"WITH {SESSION} SELECT id, (time_created * 4096 + id % 4096) % 281474976710656 // 4096 AS ms FROM session")
def id_time(spark, d):
    raw = (F.col("time_created") * 4096 + F.col("id") % 4096) % (1 << 48)
    made = F.concat(F.lit("ses_"), F.lower(F.lpad(F.hex(raw), 12, "0")), F.lit("abcDEF"))
    return session(spark, d).select("id", C.id_millis(made).alias("ms"))


@query("f22_json_extract", "SELECT event_id AS id, CAST(props->>'$.k' AS BIGINT) AS k, props->>'$.missing' AS missing FROM events")
def json_extract(spark, d):
    g = F.get_json_object
    return table(spark, d, "events").select(F.col("event_id").alias("id"), g("props", "$.k").cast("long").alias("k"), g("props", "$.missing").alias("missing"))


_PROPS = """'{"o": {"a": [1, 2.50, null]}, ' || substr(props, 2, length(props) - 2) || ', "b": true}'"""


@query("f23_json_set", f"SELECT event_id AS id, regexp_replace({_PROPS}, '\\}}$', ',\"added\":\"' || event_type || '\"}}') AS added, regexp_replace({_PROPS}, '\"k\": [0-9]+', '\"k\": ' || event_id) AS changed, regexp_replace({_PROPS}, ', \"k\": [0-9]+', '') AS removed FROM events")
def json_set(spark, d):
    from quillspark.operators.writes import json_set as set_

    e = table(spark, d, "events").withColumn("p", F.expr(_PROPS))
    return e.select(F.col("event_id").alias("id"), set_("p", "added", F.col("event_type")).alias("added"), set_("p", "k", F.col("event_id")).alias("changed"), set_("p", "k", None).alias("removed"))


@query("f24_coalesce", f"WITH {USAGE} SELECT id, coalesce(reasoning, cache_read, -1) AS v FROM usage")
def coalesce(spark, d):
    return usage(spark, d).select("id", F.coalesce("reasoning", "cache_read", F.lit(-1)).alias("v"))


@query(
    "f25_step_cost",
    f"""WITH {USAGE} SELECT id, round(CASE WHEN input * 3000 + coalesce(cache_read, 0) > 200000 THEN (input * 3000 * 6.0 + output * 22.5 + coalesce(cache_read, 0) * 0.6 + coalesce(reasoning, 0) * 22.5)
    ELSE (input * 3000 * 3.0 + output * 15.0 + coalesce(cache_read, 0) * 0.3 + coalesce(reasoning, 0) * 15.0) END / 1000000, 9) AS cost FROM usage""",
)
def step_cost(spark, d):
    z = lambda c: F.coalesce(c, F.lit(0))
    tokens = {"input": F.col("input") * 3000, "output": F.col("output"), "reasoning": z("reasoning"), "cache_read": z("cache_read"), "cache_write": F.lit(0)}
    rates = {k: F.lit(v) for k, v in (("input", 3.0), ("output", 15.0), ("cache_read", 0.3), ("cache_write", 3.75))}
    large = {k: F.lit(v) for k, v in (("input", 6.0), ("output", 22.5), ("cache_read", 0.6), ("cache_write", 7.5))}
    return usage(spark, d).select("id", F.round(M.step_cost(tokens, rates, large), 9).alias("cost"))


@query("f26_hosted_cost", f"WITH {USAGE} SELECT id, CAST(floor((2 * CAST(input AS DOUBLE) * 100 + 8 * CAST(output AS DOUBLE) * 100 + coalesce(8 * CAST(reasoning AS DOUBLE) * 100, 0) + coalesce(0.5 * cache_read * 100, 0)) * 1000000 + 0.5) AS BIGINT) AS cost FROM usage")
def hosted_cost(spark, d):
    tokens = {"input": F.col("input"), "output": F.col("output"), "reasoning": F.col("reasoning"), "cache_read": F.col("cache_read"), "cache_write_5m": F.lit(None).cast("long"), "cache_write_1h": F.lit(0)}
    rates = {"input": F.lit(2.0), "output": F.lit(8.0), "cache_read": F.lit(0.5), "cache_write_5m": F.lit(0.0), "cache_write_1h": F.lit(1.0)}
    return usage(spark, d).select("id", M.hosted_cost(tokens, rates, rates).alias("cost"))


@query("f27_processing_fee", "SELECT p_partkey AS id, CAST(floor((((p_size * 100) + 30) / 0.956::DOUBLE) * 0.044::DOUBLE + 30 + 0.5) AS BIGINT) AS fee FROM part")
def processing_fee(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), M.processing_fee(F.col("p_size") * 100).alias("fee"))


@query(
    "f28_weekly_limit",
    f"""WITH {USAGE}, n AS (SELECT *, TIMESTAMP '2024-01-31 10:00:00' AS now FROM usage)
    SELECT id, CASE WHEN t >= TIMESTAMP '2024-01-29' AND cost * 100000 >= 2000000000 THEN 'rate-limited' ELSE 'ok' END AS status, CAST(epoch(TIMESTAMP '2024-02-05') - epoch(now) AS BIGINT) AS reset_sec,
    CASE WHEN t < TIMESTAMP '2024-01-29' THEN 0 WHEN cost * 100000 >= 2000000000 THEN 100 ELSE CAST(floor(cost * 100000 / 2000000000.0 * 100) AS BIGINT) END AS percent FROM n""",
)
def weekly_limit(spark, d):
    now = F.lit("2024-01-31 10:00:00").cast("timestamp")
    return usage(spark, d).select("id", M.weekly_status(F.col("cost") * 100_000, F.col("t"), now, F.lit(20)).alias("s")).select("id", "s.*")


@query("f29_overflow", f"WITH {USAGE} SELECT id, CASE WHEN input % 2 = 0 THEN input * 2000 + output ELSE input * 2500 END >= 200000 - 8000 AS over FROM usage")
def overflow(spark, d):
    total = F.when(F.col("input") % 2 == 0, F.lit(0)).otherwise(F.col("input") * 2500)
    return usage(spark, d).select("id", M.overflows(total, F.col("input") * 2000 + F.col("output"), F.lit(200_000), F.lit(None).cast("int"), F.lit(8000)).alias("over"))


@query("f30_frecency", f"WITH {USAGE} SELECT id, round(input / (1.0 + output), 9) AS score FROM usage")
def frecency(spark, d):
    return usage(spark, d).select("id", F.round(M.frecency(F.col("input"), F.col("output")), 9).alias("score"))


@query("f31_retry_delay", "SELECT l_orderkey AS id, l_linenumber AS attempt, CAST(least(2000 * pow(2, l_linenumber - 1), 30000) AS BIGINT) AS ms FROM lineitem")
def retry_delay(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("attempt"), M.retry_delay(F.col("l_linenumber")).alias("ms"))


@query("f32_locale", "SELECT p_partkey AS id, CASE WHEN p_size * 40000 >= 1000000 THEN format('{:.1f}', p_size * 40000 / 1000000.0) || 'M' WHEN p_size * 40000 >= 1000 THEN format('{:.1f}', p_size * 40000 / 1000.0) || 'K' ELSE CAST(p_size * 40000 AS VARCHAR) END AS short, CASE WHEN length(p_name) <= 8 THEN p_name ELSE left(p_name, 7) || '…' END AS cut, CASE WHEN length(p_brand || p_name) <= 12 THEN p_brand || p_name ELSE left(p_brand || p_name, 6) || '…' || right(p_brand || p_name, 5) END AS middle, p_size || CASE WHEN p_size = 1 THEN ' item' ELSE ' items' END AS many FROM part")
def locale(spark, d):
    both = F.concat("p_brand", "p_name")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.short_number(F.col("p_size") * 40000).alias("short"), T.truncate(F.col("p_name"), 8).alias("cut"), T.truncate_middle(both, 12).alias("middle"), T.pluralize(F.col("p_size"), "{} item", "{} items").alias("many"))


@query("f33_html_escape", "SELECT page_id AS id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS digest FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.md5(T.html_escape(F.col("html"))).alias("digest"))


@query("f34_numbered_block", "SELECT n_regionkey AS id, 'head' || chr(10) || string_agg(i || '. ' || n_name, chr(10) ORDER BY i) || chr(10) || 'tail' AS block FROM (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation) GROUP BY 1")
def numbered_block(spark, d):
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.sort_array(F.collect_list("n_name")).alias("l"))
    return n.select("id", T.numbered_block(F.col("l"), "head", "tail").alias("block"))


@query("f35_html_text")
def html_text(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), D.text_of_html("html").alias("text"))


@query("f36_html_markdown")
def html_markdown(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), D.markdown_of_html("html").alias("markdown"))


@query("f37_levenshtein", "SELECT p_partkey AS id, CAST(levenshtein(p_name, 'small ring') AS INTEGER) AS distance FROM part")
def levenshtein(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.levenshtein("p_name", F.lit("small ring")).alias("distance"))


@query("f38_fuzzy_replace", "SELECT c_custkey AS id, 'begin' || chr(10) || 'new ' || c_name || chr(10) || 'end' AS text FROM customer")
def fuzzy_replace(spark, d):
    name = F.col("c_name")
    body = F.concat(F.lit("begin\n  old  "), name, F.lit("\nend"))
    out = D.replaced(body, F.concat(F.lit("old "), name), F.concat(F.lit("new "), name))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), out.alias("r")).select("id", F.col("r.text").alias("text"))


@query("f39_dedent", "SELECT c_custkey AS id, 'a' || chr(10) || '  ' || c_name AS text FROM customer")
def dedent(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.dedent(F.concat(F.lit("    a\n      "), "c_name")).alias("text"))


@query("f40_numstat", "SELECT p_partkey AS id, p_name AS file, CAST(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END AS BIGINT) AS additions, CAST(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size * 2 END AS BIGINT) AS deletions, p_size % 5 = 0 AS \"binary\" FROM part")
def numstat(spark, d):
    s = F.col("p_size")
    line = F.when(s % 5 == 0, F.concat(F.lit("-\t-\t"), "p_name")).otherwise(F.concat_ws("\t", s, s * 2, "p_name"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.numstat(line).alias("n")).select("id", "n.*")


@query("f41_sections", "SELECT r_regionkey AS id, '## Rules' || chr(10) || r_name AS section FROM region")
def sections(spark, d):
    text = F.concat(F.lit("# T\n## Rules\n"), "r_name", F.lit("\n## Other\nx"))
    return table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.get(D.section_column(["rules"])(text), 0).alias("section"))


@query("f42_summary_only", "SELECT r_regionkey AS id, 'kept ' || r_name AS text FROM region")
def summary_only(spark, d):
    text = F.concat(F.lit("<analysis>a\nb</analysis><summary>kept "), "r_name", F.lit("</summary>"))
    return table(spark, d, "region").select(F.col("r_regionkey").alias("id"), T.summary_only(text).alias("text"))


_E = "CAST(embedding AS DOUBLE[])"


@query("f43_normalized", f"SELECT vec_id AS id, round(embedding[1] / sqrt(list_dot_product({_E}, {_E})), 6) AS x FROM embeddings")
def normalized(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(F.get(V.normalized(F.col("embedding")), 0), 6).alias("x"))


@query("f44_cosine", "SELECT a.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v.join(v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("e")), "id").select("id", F.round(V.cosine(F.col("embedding"), F.col("e")), 6).alias("cosine"))


@query("f45_closeness", "SELECT a.vec_id AS id, round(1 / (1 + list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def closeness(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v.join(v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("e")), "id").select("id", F.round(V.closeness(V.l2(F.col("embedding"), F.col("e"))), 6).alias("score"))


@query("f46_jaccard", "SELECT a.p_partkey AS id, round(len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) * 1.0 / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))), 6) AS score FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def jaccard(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), V.token_set(F.col("p_name")).alias("s"))
    return p.join(p.select((F.col("id") - 1).alias("id"), F.col("s").alias("o")), "id").select("id", F.round(V.jaccard(F.col("s"), F.col("o")), 6).alias("score"))


@query("f47_keywords", "SELECT p_partkey AS id, array_to_string(string_split(p_name, ' '), ',') AS keywords FROM part")
def keywords(spark, d):
    said = F.concat(F.lit("what was the "), "p_name", F.lit(" thing?"))
    out = K.with_keywords(table(spark, d, "part").select(F.col("p_partkey").alias("id"), said.alias("query")))
    return out.select("id", F.array_join("keywords", ",").alias("keywords"))


@query("f48_expanded", "SELECT p_partkey AS id, 'the ' || p_name || ' OR ' || array_to_string(string_split(p_name, ' '), ' OR ') AS expanded FROM part")
def expanded(spark, d):
    out = K.with_keywords(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("the "), "p_name").alias("query")))
    return out.select("id", "expanded")


@query("f49_augmented", "SELECT r_regionkey AS id, r_name || '讨论方 讨 论 方 讨论 论方' AS text FROM region")
def augmented(spark, d):
    return table(spark, d, "region").select(F.col("r_regionkey").alias("id"), K.augmented(F.concat("r_name", F.lit("讨论方"))).alias("text"))


@query("f50_share_id", "SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN 's' || page_id END AS share FROM pages")
def share_id(spark, d):
    url = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://example.com/s/s"), "page_id")).otherwise(F.col("url"))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), T.share_id(url).alias("share"))


@query("f51_defaults", f"WITH {USAGE} SELECT id, coalesce(reasoning, 7) AS strict, CASE WHEN reasoning IS NULL OR reasoning = 0 THEN 7 ELSE reasoning END AS loose FROM usage")
def defaults(spark, d):
    return usage(spark, d).select("id", F.coalesce("reasoning", F.lit(7)).alias("strict"), T.or_default(F.col("reasoning"), 7).alias("loose"))


@query("f52_normalized_usage", f"WITH {USAGE} SELECT id, CASE WHEN id % 2 = 0 THEN input ELSE input * 2 - id % 10 END AS input, CASE WHEN id % 2 = 0 THEN output ELSE output - id % 5 END AS output, CASE WHEN id % 2 = 0 THEN 0 ELSE id % 5 END AS reasoning, id % 10 AS cache_read FROM usage")
def normalized_usage(spark, d):
    js = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    i, even = F.col("id"), F.col("id") % 2 == 0
    a = js(input_tokens=F.col("input"), output_tokens=F.col("output"), cache_read_input_tokens=i % 10)
    b = js(input_tokens=F.col("input") * 2, output_tokens=F.col("output"), input_tokens_details=F.struct((i % 10).alias("cached_tokens")), output_tokens_details=F.struct((i % 5).alias("reasoning_tokens")))
    out = M.normalized_usage(F.when(even, "messages").otherwise("responses"), F.when(even, a).otherwise(b))
    return usage(spark, d).select("id", out.alias("u")).select("id", "u.input", "u.output", "u.reasoning", "u.cache_read")


@query("f53_layers", "SELECT * FROM (VALUES ('model', 'b'), ('plugin', 'x,y,z')) AS t(k, v)")
def layers(spark, d):
    from quillspark.functions.config import merged

    got = merged({"model": "a", "plugin": ["x", "y"]}, {"model": "b", "plugin": ["y", "z"]})
    return spark.createDataFrame([(k, ",".join(v) if isinstance(v, list) else v) for k, v in got.items()], "k string, v string")


@query("f54_seek", "SELECT c_custkey AS id, CAST(1 + c_custkey % 3 AS INTEGER) AS place FROM customer")
def seek(spark, d):
    k = F.col("c_custkey")
    lines = F.concat(F.array(F.lit("first")), F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("pad"))).otherwise(F.array(F.lit("pad"), F.lit("pad"))), F.array(F.lit("  \u201csaid\u201d\u2014x  "), F.lit("last ")))
    pattern = F.array(F.lit('"said"-x'), F.lit("last"))
    return table(spark, d, "customer").select(k.alias("id"), D.place_of(lines, pattern).alias("place"))
