"""Retrieval and file search over the synthetic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.keywords import extract
from quillspark.operators import joins as J
from quillspark.operators import retrieval as R
from quillspark.operators import search as S
from quillspark.operators.keyword_index import KeywordIndex
from quillspark.operators.trigram_index import TrigramIndex
from quillspark.operators.vector_search import VectorIndex
from quillspark.plans.registry import query
from quillspark.plans.views import FILE, file
from quillspark.session import scratch, table
from quillspark.sources.files import needs_rebuild, sync_plan

TERMS = extract("please find the thing about erwh tion")


@query("r01_fingerprints", f"WITH {FILE} SELECT sha256(text) AS hash, count(*) AS n FROM file GROUP BY 1")
def fingerprints(spark, d):
    return file(spark, d).groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"))


@query("w10_chunk_counts")
def chunk_counts(spark, d):
    return R.chunks(file(spark, d)).groupBy("path").agg(F.count("*").alias("chunks"), F.max("end_line").alias("lines"))


@query("r02_chunks")
def chunks(spark, d):
    return R.chunks(file(spark, d))


def fake_provider(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in for an embedding service."""
    return [[float(len(t)), float(t.count(" ")), float(t.count("e"))] for t in texts]


@query("r03_embed", f"WITH {FILE} SELECT id, CAST(length(text) AS DOUBLE) AS a, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS b FROM file")
def embed(spark, d):
    f = file(spark, d).withColumn("hash", F.sha2("text", 256))
    cache = f.where("id % 3 = 0").dropDuplicates(["hash"]).select("hash", F.lit("m").alias("model"), F.array(F.length("text").cast("float"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).cast("float"), F.lit(0.0).cast("float")).alias("embedding"))
    out, _ = R.embed(f.select("id", "hash", "text"), cache, fake_provider, "m")
    return out.select("id", F.get("embedding", 0).cast("double").alias("a"), F.get("embedding", 1).cast("double").alias("b"))


_WORDS = """w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) > 0) AS words FROM file), l AS (SELECT id, len(words) AS n FROM w WHERE len(words) > 0),
    p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM w) WHERE term IN ('erwh', 'tion') GROUP BY ALL), s AS (SELECT count(*) AS docs, avg(n) AS mean FROM l), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    bm AS (SELECT id, sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM p JOIN df USING (term) JOIN l USING (id), s GROUP BY id)"""


@query("r04_bm25", f"WITH {FILE}, {_WORDS} SELECT id, round(score, 6) AS score FROM bm")
def bm25(spark, d):
    return R.bm25_scan(file(spark, d), "id", "text", TERMS).select("id", F.round("score", 6).alias("score"))


@query("r04_bm25_index", f"WITH {FILE}, {_WORDS} SELECT id, round(score, 6) AS score FROM bm")
def bm25_index(spark, d):
    index = KeywordIndex.build(file(spark, d), scratch(spark, "keywords"))
    return index.scores(TERMS).select("id", F.round("score", 6).alias("score"))


#: Every query's words: the first six of its own text. Queries are the vectors whose id is divisible by 50.
_ASKED = """aq AS (SELECT id AS query, unnest(list_distinct(words[1:6])) AS term FROM w WHERE id % 50 = 0 AND id IN (SELECT vec_id FROM embeddings)),
    ap AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM w) GROUP BY ALL), ad AS (SELECT term, count(*) AS df FROM ap GROUP BY 1),
    ab AS (SELECT query, ap.id, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS score FROM aq JOIN ap USING (term) JOIN ad USING (term) JOIN l ON l.id = ap.id, s GROUP BY ALL),
    ak AS (SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS n FROM ab) WHERE n <= 30)"""


def _questions(spark, d):
    """query, terms of every query."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 0)
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"))
    return file(spark, d).where("id % 50 = 0").join(asked, "id", "left_semi").select(F.col("id").alias("query"), F.slice(words, 1, 6).alias("terms"))


def _by_keyword(spark, d, k):
    return KeywordIndex.build(file(spark, d), scratch(spark, "keywords")).search(_questions(spark, d), k)


@query("r04_search_all", f"WITH {FILE}, {_WORDS}, {_ASKED} SELECT query, id, round(score, 6) AS score FROM ak")
def search_all(spark, d):
    return _by_keyword(spark, d, 30).select("query", "id", F.round("score", 6).alias("score"))


@query("r05_rank_scale_all", f"WITH {FILE}, {_WORDS}, {_ASKED} SELECT query, id, round(CASE WHEN max(-score) OVER p = min(-score) OVER p THEN 1 ELSE 1 - (-score - min(-score) OVER p) / (max(-score) OVER p - min(-score) OVER p) END, 6) AS score FROM ak WINDOW p AS (PARTITION BY query)")
def rank_scale_all(spark, d):
    hits = _by_keyword(spark, d, 30).withColumn("rank", -F.col("score"))
    return R.rank_scale(hits, by=("query",)).select("query", "id", F.round("score", 6).alias("score"))


#: A later state of the files: a third is gone, a third of the rest has another end, a third is new.
_LATER = "file AS (SELECT id, path, mtime, CASE WHEN id % 3 = 1 AND id % 2 = 0 THEN text || ' erwh' ELSE text END AS text FROM file0 WHERE id % 3 <> 0)"


@query("s07_keyword_sync", f"WITH {FILE.replace('file AS', 'file0 AS')}, {_LATER}, {_WORDS} SELECT id, round(score, 6) AS score FROM bm")
def keyword_sync(spark, d):
    f = file(spark, d)
    old = f.where("id % 3 <> 2")
    new = f.where("id % 3 <> 0").withColumn("text", F.when(F.expr("id % 3 = 1 AND id % 2 = 0"), F.concat("text", F.lit(" erwh"))).otherwise(F.col("text")))
    new = new.withColumn("mtime", F.col("mtime") + 1)
    index = KeywordIndex.build(old, scratch(spark, "keywords"), owner="path")
    state = [x.select("path", "mtime", F.sha2("text", 256).alias("hash")) for x in (old, new)]
    index.sync(sync_plan(*state), new.select(F.col("path").alias("owner"), "id", "text"))
    return index.scores(TERMS).select("id", F.round("score", 6).alias("score"))


@query("r05_rank_scale", f"WITH {FILE}, {_WORDS}, r AS (SELECT id, -score AS rank FROM bm ORDER BY rank, id LIMIT 30) SELECT id, round(1 - (rank - (SELECT min(rank) FROM r)) / ((SELECT max(rank) FROM r) - (SELECT min(rank) FROM r)), 6) AS score FROM r")
def rank_scale(spark, d):
    hits = R.bm25_scan(file(spark, d), "id", "text", TERMS).select("id", (-F.col("score")).alias("rank")).orderBy("rank", "id").limit(30)
    return R.rank_scale(hits).select("id", F.round("score", 6).alias("score"))


_NEAR = "SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0"


#: Rows a search returns; each leg of a hybrid search brings three times as many.
LIMIT = 10
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS n FROM ({_NEAR})"


def _asked(spark, d, which="vec_id % 50 = 0"):
    v = table(spark, d, "embeddings")
    return v, v.where(which).select(F.col("vec_id").alias("query"), F.col("embedding").alias("query_embedding"))


def _near(spark, d, k, which="vec_id % 50 = 0"):
    return R.nearest(*_asked(spark, d, which), k, "vec_id")


@query("r06_vector_search", f"SELECT query, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS n FROM ({_NEAR})) WHERE n <= 10")
def vector_search(spark, d):
    return _near(spark, d, 10).select("query", "id", F.round("score", 6).alias("score"))


@query("r06_index_exact", f"SELECT query, id, round(score, 6) AS score FROM ({_RANKED}) WHERE n <= 10")
def index_exact(spark, d):
    v, q = _asked(spark, d)
    index = VectorIndex.build(v, scratch(spark, "vectors"), id_="vec_id")
    return index.search_exact(q, 10).select("query", "id", F.round("score", 6).alias("score"))


#: Queries on which the number of cells to probe is measured, and the share of true neighbours asked for.
TUNED_ON, RECALL = 200, 0.95


@query("r06_index_search")
def index_search(spark, d):
    v, q = _asked(spark, d)
    index = VectorIndex.build(v, scratch(spark, "vectors"), id_="vec_id")
    sample = q.orderBy(F.xxhash64("query", F.lit(1)), "query").limit(TUNED_ON)
    return index.search(q, 10, index.probes_for(sample, 10, RECALL))


@query("r07_brute_force", f"SELECT query, id, round(score, 6) AS score FROM ({_NEAR}) WHERE id <> query AND score > 0.3")
def brute_force(spark, d):
    return R.similarities(*_asked(spark, d), "vec_id", above=0.3, digits=6).where("id <> query").select("query", "id", "score")


@query("r08_overfetch", f"SELECT query, id FROM ({_RANKED}) WHERE n <= 30")
def overfetch(spark, d):
    return _near(spark, d, 3 * LIMIT).select("query", "id")


@query("r09_hybrid_merge", f"WITH {FILE}, {_WORDS}, {_ASKED}, v AS (SELECT query, id, score FROM ({_RANKED}) WHERE n <= 30) SELECT query, id, round(0.7 * coalesce(v.score, 0) + 0.3 * coalesce(ak.score, 0), 6) AS score, CASE WHEN coalesce(v.score, 0) >= coalesce(ak.score, 0) THEN 'vector' ELSE 'keyword' END AS source FROM v FULL JOIN ak USING (query, id)")
def hybrid_merge(spark, d):
    return R.merged_legs(_near(spark, d, 3 * LIMIT), _by_keyword(spark, d, 3 * LIMIT)).select("query", "id", F.round("score", 6).alias("score"), "source")


@query(
    "r10_decay",
    f"""WITH {FILE}, x AS (SELECT id, TRY_CAST(nullif(regexp_extract(path, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS DATE) AS day FROM file)
    SELECT id, round(0.8 * coalesce(exp(-ln(2) / 30 * greatest(0, date_diff('day', day, DATE '2025-12-01'))), 1), 6) AS score FROM x""",
)
def decay(spark, d):
    rows = file(spark, d).select("id", "path", F.lit(0.8).alias("score"))
    return R.decayed(rows, F.lit("2025-12-01").cast("timestamp")).select("id", F.round("score", 6).alias("score"))


@query("r11_mmr")
def mmr(spark, d):
    return _pipeline(spark, d, mmr=True)


def _pipeline(spark, d, **how):
    k = R.rank_scale(_by_keyword(spark, d, 3 * LIMIT).withColumn("rank", -F.col("score")), by=("query",)).select("query", "id", "score")
    texts = file(spark, d).select("id", "path", "text")
    return R.hybrid(_near(spark, d, 3 * LIMIT), k, texts, F.lit("2025-12-01").cast("timestamp"), LIMIT, **how).select("query", "id", "rank", F.round("score", 6).alias("score"))


#: Token sets of texts, as in `diversify`; an İ is two characters in lower case elsewhere.
_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(replace(text, 'İ', 'i ')), '[^a-z0-9_]+'), lambda t: length(t) > 1))"


@query(
    "r12_pipeline",
    f"""WITH RECURSIVE {FILE}, {_WORDS}, {_ASKED}, v AS (SELECT query, id, score FROM ({_RANKED}) WHERE n <= 30),
    k AS (SELECT query, id, CASE WHEN max(score) OVER p = min(score) OVER p THEN 1 ELSE 1 - (max(score) OVER p - score) / (max(score) OVER p - min(score) OVER p) END AS score FROM ak WINDOW p AS (PARTITION BY query)),
    m AS (SELECT query, id, 0.7 * coalesce(v.score, 0) + 0.3 * coalesce(k.score, 0) AS score FROM v FULL JOIN k USING (query, id)),
    x AS (SELECT id, TRY_CAST(nullif(regexp_extract(path, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS DATE) AS day FROM file),
    z AS (SELECT query, id, score * coalesce(exp(-ln(2) / 30 * greatest(0, date_diff('day', day, DATE '2025-12-01'))), 1) AS score FROM m JOIN x USING (id)),
    y AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS pos, score FROM z WHERE score >= 0.05),
    t AS (SELECT query, pos, {_TOKENS} AS t FROM y JOIN file USING (id)),
    i AS (SELECT a.query, a.pos, b.pos AS other, len(list_intersect(a.t, b.t)) AS n, len(a.t) + len(b.t) AS size FROM t a JOIN t b ON a.query = b.query AND a.pos <> b.pos),
    j AS (SELECT query, pos, other, CASE WHEN size = 0 THEN 0e0 ELSE CAST(n AS DOUBLE) / (size - n) END AS alike FROM i),
    g AS (SELECT query, pos, id, score, 0e0 AS near, 1 AS rank, pos = 1 AS picked FROM y
      UNION ALL SELECT query, pos, id, score, near, rank, row_number() OVER (PARTITION BY query ORDER BY 0.7e0 * score - (1 - 0.7e0) * near DESC, pos) = 1
      FROM (SELECT l.query, l.pos, l.id, l.score, greatest(l.near, alike) AS near, l.rank + 1 AS rank FROM g l JOIN g p ON p.query = l.query AND p.picked JOIN j ON j.query = l.query AND j.pos = l.pos AND j.other = p.pos WHERE NOT l.picked AND l.rank < 10))
    SELECT query, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM g WHERE picked""",
)
def pipeline(spark, d):
    return _pipeline(spark, d, mmr=True, min_score=0.05)


@query("r13_save_gate", f"SELECT query, id, CASE WHEN score >= 0.95 THEN 'skip' WHEN score >= 0.85 AND id % 2 = 0 THEN 'overwrite' ELSE 'new' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS n FROM ({_NEAR})) WHERE n <= 5")
def save_gate(spark, d):
    return R.save_gate(_near(spark, d, 5), F.col("id") % 2 == 0).select("query", "id", "action")


@query("r14_cache_prune", "SELECT event_id AS id FROM events ORDER BY ts DESC, event_id LIMIT 300")
def cache_prune(spark, d):
    from quillspark.operators.paging import keep_newest

    return keep_newest(table(spark, d, "events").select(F.col("event_id").alias("id"), "ts"), 300, "ts", "id").select("id")


@query("r15_reindex", "SELECT r_regionkey AS id, r_name || '!' AS name FROM region")
def reindex(spark, d):
    from quillspark.operators import writes

    root = scratch(spark, "reindex")
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    writes.swap_in(r, root, "names")
    writes.swap_in(r.withColumn("name", F.concat("name", F.lit("!"))), root, "names")
    return writes.current(spark, root, "names")


@query("r16_version_check", "SELECT r_regionkey AS version, r_regionkey <> 2 AS rebuild FROM region")
def version_check(spark, d):
    root = scratch(spark, "manifest")
    spark.sql("SELECT 'version' AS key, '2' AS value UNION ALL SELECT 'model', 'm'").write.parquet(root)
    manifest = spark.read.parquet(root)
    return spark.createDataFrame([(v, needs_rebuild(manifest, v)) for v in range(5)], "version long, rebuild boolean")


@query("r17_fuzzy_files")
def fuzzy_files(spark, d):
    return S.fuzzy_find(file(spark, d), "s1plain", 20)


_LICENSE = f"WITH {FILE}, l AS (SELECT path, mtime, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM file) SELECT path, CAST(line_no AS INTEGER) AS line_no FROM l WHERE regexp_matches(line, 'License') ORDER BY mtime DESC, path, line_no LIMIT 100"


@query("r18_regex_lines", _LICENSE)
def regex_lines(spark, d):
    return S.grep(file(spark, d).select("path", "mtime", "text"), "License").select("path", "line_no")


@query("r18_regex_index", _LICENSE)
def regex_index(spark, d):
    index = TrigramIndex.build(file(spark, d), scratch(spark, "trigrams"))
    return index.search("License").select("path", "line_no")


@query("r19_glob", f"WITH {FILE} SELECT path FROM file WHERE path LIKE 'notes/src1/%' ORDER BY path LIMIT 100")
def glob(spark, d):
    from quillspark.functions.text import wildcard

    return file(spark, d).where(F.col("path").rlike(wildcard("notes/src1/*"))).select("path").orderBy("path").limit(100)


@query("r20_tree", f"WITH {FILE}, x AS (SELECT DISTINCT unnest(['notes', 'notes/' || split_part(path, '/', 2)] || CASE WHEN contains(path, '.hidden') THEN ['notes/' || split_part(path, '/', 2) || '/.hidden'] ELSE [] END) AS dir FROM file), y AS (SELECT dir, len(string_split(dir, '/')) AS depth FROM x) SELECT dir, CAST(depth AS INTEGER) AS depth, greatest(0, (SELECT count(*) FROM y) - 20) AS truncated FROM y ORDER BY depth, dir LIMIT 20")
def tree(spark, d):
    return S.tree(file(spark, d), 20)


@query("r21_indented_tree")
def indented_tree(spark, d):
    return S.indented(file(spark, d), 30, ignore=(r"\.hidden",)).select("path", "kind", "line")


@query("s07_sync_counts", f"WITH {FILE} SELECT CASE WHEN id % 3 = 0 THEN 'delete' WHEN id % 3 = 1 THEN 'skip' ELSE 'index' END AS action, count(*) AS n FROM file GROUP BY 1")
def sync_counts(spark, d):
    f = file(spark, d).select("id", "path", "mtime", F.sha2("text", 256).alias("hash"))
    return sync_plan(f.where("id % 3 <> 2"), f.where("id % 3 <> 0")).groupBy("action").agg(F.count("*").alias("n"))
