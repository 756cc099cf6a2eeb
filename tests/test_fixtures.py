"""Cases of FIXTURES.md, and the Python-backed functions against their plain forms."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import calendar as C
from quillspark.functions import documents as D
from quillspark.functions import keywords as K
from quillspark.functions import money as M
from quillspark.functions import text as T
from quillspark.functions import vectors as V
from quillspark.operators import aggregates as A
from quillspark.operators import joins as J
from quillspark.operators import paging as P
from quillspark.operators import retrieval as R
from quillspark.operators import search as S
from quillspark.operators import windows as W
from quillspark.operators import writes as X
from quillspark.plans import plugins
from quillspark.sources import exchange
from quillspark.sources import files as SF
from quillspark.streaming import counters, eventlog

UTC = dt.timezone.utc


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


# --- paging, events, writes -------------------------------------------------

@pytest.mark.parametrize("times", [[1000 + i for i in range(6)], [1000.5 + i for i in range(6)]])
def test_keyset_pages(spark, times):
    ids = [f"msg{i}" for i in range(6)]
    df = spark.createDataFrame(list(zip(ids, map(float, times), strict=True)), "id string, time_created double")
    page, more, cursor = P.keyset_page(df, 2)
    assert [r.id for r in page.collect()] == ids[-2:] and more
    page, more, cursor = P.keyset_page(df, 2, cursor)
    assert [r.id for r in page.collect()] == ids[-4:-2] and more
    page, more, cursor = P.keyset_page(df, 2, cursor)
    assert [r.id for r in page.collect()] == ids[:2] and not more and cursor is None


def test_time_cursor_skips_ties(spark):
    df = spark.createDataFrame([("a", 5), ("b", 4), ("c", 4), ("d", 3)], "id string, time_updated long")
    assert [r.time_updated for r in P.updated_before(df, None, 2).collect()] == [5, 4]
    assert [r.id for r in P.updated_before(df, 4, 2).collect()] == ["d"]


def test_replay_outcomes(spark):
    log = spark.createDataFrame([("x", s, i, "t", i) for i, s in enumerate([0, 1, 1, 3])], "aggregate_id string, seq long, id long, type string, arrived long")
    heads = spark.createDataFrame([], "aggregate_id string, head long")
    rows = sorted(eventlog.replay(log, heads).collect(), key=lambda r: r.arrived)
    assert [r.outcome for r in rows] == ["apply", "apply", "ignore", "gap"] and rows[-1].expected == 2
    rows = eventlog.replay(log.limit(1), heads, known=["other"]).collect()
    assert [r.outcome for r in rows] == ["unknown"]


def test_replay_stream(spark, tmp_path):
    schema = "aggregate_id string, seq long, id string, type string, data string"
    src = tmp_path / "in"
    rows = [("x", 0, "a", "t", ""), ("x", 1, "b", "t", ""), ("y", 0, "c", "t", ""), ("x", 3, "d", "t", "")]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(src))
    stream = eventlog.replay_stream(spark.readStream.schema(schema).json(str(src)))
    q = stream.writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.id, r.outcome) for r in spark.table("replayed").collect()}
    assert got == {("a", "apply"), ("b", "apply"), ("c", "apply"), ("d", "gap")}


def test_stream_keeps_latest_by_key(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("part1", 1, "Hello"), ("part1", 2, "Hello Updated"), ("part2", 1, "x")], "key string, seq long, text string").coalesce(1).write.json(str(src))
    stream = spark.readStream.schema("key string, seq long, text string").json(str(src))
    eventlog.write_latest(stream, str(tmp_path / "out"), "key", "seq", str(tmp_path / "cp")).awaitTermination(120)
    got = {(r.key, r.text) for r in eventlog.StateLog(spark, str(tmp_path / "out"), stream.schema, "key", "seq").read().collect()}
    assert got == {("part1", "Hello Updated"), ("part2", "x")}


def test_week_counter_and_anchored_window(spark):
    sun, mon = dt.datetime(2026, 3, 1, 23, 59), dt.datetime(2026, 3, 2)
    df = spark.createDataFrame([("k", sun, 1), ("k", mon, 2)], "key string, t timestamp, cost long")
    assert sorted(r.used for r in counters.weekly(df, "key", "t", "cost").collect()) == [1, 2]
    df = spark.createDataFrame([("k", t, c) for t, c in ((0, 1), (1800, 2), (3600, 4), (3601, 5))], "key string, s long, cost long")
    rows = sorted(counters.anchored(df, "key", "s", "cost", 3600).collect(), key=lambda r: r.s)
    assert [r.used for r in rows] == [1, 3, 7, 5] and [r.anchor for r in rows] == [0, 0, 0, 3601]


def test_escalation_on_sixth(spark):
    df = spark.createDataFrame([("s", i, x == "D") for i, x in enumerate("DDADDD")], "s string, i long, denied boolean")
    rows = sorted(W.escalations(df, ["s"], "i", F.col("denied")).collect(), key=lambda r: r.i)
    assert [r.escalate for r in rows] == [False] * 5 + [True]


def test_doom_loop(spark):
    mk = lambda calls: spark.createDataFrame([("s", i, *c, False) for i, c in enumerate(calls)], "s string, i long, tool string, input string, pending boolean")
    flagged = lambda calls: any(r.loop for r in W.repeated_calls(mk(calls), ["s"], ["i"], ["tool", "input"]).collect())
    assert flagged([("g", "1")] * 3) and not flagged([("g", "1"), ("g", "2"), ("g", "1")])


def test_object_range(spark):
    keys = spark.createDataFrame([(f"user{i}",) for i in range(1, 6)], "key string")
    assert [r.key for r in SF.objects(keys, "user", after="user2", before="user4").collect()] == ["user3"]


def test_debounce_opens_at_first_item(spark):
    df = spark.createDataFrame([("s", "a", 0, 1), ("s", "a", 900, 2), ("s", "b", 950, 3), ("s", "a", 1000, 4)], "g string, k string, at long, v long")
    got = {(r.batch_start, r.k, r.v) for r in eventlog.debounced(df, "g", "k", "at").collect()}
    assert got == {(0, "a", 2), (0, "b", 3), (1000, "a", 4)}
    df = spark.createDataFrame([("s", "a", 5, 1), ("s", "a", 5, 2), ("t", "a", 5, 3), (None, "a", 7, 4), ("t", "a", None, 5)], "g string, k string, at long, v long")
    got = {(r.g, r.batch_start, r.v) for r in eventlog.debounced(df, "g", "k", "at", 1000, "v").collect()}
    assert got == {("s", 5, 2), ("t", 5, 3), (None, 7, 4)}
    assert eventlog.debounced(df.limit(0), "g", "k", "at").count() == 0


# --- calendar and money -----------------------------------------------------

@pytest.mark.parametrize("now, sub, start, end", [
    ("2026-03-20 10:00", "2026-01-15 08:00", "2026-03-15 08:00", "2026-04-15 08:00"),
    ("2026-03-10 10:00", "2026-01-15 08:00", "2026-02-15 08:00", "2026-03-15 08:00"),
    ("2026-03-01 10:00", "2026-01-31 12:00", "2026-02-28 12:00", "2026-03-31 12:00"),
    ("2026-03-15 08:00", "2026-01-15 08:00", "2026-03-15 08:00", "2026-04-15 08:00"),
    ("2026-02-15 06:00", "2025-12-30 06:00", "2026-01-30 06:00", "2026-02-28 06:00"),
])
def test_monthly_bounds(spark, now, sub, start, end):
    a, b = C.monthly_bounds(F.lit(now).cast("timestamp"), F.lit(sub).cast("timestamp"))
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    assert (one(spark, fmt(a)), one(spark, fmt(b))) == (start, end)


def test_limits(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    now, sub = ts("2026-03-20 10:00"), ts("2026-01-15 08:00")
    half = one(spark, M.monthly_status(F.lit(500_000_000), ts("2026-03-18 00:00"), now, sub, F.lit(10)))
    full = one(spark, M.monthly_status(F.lit(1_000_000_000), ts("2026-03-18 00:00"), now, sub, F.lit(10)))
    old = one(spark, M.monthly_status(F.lit(1_000_000_000), ts("2026-03-10 00:00"), now, sub, F.lit(10)))
    assert (half.status, half.percent) == ("ok", 50) and (full.status, full.percent) == ("rate-limited", 100) and (old.status, old.percent) == ("ok", 0)
    rolling = one(spark, M.rolling_status(F.lit(1), ts("2026-03-20 08:00"), now, F.lit(10), 5))
    assert (rolling.status, rolling.reset_sec) == ("ok", 3 * 3600)


def test_rounding_and_lengths(spark):
    assert (one(spark, T.half_up(F.lit(-2.5))), one(spark, T.half_up(F.lit(2.5)))) == (-2, 3)
    assert [one(spark, T.utf16_length(F.lit(s))) for s in ("a😀", "abc", "中😀😀")] == [3, 3, 5]
    assert one(spark, T.weighted_size(F.lit("a中😀"))) == 9
    assert [one(spark, T.duration(F.lit(x))) for x in (5, 1500, 61_000, 3_660_000)] == ["5ms", "1.5s", "1m 1s", "1h 1m"]
    assert one(spark, T.title_case(F.lit("hello big world"))) == "Hello Big World"
    assert one(spark, C.iso_yearweek(F.lit("2027-01-01").cast("timestamp"))) == 202653
    assert one(spark, C.path_date(F.lit("a/2026-02-30-x.md"))) is None


def test_median_and_context_share(spark):
    for xs, want in (([1, 2, 3, 10], 2.5), ([1, 2, 9], 2), ([], 0)):
        assert spark.createDataFrame([(x,) for x in xs], "x long").agg(A.median("x").alias("m")).first().m == want
    chars = spark.createDataFrame([("s", "system", 13, 20), ("s", "user", 11, 20), ("s", "assistant", 18, 20)], "k string, role string, size long, lim long")
    got = {r.role: r.tokens for r in A.context_share(chars, "k", "role", "size", "lim").collect()}
    assert got == {"system": 4, "user": 3, "assistant": 5, "other": 8}
    chars = spark.createDataFrame([("s", "system", 200, 10), ("s", "user", 400, 10), ("s", "assistant", 400, 10)], "k string, role string, size long, lim long")
    assert sum(r.tokens for r in A.context_share(chars, "k", "role", "size", "lim").collect()) <= 10


def test_reverts_cancel(spark):
    rows = [(i, t) for i, t in enumerate(['add a', 'add b', 'Revert "add a"', 'Revert "never"'])]
    df = spark.createDataFrame([("r", *x) for x in rows], "g string, i long, title string")
    assert sorted(r.title for r in A.without_reverts(df, "g", "i", "title").collect()) == ['Revert "never"', "add b"]
    titles = ["x", "y", "x", 'Revert "x"', None, 'Revert "Revert "x""', 'Revert "x"', 'Revert "x"']
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(titles)], "g string, i long, title string")
    assert sorted(r.i for r in A.without_reverts(df, "g", "i", "title").collect()) == [1, 4, 5, 7]


def test_prune_skips_newest_turns_and_stops(spark):
    def part(msg, pos, role, tokens, **k):
        base = {"is_summary": False, "is_compacted": False, "is_protected": False} | k
        return ("s", msg, pos, role, "tool", "completed", tokens, base["is_summary"], base["is_compacted"], base["is_protected"])

    rows = [part(0, 0, "assistant", 9000), part(1, 0, "assistant", 30_000), part(2, 0, "assistant", 30_000), part(3, 0, "assistant", 500, is_protected=True)]
    users = [("s", m, None, "user", None, None, None, False, False, False) for m in (4, 6)]
    rows += users + [part(5, 0, "assistant", 99_999)]
    df = spark.createDataFrame(rows, "session_id string, msg long, pos long, role string, part_type string, status string, tokens long, is_summary boolean, is_compacted boolean, is_protected boolean")
    assert sorted(r.msg for r in W.prunable(df).collect()) == [0, 1]


# --- retrieval --------------------------------------------------------------

def test_merge_decay_and_rank(spark):
    mk = lambda rows: spark.createDataFrame(rows, "id string, score double")
    got = {r.id: (round(r.score, 9), r.source) for r in J.merge_scores(mk([("a", .9), ("b", .5)]), mk([("b", 1.0), ("c", .4)])).collect()}
    assert got == {"a": (.63, "vector"), "b": (.65, "keyword"), "c": (.12, "keyword")}
    df = spark.createDataFrame([("2026-01-01-x.md", .8), ("plain.md", .8)], "path string, score double")
    assert sorted(round(r.score, 6) for r in R.decayed(df, F.lit("2026-01-31").cast("timestamp")).collect()) == [.4, .8]
    ranks = lambda xs: sorted(r.score for r in R.rank_scale(spark.createDataFrame([(float(x),) for x in xs], "rank double")).collect())
    assert ranks([-3, -2, -1]) == [0, .5, 1] and ranks([-7]) == [1]


def test_diversity():
    df = pd.DataFrame({"id": list("abc"), "score": [.9, .8, .6], "text": ["x1 y1", "x1 y1", "p1 q1"]})
    assert R.diversify(df, 2)["id"].tolist() == ["a", "c"]


def test_chunks_overlap_and_split():
    text = "\n".join(f"line {i} " + "x" * 40 for i in range(60))
    got = R.chunk_text(text, tokens=50, overlap=15)
    assert got[0][0] == 1 and got[-1][1] == 60
    assert all(R.weight(c[2]) + 1 <= 200 + 60 for c in got)
    assert all(b[0] <= a[1] for a, b in zip(got, got[1:], strict=False))
    assert [c[2] for c in R.chunk_text("", 50)] == [""]
    wide = R.chunk_text("中" * 500, tokens=50, overlap=0)
    assert "".join(c[2].replace("\n", "") for c in wide) == "中" * 500
    assert "".join(c[2].replace("\n", "") for c in R.chunk_text("😀" * 333, tokens=50, overlap=0)) == "😀" * 333


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, V.cosine(a(1, 0), a(1, 0))) == 1 and one(spark, V.cosine(a(0, 0), a(1, 0))) == 0
    assert one(spark, V.closeness(V.l2(a(0, 0), a(3, 4)))) == pytest.approx(1 / 6)
    assert one(spark, V.jaccard(V.token_set(F.lit("")), V.token_set(F.lit("")))) == 0


def test_keywords():
    got = K.extract("that thing we discussed about the API")
    assert "discussed" in got and "api" in got and not set(got) & {"that", "the", "we", "thing"}
    assert K.extract("讨论方案") == ["讨", "论", "方", "案", "讨论", "论方", "方案"]
    assert K.expand("fix the bug") == "fix the bug OR fix OR bug"
    assert K.extract("之前讨论的那个方案") == ["之", "讨", "论", "个", "方", "案", "前讨", "讨论", "论的", "的那", "个方", "方案"]
    assert K.extract("qué hicimos ayer con el despliegue") == ["hicimos", "despliegue"]
    assert K.extract("como foi ontem a implantação") == ["implantação"] and K.extract("ماذا عن الخادم") == ["الخادم"]
    assert K.extract("그리고 서버를 배포") == ["서버를", "서버", "배포"] and K.extract("this는") == ["this는"]
    assert K.extract("昨日のエラー") == ["エラー"]


def test_keyword_columns_agree_with_python(spark):
    qs = ["what was the solution for the bug", "讨论 the API 2024", "", "ab abc 123 x_y"]
    rows = K.with_keywords(spark.createDataFrame([(q,) for q in qs], "query string")).collect()
    assert all(r.keywords == K.extract(r.query) for r in rows)


# --- documents --------------------------------------------------------------

def test_html():
    html = "<h1>T</h1><script>x()</script><p>a <b>b</b></p><style>s</style>tail<iframe>no<p>yes</p></iframe>"
    assert "x()" not in D.html_to_text(html) and "yes" in D.html_to_text(html)
    md = D.html_to_markdown("<h2>Head</h2><p>one <em>two</em> <a href='u'>l</a></p><ul><li>x</li><li>y</li></ul><hr><pre>k\n z</pre>")
    assert "## Head" in md and "*two*" in md and "[l](u)" in md and "-   x" in md and "---" in md and "```\nk\n z\n```" in md


@pytest.mark.parametrize("content, old, new, want", [
    ("a\nb\nc", "b", "X", "a\nX\nc"),
    ("  a\n    b\n", "a\nb", "X", "X\n"),
    ("f {\n  one\n  two\n}\n", "f {\n  uno\n  two\n}", "X", "X\n"),
    ("say   hello  world", "say hello world", "X", "X"),
    ("    if x:\n        y", "if x:\n    y", "Z", "Z"),
    ("a\tb", "a\\tb", "X", "X"),
    ("keep this", "  keep this  ", "X", "X"),
])
def test_fuzzy_replace(content, old, new, want):
    assert D.fuzzy_replace(content, old, new) == want


def test_fuzzy_replace_errors():
    for args, why in ((("a a", "a", "b"), "ambiguous"), (("a", "zzz", "b"), "not found"), (("a", "a", "a"), "identical")):
        with pytest.raises(ValueError, match=why):
            D.fuzzy_replace(*args)
    assert D.fuzzy_replace("a a", "a", "b", True) == "b b"


def test_seek():
    lines = ["x", "a ", "  b", "\u201cc\u201d\u2014d"]
    assert D.seek(lines, ["a"]) == 1 and D.seek(lines, ["b"]) == 2 and D.seek(lines, ['"c"-d']) == 3 and D.seek(lines, ["q"]) == -1 and D.seek(lines, []) == -1
    assert D.seek(["k", "z", "k"], ["k"], at_end=True) == 2


def test_sections():
    text = "# top\n## Rules\na\n### Sub\nb\n```\n## not\n```\n## Next\nc"
    assert D.sections(text, ["rules", "none"]) == ["## Rules\na\n### Sub\nb\n```\n## not\n```"]


# --- sources, exchange, plugins ---------------------------------------------

def test_json_tree_takes_ids_from_paths_and_survives_bad_files(spark, tmp_path):
    d = tmp_path / "message" / "ses_1"
    d.mkdir(parents=True)
    (d / "msg_1.json").write_text(json.dumps({"id": "wrong", "role": "user"}))
    (d / "msg_2.json").write_text("{broken")
    rows, bad = SF.json_tree(spark, str(tmp_path / "message"), "role string", ["id", "session_id"])
    assert [(r.id, r.session_id, r.role) for r in rows.collect()] == [("msg_1", "ses_1", "user")]
    assert bad.count() == 1


def test_markdown_jsonl_and_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("hello")
    (tmp_path / "b.txt").write_text("no")
    assert [r.text for r in SF.markdown_files(spark, str(tmp_path)).collect()] == ["hello"]
    assert SF.file_listing(spark, str(tmp_path)).count() == 2
    (tmp_path / "log.jsonl").write_text('{"path":"a","freq":1,"last":1}\nbad\n{"path":"a","freq":2,"last":5}\n{"path":"b","freq":1,"last":2}\n')
    got = SF.jsonl_latest(spark, str(tmp_path / "log.jsonl"), "path string, freq long, last long", "path", "last", 10).collect()
    assert [(r.path, r.freq) for r in got] == [("a", 2), ("b", 1)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("m1", dt.datetime(2026, 1, 2, 3), 'a "q", b')], "model string, time timestamp, text string")
    exchange.write_csv(df.select("text"), str(tmp_path / "csv"))
    assert '"a ""q"", b"' in "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    exchange.write_by_hour(df, str(tmp_path / "json"))
    assert list((tmp_path / "json/model=m1/year=2026/month=1/day=2/hour=3").glob("part-*"))


def test_only_queries_are_allowed(spark):
    assert SF.read_only_sql(spark, "SELECT 1 AS x").count() == 1
    for bad in ("DROP TABLE x", "SELECT 1; DROP TABLE x", "INSERT INTO x VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a"):
        with pytest.raises(PermissionError):
            SF.read_only_sql(spark, bad)


def test_export_keeps_sessions_without_messages(spark):
    s = spark.createDataFrame([("s1", "t"), ("s2", "u")], "id string, title string")
    m = spark.createDataFrame([("m2", "s1", 2), ("m1", "s1", 1)], "id string, session_id string, n long")
    p = spark.createDataFrame([("p1", "m1", "x")], "id string, message_id string, text string")
    got = {r.session_id: json.loads(r.body) for r in exchange.export_sessions(s, m, p).collect()}
    assert got["s2"]["messages"] == [] and [len(x["parts"]) for x in got["s1"]["messages"]] == [1, 0]


def test_versions_swap(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "x long")
    X.swap_in(df, str(tmp_path), "t")
    X.swap_in(df.withColumn("x", F.lit(2)), str(tmp_path), "t")
    with pytest.raises(LookupError):
        X.current(spark, str(tmp_path), "other")
    assert X.current(spark, str(tmp_path), "t").count() == 1


def test_plugins_are_discovered(spark, tmp_path):
    (tmp_path / "tools").mkdir()
    (tmp_path / "tools" / "text.py").write_text("from quillspark.plans.plugins import tool\n\n@tool('string', 'string')\ndef twice(s):\n    return s + s\n")
    assert plugins.discover(spark, str(tmp_path)) == ["text_twice"]
    assert spark.sql("SELECT text_twice('ab') AS x").first().x == "abab"


def test_wildcards(spark):
    df = spark.createDataFrame([(s,) for s in ("ls", "ls -la", "lsx", "a.b", "axb", "a\nb")], "s string")
    hit = lambda p: {r.s for r in df.where(F.col("s").rlike(T.wildcard(p))).collect()}
    both = lambda p: {r.s for r in df.withColumn("rx", T.wildcard_column(F.lit(p))).where("s rlike rx").collect()}
    for p, want in (("ls *", {"ls", "ls -la"}), ("a.b", {"a.b"}), ("a?b", {"a.b", "axb", "a\nb"}), ("*", {"ls", "ls -la", "lsx", "a.b", "axb", "a\nb"})):
        assert hit(p) == want == both(p)


@pytest.mark.parametrize("pattern, hits", [
    ("git", {"git", "git push", "git push origin main"}), ("git push", {"git push", "git push origin main"}), ("git * main", {"git push origin main"}),
    ("g?t origin", {"git push origin main"}), ("git main push", set()), ("git *", {"git", "git push", "git push origin main"}), ("rm -*", {"rm x -rf"}),
])
def test_structured_patterns(spark, pattern, hits):
    df = spark.createDataFrame([(s,) for s in ("git", "git push", "git push origin main", "rm x -rf", "digit push")], "s string")
    joined = F.array_join(F.split("s", " "), T.TOKEN_END)
    assert {r.s for r in df.where(joined.rlike(T.structured(pattern))).collect()} == hits


def test_json_predicate_is_three_valued(spark):
    df = spark.createDataFrame([(1, None), (2, "{}"), (3, '{"plan":"sub"}'), (4, '{"plan":"byok"}')], "id long, e string")
    keep = df.where(F.col("e").isNull() | (F.get_json_object("e", "$.plan") != "sub"))
    assert [r.id for r in keep.orderBy("id").collect()] == [1, 4]


def test_fuzzy_files(spark):
    df = spark.createDataFrame([("src/main.py",), ("src/other.py",), ("docs/m_a_i_n.md",)], "path string")
    assert [r.path for r in S.fuzzy_find(df, "main", 5).collect()] == ["src/main.py", "docs/m_a_i_n.md"]
