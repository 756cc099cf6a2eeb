"""Regex search by trigrams: the same lines as a scan, from fewer files."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import trigram_index as T
from quillspark.operators.search import grep
from quillspark.plans import views

SF = "/root/testdata/sf0.001"
PATTERNS = ["License", "Lic(ense|ence)", r"\bthe [a-z]+ing\b", "(?i)license", "a.b", "x*License+ v?", "(License|Copyright) .*20", "é[aeiou]ou", r"\d{3}-\d{4}", "nosuchword", "", "ab|", "(?:foo)?the", r"\p{L}+zz"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    files = views.file(spark, SF).select("path", "mtime", "text").unionByName(spark.createDataFrame([("null.md", 5, None), ("short.md", 6, "ab"), ("twice.md", 7, "License\nLicense")], "path string, mtime long, text string"))
    T.BLOCK = 50
    return files, T.TrigramIndex.build(files, str(tmp_path_factory.mktemp("tri") / "x"))


def test_same_lines_as_a_scan(index):
    files, ix = index
    for p in PATTERNS:
        want = [tuple(r) for r in grep(files, p, 100).select("path", "line_no").collect()]
        assert [tuple(r) for r in ix.search(p, 100).select("path", "line_no").collect()] == want, p


def test_few_files_are_read(index):
    files, ix = index
    n = files.count()
    assert ix.candidates("nosuchword").count() == 0
    hit = files.where(F.col("text").rlike("License")).count()
    assert hit <= ix.candidates("License").count() < n / 2 and ix.candidates("(?i)license").count() == n


def test_neither_texts_nor_trigrams_are_shuffled(spark, index, monkeypatch):
    files, ix = index
    stored = spark.read.parquet(f"{ix.path}/postings")
    assert dict(stored.dtypes)["nos"] == "array<int>" and "paths" not in stored.columns
    monkeypatch.setattr(T, "SENT", 0)  # too many candidates: all files of their blocks
    found = ix.search("License", 100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert [tuple(r) for r in found.select("path", "line_no").collect()] == [tuple(r) for r in grep(files, "License", 100).select("path", "line_no").collect()]
    grams = {r.gram: r.n for r in stored.groupBy("gram").agg(F.sum(F.size("nos")).alias("n")).collect()}
    texts = [r.text or "" for r in files.collect()]
    assert grams == {g: sum(g in t for t in texts) for g in {t[i:i + 3] for t in texts for i in range(len(t) - 2)}}


@pytest.mark.parametrize("pattern, held", [("abc", "abc"), ("abcd", ("and", ("abc", "bcd"))), ("ab", None), ("(abc|xyz)", ("or", ("abc", "xyz"))), ("(abc|x)", None), ("abc?de", None), ("(abc)+x?", "abc"), ("abc.*def", ("and", ("abc", "def"))), ("(?i)abc", None), ("[", None), ("(?i:abc)d", None), ("(?!abc)xyz", "xyz")])
def test_requirements(pattern, held):
    assert T.required(pattern) == held


def test_a_match_always_fulfils_what_is_required():
    texts = ["abcde", "xyz abc", "aabbcc", "foo bar baz", "the license", "ab\ncd"]
    for p in ["a(b|c)*cde?", "(foo|bar) ba[rz]", "(abc|bcd)+", "x?yz abc", "l(i|o)cense", "(?:the )?license$", "^foo.*baz", "(a|b){3,}", "a{2}b{2}c{2}"]:
        need = T.required(p)

        def ok(need, t):
            return True if need is None else need in t if isinstance(need, str) else (all if need[0] == "and" else any)(ok(x, t) for x in need[1])

        assert all(ok(need, t) for t in texts if re.search(p, t)), p
