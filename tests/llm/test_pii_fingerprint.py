import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from quillspark.llm import fingerprint, pii

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 12 <= len(d) <= 19 and luhn(d),
        "phone": lambda: 9 <= len(d) <= 15,
    }[kind]()


def brute(text):
    out = []
    for k, (kind, p) in enumerate(BASE):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, text or "") if good(kind, m.group())]
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(out))


TEXTS = [
    None, "", "a@b.c_d@e.f and x@y", "mail 😀 me: joe.doe+x@mail-1.example.com, 10.0.0.255 or 10.0.0.256",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (212) 555-0199 +1 2", "1.2.3.4.5.6.7.8.9", "007.1.2.3 0000255.1.1.1",
    "DE89 3704 0044 0532 0130 00 iban DE89370400440532013000", "ssn 123-45-6789 then 123-45-67890", "a" * 20000 + "@b.co",
    "x@a." + "b." * 6000 + "c", "9" * 3000 + " " + "1" * 19, "+" * 50 + "49 30 1234567", "éa@b.cö 1.1.1.1é",
]


def test_base_spans_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    rows = {r.doc_id: r for r in pii.find_pii(docs, "text", "doc_id").collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        base = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in rows[i].spans if s.at < 4)
        assert base == brute(t), (i, (t or "")[:60])
    assert any(s.kind == "iban" for s in rows[8].spans) and [s.kind for s in rows[9].spans] == ["ssn"]


def test_pii_query_matches_brute_force_on_documents(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in pii.op7_pii(spark, d).collect()}
    for doc_id, text in duckdb.sql(f"select doc_id, text from '{d}/documents.parquet'").fetchall():
        want = brute(text)
        assert rows[doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_fingerprints_fold_unicode_case_and_blanks(spark):
    texts = ["Ａ  b c", "a B c", " a b\n\tC ", "Straße", "STRASSE", "é", "É", None, "", "other"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    f = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs, "text", "doc_id").collect()}
    assert f[0] == f[1] == f[2] and f[3] == f[4] and f[5] == f[6] and f[7] == f[8]
    assert len({f[0], f[3], f[5], f[7], f[9]}) == 5
    c = {r.doc_id: r.class_id for r in fingerprint.exact_classes(docs).collect()}
    assert [c[i] for i in range(10)] == [0, 0, 0, 3, 3, 5, 5, 7, 7, 9]


def test_edited_texts_match_brute_force(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    src = duckdb.sql(f"select doc_id, coalesce(text,'') from '{d}/documents.parquet' order by 1").fetchall()
    rows = {r.doc_id: r for r in fingerprint.op6_document_fingerprints(spark, d).collect()}
    assert len(rows) == len(src)
    for (i, t), (_, nxt) in zip(src, src[1:] + src[:1]):
        k = len(t) // 4
        assert rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest(), i
        assert rows[i].n_chars == len(t)
        same = " ".join(unicodedata.normalize("NFKC", t).casefold().split()) == " ".join(unicodedata.normalize("NFKC", nxt).casefold().split())
        assert rows[i].near_next == float(same)
    own = {i: form(t) for i, t in src}
    least = {}
    for i, _ in src:
        least.setdefault(own[i], i)
    assert all(rows[i].class_id == least[own[i]] for i in own)
    by_print = {}
    for i, t in own.items():
        assert by_print.setdefault(rows[i].fingerprint, t) == t
    for (i, t), (_, nxt) in zip(src, src[1:] + src[:1]):
        k = len(t) // 4
        edited = form(t[: len(t) - k] + nxt[:k])
        assert rows[i].near_edited == float(own[i] == edited)
        assert by_print.setdefault(rows[i].edited_fingerprint, edited) == edited


def form(text):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def test_equal_digests_of_unlike_bytes_are_two_classes(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "ONE "), (3, "two"), (4, "three"), (4, "two"), (None, "One")], "doc_id long, text string")
    got = fingerprint.exact_classes(docs, digester=lambda canon: F.lit("same")).collect()
    assert sorted((r.doc_id or 0, r.class_id) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 3), (4, 3), (4, 4)]


def test_hot_groups_go_by_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr("quillspark.llm.common.HOT_ROWS", 20)
    docs = spark.createDataFrame([(i, "copy" if i % 2 else f"own {i}") for i in range(100)], "doc_id long, text string")
    c = {r.doc_id: r.class_id for r in fingerprint.exact_classes(docs).collect()}
    assert c == {i: 1 if i % 2 else i for i in range(100)}


def test_fingerprint_query_takes_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x"), (3, "x"), (3, "y"), (5, "long " * 60_000), (None, None)]
    odd = spark.createDataFrame([(i, t, "clash", "c", 1.0) for i, t in rows], "doc_id long, text string, fingerprint string, check string, near_next double")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint.op6_document_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r.class_id for r in got if r.n_chars == 0} == {1}
    assert {r.class_id for r in got if r.doc_id == 3} == {3}


def test_many_spans_in_one_text(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, " ".join(f"a{i}@b.example" for i in range(n)))], "doc_id long, text string")
    spans = pii.find_pii(docs, "text", "doc_id").first().spans
    want = [(m.start(), m.end()) for m in re.finditer(r"a[0-9]+@b\.example", docs.first().text)]
    assert [(s.start, s.end) for s in spans] == want and len(want) == n


def test_running_sums(spark):
    df = spark.createDataFrame([(i, list(range(1, i + 1))) for i in range(40)], "i int, xs array<int>")
    for r in df.select("i", pii.running_sums(F.col("xs")).alias("sums")).collect():
        assert r.sums == [k * (k + 1) // 2 for k in range(1, r.i + 1)]


def test_one_row_and_empty_tables(spark):
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert [tuple(r) for r in fingerprint.with_next(one).collect()] == [(5, "abcd", "abcd")]
    assert fingerprint.with_next(one.limit(0)).count() == 0
    assert pii.find_pii(one.limit(0), "text", "doc_id").count() == 0
