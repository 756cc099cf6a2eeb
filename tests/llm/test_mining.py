"""Phrases, periodic runs and packing against brute force, and their edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import collocations as C
from quillspark.llm import packing as P
from quillspark.llm import periodic as R
from tests.oracle import differences, duck

SMALL = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "a b c a b c a b c a b c a"), (None, "lost words here"), (5, "word " * 20_000), (6, "ünï çödé 😀 text\x00x"), (7, "a b c"), (8, " \t\n\v\f\r "),
       (9, "x" * 50_000), (10, "A. b; C! a\tb c?\x0bd"), (11, "<|endoftext|> <|ENDOFTEXT|> don't İ ΑΣ")]


def odd_docs(spark):
    return spark.createDataFrame([(i, t, "clash", "x", 1, None if i == 4 else "en") for i, t in ODD], "doc_id long, text string, cell string, place string, n long, lang string")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- phrases ------------------------------------------------------------------

def brute_phrases(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang, low = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = {}
    for lang, held in f.items():
        good = {p: a for p, a in held.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in good.items():
            cuts = [(1000 * a * n[lang] // (held[p[:k]] * held[p[k:]]), k, held[p[:k]], held[p[k:]]) for k in range(1, len(p))]
            if any(100 * b >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in good.items() if len(q) > len(p)):
                continue
            score, _, left, right = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), " ".join(p), a, left, right, n[lang], score))
        for rank, r in enumerate(sorted(rows)[:top], 1):
            out[lang, rank] = r[3:]
    return out


@pytest.mark.parametrize("bits", [8, 24])
def test_phrases_by_counting_all(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "BITS", bits)  # 256 cells: everything collides, and nothing changes
    monkeypatch.setattr(C, "FAN", 2)
    rng = np.random.default_rng(1)
    texts = [(None if i % 9 == 0 else "ab"[i % 2], " ".join(rng.choice(["x", "Y", "z,", "w", "über", "q."], 30))) for i in range(80)]
    rows = [(i, t, g) for i, (g, t) in enumerate(texts + [texts[0]] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    monkeypatch.setattr(C, "HELD_ROWS", 40 if bits == 8 else 1_500_000)  # sums that outgrow a task go on in parts
    assert all(r.f >= 5 or r.words == 0 for r in C.phrase_counts(df, 5, bits).collect())
    monkeypatch.setattr(C.phrase_counts, "__defaults__", (C.LEAST, bits))
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in C.collocations(df, least=5, top=60).collect()}
    assert got == brute_phrases([(g, t) for _, t, g in rows], 5, 60)


def test_phrases_of_odd_texts(spark):
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in C.collocations(odd_docs(spark), least=2).collect()}
    assert got == brute_phrases([(None if i == 4 else "en", t) for i, t in ODD], 2, 2000)
    assert not C.collocations(odd_docs(spark).limit(0)).collect()


def test_phrase_query_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    assert differences(spark, "op11", C.op11_collocations, C.OP11_SQL, d, duck(d)) is None


def test_scores_are_exact_beyond_64_bits(spark, monkeypatch):
    rows = [("en", 0, "", 9_000_000_000_000), ("en", 2, "a b", 3_000_000_000_001), ("en", 1, "a", 3_000_000_000_007), ("en", 1, "b", 3_000_000_000_011)]
    monkeypatch.setattr(C, "phrase_counts", lambda *_: spark.createDataFrame(rows, "lang string, words int, phrase string, f long"))
    r = C.collocations(odd_docs(spark)).first()
    assert r.score == 1000 * rows[1][3] * rows[0][3] // (rows[2][3] * rows[3][3])


def test_sketch_widens_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(C, "BITS", 8)
    rng = np.random.default_rng(3)
    rows = [(" ".join(f"w{x}" for x in rng.integers(0, 3000, 400)), "en") for _ in range(40)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    monkeypatch.setattr(C, "HELD_HASHES", 5000)  # a task sends its sketch in parts
    share = lambda bits: np.unpackbits(C.frequent_bits(df, bits, 10)).mean()
    assert share(8) == 1 and share(C.width_for(df, 10)) < 0.2  # at its least width it screens nothing
    everything = C.phrase_counts(df, 10, 8).collect()
    assert sorted(map(tuple, C.phrase_counts(df, 10).collect())) == sorted(map(tuple, everything))


def test_counts_are_sent_in_few_bytes():
    rng = np.random.default_rng(4)
    texts = pa.array([" ".join(f"word{x}" for x in rng.integers(0, 800, 500) ** 2 // 800) for _ in range(400)])
    langs = ["en", "a b", "", "en"] * 100
    bits = np.full((C.ROWS, 1 << 5), 255, np.uint8)  # lets everything through
    whole = C.slice_counts(texts, langs, bits, 8)
    sent = [x.as_buffer() for x in C._packed(whole).column("counts")]
    assert len(sent) == C.BUCKETS and sum(x.size for x in sent) < 8 * whole.size  # phrases in full took 21
    parts = [C.slice_counts(texts.slice(i, 100), langs[i:i + 100], bits, 8) for i in range(0, 400, 100)]
    again = C.added([C._unpacked(x.as_buffer()) for p in parts for x in C._packed(p).column("counts")])
    listed = lambda t: sorted(tuple(r.values()) for b in C._listed(t, 1) for r in b.to_pylist())
    want = Counter()
    for lang, text in zip(langs, texts.to_pylist(), strict=True):
        w = text.split()
        want.update((lang, k, " ".join(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
        want[lang, 0, ""] += len(w)
    assert listed(whole) == listed(again) == sorted((*p, f) for p, f in want.items())


# --- periodic runs --------------------------------------------------------------

def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_by_comparing_all():
    rng = random.Random(5)
    for _ in range(3000):
        k = rng.choice([1, 2, 2, 3, 4])
        w = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            x = [rng.randrange(k) for _ in range(rng.randint(1, 6))]
            a, y = rng.randint(0, len(w)), (x * 10)[:rng.randint(4, 40)]
            w[a:a + len(y)] = y
        w += w[:rng.randint(0, len(w))] if rng.random() < 0.3 else []
        codes, at = np.array(w, np.int32), np.array([0, len(w)])
        assert R.runs_of(w) == brute_runs(w) == R.batch_runs(codes, at).get(0, []) == R.batch_runs(codes, at, False).get(0, []), w


def test_factors_are_the_longest_earlier_stretches():
    rng = random.Random(3)
    for _ in range(300):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        at = 0
        for begin, length, source in R.factors(w):
            assert begin == at
            longest = max((next((k for k in range(len(w) - begin) if w[s + k] != w[begin + k]), len(w) - begin) for s in range(begin)), default=0)
            assert length == max(1, longest) and (source < 0) == (longest == 0)
            if source >= 0:
                assert source < begin and w[source:source + length] == w[begin:begin + length]
            at += length
        assert at == len(w)


def brute_op12(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(w)
    drop = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (-((r[1] - r[0]) / r[2]), r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *((best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4),
            digest("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_run_query_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SMALL).collect() if len(r.text or "") < 6000]
    ids = {i for i, _ in rows}
    got = {r.doc_id: tuple(r) for r in R.op12_periodic_runs(spark, SMALL).collect()}
    assert len(got) == documents(spark, SMALL).count()
    assert {i: got[i] for i in ids} == {i: brute_op12(i, t) for i, t in rows}
    assert sum(r[1] > 0 for r in got.values()) > len(got) // 20


def test_runs_of_odd_texts(spark):
    got = sorted((tuple(r)[:6] for r in R.periodic_runs(odd_docs(spark)).collect()), key=repr)
    want = []
    for i, t in ODD:
        runs = [(0, 20_000, 1)] if i == 5 else brute_runs((t or "").split())
        s = runs and (runs[0][0], runs[0][1] - runs[0][0], runs[0][2])
        want.append((i, len(runs), *(s or (None,) * 3), 1000 * s[1] // s[2] if s else None))
    assert got == sorted(want, key=repr)
    by_id = {r.doc_id: r.collapsed for r in R.periodic_runs(odd_docs(spark)).collect()}
    assert by_id[5] == "word" and by_id[4] == "a b c" and by_id[1] == by_id[8] == "" and by_id[6] == "ünï çödé 😀 text\x00x"
    assert not R.periodic_runs(odd_docs(spark).limit(0)).collect()


# --- packing ----------------------------------------------------------------------

def test_hilbert_curve_visits_every_cell_step_by_step():
    cube = np.array(list(itertools.product(range(8), repeat=3)))
    order = cube[np.argsort(P.hilbert(cube, 3))]
    assert sorted(P.hilbert(cube, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def whole_ids(text):
    return P.tokenizer(P.TOKENIZER).encode(text or "", add_special_tokens=False).ids + [1]


def test_words_give_the_ids_of_whole_texts(spark):
    texts = [t or "" for _, t in ODD] + [r.text or "" for r in documents(spark, SMALL).collect()]
    ids, at = P.encode(pa.array(texts), P.TOKENIZER)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [whole_ids(t) for t in texts]


def check_pieces(rows, want, size):
    """Every id lies in one piece; sequences are gapless and full, or a power of two."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        docs[r.doc_id, r.doc_tokens].append((r.start, ids))
        seqs[r.sequence_id].append((r.offset, r.length))
    got = []
    for (i, n), pieces in docs.items():
        flat = [x for _, ids in sorted(pieces, key=lambda p: p[0]) for x in ids]
        assert len(flat) % n == 0
        got += [(i, flat[:n])] * (len(flat) // n) if len(flat) > n and [(p[0]) for p in pieces].count(0) == len(flat) // n else [(i, flat)]
    key = lambda x: (str(x[0]), len(x[1]))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sorted(seqs) == list(range(len(seqs)))
    short = []
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == size or at & (at - 1) == 0 and at < size
        short += [at] if at < size else []
    assert len(set(short)) == len(short)


@pytest.mark.parametrize("size", [64, 100, 2048])
def test_pieces_of_odd_texts(spark, size):
    pieces = P.pack(odd_docs(spark).repartition(3), size)
    check_pieces(pieces.collect(), [(i, whole_ids(t)) for i, t in ODD], size)
    whole = P.sequences(pieces).collect()
    assert sum(len(r.ids) // 4 for r in whole) == sum(len(whole_ids(t)) for _, t in ODD)
    assert not P.pack(odd_docs(spark).limit(0)).collect()


def test_pack_query(spark, monkeypatch):
    from quillspark.llm import common
    monkeypatch.setattr(common, "ROWS_PER_CELL", 10)  # many cells
    docs = documents(spark, SMALL)
    copies = docs.unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.explode(F.sequence(F.lit(10_001), F.lit(10_100)))))
    pieces = P.pack(copies).collect()
    check_pieces(pieces, [(r.doc_id, whole_ids(r.text)) for r in copies.select("doc_id", "text").collect()], P.SIZE)
    got = P.op13_hilbert_packing(spark, SMALL).collect()
    for r in got:
        assert 0 <= r.ids_crc32 < 1 << 32
    text = {r.doc_id: r.text for r in docs.collect()}
    r = max(got, key=lambda r: r.start)
    assert r.ids_crc32 == zlib.crc32(np.array(whole_ids(text[r.doc_id])[r.start:r.start + r.length], "<u4").tobytes())


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents that follow each other share a language far more often than in a random order."""
    docs = documents(spark, "/root/testdata/sf0.01")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = sorted(P.pack(docs).where("start = 0").collect(), key=lambda r: (r.sequence_id, r.offset))
    same = np.mean([lang[a.doc_id] == lang[b.doc_id] for a, b in itertools.pairwise(rows)])
    share = Counter(lang.values())
    assert same > 0.15 + sum((n / len(lang)) ** 2 for n in share.values())
