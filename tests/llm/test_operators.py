"""Brute-force, round-trip and held-out tests of the corpus operators, and their edge cases."""

import hashlib
import itertools
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat, components, decontaminate, kdtree, langid, mixing, nbsvm, simhash, toxicity
from quillspark.llm.common import materialize, table

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "a b c"), (None, "lost words here"), (5, "word " * 30_000), (6, "ünï çödé 😀 text"), (7, "a b c"), (8, " \t\n ")]


def odd_docs(spark):
    rows = [(i, t, "clash", "x", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string, score int")


# --- components -------------------------------------------------------------

def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)], [(5, 3), (3, 9), (7, 8), (8, 8), (9, 1)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components.connected_components(df).collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]])


# --- simhash ----------------------------------------------------------------

def brute_links(fps, tau):
    return {(min(a, b), max(a, b)) for a, b in itertools.combinations([int(x) for x in fps], 2) if (a ^ b).bit_count() <= tau}


@pytest.mark.parametrize("tau", [4, 9])
def test_general_pigeonhole_misses_no_pair(spark, tau):
    rng = np.random.default_rng(tau)
    fps = set(rng.integers(0, 2**63, 120).tolist())
    for x in list(fps)[:40]:
        for _ in range(3):
            y = x
            for b in rng.choice(63, rng.integers(1, tau + 2), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in simhash.near_pairs(df, tau).collect()}
    assert got == brute_links(fps, tau)


def test_dense_runs_keep_components():
    rng = np.random.default_rng(1)
    base = np.uint64(0x0123456789ABCDEF)
    cloud = {base}
    while len(cloud) < 400:
        x = base
        for b in rng.choice(64, 3, replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        cloud.add(x)
    far = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fp = np.unique(np.concatenate([np.array(list(cloud), np.uint64), far]))
    a, b = simhash.links(fp, np.full(len(fp), 3, np.int8), 4)
    assert len(a) < len(fp)
    assert brute_components(zip(a.tolist(), b.tolist(), strict=True)) == brute_components(brute_links(fp, 4))


def test_blocks_meet_pairwise(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 50)
    fp = np.unique(np.random.default_rng(2).integers(0, 2**16, 200, dtype=np.uint64))
    parts = [list(range(0, 13)), list(range(13, 26)), list(range(26, 39)), list(range(39, 52)), list(range(52, 64))]
    hist = [np.bincount(simhash.part_values(fp, p), minlength=1 << len(p)) for p in parts]
    cost = [simhash.costs(h, len(p), 1) for h, p in zip(hist, parts, strict=True)]
    k, f, r = simhash.keys_of(fp, parts, hist, cost, 0)
    found = set()
    for key in np.unique(k):
        x, y = simhash.links(f[k == key], r[k == key], 4)
        found |= set(zip(x.tolist(), y.tolist(), strict=True))
    assert brute_components(found) == brute_components(brute_links(fp, 4))


def test_simhash_query_matches_brute_force(spark):
    rows = {r.doc_id: r for r in simhash.op3_simhash_near_dedup(spark, MID).collect()}
    src = duckdb.sql(f"select doc_id, coalesce(text, '') from '{MID}/documents.parquet' order by 1").fetchall()
    fp = {i: simhash.simhash(t.encode(), 4)[0] for i, t in src}
    assert all(rows[i].fingerprint == f"{x:016x}" for i, x in fp.items()) and len(rows) == len(src)
    links = [(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 4]
    want = brute_components(links)
    assert all(rows[i].component_id == want.get(i, i) for i in fp)


def test_simhash_by_hand():
    one = "the only words"
    assert simhash.simhash(one.upper().encode(), 4)[0] == __import__("xxhash").xxh64_intdigest(one.encode(), 42)
    assert simhash.simhash(b" \t ", 4) == (0, 0)


def test_simhash_edge_cases(spark):
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.component_id)
    assert by[1] == by[2] == by[8] == {1} and by[3] == {3} and by[4] == by[7] == {4} and by[None] == {None}
    assert simhash.near_duplicates(odd_docs(spark).limit(0)).count() == 0


def test_similar_documents(spark):
    base = " ".join(f"w{i}" for i in range(200))
    near = base.replace("w100 ", "other ")
    docs = spark.createDataFrame([(1, base), (2, near), (3, "quite another text of a few words"), (4, base), (5, None), (6, "")], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one_of_each(docs).collect()}
    assert kept == {1, 3, 5}
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [300, 1000])
def test_similar_documents_in_a_crowd(spark, copies):
    rng = np.random.default_rng(copies)
    base = [f"w{i}" for i in range(400)]
    texts = {0: " ".join(base)}
    for i in range(1, copies + 1):  # independent edits: similarity to the original from 0.7 to 0.9
        own = base.copy()
        for k in rng.choice(400, rng.integers(4, 15), replace=False):
            own[k] = f"e{rng.integers(1 << 40)}"
        texts[i] = " ".join(own)
        if i % 10 == 0:  # a copy of the copy, with edits of its own
            for k in rng.choice(400, 5, replace=False):
                own[k] = f"e{rng.integers(1 << 40)}"
            texts[copies + i] = " ".join(own)
    ids = sorted(texts)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    fp = np.array([simhash.simhash(texts[i].encode(), 5)[0] for i in ids], np.uint64)
    sets = [set(simhash.shingle_set(texts[i].encode(), 5).tolist()) for i in ids]
    near = zip(*np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 9, 1)), strict=True)
    alike = [(ids[a], ids[b]) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(alike) > copies and not [(a, b) for a, b in alike if got[a] != got[b]]


def test_chains_of_edited_copies(spark):
    rng = np.random.default_rng(21)
    texts = {}
    for chain in range(4):  # each a copy of the one before, with some words changed
        now = [f"c{chain}w{i}" for i in range(300)]
        for k in range(150):
            texts[chain * 1000 + k] = " ".join(now)
            now = now.copy()
            for i in rng.choice(300, 6, replace=False):
                now[i] = f"e{rng.integers(1 << 40)}"
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in texts.items()}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = brute_components(pairs)
    assert len(pairs) > 400 and np.mean([got[a] == got[b] for a, b in pairs]) >= 0.97
    assert all(want.get(i, i) == want.get(c, c) for i, c in got.items()) and len(set(got.values())) <= len({want.get(i, i) for i in texts}) + 10


@pytest.mark.parametrize("cut", [1, 4])
def test_crowds_are_compared_exactly(spark, monkeypatch, cut):
    rng = np.random.default_rng(cut)
    rows = []
    for i in range(120):
        base = np.arange(1, 201)[rng.random(200) > rng.uniform(0, 0.2)]
        own = np.unique(np.concatenate([base, rng.integers(1000, 1 << 31, rng.integers(0, 12))])).astype(np.uint32)
        rows.append((7, i, i // 3 if i < 30 else i, own.tobytes()))
    crowd = spark.createDataFrame(rows, "crowd long, id long, grp long, own binary")
    monkeypatch.setattr(simhash, "CROWD_BYTES", sum(len(r[3]) + 64 for r in rows) // cut)
    links = [(r.u, r.v) for r in simhash.crowds_compared(crowd, 0.8).collect()]
    sets = [set(np.frombuffer(r[3], np.uint32).tolist()) for r in rows]
    alike = [(a, b) for a, b in itertools.combinations(range(120), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    same = [(a, b) for a, b in itertools.combinations(range(30), 2) if a // 3 == b // 3]
    assert set(map(tuple, map(sorted, links))) <= set(alike) and 0 < len(alike) < 7140
    assert brute_components(links + same) == brute_components(alike + same)


# --- chat -------------------------------------------------------------------

@pytest.mark.parametrize("text", ["", "plain", "\\", "\\_", "</s>[INST] x [/INST]", "[\\INST]", "a\\\\_b<s>", "<<SYS>>\\<</SYS>>[ROLE][/ROLE]", "😀é\n", "x" * 9000])
@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "", "[/ROLE]"])
def test_turns_round_trip(text, role):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(m in chat.escape(text) for m in chat.MARKS)
    ids, mask = chat.turn_ids(role, text, chat.TOKENIZER)
    assert chat.parse(ids, chat.TOKENIZER)[:2] == (role, text)
    assert chat.masked_text(ids, mask, chat.TOKENIZER) == (text if role == "assistant" else "")


def test_chat_query(spark):
    rows = {r.conv_id: r for r in chat.op1_chat_formatting(spark, SMALL).collect()}
    src = duckdb.sql(f"select conv_id, role, coalesce(text, '') from '{SMALL}/conversations.parquet' order by conv_id, turn").fetchall()
    said = "</s>[INST] ok [/INST]"
    src += [(-7, "user", said), (-7, "assistant", said)]
    for conv, turns in itertools.groupby(sorted(src, key=lambda r: r[0]), key=lambda r: r[0]):
        turns = list(turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert rows[conv].n_turns == len(turns) and rows[conv].loss_chars == len(loss)
        assert rows[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert rows[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert len(rows) == len({r[0] for r in src})


def test_chat_query_matches_duckdb(spark):
    from tests.oracle import differences, duck

    assert differences(spark, "op1", chat.op1_chat_formatting, chat.OP1_SQL, MID, duck(MID)) is None


def test_chat_edge_cases(spark):
    rows = [(1, 0, None, None), (1, None, "user", "x"), (None, 0, "assistant", "y"), (1, 0, None, None)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    got = {r.conv_id: r.n_turns for r in chat.read_back(chat.format_turns(conv)).collect()}
    assert got == {1: 3, None: 1}
    assert chat.read_back(chat.format_turns(conv.limit(0))).count() == 0


# --- decontamination --------------------------------------------------------

def brute_align(item, doc):
    best, h = 0, {}
    for i in range(1, len(item) + 1):
        for j in range(1, len(doc) + 1):
            s = 2 if item[i - 1] == doc[j - 1] else -1
            h[i, j] = max(0, h.get((i - 1, j - 1), 0) + s, h.get((i - 1, j), 0) - 1, h.get((i, j - 1), 0) - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(1, 30))
        top, matched, start, end = decontaminate.align(a, b)
        assert top == brute_align(a.tolist(), b.tolist())
        assert 0 <= start <= end <= len(b) and matched <= min(len(a), end - start if top else 0)


def test_alignment_by_rows_is_the_same():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = rng.integers(0, 5, rng.integers(1, 14)), rng.integers(0, 5, rng.integers(1, 40))
        assert decontaminate.align_rows(a, b) == decontaminate.align(a, b)


def test_a_very_long_item(spark):
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in rng.integers(0, 5000, 20_000)]
    copy = [w if rng.random() > 0.05 else "other" for w in words]
    docs = spark.createDataFrame([(1, " ".join(copy)), (2, " ".join(reversed(words)))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words)), (9, " ".join(words))], "item_id long, text string")
    got = decontaminate.leaks(docs, bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 9)] and got[0].matched > 18_000 and got[0].score > 0.8


def test_leaks_are_found_and_clean_documents_are_not(spark):
    words = [f"w{i}" for i in range(400)]
    item = " ".join(words[:40])
    edited = " ".join("changed" if i % 8 == 5 else w for i, w in enumerate(words[:40]))
    docs = spark.createDataFrame(
        [(1, "before " + item.upper() + " after"), (2, "x " * 500 + edited), (3, " ".join(words[200:])), (4, None), (5, ""), (6, " ".join(words[:3])), (7, "ab cd"), (7, "ab cd")],
        "doc_id long, text string").withColumn("score", F.lit("clash"))
    bench = spark.createDataFrame([(10, item), (11, "ab cd"), (12, None), (13, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(1, 10), (2, 10), (7, 11), (7, 11)]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, block_bytes=100).collect()) == got
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == {3, 4, 5, 6}


def test_leak_query_matches_brute_force(spark):
    got = {(r.doc_id, r.item_id) for r in decontaminate.op2_decontamination(spark, SMALL).collect()}
    docs = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    items = duckdb.sql(f"select item_id, text from '{SMALL}/benchmark.parquet'").fetchall()
    plain = {d: " ".join(decontaminate.words_of(t)) for d, t in docs}
    whole = {(d, i) for d, t in plain.items() for i, x in items if f" {' '.join(decontaminate.words_of(x))} " in f" {t} "}
    assert whole <= got
    for d, i in got - whole:
        x = decontaminate.words_of(dict(items)[i])
        assert brute_align(x, plain[d].split()) >= decontaminate.MIN_SCORE * 2 * len(x)


def test_edited_copies_of_a_hot_item_are_found(spark):
    rng = np.random.default_rng(8)
    item = [f"w{i}" for i in range(16)]
    docs, want = [], set()
    for d in range(400):
        own = [f"e{rng.integers(1 << 40)}" if d % 2 and rng.random() < 0.25 else w for w in item]
        docs.append((d, " ".join([f"x{rng.integers(1 << 40)}" for _ in range(20)] + own + [f"y{d}"] * 20)))
        grams = {tuple(item[i:i + 3]) for i in range(14)} & {tuple(own[i:i + 3]) for i in range(14)}
        if len(grams) >= 2 and brute_align(item, own) >= decontaminate.MIN_SCORE * 2 * 16:
            want.add(d)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(want) > 300 and want <= got


# --- classifiers ------------------------------------------------------------

def held(spark, fn, column, mod, rest):
    truth = dict(duckdb.sql(f"select doc_id, {column} from '{MID}/labels.parquet' where {column} is not null").fetchall())
    rows = fn(spark, MID).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    own = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return float(np.mean([a == b for a, b in own])), len(rows)


def test_quality_held_out(spark):
    accuracy, n = held(spark, nbsvm.op4_quality_classifier, "quality", 5, 0)
    assert accuracy >= 0.9 and n == 1000


def test_toxicity_held_out(spark):
    accuracy, n = held(spark, toxicity.op5_toxicity, "toxic", 4, 2)
    assert accuracy >= 0.9 and n == 1000


def test_language_held_out(spark):
    truth = dict(duckdb.sql(f"select doc_id, lang from '{MID}/documents.parquet'").fetchall())
    rows = langid.op9_language_id(spark, MID).collect()
    own = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(own) >= 0.97 and len(rows) == 1000


def test_interactions_are_learned():
    rng = np.random.default_rng(0)
    texts, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        rest = " ".join(f"z{k}" for k in rng.integers(0, 40, 20))
        texts.append(f"{'insultingword' if a else ''} {rest} {'groupmention' if b else ''}")
        y.append(int(a and b))
    model = toxicity.fit(texts, np.array(y))
    s = np.array([toxicity.score(t, model) for t in ("insultingword groupmention z1", "insultingword z1", "groupmention z1", "z1")])
    assert s[0] > 0.5 and (s[1:] < 0.3).all()


def test_hinge_model_matches_subgradient_descent():
    rng = np.random.default_rng(12)
    x = np.append(rng.normal(size=(60, 4)), np.ones((60, 1)), axis=1)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    value = lambda w: w @ w / 2 + np.maximum(0, 1 - y * (x @ w)).sum()
    got = nbsvm.hinge_dual([(np.arange(5), r) for r in x], y, 5, 1.0, 2000)
    w, best = np.zeros(5), np.inf
    for k in range(1, 40_001):
        w = w - (w - ((y * (x @ w) < 1) * y) @ x) / k
        best = min(best, value(w))
    assert value(got) <= best * 1.01


def test_factorization_machine_matches_the_pairwise_sum():
    rng = np.random.default_rng(3)
    model = {"bias": 0.3, "w": rng.normal(size=9), "v": rng.normal(size=(9, toxicity.RANK))}
    x = np.array([1, 4, 5, 8])
    pairs = sum(float(model["v"][a] @ model["v"][b]) for a, b in itertools.combinations(x, 2))
    assert abs(toxicity.machine(x, model) - (0.3 + model["w"][x].sum() + pairs)) < 1e-9


def test_ftrl_matches_the_update_rule_by_hand():
    rows = [(np.array([0, 2, langid.BUCKETS]), np.array([0.6, 0.8, 1.0])), (np.array([1, 2, langid.BUCKETS]), np.array([0.8, 0.6, 1.0]))] * 8
    y = np.array([0, 1] * 8)
    got = langid.ftrl(rows, y, 2, epochs=1)
    z, n = {}, {}

    def weight(c, i):
        a, b = z.get((c, i), 0.0), n.get((c, i), 0.0)
        return 0.0 if abs(a) <= langid.L1 else -(a - np.sign(a) * langid.L1) / ((langid.BETA + b**0.5) / langid.ALPHA + langid.L2)

    for k in np.random.default_rng(3).permutation(16):
        i, v = rows[k]
        w = {(c, int(j)): weight(c, int(j)) for c in (0, 1) for j in i}
        s = [sum(w[c, int(j)] * x for j, x in zip(i, v, strict=True)) for c in (0, 1)]
        e = np.exp(np.array(s) - max(s))
        for c in (0, 1):
            for j, x in zip(i.tolist(), v, strict=True):
                g = (e[c] / e.sum() - (c == y[k])) * x
                b = n.get((c, j), 0.0)
                z[c, j] = z.get((c, j), 0.0) + g - ((b + g * g) ** 0.5 - b**0.5) / langid.ALPHA * w[c, j]
                n[c, j] = b + g * g
    assert all(abs(got[c, j] - weight(c, j)) < 1e-9 for c in (0, 1) for j in (0, 1, 2, langid.BUCKETS))


def test_ngrams_at_chunk_borders_count_once(monkeypatch):
    text = "".join(chr(97 + k * 7 % 23) for k in range(1000))
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "CHUNK", 64)
    assert (langid.ngram_counts(text) == whole).all() and whole.sum() == 1000 + 999 + 998


def test_sample_of_a_fit_is_bounded_in_bytes():
    rows = [(h, d, "x" * (d % 50), d) for d, h in enumerate(np.random.default_rng(1).permutation(500).tolist())]
    want, held = [], 0
    for h, d, t, y in sorted(rows):
        held += len(t)
        if held > 2000:
            break
        want.append((t, y))
    for seed in (1, 2):
        kept = nbsvm.Sample(2000)
        for k in np.random.default_rng(seed).permutation(500):
            kept.add(*rows[k])
        assert kept.rows() == sorted(want, key=lambda r: r[1])


def test_hinge_model_separates():
    rows = [(np.array([0, 2]), np.array([1.0, 1.0])), (np.array([1, 2]), np.array([1.0, 1.0]))]
    w = nbsvm.hinge_dual(rows, np.array([1.0, -1.0]), 3, 10.0, 50)
    assert w[0] > 0.5 > -0.5 > w[1]


def test_classifier_edge_cases(spark):
    docs = odd_docs(spark)
    some = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int")
    for f in (lambda d, s: nbsvm.quality_scores(d, s), lambda d, s: toxicity.toxicity_scores(d, s)):
        for labels in (some, some.limit(0), some.where("doc_id = 3")):
            rows = f(docs, labels).collect()
            assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert f(docs.limit(0), some).count() == 0
    langs = docs.withColumn("lang", F.when(F.col("doc_id") > 3, F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")))
    rows = langid.identify(langs).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows if r.doc_id in (1, 2, 8)} == {"und"}
    assert {r.lang_pred for r in langid.identify(langs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(langs.limit(0)).count() == 0


# --- sharding ---------------------------------------------------------------

def check_shards(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return {k: sum(r["size"] for r in v) for k, v in by.items()}


def test_shards_are_balanced_and_keep_equal_texts(spark):
    rows = kdtree.op8_kd_tree_sharding(spark, MID).collect()
    texts = dict(duckdb.sql(f"select doc_id, coalesce(text, '') from '{MID}/documents.parquet'").fetchall())
    sizes = check_shards(rows, 8)
    assert len(sizes) == 8 and max(sizes.values()) <= 1.1 * sum(sizes.values()) / 8
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    of = {}
    for r in rows:
        assert of.setdefault(texts[r.doc_id], r.shard) == r.shard


def brute_tree(rows, shards):
    """The tree by sorting, over the same integer keys: (doc_id, shard)."""
    out, groups = {}, {}
    for r in rows:
        groups[r["h1"], r["h2"]] = groups.get((r["h1"], r["h2"]), 0) + r["size"]
    left, leaves, first = sum(groups.values()), shards, 0
    for w, g in sorted((-w, g) for g, w in groups.items()):
        if leaves < 2 or -w * leaves < left or first == shards - 1:
            break
        out |= {r["doc_id"]: first for r in rows if (r["h1"], r["h2"]) == g}
        left, leaves, first = left + w, leaves - 1, first + 1
    nodes = [([r for r in rows if r["doc_id"] not in out], leaves, first)]
    while nodes:
        own, leaves, first = nodes.pop()
        if leaves == 1:
            out |= {r["doc_id"]: first for r in own}
            continue
        key = max(("k_" + d for d in kdtree.DIMENSIONS), key=lambda k: max(r[k] for r in own) - min(r[k] for r in own))
        want, below = sum(r["size"] for r in own) * (leaves // 2) // leaves, 0
        at = {}
        for r in own:
            at[r[key]] = at.get(r[key], 0) + r["size"]
        for cut in sorted(at):
            if below + at[cut] > want:
                break
            below += at[cut]
        if abs(below + at[cut] - want) < want - below:
            cut += 1
        nodes.append(([r for r in own if r[key] < cut], leaves // 2, first))
        nodes.append(([r for r in own if r[key] >= cut], leaves - leaves // 2, first + leaves // 2))
    return out


@pytest.mark.parametrize("shards", [2, 3, 8])
def test_tree_matches_brute_force(spark, shards):
    rows = [r.asDict() for r in kdtree.points(table(spark, SMALL, "documents")).collect()]
    for d in kdtree.DIMENSIONS:
        lo, hi = min(r[d] for r in rows), max(r[d] for r in rows)
        for r in rows:
            r["k_" + d] = int(min(kdtree.SCALE - 1, np.floor((r[d] - lo) / max(hi - lo, 1e-12) * kdtree.SCALE))) * kdtree.SCALE + r["h1"] % kdtree.SCALE
    got = {r.doc_id: r.shard for r in kdtree.kd_shards(table(spark, SMALL, "documents"), shards).collect()}
    assert got == brute_tree(rows, shards)


def test_leaves_reach_the_target_bytes(spark):
    docs = table(spark, MID, "documents")
    total = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).first()[0]
    rows = kdtree.kd_shards(docs, target_bytes=total // 5).collect()
    sizes = check_shards(rows, 6)
    assert len(sizes) == 6 and max(sizes.values()) <= 1.1 * total // 5


def test_shard_edge_cases(spark):
    rows = kdtree.kd_shards(odd_docs(spark), 3).collect()
    assert len(rows) == len(ODD)
    check_shards(rows, 3)
    heavy = spark.createDataFrame([(i, "same") for i in range(60)] + [(100 + i, f"t{i}") for i in range(60)], "doc_id long, text string")
    sizes = check_shards(kdtree.kd_shards(heavy, 4).collect(), 4)
    assert len(sizes) == 4 and min(sizes.values()) > 40
    assert kdtree.kd_shards(heavy.limit(0), 4).count() == 0
    assert {r.shard for r in kdtree.kd_shards(heavy, 1).collect()} == {0}


# --- mixing -----------------------------------------------------------------

def brute_rates(p, tokens, aims, most=None, movable=None, steps=60_000):
    """Accelerated projected gradient over all documents' own rates; the totals it reaches, as shares."""
    t = tokens / tokens.sum()
    a, r = p * t[:, None], np.ones(len(t))
    step = 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p).max()
    now, speed = r.copy(), 1.0
    for _ in range(steps):
        new = np.maximum(0, now - step * (p @ (a.T @ now - aims)))
        new = new if most is None else np.minimum(most, new)
        new = new if movable is None else np.where(movable, new, 1.0)
        faster = (1 + (1 + 4 * speed**2) ** 0.5) / 2
        now, r, speed = new + (speed - 1) / faster * (new - r), new, faster
    return a.T @ r, r


@pytest.mark.parametrize("aims,most", [([0.5, 0.3, 0.2], None), ([0.9, 0.08, 0.02], None), ([0.2, 0.1, 0.1], 1.0), ([0.999, 0.001, 0.0], None)])
def test_rates_match_brute_force(spark, aims, most):
    rng = np.random.default_rng(4)
    p, tokens = rng.dirichlet([1, 1, 1], 300), rng.integers(1, 500, 300)
    movable = p[:, 0] < 0.6 if most else None
    rows = [(i, int(t), *map(float, q)) for i, (t, q) in enumerate(zip(tokens, p, strict=True))]
    rows = materialize(spark.createDataFrame(rows, "doc_id long, tokens long, p_0 double, p_1 double, p_2 double"), "t")
    total = float(tokens.sum())
    rate, fit = mixing.rates(rows, [x * total for x in aims], most, F.col("p_0") < 0.6 if most else None)
    want, _ = brute_rates(p, tokens, np.array(aims), most, movable)
    got = rows.withColumn("r", rate).agg(F.min("r"), F.max("r"), *[F.sum(F.col("r") * F.col("tokens") * F.col(f"p_{k}")) for k in range(3)]).first()
    assert got[0] >= 0 and (most is None or got[1] <= most)
    assert all(abs(x / total - y) < 1e-3 for x, y in zip(got[2:], want, strict=True)) and abs(fit["totals"][0] - got[2]) < 1e-6 * total


def test_mixing_is_the_same_in_any_partitioning(spark):
    docs, labels = table(spark, MID, "documents"), mixing.label_domains(table(spark, MID, "labels"))
    one, other = ({r.doc_id: r for r in mixing.mix(d, labels, mixing.TARGETS).collect()} for d in (docs.repartition(1, "doc_id"), docs.repartition(7, "text")))
    assert all(abs(one[d].rate - other[d].rate) < 1e-6 and abs(one[d].p_low - other[d].p_low) < 1e-9 for d in one) and len(one) == len(other) == 1000


def test_posteriors_match_naive_bayes_by_hand(spark):
    docs = table(spark, MID, "documents")
    model = mixing.learn(docs, mixing.label_domains(table(spark, MID, "labels")))
    some = docs.select("doc_id", F.array_distinct(mixing.buckets(F.col("text"))).alias("have")).collect()
    got = {r.doc_id: r for r in mixing.posteriors(docs, model).collect()}
    for r in some:
        z = [b + sum(w[x] for x in sorted(r.have)) for b, w in zip(model["base"], model["weights"], strict=True)]
        e = np.exp((np.array(z) - max(z)) / model["t"])
        assert np.allclose([got[r.doc_id][f"p_{k}"] for k in range(len(z))], e / e.sum(), atol=1e-4)


def test_thinning_realises_the_fitted_mix(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    known = labels.select("doc_id", F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean").alias("domain"))
    kept = {r.doc_id for r in mixing.thin(docs, known, {"low": 0.14}, 0.6).select("doc_id").collect()}
    model = mixing.learn(docs, known)
    rows = mixing.posteriors(docs, model).toPandas()
    low, clean = (rows.tokens * rows[f"p_{model['domains'].index(d)}"] for d in ("low", "clean"))
    p = np.stack([clean, low], 1) / rows.tokens.to_numpy()[:, None].clip(1)
    whole = float(clean.sum()) / 0.86
    want, _ = brute_rates(p, rows.tokens.to_numpy(), np.array([clean.sum(), 0.14 * whole]) / rows.tokens.sum(), 1.0, p[:, 1] >= 0.6, 20_000)
    stay = rows.doc_id.isin(kept)
    for x, w in zip((clean, low), want, strict=True):
        assert abs(float(x[stay].sum()) / rows.tokens.sum() - w) < 0.01
    assert not set(rows.doc_id[(p[:, 1] < 0.6)]) - kept


def test_mixing_edge_cases(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(3, "a"), (4, "b"), (5, "a"), (None, "b"), (6, None)], "doc_id long, domain string")
    rows = mixing.mix(docs, labels, {"a": 0.5, "b": 0.5}).collect()
    assert len(rows) == len(ODD) and all(r.rate >= 0 for r in rows)
    assert {r.rate for r in mixing.mix(docs, labels.limit(0), {"a": 1.0}).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labels, {"a": 1.0}).count() == 0


def test_mixing_query(spark):
    rows = mixing.op10_mixing(spark, MID).toPandas()
    total = rows.tokens.sum()
    for d, share in mixing.TARGETS.items():
        assert abs((rows.rate * rows.tokens * rows[f"p_{d}"]).sum() / total - share) < 1e-4
    assert len(rows) == table(spark, MID, "documents").count() and (rows.rate >= 0).all()
