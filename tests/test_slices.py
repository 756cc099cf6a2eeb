"""Texts are taken a slice at a time: the same rows, and no more held than a slice."""

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.operators import keyword_index as K
from quillspark.operators import retrieval as R

TEXTS = [(i, f"line {i}\n" * (i % 7) + "w1 w2 " * (i % 11)) for i in range(60)] + [(60, None), (61, ""), (62, "w1 " * 5000)]


def test_chunks_of_slices(spark, monkeypatch):
    files = spark.createDataFrame(TEXTS, "id long, text string").select(F.concat(F.lit("f"), "id").alias("path"), "text")
    monkeypatch.setattr(R, "CHUNKED", 100)
    want = {(f"f{i}", n, *c) for i, t in TEXTS for n, c in enumerate(R.chunk_text(t or ""))}
    assert {tuple(r) for r in R.chunks(files).collect()} == want
    assert not R.chunks(files.limit(0)).collect()


def test_words_are_taken_from_at_most_a_slice(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    monkeypatch.setattr(K, "COUNTED", 100)
    got = {r.id: (r.length, list(r.tf)) for r in K.term_counts(docs, "id", "text", ["w1", "line"]).collect()}
    assert got == {i: (len((t or "").split()), [(t or "").split().count(w) for w in ("w1", "line")]) for i, t in TEXTS}
    texts = pa.array([t for _, t in TEXTS])
    cuts = list(K.batches_of(texts, 100))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(TEXTS) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:], strict=False))
    assert all(hi - lo == 1 or sum(len(t or "") for _, t in TEXTS[lo:hi]) <= 100 for lo, hi in cuts) and K.COUNTED < 8 << 20
