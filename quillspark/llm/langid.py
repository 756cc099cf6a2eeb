"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters of the whole lower-cased text;
their document frequencies are counted over all documents that may be learned from. The model is fitted by
follow-the-regularised-leader with elastic-net penalties (so most weights are
exactly zero), then one temperature, chosen on a tenth of the sample that the fit
has not seen, calibrates its probabilities.

The fit uses the rows with a language whose id hashes lowest, at most MAX_TRAIN of
them and nbsvm's MAX_TRAIN_BYTES of text, in one task. Counting and scoring read every whole text, each in one pass; only BUCKETS
counts are shuffled.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a
table without labels gives ``und`` for all; one language gives that language with
score 1; repeated ids give a row each; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import hash_mod, table
from quillspark.llm.nbsvm import fitted

MAX_TRAIN = 8_000
BUCKETS = 1 << 15
ORDERS = 3
CHUNK = 1 << 20
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
EPOCHS = 2
TEMPERATURES = np.geomspace(0.05, 4, 40)
UNKNOWN = "und"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def ngram_counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text."""
    out = np.zeros(BUCKETS, np.int64)
    text = text.lower()
    for at in range(0, len(text), CHUNK):
        part = text[at:at + CHUNK + ORDERS - 1]  # n-grams that start within the chunk
        c = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        h = np.zeros(len(c), np.uint64)
        for n in range(ORDERS):
            if len(c) <= n:
                break
            h = (h[: len(c) - n] * np.uint64(0x100000001B3) + c[n:] + np.uint64(1)) * _MIX[n]
            out += np.bincount((h[:CHUNK] >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    return out


def tfidf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and unit-length weights."""
    counts = ngram_counts(text)
    i = np.nonzero(counts)[0]
    v = (1 + np.log(counts[i])) * idf[i]
    return i, v / max(float(np.sqrt(v @ v)), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(rows, y: np.ndarray, classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (classes x BUCKETS + 1); the last column is the bias."""
    z, n = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))

    def weights(i):
        zi, ni = z[:, i], n[:, i]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, v = rows[k]
            w = weights(i)
            err = _softmax(w @ v)
            err[y[k]] -= 1
            g = err[:, None] * v[None, :]
            ni = n[:, i]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[:, i] += g - sigma * w
            n[:, i] = ni + g * g
    return weights(np.arange(BUCKETS + 1))


def make_fit(idf: np.ndarray):
    def fit(texts: list[str], y: np.ndarray) -> dict:
        langs = sorted(set(y.tolist()))
        model = {"langs": langs, "w": np.zeros((len(langs), BUCKETS + 1)), "t": 1.0, "idf": idf}
        if len(langs) < 2:
            return model
        at = {x: i for i, x in enumerate(langs)}
        target = np.array([at[x] for x in y.tolist()])
        rows = []
        for t in texts:
            i, v = tfidf(t, idf)
            rows.append((np.append(i, BUCKETS), np.append(v, 1.0)))
        test = np.arange(len(rows)) % 10 == 9
        train = np.nonzero(~test)[0]
        w = ftrl([rows[k] for k in train], target[train], len(langs))
        held = np.nonzero(test)[0] if test.any() else train
        z = np.array([w[:, i] @ v for i, v in (rows[k] for k in held)])
        loss = [-np.log(_softmax(z / t)[np.arange(len(held)), target[held]] + 1e-12).mean() for t in TEMPERATURES]
        return model | {"w": w, "t": float(TEMPERATURES[int(np.argmin(loss))])}

    return fit


def predict(text: str | None, model: dict) -> tuple[str, float]:
    if not model["langs"] or text is None or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    i, v = tfidf(text, model["idf"])
    w = model["w"]
    p = _softmax((w[:, i] @ v + w[:, BUCKETS]) / model["t"])
    k = int(np.argmax(p))
    return model["langs"][k], float(p[k])


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Texts, and for each bucket the texts that have it, over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                if t:
                    df[:BUCKETS] += ngram_counts(t) > 0
                    n += 1
        df[BUCKETS] = n
        i = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(df[i])], ["bucket", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return int(out[BUCKETS]), out[:BUCKETS]


def identify(docs: DataFrame, may_learn=None, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, lang_pred, score; ``may_learn`` is a condition on the rows learned from."""
    import pickle

    allowed = docs if may_learn is None else docs.where(may_learn)
    n, df = document_frequencies(allowed)
    idf = np.log((1 + n) / (1 + df)) + 1
    known = allowed.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = known.select("doc_id", "text", F.col("lang").alias("y")).join(F.broadcast(chosen), "doc_id")
    model = fitted(sample, make_fit(idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model)
        for b in batches:
            got = [predict(t, m) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents"), hash_mod("doc_id", 4) != 2)
    return out.select("doc_id", (hash_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
