"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct words, lower-cased, and their prefixes of 4 to 6
letters (which catch inflected forms), hashed into BUCKETS buckets (CRC-32). The machine has
a bias, a weight for each bucket and a RANK-vector for each bucket, so that pairs of
terms (an insult with the mention of a group) have a weight of their own, the dot
product of their vectors, even where each alone says little. It is trained by
Adagrad on the logistic loss; a logistic curve fitted on a tenth of the sample that
training has not seen makes its output a probability.

Only buckets more frequent in label 1 by Z_MIN standard errors and by a factor, and
those whose rate differs so among the rows that have one of these, are trained: the
others are noise in texts of thousands of words.

The fit uses the labelled rows whose id hashes lowest, at most MAX_TRAIN of them and
MAX_TRAIN_BYTES of text, in one task; its memory does not grow with the table. Of
rows that share their SKETCH least hashes of four words running, which only copies
do, one is fitted. Scoring reads every whole text, in one pass without a shuffle.

Defined results: a null or empty text has no term and gets the score of the bias;
rows without a label are scored like any other; a table without two labelled
classes gives every row the share of label 1 (0.5 if none is labelled); repeated
ids give a row each; an empty table gives no rows; extra columns are ignored.
``without_toxic`` drops a document only on evidence of its own: a score of the
threshold or more, and at least one trained term. A text without one (a null or an
empty text too) stays, so without labels, or with too few to learn from, all stay.
"""

from __future__ import annotations

import heapq
import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import hash_mod, table
from quillspark.llm.nbsvm import fitted, labelled_sample, logistic_curve, rejected, scored

MAX_TRAIN = 16_000
#: A text of this score or more is held toxic, by the operator and by the pipeline's stage.
THRESHOLD = 0.3
BUCKETS = 1 << 32
PREFIXES = (4, 5, 6)
RANK = 8
Z_MIN = 6.0
#: Least difference of the log rates, and the rows of the sample a bucket must occur in
#: (fewer, 3 at least, where under 20 times as many rows have label 1).
RATIO_MIN = 1.0
MIN_ROWS = 8
#: Rows of either class that it takes to compare rates in company of a telling bucket.
ENOUGH = 50
EPOCHS = 10
#: Outputs beyond this count as this, so that the clearest rows don't flatten the curve.
CLIP = 8.0
#: Rows of the sample that share their so many least hashes of four words count as copies.
SKETCH = 6
RATE = 0.1
DECAY = 1e-5
#: Words whose buckets a worker remembers, at most.
MEMO = 100_000
_WORD = re.compile(r"[^\W_]+")


def buckets_of(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its prefixes."""
    terms = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]
    return tuple(crc32(t.encode("utf-8", "replace")) for t in terms)


def buckets(text: str | None) -> np.ndarray:
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.array([b for w in words for b in buckets_of(w)], np.uint32))


def sketch(text: str | None) -> bytes:
    """The least hashes of four words running (of all words, if fewer)."""
    w = _WORD.findall((text or "").lower())
    runs = {crc32(" ".join(w[i:i + 4]).encode("utf-8", "replace")) for i in range(max(1, len(w) - 3))}
    return np.array(heapq.nsmallest(SKETCH, runs), np.uint32).tobytes()


def machine(x: np.ndarray, model: dict) -> float:
    """Output for a row of active positions."""
    if not len(x):
        return model["bias"]
    v = model["v"][x]
    s = v.sum(0)
    return model["bias"] + float(model["w"][x].sum() + 0.5 * (s @ s - (v * v).sum()))


def _telling(rows: list[np.ndarray], y: np.ndarray, either: bool) -> set[int]:
    """Buckets more frequent in label 1 (``either``: or less), by enough standard errors."""
    n_pos, n_neg = int((y > 0).sum()), int((y <= 0).sum())
    if min(n_pos, n_neg) < (ENOUGH if either else 1):
        return set()
    codes, n = np.unique(np.concatenate(rows), return_counts=True)
    least = min(MIN_ROWS, max(3, n_pos // 20))
    codes, n = codes[n >= least], n[n >= least]
    seen, k = np.unique(np.concatenate([r for r, t in zip(rows, y > 0, strict=True) if t]), return_counts=True)
    pos = np.zeros(len(codes))
    at = np.searchsorted(codes, seen)
    hit = (at < len(codes)) & (codes[np.minimum(at, len(codes) - 1)] == seen) if len(codes) else np.zeros(len(seen), bool)
    pos[at[hit]] = k[hit]
    neg = n - pos
    share = n / (n_pos + n_neg)
    z = np.abs(pos / n_pos - neg / n_neg) / np.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_neg) + 1e-12)
    ratio = np.log((pos + 0.5) / (n_pos + 1) / ((neg + 0.5) / (n_neg + 1)))
    ratio = np.abs(ratio) if either else ratio
    good = (z >= Z_MIN) & (ratio >= RATIO_MIN)
    return set(codes[good].tolist())


def _active(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The buckets to train: telling ones, and those that tell in their company."""
    alone = _telling(rows, y, False)
    marks = np.array(sorted(alone), np.uint32)
    near = np.array([bool(np.isin(r, marks).any()) for r in rows], bool)
    together = _telling([r for r, t in zip(rows, near, strict=True) if t], y[near], True) if near.any() else set()
    return np.array(sorted({*alone, *together}), np.uint32)


def fit(texts: list[str], y: np.ndarray) -> dict:
    model = {"active": {}, "w": np.zeros(0), "v": np.zeros((0, RANK)), "bias": 0.0, "a": 1.0, "b": 0.0}
    pos = float((y > 0).mean()) if len(y) else 0.5
    if pos in (0.0, 1.0) or not len(y):
        p = min(max(pos, 1e-3), 1 - 1e-3)
        return model | {"b": float(np.log(p / (1 - p)))}
    rows = [buckets(t) for t in texts]
    first: dict[bytes, int] = {}
    for k, t in enumerate(texts):
        first.setdefault(sketch(t), k)
    alone = sorted(first.values())  # copies would make a copied text's every word tell
    rows, y = [rows[k] for k in alone], y[alone]
    test = np.arange(len(y)) % 10 == 9
    if len(set(y[test] > 0)) < 2:
        test[:] = False
    active = _active([r for r, t in zip(rows, test, strict=True) if not t], y[~test])
    at = {int(b): i for i, b in enumerate(active)}
    xs = [np.searchsorted(active, r[np.isin(r, active, assume_unique=True)]) for r in rows]
    rng = np.random.default_rng(5)
    model |= {"active": at, "w": np.zeros(len(active)), "v": rng.normal(0, 0.02, (len(active), RANK)), "bias": float(np.log(pos / (1 - pos)))}
    w, v = model["w"], model["v"]
    gw, gv, gb = np.full(len(active), 1e-2), np.full((len(active), RANK), 1e-2), 1e-2
    train = np.nonzero(~test)[0]
    for _ in range(EPOCHS):
        for k in rng.permutation(train):
            x = xs[k]
            out = machine(x, model)
            err = 1 / (1 + np.exp(-np.clip(out, -35, 35))) - (1.0 if y[k] > 0 else 0.0)
            gb += err * err
            model["bias"] -= RATE * err / gb**0.5
            if len(x) and abs(err) > 1e-4:
                vx = v[x]
                dw = err + DECAY * w[x]
                dv = err * (vx.sum(0) - vx) + DECAY * vx
                gw[x] += dw * dw
                gv[x] += dv * dv
                w[x] -= RATE * dw / np.sqrt(gw[x])
                v[x] -= RATE * dv / np.sqrt(gv[x])
    out = np.clip([machine(x, model) for x in xs], -CLIP, CLIP)
    held = test if test.any() else ~test
    model["a"], model["b"] = logistic_curve(out[held], y[held])
    return model


def active_terms(text: str | None, model: dict) -> np.ndarray:
    """Positions of a text's trained terms."""
    memo = model.setdefault("memo", {})
    active = model["active"]
    found = set()
    for word in set(_WORD.findall((text or "").lower())):
        hit = memo.get(word)
        if hit is None:
            if len(memo) >= MEMO:
                memo.clear()
            hit = memo[word] = tuple(active[b] for b in buckets_of(word) if b in active)
        if hit:
            found.update(hit)
    return np.array(sorted(found), np.int64)


def _probability(x: np.ndarray, model: dict) -> float:
    out = np.clip(machine(x, model), -CLIP, CLIP)
    return float(1 / (1 + np.exp(-np.clip(model["a"] * out + model["b"], -35, 35))))


def score(text: str | None, model: dict) -> float:
    return _probability(active_terms(text, model), model)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", may_learn=None, most: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted; ``may_learn`` is a condition on the labels' doc_id."""
    sample = labelled_sample(docs, labels, label, F.lit(True) if may_learn is None else may_learn, most)
    return scored(docs, fitted(sample, fit), score, threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MAX_TRAIN) -> DataFrame:
    """``docs`` without the documents held toxic, learned from all labels of ``docs``."""
    def rejects(text, model):
        x = active_terms(text, model)
        return len(x) > 0 and _probability(x, model) >= threshold

    return rejected(docs, fitted(labelled_sample(docs, labels, "toxic", F.lit(True), most), fit), rejects)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = toxicity_scores(docs, labels, "toxic", hash_mod("doc_id", 4) != 2)
    return out.select("doc_id", (hash_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
