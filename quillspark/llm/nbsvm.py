"""Quality classifier: a linear SVM over n-gram indicators scaled by naive Bayes.

Features are the distinct tokens and token pairs of a whole text (a token is a run
of word characters or a run of marks, lower-cased), and which patterns of immediate
repetition it has, whatever the tokens. Each indicator is scaled by the
log ratio of its smoothed class frequencies; a hinge-loss model is then fitted by
dual coordinate descent, and a logistic curve, fitted on a tenth of the sample
that the model has not seen, turns margins into probabilities.

The fit uses the labelled rows whose id hashes lowest, at most MAX_TRAIN of them and
MAX_TRAIN_BYTES of text, so its memory is bounded whatever the table's size and its
texts' length; it runs in one task. Scoring reads every whole text, in one pass
without a shuffle.

Defined results: a null or empty text has no feature and gets the score of the
intercept; rows without a label are scored like any other; a table without two
labelled classes gives every row the share of label 1 (0.5 if none is labelled);
repeated ids give a row each; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import hash_mod, table

#: Bounds on the labelled rows of a fit and on the bytes of their texts.
MAX_TRAIN = 12_000
MAX_TRAIN_BYTES = 128 << 20
#: Bound on the features kept, and the rows of the sample a feature must occur in.
MAX_FEATURES = 150_000
MIN_ROWS = 5
#: Hashed counts that tell which tokens are worth an exact count.
SLOTS = 1 << 22
SMOOTHING = 1.0
COST = 1.0
#: Passes end when no dual variable moved by more than MOVED, or after EPOCHS.
EPOCHS = 60
MOVED = 1e-3
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def repeats(seq: list[str]) -> list[int]:
    """Which of the repeat patterns a text has: a token twice, three and five times running, a pair and a triple twice running."""
    one, two, three = (bytes(map(eq, seq, seq[k:])) for k in (1, 2, 3))
    found = (b"\1" in one, b"\1\1" in one, b"\1\1\1\1" in one, b"\1\1" in two, b"\1\1\1" in three)
    return [k for k, hit in enumerate(found) if hit]


def grams(seq: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    """Distinct codes: -1 - k for repeat pattern k, a token's number, or two numbers for a pair."""
    ids = np.fromiter(map(vocabulary.get, seq, repeat(-1)), np.int64, len(seq))
    a, b = ids[:-1], ids[1:]
    both = (a >= 0) & (b >= 0)
    pairs = ((a[both] + 1) << 32) | b[both]
    return np.unique(np.concatenate([ids[ids >= 0], pairs, np.array([-1 - k for k in repeats(seq)], np.int64)]))


def hinge_dual(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n: int, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of min |w|^2/2 + cost * sum max(0, 1 - y w.x), one dual variable (0 to cost) at a time."""
    w, alpha = np.zeros(n), np.zeros(len(rows))
    square = np.array([max(float(v @ v), 1e-12) for _, v in rows])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            i, v = rows[k]
            g = y[k] * float(w[i] @ v) - 1
            new = min(cost, max(0.0, alpha[k] - g / square[k]))
            if new != alpha[k]:
                w[i] += (new - alpha[k]) * y[k] * v
                moved = max(moved, abs(new - alpha[k]))
                alpha[k] = new
        if moved < MOVED:
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of sigmoid(a * margin + b), by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        scale = min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        a, b = a - scale * step[0], b - scale * step[1]
    return float(max(a, 1e-6)), float(b)


def fit(texts: list[str], y: np.ndarray) -> dict:
    """Margins are dot products with rows scaled to length one, plus a bias."""
    model = {"vocabulary": {}, "codes": np.zeros(0, np.int64), "w": np.zeros(0), "ratio": np.zeros(0), "bias": 0.0, "a": 1.0, "b": 0.0}
    pos = float((y > 0).mean()) if len(y) else 0.5
    if pos in (0.0, 1.0) or not len(y):
        p = min(max(pos, 1e-3), 1 - 1e-3)
        return model | {"b": float(np.log(p / (1 - p)))}
    # texts are split again in each step: their tokens, as objects, would take many times their room
    slots = np.zeros(SLOTS, np.int32)
    for t in texts:
        np.add.at(slots, [crc32(x.encode("utf-8", "replace")) % SLOTS for x in set(tokens(t))], 1)
    seen = Counter()
    for t in texts:
        seen.update(x for x in set(tokens(t)) if slots[crc32(x.encode("utf-8", "replace")) % SLOTS] >= MIN_ROWS)
    vocabulary = {t: i for i, t in enumerate(sorted(t for t, n in seen.items() if n >= MIN_ROWS))}
    del seen, slots
    coded = [grams(tokens(t), vocabulary) for t in texts]
    codes, n = np.unique(np.concatenate(coded), return_counts=True)
    kept = np.sort(np.lexsort((codes, -n))[:MAX_FEATURES])
    codes = codes[kept[n[kept] >= MIN_ROWS]]
    idx = [np.searchsorted(codes, c[np.isin(c, codes, assume_unique=True)]).astype(np.int32) for c in coded]
    del coded
    test = np.arange(len(y)) % 10 == 9
    if len(set(y[test] > 0)) < 2:
        test[:] = False
    p, q = np.full(len(codes), SMOOTHING), np.full(len(codes), SMOOTHING)
    for i, label, held in zip(idx, y, test, strict=True):
        if not held:
            (p if label > 0 else q)[i] += 1
    n_pos, n_neg = (y[~test] > 0).sum() + 2 * SMOOTHING, (y[~test] <= 0).sum() + 2 * SMOOTHING
    ratio = np.log((p / n_pos) / (q / n_neg))

    def row(i):
        v = ratio[i]
        return np.append(i, np.int32(len(codes))), np.append(v / max(np.sqrt(v @ v), 1e-9), 1.0).astype(np.float32)

    rows = [row(i) for i in idx]
    train = np.nonzero(~test)[0]
    w = hinge_dual([rows[k] for k in train], np.where(y[train] > 0, 1.0, -1.0), len(codes) + 1)
    margin = np.array([w[i] @ v for i, v in rows])
    held = test if test.any() else ~test
    a, b = logistic_curve(margin[held], y[held])
    return model | {"vocabulary": vocabulary, "codes": codes, "w": w[:-1] * ratio, "ratio": ratio, "bias": float(w[-1]), "a": a, "b": b}


def score(text: str | None, model: dict) -> float:
    margin, codes = model["bias"], model["codes"]
    if len(codes):
        c = grams(tokens(text), model["vocabulary"])
        at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
        at = at[codes[at] == c]
        norm = float(np.sqrt(model["ratio"][at] @ model["ratio"][at]))
        margin += float(model["w"][at].sum()) / norm if norm > 1e-9 else 0.0
    return float(1 / (1 + np.exp(-np.clip(model["a"] * margin + model["b"], -35, 35))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn, most: int) -> DataFrame:
    """doc_id, text, y of at most ``most`` labelled documents, those whose id hashes lowest.

    Only the narrow labels are sorted; the sample's ids, bounded by ``most``, go to the
    documents, so texts stay where they are read."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & may_learn)
    one = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


class Sample:
    """The rows of least hash, as long as their texts stay within ``most`` bytes together."""

    def __init__(self, most: int):
        self.most, self.held, self.end, self.heap = most, 0, None, []

    def add(self, h: int, doc_id: int, text: str | None, y) -> None:
        if self.end is not None and (h, doc_id) >= self.end:
            return
        size = len((text or "").encode("utf-8", "replace"))
        heapq.heappush(self.heap, (-h, -doc_id, size, text or "", y))
        self.held += size
        while self.held > self.most:
            h, doc_id, size, _, _ = heapq.heappop(self.heap)
            self.held -= size
            self.end = (-h, -doc_id)  # nothing from here on: what is kept is the same in any order of rows

    def rows(self) -> list[tuple[str, object]]:
        return [(t, y) for _, _, _, t, y in sorted(self.heap, key=lambda r: -r[1])]


def train(sample: DataFrame, fit_rows, most_bytes: int = MAX_TRAIN_BYTES) -> DataFrame:
    """One row, ``model``: what ``fit_rows(texts, y)`` made of the sample, in one task."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Sample(most_bytes)
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("h", "doc_id", "text", "y")), strict=True):
                kept.add(*r)
        rows = kept.rows()
        order = np.random.default_rng(11).permutation(len(rows))
        model = fit_rows([rows[i][0] for i in order], np.array([rows[i][1] for i in order]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # a repeated id counts once, so that the sample stays within its bound
    once = sample.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("row"))
    return once.select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "row.*").repartition(1).mapInArrow(run, "model binary")


def fitted(sample: DataFrame, fit_rows) -> bytes:
    got = train(sample, fit_rows).collect()
    if got:
        return bytes(got[0].model)
    import pickle

    return pickle.dumps(fit_rows([], np.array([])))


def scored(docs: DataFrame, model: bytes, score_text, threshold: float) -> DataFrame:
    """doc_id, score, predicted of every row of ``docs``."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(model)
        for b in batches:
            s = np.array([score_text(t, known) for t in b.column("text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def rejected(docs: DataFrame, model: bytes, rejects) -> DataFrame:
    """``docs`` without the rows whose text ``rejects(text, model)``; all columns are kept."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(model)
        for b in batches:
            yield b.filter(pa.array([not rejects(t, known) for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", may_learn=None, most: int = MAX_TRAIN, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted; ``may_learn`` is a condition on the labels' doc_id."""
    sample = labelled_sample(docs, labels, label, F.lit(True) if may_learn is None else may_learn, most)
    return scored(docs, fitted(sample, fit), score, threshold)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_scores(docs, labels, "quality", hash_mod("doc_id", 5) != 0)
    return out.select("doc_id", (hash_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
