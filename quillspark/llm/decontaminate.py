"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. The words of the benchmark's items give their n-grams, which one pass over all whole
   documents finds. All are seeds, however many documents hold them: which n-grams of an
   item are rare depends on its copies' edits, so rare ones alone lose edited copies of an
   item that leaked into many documents.
2. Where an item has two seeds within its length, the stretch around them is aligned
   with the item (local alignment over words: match 2, mismatch and gap -1), unless it
   holds too few of the item's words for the least score. The score is the best
   alignment's, as a share of the item's own; copies that are edited, cut or rewritten
   in part lose only the words concerned. An alignment of more than MATRIX_CELLS cells
   goes row by row, so its memory grows with the stretch, not with its square.

The benchmark is read in blocks of about BLOCK_BYTES of text, one pass a block, so
what goes to the executors is bounded whatever its size; documents are never
shuffled, and nothing of them reaches the driver.

Defined results: null and empty texts and items match nothing; an item of fewer
words than an n-gram is its own only seed, and must occur whole; repeated documents
give a row each, repeated rows of an item count once; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import anti_by_id, materialize, table

NGRAM = 3
MIN_SEEDS = 2
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.45
BLOCK_BYTES = 4 << 20
_WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, score double, matched int, start_word int, end_word int"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Index:
    """A block of items: word numbers, and the sorted codes of their n-grams."""

    def __init__(self, items: list[tuple[int, str]], n: int = NGRAM):
        self.n = n
        self.items = [(i, w) for i, t in sorted(items, key=lambda x: (x[0], x[1] or "")) if (w := words_of(t))]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in self.items for w in ws}))}
        self.ids = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in self.items]
        per = [np.unique(self.codes(x, short=True)) for x in self.ids]
        self.grams = np.unique(np.concatenate(per)) if per else np.zeros(0, np.int64)
        self.of_item = [np.searchsorted(self.grams, p) for p in per]
        gram = np.concatenate(self.of_item) if per else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(per)), [len(p) for p in per])
        order = np.argsort(gram, kind="stable")
        self.owner = item[order]  # the items of n-gram g: owner[starts[g]:starts[g + 1]]
        self.starts = np.searchsorted(gram[order], np.arange(len(self.grams) + 1))

    def by_item(self, pos: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each item the (position, n-gram) pairs of its n-grams."""
        out: dict[int, list[tuple[int, int]]] = {}
        for p, g in zip(pos.tolist(), at.tolist(), strict=True):
            for k in self.owner[self.starts[g]:self.starts[g + 1]].tolist():
                out.setdefault(k, []).append((p, g))
        return out

    def numbers(self, text: str | None) -> np.ndarray:
        w = words_of(text)
        return np.fromiter(map(self.vocabulary.get, w, repeat(-1)), np.int64, len(w))

    def codes(self, x: np.ndarray, short: bool = False) -> np.ndarray:
        """Code of the n-gram at each position (-1: a word of it is in no item)."""
        size = len(self.vocabulary) + 1
        if len(x) < self.n and not short:
            return np.full(max(len(x), 0), -1, np.int64)
        m = max(len(x) - self.n + 1, 1)
        out, bad = np.zeros(m, np.uint64), np.zeros(m, bool)
        for k in range(min(self.n, len(x))):
            part = x[k:k + m]
            out = out * np.uint64(size) + (part + 1).astype(np.uint64)
            bad |= part < 0
        out = (out & np.uint64(0x7FFFFFFFFFFFFFFF)).astype(np.int64)
        out[bad] = -1
        return out

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in x of n-grams of the items, and which they are."""
        if not len(self.grams) or not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = np.nonzero(x >= 0)[0]
        if not len(known):
            return known, known
        pos, at = [], []
        if len(x) >= self.n:
            c = self.codes(x)
            k = np.minimum(np.searchsorted(self.grams, c), len(self.grams) - 1)
            hit = np.nonzero((self.grams[k] == c) & (c >= 0))[0]
            pos.append(hit), at.append(k[hit])
        for ids, own in zip(self.ids, self.of_item, strict=True):
            if len(ids) < self.n and len(x) >= len(ids):  # a short item occurs whole or not at all
                same = np.all(np.lib.stride_tricks.sliding_window_view(x, len(ids)) == ids, axis=1)
                p = np.nonzero(same)[0]
                pos.append(p), at.append(np.full(len(p), own[0]))
        return (np.concatenate(pos), np.concatenate(at)) if pos else (known[:0], known[:0])


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman: best score, matched words, start and end (exclusive) in ``doc``."""
    m, w = len(item), len(doc)
    steps = np.arange(w + 1) * -GAP
    h, score = np.zeros(w + 1, np.int64), np.zeros((m + 1, w + 1), np.int64)
    for i in range(1, m + 1):
        diag = h[:-1] + np.where(doc == item[i - 1], MATCH, MISMATCH)
        best = np.maximum(0, np.maximum(diag, h[1:] + GAP))
        best = np.concatenate([[0], best])
        h = np.maximum.accumulate(best + steps) - steps  # gaps along the document
        score[i] = h
    i, j = np.unravel_index(int(np.argmax(score)), score.shape)
    top, end, matched = int(score[i, j]), int(j), 0
    while i and j and score[i, j] > 0:
        same = doc[j - 1] == item[i - 1]
        if score[i, j] == score[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matched += bool(same)
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return top, matched, int(j), end


#: Cells of an alignment whose score matrix is kept; larger ones go row by row.
MATRIX_CELLS = 1 << 22


def align_rows(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int, int]:
    """The same as ``align`` in memory of a few rows: each cell carries where its alignment starts
    and how many words it matches, so that no way back is needed."""
    w = len(doc)
    at = np.arange(w + 1, dtype=np.int64)
    h, start, matched = np.zeros(w + 1, np.int64), at.copy(), np.zeros(w + 1, np.int64)
    top, best = 0, (0, 0, 0, 0)
    for word in item:
        same = doc == word
        diag = h[:-1] + np.where(same, MATCH, MISMATCH)
        up = h[1:] + GAP
        own = np.zeros(w + 1, np.int64)
        own[1:] = np.maximum(0, np.maximum(diag, up))
        new = np.maximum.accumulate(own - at * GAP) + at * GAP
        by_diag, by_up = new[1:] == diag, new[1:] == up
        s, m = at.copy(), np.zeros(w + 1, np.int64)
        s[1:] = np.where(by_diag, start[:-1], np.where(by_up, start[1:], at[1:]))
        m[1:] = np.where(by_diag, matched[:-1] + same, np.where(by_up, matched[1:], 0))
        # gaps along the document: from the last cell before that has its score by itself
        source = np.maximum.accumulate(np.where(np.append(True, by_diag | by_up) | (new == 0), at, 0))
        h, start, matched = new, s[source], m[source]
        none = h == 0
        start[none], matched[none] = at[none], 0
        end = int(np.argmax(h))
        if h[end] > top:
            top, best = int(h[end]), (int(h[end]), int(matched[end]), int(start[end]), end)
    return best


def aligned(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int, int]:
    return align(item, doc) if len(item) * len(doc) <= MATRIX_CELLS else align_rows(item, doc)


def within_reach(item: np.ndarray, doc: np.ndarray, min_score: float) -> bool:
    """Whether ``doc`` has enough of the item's words, each as often as it may match, for the least score."""
    known, times = np.unique(item, return_counts=True)
    k = np.minimum(np.searchsorted(known, doc), len(known) - 1)
    has = np.bincount(k[known[k] == doc], minlength=len(known))
    return int(np.minimum(has, times).sum()) / len(item) >= min_score


def hits(x: np.ndarray, pos: np.ndarray, at: np.ndarray, index: Index, min_score: float) -> list[tuple[int, float, int, int, int]]:
    """(item, score, matched, start, end) of every item found in one document."""
    by = index.by_item(pos, at)
    out = []
    for k, found in by.items():
        ids = index.ids[k]
        m, best = len(ids), None
        enough = min(MIN_SEEDS, len(index.of_item[k]))
        if len({g for _, g in found}) < enough:
            continue
        found.sort()
        runs, run = [], [found[0]]
        for f in found[1:]:
            if f[0] - run[-1][0] > m:
                runs.append(run)
                run = []
            run.append(f)
        runs.append(run)
        for run in runs:
            if len({g for _, g in run}) < enough:
                continue
            # a run longer than this is a text of the item's own words over and over: any stretch of it will do
            lo = max(0, run[0][0] - m)
            for start in range(lo, run[-1][0] + m, 8 * m):
                part = x[start:min(run[-1][0] + 2 * m, start + 10 * m)]
                if not within_reach(ids, part, min_score):
                    continue
                top, matched, a, b = aligned(ids, part)
                got = (top / (MATCH * m), matched, start + a, start + b)
                if best is None or got > best:
                    best = got
        if best and best[0] >= min_score:
            out.append((k, *best))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Distinct (item_id, text) rows, dealt by a hash of both into blocks of about ``block_bytes``."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = -(-total // block_bytes)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        if got := [(r.item_id, r.text) for r in part.collect()]:
            yield got


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score, matched, start_word, end_word of every item found in a document."""
    spark, out = docs.sparkSession, None
    for items in _blocks(benchmark, block_bytes):
        index = Index(items)
        if not len(index.grams):
            continue

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    x = index.numbers(t)
                    rows += [(d, index.items[k][0], s, m, a, e) for k, s, m, a, e in hits(x, *index.find(x), index, min_score)]
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "item_id", "score", "matched", "start_word", "end_word"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the documents in which an item of the benchmark is found."""
    return anti_by_id(docs, materialize(leaks(docs, benchmark, min_score).select("doc_id").distinct(), "leaks-gone"), "doc_id")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
