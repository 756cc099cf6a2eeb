"""Periodic runs of words, after Kolpakov and Kucherov.

A run is a stretch of consecutive words with smallest period q and at least
``max(MIN_WORDS, EXPONENT * q)`` words that no neighbouring word extends keeping q.

A text is cut into LZ factors, each the longest stretch that also begins earlier, read off
a suffix automaton. A run that holds or touches a factor's begin is found there by Main's
algorithm: for each period that can cross it, how far do the words on both sides agree with
those one period away? With 4 periods or more, one side holds two, so periods up to half of
the factor (run to the right) or a third of it and the factor before (run to the left) are
all that can be met. Every other run lies strictly inside a factor and is copied from the
factor's earlier occurrence.

The method runs on what an exact screen leaves of a text: a run's every stretch of 4 words
recurs one period away, so places whose nearest recurrence is farther than a quarter of the
recurring stretch around them lie in no run. Texts that hardly repeat cost one sort.

Texts are read in slices of Arrow batches; a document is one row of one task, and nothing is
shuffled. A suffix automaton takes some 300 bytes a word of the longest repetitive stretch.

Defined results: null and empty texts have no words, no runs and an empty collapsed text;
repeated rows give a row each; null ids are kept; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import table

EXPONENT, MIN_WORDS = 4, 6
#: Words of a screened stretch; runs of 4 periods and 6 words hold enough of them.
GRAM = 4
SLICE_BYTES = 4 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
Run = tuple[int, int, int]  # begin, end (exclusive), period


# --- screen ------------------------------------------------------------------

def _stretches(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal stretches of True."""
    edge = np.diff(np.concatenate([[0], ok.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def screen(codes: np.ndarray, offsets: np.ndarray, passes: int = 8) -> list[tuple[int, int]]:
    """Stretches of words, within the documents of ``offsets``, outside which no run lies.

    Equal hashes of unequal words only widen them."""
    n = len(codes) - GRAM + 1
    if n < MIN_WORDS - GRAM + 1:
        return []
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    h = doc[:n] * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(GRAM):
        h = (h + codes[k:n + k].astype(np.uint64) + np.uint64(1)) * _P
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    gap = np.where(same, np.diff(order), n + 1)
    near = np.full(n, n + 1)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    near[doc[:n] != doc[GRAM - 1:]] = n + 1  # across two documents
    ok = near <= n
    for _ in range(passes):
        begin, end = _stretches(ok)
        size = end - begin
        most = np.where(size + GRAM - 1 >= MIN_WORDS, (size + GRAM - 1) // EXPONENT, 0)
        kept = ok.copy()
        kept[ok] = near[ok] <= np.repeat(most, size)
        if kept.sum() == ok.sum():
            break
        ok = kept
    begin, end = _stretches(ok)
    return [(b, e + GRAM - 1) for b, e in zip(begin.tolist(), end.tolist(), strict=True) if e - b + GRAM - 1 >= MIN_WORDS]


# --- factors -----------------------------------------------------------------

def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """LZ factors (begin, length, begin of an earlier occurrence or -1), from a suffix automaton."""
    step: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        now = len(step)
        step.append({})
        size.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    out, at, n = [], 0, len(w)
    while at < n:
        state, end, source = 0, at, -1
        while end < n:
            state = step[state][w[end]]
            if first[state] >= end:  # the first time these words end is here
                break
            source = first[state]
            end += 1
        length = max(1, end - at)
        out.append((at, length, source - length + 1 if end > at else -1))
        at += length
    return out


# --- Main's algorithm --------------------------------------------------------

def _ahead(w: np.ndarray, a: int, b: int) -> int:
    """How many words from a on equal those from b on (a < b)."""
    n, got, step = len(w) - b, 0, 64
    while got < n:
        k = min(step, n - got)
        differ = w[a + got:a + got + k] != w[b + got:b + got + k]
        if differ.any():
            return got + int(differ.argmax())
        got, step = got + k, step * 4
    return n


def _crossing(w: np.ndarray, lz: list[tuple[int, int, int]]) -> set[Run]:
    """Runs that hold or touch the begin of a factor, or the end of the text."""
    n = len(w)
    begin = np.array([b for b, _, _ in lz] + [n])
    size = np.array([k for _, k, _ in lz] + [0])
    before = np.concatenate([[0], size[:-1]])
    back = w[::-1]

    def pairs(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.repeat(begin, most)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most) + 1

    def alike(most: np.ndarray, side) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of begin and period for which three of the words that must agree do."""
        b, q = pairs(most)
        for j in (lambda q: q * 0, lambda q: q - 1, lambda q: q // 2):
            x, y = side(b, q, j(q))
            ok = w[x] == w[y]
            b, q = b[ok], q[ok]
        return b, q

    found = set()
    b, q = alike(np.minimum(size // 2, (n - begin) // 2), lambda b, q, j: (b + j, b + q + j))  # two periods to the right
    right = list(zip(b.tolist(), q.tolist(), strict=True))
    b, q = alike(np.minimum((size + before) // 3 + 1, begin // 2), lambda b, q, j: (b - 1 - j, b - 1 - q - j))  # to the left
    left = list(zip((b - q).tolist(), q.tolist(), strict=True))
    done: dict[int, int] = {}  # period: end of its last run, whose other crossings need no second look
    for x, q in sorted(right + left):
        if done.get(q, -1) >= x + q:
            continue
        end = x + q + _ahead(w, x, x + q)
        start = x - _ahead(back, n - x - q, n - x)
        if end - start >= 2 * q:
            done[q] = end
        if end - start >= max(MIN_WORDS, EXPONENT * q):
            found.add((start, end, q))
    return found


def runs_of(words) -> list[Run]:
    """All runs of a text of word numbers, by begin, then period."""
    w = np.asarray(words)
    if len(w) < MIN_WORDS:
        return []
    lz = factors(w.tolist())
    runs = sorted(_crossing(w, lz))
    for begin, length, source in lz:
        if source < 0 or length < MIN_WORDS + 2:
            continue
        k = bisect_left(runs, (source + 1, 0, 0))
        while k < len(runs) and runs[k][0] < source + length:
            s, e, q = runs[k]
            if e < source + length:
                copy = (s + begin - source, e + begin - source, q)
                at = bisect_left(runs, copy)
                if at == len(runs) or runs[at] != copy:
                    insort(runs, copy)
            k += 1
    least: dict[tuple[int, int], int] = {}
    for s, e, q in runs:
        least[s, e] = min(q, least.get((s, e), q))
    return sorted(((s, e, q) for (s, e), q in least.items()), key=lambda r: (r[0], r[2]))


# --- documents ---------------------------------------------------------------

def split_words(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Texts with single spaces, all words (dictionary-encoded) and where each text's begin."""
    trimmed = pc.ascii_trim_whitespace(texts)
    lists = pc.ascii_split_whitespace(trimmed)
    words = lists.flatten()
    words = words.filter(pc.not_equal(words, ""))
    filled = pc.greater(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    many = np.where(filled, pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0)
    return pc.binary_join(lists, " "), words.dictionary_encode(), np.concatenate([[0], np.cumsum(many)]).astype(np.int64)


def batch_runs(codes: np.ndarray, offsets: np.ndarray, screened: bool = True) -> dict[int, list[Run]]:
    """Runs of the documents that have any, by their number in the batch."""
    parts = screen(codes, offsets) if screened else list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    out: dict[int, list[Run]] = {}
    for b, e in parts:
        if got := runs_of(codes[b:e]):
            d = int(np.searchsorted(offsets, b, "right")) - 1
            shift = b - int(offsets[d])
            out.setdefault(d, []).extend((s + shift, t + shift, q) for s, t, q in got)
    return {d: sorted(r, key=lambda x: (x[0], x[2])) for d, r in out.items()}


def strongest(runs: list[Run]) -> Run:
    """The run with most periods, by exact fractions; ties to the least begin, then period."""
    best = runs[0]
    for r in runs[1:]:
        a, b = (r[1] - r[0]) * best[2], (best[1] - best[0]) * r[2]
        if a > b or (a == b and (r[0], r[2]) < (best[0], best[2])):
            best = r
    return best


def collapsed(words: np.ndarray, runs: list[Run]) -> np.ndarray:
    """The words that no run repeats: of each run the first period stays unless another run drops it."""
    keep = np.ones(len(words), bool)
    for s, e, q in runs:
        keep[s + q:e] = False
    return words[keep]


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(documents: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run (start, length, period, exponent_milli), runs and the collapsed text."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column("text"), "")
            upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_BYTES, "right")))
                joined, words, offsets = split_words(texts.slice(at, end - at))
                codes = words.indices.to_numpy()
                found = batch_runs(codes, offsets)
                n = end - at
                best, lists = [None] * n, [[]] * n
                at_most = np.zeros(n, bool)
                short = []
                for d in sorted(found):
                    s, e, q = strongest(found[d])
                    best[d] = (s, e - s, q, 1000 * (e - s) // q)
                    lists[d] = [{"start": s, "length": e - s, "period": q} for s, e, q in found[d]]
                    left = collapsed(codes[offsets[d]:offsets[d + 1]], found[d])
                    short.append(" ".join(words.dictionary.take(pa.array(left)).to_pylist()))
                    at_most[d] = True
                text = pc.replace_with_mask(joined, pa.array(at_most), pa.array(short, pa.string()))
                columns = [pa.array([x and x[k] for x in best], pa.int64()) for k in range(4)]
                counts = pa.array([len(x) for x in lists], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, n), counts, *columns, pa.array(lists, pa.list_(run_type)), text],
                    ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"],
                )
                at = end

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _SCHEMA)


# --- the query ---------------------------------------------------------------

def repeat_tail(doc_id: int, text: str) -> str:
    """The query's edit: one document in ten repeats a stretch from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    words = text.encode("utf-8", "surrogatepass").split()
    if h % 10 or not words:
        return text
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a:a + p]
    tail = (period * ((n - a) // p + 1))[:n - a]
    return b" ".join(words[:a] + tail).decode("utf-8", "surrogatepass")


def with_repeats(documents: DataFrame) -> DataFrame:
    """doc_id and text, edited by ``repeat_tail``; null ids and null texts stay as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, text = b.column("doc_id").to_pylist(), b.column("text")
            hit = np.array([i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in ids], bool) & text.is_valid().to_numpy(zero_copy_only=False)
            new = [repeat_tail(ids[k], text[k].as_py()) for k in np.flatnonzero(hit).tolist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.replace_with_mask(text, pa.array(hit), pa.array(new, text.type))], ["doc_id", "text"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text string")


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every edited document, with digests of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return periodic_runs(with_repeats(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
