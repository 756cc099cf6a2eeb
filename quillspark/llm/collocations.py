"""Phrase collocations: merged count-min sketches, an exact second pass, scores and subsumption.

First pass: each task hashes every phrase of 1 to 5 words and its language into the rows of a
count-min sketch. Tasks send the cells that they hit, as gaps and counts saturated at the least
count, in slices; slices of one place are added up in a tree of wide fixed fan-in. What is kept of
the sum is a bit a cell: is it at least the least count? A sketch only overestimates, so a phrase
with a zero bit is rare.

Second pass: phrases whose bits are all set, and whose shorter parts' bits are too, are counted
exactly, by their words: each task adds up its slices of text, one shuffle adds up tasks. Parts
of a frequent phrase are frequent, so both sides of every cut are among the counts.

A wrong survivor costs some bytes and changes nothing, so the sketch's width decides only how
many rare phrases the second pass counts. It grows with the text, so that a cell gets about half the
least count of phrases (2^24 cells a row for 1 GB of text, 2^27 for 8 GB, 2^29 at most: 128 MB of bits
for every task). What a task sends and holds doesn't grow with it but by bits: only cells that it hits count.

Counts are tries: a row is the row of the phrase without its last word, that word's number, and its
occurrences, so a phrase takes some four bytes in the shuffle. A trie is cut into buckets by a hash of
language and first two words; what meets in one bucket is added up as it streams by. A task holds at most
HELD_ROWS counts: beyond that its sums so far go on, and a last aggregate, which can spill, adds them up.

A hot language or phrase is one number a task before the shuffle. Scores use 38-digit integers.

Defined results: null texts are empty, a null language is ``und``; repeated rows count each;
null or empty tables give no rows; extra columns are ignored. Ranks go by score, count, then
phrase in UTF-8 order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize, table

LEAST, LONGEST, TOP, SUBSUME = 100, 5, 2000, 100
ROWS = 2
#: Cells of a row, at least and at most, and of a slice of it, as powers of two; phrases a byte of text.
BITS, MOST_BITS, SLICE_BITS, PER_BYTE = 24, 29, 18, 0.6
#: Sketches added up by one task and slice, and hashes held by a task before it sends their cells.
FAN, HELD_HASHES = 1024, 1 << 23
SLICE_BYTES = 4 << 20
EXACT_BYTES = 4 << 20
#: Buckets of phrases, and rows of counts held before they are added up.
BUCKETS, HELD_ROWS = 128, 1_000_000
#: Languages whose totals are sent to all phrases; more meet them by a shuffle.
MANY_LANGS = 10_000
UNKNOWN = "und"
_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


# --- words and phrases of a slice of texts -------------------------------------

class Words:
    """Words of some texts: their bytes end to end, where each begins, and its piece and text."""

    def __init__(self, texts: pa.Array):
        low = pc.ascii_lower(texts)
        at = np.frombuffer(low.buffers()[1], np.int32)[low.offset:low.offset + len(low) + 1].astype(np.int64)
        raw = np.frombuffer(low.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        kind = _KIND[raw]
        word = kind == 0
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        first = at[:-1][at[:-1] < at[1:]]
        begins[first] = word[first]  # a text begins a word of its own
        start = np.flatnonzero(begins)
        self.text = np.searchsorted(at, start, "right") - 1
        self.piece = np.cumsum(kind == 2, dtype=np.int64)[start] + self.text
        self.bytes = raw[word]
        self.begin = (np.cumsum(word, dtype=np.int64)[start] - 1) if len(start) else np.zeros(0, np.int64)
        self.n = len(start)

    def hashes(self) -> np.ndarray:
        """64 bits of each word; equal words have equal ones."""
        return word_hashes(self.bytes, self.begin)

    def encoded(self) -> pa.DictionaryArray:
        offsets = np.append(self.begin, len(self.bytes)).astype(np.int32)
        return pa.StringArray.from_buffers(self.n, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.bytes))).dictionary_encode()


def word_hashes(raw: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64 bits of each of the words that lie end to end."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = np.diff(begin, append=len(raw))
    place = np.arange(len(raw)) - np.repeat(begin, size)
    h = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[place], begin)
    return mix(h + size.astype(np.uint64))


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, _A)) if n else np.zeros(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _C
    return h ^ (h >> np.uint64(32))


def lang_hash(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode(), np.uint8).astype(np.uint64)
    return mix(np.array([((raw + np.uint64(1)) * _powers(len(raw))).sum()], np.uint64))[0] if len(raw) else np.uint64(0)


def phrase_hashes(words: Words, langs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2 … LONGEST words: places where a phrase begins, and its hash."""
    h = words.hashes()
    by_lang = {x: lang_hash(x) for x in set(langs)}
    now = mix(h ^ np.array([by_lang[x] for x in langs] or [0], np.uint64)[words.text]) if words.n else h
    at = np.arange(words.n)
    yield at, now
    for k in range(1, LONGEST):
        ok = (at + k < words.n)
        at, now = at[ok], now[ok]
        ok = words.piece[at] == words.piece[at + k]
        at, now = at[ok], now[ok]
        now = mix(now * _A + h[at + k])
        yield at, now


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cells in a row of the sketch."""
    return (h >> np.uint64(32 * row)).astype(np.uint32) >> np.uint32(32 - bits)


def _slices(b: pa.RecordBatch, most: int) -> Iterator[tuple[pa.Array, list[str]]]:
    texts = pc.fill_null(b.column("text"), "")
    langs = pc.fill_null(b.column("lang"), UNKNOWN).to_pylist()
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, end - at), langs[at:end]
        at = end


# --- first pass ------------------------------------------------------------------

def _held(least: int) -> np.dtype:
    """The type of counts that stop at ``least``."""
    return np.dtype(np.uint8 if least < 1 << 8 else np.uint16 if least < 1 << 16 else np.uint32)


def width_for(documents: DataFrame, least: int) -> int:
    """Bits of a row that leaves a cell about half of ``least`` phrases."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(BITS, math.ceil(math.log2(max(1, 2 * PER_BYTE * size / least)))))


_SLICES = "part long, slot long, cells int, counts binary"


def sketches(documents: DataFrame, bits: int, least: int) -> DataFrame:
    """part, slot, cells, counts: every task's sketch in slices, saturated at ``least``, as the cells that aren't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part = [], 0, TaskContext.get().partitionId()
        for b in batches:
            for texts, langs in _slices(b, SLICE_BYTES):
                for _, h in phrase_hashes(Words(texts), langs):
                    held.append(h)
                    size += len(h)
                if size > HELD_HASHES:
                    yield from _sketch(part, held, bits, least)
                    held, size = [], 0
        if size:
            yield from _sketch(part, held, bits, least)

    return documents.mapInArrow(run, _SLICES)


def _sketch(part: int, hashes: list[np.ndarray], bits: int, least: int) -> Iterator[pa.RecordBatch]:
    width = min(SLICE_BITS, bits)
    for row in range(ROWS):
        cell = np.concatenate([cells(h, row, bits) for h in hashes])
        cell.sort()
        edges = np.searchsorted(cell, np.arange(1 << (bits - width), dtype=np.uint32) << np.uint32(width)).tolist()
        found = []
        for slot, (lo, hi) in enumerate(pairwise([*edges, len(cell)])):
            if lo < hi:
                c = cell[lo:hi] & np.uint32((1 << width) - 1)
                first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
                found.append(_sliced((row << (bits - width)) + slot, c[first].astype(np.int64), np.diff(first, append=len(c)), least))
        yield _rows_of(part, found)


def _sliced(slot: int, at: np.ndarray, n: np.ndarray, least: int) -> tuple[int, int, bytes]:
    """Ascending cells of a slice, and what they count: the low and high bytes of gaps, then counts."""
    gap = np.diff(at, prepend=0)
    raw = gap.astype(np.uint8).tobytes() + (gap >> 8).astype(np.uint16).tobytes() + np.minimum(n, least).astype(_held(least)).tobytes()
    return slot, len(at), pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _rows_of(part: int, found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    slots, sizes, raw = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array([part] * len(slots), pa.int64()), pa.array(slots, pa.int64()), pa.array(sizes, pa.int32()), pa.array(raw, pa.binary())], ["part", "slot", "cells", "counts"])


def _unsliced(n: int, raw: pa.Buffer, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells within a slice, and their counts."""
    kind = _held(least)
    got = pa.Codec("zstd").decompress(raw, n * (3 + kind.itemsize))
    gap = np.frombuffer(got, np.uint8, n).astype(np.int64) + (np.frombuffer(got, np.uint16, n, n).astype(np.int64) << 8)
    return np.cumsum(gap), np.frombuffer(got, kind, n, 3 * n)


def merged(slices: DataFrame, bits: int, least: int) -> DataFrame:
    """Slices of one slot and part added up."""
    width = min(SLICE_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def done() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return _rows_of(key[0], [_sliced(key[1], at, total[at], least)])

        for b in batches:
            for part, slot, n, raw in zip(*(b.column(c).to_pylist() for c in ("part", "slot", "cells")), b.column("counts"), strict=True):
                if (part, slot) != key:
                    if key is not None:
                        yield done()
                    key, total = (part, slot), np.zeros(1 << width, np.uint64)
                at, f = _unsliced(n, raw.as_buffer(), least)
                total[at] += f
        if key is not None:
            yield done()

    return slices.repartition("part", "slot").sortWithinPartitions("part", "slot").mapInArrow(run, _SLICES)


def frequent_bits(documents: DataFrame, bits: int, least: int) -> np.ndarray:
    """For each row of the merged sketch, a bit a cell: does it reach ``least``? (ROWS x 2^bits / 8 bytes)"""
    width = min(SLICE_BITS, bits)
    now, written = sketches(documents, bits, least), []
    while True:
        now = materialize(merged(now.withColumn("part", F.floor(F.col("part") / FAN)), bits, least), "sketches")
        written.append(now)
        if not now.agg(F.max("part")).first()[0]:
            break

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for n, raw in zip(b.column("cells").to_pylist(), b.column("counts"), strict=True):
                at, f = _unsliced(n, raw.as_buffer(), least)
                full = np.zeros(1 << width, bool)
                full[at[f >= least]] = True
                got.append(np.packbits(full).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("slot"), pa.array(got, pa.binary())], ["slot", "bits"])

    out = np.zeros((ROWS << (bits - width), (1 << width) // 8), np.uint8)
    for r in now.mapInArrow(reach, "slot long, bits binary").toLocalIterator():
        out[r.slot] = np.frombuffer(r.bits, np.uint8)
    discard(*written)
    return out.reshape(ROWS, -1)


# --- second pass -----------------------------------------------------------------

def _set(bits: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for r, row in enumerate(bits):
        cell = cells(h, r, width)
        ok &= (row[cell >> np.uint32(3)] >> (np.uint32(7) - (cell & np.uint32(7))) & 1).astype(bool)
    return ok


class Counts(NamedTuple):
    """Phrases as a trie. ``levels`` has the phrases of 0, 1 … LONGEST words (of 0: all words of a language), in
    order of their first two arrays: row of the phrase without its last word, number of that word (of 0: of the
    language), occurrences."""

    langs: pa.Array
    words: pa.Array
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @property
    def size(self) -> int:
        return sum(len(f) for _, _, f in self.levels)


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its place among the distinct ones, and those, ascending."""
    ids, distinct = pd.factorize(key)
    order = np.argsort(distinct)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[ids], distinct[order]


def slice_counts(texts: pa.Array, langs: list[str], bits: np.ndarray, width: int) -> Counts:
    """Exact counts, in these texts, of the phrases that the sketch lets through."""
    w = Words(texts)
    names = sorted(set(langs))
    number = {x: i for i, x in enumerate(names)}
    lang = np.array([number[x] for x in langs], np.int64)[w.text] if w.n else np.zeros(0, np.int64)
    encoded = w.encoded()
    code, n = encoded.indices.to_numpy().astype(np.int64), max(1, len(encoded.dictionary))
    levels = [(np.zeros(len(names), np.int64), np.arange(len(names)), np.bincount(lang, minlength=len(names)))]
    alive = np.zeros(w.n + 1, bool)
    same = np.zeros(w.n + 1, np.int64)  # row of the phrase that begins here
    for k, (at, h) in enumerate(phrase_hashes(w, langs), 1):
        ok = _set(bits, h, width)
        if k > 1:
            ok &= alive[at] & alive[at + 1]
        at = at[ok]
        ids, distinct = _numbered((lang[at] if k == 1 else same[at]) * n + code[at + k - 1])
        alive[:] = False
        alive[at] = True
        same[at] = ids
        levels.append((distinct // n, distinct % n, np.bincount(ids, minlength=len(distinct))))
    used = np.unique(levels[1][1])  # words of longer phrases are among them
    levels[1:] = [(before, np.searchsorted(used, last), f) for before, last, f in levels[1:]]
    return Counts(pa.array(names, pa.string()), encoded.dictionary.take(pa.array(used)), levels)


def _joined(parts: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct strings of all parts, and for each part their numbers."""
    both = pa.concat_arrays(parts).dictionary_encode()
    return both.dictionary, np.split(both.indices.to_numpy().astype(np.int64), np.cumsum([len(x) for x in parts])[:-1])


def added(held: list[Counts]) -> Counts:
    """Counts added up."""
    if len(held) == 1:
        return held[0]
    langs, lang_of = _joined([x.langs for x in held])
    words, word_of = _joined([x.words for x in held])
    rows, levels = [np.zeros(1, np.int64)] * len(held), []
    for k in range(LONGEST + 1):
        n, last_of = max(1, len(words if k else langs)), word_of if k else lang_of
        ids, distinct = _numbered(np.concatenate([rows[i][x.levels[k][0]] * n + last_of[i][x.levels[k][1]] for i, x in enumerate(held)]))
        f = np.zeros(len(distinct), np.int64)
        np.add.at(f, ids, np.concatenate([x.levels[k][2] for x in held]))
        levels.append((distinct // n, distinct % n, f))
        rows = np.split(ids, np.cumsum([len(x.levels[k][2]) for x in held])[:-1])
    return Counts(langs, words, levels)


def _packed(t: Counts) -> pa.RecordBatch:
    """bucket, counts: counts cut by a hash of language and first two words, and compressed. Shorter phrases stand, as
    many as they occur, in a bucket of their own, and with none where longer ones need them."""
    offsets = np.frombuffer(t.words.buffers()[1], np.int32)[t.words.offset:t.words.offset + len(t.words) + 1].astype(np.int64) if len(t.words) else np.zeros(1, np.int64)
    word = word_hashes(np.frombuffer(t.words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]], offsets[:-1] - offsets[0])
    h, of = np.array([lang_hash(x) for x in t.langs.to_pylist()], np.uint64), []
    for k, (before, last, _) in enumerate(t.levels):
        if k:
            h = mix(h[before] * _A + word[last]) if k < 3 else h[before]
        of.append((h % np.uint64(BUCKETS)).astype(np.int64))
    n = [max(1, len(x)) for x in of]
    placed = [np.sort(x * m + np.arange(len(x))) for x, m in zip(of, n, strict=True)]  # bucket and row as one number
    for k in (1, 0):
        bucket, row = np.divmod(placed[k + 1], n[k + 1])
        placed[k] = np.union1d(placed[k], bucket * n[k] + t.levels[k + 1][0][row])
    begins = [np.searchsorted(x, np.arange(BUCKETS + 1) * m) for x, m in zip(placed, n, strict=True)]
    columns = []
    for k, (before, last, f) in enumerate(t.levels):
        bucket, row = np.divmod(placed[k], n[k])
        up = np.searchsorted(placed[k - 1], bucket * n[k - 1] + before[row]) - begins[k - 1][bucket] if k else before[row]
        columns.append((up, last[row], np.where(of[k][row] == bucket, f[row], 0)))
    keys, out = [], []
    for b in range(BUCKETS):
        part = [tuple(c[x[b]:x[b + 1]] for c in col) for x, col in zip(begins, columns, strict=True)]
        if len(part[0][0]):
            used, last = np.unique(np.concatenate([x[1] for x in part[1:]]), return_inverse=True)
            keys.append(b)
            out.append(_bytes([len(x[0]) for x in part], t.langs.take(pa.array(part[0][1])), t.words.take(pa.array(used)), np.concatenate([np.diff(x[0], prepend=0) for x in part]), last, np.concatenate([x[2] for x in part])))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(out, pa.binary())], ["bucket", "counts"])


def _bytes(sizes: list[int], langs: pa.Array, words: pa.Array, up: np.ndarray, last: np.ndarray, f: np.ndarray) -> bytes:
    def row(x: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    small = [row(pa.array(x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)))) for x in (up, last, f)]
    whole = pc.binary_join(row(words), " ")  # no word has a space
    t = pa.RecordBatch.from_arrays([row(pa.array(sizes, pa.int64())), row(langs), whole, *small], ["sizes", "langs", "words", "up", "last", "f"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(t)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: pa.Buffer) -> Counts:
    t = pa.ipc.open_stream(raw).read_next_batch()
    sizes, up, last, f = (t.column(c).flatten().to_numpy().astype(np.int64) for c in ("sizes", "up", "last", "f"))
    cuts = np.cumsum(sizes)[:-1]
    last = np.concatenate([np.arange(sizes[0]), last])
    words = pc.split_pattern(t.column("words"), " ").flatten() if len(t.column("words")[0].as_py()) else pa.array([], pa.string())
    return Counts(t.column("langs").flatten(), words, list(zip([np.cumsum(x) for x in np.split(up, cuts)], np.split(last, cuts), np.split(f, cuts), strict=True)))


def _listed(t: Counts, least: int) -> Iterator[pa.RecordBatch]:
    """lang, words, phrase, f of phrases with at least ``least`` occurrences, and of languages."""
    for k, (_, _, f) in enumerate(t.levels):
        at = row = np.flatnonzero(f >= (least if k else 1))
        words = []
        for before, last, _ in t.levels[k:0:-1]:
            words.insert(0, t.words.take(pa.array(last[row])))
            row = before[row]
        phrase = pc.binary_join_element_wise(*words, " ") if k > 1 else words[0] if k else pa.array([""] * len(at), pa.string())
        yield pa.RecordBatch.from_arrays([t.langs.take(pa.array(t.levels[0][1][row])), pa.array(np.full(len(at), k, np.int32)), phrase, pa.array(f[at].astype(np.int64))], ["lang", "words", "phrase", "f"])


def phrase_counts(documents: DataFrame, least: int = LEAST, width: int | None = None) -> DataFrame:
    """lang, words, phrase, f: every phrase of 1 to LONGEST words with at least ``least`` occurrences, exactly;
    with 0 words and an empty phrase, all words of a language."""
    rows = documents.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    if width is None:
        width = width_for(rows, least)
    bits = rows.sparkSession.sparkContext.broadcast(frequent_bits(rows, width, least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for texts, langs in _slices(b, EXACT_BYTES):
                held.append(slice_counts(texts, langs, bits.value, width))
                size += held[-1].size
                if size > HELD_ROWS:
                    held = [added(held)]
                    size = held[0].size
                    if 2 * size > HELD_ROWS:
                        yield _packed(held[0])
                        held, size = [], 0
        if held:
            yield _packed(added(held))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, size, parted = None, [], 0, False
        for b in batches:
            for k, raw in zip(b.column("bucket").to_pylist(), b.column("counts"), strict=True):
                if k != bucket:
                    if held:  # if nothing of this bucket has gone before, these are the totals
                        yield from _listed(added(held), 1 if parted else least)
                    bucket, held, size, parted = k, [], 0, False
                held.append(_unpacked(raw.as_buffer()))
                size += held[-1].size
                if size > HELD_ROWS:
                    held = [added(held)]
                    size = held[0].size
                    if 2 * size > HELD_ROWS:  # more phrases than a task should hold: their sums go on as they are
                        yield from _listed(held[0], 1)
                        held, size, parted = [], 0, True
        if held:
            yield from _listed(added(held), 1 if parted else least)

    packed = rows.mapInArrow(count, "bucket int, counts binary").repartition("bucket").sortWithinPartitions("bucket")
    sums = packed.mapInArrow(total, "lang string, words int, phrase string, f long")
    return sums.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least))


# --- scores ----------------------------------------------------------------------

def collocations(documents: DataFrame, least: int = LEAST, subsume: int = SUBSUME, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's phrases of 2 to LONGEST words by their weakest cut.

    A phrase goes if a longer frequent one holds it with at least ``subsume`` hundredths of its occurrences."""
    counts = materialize(phrase_counts(documents, least), "phrases")
    part = counts.where("words > 0").select("lang", "phrase", "f")
    word = F.split("phrase", " ")
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), word.alias("w"))

    def of(begin, size):
        return F.array_join(F.slice("w", begin, size), " ")

    cuts = candidates.select("lang", "phrase", "a", "words", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", of(F.lit(1), F.col("cut")).alias("left"), of(F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right")
    )
    sides = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    sides = sides.join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    whole = F.expr("(1000BD * cast(a as decimal(19,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    few = totals.limit(MANY_LANGS + 1).count() <= MANY_LANGS
    scored = sides.join(F.broadcast(totals) if few else totals, "lang").withColumn("score", whole)
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")

    inner = candidates.where("words > 2").select("lang", "a", "w", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("begin"))
    held = inner.select("lang", of(F.col("begin"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < subsume * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The same by counting every phrase.
OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0B\f\r]')) AS piece FROM d),
w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[ \t]+') IF x <> ''] AS w FROM p),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w CROSS JOIN range(1, 6) AS s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 100),
cut AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, j, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = lp JOIN f y ON y.lang = cut.lang AND y.phrase = rp JOIN n ON n.lang = cut.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = m.lang AND len(c.phrase) > len(m.phrase)
  AND contains(' ' || c.phrase || ' ', ' ' || m.phrase || ' ') AND 100 * c.a >= 100 * m.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""
