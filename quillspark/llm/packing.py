"""Packing along a space-filling curve.

A document becomes its token ids and one end id, and a point: token ids are hashed with
signs into a vector (logarithms of counts, unit length), which a fixed random matrix
projects to a few dimensions. Each dimension is cut at quantiles over all documents, the
Hilbert index of the resulting cube is the document's place on the curve, and documents
are laid end to end along it. Where they lie is a running sum: sums over range cells of
the curve, then rows within a cell in order. The line is cut every ``size`` ids, so that
a sequence holds neighbours; what is left after the last whole sequence is cut into powers
of two, so nothing is padded.

Tokens are made once and written with the points; one shuffle by cell brings them in
order. The low bits of a place are a hash of the point and of the row, so any number of
equal documents is spread over cells, and no cell is more than a stream of rows to its task.
The driver holds the quantiles and one number a cell (at most MAX_CELLS).

Tokenisation: the tokenizer lowers case and never lets a token span white space or the end
of a run of letters before a sign, and what comes before such a place doesn't change what
comes after. So texts are cut there, each word is encoded once (a bounded memo a worker),
and the ids of a text are those of its words in order. Texts that hold a mark of the
tokenizer's own are encoded whole. Another tokenizer needs the same property.

Defined results: a null or empty text is its end id alone; repeated rows are documents of
their own; null ids are kept; an empty table gives no rows; extra columns are ignored. A
document is one row of one task: its ids, 2 or 4 bytes each, must fit in memory.
"""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cell_bounds, cell_of, materialize, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SIZE = 2048
BUCKETS, DIMS, BITS = 256, 4, 8
SEED = 13
#: Text handled at once, and words remembered, in a worker.
SLICE_BYTES = 8 << 20
MEMO = 300_000
_memo: dict[str, list[dict[str, bytes]]] = {}
_AFTER_WORD = r"([a-z])([!-/:-@\[-`{-~])"


def tokenizer_path(name: str) -> str:
    """A name of the public collection, or a path as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(tokenizer_path(name)))


@functools.cache
def id_type(name: str) -> np.dtype:
    return np.dtype("<u2" if tokenizer(name).get_vocab_size() <= 1 << 16 else "<u4")


def word_ids(words: list[str], name: str) -> list[bytes]:
    """Ids of each word, as bytes of ``id_type``; words of the last two generations are remembered."""
    young, old = _memo.setdefault(name, [{}, {}])
    got = list(map(young.get, words))
    new = [w for w, g in zip(words, got, strict=True) if g is None]
    if new:
        kind = "H" if id_type(name).itemsize == 2 else "I"
        found = list(map(old.get, new))
        lost = [w for w, g in zip(new, found, strict=True) if g is None]
        fresh = iter([array(kind, e.ids).tobytes() for e in tokenizer(name).encode_batch_fast(lost, add_special_tokens=False)])
        found = [next(fresh) if g is None else g for g in found]
        if len(young) + len(new) > MEMO:
            _memo[name] = [young := {}, _memo[name][0]]
        young.update(zip(new, found, strict=True))
        it = iter(found)
        got = [next(it) if g is None else g for g in got]
    return got


def encode(texts: pa.Array, name: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, end ids included, and where each text's begin (one more offset than texts)."""
    kind = id_type(name)
    marked = np.zeros(len(texts), bool)
    for mark in tokenizer(name).get_added_tokens_decoder().values():
        marked |= pc.match_substring(texts, mark.content).to_numpy(zero_copy_only=False)
    if marked.any():  # texts with the tokenizer's own marks are encoded whole
        whole = tokenizer(name).encode_batch_fast(texts.filter(pa.array(marked)).to_pylist(), add_special_tokens=False)
        texts = pc.if_else(pa.array(marked), pa.scalar(""), texts)
    split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), _AFTER_WORD, r"\1 \2"))
    words = split.flatten().dictionary_encode()
    known = word_ids(words.dictionary.to_numpy(zero_copy_only=False).tolist(), name)
    at = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
    ends = np.full(len(texts), len(known))
    known.append(np.array([end_id], kind).tobytes())
    if marked.any():  # such a text is one word
        ends[marked] += 1 + np.arange(len(whole))
        known += [np.array([*e.ids, end_id], kind).tobytes() for e in whole]
    sizes = np.fromiter(map(len, known), np.int64, len(known)) // kind.itemsize
    flat = np.frombuffer(b"".join(known), kind)
    codes = np.insert(words.indices.to_numpy(), at, ends)
    sizes_of = sizes[codes]
    upto = np.cumsum(sizes_of)
    ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - upto + sizes_of, sizes_of) + np.arange(int(upto[-1]) if len(upto) else 0)]
    return ids, np.concatenate([[0], upto[at + np.arange(len(at))]]).astype(np.int64)


@functools.cache
def _hashing(buckets: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each id's bucket and sign, and the projection; fixed by SEED."""
    rng = np.random.default_rng(SEED)
    n = 1 << 16
    return rng.integers(0, buckets, n), rng.choice([-1.0, 1.0], n), rng.normal(size=(buckets, dims))


def points(ids: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    """The projected document vectors."""
    bucket, sign, project = _hashing(buckets, dims)
    low, n = ids & 0xFFFF, len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(offsets))
    v = np.bincount(of * buckets + bucket[low], weights=sign[low], minlength=n * buckets).reshape(n, buckets)
    v = np.sign(v) * np.log1p(np.abs(v))
    return np.einsum("ij,jk->ik", v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), project)


def hilbert(cube: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points of a cube (rows of ``bits``-bit coordinates)."""
    x = cube.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess turns, highest bit first
        p = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def _slices(b: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows of a batch with their texts (null: empty), about ``most`` bytes at a time."""
    texts = pc.fill_null(b.column("text"), "")
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield b.slice(at, end - at), texts.slice(at, end - at)
        at = end


def tokens(documents: DataFrame, name: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """doc_id, rid, n_tokens, ids (bytes), at (the point): a row for each row of ``documents``."""
    schema = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("at", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, texts in _slices(b):
                ids, offsets = encode(texts, name, end_id)
                p = points(ids, offsets)
                raw = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((offsets * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                at = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * DIMS), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("rid"), pa.array(np.diff(offsets)), raw, at], schema=schema)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, rid long, n_tokens long, ids binary, at array<double>")


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with place: the Hilbert index above hashes of the point and of the row."""
    levels = 1 << BITS
    shares = [i / levels for i in range(1, levels)]
    got = rows.agg(*[F.percentile_approx(F.col("at")[i], shares, 10 * levels).alias(f"c{i}") for i in range(DIMS)]).first()
    cuts = [np.array(c or [], np.float64) for c in got]

    def place(at: pd.Series) -> pd.Series:
        p = np.vstack(at.to_numpy()) if len(at) else np.zeros((0, DIMS))
        return pd.Series(hilbert(np.stack([np.searchsorted(c, p[:, i], "right") for i, c in enumerate(cuts)], 1), BITS))

    curve = F.pandas_udf(place, "long")("at")
    low = F.shiftleft(F.xxhash64("at").bitwiseAND(0x7FFF), 16) + F.xxhash64("doc_id", "rid").bitwiseAND(0xFFFF)
    return rows.withColumn("place", F.shiftleft(curve, 31) + low).drop("at")


def _tail(rest: int) -> np.ndarray:
    """Powers of two that add up to ``rest``, largest first."""
    return np.array([1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)


class Layout:
    """Which sequence each position of the line lies in."""

    def __init__(self, total: int, size: int):
        self.size, self.whole = size, total // size
        self.tail = np.concatenate([[0], np.cumsum(_tail(total % size))]).astype(np.int64)

    def sequence(self, at: np.ndarray) -> np.ndarray:
        over = at - self.whole * self.size
        return np.where(over < 0, at // self.size, self.whole + np.searchsorted(self.tail, over, "right") - 1)

    def begin(self, sequence: np.ndarray) -> np.ndarray:
        over = np.clip(sequence - self.whole, 0, len(self.tail) - 1)
        return np.minimum(sequence, self.whole) * self.size + self.tail[over]


def pack(documents: DataFrame, size: int = SIZE, name: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids: the pieces of all documents in sequences
    of ``size`` ids; ids are unsigned 32-bit numbers, little-endian, as bytes."""
    rows = _placed(materialize(tokens(documents, name, end_id), "tokens"))
    bounds = cell_bounds(rows, "place", rows.count())
    celled = rows.withColumn("cell", cell_of(F.col("place"), bounds))
    sums = {r.cell: r.n for r in celled.groupBy("cell").agg(F.sum("n_tokens").alias("n")).collect()}
    per_cell = np.array([sums.get(i, 0) for i in range(len(bounds) + 1)], np.int64)
    begins, layout = np.cumsum(per_cell) - per_cell, Layout(int(per_cell.sum()), size)
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, at, kind = None, 0, id_type(name)
        for b in batches:
            if not b.num_rows:
                continue
            cells, ns = b.column("cell").to_numpy(), b.column("n_tokens").to_numpy()
            upto = np.cumsum(ns)
            line = upto - ns
            new = np.flatnonzero(np.diff(cells, prepend=-1))  # where a cell begins, so does its part of the line
            base = begins[cells[new]] - line[new]
            if cells[0] == cell:
                base[0] = at
            line += np.repeat(base, np.diff(new, append=len(ns)))
            cell, at = cells[-1], int(line[-1] + ns[-1])
            first, last = layout.sequence(line), layout.sequence(line + ns - 1)
            many = last - first + 1
            row = np.repeat(np.arange(len(ns)), many)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            begin = np.maximum(line[row], layout.begin(sequence))
            end = np.minimum(line[row] + ns[row], layout.begin(sequence + 1))
            step = max(1, (1 << 20) // size)
            ids = b.column("ids")
            for lo in range(0, len(row), step):  # about a million ids at a time
                part = slice(lo, lo + step)
                r, start, length = row[part], (begin - line[row])[part], (end - begin)[part]
                raw = [np.frombuffer(ids[int(i)].as_buffer(), kind)[s:s + n].astype("<u4").tobytes() for i, s, n in zip(r, start, length, strict=True)]
                take = pa.array(r)
                offset = (begin - layout.begin(sequence))[part]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), pa.array(start), pa.array(length), b.column("n_tokens").take(take), pa.array(sequence[part]), pa.array(offset), pa.array(raw, pa.binary())], names)

    order = celled.repartition("cell").sortWithinPartitions("cell", "place", "doc_id", "rid")
    return order.select("cell", "doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids: what ``pack`` gives, one row a sequence (never more than its ids)."""
    held = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p"))
    whole = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return held.select("sequence_id", whole.alias("ids"), F.col("p.doc_id").alias("doc_ids"))


def op13_hilbert_packing(spark, sf_dir: str) -> DataFrame:
    """Every document's pieces, with the unsigned crc32 of each piece's ids."""
    return pack(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
