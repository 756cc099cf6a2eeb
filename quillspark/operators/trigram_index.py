"""A trigram index for regex search over files.

A pattern's literal stretches say which trigrams a matching file must hold: all of a stretch's, those
of every part of a sequence, those of one branch of an alternative. Postings of these trigrams alone
are read; files whose trigrams fulfil the requirement are candidates, and the pattern itself decides on
their lines, so the result is that of a scan. A pattern that requires nothing (too short, or letters of
either case) reads all files.

Files lie by block, at most ``BLOCK`` files each, numbered where they are read; a posting is one trigram's
files of one block, as numbers, made in the task that reads them, so neither texts nor trigrams are shuffled
and a trigram that all files hold is many rows. The search prunes blocks without candidates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.search import grep
from quillspark.session import scratch

BLOCK, BUCKETS = 4096, 16
#: Characters whose trigrams are held at once, and candidates that are sent to the files at most.
SLICE, SENT = 4 << 20, 1 << 20
#: A requirement: a trigram, ("and", parts) or ("or", parts); None asks for nothing.
Need = str | tuple | None


def _all_of(parts: list[Need]) -> Need:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _stretch(s: str) -> Need:
    return _all_of([s[i:i + 3] for i in range(len(s) - 2)])


def _sequence(tokens) -> Need:
    parts, run = [], ""
    for op, value in tokens:
        kind = str(op)
        if kind == "LITERAL":
            run += chr(value)
            continue
        parts.append(_stretch(run))
        run = ""
        if kind == "SUBPATTERN":
            parts.append(_sequence(value[3]) if not value[1] and not value[2] else None)
        elif kind == "ATOMIC_GROUP":
            parts.append(_sequence(value))
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            parts.append(_sequence(value[2]))
        elif kind == "BRANCH":
            each = [_sequence(b) for b in value[1]]
            parts.append(None if None in each else ("or", tuple(each)))
    return _all_of([*parts, _stretch(run)])


def required(pattern: str) -> Need:
    """What a text must hold to match; nothing where the pattern ignores case or isn't understood."""
    try:
        tree = re._parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return None
    return None if tree.state.flags & (re.IGNORECASE | re.VERBOSE) else _sequence(tree)


def grams_of(need: Need) -> set[str]:
    return set() if need is None else {need} if isinstance(need, str) else set().union(*map(grams_of, need[1]))


def fulfilled(need: Need, held: Column) -> Column:
    """Whether an array of trigrams fulfils a requirement."""
    if isinstance(need, str):
        return F.array_contains(held, need)
    out = None
    for p in need[1]:
        x = fulfilled(p, held)
        out = x if out is None else out & x if need[0] == "and" else out | x
    return out


class TrigramIndex:
    """Folders below ``path``: files by block, postings by bucket of the trigram."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, files: DataFrame, path: str) -> TrigramIndex:
        """From files (path, mtime, text)."""
        index = cls(files.sparkSession, path)
        most = BLOCK

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, seen = TaskContext.get().partitionId() << 14, 0  # a task has at most 16384 blocks
            for b in batches:
                at = np.arange(seen, seen + b.num_rows)
                seen += b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((first + at // most).astype(np.int32)), pa.array((at % most).astype(np.int32))], [*b.schema.names, "block", "no"])

        rows = files.select("path", "mtime", F.coalesce("text", F.lit("")).alias("text"))
        rows = rows.mapInArrow(number, f"path string, mtime {rows.schema['mtime'].dataType.simpleString()}, text string, block int, no int")
        rows.limit(0).drop("block").coalesce(1).write.parquet(f"{index.path}/files/block=-1")
        rows.write.mode("append").partitionBy("block").parquet(f"{index.path}/files")
        lists = index._files().select("block", "no", "text").mapInArrow(_postings, "gram string, block int, nos array<int>")
        lists = lists.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
        lists.limit(0).drop("bucket").coalesce(1).write.parquet(f"{index.path}/postings/bucket=-1")
        lists.sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(f"{index.path}/postings")
        return index

    def _files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/files").where("block >= 0")

    def candidates(self, pattern: str) -> DataFrame:
        """block, no of the files that may match."""
        need = required(pattern)
        if need is None:
            return self._files().select("block", "no")
        asked = self.spark.createDataFrame([(g,) for g in sorted(grams_of(need))], "gram string").withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
        hit = self.spark.read.parquet(f"{self.path}/postings").join(F.broadcast(asked), ["bucket", "gram"], "left_semi")  # the pattern's own trigrams
        held = hit.select("gram", "block", F.explode("nos").alias("no")).groupBy("block", "no").agg(F.collect_set("gram").alias("held"))
        return held.where(fulfilled(need, F.col("held"))).select("block", "no")

    def search(self, pattern: str, limit: int = 100, cut: int = 2000) -> DataFrame:
        """What ``grep`` gives over all files. Candidates are sent to the files once they are counted; of too many,
        the blocks alone are, for the pattern decides on every line anyhow."""
        read = self._files()
        if required(pattern) is not None:
            path = scratch(self.spark, "candidates")
            self.candidates(pattern).write.parquet(path)
            few = self.spark.read.parquet(path)
            few = few if few.count() <= SENT else few.select("block").distinct()
            read = read.join(F.broadcast(few), few.columns, "left_semi")
        return grep(read.select("path", "mtime", "text"), pattern, limit, cut)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, block, nos: of each slice of a block's files."""
    def given(block: int, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        key = np.concatenate([k for _, k in held])
        no = np.repeat(np.array([n for n, _ in held], np.int32), [len(k) for _, k in held])
        order = np.argsort(key, kind="stable")
        key, no = key[order], no[order]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        one = key[start]
        letters = np.stack([one >> 42, one >> 21 & 0x1FFFFF, one & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
        nos = pa.ListArray.from_arrays(pa.array(np.append(start, len(no)).astype(np.int32)), pa.array(no))
        return pa.RecordBatch.from_arrays([pa.array([letters[i:i + 3] for i in range(0, len(letters), 3)], pa.string()), pa.array(np.full(len(one), block, np.int32)), nos], ["gram", "block", "nos"])

    for b in batches:
        held, size, last = [], 0, None
        for block, no, text in zip(b.column("block").to_pylist(), b.column("no").to_pylist(), b.column("text"), strict=True):
            c = np.frombuffer(text.as_py().encode("utf-32-le"), "<u4").astype(np.int64)
            if held and (block != last or size + len(c) > SLICE):
                yield given(last, held)
                held, size = [], 0
            held.append((no, np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])))
            size, last = size + len(c), block
        if held:
            yield given(last, held)
