"""Shared helpers: tables, tables written to the shared folder, range cells."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: More cells than this are never made; a cell only bounds the rows one window sees.
MAX_CELLS = 16_384
ROWS_PER_CELL = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(path)
    return path


#: Tables that ``materialize`` wrote and ``discard`` has not removed.
_WRITTEN: list[DataFrame] = []


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage is cut there.

    An application's tables lie together below its id; what ``discard`` has not removed goes
    when the driver ends."""
    spark = df.sparkSession
    own = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    path = f"{own}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _file_system(spark, own)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    _WRITTEN.append(out)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes the files of tables made by ``materialize`` that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_written", None):
            fs, at = _file_system(t.sparkSession, path)
            fs.delete(at, True)
            _WRITTEN[:] = [x for x in _WRITTEN if x is not t]


@contextmanager
def temporary_tables() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """On a normal end, removes the tables written inside, but for those given to the yielded function."""
    before, kept = len(_WRITTEN), []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    yield keep
    discard(*[t for t in _WRITTEN[before:] if not any(t is k for k in kept)])


def keep_only(df: DataFrame, *names: str) -> DataFrame:
    """The columns an operator works on, so that extra columns can never clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: Ids are broadcast up to so many (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def _by_id(rows: DataFrame, ids: DataFrame, id_col: str, kind: str) -> DataFrame:
    listed = ids.select(F.col(ids.columns[0]).alias(id_col))
    small = listed.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(listed) if small else listed, id_col, kind)


def anti_by_id(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not listed (null ids stay); columns and their order are kept."""
    return _by_id(rows, ids, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in rows.columns])


def semi_by_id(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is listed."""
    return _by_id(rows, ids, id_col, "left_semi").select(*[F.col(f"`{c}`") for c in rows.columns])


#: Keys of more rows than this go by a broadcast, at most MAX_HOT of them; the others by a shuffle.
HOT_ROWS = 100_000
MAX_HOT = 10_000


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` left-joined with ``facts``, which has one row a key and the key's count of ``rows`` in ``n``.

    The rows of a key with a large share of all never meet in one task."""
    hot = facts.where(F.col(n) > HOT_ROWS).orderBy(F.desc(n), *keys).limit(MAX_HOT)
    if hot.isEmpty():
        return rows.join(facts, keys, "left").drop(n)
    hot = materialize(hot, "hot")
    near = rows.join(F.broadcast(hot), keys)
    far = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts, keys, "left")
    return near.unionByName(far).drop(n)


def hash_mod(col: str, n: int) -> Column:
    """crc32 of a column's text form, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def cell_bounds(df: DataFrame, col: str, rows: int) -> list[int]:
    """Ascending lower bounds of range cells of about ROWS_PER_CELL rows (at most MAX_CELLS)."""
    n = 1
    while n < MAX_CELLS and n * ROWS_PER_CELL < rows:
        n *= 2
    if n == 1:
        return []
    got = df.agg(F.percentile_approx(col, [i / n for i in range(1, n)], 10 * n)).first()[0]
    return sorted({int(x) for x in got or []})


def cell_of(col: Column, bounds: list[int]) -> Column:
    """How many bounds are <= col, by binary search over a literal array (nulls: cell 0)."""
    if not bounds:
        return F.lit(0)
    steps, top = [], 1
    while top <= len(bounds):
        steps.insert(0, top)
        top *= 2
    big = 2**63 - 1
    padded = F.array(*[F.lit(b).cast("long") for b in bounds + [big] * (top - 1 - len(bounds))])
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, s: at + F.when(F.element_at(padded, at + s) <= col, s).otherwise(F.lit(0)),
    )
    return F.coalesce(found, F.lit(0))
