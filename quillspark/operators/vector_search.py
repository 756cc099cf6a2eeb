"""Vector search: blocked products, and an inverted file over cells.

Scores are cosines, rounded to 12 decimals so that equal vectors tie; ties go to the least id.
A vector that is null or empty, holds a null or has another length than the query is skipped;
a vector of tiny norm scores 0 with everything.

Every search is one job of the same shape. Vectors and queries of a cell are dealt into parts;
each part of the vectors meets each part of the queries once, as a product of matrices in Arrow
batches, and keeps ``k`` rows a query, so scores are never sorted or shuffled. What the parts
kept is merged by a window over at most k rows a part. A search without an index has one cell.
Few queries are sent to the vectors where they lie, without moving them.

Where all pairs are wanted (J15, R07), rows grow with the product of both sides, and so does what a
caller writes. Asked for few digits, blocks of pairs are sorted by score: equal scores lie side by side
and take about half the room in a columnar file. Vectors that make more pairs than a task should
give out are dealt evenly first, however few files they come from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries up to so many bytes are sent to all vectors; more meet them by a shuffle.
QUERY_BYTES = 16 << 20
#: Rows of a cell that one task takes: of the vectors (streamed), and of the queries (held).
VECTOR_PART, QUERY_PART = 100_000, 4096
#: Scores held at once.
BLOCK = 1 << 21
#: Pairs sorted at once (8 bytes each), and those scored or given out at once.
PAIRS, STRIP = 1 << 23, 1 << 18
#: Pairs that one task gives out where all are wanted.
TASK_PAIRS = 1 << 25
TINY = 1e-10
#: Rows an index is fitted on at most, those whose id hashes lowest; cells at most.
SAMPLE, MAX_CELLS = 50_000, 4096


# --- products of blocks -------------------------------------------------------

def unit_rows(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each width: positions and unit rows of the vectors that can be scored."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    out = {}
    for width in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == width)
        rows = flat[(ends[at] - width)[:, None] + np.arange(width)]
        whole = ~np.isnan(rows).any(axis=1)
        at, rows = at[whole], rows[whole]
        norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
        out[width] = at, np.where(norm < TINY, 0.0, rows / np.maximum(norm, TINY))
    return out


class Best:
    """The k best of each query of a block so far, or all above a score."""

    def __init__(self, names: pa.Array, matrices: dict[int, tuple[np.ndarray, np.ndarray]], k: int | None, above: float | None, digits: int | None = None):
        self.names, self.matrices, self.k, self.above, self.digits = names, matrices, k, above, digits
        self.floor = np.full(len(names), -np.inf if above is None else above)
        self.kept = pd.DataFrame({"q": [], "id": [], "score": []})

    def add(self, ids: pa.Array, vectors: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        """Rows to give out now: all that pass, where no k is asked for."""
        if self.digits is not None:
            yield from self.alike(ids, vectors)
            return
        for width, (at, v) in vectors.items():
            if width not in self.matrices:
                continue
            of, q = self.matrices[width]
            step = max(1, BLOCK // len(of))
            for lo in range(0, len(at), step):
                score = np.round(q @ v[lo:lo + step].T, 12)
                n = score.shape[1]
                if self.k is None:
                    i, j = np.nonzero(score > self.floor[of][:, None])
                else:
                    floor = self.floor[of]
                    if n > self.k:
                        floor = np.maximum(floor, np.partition(score, n - self.k, axis=1)[:, n - self.k])
                    i, j = np.nonzero(score >= floor[:, None])
                got = pd.DataFrame({"q": of[i], "id": ids.take(pa.array(at[lo + j])).to_numpy(zero_copy_only=False), "score": score[i, j]})
                if self.k is None:
                    yield got
                    continue
                both = pd.concat([self.kept, got]) if len(self.kept) else got
                self.kept = both.sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q", sort=False).head(self.k)
                full = self.kept.groupby("q")["score"].agg(["min", "size"])
                full = full[full["size"] >= self.k]["min"]
                self.floor[full.index.to_numpy(np.int64)] = full.to_numpy()

    def alike(self, ids: pa.Array, vectors: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        """All that pass, a block at a time, best first; scores are rounded from 12 decimals, half up, as SQL's round does."""
        unit, least = 10.0 ** (12 - self.digits), -np.inf if self.above is None else self.above
        for width, (at, v) in vectors.items():
            if width not in self.matrices:
                continue
            of, q = self.matrices[width]
            for qlo in range(0, len(of), QUERY_PART):
                some = q[qlo:qlo + QUERY_PART]
                step = max(1, PAIRS // len(some))
                for lo in range(0, len(at), step):
                    part = v[lo:lo + step].T
                    n = part.shape[1]
                    keys, size, strip = np.empty(len(some) * n, np.int64), 0, max(1, STRIP // n)
                    for i in range(0, len(some), strip):
                        score = np.rint((some[i:i + strip] @ part).ravel() * 1e12)
                        here = np.flatnonzero(score / 1e12 > least)
                        score = score[here]
                        score = np.copysign(np.floor((np.abs(score) + unit / 2) / unit), score).astype(np.int64)
                        keys[size:size + len(here)] = -score * len(keys) + (i * n + here)  # the score, then the place in the block
                        size += len(here)
                    keys = keys[:size]
                    keys.sort()
                    for j in range(0, size, STRIP):
                        score, pair = np.divmod(keys[j:j + STRIP], len(some) * n)
                        i, k = np.divmod(pair, n)
                        yield pd.DataFrame({"q": of[qlo + i], "id": ids.take(pa.array(at[lo + k])).to_numpy(zero_copy_only=False), "score": -score / 10.0 ** self.digits})

    def batch(self, rows: pd.DataFrame, id_type: pa.DataType) -> pa.RecordBatch:
        at = pa.array(rows["q"].to_numpy(np.int64))
        return pa.RecordBatch.from_arrays([self.names.take(at), pa.array(rows["id"], id_type), pa.array(rows["score"].to_numpy(np.float64))], ["query", "id", "score"])


def _schema(queries: DataFrame, vectors: DataFrame) -> str:
    return f"query {queries.schema['query'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"


def _sent(vectors: DataFrame, queries: DataFrame, k: int | None, above: float | None, digits: int | None) -> DataFrame:
    """Queries of a checked size are sent to the vectors."""
    got = queries.select("query", "query_embedding").toArrow().combine_chunks()
    name_list = got.column("query").combine_chunks() if got.num_rows else pa.array([], got.schema.field("query").type)
    matrices = unit_rows(got.column("query_embedding")) if got.num_rows else {}
    held = vectors.sparkSession.sparkContext.broadcast((name_list.to_pylist(), str(name_list.type), matrices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kind, mats = held.value
        best, id_type = Best(pa.array(names, pa.type_for_alias(kind)), mats, k, above, digits), None
        for b in batches:
            id_type = b.column("id").type
            for rows in best.add(b.column("id"), unit_rows(b.column("embedding"))):
                yield best.batch(rows, id_type)
        if len(best.kept):
            yield best.batch(best.kept, id_type)

    return vectors.select("id", "embedding").mapInArrow(run, _schema(queries, vectors))


def _dealt(vectors: DataFrame, queries: DataFrame, k: int | None, above: float | None, digits: int | None = None) -> DataFrame:
    """Parts of a cell's vectors meet parts of its queries; both have a column ``cell``."""
    many = queries.groupBy("cell").agg(F.count("*").alias("nq")).join(vectors.groupBy("cell").agg(F.count("*").alias("nv")), "cell")
    parts = F.broadcast(many.select("cell", F.ceil(F.col("nq") / QUERY_PART).alias("qs"), F.ceil(F.col("nv") / VECTOR_PART).alias("vs")))  # a row a cell

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))

    q = queries.join(parts, "cell").select("cell", F.pmod(F.xxhash64("query"), "qs").cast("int").alias("qp"), every("vs").alias("vp"), F.lit(0).alias("side"), "query", F.lit(None).cast(vectors.schema["id"].dataType).alias("id"), F.col("query_embedding").cast("array<double>").alias("e"))
    v = vectors.join(parts, "cell").select("cell", every("qs").alias("qp"), F.pmod(F.xxhash64("id"), "vs").cast("int").alias("vp"), F.lit(1).alias("side"), F.lit(None).cast(queries.schema["query"].dataType).alias("query"), "id", F.col("embedding").cast("array<double>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best, waiting, id_type = None, None, [], None

        def ready() -> Best:
            t = pa.Table.from_batches(waiting).combine_chunks()
            return Best(t.column("query").combine_chunks(), unit_rows(t.column("e")), k, above, digits)

        for b in batches:
            id_type = b.column("id").type
            keys = np.stack([b.column(c).to_numpy() for c in ("cell", "qp", "vp", "side")], 1)
            cut = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1 if len(keys) else []
            for lo, hi in zip([0, *cut], [*cut, len(keys)], strict=True):
                if lo == hi:
                    continue
                now, part = tuple(keys[lo][:3].tolist()), b.slice(lo, hi - lo)
                if now != key:
                    if best is not None and len(best.kept):
                        yield best.batch(best.kept, id_type)
                    key, best, waiting = now, None, []
                if keys[lo][3] == 0:
                    waiting.append(part)
                    continue
                if best is None:
                    if not waiting:
                        continue
                    best = ready()
                for rows in best.add(part.column("id"), unit_rows(part.column("e"))):
                    yield best.batch(rows, id_type)
        if best is not None and len(best.kept):
            yield best.batch(best.kept, id_type)

    met = q.unionByName(v).repartition("cell", "qp", "vp").sortWithinPartitions("cell", "qp", "vp", "side")
    return met.mapInArrow(run, _schema(queries, vectors))


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return rows.withColumn("_n", F.row_number().over(w)).where(f"_n <= {k}").drop("_n")


def block_scores(vectors: DataFrame, queries: DataFrame, id_: str = "id", vector: str = "embedding", k: int | None = None, above: float | None = None, digits: int | None = None) -> DataFrame:
    """query, id, score: the k best of each query, or every pair (above a score, if given; scores rounded to ``digits``)."""
    if digits is not None and (k is not None or not 0 <= digits <= 9):
        raise ValueError("digits (0 to 9) are for every pair, not for the k best")
    v = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("embedding"))
    q = queries.select("query", "query_embedding")
    size = q.agg(F.count("*").alias("n"), F.max(F.size("query_embedding")).alias("width")).first()
    if size.n * (8 * max(size.width or 0, 0) + 64) <= QUERY_BYTES:
        if k is None and (pairs := size.n * v.count()) > TASK_PAIRS:
            v = v.repartition(max(math.ceil(pairs / TASK_PAIRS), v.sparkSession.sparkContext.defaultParallelism))
        rows = _sent(v, q, k, above, digits)
    else:
        rows = _dealt(v.withColumn("cell", F.lit(0)), q.withColumn("cell", F.lit(0)), k, above, digits)
    return rows if k is None else _best(rows, k)


# --- inverted file --------------------------------------------------------------

def fit_cells(vectors: DataFrame, cells: int | None = None, id_: str = "id", vector: str = "embedding", rounds: int = 12, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of spherical k-means, fitted in one task on at most ``sample`` rows of the commonest
    width, those whose id hashes lowest. By default about the square root of all rows are cells."""
    v = vectors.where(F.size(vector) > 0).select(F.col(id_).alias("id"), F.col(vector).alias("embedding"))
    got = v.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if got is None:
        return np.zeros((0, 0))
    cells = cells or max(1, min(MAX_CELLS, math.isqrt(got["count"])))
    rows = v.where(F.size("embedding") == got.w).orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unit_rows(b.column("embedding"))[got.w][1] for b in batches if b.num_rows]
        x = np.concatenate(held)
        rng = np.random.default_rng(7)
        at, near = [int(rng.integers(len(x)))], np.full(len(x), 2.0)
        while len(at) < min(cells, len(x)):  # spread the first centres: far rows are likelier
            near = np.minimum(near, np.maximum(0.0, 1 - x @ x[at[-1]]))
            if near.sum() <= 1e-12:
                break
            at.append(int(rng.choice(len(x), p=near / near.sum())))
        centre = x[at].copy()
        for _ in range(rounds):
            own = np.concatenate([np.argmax(x[i:i + 4096] @ centre.T, axis=1) for i in range(0, len(x), 4096)])
            total = np.zeros_like(centre)
            np.add.at(total, own, x)
            norm = np.linalg.norm(total, axis=1, keepdims=True)
            centre = np.where(norm > TINY, total / np.maximum(norm, TINY), centre)
        yield pa.RecordBatch.from_arrays([pa.array(list(centre), pa.list_(pa.float64()))], ["c"])

    return np.array([r.c for r in rows.mapInArrow(run, "c array<double>").collect()])  # at most MAX_CELLS rows


def _cells_of(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """``rows`` (a name and a vector) with near: the nearest cells and the angles to their centroids.

    Vectors that no centroid fits (another width) share cell -1."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)
    name, vec = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in batches:
            cell = np.full((b.num_rows, max(1, probes)), -1, np.int64)
            angle = np.zeros(cell.shape)
            for width, (at, v) in unit_rows(b.column(vec)).items():
                if len(c) and width == c.shape[1]:
                    for lo in range(0, len(at), 4096):
                        score = v[lo:lo + 4096] @ c.T
                        best = np.argsort(-score, axis=1, kind="stable")[:, :probes]
                        cell[at[lo:lo + 4096], :best.shape[1]] = best
                        angle[at[lo:lo + 4096], :best.shape[1]] = np.arccos(np.clip(np.take_along_axis(score, best, 1), -1, 1))
            near = [[{"cell": int(x), "angle": float(a)} for x, a in zip(cs, an, strict=True) if x >= 0] or [{"cell": -1, "angle": 0.0}] for cs, an in zip(cell, angle, strict=True)]
            kind = pa.list_(pa.struct([("cell", pa.int64()), ("angle", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(name), b.column(vec), pa.array(near, kind)], [name, vec, "near"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return rows.mapInArrow(run, f"{kinds}, near array<struct<cell:bigint,angle:double>>")


class VectorIndex:
    """An inverted file on disk: vectors partitioned by cell, and each cell's radius.

    ``build`` puts every row into its nearest cell; rows of a large cell are dealt over many
    files. ``add`` appends rows to the cells that are there. ``search`` reads the cells that its
    queries probe (partition pruning) and no others."""

    def __init__(self, spark, path: str, centroids: np.ndarray):
        self.spark, self.path, self.centroids = spark, path.rstrip("/"), centroids

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, id_: str = "id", vector: str = "embedding") -> VectorIndex:
        index = cls(vectors.sparkSession, path, fit_cells(vectors, cells, id_, vector))
        spark = index.spark
        table = [(i, c.tolist()) for i, c in enumerate(index.centroids)]
        spark.createDataFrame(table, "cell long, centroid array<double>").coalesce(1).write.parquet(f"{index.path}/centroids")
        none = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("embedding"), F.lit(0.0).alias("angle")).limit(0)
        none.coalesce(1).write.parquet(f"{index.path}/cells/cell=-1")  # columns are known without rows
        index.add(vectors, id_, vector)
        return index

    @classmethod
    def open(cls, spark, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path.rstrip('/')}/centroids").orderBy("cell").collect()  # at most MAX_CELLS
        return cls(spark, path, np.array([r.centroid for r in rows]) if rows else np.zeros((0, 0)))

    def add(self, vectors: DataFrame, id_: str = "id", vector: str = "embedding") -> None:
        placed = _cells_of(vectors.where(F.size(vector) > 0).select(F.col(id_).alias("id"), F.col(vector).alias("embedding")), self.centroids, 1)
        flat = placed.select("id", "embedding", F.col("near")[0]["cell"].alias("cell"), F.col("near")[0]["angle"].alias("angle"))
        parts = max(1, -(-flat.count() // VECTOR_PART))
        flat.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(parts))).write.mode("append").partitionBy("cell").parquet(f"{self.path}/cells")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells").withColumn("cell", F.col("cell").cast("long"))

    def probes_for(self, queries: DataFrame, k: int, target: float = 0.95) -> int:
        """The least number of cells to probe so that these queries find ``target`` of their true k best.

        Give it a sample: it compares them with all rows. Vectors without structure need many cells."""
        every = _cells_of(queries.select("query", "query_embedding"), self.centroids, max(1, len(self.centroids)))
        order = every.select("query", F.transform("near", lambda x: x["cell"]).alias("order"))
        truth = block_scores(self.rows(), queries, k=k).join(self.rows().select("id", "cell"), "id").join(order, "query")
        ranks = truth.select(F.array_position("order", F.col("cell")).alias("rank"))  # cell -1 is always probed: rank 0
        found = dict(ranks.groupBy("rank").count().collect())  # a row a cell at most
        total, so_far = sum(found.values()), 0
        for rank in sorted(found):
            so_far += found[rank]
            if so_far >= target * total:
                return max(1, int(rank))
        return max(1, len(self.centroids))

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """query, id, score: the k best of each query among its ``probes`` nearest cells (and cell -1)."""
        near = _cells_of(queries.select("query", "query_embedding"), self.centroids, min(probes, max(1, len(self.centroids))))
        asked = near.select("query", "query_embedding", F.explode(F.array_distinct(F.concat(F.transform("near", lambda x: x["cell"]), F.array(F.lit(-1).cast("long"))))).alias("cell"))
        return _best(_dealt(self.rows(), asked, k, None), k)

    def search_exact(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """The same as over all rows. The first search gives each query a score that its k-th must reach;
        then only cells are read that can hold one: no member is nearer than the centroid less the radius."""
        radius = self.rows().groupBy("cell").agg(F.max("angle").alias("radius"))  # a row a cell
        first = self.search(queries, k, probes)
        reach = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("least"))
        every = _cells_of(queries.select("query", "query_embedding"), self.centroids, max(1, len(self.centroids)))
        cells = every.join(reach, "query", "left").select("query", "query_embedding", F.coalesce("least", F.lit(-2.0)).alias("least"), F.explode("near").alias("n"))
        cells = cells.select("query", "query_embedding", "least", "n.*").where("cell >= 0").join(F.broadcast(radius), "cell")
        asked = cells.where(F.cos(F.greatest(F.lit(0.0), F.col("angle") - F.col("radius") - 1e-9)) >= F.col("least") - 1e-9).select("query", "query_embedding", "cell")
        loose = queries.select("query", "query_embedding", F.lit(-1).cast("long").alias("cell"))
        return _best(_dealt(self.rows(), asked.unionByName(loose), k, None), k)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """query, recall: the share of the true k best that a search found."""
    hit = truth.join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return hit.groupBy("query").agg((F.count("hit") / F.least(F.lit(k), F.count("*"))).alias("recall"))
