"""Hybrid retrieval: chunks, keyword and vector legs, fusion, decay, diversity.

Vector scores are cosines in both legs, and one root is the scope of a sync; both are
deliberate differences from the behaviour studied, whose two legs scored on unlike scales."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.calendar import path_date
from quillspark.functions.text import CHARS_PER_TOKEN
from quillspark.operators.joins import merge_scores
from quillspark.operators.keyword_index import batches_of, impact, term_counts
from quillspark.operators.vector_search import block_scores
from quillspark.session import scratch

HALF_LIFE_DAYS = 30
LAMBDA = 0.7
CHUNKED = 1 << 20
_WIDE = re.compile("[一-鿿㐀-䶿豈-﫿　-〿＀-￯가-힯぀-ヿ\U00010000-\U0010ffff]")


# --- chunks -----------------------------------------------------------------

def weight(s: str) -> int:
    return len(s) + (CHARS_PER_TOKEN - 1) * len(_WIDE.findall(s))


def pieces(line: str, most: int, tokens: int) -> list[str]:
    """A line cut at every ``most`` UTF-16 units, and at every ``tokens`` where that still weighs too
    much. A character belongs where its first unit is, so a surrogate pair stays whole."""
    unit = [0, *accumulate(1 + (c > "\uffff") for c in line)]
    coarse = [bisect_left(unit, u) for u in range(0, max(unit[-1], 1), most)]
    out = []
    for lo, hi in pairwise([*coarse, len(line)]):
        cuts = [lo]
        while weight(line[lo:hi]) > most and (cut := bisect_left(unit, unit[cuts[-1]] + max(1, tokens))) < hi:
            cuts.append(cut)
        out += [line[a:b] for a, b in pairwise([*cuts, hi]) if a < b or not line]
    return out


def chunk_text(text: str, tokens: int = 400, overlap: int = 80) -> list[tuple[int, int, str, str]]:
    """(first line, last line, text, hash) of overlapping chunks within a weighted budget.

    With running sums of the pieces' weights, a chunk's end is the last piece that its budget reaches
    (one new piece at least), and the next begins at the last piece from which the overlap is met."""
    most, lap = max(32, tokens * CHARS_PER_TOKEN), max(0, overlap * CHARS_PER_TOKEN)
    cut = [(no, p) for no, line in enumerate(text.split("\n"), 1) for p in pieces(line, most, tokens)]
    sums = [0, *accumulate(weight(p) + 1 for _, p in cut)]
    out, start, end = [], 0, 0
    while end < len(cut):
        end = max(end + 1, bisect_right(sums, sums[start] + most) - 1)
        body = "\n".join(p for _, p in cut[start:end])
        out.append((cut[start][0], cut[end - 1][0], body, hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()[:16]))
        start = max(start, bisect_right(sums, sums[end] - lap) - 1)
    return out


def chunks(files: DataFrame, path: str = "path", text: str = "text", tokens: int = 400, overlap: int = 80) -> DataFrame:
    """path, idx, start_line, end_line, text, hash of every file; files are split where they are, and chunks of
    about ``CHUNKED`` bytes of files (one file at least) are held at once."""
    most = CHUNKED
    schema = "path string, idx int, start_line int, end_line int, text string, hash string"
    kinds = pa.schema([("path", pa.string()), ("idx", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string()), ("hash", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in batches_of(b.column("text"), most):
                part = b.slice(lo, hi - lo)
                rows = [(p, i, *c) for p, t in zip(part.column("path").to_pylist(), part.column("text").to_pylist(), strict=True) for i, c in enumerate(chunk_text(t or "", tokens, overlap))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return files.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(run, schema)


# --- embeddings -------------------------------------------------------------

def embed(chunks_: DataFrame, cache: DataFrame, provider: Callable[[list[str]], list[list[float]]], model: str, batch_bytes: int = 8000) -> tuple[DataFrame, DataFrame]:
    """(chunks with embeddings, new cache rows): each distinct text that the cache lacks is
    embedded once, in batches of at most ``batch_bytes``, with three attempts (R03)."""
    texts = chunks_.select("hash", "text").dropDuplicates(["hash"])
    missing = texts.join(cache.where(F.col("model") == model).select("hash"), "hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            group, size = [], 0
            done = []

            def send(group):
                for attempt in range(3):
                    try:
                        return provider([t for _, t in group])
                    except Exception:
                        if attempt == 2:
                            raise
                return []

            for h, t in zip(pdf["hash"], pdf["text"], strict=True):
                n = len(t.encode())
                if group and size + n > batch_bytes:
                    done += zip([h for h, _ in group], send(group), strict=True)
                    group, size = [], 0
                group.append((h, t))
                size += n
            if group:
                done += zip([h for h, _ in group], send(group), strict=True)
            yield pd.DataFrame(done, columns=["hash", "embedding"])

    new = missing.mapInPandas(run, "hash string, embedding array<float>").select("hash", F.lit(model).alias("model"), "embedding")
    known = cache.where(F.col("model") == model).select("hash", "model", "embedding").unionByName(new)
    return chunks_.join(known.select("hash", "embedding"), "hash", "left"), new


# --- keyword leg ------------------------------------------------------------

def bm25_scan(docs: DataFrame, id_: str, text: str, terms: list[str]) -> DataFrame:
    """id, score of texts that have any of the terms, without an index (R04): texts are read once; their
    counts, a row a text, are written down for the statistics and the scores."""
    asked = list(dict.fromkeys(terms))
    at = scratch(docs.sparkSession, "terms")
    term_counts(docs, id_, text, asked).where("length > 0").write.parquet(at)
    rows = docs.sparkSession.read.parquet(at)
    got = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col("tf")[k] > 0).alias(f"df_{k}") for k in range(len(asked))]).first()
    score, hit = F.lit(0.0), F.lit(False)
    for k in range(len(asked)):
        weight_ = math.log((got.n - got[f"df_{k}"] + 0.5) / (got[f"df_{k}"] + 0.5) + 1)
        score = score + F.lit(weight_) * impact(F.col("tf")[k], F.col("length"), F.lit(got.mean or 1.0))
        hit = hit | (F.col("tf")[k] > 0)
    return rows.where(hit).select("id", score.alias("score"))


def rank_scale(df: DataFrame, rank: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """Lower ranks are better: best 1, worst 0; a sole or all-equal result is 1 (R05). ``by`` names the
    columns of a query, whose results are a bounded list."""
    w = Window.partitionBy(*by)
    best, worst = F.min(rank).over(w), F.max(rank).over(w)
    return df.withColumn("score", F.when(worst == best, F.lit(1.0)).otherwise(1 - (F.col(rank) - best) / (worst - best)))


# --- vector leg -------------------------------------------------------------

def similarities(vectors: DataFrame, queries: DataFrame, id_: str = "id", vector: str = "embedding", above: float | None = None, digits: int | None = None) -> DataFrame:
    """query, id, score: the cosine of every vector with every query (J15, R07), or those above a score; scores are rounded to ``digits``."""
    return block_scores(vectors, queries, id_, vector, above=above, digits=digits)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_: str = "id", vector: str = "embedding") -> DataFrame:
    """query, id, score: the k most alike of each query."""
    return block_scores(vectors, queries, id_, vector, k=k)


# --- fusion -----------------------------------------------------------------

def decayed(df: DataFrame, now: Column, path: str = "path") -> DataFrame:
    """Scores halve every 30 days of the date in the path; without one they stay."""
    age = F.greatest(F.lit(0.0), (F.unix_millis(now) - F.unix_millis(path_date(F.col(path)).cast("timestamp"))) / 86_400_000)
    factor = F.exp(-F.log(F.lit(2.0)) / HALF_LIFE_DAYS * age)
    return df.withColumn("score", F.col("score") * F.coalesce(factor, F.lit(1.0)))


def _tokens(text: str) -> set[str]:
    return {t for t in re.split(r"[^A-Za-z0-9_]+", text.lower()) if len(t) > 1}


def diversify(results: pd.DataFrame, limit: int) -> pd.DataFrame:
    """Maximal marginal relevance over rows sorted by score; ties keep the earlier."""
    rows = results.reset_index(drop=True)
    sets = [_tokens(t) for t in rows["text"]]
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    picked, left, nearest_ = [], list(range(len(rows))), [0.0] * len(rows)
    while left and len(picked) < limit:
        best = left[0] if not picked else max(left, key=lambda i: (LAMBDA * rows["score"][i] - (1 - LAMBDA) * nearest_[i], -i))
        picked.append(best)
        left.remove(best)
        for i in left:
            nearest_[i] = max(nearest_[i], alike(sets[i], sets[best]))
    return rows.loc[picked].assign(rank=range(1, len(picked) + 1))


def merged_legs(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """query, id, score, source: both legs' results for every query."""
    both = F.struct("query", "id").alias("both")
    merged = merge_scores(vector.select(both, "score"), keyword.select(both, "score"), "both")
    return merged.select("both.query", "both.id", "score", "source")


def hybrid(vector: DataFrame, keyword: DataFrame, chunks_: DataFrame, now: Column, limit: int = 10, min_score: float = 0.0, decay: bool = True, mmr: bool = True) -> DataFrame:
    """The whole pipeline for all queries at once: merge, decay, minimum, diversity.

    Legs are (query, id, score). Either brings at most 3 * limit rows a query (R08), so a query's last
    step, a greedy selection, holds at most 6 * limit texts; queries are dealt over tasks."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    legs = [x.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= 3 * limit).drop("_n") for x in (vector, keyword)]
    out = merged_legs(*legs).join(chunks_.select("id", "path", "text"), "id")
    if decay:
        out = decayed(out, now)
    if min_score > 0:
        out = out.where(F.col("score") >= min_score)
    if not mmr:
        return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    kinds = {c: out.schema[c].dataType.simpleString() for c in ("query", "id")}
    schema = f"query {kinds['query']}, id {kinds['id']}, score double, source string, path string, text string, rank int"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        return diversify(pdf.sort_values(["score", "id"], ascending=[False, True], kind="stable"), limit)

    return out.select("query", "id", "score", "source", "path", "text").groupBy("query").applyInPandas(pick, schema)


def save_gate(best: DataFrame, inside: Column, skip: float = 0.95, overwrite: float = 0.85) -> DataFrame:
    """What to do with a text to be saved, from its best match."""
    act = F.when(F.col("score") >= skip, "skip").when((F.col("score") >= overwrite) & inside, "overwrite").otherwise("new")
    return best.withColumn("action", act)
