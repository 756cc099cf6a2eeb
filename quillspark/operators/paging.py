"""Ordering, limits and pages. All limits keep their sort, so Spark takes the
first rows of every partition before anything is shuffled."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, n: int, time: str = "time_updated", id_: str = "id") -> DataFrame:
    """Newest first, ties by id."""
    return df.orderBy(F.desc(time), F.desc(id_)).limit(n)


def encode_cursor(time: float, id_: str) -> str:
    raw = json.dumps({"id": id_, "time": time}, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def decode_cursor(cursor: str) -> tuple[float, str]:
    got = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    return got["time"], got["id"]


def before(time: str, id_: str, cursor: tuple[float, str]) -> Column:
    """(time, id) < cursor, as a row value."""
    t, i = cursor
    return (F.col(time) < t) | ((F.col(time) == t) & (F.col(id_) < i))


def keyset_page(df: DataFrame, limit: int, cursor: str | None = None, time: str = "time_created", id_: str = "id") -> tuple[DataFrame, bool, str | None]:
    """(page in ascending order, whether there are more, cursor of the next page)."""
    rows = df if cursor is None else df.where(before(time, id_, decode_cursor(cursor)))
    got = rows.orderBy(F.desc(time), F.desc(id_)).limit(limit + 1)
    edge = got.select(time, id_).collect()  # limit + 1 rows
    more = len(edge) > limit
    page = got.limit(limit).orderBy(time, id_)
    return page, more, encode_cursor(edge[limit - 1][0], edge[limit - 1][1]) if more else None


def offset_page(df: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """OFFSET paging."""
    return df.orderBy(*order).offset(page * size).limit(size)


def updated_before(df: DataFrame, cursor, limit: int, time: str = "time_updated", strict: bool = True) -> DataFrame:
    """A page whose cursor is a time alone (T04): rows that tie with a page's last are skipped.
    With ``strict`` off, give (time, id) as cursor and none is."""
    if cursor is not None:
        df = df.where(F.col(time) < cursor if strict else before(time, "id", cursor))
    return df.orderBy(F.desc(time), F.desc("id")).limit(limit)


def first_then_sort(df: DataFrame, n: int, path: str = "path", mtime: str = "mtime") -> DataFrame:
    """The first n by path, then newest first: a sample, not a top n."""
    return df.orderBy(path).limit(n).orderBy(F.desc(mtime), path)


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n random rows, the same ones whatever the partitioning."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def keep_newest(df: DataFrame, cap: int, time: str, *ties: str) -> DataFrame:
    """All but the oldest rows above ``cap``."""
    return df.orderBy(F.desc(time), *ties).limit(cap)


def top_share(df: DataFrame, key: str, n: int, count: str = "n") -> DataFrame:
    """Most frequent keys with their share in percent to one decimal; n = 0 means all."""
    counts = df.groupBy(key).agg(F.count("*").alias(count))
    total = df.agg(F.count("*").alias("_total"))  # one row
    out = counts.join(F.broadcast(total)).select(key, count, F.round(F.col(count) / F.col("_total") * 100, 1).alias("percent"))
    out = out.orderBy(F.desc(count), key)
    return out.limit(n) if n else out


def listing_order(df: DataFrame, kind: str = "kind", name: str = "name") -> DataFrame:
    """Directories before files, then by name."""
    return df.orderBy(F.when(F.col(kind) == "directory", 0).otherwise(1), name)


def hidden_last(df: DataFrame, path: str = "path") -> DataFrame:
    """Paths with a hidden component after all others."""
    return df.orderBy(F.col(path).rlike(r"(^|/)\.[^/.]"), path)


def ranked_models(df: DataFrame, priority: list[str], id_: str = "id") -> DataFrame:
    """By position of the first listed substring, later ones first and unlisted ones last; then ids
    with 'latest'; then id descending (T17)."""
    rank = F.lit(-1)
    for k in reversed(range(len(priority))):
        rank = F.when(F.col(id_).contains(priority[k]), k).otherwise(rank)
    return df.orderBy(F.desc(rank), F.when(F.col(id_).contains("latest"), 0).otherwise(1), F.desc(id_))


def fused(df: DataFrame, n: int, fuzzy: str = "fuzzy", prefix: str = "is_prefix", frecency: str = "frecency", id_: str = "id") -> DataFrame:
    """fuzzy * (2 if prefix) * (1 + frecency), best n."""
    score = F.col(fuzzy) * F.when(F.col(prefix), 2).otherwise(1) * (1 + F.col(frecency))
    return df.withColumn("score", score).orderBy(F.desc("score"), id_).limit(n)


def backward_pages(df: DataFrame, group: str, size: int = 50, time: str = "time_created", id_: str = "id") -> DataFrame:
    """Every row with ``n``, its place from the newest of its group, and ``page``, in pages of ``size``."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(time), F.desc(id_))).cast("long")
    return df.withColumn("n", n).withColumn("page", F.floor((F.col("n") - 1) / size))


def top_per_group(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """First n rows of every group; Spark limits groups before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(f"_n <= {n}").drop("_n")
