"""File search over (path, text) or (path, mtime) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """A row a line, numbered from 1."""
    cols = [c for c in files.columns if c != text]
    return files.select(*cols, F.posexplode(F.split(text, "\n")).alias("_at", "line")).select(*cols, (F.col("_at") + 1).alias("line_no"), "line")


def grep(files: DataFrame, pattern: str, limit: int = 100, cut: int = 2000) -> DataFrame:
    """Matching lines, those of the newest files first."""
    hit = lines(files).where(F.col("line").rlike(pattern))
    return hit.withColumn("line", F.substring("line", 1, cut)).orderBy(F.desc("mtime"), "path", "line_no").limit(limit)


def fuzzy_score(query: str, path: Column) -> Column:
    """Subsequence score in [0, 1], null where the query's letters do not occur in order (R17). The
    score is this library's own: matched letters over the length of the shortest stretch from the
    first to the last of them, a quarter more if the file name starts with the query."""
    escaped = [c if c.isalnum() else "\\" + c for c in query.lower()]
    got = F.regexp_extract(F.lower(path), "(?s)(" + ".*?".join(escaped) + ")", 1) if query else F.lit("")
    name = F.lower(F.substring_index(path, "/", -1))
    base = F.lit(float(len(query))) / F.length(got)
    bonus = F.when(name.startswith(query.lower()), F.lit(0.25)).otherwise(F.lit(0.0))
    return F.when(F.length(got) > 0, F.least(F.lit(1.0), base + bonus))


def fuzzy_find(files: DataFrame, query: str, limit: int, path: str = "path") -> DataFrame:
    scored = files.select(path, fuzzy_score(query, F.col(path)).alias("score")).where("score IS NOT NULL")
    return scored.orderBy(F.desc("score"), F.length(path), path).limit(limit)


def directories(files: DataFrame, path: str = "path") -> DataFrame:
    """All directories above the files, with their depth."""
    parts = F.split(path, "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = files.where(F.col(path).contains("/")).select(F.explode(up).alias("dir")).where("dir <> ''").distinct()
    return dirs.withColumn("depth", F.size(F.split("dir", "/")))


def tree(files: DataFrame, limit: int, path: str = "path") -> DataFrame:
    """Directories by depth, then name, up to a limit, with how many are left out."""
    dirs = directories(files, path)
    cut = dirs.agg(F.greatest(F.lit(0), F.count("*") - limit).alias("truncated"))  # one row
    return dirs.orderBy("depth", "dir").limit(limit).join(F.broadcast(cut))


def indented(files: DataFrame, limit: int, path: str = "path", ignore: tuple[str, ...] = ()) -> DataFrame:
    """The first files with their directories, directories first, indented by depth."""
    kept = files
    for p in ignore:
        kept = kept.where(~F.col(path).rlike(p))
    first = kept.select(path).orderBy(path).limit(limit)
    dirs = directories(first, path).select(F.col("dir").alias("path"), F.lit("directory").alias("kind"))
    both = dirs.unionByName(first.select(F.col(path).alias("path"), F.lit("file").alias("kind")))
    depth = F.size(F.split("path", "/")) - 1
    name = F.substring_index("path", "/", -1)
    order = F.concat_ws("/", F.transform(F.split("path", "/"), lambda p, i: F.concat(F.when((i == depth) & (F.col("kind") == "file"), "1").otherwise("0"), p)))
    line = F.concat(F.repeat(F.lit("  "), depth), name, F.when(F.col("kind") == "directory", "/").otherwise(""))
    return both.select("path", "kind", line.alias("line"), order.alias("sort_key")).orderBy("sort_key")
