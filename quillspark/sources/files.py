"""Sources that are files. Every reader has an explicit schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.calendar import path_date

CORRUPT = "_corrupt"


def json_tree(spark: SparkSession, root: str, schema: str, ids: list[str], pattern: str = "*.json") -> tuple[DataFrame, DataFrame]:
    """(rows, unreadable files) of a tree of one-object JSON files (S04, S05). ``ids`` names the path
    components before '.json', last first; they come from the path, never from the body."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = files.select(F.col("_metadata.file_path").alias("_path"), "value", parsed.alias("_p"))
    bad = rows.where(F.col(f"_p.{CORRUPT}").isNotNull()).select(F.col("_path").alias("path"), F.col("value").alias("body"))
    rows = rows.where(F.col(f"_p.{CORRUPT}").isNull()).select("_path", "_p.*").drop(CORRUPT)
    bare = F.regexp_replace("_path", r"\.[a-z]+$", "")
    for k, name in enumerate(ids):
        rows = rows.withColumn(name, F.substring_index(F.substring_index(bare, "/", -1 - k), "/", 1))
    return rows.drop("_path"), bad


def markdown_files(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, text, hash of all *.md below a root (S06, R01); the hash is that of the file's bytes."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    return got.select("path", F.col("modificationTime").alias("mtime"), F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("hash"))


def sync_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, action of a manifest sync (S07): same mtime 'skip', same hash 'touch', else 'index'; paths
    that are gone 'delete'."""
    both = old.select("path", F.col("mtime").alias("_m"), F.col("hash").alias("_h"), F.lit(True).alias("_old")).join(
        new.select("path", "mtime", "hash", F.lit(True).alias("_new")), "path", "full")
    act = (
        F.when(F.col("_new").isNull(), "delete").when(F.col("_old").isNull(), "index")
        .when(F.col("_m") == F.col("mtime"), "skip").when(F.col("_h") == F.col("hash"), "touch").otherwise("index")
    )
    return both.select("path", act.alias("action"))


def needs_rebuild(manifest: DataFrame, version: int) -> bool:
    """Whether an index was written by another version."""
    got = manifest.where("key = 'version'").select("value").first()
    return got is None or int(got.value) != version


def jsonl_latest(spark: SparkSession, path: str, schema: str, key: str, order: str, keep: int) -> DataFrame:
    """The last good line of each key, the newest ``keep`` of them."""
    rows = spark.read.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    good = rows.where(F.col(CORRUPT).isNull() & F.col(key).isNotNull()).drop(CORRUPT)
    rest = [c for c in good.columns if c != key]
    last = good.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")
    return last.orderBy(F.desc(order), key).limit(keep)


def objects(listing: DataFrame, prefix: str, after: str | None = None, before: str | None = None, limit: int | None = None, key: str = "key") -> DataFrame:
    """Keys of a prefix in order (S09): after (exclusive), then the limit, then before."""
    out = listing.where(F.col(key).startswith(prefix))
    if after is not None:
        out = out.where(F.col(key) > after)
    if limit is not None:
        out = out.orderBy(key).limit(limit)
    if before is not None:
        out = out.where(F.col(key) < before)
    return out.orderBy(key)


def file_listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, mtime, length of all files below a root; contents are not read."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return got.select("path", F.col("modificationTime").alias("mtime"), "length")


def text_page(files: DataFrame, offset: int = 1, limit: int = 2000, cut: int = 2000, most_bytes: int = 50 * 1024) -> DataFrame:
    """Lines from a 1-based offset while their bytes fit, long lines cut."""
    from pyspark.sql import Window

    rows = files.select("path", F.posexplode(F.split("text", "\n")).alias("_at", "line")).withColumn("line_no", F.col("_at") + 1)
    rows = rows.where(F.col("line_no").between(offset, offset + limit - 1))
    rows = rows.withColumn("line", F.when(F.length("line") > cut, F.concat(F.substring("line", 1, cut), F.lit("..."))).otherwise(F.col("line")))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_bytes", F.sum(F.octet_length("line") + 1).over(w)).where(f"_bytes <= {most_bytes}").select("path", "line_no", "line")


_READ_ONLY = re.compile(r"(?is)^\s*(with|select|values|table|from|show|describe|desc|explain)\b")
_WRITES = re.compile(r"(?is)\b(insert|update|delete|merge|create|drop|alter|truncate|replace\s+table|set|refresh|cache|load)\b")


def read_only_sql(spark: SparkSession, text: str) -> DataFrame:
    """Ad-hoc SQL over the session's views; anything but a query is refused."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", text, flags=re.S)
    if not _READ_ONLY.match(bare) or _WRITES.search(bare) or ";" in bare.rstrip().rstrip(";"):
        raise PermissionError("only a single query is allowed")
    return spark.sql(text.rstrip().rstrip(";"))


def as_tsv(df: DataFrame) -> DataFrame:
    """Rows as tab-separated lines; as_json gives one object a row."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def metric_rows(events: DataFrame) -> DataFrame:
    """Rows from logged lines '_metric:{json}' (S17). ``events`` has batch, pos, url_ok, time, base (a map)
    and logs (an array of lines). Later keys overwrite; each error adds a row of its own with what was
    known then. As studied, the first event of a batch whose URL does not match ends the batch."""
    from pyspark.sql import Window

    w = Window.partitionBy("batch").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.withColumn("_bad", F.max((~F.col("url_ok")).cast("int")).over(w)).where("_bad = 0")
    metrics = F.transform(F.filter("logs", lambda x: x.startswith("_metric:")), lambda x: F.from_json(F.substr(x, F.lit(9)), "map<string,string>"))

    def over(a: Column, b: Column) -> Column:
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)

    states = F.aggregate(metrics, F.array(F.col("base")), lambda acc, m: F.concat(acc, F.array(over(F.element_at(acc, -1), m))))
    rows = rows.withColumn("_m", metrics).withColumn("_s", states)
    errors = F.filter(F.transform("_m", lambda m, i: F.when(F.map_contains_key(m, F.lit("llm.error.code")), F.get("_s", i + 1))), lambda x: x.isNotNull())
    each = F.concat(
        F.transform(errors, lambda m: F.struct(F.lit("llm.error").alias("event_type"), m.alias("data"))),
        F.array(F.struct(F.lit("completions").alias("event_type"), F.element_at("_s", -1).alias("data"))),
    )
    return rows.select("batch", "pos", "time", F.explode(each).alias("_e")).select("batch", "pos", "time", "_e.event_type", "_e.data")


def markdown_table(lines: DataFrame, columns: list[str], value: str = "value") -> DataFrame:
    """Body rows of a Markdown table (S20): the header and the rule below it are not rows."""
    cells = F.transform(F.slice(F.split(F.col(value), r"\|"), 2, len(columns)), lambda x: F.trim(x))
    body = lines.where(F.col(value).rlike(r"^\s*\|.*\|\s*$") & ~F.col(value).rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    out = body.select(*[F.get(cells, k).alias(c) for k, c in enumerate(columns)])
    return out.where(F.col(columns[0]) != columns[0])


def dated_paths(files: DataFrame) -> DataFrame:
    return files.withColumn("date", path_date(F.col("path")))
