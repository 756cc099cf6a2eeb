"""Join shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.scan import Scan
from quillspark.session import scratch


def nest(parents: DataFrame, children: DataFrame, key: str, order: list[str], into: str) -> DataFrame:
    """Children under their parent as an ordered array; none gives an empty array."""
    rest = [c for c in children.columns if c != key]
    fields = [*order, *[c for c in rest if c not in order]]
    lists = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(into))
    empty = F.array().cast(lists.schema[into].dataType)
    return parents.join(lists, key, "left").withColumn(into, F.coalesce(into, empty))


def split_orphans(children: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a parent, rows without) (J11). Children pass by a table of their partition's parents unsorted,
    so a task's memory doesn't grow with the children of one key."""
    ids = parents.select(key).distinct().hint("shuffle_hash")
    return children.join(ids, key, "left_semi"), children.join(ids, key, "left_anti")


def absent_only(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not there yet."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def merge_scores(vector: DataFrame, keyword: DataFrame, id_: str = "id", vector_weight: float = 0.7, keyword_weight: float = 0.3) -> DataFrame:
    """Full outer join of two scored lists; a missing score is zero."""
    both = vector.select(id_, F.col("score").alias("_v")).join(keyword.select(id_, F.col("score").alias("_k")), id_, "full")
    v, k = F.coalesce("_v", F.lit(0.0)), F.coalesce("_k", F.lit(0.0))
    return both.select(id_, (v * vector_weight + k * keyword_weight).alias("score"), F.when(v >= k, "vector").otherwise("keyword").alias("source"))


def latest_before(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, into: str) -> DataFrame:
    """As-of lookup, strictly backward: the newest right value before each left row.

    One union and one running value by key, so it is linear in the rows however many match, and a large
    key is many tasks."""
    tagged = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    known = right.where(F.col(value).isNotNull()).select(F.col(key), F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(tagged.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    scan = Scan(tagged.unionByName(known), [key], ["_t", "_side"])
    seen = scan.running(scan.rows, {"_last": ("last", F.col("_value"))})
    return seen.where("_side = 0").select("_row.*", F.col("_last").alias(into))


def remapped(rows: DataFrame, mapping: DataFrame, *cols: str) -> DataFrame:
    """Ids replaced by way of an (old, new) table; an id without an entry stays."""
    out = rows
    for c in cols:
        m = mapping.select(F.col("old").alias(c), F.col("new").alias(f"_new_{c}"))
        out = out.join(m, c, "left").withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_new_{c}")
    return out.select(*rows.columns)


def descendants(tree: DataFrame, roots: DataFrame, id_: str = "id", parent: str = "parent_id") -> DataFrame:
    """Roots and everything below them at any depth, by pointer jumping (J19): id, once each.

    Every node points to its parent, and knows whether a root is among the nodes between itself and
    where it points. A round replaces each pointer by its target's, so distances double and a chain of n
    takes log2(n) rounds of one join. A node that meets a root, or whose pointer leaves the tree, is done;
    on a cycle pointers never leave, so rounds end once they exceed twice the logarithm of the nodes,
    when every node of a cycle has been passed. A root that is no node itself may be a parent all the same."""
    spark = tree.sparkSession
    asked = roots.select(F.col(id_).alias("id")).where("id IS NOT NULL").distinct()
    marked = asked.select("id", F.lit(True).alias("_root"))
    nodes = tree.select(F.col(id_).alias("id"), F.col(parent).alias("up")).where("id IS NOT NULL").groupBy("id").agg(F.min("up").alias("up"))
    now = nodes.join(marked, "id", "full").select("id", "up", F.coalesce("_root", F.lit(False)).alias("hit"))
    path = scratch(spark, "closure")
    now.write.parquet(f"{path}/0")
    now, rounds = spark.read.parquet(f"{path}/0"), 0
    most = 2 + max(1, now.count()).bit_length()
    while rounds < most and not now.where("NOT hit AND up IS NOT NULL").isEmpty():
        rounds += 1
        to = now.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("hit").alias("_hit"))
        open_ = now.where("NOT hit AND up IS NOT NULL").join(to, F.col("up") == F.col("_id"), "left")
        moved = open_.select("id", F.col("_up").alias("up"), F.coalesce("_hit", F.lit(False)).alias("hit"))
        now.where("hit OR up IS NULL").unionByName(moved).write.parquet(f"{path}/{rounds}")
        now = spark.read.parquet(f"{path}/{rounds}")
    return now.where("hit").select("id").unionByName(asked).distinct().withColumnRenamed("id", id_)


def share_of_limit(rows: DataFrame, limits: DataFrame, keys: list[str], used: str, limit: str) -> DataFrame:
    """Dictionary lookup and percent of a limit, null without one."""
    out = rows.join(limits.select(*keys, limit), keys, "left")
    return out.withColumn("percent", F.when(F.coalesce(limit, F.lit(0)) > 0, F.round(F.col(used) / F.col(limit) * 100)).cast("long"))


def last_match(requests: DataFrame, rules: DataFrame, fits: Column, key: str, order: Column, value: str, default=None) -> DataFrame:
    """For each request the value of the last rule that fits.

    Rules are a configuration: they are broadcast, and the theta join streams the requests."""
    hit = requests.join(F.broadcast(rules), fits, "left").groupBy(key).agg(F.max_by(value, order).alias(value))
    return hit if default is None else hit.withColumn(value, F.coalesce(value, F.lit(default)))
