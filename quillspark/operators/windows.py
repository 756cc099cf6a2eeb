"""Ordered-sequence operators: running values by key, see ``scan``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.scan import Scan

PRUNE_PROTECT, PRUNE_MINIMUM = 40_000, 20_000


def prunable(parts: DataFrame, key: str = "session_id", protect: int = PRUNE_PROTECT, minimum: int = PRUNE_MINIMUM) -> DataFrame:
    """Tool outputs to erase (W01). ``parts`` has msg (its position), pos, role, part_type, tool, status,
    tokens, is_summary, is_compacted, is_protected; a message without parts has one row with pos null.

    From the newest back: the newest two user turns are skipped; a summary or a part compacted
    before ends the walk; what lies beyond ``protect`` tokens is pruned, if that is over ``minimum``."""
    back = Scan(parts, [key], ["msg", "pos"], reverse=True)
    first = F.row_number().over(Window.partitionBy(key, "msg").orderBy(F.desc_nulls_last("pos"))) == 1
    rows = back.rows.withColumn("_user", F.when(first & (F.col("role") == "user"), 1).otherwise(0))
    rows = back.running(rows, {"_turns": ("sum", F.col("_user"))}).where("_turns >= 2")
    done = (F.col("part_type") == "tool") & (F.col("status") == "completed") & ~F.coalesce("is_protected", F.lit(False))
    stop = ((F.col("role") == "assistant") & F.coalesce("is_summary", F.lit(False))) | (done & F.coalesce("is_compacted", F.lit(False)))
    rows = back.running(rows, {"_stop": ("max", stop.cast("int"))}).where("_stop = 0 AND part_type = 'tool'").where(done)
    rows = back.running(rows, {"_total": ("sum", F.col("tokens"))}).where(F.col("_total") > protect)
    if back.split:
        enough = rows.groupBy(F.col(key).alias("_enough")).agg(F.sum("tokens").alias("_pruned")).where(F.col("_pruned") > minimum)
        return rows.join(enough, rows[key].eqNullSafe(enough["_enough"]), "left_semi").select(*parts.columns)
    whole = F.sum("tokens").over(Window.partitionBy(key))
    return rows.withColumn("_pruned", whole).where(F.col("_pruned") > minimum).select(*parts.columns)


def delta(df: DataFrame, keys: list[str], order: str, value: str, into: str = "delta") -> DataFrame:
    """Difference to the row before; the first row's is its value."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(into, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def escalations(df: DataFrame, keys: list[str], order: str, denied: Column, consecutive: int = 3, total: int = 20) -> DataFrame:
    """Consecutive and total denials so far, and whether to escalate; an approval resets the run."""
    scan = Scan(df, keys, [order])
    rows = scan.running(scan.rows.withColumn("_denied", denied.cast("int")), {"total": ("sum", F.col("_denied"))})
    rows = scan.running(rows, {"_before": ("last", F.when(F.col("_denied") == 0, F.col("total")))})  # the total at the last approval
    rows = rows.withColumn("consecutive", F.col("total") - F.coalesce("_before", F.lit(0)))
    return rows.withColumn("escalate", (F.col("consecutive") >= consecutive) | (F.col("total") >= total)).select(*df.columns, "total", "consecutive", "escalate")


def repeated_calls(df: DataFrame, keys: list[str], order: list[str], same: list[str], times: int = 3, pending: str = "pending") -> DataFrame:
    """Marks rows that end ``times`` equal calls in a row, none of them pending."""
    w = Window.partitionBy(*keys).orderBy(*order)
    hit = ~F.col(pending)
    for k in range(1, times):
        for c in same:
            hit = hit & F.coalesce(F.lag(c, k).over(w) == F.col(c), F.lit(False))
        hit = hit & ~F.coalesce(F.lag(pending, k).over(w), F.lit(True))
    return df.withColumn("loop", hit)


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Log compaction: the last row of each key, by one partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(*keys, "_row.*").select(*df.columns)


def since_compaction(msgs: DataFrame, key: str, order: str, boundary: Column) -> DataFrame:
    """From the newest back to and including the newest boundary message."""
    back = Scan(msgs, [key], [order], reverse=True)
    passed = back.running(back.rows, {"_passed": ("max", boundary.cast("int"))}, exclusive=True)
    return passed.where(F.coalesce("_passed", F.lit(0)) == 0).select(*msgs.columns)


def within_budget(df: DataFrame, keys: list[str], order: list[Column], size: str, budget: int, least_tail: int = 100) -> DataFrame:
    """Rows in ascending ``order`` (newest first: negated times) while they fit a budget; the first that
    does not is cut if more than ``least_tail`` remain (W09). Adds ``taken``, the size used of each row."""
    scan = Scan(df, keys, order)
    rows = scan.running(scan.rows, {"_sum": ("sum", F.col(size))})
    left = F.lit(budget) - (F.col("_sum") - F.col(size))
    taken = F.when(F.col("_sum") <= budget, F.col(size)).when(left > least_tail, left)
    return rows.withColumn("taken", taken).where("taken IS NOT NULL").drop("_sum", "_cell")


def head_within(df: DataFrame, keys: list[str], order: list[Column], size: str, lines: int = 2000, most_bytes: int = 50 * 1024) -> DataFrame:
    """Rows before a count or a running size is exceeded (W11; negate the order for the tail)."""
    scan = Scan(df, keys, order)
    rows = scan.running(scan.rows, {"_n": ("count", F.lit(1)), "_sum": ("sum", F.col(size))})
    return rows.where((F.col("_n") <= lines) & (F.col("_sum") <= most_bytes)).drop("_n", "_sum", "_cell")
