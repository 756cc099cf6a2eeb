"""Assembly of streamed model output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Where each tool state may come from.
TOOL_MOVES = {"pending": (None,), "running": ("pending",), "completed": ("running",), "error": ("running",)}


def text_parts(events: DataFrame) -> DataFrame:
    """message_id, part_id, text, complete from start, delta and end events in order."""
    rows = events.where(F.col("type").isin("start", "delta", "end"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("type") == "delta", F.struct("seq", "delta")))), lambda x: x["delta"]), "")
    out = rows.groupBy("message_id", "part_id").agg(text.alias("text"), F.max(F.when(F.col("type") == "end", True)).alias("_end"), F.min(F.when(F.col("type") == "start", F.col("seq"))).alias("_start"))
    return out.where("_start IS NOT NULL").select("message_id", "part_id", "text", F.coalesce("_end", F.lit(False)).alias("complete"))


def tool_states(events: DataFrame) -> DataFrame:
    """Last valid state of each call; a move that the machine does not know is marked."""
    w = Window.partitionBy("call_id").orderBy("seq")
    before = F.lag("status").over(w)
    good = F.lit(False)
    for to, sources in TOOL_MOVES.items():
        for s in sources:
            good = good | ((F.col("status") == to) & (before.isNull() if s is None else F.coalesce(before == s, F.lit(False))))
    rows = events.withColumn("_good", good)
    return rows.groupBy("call_id").agg(F.max_by("status", F.when(F.col("_good"), F.col("seq"))).alias("status"), F.sum((~F.col("_good")).cast("int")).alias("invalid"))


def stream_usage(chunks: Column) -> Column:
    """The last usage object among the data lines of a stream, as JSON, or null."""
    found = F.filter(F.transform(chunks, lambda x: F.get_json_object(F.regexp_replace(x, r"^data:\s*", ""), "$.usage")), lambda x: x.isNotNull())
    return F.try_element_at(found, F.lit(-1))


def sse_chunks(body: Column, separator: str = "\n\n") -> Column:
    """Complete chunks of a streamed body; an unfinished rest is carried, so it is not one."""
    parts = F.split(body, separator)
    return F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.length(x) > 0)
