"""Exchange formats: nested export and import, CSV and time-partitioned JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.joins import nest


def export_sessions(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """session_id, body: {info, messages: [{info, parts}]} as JSON (S13). Sessions have id; messages id,
    session_id; parts id, message_id."""
    full = nest(messages.withColumnRenamed("id", "message_id"), parts, "message_id", ["id"], "parts")
    info = [c for c in full.columns if c not in ("parts", "session_id")]
    shaped = full.select("session_id", F.col("message_id").alias("_o"), F.struct(F.struct(*info).alias("info"), "parts").alias("m"))
    lists = shaped.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("_o", "m"))).alias("_l"))
    out = sessions.withColumnRenamed("id", "session_id").join(lists, "session_id", "left")
    body = F.struct(F.struct(*[c for c in sessions.columns if c != "id"]).alias("info"), F.coalesce(F.transform("_l", lambda x: x["m"]), F.array().cast(f"array<{shaped.schema['m'].dataType.simpleString()}>")).alias("messages"))
    return out.select("session_id", F.to_json(body).alias("body"))


def import_items(items: DataFrame) -> dict[str, DataFrame]:
    """A flat share log (type, data JSON) as three tables (S14): the session, its messages, their parts."""
    get = lambda p: F.get_json_object("data", p)
    session = items.where("type = 'session'").select(get("$.id").alias("id"), "data")
    messages = items.where("type = 'message'").select(get("$.id").alias("id"), get("$.sessionID").alias("session_id"), "data")
    parts = items.where("type = 'part'").select(get("$.id").alias("id"), get("$.messageID").alias("message_id"), "data")
    return {"session": session, "message": messages, "part": parts.join(messages.select(F.col("id").alias("message_id")), "message_id", "left_semi")}


def write_csv(df: DataFrame, path: str) -> None:
    """CSV in which a cell with a quote, comma or line end is quoted and quotes are doubled."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_by_hour(df: DataFrame, path: str, model: str = "model", time: str = "time") -> None:
    """JSON below model/year/month/day/hour (S16); finer folders would make a file a row."""
    t = F.col(time)
    parts = {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t)}
    out = df.withColumns(parts)
    out.repartition(model, *parts).write.partitionBy(model, *parts).json(path)
