"""Writes as new states of a table. Nothing is changed in place: a step returns
the next state, or writes it beside the old one and switches a pointer."""

from __future__ import annotations

import json
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _tie(df: DataFrame, columns: list[str]) -> Column:
    """Decides between rows that nothing else tells apart: a hash of the row, the same in any partitioning."""
    return F.xxhash64(*[c for c in columns if "map<" not in df.schema[c].dataType.simpleString()])


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Changes replace rows of equal key; columns in ``keep`` stay as they first were (D01, E06). Of several
    changes of a key the last by ``order`` wins, of equal ones the one whose row hashes highest, as a whole."""
    rest = [c for c in base.columns if c not in keys]
    turn = F.lit(0).cast("long") if order is None else F.col(order).cast("long")
    old = base.select(*keys, *rest, F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_turn"))
    new = changes.select(*keys, *rest, F.lit(1).alias("_side"), turn.alias("_turn"))
    both = old.unionByName(new)
    when, row = F.struct("_side", "_turn", _tie(both, rest)), F.struct(*rest)
    ends = both.groupBy(*keys).agg(F.min_by(row, when).alias("_first"), F.max_by(row, when).alias("_last"))
    return ends.select(*keys, *[F.col(f"{'_first' if c in keep else '_last'}.{c}").alias(c) for c in rest]).select(*base.columns)


def add_up(base: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Insert or increment."""
    return base.select(*keys, value).unionByName(delta.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def insert_ignore(base: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Adds rows whose key is not there; of several new ones the first by ``order``, of equal ones the one
    whose row hashes lowest (D03)."""
    rest = [c for c in base.columns if c not in keys]
    when = F.struct(*([order] if order else []), _tie(new, rest) if rest else F.lit(0))
    one = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), when).alias("_row")).select(*keys, "_row.*") if rest else new.select(*keys).distinct()
    return base.unionByName(one.join(base.select(*keys), keys, "left_anti").select(*base.columns))


def replace_children(children: DataFrame, parent: str, lists: DataFrame, items: str, position: str = "position") -> DataFrame:
    """Deletes a parent's children and inserts its new list in order."""
    kept = children.join(lists.select(parent).distinct(), parent, "left_anti")
    new = lists.select(parent, F.posexplode(items).alias(position, "_item")).select(parent, position, "_item.*")
    return kept.select(*children.columns).unionByName(new.select(*children.columns))


def soft_delete(df: DataFrame, hit: Column, now: Column, column: str = "time_deleted") -> DataFrame:
    """Sets the deletion time where a row is hit and not deleted yet."""
    return df.withColumn(column, F.when(hit & F.col(column).isNull(), now).otherwise(F.col(column)))


def undelete(base: DataFrame, keys_df: DataFrame, keys: list[str], column: str = "time_deleted") -> DataFrame:
    """Inserts keys, or clears the deletion time of those that are there."""
    return add_missing_nulls(upsert(base.select(*keys, column), keys_df.select(*keys, F.lit(None).cast(base.schema[column].dataType).alias(column)), keys), column)


def add_missing_nulls(df: DataFrame, column: str) -> DataFrame:
    """max_by skips no null values, so a cleared column stays cleared; this only fixes its place."""
    return df.select(*[c for c in df.columns if c != column], column)


def balances(ledger: DataFrame, key: str, amount: str, kind: str, reversible: Column) -> DataFrame:
    """Sum of credits less debits; a refund counts only if it is reversible."""
    signed = F.when(F.col(kind) == "credit", F.col(amount)).when(F.col(kind) == "debit", -F.col(amount)).when((F.col(kind) == "refund") & reversible, -F.col(amount)).otherwise(0)
    return ledger.groupBy(key).agg(F.sum(signed).alias("balance"))


def reverted(messages: DataFrame, parts: DataFrame, message: str | Column, part: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Drops what comes after a message, or after a part within it (D11): later messages go, the
    message itself unless a part is named, and in it the parts from the named one on."""
    kept = messages.where(F.col("id") < message if part is None else F.col("id") <= message)
    left = parts.join(kept.select(F.col("id").alias("message_id")), "message_id", "left_semi")
    return kept, left if part is None else left.where((F.col("message_id") < message) | (F.col("id") < part))


def patched(df: DataFrame, key: str, patches: DataFrame, columns: list[str]) -> DataFrame:
    """Partial updates: ``patches`` has the key, ``present`` (names given) and the values (P19). A name
    that is given with null clears; one that is not given leaves the column."""
    p = patches.select(key, "present", *[F.col(c).alias(f"_n_{c}") for c in columns])
    out = df.join(p, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.array_contains(F.coalesce("present", F.array().cast("array<string>")), c), F.col(f"_n_{c}")).otherwise(F.col(c)))
    return out.select(*df.columns)


_SPACE = re.compile(r"[ \t\n\r]*")


def spliced(text: str | None, key: str, value: str | None) -> str | None:
    """A JSON object's text with one top-level key set to a JSON text, or removed; all else stays byte for
    byte. A null, or a text that isn't an object, stays as it is; a repeated key is set, or removed, everywhere."""
    if text is None:
        return None
    decoder, pairs = json.JSONDecoder(), []
    skip = lambda at: _SPACE.match(text, at).end()
    try:
        start = at = skip(0)
        if text[at] != "{":
            return text
        at = skip(at + 1)
        while text[at] != "}":
            begin = at
            name, at = decoder.raw_decode(text, at)
            colon = skip(at)
            if not isinstance(name, str) or text[colon] != ":":
                return text
            from_ = skip(colon + 1)
            _, at = decoder.raw_decode(text, from_)
            pairs.append((name, begin, from_, at))
            at = skip(at)
            if text[at] == ",":
                at = skip(at + 1)
                if text[at] == "}":
                    return text
            elif text[at] != "}":
                return text
        if text[at + 1:].strip(" \t\n\r"):
            return text
    except (ValueError, IndexError, RecursionError):
        return text
    hits = [p for p in pairs if p[0] == key]
    if value is not None and not hits:
        return text[:at] + ("," if pairs else "") + json.dumps(key) + ":" + value + text[at:]
    if value is not None:
        for _, _, a, b in reversed(hits):
            text = text[:a] + value + text[b:]
        return text
    if not hits:
        return text
    out, any_left = text[:pairs[0][1]], False
    for i, (name, begin, _, end) in enumerate(pairs):
        if name != key:
            out += text[pairs[i - 1][3] if any_left else begin:begin] + text[begin:end]  # what stood before a member stays before it
            any_left = True
    return out + text[pairs[-1][3]:]


def json_set(column: str, key: str, value: Column | None) -> Column:
    """Sets a top-level key of a JSON object, or removes it where the value is None (F23): numbers, booleans,
    nulls, arrays and nested objects of the other keys stay byte for byte. A null value sets null."""
    if value is None:
        return F.pandas_udf(lambda s: s.map(lambda t: spliced(t, key, None), na_action="ignore"), "string")(column)

    def put(s: pd.Series, v: pd.Series) -> pd.Series:
        values = [x[5:-1] if x != "{}" else "null" for x in v]  # {"v":...}
        return pd.Series([spliced(t, key, x) for t, x in zip(s, values, strict=True)], dtype=object)

    return F.pandas_udf(put, "string")(F.col(column), F.to_json(F.struct(value.alias("v"))))


_POINTER = "name string, version long, path string"


def _newest(spark: SparkSession, root: str, name: str):
    p = spark.read.schema(_POINTER).json(f"{root}/_pointers")
    return p.where(F.col("name") == name).orderBy(F.desc("version"), F.desc("path")).first()


def swap_in(df: DataFrame, root: str, name: str) -> str:
    """Writes a new version beside the old and switches the pointer table last (R15); readers of
    ``current`` see one version or the other, and a failed write leaves the old one. Versions are numbered."""
    spark, path = df.sparkSession, f"{root}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    pointers = spark.createDataFrame([], _POINTER)
    pointers.coalesce(1).write.mode("append").json(f"{root}/_pointers")  # so that there is a folder to read
    last = _newest(spark, root, name)
    spark.createDataFrame([(name, last.version + 1 if last else 0, path)], _POINTER).coalesce(1).write.mode("append").json(f"{root}/_pointers")
    return path


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The version with the highest number."""
    at = _newest(spark, root, name)
    if at is None:
        raise LookupError(f"no version of {name}")
    return spark.read.parquet(at.path)
