"""Many wildcard patterns against many texts.

A pattern holds literal text at its begin, its end or in between. The longest such piece, cut to one
of a few lengths, is its anchor; a text offers its own begins, ends and grams of the lengths that the
anchors have, and an equi-join on the anchor proposes the pairs that the whole pattern then verifies.
So each rule is looked up like a word in a trie, by a hash join that Spark broadcasts or shuffles by the
measured size of the rules, and splits where an anchor is hot.

Rules of one pattern are one rule, the last; patterns of wildcards alone say no more than a length, so
only the last rule of each length is kept, at most two for each length of a pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import wildcard
from quillspark.session import scratch

#: Lengths of begins and ends, and of grams from within.
ENDS, GRAMS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64), (1, 2, 3, 4, 6, 8)


def anchor(pattern: str) -> tuple[str, int, str]:
    """Kind ('=' whole, '<' begin, '>' end, '~' within, '*' none), length and text of a pattern's longest anchor."""
    core = pattern.replace("\\", "/")
    core = core[:-2] + "*" if core.endswith(" *") else core
    pieces = re.split(r"[*?]", core)
    if len(pieces) == 1:
        return "=", -1, core
    cut = lambda piece, lengths: max((n for n in lengths if n <= len(piece)), default=0)
    first, last, within = pieces[0], pieces[-1], max(pieces, key=len)
    a, b, c = cut(first, ENDS), cut(last, ENDS), cut(within, GRAMS)
    if not c:
        return "*", 0, ""
    if a >= max(b, c):
        return "<", a, first[:a]
    return (">", b, last[-b:]) if b >= c else ("~", c, within[:c])


def anchors(rules: DataFrame, pattern: str) -> DataFrame:
    """``rules`` that have a pattern, with _kind, _size, _anchor and the whole pattern as a regex, _rx."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(*anchor(p), wildcard(p)) for p in pdf["_p"]]
            yield pd.DataFrame([(p, *f) for p, f in zip(pdf["_p"], found, strict=True)], columns=["_p", "_kind", "_size", "_anchor", "_rx"])

    each = rules.where(F.col(pattern).isNotNull()).select(F.col(pattern).alias("_p")).distinct().mapInPandas(run, "_p string, _kind string, _size int, _anchor string, _rx string")
    return rules.join(each, F.col(pattern) == F.col("_p")).drop("_p")


def _offers(text: Column, kinds: list[tuple[str, int]]) -> Column:
    """(kind, size, anchor) of everything that a rule could be anchored on in a text."""
    def offer(kind: str, n: int, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("k"), F.lit(n).alias("n"), key.alias("a"))

    def within(n: int) -> Column:
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))
        return F.transform(grams, lambda g: offer("~", n, g))

    none, out = F.array().cast("array<struct<k:string,n:int,a:string>>"), []
    for kind, n in kinds:
        if kind == "=":
            found = F.array(offer("=", n, text))
        elif kind == "<":
            found = F.array(offer("<", n, F.substr(text, F.lit(1), F.lit(n))))
        elif kind == ">":
            found = F.array(offer(">", n, F.substr(text, F.length(text) - n + 1, F.lit(n))))
        else:
            found = within(n)
        out.append(F.when(F.length(text) >= n, found).otherwise(none))
    return F.concat(*out) if out else F.array().cast("array<struct<k:string,n:int,a:string>>")


def matches(requests: DataFrame, rules: DataFrame, text: str, pattern: str = "pattern", order: Column | None = None) -> DataFrame:
    """Every pair of a request and a rule whose pattern fits its text, with the columns of both.

    With ``order``, only the last rule of a pattern, and of patterns that say the same length, is kept."""
    rule_columns = rules.columns
    if order is not None:
        rest = [c for c in rule_columns if c != pattern]
        rules = rules.groupBy(pattern).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(pattern, "_r.*").select(*rule_columns)
    spark, at = rules.sparkSession, scratch(rules.sparkSession, "rules")
    anchors(rules, pattern).write.parquet(at)  # once; its size then says how it is joined
    placed = spark.read.parquet(at)
    kinds = [(r[0], r[1]) for r in placed.where("_kind <> '*'").select("_kind", "_size").distinct().collect()]  # at most a few of each kind
    offered = requests.withColumn("_o", F.explode(_offers(F.col(text), sorted(kinds))))
    on = (F.col("_o.k") == F.col("_kind")) & (F.col("_o.n") == F.col("_size")) & (F.col("_o.a") == F.col("_anchor"))
    fits = F.expr(f"`{text}` rlike _rx")
    hit = offered.join(placed.where("_kind <> '*'"), on).where(fits).select(*requests.columns, *rule_columns)
    bare = placed.where("_kind = '*'")
    if order is not None:
        star, least = F.contains(F.col(pattern), F.lit("*")), F.length(F.replace(F.col(pattern), F.lit("*"), F.lit("")))
        one = F.max_by(F.struct(*[c for c in placed.columns]), order).alias("_r")
        bare = bare.groupBy(star.alias("_star"), least.alias("_least")).agg(one).select("_r.*")
    few = bare.limit(FEW_BARE + 1).count() <= FEW_BARE
    length = requests.join(F.broadcast(bare) if few else bare, fits).select(*requests.columns, *rule_columns)
    return hit.unionByName(length)


#: Patterns without any literal that are sent to all requests; more are left to the planner.
FEW_BARE = 10_000


def last_rule(requests: DataFrame, rules: DataFrame, text: str, key: str, order: Column, value: str, default=None, pattern: str = "pattern") -> DataFrame:
    """For each request the value of the last rule that fits, or the default.

    Requests are told apart by ``key``; one that no rule fits stays."""
    hit = matches(requests.select(key, text), rules, text, pattern, order).groupBy(key).agg(F.max_by(value, order).alias(value))
    out = requests.select(key).join(hit, key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(value, F.lit(default)))
