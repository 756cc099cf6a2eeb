"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.scan import Scan
from quillspark.session import scratch

DAY_MS = 86_400_000
KINDS = ("input", "output", "reasoning", "cache_read", "cache_write")


def null_zero(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def totals(messages: DataFrame) -> DataFrame:
    """Messages, cost and five token kinds; only assistant messages cost."""
    own = F.col("role") == "assistant"
    return messages.agg(
        F.count("*").alias("messages"),
        null_zero(F.when(own, F.coalesce("cost", F.lit(0)))).alias("cost"),
        *[null_zero(F.when(own, F.coalesce(k, F.lit(0)))).alias(k) for k in KINDS],
    )


def model_usage(messages: DataFrame) -> DataFrame:
    """By provider/model; here output includes reasoning, unlike in ``totals``."""
    own = messages.where("role = 'assistant'")
    zero = lambda k: F.coalesce(k, F.lit(0))
    return own.groupBy(F.concat_ws("/", "provider", "model").alias("model")).agg(
        F.count("*").alias("messages"), null_zero("cost").alias("cost"), null_zero("input").alias("input"),
        null_zero(zero("output") + zero("reasoning")).alias("output"),
        null_zero("cache_read").alias("cache_read"), null_zero("cache_write").alias("cache_write"),
    )


def median(c: str) -> Column:
    """Exact, the mean of the middle two for an even count, 0 if empty."""
    return F.coalesce(F.percentile(c, 0.5), F.lit(0.0))


def medians(df: DataFrame, keys: list[str], value: str, into: str = "median") -> DataFrame:
    """The exact median of every group of any size (A05): the mean of the middle two for an even count, 0
    where all values are null.

    Equal values are counted first; the running number of values, in order, says which one holds the middle
    ranks. No task keeps a group's values, and a large group is many tasks."""
    each = df.groupBy(*keys, value).agg(F.count(value).alias("_n"))
    scan = Scan(each, keys, [value])
    upto = scan.running(scan.rows, {"_upto": ("sum", F.col("_n"))})
    groups = df.groupBy(*keys).agg(F.count(value).alias("_all"))
    for k in keys:
        groups = groups.withColumnRenamed(k, f"_{k}_")
    same = F.lit(True)
    for k in keys:
        same = same & upto[k].eqNullSafe(groups[f"_{k}_"])
    low, high = F.expr("(_all + 1) div 2"), F.expr("(_all + 2) div 2")
    holds = lambda t: (F.col("_upto") - F.col("_n") < t) & (t <= F.col("_upto"))
    x = F.col(value).cast("double")
    at = upto.join(groups, same).groupBy(*keys).agg(F.max(F.when(holds(low), x)).alias("_low"), F.max(F.when(holds(high), x)).alias("_high"))
    return at.select(*keys, F.coalesce((F.col("_low") + F.col("_high")) / 2, F.lit(0.0)).alias(into))


def per_day(first: Column, last: Column, window_days: int | None) -> Column:
    """Days to divide by."""
    span = F.greatest(F.lit(1), F.ceil((last - first) / DAY_MS))
    return span.cast("long") if window_days is None else F.lit(max(window_days, 1)).cast("long")


def dense(df: DataFrame, spine: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every combination of the spine; missing values are zero."""
    return spine.join(df, keys, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def top_models(df: DataFrame, group: str, model: str, amount: str, n: int = 3) -> DataFrame:
    """model1, percent1 ... padded with '-' (A13)."""
    w = Window.partitionBy(group).orderBy(F.desc(amount), model)
    rows = df.withColumn("_n", F.row_number().over(w)).withColumn("_total", F.sum(amount).over(Window.partitionBy(group)))
    share = F.when(F.col("_total") > 0, F.concat(F.format_string("%.1f", F.col(amount) / F.col("_total") * 100), F.lit("%"))).otherwise("0.0%")
    cells = []
    for k in range(1, n + 1):
        pick = lambda c, k=k: F.coalesce(F.max(F.when(F.col("_n") == k, c)), F.lit("-"))
        cells += [pick(F.col(model)).alias(f"model{k}"), pick(share).alias(f"percent{k}")]
    return rows.where(f"_n <= {n}").groupBy(group).agg(*cells)


def with_total(df: DataFrame, label: str, name: str, summed: list[str]) -> DataFrame:
    """A TOTAL row below the others, in which only the listed columns are filled."""
    total = df.agg(*[F.sum(c).alias(c) for c in summed])
    cells = [F.lit(name).alias(label) if c == label else F.col(c) if c in summed else F.lit(None).cast(t).alias(c) for c, t in df.dtypes]
    return df.unionByName(total.select(*cells))


def context_share(chars: DataFrame, key: str, role: str, size: str, limit: str) -> DataFrame:
    """Estimated tokens by role, scaled down to the input they share; the rest is 'other' (A21)."""
    est = chars.groupBy(key, role).agg(F.ceil(F.sum(size) / 4).cast("long").alias("tokens"), F.max(limit).alias("_limit"))
    whole = F.sum("tokens").over(Window.partitionBy(key))
    scaled = F.when(whole > F.col("_limit"), F.floor(F.col("tokens") * F.col("_limit") / whole).cast("long")).otherwise(F.col("tokens"))
    est = est.withColumn("tokens", scaled)
    rest = est.groupBy(key).agg((F.max("_limit") - F.sum("tokens")).alias("tokens"), F.max("_limit").alias("_limit")).withColumn(role, F.lit("other"))
    both = est.unionByName(rest).where("tokens > 0")
    return both.select(key, role, "tokens", F.round(F.col("tokens") / F.col("_limit") * 100, 1).alias("percent"))


def last_where(df: DataFrame, key: str, keep: Column, order: Column, *cols: str) -> DataFrame:
    """The last row of each key that satisfies a condition."""
    return df.where(keep).groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_row")).select(key, "_row.*")


def first_and_last(df: DataFrame, key: str, first: str, last: str, order: Column) -> DataFrame:
    """The first value of one column and the last of another, nulls aside."""
    a = F.min_by(F.col(first), F.when(F.col(first).isNotNull(), order))
    b = F.max_by(F.col(last), F.when(F.col(last).isNotNull(), order))
    return df.groupBy(key).agg(a.alias(first), b.alias(last))


def score_matrix(results: DataFrame, tasks: list[str]) -> DataFrame:
    """Model by task scores from result JSON {averageScore, tasks: [{task, score}]}."""
    schema = "averageScore double, tasks array<struct<task:string,score:double>>"
    rows = results.select("model", F.from_json("result", schema).alias("r")).select("model", F.col("r.averageScore").alias("average"), F.explode("r.tasks").alias("t"))
    return rows.groupBy("model", "average").pivot("t.task", tasks).agg(F.max("t.score"))


def by_section(df: DataFrame, item: str, areas: str, priority: list[str]) -> DataFrame:
    """section, item, position: items under the first of their areas by priority, in order within their
    section (A25). Rows stay rows, so a section of any size is many tasks."""
    best = F.array_min(F.transform(areas, lambda a: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), a), F.lit(0)), F.lit(len(priority) + 1))))
    section = F.coalesce(F.get(F.array(*map(F.lit, priority)), (best - 1).cast("int")), F.lit("other"))
    return _positions(df.select(section.alias("section"), F.col(item).alias("item")), "section", "item")


def _positions(rows: DataFrame, group: str, item: str) -> DataFrame:
    """``rows`` with their position, from 1, in the order of items of a group."""
    scan = Scan(rows, [group], [item])
    return scan.running(scan.rows, {"position": ("count", F.lit(1))}).drop("_cell")


def without_reverts(commits: DataFrame, group: str, order: str, title: str) -> DataFrame:
    """Cancels pairs 'x' ... 'Revert "x"' in order, the latest x first; an unmatched revert
    stays, and can be reverted itself (A26). A null title stays.

    Titles of one root meet level by level: commits against their reverts, what reverts stay against
    theirs, and so on. At a level, with S the running sum of +1 for a title and -1 for its revert and
    M its running minimum, S - min(0, M) is how many stand; a revert is unmatched where S falls below all
    before, and a title stands to the end if the number never falls below what it was with it. All of these
    are running values, so a title that is committed and reverted endlessly is many tasks."""
    def nested(t: Column) -> Column:
        opening = F.length(F.regexp_extract(t, r'^((?:Revert ")*)', 1)) / 8
        return F.least(opening, F.length(F.regexp_extract(t, r'("*)$', 1))).cast("int")

    depth = F.coalesce(nested(F.col(title)), F.lit(0))
    root = F.substr(title, 8 * F.col("_depth") + 1, F.length(title) - 9 * F.col("_depth"))
    rows = commits.withColumn("_depth", depth).withColumn("_root", root)
    most = rows.agg(F.max("_depth")).first()[0] or 0
    for level in range(most):
        here = F.col("_depth").isin(level, level + 1) & F.col("_root").isNotNull()
        scan = Scan(rows.where(here), [group, "_root"], [order, "_depth"])
        at = scan.rows.withColumn("_step", F.when(F.col("_depth") == level, 1).otherwise(-1))
        at = scan.running(at, {"_sum": ("sum", F.col("_step"))})
        at = scan.running(at, {"_least": ("min", F.col("_sum"))}, exclusive=True)
        low = F.least(F.lit(0), F.col("_least"))
        at = at.withColumn("_lone", F.col("_sum") < low).withColumn("_stand", F.col("_sum") - F.least(low, F.col("_sum")))
        at = scan.running(at, {"_later": ("min", F.col("_stand"))}, exclusive=True, reverse=True)
        stays = F.when(F.col("_depth") == level, F.coalesce(F.col("_later") >= F.col("_stand"), F.lit(True))).otherwise(F.col("_lone"))
        rows = rows.where(~here).unionByName(at.where(stays).select(*rows.columns))
        if level + 1 < most:
            path = scratch(rows.sparkSession, "reverts")
            rows.write.parquet(path)
            rows = rows.sparkSession.read.parquet(path)
    return rows.select(*commits.columns)


def nested_sum(array: str, field: str) -> Column:
    """Sum of a field over an array of structs."""
    return F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x[field].cast("long"), F.lit(0)))


def deduplicated(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """First position, last value of every key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(order).alias("_at"), F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*", F.col("_at").alias("first_at"))


def grouped_lists(df: DataFrame, keep: Column, group: str, item: str) -> DataFrame:
    """Filter, group, sort within groups, sort groups: group, item, position in that order."""
    return _positions(df.where(keep).select(group, item), group, item).orderBy(group, "position")
