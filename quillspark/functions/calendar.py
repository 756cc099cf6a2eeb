"""Calendar functions, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def iso_yearweek(ts: Column) -> Column:
    """ISO year * 100 + ISO week."""
    return (F.extract(F.lit("YEAROFWEEK"), ts) * 100 + F.extract(F.lit("WEEK"), ts)).cast("long")


def week_start(ts: Column) -> Column:
    """Monday, midnight."""
    return F.date_trunc("week", ts)


def week_end(ts: Column) -> Column:
    return week_start(ts) + F.expr("INTERVAL 7 DAYS")


def month_start(ts: Column) -> Column:
    return F.date_trunc("month", ts)


def same_month(a: Column, b: Column) -> Column:
    """Month and year agree (F16)."""
    return (F.month(a) == F.month(b)) & (F.year(a) == F.year(b))


def _anchor(first: Column, subscribed: Column) -> Column:
    """The subscription's day and time in the month that starts at ``first``, clamped to its length."""
    day = F.least(F.dayofmonth(subscribed), F.dayofmonth(F.last_day(first)))
    since = F.unix_micros(subscribed) - F.unix_micros(F.date_trunc("day", subscribed))
    return F.timestamp_micros(F.unix_micros(first) + (day - 1).cast("long") * 86_400_000_000 + since)


def monthly_bounds(now: Column, subscribed: Column) -> tuple[Column, Column]:
    """Start and end of the month of a subscription in which ``now`` falls."""
    this = F.date_trunc("month", now)
    before = F.date_trunc("month", F.add_months(this, -1))
    after = F.date_trunc("month", F.add_months(this, 1))
    passed = _anchor(this, subscribed) <= now
    start = F.when(passed, _anchor(this, subscribed)).otherwise(_anchor(before, subscribed))
    end = F.when(passed, _anchor(after, subscribed)).otherwise(_anchor(this, subscribed))
    return start, end


def seconds_to_next_day(ms: Column) -> Column:
    """Whole seconds until the next UTC day, rounded up."""
    return F.ceil((DAY_MS - ms % DAY_MS) / 1000).cast("long")


def day_key(ts: Column) -> Column:
    """YYYYMMDD (F19)."""
    return F.date_format(ts, "yyyyMMdd")


def path_date(path: Column) -> Column:
    """The first YYYY-MM-DD in a path; null where there is none or it is no date."""
    return F.try_to_date(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")


def id_millis(id_: Column) -> Column:
    """Milliseconds encoded in a sortable id prefix_<12 hex>...; they wrap at 2^36."""
    hexed = F.regexp_extract(id_, r"^[a-z]+_([0-9a-f]{12})", 1)
    return F.floor(F.conv(hexed, 16, 10).cast("decimal(20,0)") / 4096).cast("long")
