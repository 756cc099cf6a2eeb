"""Vector functions over array<float> columns; higher-order functions, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(a: Column) -> Column:
    """Unit length; a vector of tiny norm is left as it is."""
    n = norm(a)
    return F.when(n < TINY, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Zero where a norm is tiny."""
    d = norm(a) * norm(b)
    return F.when(d < TINY, F.lit(0.0)).otherwise(dot(a, b) / d)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def closeness(distance: Column) -> Column:
    """1 / (1 + d)."""
    return 1 / (1 + distance)


def token_set(s: Column) -> Column:
    """Distinct lower-cased tokens of two characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(s), r"[^A-Za-z0-9_]+"), lambda t: F.length(t) > 1))


def jaccard(a: Column, b: Column) -> Column:
    """Over two arrays taken as sets; both empty gives zero."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
