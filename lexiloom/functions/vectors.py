"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """The vector at length 1; a null for zero vectors, so that they match nothing."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 for empty, unequally long or zero vectors. Null stays null: unknown isn't 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    long = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (long == 0), F.lit(0.0)).otherwise(F.try_divide(dot(a, b), long))


def rounded(a: Column | str, digits: int = 5) -> Column:
    return F.transform(a, lambda x: F.round(x.cast("double"), digits))
