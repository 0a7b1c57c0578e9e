"""Terms of ranking and evaluation formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, RRF_K = 1.2, 0.75, 60
#: Contributions are summed as integers of this fraction, so that the order of a distributed sum doesn't matter.
QUANTUM = 1e9


def idf(n: Column, df: Column) -> Column:
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def bm25_term(idf_: Column, tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    return idf_ * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl))


def exact_sum(x: Column) -> Column:
    """The sum of x to nine decimals, the same whatever the order."""
    return F.sum(F.round(x * QUANTUM).cast("long")) / QUANTUM


def gain(grade: Column, rank: Column) -> Column:
    """A hit's share of discounted cumulative gain, ranks from 1."""
    return (F.pow(F.lit(2.0), grade) - 1.0) / F.log2(rank + 1.0)


def rrf(rank: Column, k: int = RRF_K) -> Column:
    """Reciprocal-rank fusion's share; 0 without a rank."""
    return F.coalesce(1.0 / (k + rank), F.lit(0.0))
