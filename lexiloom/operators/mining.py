"""Mining of query logs for failing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_VOLUME, LIMIT = 3, 50


def mining_sql(view: str = "logs", min_volume: int = MIN_VOLUME, limit: int = LIMIT, where: str = "true") -> str:
    """The mining query as SQL that Spark and other engines take alike."""
    return f"""
        select query, count(*) as volume, cast(sum(case when n_results = 0 then 1 else 0 end) as bigint) as zero_results, cast(sum(case when clicked then 1 else 0 end) as bigint) as clicks
        from {view} where {where} group by query having count(*) >= {int(min_volume)} and sum(case when n_results = 0 then 1 else 0 end) > 0
        order by zero_results desc, volume desc, query limit {int(limit)}"""


def counts(logs: DataFrame) -> DataFrame:
    """query, volume, zero_results, clicks: combined in each task before the shuffle."""
    return logs.groupBy("query").agg(F.count(F.lit(1)).alias("volume"), F.count_if(F.col("n_results") == 0).alias("zero_results"), F.count_if(F.col("clicked")).alias("clicks"))


def candidates(logs: DataFrame, min_volume: int = MIN_VOLUME, limit: int | None = LIMIT, since=None, until=None) -> DataFrame:
    """query, volume, zero_results, clicks, zero_rate, impact of queries that found nothing at least once; a range of days prunes the partitions of ts."""
    if since is not None:
        logs = logs.where(F.col("ts") >= F.lit(since).cast("date"))
    if until is not None:
        logs = logs.where(F.col("ts") <= F.lit(until).cast("date"))
    found = counts(logs).where((F.col("volume") >= min_volume) & (F.col("zero_results") > 0))
    found = found.withColumn("zero_rate", F.round(F.col("zero_results") / F.col("volume"), 4)).withColumn("impact", F.col("zero_results"))
    return found if limit is None else found.orderBy(F.desc("zero_results"), F.desc("volume"), "query").limit(limit)


def mine(logs: DataFrame, engine: str = "spark", **options) -> DataFrame:
    """candidates() by engine name; there is one engine here."""
    if engine != "spark":
        raise ValueError(f"unknown engine: {engine!r}")
    return candidates(logs, **options)
