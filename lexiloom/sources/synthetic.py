"""Synthetic catalogs and query logs from hashes of row numbers: the same for any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The shares of the mix.
FAN_RATIO, FAILING, HEALTHY, NOISE_EMPTY, CLICKS = 0.02, 0.12, 0.75, 0.30, 0.35
KINDS = ("커튼", "텐트", "우산", "책상", "조명", "텀블러", "운동화", "충전기")
QUALITIES = ("경량", "대용량", "무선", "프리미엄", "접이식", "미니", "방수", "국산")
FAN = "아이돌 팬 미팅 굿즈"


def uniform(seed: int, *salt: str) -> Column:
    """A number in [0, 1) by the row's id, the seed and a salt."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), *map(F.lit, salt)), F.lit(1 << 52)) / float(1 << 52)


def _pick(values: Sequence[str], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def synthesize_catalog(spark: SparkSession, n: int, seed: int = 7, fan_ratio: float = FAN_RATIO, original: DataFrame | None = None) -> DataFrame:
    """n rows S0000001..., the first share of them about fans; behind the original catalog if one is given."""
    fan = F.col("id") < int(n * fan_ratio)
    kind, quality = _pick(KINDS, uniform(seed, "kind")), _pick(QUALITIES, uniform(seed, "quality"))
    rows = spark.range(n).select(
        F.format_string("S%07d", F.col("id") + 1).alias("doc_id"), F.when(fan, F.concat_ws(" ", F.lit(FAN), (F.col("id") + 1).cast("string"))).otherwise(F.concat_ws(" ", quality, kind)).alias("name"),
        F.when(fan, F.lit("팬 사인회 기념품")).otherwise(F.concat_ws(" ", kind, F.lit("추천"), _pick(QUALITIES, uniform(seed, "more")))).alias("description"), F.when(fan, F.lit("굿즈")).otherwise(kind).alias("category"),
    )
    return rows if original is None else original.select(*rows.columns).unionByName(rows)


def synthesize_query_log(spark: SparkSession, n: int, failing: Sequence[str], healthy: Sequence[str], seed: int = 7, days: int = 7, start: str = "2026-08-10") -> DataFrame:
    """n log rows: 12 % failing queries without results, 63 % healthy ones, noise with 30 % empty; ranks fall off as u squared; clicks only on results."""
    u, squared = uniform(seed, "class"), uniform(seed, "rank") * uniform(seed, "rank")
    bad, good = u < FAILING, (u >= FAILING) & (u < HEALTHY)
    noise = F.concat(F.lit("검색어"), F.floor(squared * 500).cast("string"))
    query = F.when(bad, _pick(failing, squared)).when(good, _pick(healthy, squared)).otherwise(noise)
    empty = bad | (~good & (uniform(seed, "empty") < NOISE_EMPTY))
    results = F.when(empty, 0).otherwise(1 + F.floor(uniform(seed, "n") * 40)).cast("int")
    return spark.range(n).select(F.date_add(F.lit(start).cast("date"), F.pmod(F.col("id"), F.lit(days)).cast("int")).alias("ts"), query.alias("query"), results.alias("n_results"), ((results > 0) & (uniform(seed, "click") < CLICKS)).alias("clicked"))
