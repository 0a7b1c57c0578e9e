"""The Parquet lake: a catalog, and query logs partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import schemas


def write_catalog(docs: DataFrame, root: str, files: int | None = None) -> str:
    """root/catalog in snappy Parquet; `files` bounds their number for small catalogs."""
    path = f"{root.rstrip('/')}/catalog"
    (docs.coalesce(files) if files else docs).write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def write_query_log(logs: DataFrame, root: str, files_per_day: int = 1) -> str:
    """root/logs partitioned by ts, `files_per_day` files a day: a day's rows are dealt over that many tasks, so a hot day doesn't meet in one."""
    path = f"{root.rstrip('/')}/logs"
    dealt = logs.repartition("ts") if files_per_day == 1 else logs.repartition("ts", F.pmod(F.xxhash64(*logs.columns), F.lit(files_per_day)))
    dealt.write.mode("overwrite").partitionBy("ts").parquet(path)
    return path


def read_catalog(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOG).parquet(f"{root.rstrip('/')}/catalog")


def read_query_log(spark: SparkSession, root: str) -> DataFrame:
    """The log; filters on ts prune directories."""
    return spark.read.schema(schemas.QUERY_LOG).parquet(f"{root.rstrip('/')}/logs")


def lake_stats(spark: SparkSession, root: str) -> DataFrame:
    """name, files, bytes, rows, partitions of the catalog and the logs, from file metadata and row counts."""
    def of(name: str, partitions) -> DataFrame:
        rows = spark.read.parquet(f"{root.rstrip('/')}/{name}").select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_size").alias("__b"))
        by_file = rows.groupBy("__f").agg(F.first("__b").alias("b"), F.count(F.lit(1)).alias("n"))
        return by_file.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("files"), F.sum("b").alias("bytes"), F.sum("n").alias("rows"), partitions)

    day = F.regexp_extract("__f", "/ts=([^/]+)/", 1)
    return of("catalog", F.lit(0).cast("long").alias("partitions")).unionByName(of("logs", F.count_distinct(day).alias("partitions")))


def query_log_from_events(events: DataFrame) -> DataFrame:
    """An event table as a query log: ts, query, n_results, clicked."""
    k = F.get_json_object("props", "$.k").cast("int")
    n = F.floor(F.col("value") / 20).cast("int")
    return events.select(F.to_date("ts").alias("ts"), F.concat("event_type", F.lit("-"), F.pmod(k, F.lit(20)).cast("string")).alias("query"), n.alias("n_results"), ((F.col("value") >= 20) & F.col("event_type").isin("click", "purchase")).alias("clicked"))
