"""Tables that are built once and read often: files in a folder that the driver and all executors share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: What this process has built: (application, name) -> path and schema.
_BUILT: dict[tuple[str, str], tuple[str, StructType]] = {}
#: Files of fewer bytes a core are dealt over the cores before their rows are worked on.
SPREAD_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if everything runs on this machine, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="lexiloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _status(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def version(spark: SparkSession, path: str) -> str:
    """Changes when files at the path do: their bytes, their number, the time of the last change."""
    fs, at = _status(spark, path)
    summary = fs.getContentSummary(at)
    return f"{path}:{summary.getLength()}:{summary.getFileCount()}:{fs.getFileStatus(at).getModificationTime()}"


def kept(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table `make` gives, written once an application under a name that says all it depends on."""
    key = (spark.sparkContext.applicationId, name)
    if key in _BUILT:
        path, schema = _BUILT[key]
        fs, at = _status(spark, f"{path}/_SUCCESS")
        if fs.exists(at):
            return spark.read.schema(schema).parquet(path)
    path = f"{shared_dir(spark)}/lexiloom/kept-{key[0]}-{hashlib.sha256(name.encode()).hexdigest()[:24]}"
    df = make()
    df.write.mode("overwrite").parquet(path)
    _BUILT[key] = path, df.schema
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written under a name of its own and read back: a plan that reads it several times doesn't make it again, and partition numbers in it stay."""
    return kept(df.sparkSession, f"{name}-{uuid.uuid4().hex}", lambda: df)


def dropped(spark: SparkSession) -> None:
    """Removes what this application has kept or written; plans over it can't be run any more."""
    for key in [k for k in _BUILT if k[0] == spark.sparkContext.applicationId]:
        fs, at = _status(spark, _BUILT.pop(key)[0])
        fs.delete(at, True)


def spread(df: DataFrame, path: str, by: str) -> DataFrame:
    """df, read from the path, dealt by a column over all cores if its files are small; large files are split by the scan itself."""
    spark = df.sparkSession
    fs, at = _status(spark, path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, by) if fs.getContentSummary(at).getLength() < cores * SPREAD_BYTES else df
