"""A session for use outside a cluster's own launcher. Operators never create or stop one."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "lexiloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """The active session if there is one, else a local one. Adaptive execution stays on: it sizes shuffles, splits skewed joins and broadcasts only measured sides."""
    return (
        SparkSession.getActiveSession()
        or SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.sql.shuffle.partitions", shuffle_partitions).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )
