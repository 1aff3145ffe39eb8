"""Shared folders for intermediate tables, as the rest of the library has them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.store import dropped, shared_dir, written

__all__ = ["dropped", "shared_dir", "shuffle_partitions", "written"]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
