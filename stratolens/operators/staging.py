"""Frames that are read more than once, written in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..streaming.jobs import shared_dir


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over as many tasks as the session shuffles into, by a hash of keys: a file of one row group would be one task, and tasks of few, large partitions hold much at once."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: cuts the lineage, and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(f"{path}/rows")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
