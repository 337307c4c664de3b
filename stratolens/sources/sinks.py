"""Writing tables: rebuilds, replaced partitions, logs, and batches of a stream that may come twice."""

from __future__ import annotations

from pyspark.sql import DataFrame


def rebuild(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that df has rows of; all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_batch(tables: dict[str, str]):
    """For foreachBatch: writes each named split of a batch under the batch's number, so a batch that comes again replaces itself. tables: path of each value of the column `kind`."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            for kind, path in tables.items():
                rows.filter(rows["kind"] == kind).drop("kind").write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            rows.unpersist()

    return write
