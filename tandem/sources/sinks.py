"""Sinks: Parquet outputs, bucketed intermediate tables, model folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.run import current
from tandem.session import scratch_path


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a Parquet folder; large outputs stay split (by match if
    asked), nothing is funnelled through one task."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def save_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to a scratch folder of the current run and read it back:
    lineage is cut, and its values can't change when a task runs again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json_arrays(records: DataFrame, path: str, folders: list[str], value: str) -> None:
    """Multi-line JSON files of one array each, a file for every value of the
    ``folders`` columns (``folder=value/...``); ``value`` holds an array of
    structs."""
    text = F.to_json(value, {"pretty": "true"}).alias("value")
    records.select(*folders, text).repartition(*folders).write.mode("overwrite").partitionBy(*folders).text(path)


def save_laid_out(df: DataFrame, keys: list[str], name: str = "laid") -> DataFrame:
    """Write a frame that is hash-partitioned on ``keys`` as a bucketed table
    in the shared checkpoint folder and read it back.

    This cuts the lineage (a lost executor re-reads files, it does not replay
    the upstream), and the bucketed scan reports the same hash partitioning,
    so windows, chunk aggregates and joins on ``keys`` that follow run with no
    shuffle at all.
    """
    from tandem.operators.sequence import layout_partitions

    spark = df.sparkSession
    n = layout_partitions(spark)
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    if n > most:
        raise ValueError(f"a layout of {n} partitions needs spark.sql.sources.bucketing.maxBuckets of {n} or more; it is {most}")
    table = f"tandem_{name}_{uuid.uuid4().hex[:12]}"
    current(spark).own_table(table)
    (df.write.mode("overwrite").bucketBy(n, *keys)
     .option("path", scratch_path(spark, table)).saveAsTable(table))
    return spark.table(table)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
