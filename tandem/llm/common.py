"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark resolves."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut, and
    a lost executor costs a reread, not a recomputation. Shuffle files of the
    finished step go when the driver's garbage is collected, so ask for that."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def shards(rows: int, per_shard: int) -> int:
    """Number of shards of at most about ``per_shard`` rows."""
    return max(1, math.ceil(rows / per_shard))


SLOTS = 1 << 25


def maybe_in(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys may be among those of ``wanted``, before a join shuffles
    them: all rows of ``wanted``'s keys pass, and a few others."""
    return flagged(rows, wanted, keys).where("maybe__").select(*rows.columns)


def flagged(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``maybe__``: false only if their keys aren't among those of
    ``wanted``, which becomes bitmaps of ``SLOTS`` bits by hash, 4 MB to
    broadcast whatever its size."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS))
    bucket, bit = F.call_function("shiftright", slot, F.lit(15)).cast("int"), slot.bitwiseAND(F.lit(32767)).cast("int")
    marks = wanted.select(bucket.alias("bucket__"), bit.alias("bit__")).groupBy("bucket__").agg(
        F.bitmap_construct_agg("bit__").alias("marks__"))
    byte = F.conv(F.hex(F.substring("marks__", F.floor(F.col("bit__") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_bit = F.call_function("shiftright", byte, F.pmod(F.col("bit__"), F.lit(8))).bitwiseAND(F.lit(1)) == 1
    asked = rows.select("*", bucket.alias("bucket__"), bit.alias("bit__")).join(F.broadcast(marks), "bucket__", "left")
    return asked.select(*rows.columns, F.coalesce(set_bit, F.lit(False)).alias("maybe__"))


def discard(df: DataFrame) -> None:
    """Delete a table that ``stored`` wrote and nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batch: pa.RecordBatch, name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece sum to about ``limit`` bytes."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(column(batch, name)).to_pylist()):
        if size and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)
