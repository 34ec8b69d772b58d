"""Incremental ingest of match files with Structured Streaming.

New event files (one per match) dropped into a folder are picked up by a
file-source stream; every micro-batch holds whole files, hence whole
matches, so the batch operators (flatten, checks, halves, labels) give the
same result as a full run. Each epoch is written to its own folder with
overwrite, so a retried epoch replaces its own output (idempotent), and the
stream's checkpoint (in the shared checkpoint folder) records which files
are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tandem.config import REFERENCE_ROLES, Roles
from tandem.operators import labels as lb
from tandem.operators import quality as qa
from tandem.operators import sequence
from tandem.run import Run
from tandem.sources import files
from tandem.sources.schemas import EVENT_SCHEMA


def event_stream(spark: SparkSession, events_dir: str, multiline: bool = True,
                 files_per_batch: int = 100, schema=EVENT_SCHEMA) -> DataFrame:
    """Streaming nested events with ``match_id`` from each file's name."""
    stream = (spark.readStream.schema(schema).option("multiLine", multiline)
              .option("maxFilesPerTrigger", files_per_batch).json(events_dir))
    return stream.withColumn("match_id", files.id_from_path(F.col("_metadata.file_path")))


def process_batch(nested: DataFrame, epoch: int, out_dir: str, roles: Roles,
                  roster: DataFrame | None = None) -> None:
    """Label one micro-batch of whole matches and write labels (and findings
    when a roster is given) under ``epoch=<n>``. The batch is persisted for
    the epoch: the chunk tables and the outputs all read it, and the JSON
    files are parsed once."""
    with Run(nested.sparkSession) as run:
        flat = run.keep(files.flatten_events(nested, roles))
        events = sequence.layout(flat, [roles.match], roles.index, roles.chunk_width)
        labelled = sequence.drop_layout(lb.labelled(events, roles))
        (labelled.write.mode("overwrite").partitionBy(roles.match)
         .parquet(f"{out_dir}/labelled/epoch={epoch}"))
        if roster is not None:
            qa.findings(events, roster, roles).write.mode("overwrite") \
              .parquet(f"{out_dir}/findings/epoch={epoch}")


def start_label_ingest(spark: SparkSession, events_dir: str, out_dir: str,
                       roles: Roles = REFERENCE_ROLES, roster: DataFrame | None = None,
                       checkpoint: str | None = None, available_now: bool = True,
                       files_per_batch: int = 100) -> StreamingQuery:
    """Start the ingest; ``available_now`` processes what is there and stops
    (a scheduled incremental run), otherwise it keeps polling. The checkpoint
    lies beside the output unless given, so a later run goes on where the last
    one ended."""
    stream = event_stream(spark, events_dir, files_per_batch=files_per_batch)
    writer = (stream.writeStream
              .foreachBatch(lambda df, epoch: process_batch(df, epoch, out_dir, roles, roster))
              .option("checkpointLocation", checkpoint or f"{out_dir}/_checkpoint"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def read_labelled(spark: SparkSession, out_dir: str) -> DataFrame:
    """All labelled events written so far (every epoch)."""
    return spark.read.option("basePath", f"{out_dir}/labelled").parquet(f"{out_dir}/labelled/epoch=*")
