"""Reading the listed files of a season, and nothing else of their folders.

The paths come as a DataFrame. Spark's readers take paths as text from the
driver, so they go there in batches of bounded count and each batch is one scan,
whose rows are written to the run's scratch folder. A path that isn't there is no
error: the manifest check reports it. A file, or a record, that can't be parsed
is a reject: it is told apart by the reader's corrupt-record column and reported
with its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.config import REFERENCE_ROLES, Roles
from tandem.operators.quality import FINDING_COLUMNS
from tandem.session import scratch_path
from tandem.sources import files
from tandem.sources import manifest as mf
from tandem.sources.schemas import EVENT_SCHEMA, LINEUP_SCHEMA, MATCH_LIST_SCHEMA

FILES_PER_READ = 10_000
CORRUPT = "_corrupt_record"
FILE, FILE_MATCH = "_file", "_file_match"
SAMPLE = 200  # characters of a rejected record that a report shows


@dataclass(frozen=True)
class Parsed:
    """Rows of the files that were read, and a row per rejected record."""

    rows: DataFrame
    rejects: DataFrame


def batches(paths: DataFrame, size: int) -> Iterator[list[str]]:
    """The distinct paths in lists of at most ``size``; the driver holds one
    list and one partition of paths at a time."""
    held: list[str] = []
    for row in paths.select("path").where("path IS NOT NULL").distinct().toLocalIterator():
        held.append(row["path"])
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def literal(path: str) -> str:
    """A path that the reader doesn't take for a pattern."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", path)


def read_paths(spark: SparkSession, paths: DataFrame, schema: T.StructType, name: str, multiline: bool = True,
               id_pattern: str = files.FILE_STEM, files_per_read: int = FILES_PER_READ) -> Parsed:
    """JSON records of the files in ``path``, with ``match_id`` from the file's
    name; null paths are left out and repeated ones read once.

    Rejects: ``match_id``, ``file`` and ``sample``, the beginning of the text
    that could not be parsed. In JSON Lines a record with a wrong type somewhere
    is a reject by itself; a multi-line file is one text, and all its records
    are rejects.
    """
    stage = scratch_path(spark, name)
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    staged = T.StructType([*wide.fields, T.StructField(FILE, T.StringType()), T.StructField(FILE_MATCH, T.StringType())])
    spark.createDataFrame([], staged).write.parquet(f"{stage}/read=none")
    for number, batch in enumerate(batches(paths, files_per_read)):
        found = (spark.read.schema(wide).option("multiLine", multiline).option("mode", "PERMISSIVE")
                 .option("columnNameOfCorruptRecord", CORRUPT).option("ignoreMissingFiles", True).json([literal(p) for p in batch]))
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        found = found.select(*schema.names, F.substring(CORRUPT, 1, SAMPLE).alias(CORRUPT), path.alias(FILE), files.id_from_path(path, id_pattern).alias(FILE_MATCH))
        found.write.mode("overwrite").parquet(f"{stage}/read={number}")
    every = spark.read.schema(staged).parquet(stage)
    own = [] if "match_id" in schema.names else [F.col(FILE_MATCH).alias("match_id")]
    rows = every.where(F.col(CORRUPT).isNull()).select(*schema.names, *own)
    rejects = every.where(F.col(CORRUPT).isNotNull()).select(
        F.col(FILE_MATCH).alias("match_id"), F.col(FILE).alias("file"), F.col(CORRUPT).alias("sample"))
    return Parsed(rows, rejects)


def present(spark: SparkSession, folder: str, kind: str, matches: DataFrame | None = None, glob: str = "*.json") -> DataFrame:
    """(match_id, kind, path) of the files under ``folder``: of the listed
    matches if a match list is given, with the paths as the listing spells them."""
    listed = files.listing(spark, folder, glob).select(files.id_from_path(F.col("path")).alias("match_id"), F.lit(kind).alias("kind"), "path")
    if matches is None:
        return listed
    wanted = matches.select(F.col("match_id").cast("string").alias("match_id")).where("match_id IS NOT NULL").distinct()
    return listed.join(wanted, "match_id", "left_semi")


def read_events(spark: SparkSession, folder: str, matches: DataFrame | None = None, roles: Roles = REFERENCE_ROLES,
                multiline: bool = True, files_per_read: int = FILES_PER_READ) -> Parsed:
    """Flat canonical events of the listed matches."""
    got = read_paths(spark, present(spark, folder, mf.EVENT_KIND, matches), EVENT_SCHEMA, "events-read", multiline, files_per_read=files_per_read)
    return Parsed(files.flatten_events(got.rows, roles), got.rejects)


def read_lineups(spark: SparkSession, folder: str, matches: DataFrame | None = None, multiline: bool = True,
                 files_per_read: int = FILES_PER_READ) -> Parsed:
    """Roster rows of the listed matches."""
    got = read_paths(spark, present(spark, folder, mf.LINEUP_KIND, matches), LINEUP_SCHEMA, "lineups-read", multiline, files_per_read=files_per_read)
    return Parsed(files.roster_from_lineups(got.rows), got.rejects)


def read_match_list(spark: SparkSession, path: str, multiline: bool = True) -> Parsed:
    """The match list: records without an id are dropped, as they name no file;
    rejects as in ``read_paths``."""
    paths = files.listing(spark, path)
    got = read_paths(spark, paths, MATCH_LIST_SCHEMA, "matches-read", multiline)
    return Parsed(got.rows.where("match_id IS NOT NULL"), got.rejects)


def reject_findings(rejects: DataFrame, kind: str) -> DataFrame:
    """A finding per file with rejects; its value says how many and which file."""
    per_file = rejects.groupBy("match_id", "file").agg(F.count(F.lit(1)).alias("n"))
    return per_file.select("match_id", F.lit(f"unreadable_{kind}").alias("check"), F.lit(None).cast("long").alias("index"),
                           F.concat(F.col("n").cast("string"), F.lit(" in "), "file").alias("value")).select(*FINDING_COLUMNS)
