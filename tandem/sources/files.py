"""Scans: nested JSON event/lineup/match-list files and Parquet folders.

One read covers a whole folder (a season); the match id of every row comes
from its file name, so no driver loop over files is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.config import REFERENCE_ROLES, Roles
from tandem.sources.schemas import EVENT_SCHEMA, LINEUP_SCHEMA, MATCH_LIST_SCHEMA

# File stem before the first dot: "events/3749052.json" -> "3749052".
FILE_STEM = r"([^/]+?)\.[^/]*$"
# Spark-written partition folder: ".../match_id=2024-01-01/part-..." -> "2024-01-01".
PARTITION_DIR = r"match_id=([^/]+)/"


def id_from_path(path: Column, pattern: str = FILE_STEM) -> Column:
    """Match id taken from a file path with a regular expression."""
    return F.regexp_extract(path, pattern, 1)


def read_json(spark: SparkSession, path: str, schema, multiline: bool = True) -> DataFrame:
    """JSON scan with an explicit schema. ``multiline`` reads files that each
    hold one JSON array (one file per task); JSON Lines input is splittable and
    is what large inputs should use."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_events(spark: SparkSession, path: str, multiline: bool = True,
                id_pattern: str = FILE_STEM, schema=EVENT_SCHEMA) -> DataFrame:
    """Nested events of all matches under ``path``, plus ``match_id``."""
    df = read_json(spark, path, schema, multiline)
    return df.withColumn("match_id", id_from_path(F.col("_metadata.file_path"), id_pattern))


def read_lineups(spark: SparkSession, path: str, multiline: bool = True,
                 id_pattern: str = FILE_STEM) -> DataFrame:
    df = read_json(spark, path, LINEUP_SCHEMA, multiline)
    return df.withColumn("match_id", id_from_path(F.col("_metadata.file_path"), id_pattern))


def read_match_list(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return read_json(spark, path, MATCH_LIST_SCHEMA, multiline)


def flatten_events(nested: DataFrame, roles: Roles = REFERENCE_ROLES) -> DataFrame:
    """Nested event records -> canonical flat event columns.

    Array items use ``get`` so that a short or NULL location gives NULL
    instead of an error under ANSI mode.
    """
    r = roles
    return nested.select(
        F.col("match_id").alias(r.match),
        F.col("index").alias(r.index),
        F.col("type.id").alias(r.type),
        F.col("player.id").alias(r.player),
        F.col("player.name").alias(r.player_name),
        F.col("team.id").alias(r.team),
        F.col("possession_team.id").alias(r.holder),
        F.col("location").alias(r.location),
        F.get(F.col("location"), 0).alias(r.x),
        F.get(F.col("location"), 1).alias(r.y),
        F.col("timestamp").alias(r.time_text),
        F.col("shot.outcome.id").alias("shot_outcome"),
        F.col("substitution.replacement.id").alias(r.substitute),
    )


def roster_from_lineups(lineups: DataFrame) -> DataFrame:
    """(match_id, team_id, player_id, player_name): one row per listed player."""
    return (lineups.select("match_id", "team_id", F.explode("lineup").alias("p"))
            .select("match_id", "team_id", F.col("p.player_id").alias("player_id"),
                    F.col("p.player_name").alias("player_name")))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """One scan over a folder of Parquet files (every match at once)."""
    return spark.read.parquet(path)


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Paths of the files under ``path``, read as a DataFrame. Only the
    ``path`` column is selected, so no file content is read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "true").load(path).select("path"))


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files under ``path``."""
    about = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    each = F.xxhash64("path", "length", F.col("modificationTime").cast("string")).cast("decimal(38,0)")
    n, total = about.select(each.alias("h")).agg(F.count(F.lit(1)), F.sum("h")).first()
    return f"{path}:{n}:{total}"


def nest_events(flat: DataFrame, roles: Roles) -> DataFrame:
    """Canonical flat events -> nested event records (the shape of the
    original event files), plus ``match_id``."""
    r = roles

    def ident(col):
        return F.when(F.col(col).isNotNull(), F.struct(F.col(col).alias("id")))

    shot = (F.when(F.col("shot_outcome").isNotNull(),
                   F.struct(F.struct(F.col("shot_outcome").alias("id")).alias("outcome")))
            if "shot_outcome" in flat.columns else F.lit(None).cast(EVENT_SCHEMA["shot"].dataType))
    player = F.when(F.col(r.player).isNotNull() | F.col(r.player_name).isNotNull(),
                    F.struct(F.col(r.player).alias("id"), F.col(r.player_name).alias("name")))
    sub = F.when(F.col(r.substitute).isNotNull(),
                 F.struct(F.struct(F.col(r.substitute).alias("id")).alias("replacement")))
    return flat.select(
        F.col(r.match).alias("match_id"), F.col(r.index).alias("index"),
        F.struct(F.col(r.type).alias("id")).alias("type"), player.alias("player"),
        ident(r.team).alias("team"), ident(r.holder).alias("possession_team"),
        F.col(r.location).alias("location"), F.col(r.time_text).alias("timestamp"),
        shot.alias("shot"), sub.alias("substitution"))
