"""Manifest of expected input files and the check that they exist.

The manifest is a DataFrame ``(match_id, kind, path)``; the listing of what
exists is a DataFrame of paths (``tandem.sources.files.listing``). A missing
file is a manifest row with no listing row: a left anti join, distributed,
instead of probing paths one by one from the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_KIND = "events"
LINEUP_KIND = "lineups"


def file_path(prefix: str, match_id: Column, suffix: str = ".json") -> Column:
    """``prefix + match_id + suffix``; NULL when the id is NULL."""
    return F.concat(F.lit(prefix), match_id.cast("string"), F.lit(suffix))


def manifest_wide(matches: DataFrame, event_prefix: str, lineup_prefix: str,
                  match_col: str = "match_id") -> DataFrame:
    """One row per match: the event file path and the lineup file path."""
    mid = F.col(match_col)
    return matches.select(mid.cast("string").alias("match_id"),
                          file_path(event_prefix, mid).alias("event_path"),
                          file_path(lineup_prefix, mid).alias("lineup_path"))


def manifest_long(matches: DataFrame, event_prefix: str, lineup_prefix: str,
                  match_col: str = "match_id") -> DataFrame:
    """One row per expected file: ``(match_id, kind, path)``."""
    wide = manifest_wide(matches, event_prefix, lineup_prefix, match_col)
    return wide.select("match_id", F.explode(F.array(
        F.struct(F.lit(EVENT_KIND).alias("kind"), F.col("event_path").alias("path")),
        F.struct(F.lit(LINEUP_KIND).alias("kind"), F.col("lineup_path").alias("path")),
    )).alias("f")).select("match_id", "f.kind", "f.path")


def missing_files(manifest: DataFrame, listed: DataFrame) -> DataFrame:
    """Manifest rows whose path is not among the listed paths, each kind on
    its own rows. The listing is de-duplicated first (map-side), so only
    distinct paths are shuffled into the anti join."""
    present = listed.select(F.col("path")).distinct()
    return manifest.join(present, "path", "left_anti").select("match_id", "kind", "path")


def listed_ids(listed: DataFrame) -> DataFrame:
    """Listing paths -> ``(kind, match_id)``: the parent folder names the
    kind, the file stem the match (``.../events/3749052.json``)."""
    return listed.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("kind"),
        F.regexp_extract("path", r"([^/]+?)\.[^/]*$", 1).alias("match_id")).distinct()


def missing_by_id(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Manifest rows whose (kind, match id) has no listed file; insensitive to
    how the two sides spell the folder (scheme, relative or absolute)."""
    return manifest.join(present, ["kind", "match_id"], "left_anti").select("match_id", "kind", "path")
