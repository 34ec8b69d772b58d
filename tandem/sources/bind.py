"""Binding of the driver's flat tables to event roles (FIXTURES.md section 2).

``events`` carries no matches, teams or nested fields, so they are derived:
a match is a calendar day, the position in the match is the row number by
``event_id``, the side is ``user_id % 2`` and the ball holder ``k % 2`` with
``k`` read from the JSON ``props``. ``customer`` is the roster, ``orders`` the
match list and ``lineitem`` the listing of files that exist.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.config import TABLE_ROLES, Roles
from tandem.operators import sequence
from tandem.sources import manifest as mf

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_roles(events: DataFrame, roles: Roles = TABLE_ROLES) -> DataFrame:
    """Flat event columns of the roles from raw ``events`` columns (plus any
    extra columns, such as ``index``, that are carried through)."""
    r = roles
    k = F.get_json_object("props", "$.k").try_cast("int")
    extra = [c for c in events.columns if c not in RAW_COLUMNS and c != r.match]
    # keep an existing match column as is: it is the partitioning key
    match = F.col(r.match) if r.match in events.columns else F.to_date("ts").cast("string").alias(r.match)
    return events.select(
        F.col("event_id"),
        match,
        *extra,
        F.col("event_type").alias(r.type),
        F.col("user_id").alias(r.player),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias(r.player_name),
        (F.col("user_id") % 2).alias(r.team),
        (k % 2).cast("long").alias(r.holder),
        F.array(F.col("value"), k.cast("double")).alias(r.location),
        F.col("value").alias(r.x),
        k.cast("double").alias(r.y),
        F.date_format("ts", "HH:mm:ss.SSS").alias(r.time_text),
        F.when(F.col("event_type") == "signup", k).cast("long").alias(r.substitute),
    )


RAW_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")


def bind_events(events: DataFrame, roles: Roles = TABLE_ROLES) -> DataFrame:
    """Canonical event rows with ``index`` = row number in the match by
    ``event_id``, laid out by (match, chunk) for the sequence operators that
    follow. Ids run through all matches, so chunk bounds come from row counts;
    a chunk is monotone in ``index`` too.

    Only the raw columns cross the layout shuffle (they are narrower than
    the derived ones); JSON parsing, time text and names are computed after
    it, in parallel over the (match, chunk) partitions.
    """
    raw = events.select(*RAW_COLUMNS, F.to_date("ts").cast("string").alias(roles.match))
    indexed = sequence.row_numbers(raw, [roles.match], "event_id", roles.index, roles.chunk_width, by_position=True)
    return event_roles(indexed, roles)


def roster(customer: DataFrame) -> DataFrame:
    """Players allowed in any match: customers with a non-negative balance."""
    return customer.filter(F.col("c_acctbal") >= 0).select(F.col("c_custkey").alias("player_id"))


def match_list(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("match_id"))


def listing_from(lineitem: DataFrame, event_prefix: str, lineup_prefix: str) -> DataFrame:
    """Paths that exist: an event file and a lineup file per order key that
    has line items. Keys are de-duplicated first (combined map-side), so
    paths are built once per key, not once per line item."""
    keys = lineitem.select(F.col("l_orderkey")).distinct()
    return keys.select(F.explode(F.array(
        mf.file_path(event_prefix, F.col("l_orderkey")),
        mf.file_path(lineup_prefix, F.col("l_orderkey")))).alias("path"))


def standin_probabilities(bound: DataFrame, roles: Roles = TABLE_ROLES) -> DataFrame:
    """Deterministic probabilities keyed by event, multiples of 1/1024 so that
    every sum over them is exact in any order (used where model output would
    make results depend on partitioning)."""
    eid = F.col("event_id")
    k = F.col(roles.y).cast("long")

    def p(expr):
        return (expr % 1024).cast("double") / F.lit(1024.0)

    return bound.withColumns({
        "p_score": p(eid * 37),
        "p_concede": p(eid * 101),
        "p_keep": p(eid * 211 + F.col(roles.player) * 7),
        "p_lose": p(eid * 307 + k),
    })
