"""A hot match: two thirds of all events moved onto one day. The layout must
spread that match over many partitions, and labels and pair totals must still
equal DuckDB's plain-window oracle on the same rows."""

import datetime

import duckdb
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tandem.config import TABLE_ROLES
from tandem.operators import labels as lb
from tandem.operators import sequence
from tandem.plans import season
from tandem.plans.oracle import SQL

R = TABLE_ROLES.with_(chunk_width=32)


@pytest.fixture(scope="module")
def hot_dir(tmp_path_factory, sf_small):
    out = tmp_path_factory.mktemp("hot")
    events = pq.read_table(f"{sf_small}/events.parquet")
    ts = events.column("ts").to_pylist()
    ids = events.column("event_id").to_pylist()
    hot_day = datetime.date(2024, 1, 7)
    moved = [datetime.datetime.combine(hot_day, t.time()) if i % 3 else t for i, t in zip(ids, ts)]
    events = events.set_column(events.schema.get_field_index("ts"), "ts",
                               pc.cast(moved, events.schema.field("ts").type))
    pq.write_table(events, out / "events.parquet")
    return str(out)


def _duck(hot_dir, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{hot_dir}/events.parquet')")
    return sorted(con.execute(sql).fetchall(), key=str)


def test_hot_match_is_spread(spark, hot_dir):
    ev = season.bound_events(spark, hot_dir, R)
    n_hot = ev.filter(F.col("match_id") == "2024-01-07").count()
    assert n_hot > ev.count() / 2
    per_part = ev.filter(F.col("match_id") == "2024-01-07") \
                 .groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per_part) >= 4
    assert max(r["count"] for r in per_part) < n_hot / 2
    assert ev.select(sequence.CHUNK).filter(F.col("match_id") == "2024-01-07").distinct().count() > 10


def test_hot_match_labels_equal_oracle(spark, hot_dir):
    lab = lb.labelled(season.bound_events(spark, hot_dir, R), R)
    for label in R.labels:
        ours = sorted(map(tuple, lab.select("match_id", "index", label).collect()), key=str)
        assert ours == _duck(hot_dir, SQL[label]), label


def test_hot_match_pairs_equal_oracle(spark, hot_dir):
    totals = season.pair_totals(season.standin_input(season.bound_events(spark, hot_dir, R), R), R)
    ours = sorted(map(tuple, totals.select("pair", "season_modified", "season_plain").collect()), key=str)
    assert ours == _duck(hot_dir, SQL["season_pair_totals"])
