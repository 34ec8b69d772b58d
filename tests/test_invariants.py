"""Invariants: results do not depend on the chunk width or the number of
partitions; labels never look past a half; the value stage keeps every
event but the first of each match."""

import pytest
from pyspark.sql import functions as F

from tandem.config import TABLE_ROLES
from tandem.operators import labels as lb
from tandem.operators import value as vl
from tandem.plans import season
from tandem.sources import bind


def _ranking(spark, sf_dir, roles):
    events = bind.bind_events(bind.table(spark, sf_dir, "events"), roles)
    return sorted(map(tuple, season.pair_totals(season.standin_input(events, roles), roles).collect()),
                  key=str)


def _labels(spark, sf_dir, roles):
    events = bind.bind_events(bind.table(spark, sf_dir, "events"), roles)
    return sorted(map(tuple, lb.labelled(events, roles).select("match_id", "index", *roles.labels).collect()))


@pytest.mark.parametrize("width", [7, 64])
def test_chunk_width_does_not_matter(spark, sf_small, width):
    narrow = TABLE_ROLES.with_(chunk_width=width)
    assert _ranking(spark, sf_small, narrow) == _ranking(spark, sf_small, TABLE_ROLES)
    assert _labels(spark, sf_small, narrow) == _labels(spark, sf_small, TABLE_ROLES)


def test_partition_count_does_not_matter(spark, sf_small):
    base = _ranking(spark, sf_small, TABLE_ROLES)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert _ranking(spark, sf_small, TABLE_ROLES.with_(chunk_width=16)) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_labels_stop_at_half(spark, sf_small):
    """The last event of half 1 sees no goal from half 2."""
    ev = lb.defence_flags(lb.segment_by_marker(lb.goal_flags(season.bound_events(spark, sf_small), TABLE_ROLES),
                                               TABLE_ROLES), TABLE_ROLES)
    ahead = lb.next_k_sums(ev, TABLE_ROLES, {"focus_goal": "g"}).toPandas()
    for _, m in ahead.sort_values(["match_id", "index"]).groupby("match_id"):
        for half, part in m.groupby("half"):
            goals = part["focus_goal"].tolist()
            expect = [sum(goals[i:i + 6]) for i in range(len(goals))]
            assert part["g"].tolist() == expect


def test_value_rows_are_events_minus_matches(spark, sf_small):
    probs = season.standin_input(season.bound_events(spark, sf_small))
    kept = vl.drop_incomplete(vl.probability_lags(probs, TABLE_ROLES), TABLE_ROLES)
    n_matches = probs.select("match_id").distinct().count()
    assert kept.count() == probs.count() - n_matches


def test_pair_is_symmetric(spark):
    rows = [("m", 1, 1, "a", 1, 0.1, 0.1, 0.5, 0.5), ("m", 2, 1, "a", 1, 0.2, 0.1, 0.5, 0.5),
            ("m", 3, 2, "b", 1, 0.3, 0.1, 0.5, 0.5), ("m", 4, 1, "a", 1, 0.5, 0.1, 0.5, 0.5)]
    df = spark.createDataFrame(rows, "match_id string, index long, player_id long, player_name string, "
                                     "team long, p_score double, p_concede double, p_keep double, p_lose double")
    pairs = vl.interactions(df, TABLE_ROLES).filter(F.col("pair").isNotNull())
    assert {r.pair for r in pairs.collect()} == {"(b, a)"}
    assert pairs.count() == 2


def test_nan_probability_row_is_dropped(spark):
    rows = [("m", 1, 1, "a", 1, 0.1), ("m", 2, 2, "b", 1, float("nan")), ("m", 3, 1, "a", 1, 0.3),
            ("m", 4, 2, "b", 1, 0.4)]
    df = spark.createDataFrame(rows, "match_id string, index long, player_id long, player_name string, "
                                     "team long, p_score double")
    df = df.withColumns({"p_concede": F.lit(0.0), "p_keep": F.lit(0.5), "p_lose": F.lit(0.5)})
    kept = vl.drop_incomplete(vl.probability_lags(df, TABLE_ROLES), TABLE_ROLES)
    # row 1 has no previous, row 2 is NaN, row 3 has a NaN previous
    assert sorted(r["index"] for r in kept.collect()) == [4]


def test_ansi_tolerant_columns(spark):
    from tandem.functions.columns import time_number, time_residue
    from tandem.sources.files import flatten_events
    from tandem.sources.schemas import EVENT_SCHEMA

    df = spark.createDataFrame([("00:1x:02.500",), ("01:02:03.004",), (None,)], "t string")
    got = [tuple(r) for r in df.select(time_number(F.col("t")), time_residue(F.col("t"))).collect()]
    assert got == [(None, "x"), (10203004, ""), (None, None)]
    nested = spark.createDataFrame([(1, [5.0]), (2, None)], "index long, location array<double>")
    for f in EVENT_SCHEMA.fields:
        if f.name not in nested.columns:
            nested = nested.withColumn(f.name, F.lit(None).cast(f.dataType))
    flat = flatten_events(nested.withColumn("match_id", F.lit("m")))
    assert [(r.x, r.y) for r in flat.orderBy("index").collect()] == [(5.0, None), (None, None)]


def test_match_partitions_are_pruned(spark, sf_small, tmp_path):
    """Events written partitioned by match: a filter on the match reaches the
    file listing (PartitionFilters), so only that match's folder is read."""
    from tandem.sources.sinks import write_parquet

    path = str(tmp_path / "by_match")
    ev = season.bound_events(spark, sf_small).select("match_id", "index", "type")
    write_parquet(ev, path, ["match_id"])
    one = spark.read.parquet(path).filter(F.col("match_id") == "2024-01-05")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(match_id" in plan and "2024-01-05" in plan
    assert one.count() == ev.filter(F.col("match_id") == "2024-01-05").count()
