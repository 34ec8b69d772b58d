"""What queries read and leave behind."""

from pathlib import Path

from pyspark.sql import functions as F

from tandem.operators import sequence
from tandem.plans import queries as q
from tandem.plans import season
from tandem.run import Run, current, release
from tandem.session import ensure_checkpoint_dir


def _tables(spark):
    return {t.name for t in spark.catalog.listTables() if t.name.startswith("tandem_")}


def _persisted(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_narrow_queries_cross_chunks(spark, sf_small):
    events = q._events(spark, sf_small.replace("0.001", "0.01"), q.NARROW)
    per_match = events.groupBy("match_id").agg(F.count_distinct(sequence.CHUNK).alias("chunks"), F.count(F.lit(1)).alias("rows"))
    assert per_match.where(F.col("rows") > q.NARROW.chunk_width).agg(F.min("chunks"), F.count(F.lit(1))).first()[0] > 1
    assert per_match.agg(F.max("chunks")).first()[0] > 3


def test_one_bound_table_and_release(spark, sf_small):
    release(spark)
    before = _tables(spark)
    for name in ("two_sides", "range_check_x", "label_goal", "lag_actor", "season_pair_totals"):
        q.all_queries()[name](spark, sf_small).count()
    assert len(_tables(spark) - before) == 1
    release(spark)
    assert _tables(spark) == before


def test_queries_leave_nothing_after_release(spark, sf_small):
    """Tables, persisted frames and scratch folders of queries that make them."""
    release(spark)
    tables, frames = _tables(spark), _persisted(spark)
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:")) / "tables"
    had = set(folder.iterdir()) if folder.exists() else set()
    for name in ("label_goal", "positive_probability", "model_reload", "json_multiline_scan", "unmatched_predictions", "ranking_file", "findings",
                 "dense_actor_ids", "segment_by_marker_narrow"):
        assert q.all_queries()[name](spark, sf_small).count()
    assert _tables(spark) - tables and _persisted(spark) > frames and set(folder.iterdir()) - had
    release(spark)
    assert _tables(spark) == tables and _persisted(spark) == frames and set(folder.iterdir()) == had


def test_flows_leave_nothing(spark, sf_small, tmp_path):
    release(spark)
    tables, frames = _tables(spark), _persisted(spark)
    season.prediction_step(spark, sf_small, str(tmp_path), kinds=("gbt",), max_iter=1)
    assert _tables(spark) == tables and _persisted(spark) == frames


def test_runs_own_what_is_made_inside(spark, sf_small):
    with Run(spark) as outer:
        table = season.bound_events(spark, sf_small)
        with Run(spark) as inner:
            assert current(spark) is inner and season.bound_events(spark, sf_small) is not table
        assert current(spark) is outer and table.count() == 1000  # an inner run takes nothing else with it
    assert current(spark) is not outer


def test_match_checks_read_two_columns(spark, sf_small):
    before = _tables(spark)
    plan = q.two_sides(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp" in plan and "user_id" in plan
    assert "props" not in plan and _tables(spark) == before


def test_bound_table_follows_the_folder(spark, sf_small, tmp_path):
    """Files that change are bound anew, without a release."""
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    events.limit(10).write.parquet(f"{tmp_path}/events.parquet")
    assert q.all_queries()["label_goal"](spark, str(tmp_path)).count() == 10
    events.limit(20).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert q.all_queries()["label_goal"](spark, str(tmp_path)).count() == 20
