"""Models: property rows are compared with SQL (test_oracle.py); here encodings
against brute force, many actors, incomplete rows, saved pipelines and folders."""

import hashlib

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tandem.config import TABLE_ROLES as R
from tandem.operators import encode
from tandem.operators import labels as lb
from tandem.operators import model as ml
from tandem.plans import season
from tandem.plans.queries import all_queries
from tandem.run import Run

PROBS = ("p_score", "p_concede", "p_keep", "p_lose")
FEATURE_SCHEMA = ("match_id string, index long, player_name string, type string, player_id long, team long, x_location double, y_location double, "
                  "time long, label_goal double, label_concede double, label_keep double, label_lose double")


@pytest.fixture(scope="module")
def features(spark, sf_small):
    return season.feature_table(season.bound_events(spark, sf_small), R)


@pytest.fixture(scope="module")
def prepared(features, tmp_path_factory):
    return ml.prepare(features, R, str(tmp_path_factory.mktemp("encodings")))


@pytest.fixture(scope="module")
def many(spark):
    """30,000 actors in 60 matches, more than any bin or dictionary holds."""
    n = F.col("id")
    flag = [(F.pmod(n * k, F.lit(7)) < 3).cast("double").alias(label) for k, label in zip((1, 3, 5, 11), R.labels)]
    return spark.range(40_000).select(
        F.concat(F.lit("m"), F.pmod(n, F.lit(60)).cast("string")).alias("match_id"), n.alias("index"),
        F.concat(F.lit("p"), F.pmod(n, F.lit(30_000)).cast("string")).alias("player_name"),
        F.concat(F.lit("t"), F.pmod(n, F.lit(40)).cast("string")).alias("type"), (F.pmod(n, F.lit(30_000)) * 1_000_003).alias("player_id"),
        F.pmod(n, F.lit(2)).alias("team"), F.pmod(n, F.lit(120)).cast("double").alias("x_location"),
        F.pmod(n * 7, F.lit(80)).cast("double").alias("y_location"), n.alias("time"), *flag)


def _ranges(scored):
    return scored.agg(F.count("*").alias("n"), *[f(p).alias(f"{f.__name__}_{p}") for p in PROBS for f in (F.min, F.max)]).first()


@pytest.mark.parametrize("values", [[], [5], [None, 3, -7, 10**15], list(range(1000, 0, -3))])
def test_dense_ids(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    got = {r.v: r.id for r in encode.dense_ids(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(v for v in values if v is not None))}


def test_rates_by_brute_force(spark, features):
    """Each row's rate leaves its match's whole fold out."""
    prior = encode.priors(features, R)
    got = {r.value: (r.id, r.rates) for r in encode.encodings(features, "player_id", R, prior).collect()}
    rows = features.collect()

    def fold(match):
        return int(hashlib.md5(match.encode()).hexdigest()[:8], 16) % encode.FOLDS

    assert [got[v][0] for v in sorted(got)] == list(range(len(got)))
    for f in range(encode.FOLDS):
        rest = [r for r in rows if fold(r.match_id) != f]
        for i, label in enumerate(R.labels):
            overall = sum(r[label] for r in rest) / len(rest)
            assert prior[f][i] == pytest.approx(overall)
            for actor, (_, rates) in got.items():
                own = [r[label] for r in rest if r.player_id == actor]
                assert rates[f][i] == pytest.approx((sum(own) + encode.RATE_WEIGHT * overall) / (len(own) + encode.RATE_WEIGHT))


def test_no_row_sees_its_own_label(spark, tmp_path):
    """An actor's rate in a match doesn't change with the labels of that match."""
    def rows(label):
        return spark.createDataFrame([("a", 1, "p", "t", 1, 1, 1.0, 1.0, 1, label, 0.0, 0.0, 0.0), ("b", 1, "p", "t", 1, 1, 1.0, 1.0, 1, 1.0, 0.0, 0.0, 0.0),
                                      ("c", 1, "p", "t", 1, 1, 1.0, 1.0, 1, 0.0, 1.0, 1.0, 1.0)], FEATURE_SCHEMA)

    seen = []
    for label in (0.0, 1.0):
        made = ml.prepare(rows(label), R, str(tmp_path / str(label)))
        seen.append(made.rows.where("match_id = 'a'").first()[ml.tree_features("label_goal")].toArray().tolist())
    assert seen[0] == seen[1]


def test_many_actors_in_all_kinds(spark, many, tmp_path):
    """No size stops a fit, a save or a reload, and no indexer holds the actors."""
    made = ml.prepare(many, R, str(tmp_path / "encodings"))
    assert {type(s).__name__ for s in made.stages.values()} == {"SQLTransformer", "OneHotEncoderModel", "VectorAssembler"}
    assert made.rows.first().features.size > 30_000 and made.rows.first()[ml.tree_features("label_goal")].size == 6
    fitted = ml.fit_all(made, R, max_iter=1)
    index = ml.save_models(made, fitted, str(tmp_path))
    assert index.count() == 8
    for kind in ml.KINDS:
        got = _ranges(ml.score_saved(many, str(tmp_path), kind, R))
        assert got.n == 40_000 and all(0 <= got[f"min_{p}"] <= got[f"max_{p}"] <= 1 for p in PROBS)
    made.rows.unpersist()


def test_raw_ids_as_indices(features, tmp_path):
    """Raw ids as one-hot indices (width = largest id + 1), as in the original
    analytic; needs numeric categories."""
    typed = features.withColumn("type", F.when(F.col("type") == "click", 3).when(F.col("type") == "view", 1).otherwise(0))
    made = ml.prepare(typed, R, str(tmp_path), index_ids=False)
    width = made.rows.first().features.size
    assert width >= typed.agg(F.max("player_id")).first()[0]
    fitted = ml.fit_all(made, R, max_iter=1, labels=("label_goal",))  # trees read the same vector
    assert fitted["gbt"]["label_goal"].numFeatures == fitted["lr"]["label_goal"].numFeatures == width


def test_tree_encodings(prepared):
    one = ml.fit_all(prepared, R, ("gbt",), max_iter=1, tree_encoding="onehot", labels=("label_goal",))["gbt"]["label_goal"]
    rates = ml.fit_all(prepared, R, ("gbt",), max_iter=1, labels=("label_goal",))["gbt"]["label_goal"]
    assert one.numFeatures == prepared.rows.first().features.size and rates.numFeatures == 6
    with pytest.raises(ValueError, match="tree encoding"):
        ml.fit_all(prepared, R, ("gbt",), tree_encoding="categorical")


def test_incomplete_rows_are_reported_not_fitted(spark, tmp_path):
    rows = [("m", i, "p", "t", i % 3, i % 2, float(i), 2.0, i, float(i % 2), 0.0, 1.0, 0.0) for i in range(20)]
    bad = [("m", 30, "p", "t", 1, 1, float("nan"), None, 5, 1.0, 0.0, 0.0, 0.0), ("m", 31, "p", "t", 1, 1, 1.0, 1.0, None, 1.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows + bad, FEATURE_SCHEMA)
    assert [tuple(r) for r in ml.incomplete_rows(df).orderBy("index").collect()] == [
        ("m", "incomplete_features", 30, "x_location,y_location"), ("m", "incomplete_features", 31, "time")]
    made = ml.prepare(df, R, str(tmp_path / "encodings"))
    fitted = ml.fit_all(made, R, max_iter=1)
    ml.save_models(made, fitted, str(tmp_path))
    assert ml.score_saved(df, str(tmp_path), "lr", R).count() == 20


def test_saved_pipeline_scores_raw_rows_and_new_values(spark, features, prepared, tmp_path):
    """One reloaded pipeline per label takes feature rows as they come, also of
    actors, types and matches that training has not seen."""
    fitted = ml.fit_all(prepared, R, max_iter=2)
    index = {(r.kind, r.label): r for r in ml.save_models(prepared, fitted, str(tmp_path)).collect()}
    assert set(index) == {(k, label) for k in ml.KINDS for label in R.labels}
    assert index["gbt", "label_goal"].n_features == 6 and '"maxIter": 2' in index["lr", "label_lose"].parameters
    new = spark.createDataFrame([("new", 1, "p", "new type", -5, 1, 1.0, 2.0, 3, 0.0, 0.0, 0.0, 0.0), ("new", 2, None, None, None, None, 1.0, 2.0, 3, 0.0, 0.0, 0.0, 0.0)],
                                FEATURE_SCHEMA)
    for (kind, label), r in index.items():
        loaded = PipelineModel.load(r.path)
        assert loaded.transform(features).select("match_id", "index", f"{label}_probability").count() == features.count()
        assert loaded.transform(new).count() == 2
    with pytest.raises(ValueError, match="no saved"):
        ml.load_models(spark, str(tmp_path), "other", R)


def test_prediction_step_writes(spark, sf_small, tmp_path):
    out = season.prediction_step(spark, sf_small, str(tmp_path), kinds=("lr",))
    pred = spark.read.parquet(out["lr"])
    assert pred.count() == 1000 and "_chunk" not in pred.columns
    assert set(PROBS) <= set(pred.columns)
    assert (tmp_path / "models" / "lr" / "label_lose").exists()
    again = season.score_step(spark, str(tmp_path / "models"), "lr", season.bound_events(spark, sf_small))
    assert again.join(pred, ["match_id", "index"]).where(F.abs(again.p_keep - pred.p_keep) < 1e-12).count() == 1000


def test_model_pair_ranking_rows(spark, sf_small):
    ranked = all_queries()["model_pair_ranking"](spark, sf_small)
    assert ranked.count() == 22  # same pairs as with stand-in probabilities


def test_stored_predictions_join_without_exchange(spark, sf_small):
    """Four frames stored one by one, with other keys each, no broadcast."""
    from tandem.operators import value as vl
    from tandem.plans import queries as q
    from tests.test_sequence import _row_exchanges

    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        frames = q._label_frames(spark, sf_small)
        joined = vl.join_stored(frames, R)
        plan = joined._jdf.queryExecution().executedPlan().treeString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 3
        pairs = season.pair_totals(joined, R)._jdf.queryExecution().executedPlan().treeString()
        assert _row_exchanges(pairs) == []  # laid out for the lags, too
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_labels_are_computed_once(spark, sf_small, tmp_path):
    """Fits and scores read the written feature table, not the label plan."""
    with Run(spark):
        table = season.feature_table(season.bound_events(spark, sf_small), R)
        made = ml.prepare(table, R, str(tmp_path))
        plan = made.rows._jdf.queryExecution().analyzed().toString() + table._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan


def test_prepared_rows_are_even_and_hold_no_vectors(spark, many, tmp_path):
    """Rows of one match lie in all partitions, in a fixed order whatever the
    layout, and what is persisted are numbers, not five vectors a row in memory."""
    with Run(spark) as run:
        made = ml.prepare(many.where("index < 4000").withColumn("match_id", F.lit("m")), R, str(tmp_path))
        sizes = made.rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert len(sizes) == 8 and max(r["count"] for r in sizes) < 700 and made.n_rows == 4000
        kept = run.frames[-1]
        assert not kept.storageLevel.useMemory and kept.storageLevel.useDisk
        assert {f.dataType.typeName() for f in kept.schema.fields} <= {"string", "long", "double"}
        assert made.rows.first().features.size == 40 + 4000 + 2 + 3


def test_fits_run_side_by_side_while_they_fit(spark, prepared):
    from dataclasses import replace

    assert ml.side_by_side(prepared, ml.KINDS, 4) == 4
    assert ml.side_by_side(replace(prepared, n_rows=10 ** 9), ml.KINDS, 4) == 1
