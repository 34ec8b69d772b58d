"""Feature rows, classifiers for the four labels, and scoring.

Categories become numbers by joins with encoding tables (``operators.encode``),
so no dictionary passes through the driver. The join is the first stage of each
label's pipeline (an SQL transformer that reads the tables from the model
folder), so a saved pipeline scores raw feature rows by itself. Encoders and
assemblers are fitted once and shared by all eight classifiers (4 labels x
{logistic regression, gradient-boosted trees}); every fit is Spark ML's
distributed training, and scoring is a projection.

Logistic regression reads type, actor and side one-hot, x, y and time, as the
original does; its width is the number of values. Trees read the label's rate of
type, actor and side instead (``tree_encoding="rates"``): six numbers, whatever
the number of actors; ``"onehot"`` gives them the vector of the original.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.config import Roles
from tandem.functions.columns import positive_probability, time_number
from tandem.operators import encode, sequence
from tandem.operators.quality import FINDING_COLUMNS
from tandem.operators.value import PROBS
from tandem.run import current

CATEGORICAL = ("type", "player_id", "team")
NUMERIC = ("x_location", "y_location", "time")
KINDS = ("gbt", "lr")
FEATURES = "features"
TREE_ENCODINGS = ("rates", "onehot")
TRAIN_PARTITIONS = 32  # of the prepared rows, fewer if the layout has fewer
PARTITION_ROWS = 1_000_000  # more partitions only for more rows than that in each
FIT_BYTES = {"gbt": 210, "lr": 110}  # that a fit keeps in memory of a row: tree points, predictions; blocks


def feature_rows(labelled: DataFrame, roles: Roles) -> DataFrame:
    """Flat numeric rows for training; events without an actor or without a
    location are left out (they still counted for the labels)."""
    categorical = [F.col(c).alias(name) for name, c in zip(CATEGORICAL, (roles.type, roles.player, roles.team))]
    numeric = [F.col(roles.x), F.col(roles.y), time_number(F.col(roles.time_text))]
    key = [F.col(roles.match).alias("match_id"), F.col(roles.index).alias("index"), F.col(roles.player_name).alias("player_name")]
    labels = [F.col(lbl).cast("double").alias(lbl) for lbl in roles.labels]
    layout = [c for c in labelled.columns if c == sequence.CHUNK]
    rows = labelled.filter(F.col(roles.player).isNotNull() & F.col(roles.x).isNotNull())
    return rows.select(*key, *categorical, *[c.alias(name) for name, c in zip(NUMERIC, numeric)], *labels, *layout)


def _missing(name: str):
    return F.col(name).isNull() | F.isnan(F.col(name).cast("double"))


def complete_rows(features: DataFrame) -> DataFrame:
    """The rows whose numbers are all there: what models are fitted on and can
    score. The others are reported by ``incomplete_rows``."""
    return features.where(~(_missing(NUMERIC[0]) | _missing(NUMERIC[1]) | _missing(NUMERIC[2])))


def incomplete_rows(features: DataFrame) -> DataFrame:
    """A finding per feature row that lacks x, y or time; its value names them."""
    lacking = F.array_join(F.array_compact(F.array(*[F.when(_missing(c), F.lit(c)) for c in NUMERIC])), ",")
    found = features.select(F.col("match_id").cast("string").alias("match_id"), F.lit("incomplete_features").alias("check"),
                            F.col("index").cast("long").alias("index"), lacking.alias("value"))
    return found.where("value <> ''").select(*FINDING_COLUMNS)


# ---- features -----------------------------------------------------------------
def tree_features(label: str) -> str:
    return f"{FEATURES}_{label}"


def encoding_step(folder: str, sizes: dict[str, int], prior: list[list[float]], roles: Roles) -> SQLTransformer:
    """Rows with ``<category>_idx`` and ``<category>_rate_<label>``, joined from
    the tables in ``folder``. A value that isn't in them, or null, has the number
    of known values as its index and the rate of all events."""
    first = f"conv(substring(md5(coalesce(CAST(t.match_id AS STRING), '')), 1, 8), 16, 10)"
    fold = f"CAST(pmod(CAST({first} AS BIGINT), {len(prior)}) AS INT)"
    nothing = "array(" + ", ".join("array(" + ", ".join(f"{r!r}D" for r in rates) + ")" for rates in prior) + ")"
    cols, joins = [], []
    for i, c in enumerate(CATEGORICAL):
        cols.append(f"CAST(coalesce(e{i}.id, {sizes[c]}) AS DOUBLE) AS {c}_idx")
        cols += [f"get(get(coalesce(e{i}.rates, {nothing}), {fold}), {j}) AS {c}_rate_{label}" for j, label in enumerate(roles.labels)]
        joins.append(f"LEFT JOIN parquet.`{folder}/{c}` e{i} ON t.{c} = e{i}.value")
    return SQLTransformer(statement=f"SELECT t.*, {', '.join(cols)} FROM __THIS__ t {' '.join(joins)}")


def raw_step() -> SQLTransformer:
    """Raw ids as one-hot indices, as in the original: they must be
    non-negative whole numbers, and the vector is as wide as the largest."""
    return SQLTransformer(statement="SELECT *, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}_idx" for c in CATEGORICAL) + " FROM __THIS__")


@dataclass
class Prepared:
    """The shared feature stages and the rows they made."""

    stages: dict  # name -> fitted stage
    rows: DataFrame
    n_rows: int
    coded: DataFrame  # the persisted numbers that the rows are made of

    def of(self, features: str) -> list:
        """The stages that lead to a feature column."""
        lead = [self.stages["encoding"]]
        if features == FEATURES:
            lead.append(self.stages["onehot"])
        return [*lead, self.stages[features]]


def dealt(coded: DataFrame, n_rows: int) -> DataFrame:
    """Rows in even partitions in a fixed order. An iteration of a fit runs a
    task and, with one-hot vectors, sums as many numbers as there are values per
    partition, so partitions must not grow in number with the values."""
    n = max(min(TRAIN_PARTITIONS, sequence.layout_partitions(coded.sparkSession)), -(-n_rows // PARTITION_ROWS))
    return coded.repartition(n, "match_id", "index").sortWithinPartitions("match_id", "index")


def prepare(features: DataFrame, roles: Roles, folder: str, index_ids: bool = True) -> Prepared:
    """Write the encoding tables to ``folder``, make the feature stages and
    persist the encoded numbers of the rows, which belong to the current run, on
    disk: fits cache what they iterate over themselves, and the vectors are made
    of the numbers as they are read. The numbers are dealt evenly by match and
    index, whatever the layout and the join with the encodings made of the rows;
    ``dealt`` sets the number of partitions, by rows and not by cores.
    ``features`` should be written (it is read once per category and twice for
    the rows). ``index_ids=False`` uses raw ids as one-hot indices and makes no
    rates."""
    rows = complete_rows(features)
    stages: dict = {}
    totals = encode.totals(rows, roles)
    if index_ids:
        prior = encode.rates_outside(totals, roles)

        def encoded(c: str) -> int:
            encode.encodings(rows, c, roles, prior).write.mode("overwrite").parquet(f"{folder}/{c}")
            return features.sparkSession.read.parquet(f"{folder}/{c}").count()

        # Small jobs that don't wait for each other; the threads see the current run.
        with ThreadPoolExecutor(max_workers=len(CATEGORICAL)) as pool:
            jobs = {c: pool.submit(copy_context().run, encoded, c) for c in CATEGORICAL}
            sizes = {c: job.result() for c, job in jobs.items()}
        stages["encoding"] = encoding_step(folder, sizes, prior, roles)
        for label in roles.labels:
            inputs = [f"{c}_rate_{label}" for c in CATEGORICAL] + list(NUMERIC)
            stages[tree_features(label)] = VectorAssembler(inputCols=inputs, outputCol=tree_features(label), handleInvalid="error")
    else:
        stages["encoding"] = raw_step()
    n_rows = int(sum(totals["n"]))
    coded = current(features.sparkSession).keep(dealt(stages["encoding"].transform(rows), n_rows), StorageLevel.DISK_ONLY)
    coded.count()  # made once, before fits ask for it side by side
    # "keep" adds a column for values that come up later.
    onehot = OneHotEncoder(inputCols=[f"{c}_idx" for c in CATEGORICAL], outputCols=[f"{c}_vec" for c in CATEGORICAL],
                           handleInvalid="keep" if index_ids else "error")
    stages["onehot"] = onehot.fit(coded)
    stages[FEATURES] = VectorAssembler(inputCols=[f"{c}_vec" for c in CATEGORICAL] + list(NUMERIC), outputCol=FEATURES, handleInvalid="error")
    made = stages["onehot"].transform(coded)
    for name, stage in stages.items():
        if name not in ("encoding", "onehot"):
            made = stage.transform(made)
    made = made.select(*features.columns, *[n for n in stages if n not in ("encoding", "onehot")])
    return Prepared(stages, made, n_rows, coded)


# ---- models -------------------------------------------------------------------
def classifier(kind: str, label: str, max_iter: int = 10, seed: int = 42, features: str = FEATURES):
    cols = dict(labelCol=label, featuresCol=features, predictionCol=f"{label}_prediction")
    if kind == "lr":
        est = LogisticRegression(maxIter=max_iter, **cols)
    elif kind == "gbt":
        est = GBTClassifier(maxIter=max_iter, seed=seed, **cols)
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    # output columns of a classification model, set after construction
    # because the tree classifiers do not take them as constructor arguments
    return (est.setProbabilityCol(f"{label}_probability")
            .setRawPredictionCol(f"{label}_raw"))


def features_of(prepared: Prepared, kind: str, label: str, tree_encoding: str = "rates") -> str:
    """The feature column that a model of a kind reads."""
    if tree_encoding not in TREE_ENCODINGS:
        raise ValueError(f"tree encoding {tree_encoding!r}")
    own = tree_features(label)
    return own if kind == "gbt" and tree_encoding == "rates" and own in prepared.stages else FEATURES


def side_by_side(prepared: Prepared, kinds: tuple, most: int) -> int:
    """How many fits may run at once: what they keep of the rows takes at most
    half of the executors' memory, or it goes to disk and back in every pass."""
    infos = prepared.rows.sparkSession.sparkContext._jsc.sc().statusTracker().getExecutorInfos()
    memory = sum(info.totalOnHeapStorageMemory() for info in infos)
    if len(infos) > 1:
        memory = memory * (len(infos) - 1) // len(infos)  # the driver is listed too
    return max(1, min(most, memory // 2 // max(1, prepared.n_rows * max(FIT_BYTES.get(kind, 0) for kind in kinds))))


def fit_all(prepared: Prepared, roles: Roles, kinds: tuple = KINDS, max_iter: int = 10, parallelism: int = 4,
            tree_encoding: str = "rates", train_partitions: int | None = None, labels: tuple | None = None) -> dict[str, dict]:
    """Every (kind, label) model, fitted on the prepared rows.

    The fits are independent, so up to ``parallelism`` of them, as many as have
    room (``side_by_side``), are submitted at once from driver threads (as CrossValidator does); each fit is still
    an ordinary distributed Spark ML job, and small stages of one fit
    overlap with those of another instead of leaving cores idle.

    The fits read the rows as they are laid out, or in ``train_partitions``
    partitions; tree models depend on the partitions, so no row or core count
    chooses them.
    """
    todo = [(kind, label, classifier(kind, label, max_iter, features=features_of(prepared, kind, label, tree_encoding)))
            for kind in kinds for label in labels or roles.labels]
    rows = prepared.rows.coalesce(train_partitions) if train_partitions else prepared.rows
    with ThreadPoolExecutor(max_workers=side_by_side(prepared, kinds, min(parallelism, len(todo)))) as pool:
        fitted = list(pool.map(lambda job: job[2].fit(rows), todo))
    out: dict[str, dict] = {kind: {} for kind in kinds}
    for (kind, label, _), model in zip(todo, fitted):
        out[kind][label] = model
    return out


def score(rows: DataFrame, models: list, roles: Roles) -> DataFrame:
    """Apply every label's model to rows with features and keep the
    positive-class probabilities as ``p_score, p_concede, p_keep, p_lose``."""
    out = rows
    for model in models:
        out = model.transform(out)
    return _probabilities(out, roles, rows.columns)


def _probabilities(scored: DataFrame, roles: Roles, had: list[str]) -> DataFrame:
    layout = [sequence.CHUNK] if sequence.CHUNK in had else []
    return scored.select(
        F.col("match_id").alias(roles.match), F.col("index").alias(roles.index),
        F.col("player_id").alias(roles.player), F.col("player_name").alias(roles.player_name),
        F.col("team").alias(roles.team),
        *[positive_probability(F.col(f"{label}_probability")).alias(p) for label, p in zip(roles.labels, PROBS)],
        *layout)


# ---- saved models -------------------------------------------------------------
def pipeline(prepared: Prepared, model) -> PipelineModel:
    """A label's stages from raw feature rows to the probability."""
    return PipelineModel([*prepared.of(model.getFeaturesCol()), model])


def save_models(prepared: Prepared, fitted: dict[str, dict], folder: str) -> DataFrame:
    """One pipeline per (kind, label) under ``folder``, and a table of them in
    ``folder/index``: kind, label, path, type and number of features and the
    model's parameters. Returns that table."""
    spark = prepared.rows.sparkSession
    todo = [(kind, label, model, f"{folder}/{kind}/{label}") for kind, models in fitted.items() for label, model in models.items()]
    with ThreadPoolExecutor(max_workers=8) as pool:
        for done in [pool.submit(pipeline(prepared, model).write().overwrite().save, path) for _, _, model, path in todo]:
            done.result()
    about = [(kind, label, path, model.getFeaturesCol(), int(model.numFeatures),
              json.dumps({p.name: v for p, v in model.extractParamMap().items()}, default=str, sort_keys=True)) for kind, label, model, path in todo]
    index = spark.createDataFrame(about, "kind string, label string, path string, features string, n_features int, parameters string")
    index.coalesce(1).write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def load_models(spark: SparkSession, folder: str, kind: str, roles: Roles) -> list[PipelineModel]:
    """The saved pipelines of a kind, in the order of the labels."""
    paths = {r["label"]: r["path"] for r in spark.read.parquet(f"{folder}/index").where(F.col("kind") == kind).collect()}
    lacking = [label for label in roles.labels if label not in paths]
    if lacking:
        raise ValueError(f"no saved {kind} model for {lacking} in {folder}")
    return [PipelineModel.load(paths[label]) for label in roles.labels]


def score_saved(features: DataFrame, folder: str, kind: str, roles: Roles) -> DataFrame:
    """Score raw feature rows with the saved pipelines of a kind. The stages
    that all four share run once; rows without all numbers are left out."""
    out, done = complete_rows(features), set()
    for model in load_models(features.sparkSession, folder, kind, roles):
        for stage in model.stages:
            shared = stage.uid
            if shared not in done:
                out = stage.transform(out)
                done.add(shared)
    return _probabilities(out, roles, features.columns)
