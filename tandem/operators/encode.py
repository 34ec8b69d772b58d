"""Categories as numbers, without a dictionary on the driver.

Every value of a category column gets a dense id and, per label, its rate of
positive events. Both are tables that are joined to the rows, so the number of
actors of a season is bounded by nothing but the tables.

Dense ids: the distinct values are range-partitioned, counted per partition and
numbered from the counts of the partitions before.

Rates are cross-fitted: matches are dealt to folds by a hash of their id, and a
row's rate is that of its value's events in the *other* folds, so no row's own
label (nor any of its match) is in its features. A value with few events leans
to the rate of all events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.config import Roles
from tandem.operators.sequence import layout_partitions
from tandem.sources.sinks import save_scratch

FOLDS = 5
RATE_WEIGHT = 20  # events by which a value's rates lean to those of all events
NO_RATE = 0.5  # the rate of all events where no event lies in the other folds


def dense_ids(values: DataFrame, column: str, out: str = "id") -> DataFrame:
    """``values`` (one row per value) with ``out``: 0, 1, ... in the order of
    ``column``; null gets none. An empty table stays empty."""
    spark = values.sparkSession
    # The position in a partition, below the partition's number.
    placed = (values.where(F.col(column).isNotNull()).repartitionByRange(layout_partitions(spark), column)
              .sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id()))
    placed = save_scratch(placed, "dense-ids").withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(starts, "_part").select(*values.columns, number.alias(out))


def fold_of(match: Column, folds: int = FOLDS) -> Column:
    """Fold of a match, 0 to ``folds`` - 1, by the first 32 bits of its md5."""
    head = F.conv(F.substring(F.md5(F.coalesce(match.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    return F.pmod(head, F.lit(folds)).cast("int")


def label_sums(rows: DataFrame, by: list[str], roles: Roles, folds: int = FOLDS) -> DataFrame:
    """Per value: ``n`` and the sums of the labels, by fold (arrays)."""
    fold = fold_of(F.col("match_id"), folds)

    def per_fold(of: Column, name: str) -> list[Column]:
        return [F.sum(F.when(F.col("_fold") == f, of).otherwise(F.lit(0.0))).alias(f"{name}_{f}") for f in range(folds)]

    sums = rows.withColumn("_fold", fold).groupBy(*by).agg(
        *per_fold(F.lit(1.0), "n"), *[c for label in roles.labels for c in per_fold(F.col(label), label)])
    return sums.select(*by, *[F.array(*[f"{name}_{f}" for f in range(folds)]).alias(name) for name in ("n", *roles.labels)])


def without_fold(column: str, fold: int, folds: int = FOLDS) -> Column:
    """Sum over all folds but one, in the order of the folds."""
    total = F.lit(0.0)
    for f in range(folds):
        if f != fold:
            total = total + F.col(column)[f]
    return total


def totals(rows: DataFrame, roles: Roles, folds: int = FOLDS) -> dict[str, list[float]]:
    """``n`` and the sums of the labels over all rows, by fold."""
    sums = label_sums(rows, [], roles, folds).first()
    return {name: [x or 0.0 for x in sums[name]] for name in ("n", *roles.labels)}


def priors(rows: DataFrame, roles: Roles, folds: int = FOLDS) -> list[list[float]]:
    """Rates of all events outside each fold: ``folds`` lists of one rate per label."""
    return rates_outside(totals(rows, roles, folds), roles)


def rates_outside(sums: dict[str, list[float]], roles: Roles) -> list[list[float]]:
    """``priors`` from the totals."""
    folds, out = len(sums["n"]), []
    for fold in range(folds):
        kept = [f for f in range(folds) if f != fold]
        n = sum(sums["n"][f] for f in kept)
        out.append([sum(sums[label][f] for f in kept) / n if n else NO_RATE for label in roles.labels])
    return out


def encodings(rows: DataFrame, column: str, roles: Roles, prior: list[list[float]], folds: int = FOLDS) -> DataFrame:
    """(value, id, rates) of a category column: ``rates[fold][label]`` is the
    rate over the events outside the fold."""
    sums = dense_ids(label_sums(rows, [column], roles, folds), column)
    rates = F.array(*[F.array(*[
        (without_fold(label, fold, folds) + RATE_WEIGHT * prior[fold][i]) / (without_fold("n", fold, folds) + RATE_WEIGHT)
        for i, label in enumerate(roles.labels)]) for fold in range(folds)])
    return sums.select(F.col(column).alias("value"), "id", rates.alias("rates"))
