"""Column expressions shared by the operators; all built-in Spark functions,
so they stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """1 where ``cond`` is true, 0 where it is false *or NULL*."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def in_set(col: Column, values: Iterable) -> Column:
    values = list(values)
    return col.isin(values) if values else F.lit(False)


def time_number(text: Column) -> Column:
    """``HH:mm:ss.SSS`` -> the digits as one number HHMMSSmmm (not a duration);
    a malformed text gives NULL instead of an ANSI cast error."""
    return F.regexp_replace(text, r"[:.]", "").try_cast("long")


def time_residue(text: Column) -> Column:
    """What is left of a time text after removing digits, ':' and '.'; a well
    formed time leaves the empty string."""
    return F.regexp_replace(text, r"[\d:.]", "")


def positive_probability(probability: Column) -> Column:
    """Probability of class 1 from an ML probability vector."""
    return F.get(vector_to_array(probability), 1)


def pair_key(valid: Column, actor_id: Column, prev_id: Column, name: Column,
             prev_name: Column) -> Column:
    """Label of the two actors of a valid interaction, the greater id first
    whoever acted first; NULL otherwise."""
    actors = [F.struct(i.alias("id"), n.cast("string").alias("name")) for i, n in ((actor_id, name), (prev_id, prev_name))]
    names = [pick(*actors)["name"] for pick in (F.greatest, F.least)]
    text = F.concat(F.lit("("), names[0], F.lit(", "), names[1], F.lit(")"))
    return F.when((valid == 1) & actor_id.isNotNull() & prev_id.isNotNull(), text)
