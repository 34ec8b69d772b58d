"""Corpus pipeline: language identification, line deduplication, SimHash near
deduplication, benchmark decontamination and best-fit packing, each stage over
all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.common import stored, table
from tandem.llm.decontaminate import decontaminate
from tandem.llm.langid import UNDETERMINED, fit, predict
from tandem.llm.linededup import dedup_lines
from tandem.llm.packing import pack_documents
from tandem.llm.simhash import near_duplicates


MIN_LANGUAGE_SCORE = 0.3


def row_key() -> Column:
    """A row by its id, null last, then its text: each row is judged on its own
    text, whatever other rows have its id."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("text").isNull().alias("empty"),
                    F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose key is not among the ids of ``dropped``."""
    keys = dropped.select(F.to_json("doc_id").alias("dropped__")).distinct()
    return docs.join(keys, F.to_json(row_key()) == F.col("dropped__"), "left_anti")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: their text has letters, and the mean
    probability of the best language reaches ``MIN_LANGUAGE_SCORE``."""
    rejected = (F.col("lang_pred") == UNDETERMINED) | (F.col("score") < MIN_LANGUAGE_SCORE)
    return without(docs, predict(docs.withColumn("row__", row_key()), fit(docs), "row__").where(rejected))


def dedup_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are similar to an earlier line."""
    cleaned = dedup_lines(docs)
    return cleaned.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with linked fingerprints the one with the smallest id, null
    last, then the smallest digest of its text; one row of those that repeat it."""
    keyed = docs.withColumn("row__", row_key())
    kept = near_duplicates(keyed, "row__").select(F.to_json("component_id").alias("kept__")).distinct()
    rows = docs.withColumn("row__", F.to_json(row_key())).join(kept, F.col("row__") == F.col("kept__"), "left_semi")
    return rows.dropDuplicates(["row__"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    hit = decontaminate(docs.withColumn("row__", row_key()), table(spark, sf_dir, "benchmark"), "row__")
    return without(docs, hit.where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language ID", keep_identified),
    ("line dedup", dedup_repeated_lines),
    ("simhash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

# Packing and the learned language labels have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; each result is written as
    Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
