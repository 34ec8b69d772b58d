"""One query per operator of this subpackage, over whole tables, with the
parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import html, urlrules
from tandem.llm.common import table
from tandem.llm.decontaminate import decontaminate
from tandem.llm.langid import identify
from tandem.llm.linededup import dedup_lines
from tandem.llm.neighbours import nearest
from tandem.llm.packing import pack_documents
from tandem.llm.passages import repeated_passages
from tandem.llm.simhash import near_duplicates
from tandem.llm.spelling import variants
from tandem.llm.suffixtree import score_texts
from tandem.llm.warc import round_trip
from tandem.llm.whitening import whiten


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", F.size("passages").alias("n_passages"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages, table(spark, sf_dir, "documents")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


# Fixed values of the query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the document its URL names: block if that is toxic
    or of low quality."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.regexp_extract("url", r"://[^/?#]*/[^/?#]+/(\d{1,18})(?:[/?#.]|$)", 1)
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    labelled = pages.where(number != "").select("url", number.cast("long").alias("doc_id")).join(labels, "doc_id").select(
        "url", F.when(bad, urlrules.BLOCK).otherwise(urlrules.ALLOW).alias("label"))
    return urlrules.judge(pages, labelled, URL_RULES)


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_removed")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_language_id, op2_substring_dedup, op3_html_extraction, op4_best_fit_packing, op5_url_filters,
           op6_warc_archives, op7_line_dedup, op8_nearest_neighbours, op9_benchmark_decontamination, op10_simhash_near_dedup,
           op11_lm_scoring, op12_embedding_whitening, op13_spelling_variants]
    return {f.__name__: f for f in own}
