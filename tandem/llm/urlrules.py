"""URL filtering by association rules.

A URL becomes a set of tokens (host, domain, host labels, path parts, file
ending, query names, fragment). Spark's FP-growth mines token combinations of
labelled URLs together with their label; combinations that imply a label with
enough confidence, support and lift become rules. Rules are matched by an
inverted index: a rule is listed under its rarest token, a URL looks up its own
tokens and keeps the rules whose tokens it all has.

Host rules given by hand come first: a rule fits its host and all subdomains
if the path starts with the rule's, and the longest wins.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.05
ALLOW, BLOCK = "allow", "block"
LABEL = "label="


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as the rules read them; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)^(/?[^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; numbers are left out, they name single pages."""
    host, path = split_url(url)
    url = F.coalesce(url.cast("string"), F.lit(""))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domain = F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    below = F.slice(labels, F.lit(1), F.greatest(n - 2, F.lit(0)))
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, r"^([^=]*)", 1))

    def tagged(tag: str, value: Column) -> Column:
        return F.when((value != "") & ~value.rlike(r"^\d+$"), F.concat(F.lit(tag + ":"), value))

    single = F.array(tagged("host", host), tagged("domain", domain), tagged("top", F.element_at(labels, -1)),
                     tagged("page", F.element_at(parts, -1)), tagged("end", ending), F.when(url.contains("#"), F.lit("fragment")))
    def each(tag: str, values: Column) -> Column:
        return F.transform(values, lambda x: tagged(tag, x))

    every = F.concat(single, each("sub", below), each("dir", folders), each("arg", names))
    return F.array_sort(F.array_distinct(F.array_compact(every)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         min_lift: float = MIN_LIFT) -> DataFrame:
    """(items, label) rows -> rules (rule, antecedent, verdict, confidence,
    support, key): key is the rule's rarest token. No labels give no rules."""
    rows = labelled.where(F.col("label").isNotNull() & (F.size("items") > 0)).select(
        F.concat("items", F.array(F.concat(F.lit(LABEL), "label"))).alias("items"))
    schema = "rule string, antecedent array<string>, verdict string, confidence double, support double, key string"
    if rows.isEmpty():
        return labelled.sparkSession.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    counts = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    label = F.col("consequent")[0]
    rules = model.associationRules.where(
        label.startswith(LABEL) & (F.col("lift") >= min_lift) & (F.col("support") >= min_support)).select(
        F.array_sort("antecedent").alias("antecedent"), F.substr(label, F.lit(len(LABEL) + 1)).alias("verdict"), "confidence", "support")
    rules = rules.withColumn("rule", F.array_join("antecedent", " "))
    rarest = rules.select("rule", F.explode("antecedent").alias("token")).join(counts, "token").groupBy("rule").agg(
        F.min(F.struct("freq", "token")).alias("least")).select("rule", F.col("least.token").alias("key"))
    return rules.join(rarest, "rule").select("rule", "antecedent", "verdict", "confidence", "support", "key")


def match(items: DataFrame, rules: DataFrame) -> DataFrame:
    """(items) sets -> (items, mined_rule, mined_verdict): the fitting rule of
    greatest confidence, then support, then the smallest name."""
    asked = items.select("items", F.explode("items").alias("key"))
    fits = asked.join(rules, "key").where(F.size(F.array_except("antecedent", "items")) == 0)
    best = fits.groupBy("items").agg(F.min_by(
        F.struct("rule", "verdict"), F.struct(-F.col("confidence"), -F.col("support"), F.col("rule"), F.col("verdict"))).alias("b"))
    return best.select("items", F.col("b.rule").alias("mined_rule"), F.col("b.verdict").alias("mined_verdict"))


def host_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as (rule, verdict), or null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        inside = (host == rule_host) | host.endswith("." + rule_host)
        own = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        chosen = F.when(inside & path.startswith(rule_path), own).otherwise(chosen)
    return chosen


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """Per page row: page_id, host, path, rule, verdict, mined_rule.

    ``labelled`` has url and label (allow or block). A URL that neither a host
    rule nor a mined rule fits is allowed; so is a null or broken one. Repeated
    rows and null ids are kept, an empty table gives no rows.
    """
    mined = stored(mine(labelled.select(tokens(F.col("url")).alias("items"), "label")), "url-rules")
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), tokens(F.col(url_col)).alias("items"))
    rows = rows.withColumn("own", host_rule(F.col("host"), F.col("path"), rules))
    best = match(rows.select("items").distinct(), mined)
    return rows.join(best, "items", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "mined_verdict", F.lit(ALLOW)).alias("verdict"), "mined_rule")
