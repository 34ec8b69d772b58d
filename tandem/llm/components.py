"""Connected components of an edge table by large-star and small-star steps
(Kiveris et al., 2014). Every step is a grouped minimum and a join, so hot
nodes are pre-aggregated; edges are written to the shared folder between
rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on its least neighbour (itself
    counted): the greater ones (large star) or the smaller ones (small star)."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("w")).union(
        edges.select(F.col("v").alias("n"), F.col("u").alias("w")))
    if not large:
        both = both.where("w < n")
    least = both.groupBy("n").agg(F.min("w").alias("m")).select("n", F.least("n", "m").alias("m"))
    hung = both.join(least, "n")
    if large:
        hung = hung.where("w > n").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        hung = hung.select(F.col("w").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return hung.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges -> (node, root), one row per node of an edge; the root is
    the least node of the component. Null ends and loops are left out."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
        now = stored(_star(_star(now, True), False), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
