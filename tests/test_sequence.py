"""The chunked sequence operators against plain Spark windows (brute force)
on random groups with gaps, NULL values and one hot group holding most rows,
for chunk widths from 1 row up to larger than any group."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tandem.operators import sequence as S
from tandem.run import Run
from tandem.sources.sinks import save_laid_out


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(11)
    rows = []
    sizes = [1, 2, 7, 30, 400]  # the last group holds most rows
    for g, n in enumerate(sizes):
        ids = sorted(rnd.sample(range(0, 3 * n + 5), n))
        for i in ids:
            v = rnd.random() if rnd.random() > 0.1 else None
            rows.append((f"g{g}", i, rnd.randint(0, 1), rnd.randint(0, 1), v))
    return spark.createDataFrame(rows, "g string, o long, f int, h int, v double")


def _brute(df):
    w = Window.partitionBy("g").orderBy("o")
    wh = Window.partitionBy("g", "h").orderBy("o").rowsBetween(0, 5)
    return df.select(
        "*", F.row_number().over(w).cast("long").alias("rn"), F.lag("v").over(w).alias("pv"),
        F.lag("f").over(w).alias("pf"), F.coalesce(F.sum("f").over(wh), F.lit(0)).cast("long").alias("la"),
        F.min(F.when(F.col("f") == 1, F.col("o"))).over(Window.partitionBy("g")).alias("mn"))


def _ours(df, width, fan=S.DEFAULT_FAN):
    a = S.row_numbers(df, ["g"], "o", "rn", width, fan)
    a = S.lag_columns(a, ["g"], "o", {"v": "pv", "f": "pf"}, width, fan)
    a = S.lookahead_sums(a, ["g", "h"], "o", {"f": "la"}, 5, width, fan)
    return S.group_min(a, ["g"], "o", F.when(F.col("f") == 1, F.col("o")), "mn", width, fan)


COLS = ["g", "o", "f", "h", "v", "rn", "pv", "pf", "la", "mn"]


@pytest.mark.parametrize("width,fan", [(1, 2), (1, 3), (2, 2), (5, 4096), (13, 2), (10_000, 4096)])
def test_matches_windows(data, width, fan):
    ours = sorted(map(tuple, _ours(data, width, fan).select(COLS).collect()), key=str)
    brute = sorted(map(tuple, _brute(data).select(COLS).collect()), key=str)
    assert ours == brute


def test_lag_after_filter_spans_empty_chunks(spark):
    # rows 10..19 removed: with width 3, several chunks are empty and the lag
    # of row 20 must come from row 9
    df = spark.range(0, 30).select(F.lit("m").alias("g"), F.col("id").alias("o"),
                                   (F.col("id") * 10).alias("v"))
    kept = df.filter((F.col("o") < 10) | (F.col("o") >= 20))
    for fan in (1, 2, 4096):
        out = {r.o: r.pv for r in S.lag_columns(kept, ["g"], "o", {"v": "pv"}, 3, fan).collect()}
        assert out[20] == 90 and out[0] is None and out[21] == 200


@pytest.mark.parametrize("fan", [1, 2, 4096])
def test_lookahead_spills_over_short_chunks(spark, fan):
    # sparse order keys: chunks of width 4 hold one row each, so the k rows
    # ahead come from several following chunks (and super-chunks)
    rows = [("m", o, 1 if o == 40 else 0, 1) for o in range(0, 44, 4)]
    df = spark.createDataFrame(rows, "g string, o long, f int, h int")
    out = {r.o: r.la for r in S.lookahead_sums(df, ["g", "h"], "o", {"f": "la"}, 5, 4, fan).collect()}
    assert [out[o] for o in range(0, 44, 4)] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1]


def test_hot_group_is_split(spark):
    """A group with most of the rows is spread over many (group, chunk)
    partitions instead of one window partition."""
    df = spark.range(0, 5000).select(F.lit("hot").alias("g"), F.col("id").alias("o"))
    laid = S.layout(df, ["g"], "o", 100)
    sizes = laid.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in sizes) < 5000 / 2
    assert laid.select(S.CHUNK).distinct().count() == 50


def _row_exchanges(plan: str) -> list[str]:
    """Exchange nodes of a physical plan tree string that move rows: their
    subtree reaches a source (file scan, range) without passing an aggregate, a broadcast or
    a persisted chunk table (InMemoryRelation). The others move chunk tables
    (one row per group and chunk)."""
    nodes = [(len(line) - len(line.lstrip(" :+-")), line.strip(" :+-")) for line in plan.splitlines()]
    small = ("BroadcastExchange", "InMemoryRelation", "HashAggregate", "ObjectHashAggregate")
    found = []
    for i, (depth, node) in enumerate(nodes):
        if not node.startswith("Exchange"):
            continue
        stack = []
        for d, n in nodes[i + 1:]:
            if d <= depth:
                break
            while stack and stack[-1][0] >= d:
                stack.pop()
            if n.startswith(("FileScan", "Range", "LocalTableScan", "Scan ")) and not any(b for _, b in stack):
                found.append(node)
                break
            stack.append((d, n.startswith(small)))
    return found


@pytest.mark.parametrize("broadcast", [True, False])
def test_saved_layout_needs_no_row_shuffle(spark, broadcast):
    """Rows written as a bucketed table on (group, chunk): row numbers, lags
    and look-ahead sums (also over a finer group, like halves of a match) on
    it shuffle no rows, only chunk tables, whether or not those are
    broadcast."""
    from tandem.sources.sinks import save_laid_out

    df = spark.range(0, 1000).select((F.col("id") % 3).cast("string").alias("g"), F.col("id").alias("o"),
                                     (F.col("id") % 2).cast("int").alias("f"),
                                     (F.col("id") >= 400).cast("int").alias("h"))
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    if not broadcast:
        for k in keys:
            spark.conf.set(k, "-1")
    try:
        saved = save_laid_out(S.layout(df, ["g"], "o", 50), ["g", S.CHUNK], "test")
        out = S.lag_columns(S.row_numbers(saved, ["g"], "o", "rn", 50), ["g"], "o", {"f": "pf"}, 50)
        out = S.lookahead_sums(out, ["g"], "o", {"f": "la"}, 5, 50)
        out = S.lookahead_sums(out, ["g", "h"], "o", {"f": "lh"}, 5, 50, layout_group=["g"])
        plan = out._jdf.queryExecution().executedPlan().treeString()
        assert "Bucketed: true" in plan
        assert ("BroadcastExchange" in plan) == broadcast
        assert _row_exchanges(plan) == []
        got = sorted(map(tuple, out.select("g", "o", "la", "lh").collect()))
        w = Window.partitionBy("g").orderBy("o").rowsBetween(0, 5)
        wh = Window.partitionBy("g", "h").orderBy("o").rowsBetween(0, 5)
        want = sorted(map(tuple, df.select("g", "o", F.sum("f").over(w).cast("long").alias("la"),
                                           F.sum("f").over(wh).cast("long").alias("lh")).collect()))
        assert got == want
        # the same operators on an unsaved frame: the layout shuffle is seen
        unsaved = S.lookahead_sums(df, ["g"], "o", {"f": "la"}, 5, 50)
        assert len(_row_exchanges(unsaved._jdf.queryExecution().executedPlan().treeString())) >= 1
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_layout_partitions_setting(spark):
    df = spark.range(0, 100).select(F.lit("m").alias("g"), F.col("id").alias("o"))
    spark.conf.set(S.LAYOUT_PARTITIONS, "5")
    try:
        assert S.layout(df, ["g"], "o", 10).rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset(S.LAYOUT_PARTITIONS)
    assert S.layout(df, ["g"], "o", 10).rdd.getNumPartitions() == \
        int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_shared_chunk_tables_released(data):
    """Chunk tables feeding two branches are persisted while a run builds on
    them; release drops them and frames built before still compute the same
    rows (they recompute)."""
    run = Run(data.sparkSession).__enter__()
    ours = _ours(data, 5, 2).select(COLS)
    before = sorted(map(tuple, ours.collect()), key=str)
    kept = list(run.frames)
    assert kept and all(t.storageLevel.useMemory for t in kept)
    run.__exit__()
    assert not run.frames and all(not t.storageLevel.useMemory for t in kept)
    assert sorted(map(tuple, ours.collect()), key=str) == before
    assert before == sorted(map(tuple, _brute(data).select(COLS).collect()), key=str)


def test_season_flows_shuffle_no_event_rows_without_broadcast(spark, sf_small):
    """On the bound (bucketed) season table, labels and the value stage up to
    the pair totals move no event rows even when no chunk table may be
    broadcast (as at full scale, where chunk tables exceed the threshold)."""
    from tandem.config import TABLE_ROLES as R
    from tandem.operators import labels as lb
    from tandem.plans import season

    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        ev = season.bound_events(spark, sf_small)
        for df in (lb.labelled(ev, R), season.pair_totals(season.standin_input(ev), R)):
            plan = df._jdf.queryExecution().executedPlan().treeString()
            assert "BroadcastExchange" not in plan
            assert _row_exchanges(plan) == []
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_layout_beyond_the_bucket_limit_names_the_setting(spark):
    spark.conf.set("spark.tandem.layout.partitions", "400000")
    try:
        with pytest.raises(ValueError, match="spark.sql.sources.bucketing.maxBuckets"):
            save_laid_out(spark.range(3), ["id"])
    finally:
        spark.conf.unset("spark.tandem.layout.partitions")


@pytest.mark.parametrize("width, fan", [(64, 4096), (10, 2), (1, 3)])
def test_chunks_by_position(spark, width, fan):
    """Interleaved, sparse and clustered ids: chunks are monotone in the order,
    of bounded size, and row numbers equal the plain window's."""
    n = F.col("id")
    rows = spark.range(4000).select(F.when(n < 1500, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.pmod(n, F.lit(300)).cast("string"))).alias("g"),
                                    F.when(n % 5 == 0, n * 1000).otherwise(n + 10_000_000).alias("o"))
    got = S.row_numbers(rows, ["g"], "o", "rn", width, fan, by_position=True)
    want = rows.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o")).cast("long"))
    assert sorted(map(tuple, got.select("g", "o", "rn").collect())) == sorted(map(tuple, want.collect()))
    chunks = got.groupBy("g", S.CHUNK).agg(F.count(F.lit(1)).alias("n"), F.min("rn").alias("a"), F.max("rn").alias("b")).collect()
    assert all(r.b - r.a + 1 == r.n for r in chunks)  # whole stretches of the order
    if width == 64:
        assert {r.n for r in chunks if r.g != "hot"} <= set(range(1, 65)) and len([r for r in chunks if r.g != "hot"]) == 300


def test_interleaved_matches_make_small_chunk_tables(spark):
    """5,000 matches with interleaved ids: a chunk per match, not one per match
    and stretch of ids."""
    rows = spark.range(60_000).select((F.pmod("id", F.lit(5000))).cast("string").alias("g"), F.col("id").alias("o"))
    assert S.layout(rows, ["g"], "o", 1000).select("g", S.CHUNK).distinct().count() > 50_000
    assert S.chunk_by_position(rows, ["g"], "o", 1000).select("g", S.CHUNK).distinct().count() == 5000
    one = rows.where("g = '7'").withColumn("o", F.col("o") * F.col("o"))
    assert S.chunk_by_position(one, ["g"], "o", 5).groupBy(S.CHUNK).count().agg(F.max("count")).first()[0] <= 7


def test_chunks_of_nothing(spark):
    none = spark.createDataFrame([], "g string, o long")
    assert S.row_numbers(none, ["g"], "o", "rn", 5, by_position=True).count() == 0
