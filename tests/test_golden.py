"""Hand-checkable golden case (FIXTURES.md section 3): focus side 217, k = 5,
goal flags and halves given, probabilities in sixteenths."""

import pytest
from pyspark.sql import functions as F

from tandem.config import REFERENCE_ROLES
from tandem.operators import labels as lb
from tandem.operators import value as vl

R = REFERENCE_ROLES.with_(chunk_width=4)

# m, idx, type, actor, name, team, holder, hg, ag, half, score, concede, keep, lose,
# expected goal, concede, keep, lose
GOLDEN = [
    ("m1", 1, 30, 7, "Ana", 217, 217, 0, 0, 1, 2, 1, 8, 2, 1, 0, 1, 0),
    ("m1", 2, 42, 9, "Bo", 217, 217, 0, 0, 1, 4, 1, 9, 1, 1, 0, 1, 0),
    ("m1", 3, 30, 9, "Bo", 217, 217, 0, 0, 1, 5, 2, 9, 3, 1, 0, 1, 0),
    ("m1", 4, 17, 3, "Cy", 99, 217, 0, 0, 1, 5, 2, 7, 6, 1, 0, 1, 1),
    ("m1", 5, 10, 7, "Ana", 217, 99, 0, 0, 1, 6, 1, 10, 4, 0, 0, 1, 0),
    ("m1", 6, 16, 9, "Bo", 217, 217, 1, 0, 1, 12, 1, 11, 2, 1, 0, 1, 0),
    ("m1", 7, 30, 3, "Cy", 99, 99, 0, 0, 2, 1, 3, 4, 9, 0, 0, 0, 0),
    ("m1", 8, 3, 3, "Cy", 99, 99, 0, 0, 2, 2, 3, 5, 8, 0, 0, 1, 0),
    ("m1", 9, 2, 7, "Ana", 217, 217, 0, 0, 2, 3, 2, 8, 6, 0, 1, 1, 0),
    ("m1", 10, 16, 3, "Cy", 99, 99, 0, 1, 2, 1, 9, 2, 9, 0, 0, 0, 0),
    ("m2", 1, 30, 9, "Bo", 217, 217, 0, 0, 1, 3, 1, 8, 2, 0, 0, 1, 0),
    ("m2", 2, 30, 7, "Ana", 217, 217, 0, 0, 1, 4, 1, 9, 2, 0, 0, 1, 0),
    ("m2", 3, 30, 11, "Di", 217, 217, 0, 0, 1, 6, 0, 10, 1, 0, 0, 1, 0),
    ("m2", 4, 16, 7, "Ana", 217, 217, 0, 0, 1, 9, 0, 12, 1, 0, 0, 1, 0),
]
COLS = ["match_id", "index", "type", "player_id", "player_name", "team", "possession_team",
        "focus_goal", "other_goal", "half", "s", "c", "kp", "ls", "e_goal", "e_concede", "e_keep", "e_lose"]


@pytest.fixture(scope="module")
def golden(spark):
    df = spark.createDataFrame(GOLDEN, COLS)
    return df.withColumns({
        "p_score": F.col("s") / 16.0, "p_concede": F.col("c") / 16.0,
        "p_keep": F.col("kp") / 16.0, "p_lose": F.col("ls") / 16.0,
    })


def test_labels(golden):
    out = lb.label_events(lb.defence_flags(golden, R), R)
    rows = out.select("match_id", "index", *R.labels, "e_goal", "e_concede", "e_keep", "e_lose").collect()
    assert len(rows) == len(GOLDEN)
    for r in rows:
        assert (r.label_goal, r.label_concede, r.label_keep, r.label_lose) == \
               (r.e_goal, r.e_concede, r.e_keep, r.e_lose), r


def test_pair_ranking(golden):
    probs = golden.select("match_id", "index", "player_id", "player_name", "team", *vl.PROBS)
    ranked = vl.rank_pairs(vl.season_pair_totals(vl.interactions(probs, R))).collect()
    assert [(r.pair, r.season_modified, r.season_plain) for r in ranked] == [
        ("(Di, Ana)", 1.0625, 0.625), ("(Bo, Ana)", 1.0, 0.5), (None, 0.0, 0.0)]


def test_interactions_detail(golden):
    probs = golden.select("match_id", "index", "player_id", "player_name", "team", *vl.PROBS)
    rows = {(r.match_id, r["index"]): r for r in vl.interactions(probs, R).collect()}
    # the first event of a match is dropped, so m1 1->2 is no interaction
    assert ("m1", 1) not in rows and rows[("m1", 2)].valid == 0
    assert rows[("m1", 2)].i_scoring is None
    # same actor twice is not an interaction
    assert rows[("m1", 3)].valid == 0
    # both directions of Ana/Di land on one pair key
    assert rows[("m2", 3)].pair == rows[("m2", 4)].pair == "(Di, Ana)"
    nulls = [r for r in rows.values() if r.pair is None]
    assert len(nulls) == 9


def test_top_pairs_limit(golden):
    probs = golden.select("match_id", "index", "player_id", "player_name", "team", *vl.PROBS)
    top = vl.top_pairs(vl.season_pair_totals(vl.interactions(probs, R)), 2).collect()
    assert [r.pair for r in top] == ["(Di, Ana)", "(Bo, Ana)"]


def test_pair_by_id_and_without_null(golden):
    probs = golden.select("match_id", "index", "player_id", "player_name", "team", *vl.PROBS)
    totals = vl.season_pair_totals(vl.interactions(probs, R, by="id"), keep_null=False)
    got = {(r.pair, r.pair_names, r.season_modified) for r in totals.collect()}
    assert got == {("(11, 7)", "(Di, Ana)", 1.0625), ("(9, 7)", "(Bo, Ana)", 1.0)}


def test_ranking_order(spark, golden, tmp_path):
    import glob

    from tandem.plans import season

    probs = golden.select("match_id", "index", "player_id", "player_name", "team", *vl.PROBS)
    path = str(tmp_path / "ranking")
    season.write_ranking(vl.season_pair_totals(vl.interactions(probs, R)), path)
    import pyarrow.parquet as pq

    pairs = [p for f in sorted(glob.glob(path + "/*.parquet")) for p in pq.read_table(f)["pair"].to_pylist()]
    assert pairs == ["(Di, Ana)", "(Bo, Ana)", None]


def test_ranking_in_parts(spark, tmp_path):
    """A ranking is written by several tasks; its part files, read in name
    order, hold the whole ranking in rank order."""
    import glob

    import pyarrow.parquet as pq

    from tandem.plans import season

    totals = spark.range(0, 5000).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("pair"),
        ((F.col("id") * 7919 % 1000) / 8.0).alias("season_modified"),
        (F.col("id") / 4.0).alias("season_plain"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        path = str(tmp_path / "ranking_big")
        season.write_ranking(totals, path)
    finally:
        spark.conf.set(key, old)
    parts = sorted(glob.glob(path + "/*.parquet"))
    assert len(parts) > 1
    got = [(r["season_modified"], r["pair"]) for p in parts for r in pq.read_table(p).to_pylist()]
    want = [(r.season_modified, r.pair) for r in totals.collect()]
    assert got == sorted(want, key=lambda t: (-t[0], t[1]))
