"""Focused label rules on small hand-made matches (focus side 217, k = 5)."""

from pyspark.sql import functions as F

from tandem.config import REFERENCE_ROLES
from tandem.operators import labels as lb

R = REFERENCE_ROLES.with_(chunk_width=3)
SCHEMA = ("match_id string, index long, type long, team long, possession_team long, "
          "shot_outcome long, x double")


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _by_index(df, col):
    return {r["index"]: r[col] for r in df.collect()}


def test_marker_needs_index_above_five_and_first_wins(spark):
    rows = [("m", i, 30, 217, 217, None, 1.0) for i in range(1, 13)]
    rows[2] = ("m", 3, 18, 217, 217, None, 1.0)    # too early: ignored
    rows[8] = ("m", 9, 18, 217, 217, None, 1.0)    # first valid marker
    rows[10] = ("m", 11, 18, 217, 217, None, 1.0)  # later marker: still half 2
    halves = _by_index(lb.segment_by_marker(_rows(spark, rows), R), "half")
    assert [halves[i] for i in range(1, 13)] == [1] * 8 + [2] * 4


def test_lookahead_includes_current_row_and_stops_at_half(spark):
    # goal by the focus side at index 7, which opens half 2 (marker at 7)
    rows = [("m", i, 30, 217, 217, None, 1.0) for i in range(1, 11)]
    rows[6] = ("m", 7, 18, 217, 217, None, 1.0)
    rows[7] = ("m", 8, 16, 217, 217, 97, 1.0)
    lab = lb.labelled(_rows(spark, rows), R)
    goal = _by_index(lab, "label_goal")
    # half 1 (1..6) never sees the goal; half 2 rows 7 and 8 see it (8 itself)
    assert [goal[i] for i in range(1, 11)] == [0, 0, 0, 0, 0, 0, 1, 1, 0, 0]


def test_concede_needs_focus_possession(spark):
    rows = [("m", 1, 30, 217, 217, None, 1.0), ("m", 2, 30, 99, 99, None, 1.0),
            ("m", 3, 16, 99, 99, 97, 1.0)]
    conc = _by_index(lb.labelled(_rows(spark, rows), R), "label_concede")
    assert conc == {1: 1, 2: 0, 3: 0}


def test_keep_and_lose_are_asymmetric(spark):
    # other side holds the ball throughout; only an opponent defensive action
    # (pressure 17 by team 99) makes a lose label, mere opponent possession
    # does not, while focus possession alone does make a keep label
    rows = [("m", 1, 30, 99, 99, None, 1.0), ("m", 2, 17, 99, 99, None, 1.0),
            ("m", 3, 30, 217, 217, None, 1.0), ("m", 4, 3, 217, 99, None, 1.0)]
    lab = lb.labelled(_rows(spark, rows), R)
    lose, keep = _by_index(lab, "label_lose"), _by_index(lab, "label_keep")
    assert lose == {1: 0, 2: 1, 3: 0, 4: 1}  # 4: focus dispossessed = opponent defence
    assert keep == {1: 0, 2: 0, 3: 1, 4: 0}


def test_own_goal_for_counts_for_its_side(spark):
    rows = [("m", 1, 30, 99, 217, None, 1.0), ("m", 2, 25, 99, 217, None, 1.0)]
    flags = lb.goal_flags(_rows(spark, rows), R)
    got = {r["index"]: (r.focus_goal, r.other_goal) for r in flags.collect()}
    assert got == {1: (0, 0), 2: (0, 1)}
    conc = _by_index(lb.labelled(_rows(spark, rows), R), "label_concede")
    assert conc == {1: 1, 2: 1}


def test_null_team_and_holder_give_zero_flags(spark):
    rows = [("m", 1, 17, None, None, None, 1.0)]
    flags = lb.defence_flags(_rows(spark, rows), R).select("focus_def", "focus_hold", "other_def", "other_hold")
    assert tuple(flags.first()) == (0, 0, 0, 0)
    assert lb.labelled(_rows(spark, rows), R).select(*R.labels).first() == (0, 0, 0, 0)
