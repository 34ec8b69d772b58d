"""Goal flags, segments (halves), defence flags and the four look-ahead labels.

Labels look at the current event and the next ``k`` events of the same match
*and* segment, by ``index``; they are computed for every match in one pass
through the chunked sequence operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.config import Roles
from tandem.functions.columns import flag, in_set
from tandem.operators import sequence

SEGMENT = "half"


def goal_flags(df: DataFrame, roles: Roles) -> DataFrame:
    """``focus_goal``/``other_goal``: a goal (``roles.goal_expr``) by the focus
    side / by the other side."""
    goal = F.expr(roles.goal_expr)
    team = F.col(roles.team)
    return df.withColumns({
        "focus_goal": flag((team == F.lit(roles.focus)) & goal),
        "other_goal": flag((team != F.lit(roles.focus)) & goal),
    })


def segment_by_marker(df: DataFrame, roles: Roles) -> DataFrame:
    """``half`` = 1 before the first marker row with index above
    ``marker_min_index`` in the match, else 2 (also when there is none)."""
    idx = F.col(roles.index)
    marker = F.when(F.expr(roles.marker_expr) & (idx > roles.marker_min_index), idx)
    out = sequence.group_min(df, [roles.match], roles.index, marker, "_marker", roles.chunk_width)
    return (out.withColumn(SEGMENT, F.when(idx < F.col("_marker"), F.lit(1)).otherwise(F.lit(2)))
            .drop("_marker"))


def defence_flags(df: DataFrame, roles: Roles) -> DataFrame:
    """Per event: defensive action by / ball held by the focus side
    (``focus_def``, ``focus_hold``) and by the other side (``other_def``,
    ``other_hold``). A dispossession counts as defence of the opponent."""
    team, typ, holder = F.col(roles.team), F.col(roles.type), F.col(roles.holder)
    focus = F.lit(roles.focus)
    own, other = team == focus, team != focus
    defence = in_set(typ, roles.defence_types)
    disp = in_set(typ, roles.dispossessed_types)
    return df.withColumns({
        "focus_def": flag((own & defence) | (other & disp)),
        "focus_hold": flag(holder == focus),
        "other_def": flag((other & defence) | (own & disp)),
        "other_hold": flag(holder != focus),
    })


def next_k_sums(df: DataFrame, roles: Roles, flags: dict[str, str]) -> DataFrame:
    """Sum of each flag over the current event and the next k events in the
    same match and segment."""
    return sequence.lookahead_sums(df, [roles.match, SEGMENT], roles.index, flags, roles.k,
                                   roles.chunk_width, layout_group=[roles.match])


def label_events(df: DataFrame, roles: Roles) -> DataFrame:
    """Events (with ``half``, goal and defence flags) -> four 0/1 labels.

    goal: a focus goal ahead while the focus side holds the ball; concede: an
    opponent goal ahead, also only while the focus side holds the ball; keep:
    focus possession ahead and the event is focus defence or possession; lose:
    opponent possession ahead and the event is opponent defence.
    """
    ahead = next_k_sums(df, roles, {"focus_goal": "_g", "other_goal": "_c",
                                    "focus_hold": "_fh", "other_hold": "_oh"})
    holds = F.col(roles.holder) == F.lit(roles.focus)
    g, c, kp, ls = roles.labels
    return ahead.withColumns({
        g: flag((F.col("_g") > 0) & holds),
        c: flag((F.col("_c") > 0) & holds),
        kp: flag((F.col("_fh") > 0) & ((F.col("focus_def") == 1) | (F.col("focus_hold") == 1))),
        ls: flag((F.col("_oh") > 0) & (F.col("other_def") == 1)),
    }).drop("_g", "_c", "_fh", "_oh")


def labelled(events: DataFrame, roles: Roles) -> DataFrame:
    """Clean events -> goal flags, half, defence flags and labels."""
    return label_events(defence_flags(segment_by_marker(goal_flags(events, roles), roles), roles),
                        roles)
