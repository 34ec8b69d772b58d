"""Seeded faults: clean matches plus one broken row (or match) per check;
exactly the seeded findings come out."""

import pytest
from pyspark.sql import functions as F

from tandem.config import REFERENCE_ROLES as R
from tandem.operators import quality as qa
from tandem.sources import manifest as mf
from tandem.sources.sinks import save_scratch

SCHEMA = ("match_id string, index long, type long, player_id long, player_name string, team long, "
          "possession_team long, x double, y double, timestamp string, substitute long")
ROSTER = [1, 2, 3, 4]


def _match(mid, teams=(217, 99), holders=(217, 99)):
    rows = []
    for i in range(4):
        rows.append([mid, i + 1, 30, ROSTER[i], f"p{ROSTER[i]}", teams[i % len(teams)],
                     holders[i % len(holders)], 10.0 * i, 5.0 * i, f"00:0{i}:00.000", None])
    return rows


def _events():
    rows = []
    for mid in ("ok", "type", "roster", "x", "y", "time", "sub"):
        rows += _match(mid)
    by = {(r[0], r[1]): r for r in rows}
    by[("type", 2)][2] = 99                      # type outside the domain
    by[("roster", 3)][3] = 555                   # actor not on the roster
    rows.append(["roster", 5, 35, 556, "p556", 217, 217, 1.0, 1.0, "00:05:00.000", None])  # exempt
    rows.append(["roster", 6, 30, None, None, 217, 217, 1.0, 1.0, "00:06:00.000", None])   # NULL actor
    by[("x", 1)][7] = 130.0                      # x beyond 121
    by[("y", 4)][8] = -3.0                       # y below -1
    by[("time", 2)][9] = "00:01:0a.000"          # malformed time
    by[("sub", 4)][10] = 777                     # substitute not on the roster
    by[("sub", 3)][10] = 2                       # substitute on the roster
    rows += _match("one_side", teams=(217,))
    rows += _match("no_focus", teams=(1, 2), holders=(1, 2))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    events = spark.createDataFrame(_events(), SCHEMA)
    mids = [r.match_id for r in events.select("match_id").distinct().collect()] + ["empty"]
    roster = spark.createDataFrame([(m, p) for m in mids for p in ROSTER], "match_id string, player_id long")
    return events, roster, spark.createDataFrame([(m,) for m in mids], "match_id string")


def _set(df):
    return {tuple(r) for r in df.collect()}


def test_row_checks(frames):
    events, roster, _ = frames
    assert _set(qa.invalid_types(events, R).select("match_id", "index")) == {("type", 2)}
    assert _set(qa.off_roster(events, roster, R).select("match_id", "index")) == {("roster", 3)}
    assert _set(qa.out_of_range(events, R, "x").select("match_id", "index")) == {("x", 1)}
    assert _set(qa.out_of_range(events, R, "y").select("match_id", "index")) == {("y", 4)}
    assert _set(qa.off_roster_substitutes(events, roster, R).select("match_id", "index", "substitute")) == \
        {("sub", 4, 777)}


def test_match_checks(frames):
    events, _, matches = frames
    sides = {r.match_id: (r.n_values, r.focus_count) for r in qa.side_status(events, R, R.team, matches).collect()}
    assert sides["one_side"] == (1, 1) and sides["no_focus"] == (2, 0) and sides["ok"] == (2, 1)
    assert sides["empty"] == (0, 0)  # listed match without events
    times = {r.match_id: r.n_residues for r in qa.time_format_status(events, R, matches).collect()}
    assert times["time"] == 2 and times["ok"] == 1 and times["empty"] == 0


def test_findings_frame(frames):
    events, roster, matches = frames
    found = qa.findings(events, roster, R, matches=matches)
    got = {(r.match_id, r.check) for r in found.collect()}
    assert got == {
        ("type", "type_domain"), ("roster", "roster"), ("x", "range_x"), ("y", "range_y"),
        ("sub", "substitute"), ("time", "time_format"),
        ("one_side", "two_sides"), ("no_focus", "focus_in_sides"), ("no_focus", "focus_in_holders"),
        ("empty", "focus_in_sides"), ("empty", "two_sides"), ("empty", "focus_in_holders"),
        ("empty", "two_holders"), ("empty", "time_format"),
    }
    summary = {r.check: r.n_findings for r in qa.findings_summary(found).collect()}
    assert summary["focus_in_sides"] == 2 and summary["type_domain"] == 1


def test_two_scans(frames):
    """All findings read the events twice: once by row, once by match."""
    events, roster, matches = frames
    saved = save_scratch(events, "events")
    plan = qa.findings(saved, roster, R, matches=matches)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") == 2


def test_strict_times(spark):
    rows = [("same", i, 30, 1, "p1", 217 if i else 99, 217 if i else 99, 1.0, 1.0, "T00:00:01.000", None) for i in range(2)]
    rows += [("fine", i, 30, 1, "p1", 217 if i else 99, 217 if i else 99, 1.0, 1.0, "00:00:01.000", None) for i in range(2)]
    events = spark.createDataFrame(rows, SCHEMA)
    roster = spark.createDataFrame([(m, 1) for m in ("same", "fine")], "match_id string, player_id long")
    assert qa.findings(events, roster, R).count() == 0  # one wrong form throughout passes, as in the original
    assert [tuple(r) for r in qa.findings(events, roster, R, strict=True).collect()] == [("same", "time_strict", None, "1")]


def test_half_markers(spark):
    rows = [("two", 7, 18), ("two", 9, 18), ("early", 3, 18), ("early", 9, 30), ("none", 9, 30)]
    events = spark.createDataFrame(rows, "match_id string, index long, type long")
    matches = spark.createDataFrame([(m,) for m in ("two", "early", "none", "absent")], "match_id string")
    found = qa.half_markers(events, R, matches)
    assert {tuple(r) for r in found.collect()} == {("two", 7, 2), ("early", None, 0), ("none", None, 0), ("absent", None, 0)}
    assert {r.match_id for r in qa.marker_findings(found).collect()} == {"early", "none", "absent"}
    assert {(r.match_id, r.value) for r in qa.marker_findings(found, most=1).collect()} >= {("two", "2")}


def test_findings_of_extreme_keys(spark):
    """A roster key is never mistaken for the key of a row that needs none."""
    events = spark.createDataFrame([("m", i, 99, None, None, 217 if i else 9, 217 if i else 9, 1.0, 1.0, "00:00:01.000", None) for i in range(3)], SCHEMA)
    keys = events.select(F.xxhash64(F.lit("m"), F.col("index"), F.lit("type_domain")).alias("player_id"))
    assert qa.findings(events, keys, R).where("check = 'type_domain'").count() == 3


def test_null_type_is_no_domain_finding(spark):
    df = spark.createDataFrame([("m", 1, None)], "match_id string, index long, type long")
    assert qa.invalid_types(df, R).count() == 0


def test_missing_files(spark, tmp_path):
    (tmp_path / "events").mkdir()
    (tmp_path / "lineups").mkdir()
    for mid in (1, 2):
        (tmp_path / "events" / f"{mid}.json").write_text("[]")
    (tmp_path / "lineups" / "1.json").write_text("[]")
    matches = spark.createDataFrame([(1,), (2,), (3,)], "match_id long")
    root = f"file:{tmp_path}"
    manifest = mf.manifest_long(matches, f"{root}/events/", f"{root}/lineups/")
    from tandem.sources.files import listing
    missing = mf.missing_files(manifest, listing(spark, str(tmp_path), "*.json"))
    got = {(r.match_id, r.kind) for r in missing.collect()}
    assert got == {("2", "lineups"), ("3", "events"), ("3", "lineups")}
