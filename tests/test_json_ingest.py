"""Nested JSON input in the original layout: one multi-line JSON array per
match for events and for lineups, optional fields absent in some files."""

import json

import pytest
from pyspark.sql import functions as F

from tandem.config import REFERENCE_ROLES
from tandem.operators import labels as lb
from tandem.operators import quality as qa
from tandem.plans import season

R = REFERENCE_ROLES.with_(chunk_width=3)


def _event(i, typ, pid, name, team, holder, loc, ts, **extra):
    e = {"index": i, "type": {"id": typ, "name": "t"}, "team": {"id": team, "name": "x"},
         "possession_team": {"id": holder}, "timestamp": ts, "period": 1}
    if pid is not None:
        e["player"] = {"id": pid, "name": name}
    if loc is not None:
        e["location"] = loc
    e.update(extra)
    return e


@pytest.fixture(scope="module")
def season_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("season")
    (root / "events").mkdir()
    (root / "lineups").mkdir()
    m1 = [
        _event(1, 35, None, None, 217, 217, None, "00:00:00.000"),
        _event(2, 30, 7, "Ana", 217, 217, [60.0, 40.0], "00:00:01.100"),
        _event(3, 16, 9, "Bo", 217, 217, [110.0, 38.0], "00:00:03.250",
               shot={"outcome": {"id": 97, "name": "Goal"}}),
        _event(4, 30, 3, "Cy", 99, 99, [60.0, 40.0], "00:00:05.000"),
        _event(5, 17, 9, "Bo", 217, 99, [70.0, 20.0], "00:00:06.000"),
        _event(6, 30, 3, "Cy", 99, 99, [50.0, 30.0], "00:00:07.000"),
        _event(7, 18, None, None, 217, 217, None, "00:00:00.000"),
        _event(8, 30, 11, "Di", 217, 217, [40.0, 10.0], "00:00:02.000"),
        _event(9, 19, 7, "Ana", 217, 217, None, "00:10:00.000",
               substitution={"replacement": {"id": 12, "name": "Ed"}}),
    ]
    m2 = [  # no shot, no substitution field anywhere in this file
        _event(1, 30, 9, "Bo", 217, 217, [10.0, 10.0], "00:00:01.000"),
        _event(2, 30, 3, "Cy", 99, 217, [20.0, 10.0], "00:00:02.000"),
        _event(3, 25, 7, "Ana", 217, 217, [30.0, 10.0], "00:00:03.000"),
    ]
    lineup = [{"team_id": 217, "lineup": [{"player_id": p, "player_name": n}
                                          for p, n in ((7, "Ana"), (9, "Bo"), (11, "Di"), (12, "Ed"))]},
              {"team_id": 99, "lineup": [{"player_id": 3, "player_name": "Cy"}]}]
    for mid, events in ((101, m1), (202, m2)):
        (root / "events" / f"{mid}.json").write_text(json.dumps(events, indent=2))
        (root / "lineups" / f"{mid}.json").write_text(json.dumps(lineup, indent=2))
    return root


def test_read_and_flatten(spark, season_dir):
    events, roster = season.json_season(spark, str(season_dir / "events"), str(season_dir / "lineups"), R)
    rows = {(r.match_id, r["index"]): r for r in events.collect()}
    assert len(rows) == 12
    assert rows[("101", 3)].shot_outcome == 97 and rows[("101", 3)].x == 110.0
    assert rows[("101", 1)].player_id is None and rows[("101", 1)].x is None
    assert rows[("101", 9)].substitute == 12
    assert rows[("202", 1)].substitute is None and rows[("202", 1)].shot_outcome is None
    assert roster.filter(F.col("match_id") == "101").count() == 5


def test_labels_and_checks_from_files(spark, season_dir):
    events, roster = season.json_season(spark, str(season_dir / "events"), str(season_dir / "lineups"), R)
    lab = {(r.match_id, r["index"]): r for r in lb.labelled(events, R).collect()}
    # half 2 starts at the half-start marker with index 7 (> 5)
    assert [lab[("101", i)].half for i in range(1, 10)] == [1] * 6 + [2] * 3
    # goal at 101/3 is seen from 101/1..3 (same half) while the focus side holds the ball
    assert [lab[("101", i)].label_goal for i in range(1, 7)] == [1, 1, 1, 0, 0, 0]
    # own goal for (type 25) by the focus side counts as a focus goal
    assert lab[("202", 3)].focus_goal == 1 and lab[("202", 1)].label_goal == 1
    # match 202 has no marker: everything is half 2
    assert {lab[("202", i)].half for i in (1, 2, 3)} == {2}
    found = qa.findings(events, roster, R)
    checks = {(r.match_id, r.check) for r in found.collect()}
    # all types, players, places and times are fine; match 202 has one ball holder
    assert checks == {("202", "two_holders")}


def test_json_lines_splittable(spark, season_dir, tmp_path):
    from tandem.sources import files

    nested = files.read_events(spark, str(season_dir / "events"))
    out = str(tmp_path / "jsonl")
    nested.drop("match_id").write.json(out)
    back = files.read_events(spark, out, multiline=False)
    assert back.count() == 12


def test_whole_season_run(spark, season_dir, tmp_path):
    """All steps from files: missing files, findings, labels, models for both
    kinds, both rankings with their top 20."""
    
    matches = tmp_path / "matches.json"
    matches.write_text(json.dumps([{"match_id": 101}, {"match_id": 202}, {"match_id": 303}]))
    out = season.run_json_season(spark, str(season_dir), str(tmp_path / "out"), str(matches), R, max_iter=2)
    found = {(r.match_id, r.check) for r in spark.read.parquet(out["findings"]).collect()}
    assert ("303", "missing_events") in found and ("303", "missing_lineups") in found
    assert ("202", "two_holders") in found and ("202", "half_marker") in found and ("101", "half_marker") not in found
    assert {("303", "half_marker"), ("303", "two_sides")} <= found
    assert spark.read.parquet(out["labelled"]).count() == 12
    for kind in ("gbt", "lr"):
        assert spark.read.parquet(out[f"predictions_{kind}"]).count() == 9  # rows with actor and place
        for by in ("season_modified", "season_plain"):
            assert spark.read.parquet(out[f"ranking_{kind}_{by}_top"]).count() == spark.read.parquet(out[f"ranking_{kind}_{by}"]).count() == 1
        # kept rows (actor and place, not the first of a match): every focus
        # event follows an opponent event, so there is no valid interaction
        ranking = spark.read.parquet(out[f"ranking_{kind}"]).collect()
        assert [(r.pair, r.season_modified, r.season_plain) for r in ranking] == [(None, 0.0, 0.0)]


def test_command_line(season_dir, tmp_path):
    """``python -m tandem`` runs the whole season in its own Spark session."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    out = tmp_path / "cli"
    env = dict(os.environ, PYTHONPATH=str(root))
    proc = subprocess.run([sys.executable, "-m", "tandem", str(season_dir), str(out), "--kinds", "lr"],
                          cwd=str(tmp_path), env=env, capture_output=True, text=True, timeout=600)
    assert proc.returncode == 0, proc.stderr[-2000:]
    written = json.loads(proc.stdout[proc.stdout.index("{"):])
    assert set(written) >= {"findings", "labelled", "predictions_lr", "ranking_lr"}
    assert (out / "models" / "lr" / "label_goal").exists()


def test_unlisted_and_unreadable_files(spark, season_dir, tmp_path):
    """Files that aren't listed are not opened; of the listed ones a missing file
    is a finding, and so is one that can't be parsed."""
    import shutil

    root = tmp_path / "season"
    shutil.copytree(season_dir, root)
    (root / "events" / "999.json").write_text('[{"index": 1}, {"ind')
    wanted = spark.createDataFrame([(101,), (202,), (303,)], "match_id long")
    rows = {tuple(map(str, r)) for r in season.json_season(spark, str(season_dir / "events"), str(season_dir / "lineups"), R)[0].collect()}
    events, roster, unreadable = season.json_season(spark, str(root / "events"), str(root / "lineups"), R, matches=wanted, rejects=True)
    assert {tuple(map(str, r)) for r in events.collect()} == rows and unreadable.count() == 0 and roster.count() == 10
    everything = season.json_season(spark, str(root / "events"), str(root / "lineups"), R, rejects=True)
    assert {tuple(map(str, r)) for r in everything[0].collect()} == rows
    assert [(r.match_id, r.check, r.value.split("/")[-1]) for r in everything[2].collect()] == [("999", "unreadable_events", "999.json")]


def test_listed_reader(spark, tmp_path):
    """Batches, odd names, empty files, wrong types, repeated and missing paths."""
    from tandem.sources import listed
    from tandem.sources.schemas import EVENT_SCHEMA

    (tmp_path / "in").mkdir()
    texts = {"1": '[{"index": 1}, {"index": 2}]', "2": '[{"index": 1}, {"ind', "3": '[{"index": 1}, {"index": "x"}]', "a+b [4]{c}": '[{"index": 4}]',
             "5": "", "6": "[]", "7": "nonsense"}
    for name, text in texts.items():
        (tmp_path / "in" / f"{name}.json").write_text(text)
    paths = listed.present(spark, str(tmp_path / "in"), "events")
    gone = spark.createDataFrame([("x", "events", None)], paths.schema)
    for size in (1, 3, 100):
        got = listed.read_paths(spark, paths.union(paths).union(gone), EVENT_SCHEMA, "t", files_per_read=size)
        assert sorted((r.match_id, r["index"]) for r in got.rows.collect()) == [("1", 1), ("1", 2), ("a+b [4]{c}", 4)]
        assert {r.match_id for r in got.rejects.collect()} == {"2", "3", "7"}
    assert [len(b) for b in listed.batches(paths.union(paths), 3)] == [3, 3]  # an empty file is listed by size
    none = listed.read_paths(spark, paths.where("false"), EVENT_SCHEMA, "t")
    assert none.rows.count() == none.rejects.count() == 0
    (tmp_path / "list.json").write_text('[{"match_id": 5}, {"other": 1}]')
    assert [r.match_id for r in listed.read_match_list(spark, str(tmp_path / "list.json")).rows.collect()] == [5]


def test_match_list_selects_matches(spark, season_dir):
    only = spark.createDataFrame([(202,)], "match_id long")
    events, roster = season.json_season(spark, str(season_dir / "events"), str(season_dir / "lineups"), R,
                                        matches=only)
    assert {r.match_id for r in events.select("match_id").distinct().collect()} == {"202"}
    assert events.count() == 3
    assert {r.match_id for r in roster.select("match_id").distinct().collect()} == {"202"}
