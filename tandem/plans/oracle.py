"""DuckDB SQL for each registered query, over the raw driver tables.

Written from the table binding (FIXTURES.md section 2) with plain windows and
joins, independently of the Spark operators, so that the two sides check
each other. Types are cast to the Spark result types (sums of integers to
BIGINT, probabilities to DOUBLE).
"""

from __future__ import annotations

EVENT_PREFIX = "data/events/"
LINEUP_PREFIX = "data/lineups/"

_CTE = {
    "ev": """
  SELECT event_id,
         CAST(CAST(ts AS DATE) AS VARCHAR) AS match_id,
         event_type AS type,
         user_id AS player_id,
         'user_' || CAST(user_id AS VARCHAR) AS player_name,
         user_id % 2 AS team,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         value AS x,
         strftime(ts, '%H:%M:%S.%g') AS timestamp
  FROM events""",
    "bound": """
  SELECT event_id, match_id, row_number() OVER (PARTITION BY match_id ORDER BY event_id) AS index,
         type, player_id, player_name, team, CAST(k % 2 AS BIGINT) AS possession_team,
         [x, CAST(k AS DOUBLE)] AS location, x, CAST(k AS DOUBLE) AS y, timestamp,
         CAST(CASE WHEN type = 'signup' THEN k END AS BIGINT) AS substitute
  FROM ev""",
    "roster": """
  SELECT c_custkey AS player_id FROM customer WHERE c_acctbal >= 0""",
    "flags": """
  SELECT *,
    CASE WHEN team = 1 AND ((type = 'purchase' AND x > 60) OR (type = 'signup' AND x > 250))
         THEN 1 ELSE 0 END AS focus_goal,
    CASE WHEN team <> 1 AND ((type = 'purchase' AND x > 60) OR (type = 'signup' AND x > 250))
         THEN 1 ELSE 0 END AS other_goal,
    min(CASE WHEN type = 'signup' AND CAST(substring(timestamp, 1, 2) AS INTEGER) >= 12 AND index > 5
             THEN index END) OVER (PARTITION BY match_id) AS marker
  FROM bound""",
    "halves": """
  SELECT *,
    CASE WHEN index < marker THEN 1 ELSE 2 END AS half,
    CASE WHEN (team = 1 AND type IN ('error', 'signup')) OR (team <> 1 AND type = 'view')
         THEN 1 ELSE 0 END AS focus_def,
    CASE WHEN possession_team = 1 THEN 1 ELSE 0 END AS focus_hold,
    CASE WHEN (team <> 1 AND type IN ('error', 'signup')) OR (team = 1 AND type = 'view')
         THEN 1 ELSE 0 END AS other_def,
    CASE WHEN possession_team <> 1 THEN 1 ELSE 0 END AS other_hold
  FROM flags""",
    "ahead": """
  SELECT *,
    CAST(sum(focus_goal) OVER w AS BIGINT) AS g5, CAST(sum(other_goal) OVER w AS BIGINT) AS c5,
    CAST(sum(focus_hold) OVER w AS BIGINT) AS fh5, CAST(sum(other_hold) OVER w AS BIGINT) AS oh5
  FROM halves
  WINDOW w AS (PARTITION BY match_id, half ORDER BY index ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)""",
    "labelled": """
  SELECT *,
    CASE WHEN g5 > 0 AND possession_team = 1 THEN 1 ELSE 0 END AS label_goal,
    CASE WHEN c5 > 0 AND possession_team = 1 THEN 1 ELSE 0 END AS label_concede,
    CASE WHEN fh5 > 0 AND (focus_def = 1 OR focus_hold = 1) THEN 1 ELSE 0 END AS label_keep,
    CASE WHEN oh5 > 0 AND other_def = 1 THEN 1 ELSE 0 END AS label_lose
  FROM ahead""",
    "probs": """
  SELECT match_id, index, player_id, player_name, team,
    CAST((event_id * 37) % 1024 AS DOUBLE) / CAST(1024 AS DOUBLE) AS p_score,
    CAST((event_id * 101) % 1024 AS DOUBLE) / CAST(1024 AS DOUBLE) AS p_concede,
    CAST((event_id * 211 + player_id * 7) % 1024 AS DOUBLE) / CAST(1024 AS DOUBLE) AS p_keep,
    CAST((event_id * 307 + CAST(y AS BIGINT)) % 1024 AS DOUBLE) / CAST(1024 AS DOUBLE) AS p_lose
  FROM bound WHERE player_id IS NOT NULL AND x IS NOT NULL""",
    "lagged": """
  SELECT *, lag(p_score) OVER w AS prev_p_score, lag(p_concede) OVER w AS prev_p_concede,
         lag(p_keep) OVER w AS prev_p_keep, lag(p_lose) OVER w AS prev_p_lose
  FROM probs WINDOW w AS (PARTITION BY match_id ORDER BY index)""",
    "kept": """
  SELECT * FROM lagged
  WHERE match_id IS NOT NULL AND index IS NOT NULL AND player_id IS NOT NULL
    AND player_name IS NOT NULL AND team IS NOT NULL
    AND p_score IS NOT NULL AND NOT isnan(p_score) AND p_concede IS NOT NULL AND NOT isnan(p_concede)
    AND p_keep IS NOT NULL AND NOT isnan(p_keep) AND p_lose IS NOT NULL AND NOT isnan(p_lose)
    AND prev_p_score IS NOT NULL AND NOT isnan(prev_p_score)
    AND prev_p_concede IS NOT NULL AND NOT isnan(prev_p_concede)
    AND prev_p_keep IS NOT NULL AND NOT isnan(prev_p_keep)
    AND prev_p_lose IS NOT NULL AND NOT isnan(prev_p_lose)""",
    "deltas": """
  SELECT *, p_score - prev_p_score AS d_p_score, p_concede - prev_p_concede AS d_p_concede,
         p_keep - prev_p_keep AS d_p_keep, p_lose - prev_p_lose AS d_p_lose
  FROM kept""",
    "vals": """
  SELECT *, d_p_score - d_p_concede AS v_scoring, d_p_keep - d_p_lose AS v_possession FROM deltas""",
    "meta": """
  SELECT *, lag(player_name) OVER w AS prev_player_name, lag(player_id) OVER w AS prev_player_id,
         lag(team) OVER w AS prev_team, lag(v_scoring) OVER w AS prev_v_scoring,
         lag(v_possession) OVER w AS prev_v_possession
  FROM vals WINDOW w AS (PARTITION BY match_id ORDER BY index)""",
    "valid": """
  SELECT *, CASE WHEN player_id <> prev_player_id AND team = 1 AND prev_team = 1 THEN 1 ELSE 0 END AS valid
  FROM meta""",
    "inter": """
  SELECT *, (v_scoring + prev_v_scoring) * valid + 0.0 AS i_scoring,
         (v_possession + prev_v_possession) * valid + 0.0 AS i_possession
  FROM valid""",
    "pairs": """
  SELECT *, i_scoring + i_possession AS i_modified,
    CASE WHEN valid = 1 THEN '(' || array_to_string([a.name for a in list_reverse_sort(
      [{'id': player_id, 'name': player_name}, {'id': prev_player_id, 'name': prev_player_name}])], ', ') || ')' END AS pair
  FROM inter""",
    "totals": """
  SELECT pair, sum(i_modified) + 0.0 AS season_modified, sum(i_scoring) + 0.0 AS season_plain
  FROM pairs GROUP BY pair""",
    "manifest": f"""
  SELECT CAST(o_orderkey AS VARCHAR) AS match_id, 'events' AS kind,
         '{EVENT_PREFIX}' || CAST(o_orderkey AS VARCHAR) || '.json' AS path FROM orders
  UNION ALL
  SELECT CAST(o_orderkey AS VARCHAR) AS match_id, 'lineups' AS kind,
         '{LINEUP_PREFIX}' || CAST(o_orderkey AS VARCHAR) || '.json' AS path FROM orders""",
    "listed": f"""
  SELECT '{EVENT_PREFIX}' || CAST(l_orderkey AS VARCHAR) || '.json' AS path FROM lineitem
  UNION ALL
  SELECT '{LINEUP_PREFIX}' || CAST(l_orderkey AS VARCHAR) || '.json' AS path FROM lineitem""",
    "side_status": """
  SELECT match_id, count(*) AS n_values, count(CASE WHEN v = 1 THEN 1 END) AS focus_count
  FROM (SELECT DISTINCT match_id, team AS v FROM bound) GROUP BY match_id""",
    "holder_status": """
  SELECT match_id, count(*) AS n_values, count(CASE WHEN v = 1 THEN 1 END) AS focus_count
  FROM (SELECT DISTINCT match_id, possession_team AS v FROM bound) GROUP BY match_id""",
    "residue_status": """
  SELECT match_id, count(*) AS n_residues
  FROM (SELECT DISTINCT match_id, regexp_replace(timestamp, '[0-9:.]', '', 'g') AS res FROM bound)
  GROUP BY match_id""",
    "found": """
  SELECT match_id, 'type_domain' AS "check", index, type AS value FROM bound
  WHERE type NOT IN ('click', 'view', 'purchase')
  UNION ALL
  SELECT match_id, 'roster', index, CAST(player_id AS VARCHAR) FROM bound b
  WHERE player_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM roster r WHERE r.player_id = b.player_id)
  UNION ALL
  SELECT match_id, 'range_x', index, CAST(x AS VARCHAR) FROM bound WHERE x < -1 OR x > 121
  UNION ALL
  SELECT match_id, 'range_y', index, CAST(y AS VARCHAR) FROM bound WHERE y < -1 OR y > 81
  UNION ALL
  SELECT match_id, 'substitute', index, CAST(substitute AS VARCHAR)
  FROM (SELECT DISTINCT match_id, index, substitute FROM bound WHERE substitute IS NOT NULL) s
  WHERE NOT EXISTS (SELECT 1 FROM roster r WHERE r.player_id = s.substitute)
  UNION ALL
  SELECT match_id, 'focus_in_sides', NULL, CAST(focus_count AS VARCHAR) FROM side_status WHERE focus_count <> 1
  UNION ALL
  SELECT match_id, 'two_sides', NULL, CAST(n_values AS VARCHAR) FROM side_status WHERE n_values <> 2
  UNION ALL
  SELECT match_id, 'focus_in_holders', NULL, CAST(focus_count AS VARCHAR) FROM holder_status
  WHERE focus_count <> 1
  UNION ALL
  SELECT match_id, 'two_holders', NULL, CAST(n_values AS VARCHAR) FROM holder_status WHERE n_values <> 2
  UNION ALL
  SELECT match_id, 'time_format', NULL, CAST(n_residues AS VARCHAR) FROM residue_status WHERE n_residues <> 1
  UNION ALL
  SELECT match_id, 'missing_' || kind, NULL, path FROM manifest m
  WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.path = m.path)""",
}

# Events with faults by the day of the month, and what checks see in them.
_CTE |= {
    "seeded": """
  SELECT event_id, match_id, index, x, y, substitute,
    CASE WHEN d = 11 AND third THEN NULL ELSE type END AS type,
    CASE WHEN d = 12 AND third THEN NULL ELSE player_id END AS player_id,
    CASE WHEN d = 5 AND team = 1 THEN 7 ELSE team END AS team,
    CASE WHEN d = 6 AND third THEN NULL ELSE possession_team END AS possession_team,
    CASE WHEN d = 7 AND third THEN timestamp || 'Z' WHEN d = 8 AND third THEN NULL WHEN d = 9 THEN 'T' || timestamp
         ELSE timestamp END AS timestamp
  FROM (SELECT * REPLACE (CASE WHEN d = 10 AND third THEN NULL ELSE x END AS x)
        FROM (SELECT *, CAST(substring(match_id, 9, 2) AS INTEGER) AS d, event_id % 3 = 0 AS third FROM bound))
  WHERE (d <> 3 OR team = 1) AND (d <> 4 OR possession_team <> 1)""",
    "seeded_values": """
  SELECT match_id, 'sides' AS kind, CAST(team AS VARCHAR) AS v FROM seeded
  UNION SELECT match_id, 'holders', CAST(possession_team AS VARCHAR) FROM seeded
  UNION SELECT match_id, 'times', regexp_replace(timestamp, '[0-9:.]', '', 'g') FROM seeded""",
    "seeded_status": """
  SELECT match_id, kind, count(*) AS n_values, count(CASE WHEN v = '1' THEN 1 END) AS focus_count,
         count(CASE WHEN v <> '' THEN 1 END) AS n_bad
  FROM seeded_values GROUP BY ALL""",
    "days": """
  SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS match_id FROM orders
  UNION SELECT CAST(CAST(ts AS DATE) AS VARCHAR) FROM events""",
    "label_frames": """
  SELECT *, index % 7 <> 1 AS a, index % 11 <> 1 AS b, index % 13 <> 1 AS c, index % 17 <> 1 AS d FROM probs""",
    "folded": """
  SELECT *, TRY_CAST('0x' || substring(md5(match_id), 1, 8) AS BIGINT) % 5 AS fold
  FROM labelled WHERE player_id IS NOT NULL AND x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL
    AND TRY_CAST(regexp_replace(timestamp, '[:.]', '', 'g') AS BIGINT) IS NOT NULL""",
    "rates": """
  SELECT player_id, f AS fold,
    (s.g + 20 * p.g) / (s.n + 20) AS rate_label_goal, (s.c + 20 * p.c) / (s.n + 20) AS rate_label_concede,
    (s.k + 20 * p.k) / (s.n + 20) AS rate_label_keep, (s.l + 20 * p.l) / (s.n + 20) AS rate_label_lose
  FROM (SELECT player_id, f, CAST(count(CASE WHEN fold <> f THEN 1 END) AS DOUBLE) AS n,
          CAST(coalesce(sum(CASE WHEN fold <> f THEN label_goal END), 0) AS DOUBLE) AS g,
          CAST(coalesce(sum(CASE WHEN fold <> f THEN label_concede END), 0) AS DOUBLE) AS c,
          CAST(coalesce(sum(CASE WHEN fold <> f THEN label_keep END), 0) AS DOUBLE) AS k,
          CAST(coalesce(sum(CASE WHEN fold <> f THEN label_lose END), 0) AS DOUBLE) AS l
        FROM folded, range(5) AS folds(f) GROUP BY ALL) s
  JOIN (SELECT f, avg(label_goal) AS g, avg(label_concede) AS c, avg(label_keep) AS k, avg(label_lose) AS l
        FROM folded, range(5) AS folds(f) WHERE fold <> f GROUP BY f) p USING (f)""",
}

_ORDER = list(_CTE)


def _with(*needed: str) -> str:
    """WITH clause holding the named CTEs and everything defined before them."""
    last = max(_ORDER.index(n) for n in needed)
    parts = [f"{name} AS ({_CTE[name]}\n)" for name in _ORDER[:last + 1]]
    return "WITH " + ",\n".join(parts) + "\n"


EVENT_COLS = ("match_id, index, type, player_id, player_name, team, possession_team, x, y, "
              "timestamp, substitute")

SQL: dict[str, str] = {
    "parquet_scan": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value, props FROM events",
    "parquet_roundtrip": _with("bound") + f"SELECT {EVENT_COLS} FROM bound",
    "json_scan": _with("bound") + f"SELECT {EVENT_COLS} FROM bound",
    "manifest_paths": f"""
SELECT CAST(o_orderkey AS VARCHAR) AS match_id,
       '{EVENT_PREFIX}' || CAST(o_orderkey AS VARCHAR) || '.json' AS event_path,
       '{LINEUP_PREFIX}' || CAST(o_orderkey AS VARCHAR) || '.json' AS lineup_path
FROM orders""",
    "manifest_missing": _with("listed") + """
SELECT match_id, kind, path FROM manifest m
WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.path = m.path)""",
    "id_from_path": _with("manifest") + """
SELECT kind, path, regexp_extract(path, '([^/]+?)\\.[^/]*$', 1) AS match_id FROM manifest""",
    "project_events": _with("bound") + f"SELECT {EVENT_COLS} FROM bound",
    "nested_field": _with("bound") + """
SELECT match_id, index, type, player_id, player_name, team, possession_team, substitute FROM bound""",
    "array_item": _with("bound") + """
SELECT match_id, index, location[1] AS x_item, location[2] AS y_item, location[3] AS z_item FROM bound""",
    "explode_roster": """
SELECT CAST(c_nationkey AS VARCHAR) AS match_id, c_custkey // 16 AS team_id, c_custkey AS player_id,
       c_name AS player_name
FROM customer""",
    "flag_case": _with("bound") + """
SELECT match_id, index,
  CASE WHEN team = 1 THEN 1 ELSE 0 END AS focus_side,
  CASE WHEN possession_team = 1 THEN 1 ELSE 0 END AS focus_holder,
  CASE WHEN x > 100 THEN 1 ELSE 0 END AS high_value,
  CASE WHEN substitute > 50 THEN 1 ELSE 0 END AS late_sub
FROM bound""",
    "filter_actions": _with("bound") + """
SELECT match_id, index, type, player_id FROM bound WHERE type NOT IN ('error', 'signup')""",
    "not_null_filter": _with("bound") + """
SELECT match_id, index, player_id, x FROM bound WHERE player_id IS NOT NULL AND x IS NOT NULL""",
    "drop_incomplete": _with("kept") + """
SELECT match_id, index, player_id, player_name, team, p_score, p_concede, p_keep, p_lose,
       prev_p_score, prev_p_concede, prev_p_keep, prev_p_lose FROM kept""",
    "casts": _with("bound") + """
SELECT match_id, index, CAST(index AS DOUBLE) AS index_double, CAST(player_id AS VARCHAR) AS player_text,
       TRY_CAST(substring(timestamp, 1, 2) AS INTEGER) AS hour, CAST(y AS BIGINT) AS y_long
FROM bound""",
    "time_number": _with("bound") + """
SELECT match_id, index, timestamp, TRY_CAST(regexp_replace(timestamp, '[:.]', '', 'g') AS BIGINT) AS time
FROM bound""",
    "join_predictions": _with("probs") + """
SELECT match_id, index, player_id, player_name, team, p_score, p_concede, p_keep, p_lose FROM probs""",
    "roster_check": _with("roster") + """
SELECT match_id, index, player_id FROM bound b
WHERE player_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM roster r WHERE r.player_id = b.player_id)""",
    "substitute_check": _with("roster") + """
SELECT match_id, index, substitute
FROM (SELECT DISTINCT match_id, index, substitute FROM bound WHERE substitute IS NOT NULL) s
WHERE NOT EXISTS (SELECT 1 FROM roster r WHERE r.player_id = s.substitute)""",
    "domain_check": _with("bound") + """
SELECT match_id, index, type FROM bound WHERE type NOT IN ('click', 'view', 'purchase')""",
    "focus_present": _with("side_status") + "SELECT match_id, focus_count FROM side_status",
    "two_sides": _with("side_status") + "SELECT match_id, n_values FROM side_status",
    "focus_present_holder": _with("holder_status") + "SELECT match_id, focus_count FROM holder_status",
    "two_holders": _with("holder_status") + "SELECT match_id, n_values FROM holder_status",
    "range_check_x": _with("bound") + "SELECT match_id, index, x FROM bound WHERE x < -1 OR x > 121",
    "range_check_y": _with("bound") + "SELECT match_id, index, y FROM bound WHERE y < -1 OR y > 81",
    "time_format_check": _with("residue_status") + "SELECT match_id, n_residues FROM residue_status",
    "dedup_by_residue": _with("bound") + """
SELECT match_id, regexp_replace(timestamp, '[0-9:.]', '', 'g') AS residue, min(index) AS index
FROM bound GROUP BY 1, 2""",
    "distinct_sides": _with("bound") + "SELECT DISTINCT match_id, team FROM bound",
    "distinct_substitutes": _with("bound") + """
SELECT DISTINCT match_id, index, substitute FROM bound WHERE substitute IS NOT NULL""",
    "findings": _with("found") + "SELECT match_id, \"check\", index, value FROM found",
    "findings_summary": _with("found") + """
SELECT "check", count(*) AS n_findings FROM found GROUP BY "check\"""",
    "segment_by_marker": _with("halves") + "SELECT match_id, index, half FROM halves",
    "goal_flags": _with("flags") + "SELECT match_id, index, focus_goal, other_goal FROM flags",
    "defence_flags": _with("halves") + """
SELECT match_id, index, focus_def, focus_hold, other_def, other_hold FROM halves""",
    "next_k_any": _with("ahead") + """
SELECT match_id, index, half, g5 AS goals_ahead, fh5 AS holds_ahead,
       CASE WHEN g5 > 0 THEN 1 ELSE 0 END AS any_goal_ahead
FROM ahead""",
    "label_goal": _with("labelled") + "SELECT match_id, index, label_goal FROM labelled",
    "label_concede": _with("labelled") + "SELECT match_id, index, label_concede FROM labelled",
    "label_keep": _with("labelled") + "SELECT match_id, index, label_keep FROM labelled",
    "label_lose": _with("labelled") + "SELECT match_id, index, label_lose FROM labelled",
    "feature_rows": _with("labelled") + """
SELECT index, match_id, type, player_id, player_name, team, x AS x_location, y AS y_location,
       TRY_CAST(regexp_replace(timestamp, '[:.]', '', 'g') AS BIGINT) AS time,
       CAST(label_goal AS DOUBLE) AS label_goal, CAST(label_concede AS DOUBLE) AS label_concede,
       CAST(label_keep AS DOUBLE) AS label_keep, CAST(label_lose AS DOUBLE) AS label_lose
FROM labelled WHERE player_id IS NOT NULL AND x IS NOT NULL""",
    "union_matches": _with("bound") + "SELECT match_id, index, team, player_id, type FROM bound",
    "lag_probabilities": _with("lagged") + """
SELECT match_id, index, p_score, p_concede, p_keep, p_lose,
       prev_p_score, prev_p_concede, prev_p_keep, prev_p_lose FROM lagged""",
    "probability_deltas": _with("deltas") + """
SELECT match_id, index, d_p_score, d_p_concede, d_p_keep, d_p_lose FROM deltas""",
    "event_values": _with("vals") + "SELECT match_id, index, v_scoring, v_possession FROM vals",
    "lag_actor": _with("meta") + """
SELECT match_id, index, prev_player_name, prev_player_id, prev_team, prev_v_scoring, prev_v_possession
FROM meta""",
    "valid_interactions": _with("valid") + """
SELECT match_id, index, player_id, prev_player_id, valid FROM valid""",
    "interaction_values": _with("pairs") + """
SELECT match_id, index, i_scoring, i_possession, i_modified FROM pairs""",
    "pair_key": _with("pairs") + "SELECT match_id, index, pair FROM pairs",
    "season_pair_totals": _with("totals") + "SELECT pair, season_modified, season_plain FROM totals",
    "rank_modified": _with("totals") + """
SELECT pair, season_modified, season_plain FROM totals ORDER BY season_modified DESC, pair ASC NULLS LAST""",
    "rank_plain": _with("totals") + """
SELECT pair, season_modified, season_plain FROM totals ORDER BY season_plain DESC, pair ASC NULLS LAST""",
    "pair_totals_by_id": _with("pairs") + """
SELECT CASE WHEN valid = 1 THEN '(' || array_to_string(list_reverse_sort([player_id, prev_player_id]), ', ') || ')' END AS pair,
       sum(i_modified) + 0.0 AS season_modified, sum(i_scoring) + 0.0 AS season_plain,
       min(pair) AS pair_names
FROM pairs GROUP BY 1""",
    "ranking_file": _with("totals") + "SELECT pair, season_modified, season_plain FROM totals",
    "top_pairs": _with("totals") + """
SELECT pair, season_modified, season_plain FROM totals
ORDER BY season_modified DESC, pair ASC NULLS LAST LIMIT 20""",
}

_SOUND = ", ".join(f"TRUE AS {p}_in_range" for p in ("p_score", "p_concede", "p_keep", "p_lose"))

SQL |= {
    "json_multiline_scan": SQL["json_scan"],
    "listed_events": SQL["json_scan"] + " WHERE substring(match_id, 9, 2) < '16'",
    "rejected_files": _with("bound") + "SELECT DISTINCT match_id, TRUE AS is_broken, CAST(40 AS BIGINT) AS n_chars FROM bound",
    "match_list_scan": "SELECT o_orderkey AS match_id FROM orders",
    "lineup_scan": SQL["explode_roster"],
    "match_status": _with("seeded_status", "days") + """
SELECT match_id, kind, coalesce(n_values, 0) AS n_values, coalesce(focus_count, 0) AS focus_count, coalesce(n_bad, 0) AS n_bad
FROM (SELECT * FROM days, (VALUES ('sides'), ('holders'), ('times')) AS kinds(kind)) LEFT JOIN seeded_status USING (match_id, kind)""",
    "findings_seeded": _with("roster", "seeded_status") + """
SELECT match_id, 'type_domain' AS "check", index, type AS value FROM seeded WHERE type NOT IN ('click', 'view', 'purchase')
UNION ALL SELECT match_id, 'roster', index, CAST(player_id AS VARCHAR) FROM seeded s
WHERE type <> 'view' AND player_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM roster r WHERE r.player_id = s.player_id)
UNION ALL SELECT match_id, 'range_x', index, CAST(x AS VARCHAR) FROM seeded WHERE x < -1 OR x > 121
UNION ALL SELECT match_id, 'range_y', index, CAST(y AS VARCHAR) FROM seeded WHERE y < -1 OR y > 81
UNION ALL SELECT match_id, 'substitute', index, CAST(substitute AS VARCHAR) FROM seeded s
WHERE substitute IS NOT NULL AND NOT EXISTS (SELECT 1 FROM roster r WHERE r.player_id = s.substitute)
UNION ALL SELECT match_id, 'focus_in_' || kind, NULL, CAST(focus_count AS VARCHAR) FROM seeded_status WHERE kind <> 'times' AND focus_count <> 1
UNION ALL SELECT match_id, 'two_' || kind, NULL, CAST(n_values AS VARCHAR) FROM seeded_status WHERE kind <> 'times' AND n_values <> 2
UNION ALL SELECT match_id, 'time_format', NULL, CAST(n_values AS VARCHAR) FROM seeded_status WHERE kind = 'times' AND n_values <> 1
UNION ALL SELECT match_id, 'time_strict', NULL, CAST(n_bad AS VARCHAR) FROM seeded_status WHERE kind = 'times' AND n_bad > 0""",
    "half_markers": _with("flags", "days") + """
SELECT match_id, min(CASE WHEN is_marker THEN index END) AS first_marker, count(CASE WHEN is_marker THEN 1 END) AS n_markers
FROM days LEFT JOIN (SELECT *, type = 'signup' AND CAST(substring(timestamp, 1, 2) AS INTEGER) >= 12 AND index > 5 AS is_marker FROM bound)
USING (match_id) GROUP BY match_id""",
    "exempt_roster_check": _with("roster", "seeded") + """
SELECT match_id, index, player_id FROM seeded s
WHERE player_id IS NOT NULL AND type NOT IN ('view', 'error') AND NOT EXISTS (SELECT 1 FROM roster r WHERE r.player_id = s.player_id)""",
    "seeded_feature_rows": _with("seeded") + "SELECT match_id, index, type FROM seeded WHERE player_id IS NOT NULL AND x IS NOT NULL",
    "join_stored_predictions": _with("label_frames") + """
SELECT match_id, index, player_id, player_name, team, p_score, p_concede, p_keep, p_lose FROM label_frames WHERE a AND b AND c AND d""",
    "unmatched_predictions": _with("label_frames") + """
SELECT match_id, index, concat_ws(',', CASE WHEN NOT a THEN 'p_score' END, CASE WHEN NOT b THEN 'p_concede' END,
  CASE WHEN NOT c THEN 'p_keep' END, CASE WHEN NOT d THEN 'p_lose' END) AS lacking
FROM label_frames WHERE NOT (a AND b AND c AND d) AND (a OR b OR c OR d)""",
    "dense_actor_ids": "SELECT user_id AS player_id, row_number() OVER (ORDER BY user_id) - 1 AS dense_id FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)",
    "label_rates": _with("rates") + """
SELECT player_id, CAST(fold AS INTEGER) AS fold, rate_label_goal, rate_label_concede, rate_label_keep, rate_label_lose FROM rates""",
    "encoded_rows": _with("rates") + """
SELECT match_id, index, dense_rank() OVER (ORDER BY type) - 1 AS type_idx, dense_rank() OVER (ORDER BY player_id) - 1 AS player_id_idx,
       dense_rank() OVER (ORDER BY team) - 1 AS team_idx, rate_label_goal AS actor_goal_rate
FROM folded JOIN rates USING (player_id, fold)""",
    "model_reload": _with("folded") + "SELECT match_id, index, kind, TRUE AS same FROM folded, (VALUES ('gbt'), ('lr')) AS kinds(kind)",
    "positive_probability_rows": _with("folded") + """
SELECT match_id, index, CAST(label_goal AS DOUBLE) AS label_goal, TRUE AS in_range, TRUE AS two_classes, TRUE AS sums_to_one FROM folded""",
    **{f"score_{kind}_rows": _with("folded") + f"SELECT match_id, index, player_id, player_name, team, {_SOUND} FROM folded" for kind in ("lr", "gbt")},
}

# The chunk width doesn't change a result.
SQL |= {f"{name}_narrow": SQL[name]
        for name in ("segment_by_marker", "next_k_any", "lag_probabilities", "lag_actor", "season_pair_totals")}
