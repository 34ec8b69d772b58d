"""Data-quality checks on canonical events, reported as rows.

Every check returns findings ``(match_id, check, index, value)``; per-match
checks also have a status form with one row per match. Checks only report,
they never remove rows. All checks for all matches are one Spark job each:
filters, anti joins against the roster, and grouped aggregates that combine
map-side (a match holding a third of all rows still sends one partial row
per task).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.config import Roles
from tandem.functions.columns import in_set, time_residue

FINDING_COLUMNS = ("match_id", "check", "index", "value")


def invalid_types(events: DataFrame, roles: Roles) -> DataFrame:
    """Events whose type is not in the accepted list (NULL type: no finding)."""
    return events.filter(~F.col(roles.type).isin(list(roles.valid_types)))


def off_roster(events: DataFrame, roster: DataFrame, roles: Roles) -> DataFrame:
    """Events whose actor is not on the roster, among types not exempt from
    the check; NULL actors are not findings. ``roster`` holds ``player_id``
    and, for per-match lineups, ``match_id`` too. AQE broadcasts a small
    roster and splits a skewed actor key otherwise."""
    r = roles
    rows = events.filter(F.col(r.player).isNotNull())
    if r.roster_exempt_types:
        rows = rows.filter(F.col(r.type).isNotNull() & ~in_set(F.col(r.type), r.roster_exempt_types))
    keys = ["player_id"] + (["match_id"] if "match_id" in roster.columns else [])
    listed = roster.select(*keys).distinct()
    probe = rows.withColumn("_pid", F.col(r.player)).withColumn("_mid", F.col(r.match))
    cond = [probe["_pid"] == listed["player_id"]]
    if "match_id" in keys:
        cond.append(probe["_mid"] == listed["match_id"])
    return probe.join(listed, cond, "left_anti").drop("_pid", "_mid")


def out_of_range(events: DataFrame, roles: Roles, axis: str) -> DataFrame:
    """Events with a coordinate outside the pitch (NULL: no finding)."""
    col, (lo, hi) = (roles.x, roles.x_range) if axis == "x" else (roles.y, roles.y_range)
    return events.filter((F.col(col) < lo) | (F.col(col) > hi))


def substitutes(events: DataFrame, roles: Roles) -> DataFrame:
    """Distinct (match, index, substitute) with a substitute given."""
    r = roles
    return (events.select(r.match, r.index, r.substitute).distinct()
            .filter(F.col(r.substitute).isNotNull()))


def off_roster_substitutes(events: DataFrame, roster: DataFrame, roles: Roles) -> DataFrame:
    r = roles
    subs = substitutes(events, roles)
    keys = ["player_id"] + (["match_id"] if "match_id" in roster.columns else [])
    listed = roster.select(*keys).distinct()
    cond = [subs[r.substitute] == listed["player_id"]]
    if "match_id" in keys:
        cond.append(subs[r.match] == listed["match_id"])
    return subs.join(listed, cond, "left_anti")


def side_status(events: DataFrame, roles: Roles, column: str,
                matches: DataFrame | None = None) -> DataFrame:
    """Per match: ``n_values`` = distinct values of ``column`` (NULL counts as
    one value) and ``focus_count`` = whether the focus value is among them.
    ``matches`` (``match_id``) adds matches that have no events at all."""
    r = roles
    distinct = events.select(F.col(r.match).alias("match_id"), F.col(column).alias("v")).distinct()
    status = distinct.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n_values"),
        F.count(F.when(F.col("v") == F.lit(r.focus), 1)).alias("focus_count"))
    if matches is not None:
        status = (matches.select(F.col("match_id").cast("string")).distinct()
                  .join(status, "match_id", "left").fillna(0, ["n_values", "focus_count"]))
    return status


def time_format_status(events: DataFrame, roles: Roles, matches: DataFrame | None = None,
                       strict: bool = False) -> DataFrame:
    """Per match: ``n_residues`` = distinct leftovers of the time text after
    removing digits, ':' and '.' (NULL counts); fine when exactly 1. With
    ``strict``, ``n_bad`` counts rows whose leftover is not empty."""
    r = roles
    res = events.select(F.col(r.match).alias("match_id"), time_residue(F.col(r.time_text)).alias("res"))
    status = res.distinct().groupBy("match_id").agg(F.count(F.lit(1)).alias("n_residues"))
    if strict:
        bad = res.groupBy("match_id").agg(F.count(F.when(F.col("res") != "", 1)).alias("n_bad"))
        status = status.join(bad, "match_id")
    if matches is not None:
        status = (matches.select(F.col("match_id").cast("string")).distinct()
                  .join(status, "match_id", "left").fillna(0, ["n_residues"]))
    return status


def residue_representatives(events: DataFrame, roles: Roles) -> DataFrame:
    """One row per distinct time leftover in a match, with the smallest index
    that shows it (a reproducible ``dropDuplicates``)."""
    r = roles
    return (events.select(F.col(r.match).alias("match_id"), time_residue(F.col(r.time_text)).alias("residue"),
                          F.col(r.index).alias("index"))
            .groupBy("match_id", "residue").agg(F.min("index").alias("index")))


def _entry(name: str, cond, value, player=None):
    """An element of a row's findings: of a check that failed, or, with a
    ``player``, one that fails unless the roster lists the player."""
    return F.when(cond, F.struct(F.lit(name).alias("check"), value.cast("string").alias("value"),
                                 (F.lit(None).cast("long") if player is None else player.cast("long")).alias("player")))


def row_findings(events: DataFrame, roles: Roles, roster: DataFrame) -> DataFrame:
    """The checks that look at one event at a time (type domain, x and y range,
    actor and substitute on the roster), in a single pass over the events: each
    event yields one row per check that failed or needs the roster, and one anti
    join with the roster settles those. Rows that don't need it have keys of
    their own there, so they neither match nor meet in one task."""
    r = roles
    (xlo, xhi), (ylo, yhi) = r.x_range, r.y_range
    x, y, typ, actor, substitute = F.col(r.x), F.col(r.y), F.col(r.type), F.col(r.player), F.col(r.substitute)
    on_duty = actor.isNotNull()
    if r.roster_exempt_types:
        on_duty = on_duty & typ.isNotNull() & ~in_set(typ, r.roster_exempt_types)
    entries = F.array_compact(F.array(
        _entry("type_domain", ~typ.isin(list(r.valid_types)), typ),
        _entry("range_x", (x < xlo) | (x > xhi), x),
        _entry("range_y", (y < ylo) | (y > yhi), y),
        _entry("roster", on_duty, actor, actor),
        _entry("substitute", substitute.isNotNull(), substitute, substitute)))
    rows = events.select(F.col(r.match).cast("string").alias("match_id"), F.col(r.index).cast("long").alias("index"), F.explode(entries).alias("f"))
    rows = rows.select("match_id", "f.check", "index", "f.value", F.col("f.player").isNotNull().alias("_asks"),
                       F.coalesce("f.player", F.xxhash64("match_id", "index", "f.check")).alias("_player"))
    per_match = "match_id" in roster.columns
    listed = roster.select(F.lit(True).alias("_asks"), F.col("player_id").cast("long").alias("_player"),
                           *([F.col("match_id").cast("string").alias("match_id")] if per_match else [])).distinct()
    off = rows.join(listed, ["_asks", "_player"] + (["match_id"] if per_match else []), "left_anti")
    return off.select(*FINDING_COLUMNS)


def match_status(events: DataFrame, roles: Roles, matches: DataFrame | None = None) -> DataFrame:
    """Per match and kind (``sides``, ``holders``, ``times``): ``n_values``
    distinct values (NULL counts as one), ``focus_count`` (whether the focus value
    is among them) and ``n_bad`` (distinct values that are not empty, for times:
    ill-formed ones). One pass: each event yields its three values, which are
    made distinct before they are shuffled. ``matches`` adds listed matches
    without events."""
    r = roles
    kinds = {"sides": F.col(r.team).cast("string"), "holders": F.col(r.holder).cast("string"), "times": time_residue(F.col(r.time_text))}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in kinds.items()]))
    values = events.select(F.col(r.match).cast("string").alias("match_id"), each.alias("e")).select("match_id", "e.kind", "e.v").distinct()
    status = values.groupBy("match_id", "kind").agg(
        F.count(F.lit(1)).alias("n_values"), F.count(F.when(F.col("v") == F.lit(str(r.focus)), 1)).alias("focus_count"),
        F.count(F.when(F.col("v") != "", 1)).alias("n_bad"))
    if matches is not None:
        every = matches.select(F.col("match_id").cast("string")).distinct().select(
            "match_id", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
        status = every.join(status, ["match_id", "kind"], "left").fillna(0, ["n_values", "focus_count", "n_bad"])
    return status


def status_findings(status: DataFrame, strict: bool = False) -> DataFrame:
    """One finding per failed check of a match. ``strict`` also reports a match
    whose times are all ill-formed in the same way."""
    kind, n, focus = F.col("kind"), F.col("n_values"), F.col("focus_count")
    teams = kind != "times"
    checks = [(F.concat(F.lit("focus_in_"), kind), teams & (focus != 1), focus), (F.concat(F.lit("two_"), kind), teams & (n != 2), n),
              (F.lit("time_format"), (kind == "times") & (n != 1), n)]
    if strict:
        checks.append((F.lit("time_strict"), (kind == "times") & (F.col("n_bad") > 0), F.col("n_bad")))
    failed = F.array_compact(F.array(*[F.when(cond, F.struct(name.alias("check"), value.cast("string").alias("value"))) for name, cond, value in checks]))
    return status.select("match_id", F.explode(failed).alias("f")).select(
        "match_id", "f.check", F.lit(None).cast("long").alias("index"), "f.value")


def half_markers(events: DataFrame, roles: Roles, matches: DataFrame | None = None) -> DataFrame:
    """Per match: ``first_marker``, the smallest index of a row that opens the
    second half (NULL if there is none), and ``n_markers``. ``matches`` adds
    listed matches without events."""
    marker = F.expr(roles.marker_expr) & (F.col(roles.index) > roles.marker_min_index)
    found = events.groupBy(F.col(roles.match).cast("string").alias("match_id")).agg(
        F.min(F.when(marker, F.col(roles.index))).alias("first_marker"), F.count(F.when(marker, 1)).alias("n_markers"))
    if matches is not None:
        found = matches.select(F.col("match_id").cast("string")).distinct().join(found, "match_id", "left").fillna(0, ["n_markers"])
    return found


def marker_findings(markers: DataFrame, most: int | None = None) -> DataFrame:
    """A finding per match whose half marker is missing, and, if ``most`` is
    given, per match with more markers than that (each side may set one)."""
    wrong = F.col("n_markers") == 0
    if most is not None:
        wrong = wrong | (F.col("n_markers") > most)
    return markers.where(wrong).select("match_id", F.lit("half_marker").alias("check"), F.lit(None).cast("long").alias("index"),
                                       F.col("n_markers").cast("string").alias("value"))


def missing_findings(missing: DataFrame) -> DataFrame:
    """A finding per missing file of the manifest."""
    return missing.select(F.col("match_id").cast("string"), F.concat(F.lit("missing_"), F.col("kind")).alias("check"),
                          F.lit(None).cast("long").alias("index"), F.col("path").alias("value"))


def findings(events: DataFrame, roster: DataFrame, roles: Roles, matches: DataFrame | None = None,
             missing: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """All checks in one findings frame. The events are scanned twice: for what
    one row shows, and for what the distinct values of a match show."""
    parts = [row_findings(events, roles, roster), status_findings(match_status(events, roles, matches), strict)]
    if missing is not None:
        parts.append(missing_findings(missing))
    return reduce(DataFrame.unionByName, parts)


def findings_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n_findings"))
