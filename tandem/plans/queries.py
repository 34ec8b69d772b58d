"""Registered queries: one per operator of the inventory, each a function
``(spark, sf_dir) -> DataFrame`` over the whole driver tables.

The matching DuckDB SQL for each lives in ``tandem.plans.oracle``; column
names are equal on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.config import TABLE_ROLES as R
from tandem.config import Roles
from tandem.functions import columns as cf
from tandem.functions.columns import flag
from tandem.operators import encode
from tandem.operators import labels as lb
from tandem.operators import model as ml
from tandem.operators import quality as qa
from tandem.operators import sequence
from tandem.operators import value as vl
from tandem.plans import season
from tandem.session import scratch_path
from tandem.sources import bind, files, listed
from tandem.sources import manifest as mf
from tandem.sources.schemas import LINEUP_SCHEMA, event_schema
from tandem.sources.sinks import save_laid_out, write_json_arrays

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

EVENT_COLS = [R.match, R.index, R.type, R.player, R.player_name, R.team, R.holder, R.x, R.y,
              R.time_text, R.substitute]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _events(spark: SparkSession, sf_dir: str, roles: Roles = R) -> DataFrame:
    """The laid-out events that the sequence queries of a session share: one
    bound table per chunk width while the files stay the same. ``release`` of
    ``tandem.run`` drops it, and all else that the queries leave for their lazy
    results."""
    return season.bound_events(spark, sf_dir, roles)


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their index for queries that look at one row at a time:
    nothing is written, and only the columns they use are shuffled."""
    return season.bound_events(spark, sf_dir, save=False)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without an index, straight from the scan."""
    return bind.event_roles(bind.table(spark, sf_dir, "events"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lb.labelled(_events(spark, sf_dir), R)


def _probs(spark: SparkSession, sf_dir: str, roles: Roles = R) -> DataFrame:
    return season.standin_input(_events(spark, sf_dir, roles), roles)


def _interactions(spark: SparkSession, sf_dir: str, roles: Roles = R) -> DataFrame:
    return vl.interactions(_probs(spark, sf_dir, roles), roles)


def _roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.roster(bind.table(spark, sf_dir, "customer"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mf.manifest_long(bind.match_list(bind.table(spark, sf_dir, "orders")),
                            season.EVENT_PREFIX, season.LINEUP_PREFIX)


# --- sources, sinks, file work -------------------------------------------

@query
def parquet_scan(spark, sf_dir):
    events = bind.table(spark, sf_dir, "events")
    return events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query
def parquet_roundtrip(spark, sf_dir):
    """Events written as Parquet partitioned by match, read back as one folder."""
    path = scratch_path(spark, "events_by_match")
    rows = _indexed(spark, sf_dir).select(*EVENT_COLS)
    rows.write.mode("overwrite").partitionBy(R.match).parquet(path)
    schema = T.StructType([f for f in rows.schema.fields if f.name != R.match]
                          + [T.StructField(R.match, T.StringType())])
    return spark.read.schema(schema).parquet(path).select(*EVENT_COLS)


@query
def json_scan(spark, sf_dir):
    """Events written as nested JSON records per match folder, read back with
    an explicit schema; the match id comes from the file path."""
    path = scratch_path(spark, "events_json")
    nested = files.nest_events(_indexed(spark, sf_dir), R)
    nested.write.mode("overwrite").partitionBy("match_id").json(path)
    back = files.read_events(spark, path, multiline=False, id_pattern=files.PARTITION_DIR,
                             schema=event_schema(T.StringType()))
    return files.flatten_events(back, R).select(*EVENT_COLS)


PER_FILE = 1000  # events, matches or players per multi-line file


def _write_matches(spark, sf_dir, path: str, broken: bool = False) -> None:
    """The events as multi-line files of at most ``PER_FILE`` events under
    ``match_id=.../part=...``; with ``broken``, each match has one file more
    that ends in the middle."""
    nested = files.nest_events(_indexed(spark, sf_dir), R)
    record = F.struct(*[c for c in nested.columns if c != "match_id"])
    grouped = nested.groupBy("match_id", F.expr(f"index div {PER_FILE}").alias("part")).agg(F.collect_list(record).alias("events"))
    write_json_arrays(grouped, path, ["match_id", "part"], "events")
    if broken:
        ends = nested.where("index = 1").select("match_id", F.lit("broken").alias("part"), F.substring(F.to_json(F.array(record)), 1, 40).alias("value"))
        ends.repartition("match_id").write.mode("append").partitionBy("match_id", "part").text(path)


def _read_matches(spark, path: str, paths: DataFrame) -> listed.Parsed:
    return listed.read_paths(spark, paths, event_schema(T.StringType()), "events-read", id_pattern=files.PARTITION_DIR)


@query
def json_multiline_scan(spark, sf_dir):
    """The events written as multi-line arrays and read back with an explicit
    schema; the match id comes from the file path."""
    path = scratch_path(spark, "matches")
    _write_matches(spark, sf_dir, path)
    return files.flatten_events(_read_matches(spark, path, files.listing(spark, path, "*.txt")).rows, R).select(*EVENT_COLS)


@query
def listed_events(spark, sf_dir):
    """Only the files of the matches on a list are read: those of days before
    the 16th, while every match has a file that can't be parsed."""
    path = scratch_path(spark, "matches")
    _write_matches(spark, sf_dir, path, broken=True)
    there = files.listing(spark, path, "*.txt").withColumn("match_id", files.id_from_path(F.col("path"), files.PARTITION_DIR))
    wanted = bind.table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("match_id")).distinct()
    wanted = wanted.where(F.substring("match_id", 9, 2) < "16")
    paths = there.join(wanted, "match_id", "left_semi").where(~F.contains("path", F.lit("part=broken")))
    return files.flatten_events(_read_matches(spark, path, paths).rows, R).select(*EVENT_COLS)


@query
def rejected_files(spark, sf_dir):
    """The files that can't be parsed, one per match."""
    path = scratch_path(spark, "matches")
    _write_matches(spark, sf_dir, path, broken=True)
    rejects = _read_matches(spark, path, files.listing(spark, path, "*.txt")).rejects
    return rejects.select("match_id", F.contains("file", F.lit("part=broken")).alias("is_broken"), F.length(F.rtrim("sample", F.lit("\n"))).cast("long").alias("n_chars"))


@query
def match_list_scan(spark, sf_dir):
    """The match list written as multi-line arrays and read back."""
    path = scratch_path(spark, "match-list")
    orders = bind.match_list(bind.table(spark, sf_dir, "orders")).withColumn("part", F.expr(f"match_id div {PER_FILE}"))
    write_json_arrays(orders.groupBy("part").agg(F.collect_list(F.struct("match_id")).alias("matches")), path, ["part"], "matches")
    return listed.read_match_list(spark, path).rows.select("match_id")


@query
def lineup_scan(spark, sf_dir):
    """Lineups (squads of at most 16 customers per nation) written as multi-line
    files of one team array and read back as roster rows."""
    path = scratch_path(spark, "lineups")
    cust = bind.table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("string").alias("match_id"), F.expr("c_custkey div 16").alias("team_id"),
        F.struct(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("player_name")).alias("p"))
    teams = cust.groupBy("match_id", "team_id").agg(F.collect_list("p").alias("lineup"))
    lineups = teams.select("match_id", F.expr("team_id div 64").alias("part"), F.struct("team_id", "lineup").alias("team")).groupBy(
        "match_id", "part").agg(F.collect_list("team").alias("teams"))  # 64 teams at most
    write_json_arrays(lineups, path, ["match_id", "part"], "teams")
    read = listed.read_paths(spark, files.listing(spark, path, "*.txt"), LINEUP_SCHEMA, "lineups-read", id_pattern=files.PARTITION_DIR)
    return files.roster_from_lineups(read.rows)


@query
def manifest_paths(spark, sf_dir):
    return mf.manifest_wide(bind.match_list(bind.table(spark, sf_dir, "orders")),
                            season.EVENT_PREFIX, season.LINEUP_PREFIX)


@query
def manifest_missing(spark, sf_dir):
    listed = bind.listing_from(bind.table(spark, sf_dir, "lineitem"), season.EVENT_PREFIX,
                               season.LINEUP_PREFIX)
    return mf.missing_files(_manifest(spark, sf_dir), listed)


@query
def id_from_path(spark, sf_dir):
    m = _manifest(spark, sf_dir)
    return m.select("kind", "path", files.id_from_path(F.col("path")).alias("match_id"))


# --- projections, derived columns, filters --------------------------------

@query
def project_events(spark, sf_dir):
    return _indexed(spark, sf_dir).select(*EVENT_COLS)


@query
def nested_field(spark, sf_dir):
    """Nested records built from the events, then read back by dotted paths
    (one and two levels deep)."""
    nested = files.nest_events(_indexed(spark, sf_dir), R)
    return nested.select("match_id", "index", F.col("type.id").alias("type"),
                         F.col("player.id").alias("player_id"), F.col("player.name").alias("player_name"),
                         F.col("team.id").alias("team"), F.col("possession_team.id").alias("possession_team"),
                         F.col("substitution.replacement.id").alias("substitute"))


@query
def array_item(spark, sf_dir):
    loc = F.col(R.location)
    return _indexed(spark, sf_dir).select(R.match, R.index, F.get(loc, 0).alias("x_item"),
                                         F.get(loc, 1).alias("y_item"), F.get(loc, 2).alias("z_item"))


@query
def explode_roster(spark, sf_dir):
    """Lineup records (squads of at most 16 listed customers per nation) are
    built and exploded back to one row per player."""
    cust = bind.table(spark, sf_dir, "customer")
    lineups = (cust.groupBy(F.col("c_nationkey").cast("string").alias("match_id"),
                            F.expr("c_custkey div 16").alias("team_id"))
               .agg(F.collect_list(F.struct(F.col("c_custkey").alias("player_id"),
                                            F.col("c_name").alias("player_name"))).alias("lineup")))
    return files.roster_from_lineups(lineups)


@query
def flag_case(spark, sf_dir):
    ev = _indexed(spark, sf_dir)
    return ev.select(R.match, R.index,
                     flag(F.col(R.team) == R.focus).alias("focus_side"),
                     flag(F.col(R.holder) == R.focus).alias("focus_holder"),
                     flag(F.col(R.x) > 100).alias("high_value"),
                     flag(F.col(R.substitute) > 50).alias("late_sub"))


@query
def filter_actions(spark, sf_dir):
    ev = _indexed(spark, sf_dir)
    return ev.filter(~F.col(R.type).isin(list(R.defence_types))).select(R.match, R.index, R.type, R.player)


@query
def not_null_filter(spark, sf_dir):
    ev = _indexed(spark, sf_dir)
    return (ev.filter(F.col(R.player).isNotNull() & F.col(R.x).isNotNull())
            .select(R.match, R.index, R.player, R.x))


@query
def drop_incomplete(spark, sf_dir):
    staged = vl.probability_lags(_probs(spark, sf_dir), R)
    return vl.drop_incomplete(staged, R).select(*vl.value_columns(R))


@query
def casts(spark, sf_dir):
    ev = _indexed(spark, sf_dir)
    return ev.select(R.match, R.index, F.col(R.index).cast("double").alias("index_double"),
                     F.col(R.player).cast("string").alias("player_text"),
                     F.substring(R.time_text, 1, 2).try_cast("int").alias("hour"),
                     F.col(R.y).cast("long").alias("y_long"))


@query
def time_number(spark, sf_dir):
    ev = _indexed(spark, sf_dir)
    return ev.select(R.match, R.index, R.time_text, cf.time_number(F.col(R.time_text)).alias("time"))


# --- joins, quality checks ------------------------------------------------

@query
def join_predictions(spark, sf_dir):
    p = _probs(spark, sf_dir)
    keys = [R.match, R.index]
    frames = [p.select(*keys, R.player, R.player_name, R.team, "p_score")] + \
             [p.select(*keys, c) for c in ("p_concede", "p_keep", "p_lose")]
    return vl.join_probabilities(frames, R)


def _label_frames(spark, sf_dir) -> list[DataFrame]:
    """The four probabilities stored one by one, each without some events."""
    p = _probs(spark, sf_dir)
    lacking = [p.select("*").where(F.pmod(F.col(R.index), F.lit(m)) != 1) for m in (7, 11, 13, 17)]
    frames = []
    for i, (name, kept) in enumerate(zip(vl.PROBS, lacking)):
        about = [R.player, R.player_name, R.team] if not i else []
        frames.append(save_laid_out(kept.select(R.match, R.index, sequence.CHUNK, *about, name), season.laid_keys(R), name))
    return frames


@query
def join_stored_predictions(spark, sf_dir):
    """The four-way join of frames that were stored one by one and don't hold
    the same events."""
    return sequence.drop_layout(vl.join_stored(_label_frames(spark, sf_dir), R))


@query
def unmatched_predictions(spark, sf_dir):
    return vl.unmatched_keys(_label_frames(spark, sf_dir), R, list(vl.PROBS))


@query
def roster_check(spark, sf_dir):
    return qa.off_roster(_indexed(spark, sf_dir), _roster(spark, sf_dir), R).select(R.match, R.index, R.player)


@query
def substitute_check(spark, sf_dir):
    return qa.off_roster_substitutes(_indexed(spark, sf_dir), _roster(spark, sf_dir), R) \
             .select(R.match, R.index, R.substitute)


@query
def domain_check(spark, sf_dir):
    return qa.invalid_types(_indexed(spark, sf_dir), R).select(R.match, R.index, R.type)


@query
def focus_present(spark, sf_dir):
    return qa.side_status(_raw(spark, sf_dir), R, R.team).select("match_id", "focus_count")


@query
def two_sides(spark, sf_dir):
    return qa.side_status(_raw(spark, sf_dir), R, R.team).select("match_id", "n_values")


@query
def focus_present_holder(spark, sf_dir):
    return qa.side_status(_raw(spark, sf_dir), R, R.holder).select("match_id", "focus_count")


@query
def two_holders(spark, sf_dir):
    return qa.side_status(_raw(spark, sf_dir), R, R.holder).select("match_id", "n_values")


@query
def range_check_x(spark, sf_dir):
    return qa.out_of_range(_indexed(spark, sf_dir), R, "x").select(R.match, R.index, R.x)


@query
def range_check_y(spark, sf_dir):
    return qa.out_of_range(_indexed(spark, sf_dir), R, "y").select(R.match, R.index, R.y)


@query
def time_format_check(spark, sf_dir):
    return qa.time_format_status(_raw(spark, sf_dir), R)


@query
def dedup_by_residue(spark, sf_dir):
    return qa.residue_representatives(_indexed(spark, sf_dir), R)


@query
def distinct_sides(spark, sf_dir):
    return _raw(spark, sf_dir).select(R.match, R.team).distinct()


@query
def distinct_substitutes(spark, sf_dir):
    return qa.substitutes(_indexed(spark, sf_dir), R)


def _seeded(spark, sf_dir, indexed: bool = False) -> DataFrame:
    """The events with faults by the day of the month: one side only, one
    holder only, a foreign side, a broken time, no time, a shifted place, an
    empty type, no actor."""
    day = F.substring(R.match, 9, 2).cast("int")
    ev = (_indexed if indexed else _raw)(spark, sf_dir)
    every_third = F.pmod(F.col("event_id"), F.lit(3)) == 0
    return ev.where((day != 3) | (F.col(R.team) == R.focus)).where((day != 4) | (F.col(R.holder) != R.focus)).withColumns({
        R.team: F.when((day == 5) & (F.col(R.team) == R.focus), F.lit(7).cast("long")).otherwise(F.col(R.team)),
        R.holder: F.when((day == 6) & every_third, F.lit(None).cast("long")).otherwise(F.col(R.holder)),
        R.time_text: F.when((day == 7) & every_third, F.concat(R.time_text, F.lit("Z"))).when((day == 8) & every_third, F.lit(None).cast("string"))
        .when(day == 9, F.concat(F.lit("T"), R.time_text)).otherwise(F.col(R.time_text)),
        R.x: F.when((day == 10) & every_third, F.lit(None).cast("double")).otherwise(F.col(R.x)),
        R.type: F.when((day == 11) & every_third, F.lit(None).cast("string")).otherwise(F.col(R.type)),
        R.player: F.when((day == 12) & every_third, F.lit(None).cast("long")).otherwise(F.col(R.player))})


@query
def match_status(spark, sf_dir):
    """Distinct sides, holders and time forms of every match, of listed days
    without events too, on events with faults."""
    days = bind.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("match_id"))
    with_events = bind.table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("match_id"))
    return qa.match_status(_seeded(spark, sf_dir), R, days.union(with_events))


@query
def findings_seeded(spark, sf_dir):
    """All findings, strict on times, of events with faults; a type and an actor
    of the roster are exempt."""
    roles = R.with_(roster_exempt_types=("view",))
    return qa.findings(_seeded(spark, sf_dir, indexed=True), _roster(spark, sf_dir), roles, strict=True)


@query
def half_markers(spark, sf_dir):
    """The first half marker and the number of markers of every match, of listed
    days without events too."""
    days = bind.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("match_id"))
    ev = _indexed(spark, sf_dir)
    return qa.half_markers(ev, R, days.union(bind.table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("match_id"))))


@query
def exempt_roster_check(spark, sf_dir):
    """Actors off the roster, where two types are exempt from the check."""
    roles = R.with_(roster_exempt_types=("view", "error"))
    return qa.off_roster(_seeded(spark, sf_dir, indexed=True), _roster(spark, sf_dir), roles).select(R.match, R.index, R.player)


@query
def seeded_feature_rows(spark, sf_dir):
    """Actor and place are filtered, then left out of what is shown; events lack
    either."""
    ev = _seeded(spark, sf_dir, indexed=True)
    return ev.filter(F.col(R.player).isNotNull() & F.col(R.x).isNotNull()).select(R.match, R.index, R.type)


@query
def findings(spark, sf_dir):
    return season.table_findings(spark, sf_dir, events=_events(spark, sf_dir))


@query
def findings_summary(spark, sf_dir):
    return qa.findings_summary(season.table_findings(spark, sf_dir, events=_events(spark, sf_dir)))


# --- segments, flags, labels ----------------------------------------------

@query
def segment_by_marker(spark, sf_dir, roles=R):
    return lb.segment_by_marker(_events(spark, sf_dir, roles), roles).select(R.match, R.index, lb.SEGMENT)


@query
def goal_flags(spark, sf_dir):
    return lb.goal_flags(_indexed(spark, sf_dir), R).select(R.match, R.index, "focus_goal", "other_goal")


@query
def defence_flags(spark, sf_dir):
    return lb.defence_flags(_indexed(spark, sf_dir), R).select(
        R.match, R.index, "focus_def", "focus_hold", "other_def", "other_hold")


@query
def next_k_any(spark, sf_dir, roles=R):
    ev = lb.defence_flags(lb.segment_by_marker(lb.goal_flags(_events(spark, sf_dir, roles), roles), roles), roles)
    ahead = lb.next_k_sums(ev, roles, {"focus_goal": "goals_ahead", "focus_hold": "holds_ahead"})
    return ahead.select(R.match, R.index, lb.SEGMENT, "goals_ahead", "holds_ahead",
                        flag(F.col("goals_ahead") > 0).alias("any_goal_ahead"))


def _label_query(label: str) -> Query:
    def run(spark, sf_dir):
        return _labelled(spark, sf_dir).select(R.match, R.index, label)
    run.__name__ = label
    return run


label_goal = query(_label_query("label_goal"))
label_concede = query(_label_query("label_concede"))
label_keep = query(_label_query("label_keep"))
label_lose = query(_label_query("label_lose"))


# --- features, models -----------------------------------------------------

@query
def feature_rows(spark, sf_dir):
    return sequence.drop_layout(ml.feature_rows(_labelled(spark, sf_dir), R))


@query
def union_matches(spark, sf_dir):
    """Rows of the focus side and of the other side, selected with columns in
    different orders, put back together by column name."""
    ev = _indexed(spark, sf_dir)
    cols = [R.match, R.index, R.team, R.player, R.type]
    own = ev.filter(F.col(R.team) == R.focus).select(*cols)
    rest = ev.filter(~(F.col(R.team) == R.focus) | F.col(R.team).isNull()).select(*reversed(cols))
    return own.unionByName(rest)


def _scores(kind: str) -> Query:
    def run(spark, sf_dir):
        return sequence.drop_layout(season.model_probabilities(spark, sf_dir, kind))
    run.__name__ = f"score_{kind}"
    return run


score_lr = query(_scores("lr"))
score_gbt = query(_scores("gbt"))


def _goal_model(spark, sf_dir) -> tuple[ml.Prepared, dict]:
    features = season.feature_table(_events(spark, sf_dir))
    prepared = ml.prepare(features, R, scratch_path(spark, "encodings"))
    return prepared, ml.fit_all(prepared, R, ("lr",), labels=(R.labels[0],))


@query
def positive_probability(spark, sf_dir):
    """Logistic regression on the goal label; class-1 probability taken from
    the probability vector."""
    prepared, fitted = _goal_model(spark, sf_dir)
    scored = fitted["lr"][R.labels[0]].transform(prepared.rows)
    return scored.select("match_id", "index", R.labels[0],
                         cf.positive_probability(F.col(f"{R.labels[0]}_probability")).alias("p_goal"))


@query
def positive_probability_rows(spark, sf_dir):
    """What SQL can say of ``positive_probability``: its rows, that the class-1
    probability is one, and that it and the class-0 probability make 1."""
    prepared, fitted = _goal_model(spark, sf_dir)
    both = vector_to_array(f"{R.labels[0]}_probability")
    scored = fitted["lr"][R.labels[0]].transform(prepared.rows)
    p = cf.positive_probability(F.col(f"{R.labels[0]}_probability"))
    return scored.select("match_id", "index", R.labels[0], p.between(0.0, 1.0).alias("in_range"),
                         (F.size(both) == 2).alias("two_classes"), (F.abs(both[0] + p - 1) < 1e-12).alias("sums_to_one"))


def _score_rows(kind: str) -> Query:
    """The rows of a kind's scores: who they belong to, and whether all four
    probabilities are ones."""
    def run(spark, sf_dir):
        scored = season.model_probabilities(spark, sf_dir, kind)
        sound = [F.col(p).between(0.0, 1.0).alias(f"{p}_in_range") for p in vl.PROBS]
        return scored.select(R.match, R.index, R.player, R.player_name, R.team, *sound)
    run.__name__ = f"score_{kind}_rows"
    return run


score_lr_rows = query(_score_rows("lr"))
score_gbt_rows = query(_score_rows("gbt"))


@query
def dense_actor_ids(spark, sf_dir):
    """Every actor with a dense id, by counts of range partitions."""
    actors = _raw(spark, sf_dir).select(R.player).distinct()
    return encode.dense_ids(actors, R.player, "dense_id")


@query
def label_rates(spark, sf_dir):
    """The cross-fitted label rates of every actor: a row per actor and fold."""
    rows = ml.complete_rows(season.feature_table(_events(spark, sf_dir)))
    coded = encode.encodings(rows, "player_id", R, encode.priors(rows, R))
    return coded.select("value", F.posexplode("rates").alias("fold", "r")).select(
        F.col("value").alias("player_id"), F.col("fold").cast("int").alias("fold"),
        *[F.col("r")[i].alias(f"rate_{label}") for i, label in enumerate(R.labels)])


@query
def encoded_rows(spark, sf_dir):
    """Feature rows with the index of each category and the goal rate of the
    actor, as the pipelines' first stage joins them."""
    features = season.feature_table(_events(spark, sf_dir))
    prepared = ml.prepare(features, R, scratch_path(spark, "encodings"))
    coded = prepared.stages["encoding"].transform(ml.complete_rows(features))
    return coded.select("match_id", "index", *[F.col(f"{c}_idx").cast("long").alias(f"{c}_idx") for c in ml.CATEGORICAL],
                        F.col(f"player_id_rate_{R.labels[0]}").alias("actor_goal_rate"))


@query
def model_reload(spark, sf_dir):
    """Models fitted, saved and loaded again: whether the saved pipelines give
    every feature row the probabilities that the live models give it."""
    folder = scratch_path(spark, "models")
    features = season.feature_table(_events(spark, sf_dir))
    prepared = ml.prepare(features, R, f"{folder}/encodings")
    fitted = ml.fit_all(prepared, R, max_iter=2)
    ml.save_models(prepared, fitted, folder)
    out = None
    for kind in ml.KINDS:
        live = ml.score(prepared.rows, list(fitted[kind].values()), R)
        saved = ml.score_saved(features, folder, kind, R).select(R.match, R.index, *[F.col(p).alias(f"saved_{p}") for p in vl.PROBS])
        same = F.lit(True)
        for p in vl.PROBS:
            same = same & (F.abs(F.col(p) - F.col(f"saved_{p}")) < 1e-12)
        each = live.join(saved, [R.match, R.index], "full").select(R.match, R.index, F.lit(kind).alias("kind"), F.coalesce(same, F.lit(False)).alias("same"))
        out = each if out is None else out.unionByName(each)
    return out


@query
def model_pair_ranking(spark, sf_dir):
    return season.model_ranking(spark, sf_dir, "lr")


@query
def model_pair_ranking_gbt(spark, sf_dir):
    """The same season ranking on the second model family."""
    return season.model_ranking(spark, sf_dir, "gbt")


# --- values, pairs, rankings ----------------------------------------------

@query
def lag_probabilities(spark, sf_dir, roles=R):
    return vl.probability_lags(_probs(spark, sf_dir, roles), roles).select(
        R.match, R.index, *vl.PROBS, *[f"prev_{p}" for p in vl.PROBS])


@query
def probability_deltas(spark, sf_dir):
    staged = vl.drop_incomplete(vl.probability_lags(_probs(spark, sf_dir), R), R)
    return vl.probability_deltas(staged).select(R.match, R.index, *[f"d_{p}" for p in vl.PROBS])


@query
def event_values(spark, sf_dir):
    staged = vl.drop_incomplete(vl.probability_lags(_probs(spark, sf_dir), R), R)
    return vl.event_values(vl.probability_deltas(staged)).select(R.match, R.index, "v_scoring", "v_possession")


@query
def lag_actor(spark, sf_dir, roles=R):
    return _interactions(spark, sf_dir, roles).select(
        R.match, R.index, "prev_player_name", "prev_player_id", "prev_team", "prev_v_scoring",
        "prev_v_possession")


@query
def valid_interactions(spark, sf_dir):
    return _interactions(spark, sf_dir).select(R.match, R.index, R.player, "prev_player_id", "valid")


@query
def interaction_values(spark, sf_dir):
    return _interactions(spark, sf_dir).select(R.match, R.index, "i_scoring", "i_possession", "i_modified")


@query
def pair_key(spark, sf_dir):
    return _interactions(spark, sf_dir).select(R.match, R.index, "pair")


@query
def season_pair_totals(spark, sf_dir, roles=R):
    return vl.season_pair_totals(_interactions(spark, sf_dir, roles))


@query
def rank_modified(spark, sf_dir):
    return vl.rank_pairs(vl.season_pair_totals(_interactions(spark, sf_dir)), "season_modified")


@query
def rank_plain(spark, sf_dir):
    return vl.rank_pairs(vl.season_pair_totals(_interactions(spark, sf_dir)), "season_plain")


@query
def top_pairs(spark, sf_dir):
    return vl.top_pairs(vl.season_pair_totals(_interactions(spark, sf_dir)), 20)


@query
def pair_totals_by_id(spark, sf_dir):
    """Pairs keyed on the two actor ids (names carried along)."""
    pairs = vl.interactions(_probs(spark, sf_dir), R, by="id")
    return vl.season_pair_totals(pairs)


@query
def ranking_file(spark, sf_dir):
    """The season ranking written as ordered Parquet parts, read back."""
    path = scratch_path(spark, "ranking")
    season.write_ranking(vl.season_pair_totals(_interactions(spark, sf_dir)), path)
    return spark.read.parquet(path)


# --- the same in many chunks per match --------------------------------------

NARROW = R.with_(chunk_width=64)


def _narrow(wide: Query) -> Query:
    def run(spark, sf_dir):
        return wide(spark, sf_dir, NARROW)
    run.__name__ = f"{wide.__name__}_narrow"
    return run


for _wide in (segment_by_marker, next_k_any, lag_probabilities, lag_actor, season_pair_totals):
    query(_narrow(_wide))


def all_queries() -> dict[str, Query]:
    return dict(REGISTRY)

