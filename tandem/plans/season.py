"""End-to-end flows over a whole season (all matches at once).

events --bind--> canonical rows laid out by (match, chunk), written once as a
bucketed table --> goal flags, halves, defence flags, labels --> feature rows,
written once --> probabilities (stand-in or model) --> interactions --> pair
totals. After the one layout shuffle, every sequence operator, chunk aggregate
and chunk-table join reads the bucketed table without shuffling again. Tables,
persisted frames and scratch folders belong to the run that a flow opens (or to
the session's, for functions that return lazy frames).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.config import REFERENCE_ROLES, TABLE_ROLES, Roles
from tandem.operators import labels as lb
from tandem.operators import model as ml
from tandem.operators import quality as qa
from tandem.operators import sequence
from tandem.operators import value as vl
from tandem.run import Run, current
from tandem.session import scratch_path
from tandem.sources import bind, files, listed
from tandem.sources import manifest as mf
from tandem.sources.sinks import save_laid_out, write_parquet

EVENT_PREFIX = "data/events/"
LINEUP_PREFIX = "data/lineups/"


def laid_keys(roles: Roles) -> list[str]:
    return [roles.match, sequence.CHUNK]


def bound_events(spark: SparkSession, sf_dir: str, roles: Roles = TABLE_ROLES,
                 save: bool = True) -> DataFrame:
    """Canonical events from the ``events`` table, indexed per match. With
    ``save`` the laid-out rows are written as a bucketed table, once per run for
    files of the same names, sizes and times."""
    if not save:
        return bind.bind_events(bind.table(spark, sf_dir, "events"), roles)
    run = current(spark)
    key = (files.fingerprint(spark, f"{sf_dir.rstrip('/')}/events.parquet"), roles)
    if key not in run.bound:
        run.bound[key] = save_laid_out(bind.bind_events(bind.table(spark, sf_dir, "events"), roles), laid_keys(roles), "events")
    return run.bound[key]


def standin_input(events: DataFrame, roles: Roles = TABLE_ROLES) -> DataFrame:
    """Value-stage input with stand-in probabilities: events with an actor and
    a location (the training rows), four probabilities per event."""
    r = roles
    rows = events.filter(F.col(r.player).isNotNull() & F.col(r.x).isNotNull())
    probs = bind.standin_probabilities(rows, r)
    keep = [sequence.CHUNK] if sequence.CHUNK in events.columns else []
    return probs.select(r.match, r.index, r.player, r.player_name, r.team, *vl.PROBS, *keep)


def pair_totals(probabilities: DataFrame, roles: Roles) -> DataFrame:
    return vl.season_pair_totals(vl.interactions(probabilities, roles))


def standin_ranking(spark: SparkSession, sf_dir: str, roles: Roles = TABLE_ROLES) -> DataFrame:
    """Season pair totals on stand-in probabilities, best pairs first."""
    events = bound_events(spark, sf_dir, roles)
    return vl.rank_pairs(pair_totals(standin_input(events, roles), roles))


def feature_table(events: DataFrame, roles: Roles = TABLE_ROLES) -> DataFrame:
    """The labelled feature rows of laid-out events, written once: every fit,
    encoding and score reads them, and the labels are computed once."""
    return save_laid_out(ml.feature_rows(lb.labelled(events, roles), roles), ["match_id", sequence.CHUNK], "features")


def laid_scores(scored: DataFrame, roles: Roles, name: str) -> DataFrame:
    """Scores written as a bucketed table for the value stage. Their rows have
    met the encoding tables on the way, which may have dealt them anew."""
    spark = scored.sparkSession
    dealt = scored.repartition(sequence.layout_partitions(spark), *laid_keys(roles))
    return save_laid_out(dealt, laid_keys(roles), name)


def model_probabilities(spark: SparkSession, sf_dir: str, kind: str, roles: Roles = TABLE_ROLES,
                        index_ids: bool = True, tree_encoding: str = "rates") -> DataFrame:
    """Label the season, train one ``kind`` model per label on the feature rows
    and score them (see ``operators.model``); the scored rows are written once
    (bucketed) so the value stage does not run the models again."""
    features = feature_table(bound_events(spark, sf_dir, roles), roles)
    prepared = ml.prepare(features, roles, scratch_path(spark, "encodings"), index_ids)
    fitted = ml.fit_all(prepared, roles, (kind,), tree_encoding=tree_encoding)
    written = laid_scores(ml.score(prepared.rows, list(fitted[kind].values()), roles), roles, f"scored_{kind}")
    prepared.coded.unpersist()
    return written


def model_ranking(spark: SparkSession, sf_dir: str, kind: str,
                  roles: Roles = TABLE_ROLES) -> DataFrame:
    probs = model_probabilities(spark, sf_dir, kind, roles)
    return vl.rank_pairs(pair_totals(probs, roles))


def label_predictions(scored: DataFrame, roles: Roles, name: str = "label") -> list[DataFrame]:
    """Each label's probability stored by itself, bucketed like the events: the
    first frame carries the actor and side columns. ``scored`` is laid out."""
    keys = [roles.match, roles.index, sequence.CHUNK]
    about = [roles.player, roles.player_name, roles.team]
    return [save_laid_out(scored.select(*keys, *(about if i == 0 else []), p).where(F.col(p).isNotNull()), laid_keys(roles), f"{name}_{p}")
            for i, p in enumerate(vl.PROBS)]


def table_findings(spark: SparkSession, sf_dir: str, roles: Roles = TABLE_ROLES,
                   events: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Every quality check on the bound tables, as one findings frame."""
    events = bound_events(spark, sf_dir, roles) if events is None else events
    roster = bind.roster(bind.table(spark, sf_dir, "customer"))
    matches = bind.match_list(bind.table(spark, sf_dir, "orders"))
    manifest = mf.manifest_long(matches, EVENT_PREFIX, LINEUP_PREFIX)
    there = bind.listing_from(bind.table(spark, sf_dir, "lineitem"), EVENT_PREFIX, LINEUP_PREFIX)
    return qa.findings(events, roster, roles, missing=mf.missing_files(manifest, there), strict=strict)


def json_season(spark: SparkSession, events_dir: str, lineups_dir: str,
                roles: Roles = REFERENCE_ROLES, multiline: bool = True, save: bool = True,
                matches: DataFrame | None = None, rejects: bool = False):
    """Nested event and lineup files of a season -> (canonical events laid
    out by (match, index chunk), roster per match). With a match list only the
    listed matches' files are read, otherwise all; with ``save`` the laid-out
    events are written once as a bucketed table (see ``bound_events``);
    ``rejects`` adds the findings of files that could not be parsed."""
    read = listed.read_events(spark, events_dir, matches, roles, multiline)
    lineups = listed.read_lineups(spark, lineups_dir, matches, multiline)
    events = sequence.layout(read.rows, [roles.match], roles.index, roles.chunk_width)
    if save:
        events = save_laid_out(events, laid_keys(roles), "json_events")
    if not rejects:
        return events, lineups.rows
    unreadable = listed.reject_findings(read.rejects, mf.EVENT_KIND).unionByName(listed.reject_findings(lineups.rejects, mf.LINEUP_KIND))
    return events, lineups.rows, unreadable


def write_ranking(totals: DataFrame, path: str, by: str = "season_modified") -> None:
    """Write the season ranking: a range-partitioned global sort, part files in
    rank order."""
    vl.rank_pairs(totals, by).write.mode("overwrite").parquet(path)


def write_rankings(totals: DataFrame, folder: str) -> dict[str, str]:
    """Both rankings and the 20 best pairs of each."""
    kept = current(totals.sparkSession).keep(totals)
    out = {}
    for by in ("season_modified", "season_plain"):
        out[by], out[f"{by}_top"] = f"{folder}/{by}", f"{folder}/{by}_top20"
        write_ranking(kept, out[by], by)
        vl.rank_pairs(kept, by).limit(20).coalesce(1).write.mode("overwrite").parquet(out[f"{by}_top"])
    kept.unpersist()
    return out


def prediction_step(spark: SparkSession, sf_dir: str, out_dir: str, roles: Roles = TABLE_ROLES,
                    kinds: tuple = ml.KINDS, index_ids: bool = True, events: DataFrame | None = None,
                    tree_encoding: str = "rates", max_iter: int = 10) -> dict[str, str]:
    """The season's training step: labelled feature rows and encodings written
    once, then per model kind one classifier per label, every pipeline saved,
    and the training rows scored and written (one scored table per kind, four
    probabilities per event). ``events`` reuses an already bound (bucketed)
    event table. Returns the written folders; nothing else is left."""
    with Run(spark):
        events = bound_events(spark, sf_dir, roles) if events is None else events
        features = feature_table(events, roles)
        prepared = ml.prepare(features, roles, f"{out_dir}/models/encodings", index_ids)
        fitted = ml.fit_all(prepared, roles, kinds, max_iter, tree_encoding=tree_encoding)
        ml.save_models(prepared, fitted, f"{out_dir}/models")
        written = {kind: f"{out_dir}/predictions/{kind}" for kind in kinds}
        for kind in kinds:
            scored = ml.score(prepared.rows, list(fitted[kind].values()), roles)
            write_parquet(sequence.drop_layout(scored), written[kind])
        return written


def score_step(spark: SparkSession, models_dir: str, kind: str, events: DataFrame, roles: Roles = TABLE_ROLES) -> DataFrame:
    """Events scored with the saved models of ``prediction_step`` or
    ``run_json_season`` (their ``models`` folder); nothing is fitted."""
    return ml.score_saved(ml.feature_rows(lb.labelled(events, roles), roles), models_dir, kind, roles)


def run_json_season(spark: SparkSession, data_root: str, out_dir: str, match_list: str | None = None,
                    roles: Roles = REFERENCE_ROLES, kinds: tuple = ml.KINDS,
                    max_iter: int = 10, index_ids: bool = True,
                    tree_encoding: str = "rates", strict: bool = False) -> dict[str, str]:
    """The whole season from nested JSON files under ``data_root``
    (``events/<match>.json``, ``lineups/<match>.json``):

    1. expected files from the match list (if given) and the missing ones;
    2. the listed files read, those that can't be parsed reported; all quality
       findings (``strict``: single ill-formed times too), matches without a half
       marker and rows without the numbers that models need among them;
    3. halves, goal and defence flags, four labels;
    4. one model per label and kind (fit once per season, saved), scores;
    5. pair values and the season ranking per model kind (top 20 and full).

    ``index_ids=False`` uses raw ids as one-hot indices and
    ``tree_encoding="onehot"`` gives the trees the one-hot vector, as the
    original does. Every step runs over all matches at once. Returns the
    written folders; nothing else is left.
    """
    with Run(spark):
        out = {"findings": f"{out_dir}/findings", "labelled": f"{out_dir}/labelled", "models": f"{out_dir}/models"}
        matches, found = None, []
        if match_list:
            parsed = listed.read_match_list(spark, match_list)
            matches = parsed.rows.select("match_id")
            found.append(listed.reject_findings(parsed.rejects, "matches"))
            out["manifest"] = f"{out_dir}/manifest"
            write_parquet(mf.manifest_wide(matches, f"{data_root}/events/", f"{data_root}/lineups/"), out["manifest"])
            manifest = mf.manifest_long(matches, f"{data_root}/events/", f"{data_root}/lineups/")
            there = mf.listed_ids(files.listing(spark, data_root, "*.json"))
            found.append(qa.missing_findings(mf.missing_by_id(manifest, there)))
        events, roster, unreadable = json_season(spark, f"{data_root}/events", f"{data_root}/lineups", roles, matches=matches, rejects=True)
        labelled = save_laid_out(lb.labelled(events, roles), laid_keys(roles), "labelled")
        write_parquet(sequence.drop_layout(labelled), out["labelled"], [roles.match])
        features = ml.feature_rows(labelled, roles)
        found += [unreadable, ml.incomplete_rows(features), qa.marker_findings(qa.half_markers(events, roles, matches)),
                  qa.findings(events, roster, roles, matches=matches, strict=strict)]
        write_parquet(reduce(DataFrame.unionByName, found), out["findings"])
        prepared = ml.prepare(features, roles, f"{out['models']}/encodings", index_ids)
        fitted = ml.fit_all(prepared, roles, kinds, max_iter, tree_encoding=tree_encoding)
        ml.save_models(prepared, fitted, out["models"])
        for kind in kinds:
            scored = laid_scores(ml.score(prepared.rows, list(fitted[kind].values()), roles), roles, f"scored_{kind}")
            out[f"predictions_{kind}"] = f"{out_dir}/predictions/{kind}"
            write_parquet(sequence.drop_layout(scored), out[f"predictions_{kind}"])
            written = write_rankings(pair_totals(scored, roles), f"{out_dir}/ranking/{kind}")
            out[f"ranking_{kind}"] = written["season_modified"]
            out |= {f"ranking_{kind}_{name}": path for name, path in written.items()}
        return out
