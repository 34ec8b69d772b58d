"""Event values from probability changes, pair interactions and season totals.

Input: one row per event with ``match_id, index, player_id, player_name,
team`` and four probabilities ``p_score, p_concede, p_keep, p_lose``.
Both lag levels run through the chunked sequence operators (no window holds
a whole match); the only other shuffle is the pair aggregate, which combines
map-side first, so a pair (or the NULL pair) holding most rows costs one row
per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.config import Roles
from tandem.functions.columns import flag, pair_key
from tandem.operators import sequence

PROBS = ("p_score", "p_concede", "p_keep", "p_lose")


def join_probabilities(frames: list[DataFrame], roles: Roles) -> DataFrame:
    """Inner equi-join of separately stored probability frames on
    (match, index); each key is one event, so no key is hot."""
    keys = [roles.match, roles.index]
    return reduce(lambda a, b: a.join(b, keys, "inner"), frames)


def join_stored(frames: list[DataFrame], roles: Roles) -> DataFrame:
    """The same join of frames that are stored bucketed on (match, chunk): each
    bucket is joined where it lies, and the result is laid out for the lags.

    Spark takes a partitioning by some of a join's keys only if
    ``spark.sql.requireAllClusterKeysForCoPartition`` is off, which is set for
    the session: the buckets hold whole chunks of a match, which are of bounded
    size, so none of them is hot."""
    frames[0].sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return reduce(lambda a, b: a.join(b, [roles.match, sequence.CHUNK, roles.index], "inner"), frames)


def unmatched_keys(frames: list[DataFrame], roles: Roles, names: list[str]) -> DataFrame:
    """Events that some of the stored frames lack, which the inner join drops:
    match, index and ``lacking``, the names of those frames. A report: only keys
    and a bit per frame are shuffled."""
    keys = [roles.match, sequence.CHUNK, roles.index]
    marked = [f.select(*keys, F.lit(1 << i).alias("_in")) for i, f in enumerate(frames)]
    found = reduce(DataFrame.union, marked).groupBy(*keys).agg(F.bit_or("_in").alias("_in"))
    lacking = F.array_join(F.array_compact(F.array(*[F.when(F.col("_in").bitwiseAND(F.lit(1 << i)) == 0, F.lit(n)) for i, n in enumerate(names)])), ",")
    return found.where(F.col("_in") != (1 << len(frames)) - 1).select(roles.match, roles.index, lacking.alias("lacking"))


def probability_lags(df: DataFrame, roles: Roles) -> DataFrame:
    """``prev_p_*``: the probabilities of the previous event in the match."""
    return sequence.lag_columns(df, [roles.match], roles.index,
                                {p: f"prev_{p}" for p in PROBS}, roles.chunk_width)


def value_columns(roles: Roles) -> list[str]:
    r = roles
    return [r.match, r.index, r.player, r.player_name, r.team, *PROBS, *[f"prev_{p}" for p in PROBS]]


def drop_incomplete(df: DataFrame, roles: Roles) -> DataFrame:
    """Drop rows with a NULL or NaN in any value column (the first event of
    each match has no previous probabilities)."""
    return df.na.drop(subset=value_columns(roles))


def probability_deltas(df: DataFrame) -> DataFrame:
    return df.withColumns({f"d_{p}": F.col(p) - F.col(f"prev_{p}") for p in PROBS})


def event_values(df: DataFrame) -> DataFrame:
    """``v_scoring`` = change of scoring minus change of conceding chances;
    ``v_possession`` = change of keeping minus change of losing the ball."""
    return df.withColumns({
        "v_scoring": F.col("d_p_score") - F.col("d_p_concede"),
        "v_possession": F.col("d_p_keep") - F.col("d_p_lose"),
    })


def actor_lags(df: DataFrame, roles: Roles) -> DataFrame:
    """Previous actor, side and values among the events kept by
    ``drop_incomplete`` (so the first kept event of a match has none)."""
    r = roles
    return sequence.lag_columns(df, [r.match], r.index, {
        r.player_name: "prev_player_name", r.player: "prev_player_id", r.team: "prev_team",
        "v_scoring": "prev_v_scoring", "v_possession": "prev_v_possession"}, r.chunk_width)


def valid_interactions(df: DataFrame, roles: Roles) -> DataFrame:
    """1 when two different actors of the focus side act consecutively."""
    focus = F.lit(roles.focus)
    return df.withColumn("valid", flag((F.col(roles.player) != F.col("prev_player_id"))
                                       & (F.col(roles.team) == focus) & (F.col("prev_team") == focus)))


def interaction_values(df: DataFrame) -> DataFrame:
    """Joint values of the two events of an interaction; 0 for invalid rows,
    NULL where there is no previous event. ``+ 0.0`` turns -0.0 into 0.0."""
    valid = F.col("valid")
    i_scoring = (F.col("v_scoring") + F.col("prev_v_scoring")) * valid + F.lit(0.0)
    i_possession = (F.col("v_possession") + F.col("prev_v_possession")) * valid + F.lit(0.0)
    return df.withColumns({"i_scoring": i_scoring, "i_possession": i_possession}) \
             .withColumn("i_modified", F.col("i_scoring") + F.col("i_possession"))


def pair_keys(df: DataFrame, roles: Roles, by: str = "name") -> DataFrame:
    """``pair``: unordered pair of consecutive actors of a valid interaction.
    ``by="name"`` labels it with the two names (two namesakes share a key,
    as in the original analytic); ``by="id"`` keys it on the two actor ids
    (names carried along in ``pair_names``)."""
    ids = F.col(roles.player), F.col("prev_player_id")
    named = pair_key(F.col("valid"), *ids, F.col(roles.player_name), F.col("prev_player_name"))
    if by == "name":
        return df.withColumn("pair", named)
    if by == "id":
        return df.withColumns({
            "pair": pair_key(F.col("valid"), *ids, ids[0].cast("string"), ids[1].cast("string")),
            "pair_names": named})
    raise ValueError(f"pair key by {by!r}")


def interactions(probabilities: DataFrame, roles: Roles, by: str = "name") -> DataFrame:
    """Per-event rows up to the pair key: lags, drop, deltas, values, actor
    lags, validity, joint values, pair."""
    staged = probability_lags(probabilities, roles)
    staged = event_values(probability_deltas(drop_incomplete(staged, roles)))
    staged = actor_lags(staged, roles)
    return pair_keys(interaction_values(valid_interactions(staged, roles)), roles, by)


def season_pair_totals(pairs: DataFrame, keep_null: bool = True) -> DataFrame:
    """Season totals per pair; invalid interactions form the NULL pair,
    kept unless ``keep_null`` is false. With id keys the names of the pair
    come along (one name pair per id pair)."""
    if not keep_null:
        pairs = pairs.filter(F.col("pair").isNotNull())
    extra = [F.min("pair_names").alias("pair_names")] if "pair_names" in pairs.columns else []
    return pairs.groupBy("pair").agg(
        (F.sum("i_modified") + F.lit(0.0)).alias("season_modified"),
        (F.sum("i_scoring") + F.lit(0.0)).alias("season_plain"), *extra)


def rank_pairs(totals: DataFrame, by: str = "season_modified") -> DataFrame:
    """Global descending order on a score (range-partitioned sort), the pair
    name breaking ties so the order is reproducible."""
    return totals.orderBy(F.desc(by), F.asc_nulls_last("pair"))


def top_pairs(totals: DataFrame, n: int = 20, by: str = "season_modified") -> DataFrame:
    """The best ``n`` pairs (a top-k: each task keeps n rows)."""
    return rank_pairs(totals, by).limit(n)
