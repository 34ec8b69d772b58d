"""Order-dependent operators over long groups without a hot task.

A window ``partitionBy(match).orderBy(index)`` sends a whole match to one
task; a match holding a third of all rows would make one task do a third of
the job. Here a group is cut into *chunks* of the order key
(``chunk = order div width``) and rows are hash-partitioned on
``(group, chunk)``, so every window partition holds at most ``width`` rows.
What crosses a chunk boundary (row counts before a chunk, the last row of the
previous chunk, the first rows of the next chunks, group-wide minima) travels
through a *chunk table* with one row per ``(group, chunk)``: it is built by an
aggregate on the already-partitioned rows (no shuffle), combined by a window
per group over ``rows / width`` entries, and joined back on
``(group, chunk)``. One shuffle of the event rows serves every operator in
this module as long as the frame keeps its layout.

The chunk table is itself combined in two levels: windows over
``(group, super-chunk)`` (``fan`` chunks each) and one window per group over
the super-chunk rows (rows / (width * fan) of them), so no task holds all
chunks of a hot group either.

Requirements: group keys are non-NULL, the order column is unique within a
group, and the chunk column is non-decreasing in the order column within a
group (any ``order div width`` of a column monotone in the order qualifies).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.run import current

CHUNK = "_chunk"
SUPER = "_super"
DEFAULT_FAN = 4096  # chunks per super-chunk in the two-level chunk tables


def chunk_of(order: str, width: int) -> Column:
    """Chunk number of a row: integral division of the order key."""
    return F.expr(f"`{order}` div {int(width)}")


LAYOUT_PARTITIONS = "spark.tandem.layout.partitions"


def layout_partitions(spark) -> int:
    """Partitions (and buckets) of the (group, chunk) layout:
    ``spark.tandem.layout.partitions`` if set, else
    ``spark.sql.shuffle.partitions``. Size it so a partition holds roughly
    128-256 MB of event rows (about 400,000 partitions for 100 TB; beyond
    100,000, raise ``spark.sql.sources.bucketing.maxBuckets`` too)."""
    value = spark.conf.get(LAYOUT_PARTITIONS, None)
    return int(value) if value else int(spark.conf.get("spark.sql.shuffle.partitions"))


def layout(df: DataFrame, group: Sequence[str], order: str, width: int) -> DataFrame:
    """Add the chunk column and hash-partition rows on (group, chunk).

    A frame that already carries the chunk column is returned unchanged, so a
    chain of operators shares one shuffle. The partition count is explicit
    (``layout_partitions``) so that the layout can be written as a bucketed
    table with the same hash (``tandem.sources.sinks.save_laid_out``).
    """
    if CHUNK in df.columns:
        return df
    n = layout_partitions(df.sparkSession)
    return df.withColumn(CHUNK, chunk_of(order, width)).repartition(n, *group, CHUNK)


def _chunked(df: DataFrame, order: str, width: int) -> DataFrame:
    """The rows with their chunk number but *before* the layout shuffle: chunk
    tables aggregate from here, so partial aggregation runs map-side and only
    one small row per chunk and task is shuffled."""
    return df if CHUNK in df.columns else df.withColumn(CHUNK, chunk_of(order, width))


CELLS = 16  # per chunk of a long group: what chunk bounds are counted in


def chunk_by_position(df: DataFrame, group: Sequence[str], order: str, width: int, cells: int = CELLS,
                      fan: int = DEFAULT_FAN) -> DataFrame:
    """Add the chunk column from row counts, for an order key that says nothing
    of a row's position: ids of interleaved groups, or with gaps. A group of at
    most ``width`` rows is one chunk. The range of a longer one is cut into equal
    cells, ``cells`` times as many as its rows need chunks; rows before a cell are
    counted, and a chunk is the cells that begin within the next ``width`` rows.
    So a chunk holds at most ``width`` rows and one cell more.

    Groups that are cut, at most rows / width of them, and their cells are
    written, so that their size is known when the rows meet them."""
    from tandem.sources.sinks import save_scratch

    group = list(group)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    parts = cells * F.ceil(F.col("_n") / width)
    long = save_scratch(sizes.where(F.col("_n") > width).select(*group, "_lo", F.greatest(F.lit(1), F.ceil((F.col("_hi") - F.col("_lo") + 1) / parts)).cast("long").alias("_wide")), "long-groups")
    if long.isEmpty():
        return df.withColumn(CHUNK, F.lit(0).cast("long"))
    placed = df.join(long, group, "left").withColumn("_cell", F.expr(f"coalesce((`{order}` - _lo) div _wide, 0)"))
    counts = placed.where(F.col("_lo").isNotNull()).groupBy(*group, F.col("_cell").alias(CHUNK)).agg(F.count(F.lit(1)).alias("_n"))
    before = _exclusive_sum(counts, group, "_n", "_off", fan)
    bounds = save_scratch(before.select(*group, F.col(CHUNK).alias("_cell"), F.expr(f"_off div {int(width)}").alias(CHUNK)), "chunk-bounds")
    return placed.join(bounds, [*group, "_cell"], "left").select(*df.columns, F.coalesce(CHUNK, F.lit(0)).cast("long").alias(CHUNK))


def _join_table(df: DataFrame, table: DataFrame, keys: Sequence[str],
                also: Sequence[str] = ()) -> DataFrame:
    """Left-join a chunk table on (group, chunk).

    A plain equi-join on exactly the rows' layout keys keeps their hash
    partitioning, so only the small table moves: Catalyst/AQE broadcast it
    when it is small, otherwise it is shuffled to the rows' partitioning.
    Columns in ``also`` (a finer group, such as the half within a match) are
    compared in a non-equi condition: as equi-join keys they would make the
    join require (layout keys + also) partitioning and shuffle the rows too.
    """
    if not also:
        return df.join(table, list(keys), "left")
    t = table.select(*[F.col(c).alias(f"_t{c}") for c in table.columns])
    cond = [df[k] == t[f"_t{k}"] for k in keys]
    # (a - b) = 0 is not extracted as an equi-join key; NULL never matches,
    # as with an equi-join.
    cond += [(df[c] - t[f"_t{c}"]) == 0 for c in also]
    out = df.join(t, cond, "left")
    rest = [c for c in table.columns if c not in keys and c not in also]
    return out.select(*[df[c] for c in df.columns], *[t[f"_t{c}"].alias(c) for c in rest])


# --- two-level scans over a chunk table (one row per group and chunk) -------

def _shared(table: DataFrame) -> DataFrame:
    """Persist a chunk table that feeds more than one branch of a plan (its
    chunk-level window and its super-chunk aggregate; the event rows and the
    look-ahead heads), so the event scan below it runs once. It holds one row
    per (group, chunk), rows / width of them, and belongs to the current run."""
    return current(table.sparkSession).keep(table)


def _with_super(table: DataFrame, fan: int) -> DataFrame:
    return _shared(table.withColumn(SUPER, F.expr(f"`{CHUNK}` div {int(fan)}")))


def _ordered(items: Column, field: str) -> Column:
    """Sort collected (position, value) structs by position and concatenate
    their array values."""
    return F.flatten(F.transform(F.array_sort(items), lambda e: e[field]))


def _exclusive_sum(table: DataFrame, group: list, col: str, out: str, fan: int) -> DataFrame:
    """Per chunk: sum of ``col`` over the chunks before it in its group."""
    t = _with_super(table, fan)
    before = Window.partitionBy(*group, SUPER).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_loc", F.coalesce(F.sum(col).over(before), F.lit(0)))
    sup = t.groupBy(*group, SUPER).agg(F.sum(col).alias("_tot"))
    sup_before = Window.partitionBy(*group).orderBy(SUPER).rowsBetween(Window.unboundedPreceding, -1)
    sup = sup.select(*group, SUPER, F.coalesce(F.sum("_tot").over(sup_before), F.lit(0)).alias("_sup"))
    return t.join(sup, group + [SUPER]).select(*group, CHUNK, (F.col("_loc") + F.col("_sup")).alias(out))


def _previous(table: DataFrame, group: list, col: str, out: str, fan: int) -> DataFrame:
    """Per chunk: ``col`` of the previous chunk of its group (non-NULL values)."""
    t = _with_super(table, fan)
    t = t.withColumn("_loc", F.lag(col, 1).over(Window.partitionBy(*group, SUPER).orderBy(CHUNK)))
    sup = t.groupBy(*group, SUPER).agg(F.max_by(col, CHUNK).alias("_last"))
    sup = sup.select(*group, SUPER, F.lag("_last", 1).over(Window.partitionBy(*group).orderBy(SUPER)).alias("_sup"))
    return t.join(sup, group + [SUPER]).select(*group, CHUNK, F.coalesce("_loc", "_sup").alias(out))


def _following(table: DataFrame, group: list, col: str, out: str, k: int, fan: int) -> DataFrame:
    """Per chunk: the first k entries of the ``col`` arrays of the chunks
    after it in its group (each chunk holds a non-empty array in order)."""
    t = _with_super(table, fan)
    inner = Window.partitionBy(*group, SUPER).orderBy(CHUNK)
    t = t.withColumn("_loc", _ordered(F.collect_list(F.struct(CHUNK, col)).over(inner.rowsBetween(1, k)), col))
    firsts = t.withColumn("_r", F.row_number().over(inner)).filter(F.col("_r") <= k)
    sup = firsts.groupBy(*group, SUPER).agg(
        F.slice(_ordered(F.collect_list(F.struct(CHUNK, col)), col), 1, k).alias("_sh"))
    after = Window.partitionBy(*group).orderBy(SUPER).rowsBetween(1, k)
    sup = sup.select(*group, SUPER, _ordered(F.collect_list(F.struct(SUPER, "_sh")).over(after), "_sh").alias("_sn"))
    return t.join(sup, group + [SUPER]).select(
        *group, CHUNK, F.slice(F.concat("_loc", "_sn"), 1, k).alias(out))


def _group_min(table: DataFrame, group: list, col: str, out: str, fan: int) -> DataFrame:
    """Per chunk: minimum of ``col`` over all chunks of its group."""
    t = _with_super(table, fan)
    sup = t.groupBy(*group, SUPER).agg(F.min(col).alias("_m"))
    sup = sup.select(*group, SUPER, F.min("_m").over(Window.partitionBy(*group)).alias(out))
    return _shared(t.join(sup, group + [SUPER]).select(*group, CHUNK, out))


def row_numbers(df: DataFrame, group: Sequence[str], order: str, out: str,
                width: int, fan: int = DEFAULT_FAN, by_position: bool = False) -> DataFrame:
    """``row_number() over (partition by group order by order)``, 1-based.
    ``by_position`` takes the chunks from row counts (``chunk_by_position``)."""
    group = list(group)
    keys = group + [CHUNK]
    if by_position:
        df = chunk_by_position(df, group, order, width, fan=fan)
        ld = df.repartition(layout_partitions(df.sparkSession), *keys)
    else:
        ld = layout(df, group, order, width)
    counts = _chunked(df, order, width).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _exclusive_sum(counts, group, "_n", "_off", fan)
    local = Window.partitionBy(*keys).orderBy(order)
    return (_join_table(ld, offsets, keys)
            .withColumn(out, (F.col("_off") + F.row_number().over(local)).cast("long"))
            .drop("_off"))


def lag_columns(df: DataFrame, group: Sequence[str], order: str,
                columns: dict[str, str], width: int, fan: int = DEFAULT_FAN) -> DataFrame:
    """Add ``out = lag(src, 1) over (partition by group order by order)`` for
    every ``src -> out`` in ``columns``: the previous row's value, NULL on the
    first row of a group."""
    group = list(group)
    ld = layout(df, group, order, width)
    keys = group + [CHUNK]
    row = F.struct(*[F.col(src).alias(f"c{i}") for i, src in enumerate(columns)])
    tails = _chunked(df, order, width).groupBy(*keys).agg(F.max_by(row, F.col(order)).alias("_tail"))
    carry = _previous(tails, group, "_tail", "_carry", fan)
    local = Window.partitionBy(*keys).orderBy(order)
    # lag of a struct is NULL only on the first row of a chunk: take the last
    # row of the previous non-empty chunk there.
    prev = F.coalesce(F.lag(row, 1).over(local), F.col("_carry"))
    out = _join_table(ld, carry, keys).withColumn("_prev", prev)
    out = out.withColumns({name: F.col("_prev")[f"c{i}"] for i, name in enumerate(columns.values())})
    return out.drop("_prev", "_carry")


def lookahead_sums(df: DataFrame, group: Sequence[str], order: str,
                   flags: dict[str, str], k: int, width: int, fan: int = DEFAULT_FAN,
                   layout_group: Sequence[str] | None = None) -> DataFrame:
    """Add ``out = sum(src) over (partition by group order by order rows
    between current row and k following)`` for every ``src -> out``; NULL
    sources count as 0. ``layout_group`` (a prefix of ``group``, default
    ``group``) names the group the rows are laid out by; the remaining group
    columns must be numeric."""
    group = list(group)
    lgroup = list(layout_group) if layout_group is not None else group
    ld = layout(df, lgroup, order, width)
    keys = group + [CHUNK]
    local = Window.partitionBy(*keys).orderBy(order)
    srcs = list(flags)
    staged = ld.withColumns({
        "_p": F.row_number().over(local),
        "_m": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        **{f"_in{i}": F.coalesce(F.sum(src).over(local.rowsBetween(0, k)), F.lit(0)).cast("long")
           for i, src in enumerate(srcs)},
    })
    # First k rows of each chunk, in order; then, per chunk, the first k rows
    # of the chunks that follow it (k non-empty chunks always suffice).
    head_row = F.struct(F.col("_p"), *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(f"f{i}")
                                       for i, s in enumerate(srcs)])
    heads = (staged.filter(F.col("_p") <= k).groupBy(*keys)
             .agg(F.array_sort(F.collect_list(head_row)).alias("_h")))
    table = _following(heads, group, "_h", "_next", k, fan)
    joined = _join_table(staged, table, lgroup + [CHUNK], [c for c in group if c not in lgroup])
    spill = F.col("_p") + F.lit(k) - F.col("_m")
    outs = {}
    for i, (src, name) in enumerate(flags.items()):
        extra = F.aggregate(F.slice(F.coalesce(F.col("_next"), F.array()), 1, spill),
                            F.lit(0).cast("long"), _adder(f"f{i}"))
        outs[name] = F.col(f"_in{i}") + F.when(spill > 0, extra).otherwise(F.lit(0).cast("long"))
    return joined.withColumns(outs).drop("_p", "_m", "_next", *[f"_in{i}" for i in range(len(srcs))])


def _adder(field: str):
    return lambda acc, e: acc + e[field]


def group_min(df: DataFrame, group: Sequence[str], order: str, value: Column, out: str,
              width: int, fan: int = DEFAULT_FAN) -> DataFrame:
    """Add ``out = min(value) over (partition by group)`` through the chunk
    table: partial minima per chunk, then the minimum over a group's chunks."""
    group = list(group)
    ld = layout(df, group, order, width)
    keys = group + [CHUNK]
    part = _chunked(df, order, width).groupBy(*keys).agg(F.min(value).alias("_v"))
    return _join_table(ld, _group_min(part, group, "_v", out, fan), keys)


def drop_layout(df: DataFrame) -> DataFrame:
    return df.drop(CHUNK) if CHUNK in df.columns else df
