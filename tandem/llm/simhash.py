"""SimHash near-duplicates by anchor points of a covering code.

The fingerprint is cut into three slices. Two fingerprints that differ in at
most ``3 k + 2`` bits differ in at most ``k`` bits of some slice. Anchors of a
slice are the words of the binary Golay code, which covers 23 bits with radius
3: a fingerprint is at home at the nearest anchor of each slice and is
replicated to every anchor within radius 3 + k of its slice. So any linked
pair meets at the home anchor of one of the two.

Per anchor the home and replicated fingerprints are compared in blocks of
bounded size, and a block gives a spanning forest of its links, never all
pairs. Only distinct fingerprints take part; documents join the component of
their fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import column, stored
from tandem.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SLICES = ((0, 22), (22, 21), (43, 21))
BLOCK = 4096
GOLAY_GENERATOR = 0b101011100011  # fixed value: a generator polynomial of the binary Golay code
RADIUS = 3


# ---- fingerprints -----------------------------------------------------------
def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(data, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(data[s:e], seed) for s, e in zip(starts, (ends[shingle - 1:] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at:at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in column(batch, "text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


# ---- anchors ----------------------------------------------------------------
@cache
def code() -> np.ndarray:
    """The 4096 words of the Golay code: multiples of the generator."""
    n = np.arange(4096, dtype=np.uint32)
    words = np.zeros(4096, np.uint32)
    for bit in range(12):
        words ^= np.where(n >> bit & 1, np.uint32(GOLAY_GENERATOR << bit), np.uint32(0))
    return words


def anchors(fps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): the cells of each fingerprint; a cell is
    slice * 4096 + number of the anchor, home says that it is the nearest."""
    rows, cells, homes = [], [], []
    words = code()
    for s, (low, width) in enumerate(SLICES):
        part = (fps >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.uint32)
        for at in range(0, len(part), 512):
            near = np.bitwise_count(part[at:at + 512, None] ^ words[None, :])
            r, c = np.nonzero(near <= RADIUS + k)
            rows.append(r + at)
            cells.append(c + 4096 * s)
            homes.append(near[r, c] <= RADIUS)
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)


def cells(fps: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = column(batch, "fp").to_numpy(zero_copy_only=False)
            r, c, home = anchors(values.view(np.uint64), k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.astype(np.int32)), pa.array(home), pa.array(values[r])], ["cell", "home", "fp"])

    return fps.mapInArrow(run, "cell int, home boolean, fp long")


# ---- comparison -------------------------------------------------------------
def forest(home: np.ndarray, other: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links between two sets of
    fingerprints: breadth-first, each visited once, compared in pieces."""
    out = []
    left = other[~np.isin(other, home)]
    everything = np.concatenate([home, left])
    waiting = everything
    first = np.zeros(len(home), bool)
    step = max(1, (1 << 21) // max(1, len(everything)))
    for at in range(0, len(home), step):
        close = np.bitwise_count(home[at:at + step, None] ^ everything[None, :]) <= bits
        first[at:at + step] = close.sum(1) > 1
    if not first.any():
        return out
    seeds = home[first]
    while len(seeds):
        frontier, seeds = seeds[:1], seeds[1:]
        waiting = waiting[waiting != frontier[0]]
        while len(frontier) and len(waiting):
            step = max(1, (1 << 21) // len(waiting))
            found = []
            for at in range(0, len(frontier), step):
                if not len(waiting):
                    break
                close = np.bitwise_count(frontier[at:at + step, None] ^ waiting[None, :]) <= bits
                hit = close.any(0)
                if hit.any():
                    out.append((frontier[at:at + step][close[:, hit].argmax(0)], waiting[hit]))
                    found.append(waiting[hit])
                    waiting = waiting[~hit]
            frontier = np.concatenate(found) if found else frontier[:0]
        seeds = seeds[np.isin(seeds, waiting)]
    return out


def links(fps: DataFrame, bits: int, block: int = BLOCK) -> DataFrame:
    """Spanning forests (u, v) of the links of distinct fingerprints."""
    k = bits // len(SLICES)
    placed = stored(cells(fps, k), "anchors")
    # At most 3 * 4096 rows whatever the input.
    sizes = placed.groupBy("cell").agg(F.count(F.when(F.col("home"), 1)).alias("h"), F.count(F.lit(1)).alias("o"))
    sizes = sizes.select("cell", F.ceil(F.col("h") / block).cast("int").alias("nh"), F.ceil(F.col("o") / block).cast("int").alias("no"))
    sized = placed.join(F.broadcast(sizes), "cell").where("nh > 0")
    number = F.xxhash64("fp")
    own = sized.where("home").select(
        "cell", F.pmod(number, "nh").cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("j"), "home", "fp")
    other = sized.select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("i"),
        F.pmod(number, "no").cast("int").alias("j"), F.lit(False).alias("home"), "fp")
    key = ["cell", "i", "j"]
    dealt = own.union(other).repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, key):
            home = group["home"]
            edges = forest(np.unique(group["fp"][home]).view(np.uint64), np.unique(group["fp"][~home]).view(np.uint64), bits)
            if edges:
                u, v = (np.concatenate(x).view(np.int64) for x in zip(*edges))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of equal keys from sorted rows, whatever the batch bounds."""
    held: list[dict[str, np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: column(batch, n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        change = np.zeros(batch.num_rows - 1, bool)
        for n in key:
            change |= cols[n][1:] != cols[n][:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for s, e in zip(bounds, bounds[1:]):
            now = tuple(cols[n][s] for n in key)
            if held and now != last:
                yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                held = []
            held.append({n: c[s:e] for n, c in cols.items()})
            last = now
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
                    bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """Per document row: doc_id, fingerprint, component_id.

    A null or wordless text has fingerprint zero and is linked like any other.
    Rows with a null id get a component by their fingerprint, but a null id is
    never a component's id unless all its ids are null. Repeated rows are
    returned each; other columns are left out.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = links(distinct.select("fp"), bits)
    of = components(edges).select(F.col("node").alias("fp"), "root")
    rooted = stored(distinct.join(of, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
