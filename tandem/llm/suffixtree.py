"""Language-model scoring by a probabilistic suffix tree over words.

A state of the tree is a context: the last one to ``depth`` words. The next
word's distribution in a context s of n occurrences takes one off each count and
gives what is left, b = (number of different next words) / n, to the distribution
of the parent, s without its first word:

    P(w | s) = (c(s w) - 1) / n + b P(w | parent)

down to the root, the smoothed frequencies of the words. A context is retained
if its divergence from its parent, the sum over its occurrences of
ln P(w | s) / P(w | parent), reaches ``penalty`` times ln N (N: training
tokens), and so are all its suffixes. A word is scored in the longest suffix of
what came before it that is a state.

A context needs ``penalty`` occurrences to pass that test, as no word has a
probability under 1/N, and next words seen once cancel out of b. So only runs
of words that occur twice, after contexts of ``penalty`` occurrences, are kept,
which is exact. Runs are counted by order: a task counts its batches by sorting
and sends the counts as one binary value per bucket of hashes, which another
task adds up; the longer runs are filtered by bitmaps of the shorter ones.

Every retained context adds to the logarithm ln P(w | s) / P(w | parent), which
depends on the run (s, w) if that was kept and on s alone if not. So a score is
a sum over the runs of a text of one number each. Texts are dealt to shards of
bounded size; a shard asks for the numbers of its different runs, bucket by
bucket, and the answers come back to it in the same order, so what is shuffled
is a key and a number per run and shard, and no run is hot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import column, discard, slices, stored
from tandem.llm.passages import mixed

DEPTH = 3
PENALTY = 4
SMOOTHING = 0.5
FOLDS, HELD_OUT_FOLD = 5, 1
SLOT_BITS = 25
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20  # of text, for the number of buckets
LEAST_BUCKETS = 64
SHARD_BYTES = 6 << 20  # of text that is scored at a time
ROUNDS = 6
PIECE_BITS = 18
LONG_WORD = 64  # bytes; longer words are hashed one by one
PACKED_ROWS = 1 << 18
END = np.uint64(0xE7037ED1A0B428DB)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(id_col: str) -> Column:
    """A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT_FOLD, F.lit(False))


# ---- runs of words ------------------------------------------------------------
# A word's hash takes in its bytes eight at a time, for all words of a piece of
# text at once, so its work grows with the words and not with their letters.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in the bytes, A-Z as a-z, and where they start; a word
    ends at white space and where a text begins."""
    n = len(data)
    space = (data == 32) | (data - np.uint8(9) <= 4)
    border = np.zeros(n + 1, bool)  # before a byte
    border[begins] = border[n] = True
    border[1:] |= space
    border[:-1] |= space
    starts, ends = np.flatnonzero(~space & border[:-1]), np.flatnonzero(~space & border[1:]) + 1
    lowered = data.tobytes().lower() + bytes(8)
    eight = np.ndarray((n + 1,), "<u8", lowered, strides=(1,))  # the eight bytes from each place on
    out = np.empty(len(starts), np.uint64)
    for done in range(0, len(starts), 1 << PIECE_BITS):
        s, size = starts[done:done + (1 << PIECE_BITS)], (ends - starts)[done:done + (1 << PIECE_BITS)]
        h = mixed(size.astype(np.uint64) * _RIGHT + (eight[s] & _FIRST_BYTES[np.minimum(size, 8)]))
        more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        at = 8
        while len(more):
            left = size[more] - at
            h[more] = mixed(h[more] * _LEFT + (eight[s[more] + at] & _FIRST_BYTES[np.minimum(left, 8)]))
            more, at = more[left > 8], at + 8
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            h[i] = xxhash.xxh3_64_intdigest(lowered[s[i]:s[i] + size[i]])
        out[done:done + len(s)] = h
    return out, starts


def concatenated(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, words and an end for each, one after the
    other, and whose they are; a null text is an empty one."""
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None else np.empty(0, np.uint8)
    bounds -= bounds[0]
    words, starts = word_hashes(data, bounds[:-1])
    sizes = np.diff(np.searchsorted(starts, bounds)) + 1
    out = np.full(len(words) + len(texts), END)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes) - 1] = False
    out[inside] = words
    return out, np.repeat(np.arange(len(texts), dtype=np.int32), sizes)


def joined(prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """The hash of a run from those of the run without its last and its first word."""
    return mixed(prefix * _LEFT + (suffix ^ (suffix >> np.uint64(29))) * _RIGHT)


def runs(words: np.ndarray, owner: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, prefix, suffix, owner) of all runs of 2 to ``order`` words."""
    now = words
    for g in range(2, order + 1):
        inside = owner[:len(owner) - g + 1] == owner[g - 1:]
        prefix, suffix = now[:-1], now[1:]
        now = joined(prefix, suffix)
        yield now[inside], prefix[inside], suffix[inside], owner[:len(inside)][inside]


# ---- bitmaps ------------------------------------------------------------------
def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of the slots that the hashes in ``hash`` fall into: 4 MB whatever
    their number, so that they fit the driver and a broadcast."""
    slot = F.call_function("shiftrightunsigned", F.col("hash"), F.lit(64 - SLOT_BITS))
    page, bit = F.call_function("shiftright", slot, F.lit(15)).cast("int"), slot.bitwiseAND(F.lit(32767)).cast("int")
    pages = hashes.select(page.alias("page"), bit.alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(1 << (SLOT_BITS - 3), np.uint8)
    for r in pages.toLocalIterator():
        out[r["page"] * 4096:(r["page"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - SLOT_BITS)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


# ---- counting -----------------------------------------------------------------
def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys side by side, and where each group begins."""
    by = np.argsort(keys)
    ordered = keys[by]
    return by, np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), ordered[1:] != ordered[:-1]]))


def counted(rows: DataFrame, order: int, bucket_bits: int, contexts=None, repeated=None) -> DataFrame:
    """(hash, prefix, suffix, n) of the runs of ``order`` words that occur twice
    or more, their prefix and suffix marked in the bitmaps that ``contexts`` and
    ``repeated`` broadcast; of single words (hash, n), all of them."""
    single = order == 1
    names = ["hash"] if single else ["prefix", "suffix"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                if not batch.num_rows:
                    continue
                words, owner = concatenated(column(batch, "text"))
                if single:
                    keys, n = np.unique(words, return_counts=True)
                    cols = [keys]
                else:
                    for found in runs(words, owner, order):
                        pass
                    key, prefix, suffix, _ = found
                    wanted = marked(contexts.value, prefix)
                    wanted[wanted] = marked(repeated.value, suffix[wanted])
                    key = key[wanted]
                    by, starts = grouped(key)
                    first, n = by[starts], np.diff(starts, append=len(by))
                    keys, cols = key[first], [prefix[wanted][first], suffix[wanted][first]]
                bucket = (keys >> np.uint64(64 - bucket_bits)).astype(np.int32)
                if not single:  # equal prefixes side by side are stored in less space
                    low = np.uint64(bucket_bits)
                    by = np.argsort(keys >> np.uint64(64 - bucket_bits) << np.uint64(64 - bucket_bits) | cols[0] >> low)
                    bucket = bucket[by]
                    cols, n = [c[by] for c in cols], n[by]
                used, starts = np.unique(bucket, return_index=True)
                ends = [*starts[1:].tolist(), len(n)]
                cut = [[x[s:e].tobytes() for s, e in zip(starts.tolist(), ends)] for x in (*cols, n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(c, pa.binary()) for c in cut)], ["bucket", *names, "n"])

    def add(table: pa.Table) -> pa.Table:
        cols = [np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64) for c in names]
        n = np.frombuffer(b"".join(table.column("n").to_pylist()), np.int32)
        keys = cols[0] if single else joined(*cols)
        by, starts = grouped(keys)
        first, n = by[starts], np.diff(np.concatenate([[0], np.cumsum(n[by], dtype=np.int64)])[np.append(starts, len(by))])
        keep = n >= (1 if single else 2)
        out = [keys[first], *([] if single else [c[first] for c in cols])]
        return pa.table([*(pa.array(c[keep].view(np.int64)) for c in out), pa.array(n[keep])], names=["hash", *([] if single else names), "n"])

    sent = rows.mapInArrow(count, "bucket int, " + "".join(f"{c} binary, " for c in names) + "n binary")
    return sent.groupBy("bucket").applyInArrow(add, "hash long, " + ("" if single else "prefix long, suffix long, ") + "n long")


# ---- the tree -----------------------------------------------------------------
def grow(rows: DataFrame, depth: int, penalty: float) -> dict:
    """The fitted tree of the texts in ``text``: N, V, per order the table of the
    numbers (hash, score, base) that runs add to a score, and the states. Joins
    hash the side that has each key once, in place of sorting both."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BUCKETS.bit_length() - 1, math.ceil(math.log2(size / BUCKET_BYTES + 1)))
    words = stored(counted(rows, 1, bits), "tree-words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    mass = total + SMOOTHING * (distinct + 1)
    least = math.ceil(penalty)
    levels = [words.select("hash", "n", ((F.col("n") + SMOOTHING) / F.lit(mass)).alias("p"))]
    contexts = []
    for order in range(2, depth + 2):
        below = levels[-1]
        marks = [spark.sparkContext.broadcast(bitmap(below.where(F.col("n") >= k).select("hash"))) for k in (least, 2)]
        found = stored(counted(rows, order, bits, *marks), "tree-runs")
        for m in marks:
            m.unpersist()
        own = below.where(F.col("n") >= least).select(F.col("hash").alias("prefix"), F.col("n").alias("size"), *(["suffix"] if order > 2 else []))
        repeats = found.groupBy("prefix").agg(F.sum("n").alias("again"), F.sum(F.col("n") - 1).alias("off"))
        context = stored(repeats.hint("shuffle_hash").join(own, "prefix").select(
            "prefix", *(["suffix"] if order > 2 else []), "size", (F.col("size") - F.col("again")).alias("once"),
            ((F.col("size") - F.col("off")) / F.col("size")).alias("b")), "tree-contexts")
        parent = below.select(F.col("hash").alias("suffix"), F.col("p").alias("below"))
        level = found.join(context.select("prefix", "size", "b").hint("shuffle_hash"), "prefix").join(parent.hint("shuffle_hash"), "suffix").select(
            "hash", "prefix", "suffix", "n", ((F.col("n") - 1) / F.col("size") + F.col("b") * F.col("below")).alias("p"), "below", "b")
        levels.append(stored(level, "tree-levels"))
        discard(found)
        contexts.append(context)
    threshold = penalty * math.log(max(total, 2))
    states: list[DataFrame] = []
    for k in range(depth, 0, -1):
        gain = levels[k].groupBy("prefix").agg(F.sum(F.col("n") * F.ln(F.col("p") / F.col("below"))).alias("gain"))
        passed = gain.hint("shuffle_hash").join(contexts[k - 1], "prefix").where(F.col("gain") + F.col("once") * F.ln("b") >= threshold).select("prefix")
        if states:
            passed = passed.union(states[-1].select(F.col("suffix").alias("prefix"))).distinct()
        state = contexts[k - 1].join(passed.hint("shuffle_hash"), "prefix").select("prefix", *(["suffix"] if k > 1 else []), F.ln("b").alias("ln_b"))
        states.append(stored(state, "tree-states"))
    states.reverse()
    numbers = [states[0].select(F.col("prefix").alias("hash"), F.col("ln_b").alias("number"))]
    for order in range(2, depth + 2):
        at = states[order - 2].select("prefix", F.lit(True).alias("state"))
        kept = levels[order - 1].join(at.hint("shuffle_hash"), "prefix", "left")
        number = F.when(F.col("state"), F.ln(F.col("p") / F.col("below")) - F.ln("b")).otherwise(F.lit(0.0))
        if order <= depth:
            kept = kept.join(states[order - 1].select(F.col("prefix").alias("hash"), "ln_b").hint("shuffle_hash"), "hash", "left")
            number = number + F.coalesce("ln_b", F.lit(0.0))
        numbers.append(stored(kept.select("hash", number.alias("number")).where("number <> 0"), "tree-numbers"))
    for done in (*levels[1:], *contexts):
        discard(done)
    return {"total": total, "distinct": distinct, "mass": mass, "bits": bits, "words": words, "numbers": numbers, "states": states}


# ---- scoring ------------------------------------------------------------------
WORDS, RUNS = 0, 1  # kinds of numbers: counts of words, and what runs add to a score


def needed(texts: pa.Array, marks: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """What texts need to be scored, a kind at a time: the kind and, per
    occurrence, the hash and whose it is."""
    words, owner = concatenated(texts)
    yield WORDS, words, owner
    kept, whose = [], []
    for bits, (key, of) in zip(marks, chain([(words, owner)], ((key, of) for key, _, _, of in runs(words, owner, len(marks))))):
        known = marked(bits, key)
        kept.append(key[known])
        whose.append(of[known])
    yield RUNS, np.concatenate(kept), np.concatenate(whose)


def different(hashes: np.ndarray) -> np.ndarray:
    """The different hashes in order, by a sort that carries no places along."""
    ordered = np.sort(hashes)
    return ordered[np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]])]


def whole(chunks: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(chunks.chunks) if chunks.num_chunks else pa.array([], pa.string())


def in_buckets(keys: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted hashes, cut by their first bits."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    used, starts = np.unique(bucket, return_index=True)
    for b, s, e in zip(used.tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        yield b, keys[s:e]


def cut(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(kind, hash, number) as (kind, bucket, hashes, numbers), a row per bucket
    of about ``PACKED_ROWS`` rows."""
    held, size = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            size += batch.num_rows
        if not size or batch is not None and size < PACKED_ROWS:
            continue
        kinds, hashes, numbers = (np.concatenate([column(b, c).to_numpy() for b in held]) for c in ("kind", "hash", "number"))
        held, size, out = [], 0, []
        for kind in np.unique(kinds).tolist():
            keys, number = hashes[kinds == kind].view(np.uint64), numbers[kinds == kind]
            by = np.argsort(keys)
            number, at = number[by], 0
            for bucket, part in in_buckets(keys[by], bits):
                out.append((kind, bucket, part.tobytes(), number[at:at + len(part)].tobytes()))
                at += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                         ["kind", "bucket", "hashes", "numbers"])


def scored(rows: DataFrame, tree: dict) -> DataFrame:
    """(id, text) -> (id, n_tokens, n_known, base, score), natural logarithms; one
    row per row."""
    spark, bits = rows.sparkSession, tree["bits"]
    marks = spark.sparkContext.broadcast([bitmap(n.select("hash")) for n in tree["numbers"]])
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int"))

    def ask(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        out = [(shard, kind, bucket, part.tobytes()) for kind, hashes, _ in needed(whole(table.column("text")), marks.value)
               for bucket, part in in_buckets(different(hashes), bits)]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                        names=["shard", "kind", "bucket", "keys"])

    def pack(numbers: pa.Table) -> pa.Table:
        """A bucket's hashes in order, and their numbers, as one row."""
        known, number = (np.frombuffer(b"".join(numbers.column(c).to_pylist()), t) for c, t in (("hashes", np.uint64), ("numbers", np.float64)))
        by = np.argsort(known)
        return pa.table([*(numbers.column(c)[:1] for c in ("kind", "bucket")), pa.array([known[by].tobytes()], pa.binary()),
                         pa.array([number[by].tobytes()], pa.binary())], names=["kind", "bucket", "hashes", "numbers"])

    def answer(questions: pa.Table, numbers: pa.Table) -> pa.Table:
        known, number = (np.frombuffer(b"".join(numbers.column(c).to_pylist()), t) for c, t in (("hashes", np.uint64), ("numbers", np.float64)))
        out = []
        for keys, kind in zip(questions.column("keys").to_pylist(), questions.column("kind").to_pylist()):
            keys = np.frombuffer(keys, np.uint64)
            found = np.zeros(len(keys))
            if len(known):
                at = np.searchsorted(known, keys)
                at[at == len(known)] = 0
                found = np.where(known[at] == keys, number[at], 0.0)
            out.append((found.astype(np.int64) if kind == WORDS else found).tobytes())
        return pa.table([*(questions.column(c) for c in ("shard", "kind", "bucket")), pa.array(out, pa.binary())], names=["shard", "kind", "bucket", "numbers"])

    table = tree["words"].select(F.lit(WORDS).alias("kind"), "hash", F.col("n").cast("double").alias("number"))
    for n in tree["numbers"]:
        table = table.union(n.select(F.lit(RUNS), "hash", "number"))
    packed = "kind int, bucket int, hashes binary, numbers binary"
    table = table.mapInArrow(lambda batches: cut(batches, bits), packed)  # few rows are shuffled
    table = stored(table.groupBy("kind", "bucket").applyInArrow(pack, packed), "tree-buckets")
    mass, id_kind = tree["mass"], rows.schema["id"].dataType

    def add(texts: pa.Table, numbers: pa.Table) -> pa.Table:
        given = {(k, b): v for k, b, v in zip(*(numbers.column(c).to_pylist() for c in ("kind", "bucket", "numbers")))}
        every, n = whole(texts.column("text")), len(texts)
        sums = {}
        for kind, hashes, owner in needed(every, marks.value):
            keys, place = np.unique(hashes, return_inverse=True)
            got = b"".join(given[kind, b] for b, _ in in_buckets(keys, bits))
            if kind == WORDS:
                count = np.frombuffer(got, np.int64)
                sums["n_tokens"] = np.bincount(owner, minlength=n)
                sums["n_known"] = np.bincount(owner[count[place] > 0], minlength=n)
                sums["base"] = np.bincount(owner, np.log((count + SMOOTHING) / mass)[place], n)
            else:
                sums["score"] = sums["base"] + np.bincount(owner, np.frombuffer(got, np.float64)[place], n)
        return pa.table([texts.column("id"), *(pa.array(sums[c]) for c in ("n_tokens", "n_known", "base", "score"))],
                        names=["id", "n_tokens", "n_known", "base", "score"])

    done = []
    for part in range(ROUNDS):  # one after the other, so that only a part of the keys is on disk
        texts = dealt.where(F.pmod("shard", F.lit(ROUNDS)) == part)
        questions = texts.groupBy("shard").applyInArrow(ask, "shard int, kind int, bucket int, keys binary")
        answers = questions.groupBy("kind", "bucket").cogroup(table.groupBy("kind", "bucket")).applyInArrow(
            answer, "shard int, kind int, bucket int, numbers binary")
        scores = texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(
            add, f"id {id_kind.simpleString()}, n_tokens long, n_known long, base double, score double")
        done.append(stored(scores, "tree-scores"))
    return reduce(DataFrame.union, done)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, penalty: float = PENALTY) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probabilities of the whole text and its end).

    Texts that are not held out are learnt from, repeated rows each time; a null
    or empty text is its end alone, a null id is never held out. With nothing to
    learn from, N and V are 0 and the base is that of the one unknown token.
    Other columns are left out; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    tree = grow(docs.where(~held_out(id_col)).select(F.col(text_col).cast("string").alias("text")), depth, penalty)
    out = scored(rows, tree)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "n_tokens", "n_known",
                      F.lit(tree["total"]).cast("long").alias("train_tokens"), (F.col("base") / math.log(10)).alias("base_score"),
                      (F.col("score") / math.log(10)).alias("score"))
