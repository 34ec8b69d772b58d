"""Line deduplication by an exact set-similarity join, DataFrame functions only.

A line is its set of lower-case words. Words are ordered by rarity, and two
lines of Jaccard similarity ``t`` or more share a word among the rarest
``n - ceil(t n) + 1`` words of the longer one and the rarest
``n - ceil(2 t n / (1 + t)) + 1`` of the shorter one (prefix filter); their
sizes and the places of the shared word bound the overlap (length and
positional filter). What is left is verified on the whole sets.

Equal lines are joined into one class first. Rarity is read from a fixed table
of word counts by hash, whose size does not grow with the words; any order
gives the same result. A line is removed if an earlier line (by document,
then line number) is similar; so it is enough to find one: lines are first
compared with the earliest line that shares two of their three rarest words,
then with the earliest one left that shares a word of their prefixes. That
settles large groups of copies without pairing them up, and only lines not
settled by it probe the join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import discard, flagged, maybe_in, stored

SIMILARITY = 0.8
RARITY_BUCKETS = 1 << 18
PASSES = 5
SKETCH_LONGS = 4
WORD_ROUNDS = 2


def spaced(text: Column, white: str = "\t\r\f\v") -> Column:
    """The text in lower case with other white space as spaces."""
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit(" ")), white, F.lower(text))


def words_array(line: Column) -> Column:
    """Distinct lower-case words of a line, split at white space."""
    return F.array_remove(F.array_distinct(F.split(spaced(line), " ")), "")


def rarity_table(rows: DataFrame) -> bytes:
    """One byte per hash bucket: 4 times the binary logarithm of its count."""
    word = F.explode(F.split(spaced(F.col("text"), "\n\t\r\f\v"), " ")).alias("word")
    bucket = F.pmod(F.xxhash64("word"), F.lit(RARITY_BUCKETS)).cast("int")
    counts = rows.select(word).where("word <> ''").groupBy(bucket.alias("bucket")).count()
    level = F.least(F.lit(127), F.floor(4 * F.log2(F.col("count")))).cast("int")
    group = F.col("bucket").bitwiseAND(F.lit(63)).alias("group")
    out = bytearray(RARITY_BUCKETS)
    for _, entries in counts.groupBy(group).agg(F.collect_list(F.col("bucket") * 128 + level)).collect():  # RARITY_BUCKETS numbers at most
        for x in entries:
            out[x >> 7] = x & 127
    return bytes(out)


def document(id_col: str, text_col: str) -> Column:
    """What names and orders a document: its id, null last, then a hash of its
    text, so that rows that share an id or have none are told apart."""
    given = F.col(id_col).cast("long")
    return F.struct(given.isNull().alias("last"), F.coalesce(given, F.lit(0)).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))


def occurrences(rows: DataFrame) -> DataFrame:
    """(doc, pos, line) of every line that has a word."""
    return rows.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"[^ \t\r\f\x0B]"))


def line_classes(rows: DataFrame) -> DataFrame:
    """(line, doc, pos): the first occurrence of every distinct line."""
    return occurrences(rows).groupBy("line").agg(F.min(F.struct("doc", "pos")).alias("at")).select("line", "at.doc", "at.pos")


def signatures(classes: DataFrame, rarity: bytes, t: float) -> DataFrame:
    """Per class its first place, key, size, parity bitmaps of its words and
    hashes of its rarest words. A word is one number: its rarity in the upper
    bits, then its hash."""
    levels = F.split(F.lit(",".join(map(str, rarity))), ",").cast("array<bigint>")  # folded into a constant

    def number(word: Column) -> Column:
        h = F.xxhash64(word)
        level = F.get(levels, F.pmod(h, F.lit(RARITY_BUCKETS)).cast("int"))
        return F.call_function("shiftleft", level, F.lit(56)).bitwiseOR(F.call_function("shiftrightunsigned", h, F.lit(8)))

    words = F.array_remove(F.split(spaced(F.col("line")), " "), "")
    ordered = F.sort_array(F.array_distinct(F.transform(words, number)))
    sized = classes.select("doc", "pos", F.unhex(F.md5("line")).alias("key"), ordered.alias("words")).select(
        "*", F.size("words").alias("n"))
    bits = F.struct(*[parity(F.col("words"), k).alias(f"b{k}") for k in range(SKETCH_LONGS)])
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(t) - 1e-9).cast("int") + 1
    return sized.select("doc", "pos", "key", "n", bits.alias("bits"),
                        F.transform(F.slice("words", F.lit(1), keep), lambda w: F.hash(w)).alias("prefix"))


def parity(hashes: Column, k: int) -> Column:
    """The k-th of ``SKETCH_LONGS`` parity bitmaps of a set: the low six
    bits of a word's hash say which bit, the two above them which bitmap."""
    def add(a: Column, h: Column) -> Column:
        own = F.call_function("shiftrightunsigned", h, F.lit(6)).bitwiseAND(F.lit(SKETCH_LONGS - 1)) == k
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
        return F.when(own, a.bitwiseXOR(bit)).otherwise(a)

    return F.aggregate(hashes, F.lit(0).cast("long"), add)


def may_match(n: Column, bits: Column, m: Column, other: Column, t: float) -> Column:
    """Sizes, and words that sit in one of the sets only: each parity bit that
    differs stands for at least one of them. One bitmap of 64 bits is full at
    a hundred words and would let all pairs of long lines pass."""
    overlap = t / (1 + t) * (n + m) - 1e-9
    similar_size = F.least(n, m) >= t * F.greatest(n, m) - 1e-9
    apart = sum(F.bit_count(bits[f"b{k}"].bitwiseXOR(other[f"b{k}"])) for k in range(SKETCH_LONGS))
    return similar_size & (apart <= n + m - 2 * F.ceil(overlap))


def by_leader(sigs: DataFrame, keys: Column, t: float) -> DataFrame:
    """Each line with the earliest line of each of its keys."""
    dealt = sigs.select("doc", "pos", "n", "bits", F.explode(keys).alias("key"))
    first = dealt.groupBy("key").agg(F.min(F.struct("doc", "pos", "n", "bits")).alias("l"), F.count(F.lit(1)).alias("size"))
    first = stored(first.where("size > 1").select("key", "l.*"), "line-leaders")
    dealt = maybe_in(dealt, first, ["key"])
    same = (F.col("x.doc") == F.col("y.doc")) & (F.col("x.pos") == F.col("y.pos"))
    near = may_match(F.col("x.n"), F.col("x.bits"), F.col("y.n"), F.col("y.bits"), t)
    return dealt.alias("x").join(first.alias("y"), F.col("x.key") == F.col("y.key")).where(~same & near).select(
        F.col("x.doc").alias("doc"), F.col("x.pos").alias("pos"), F.col("y.doc").alias("doc2"), F.col("y.pos").alias("pos2")).distinct()


def two_rarest() -> Column:
    """Keys of a line: two of its three rarest words."""
    p = F.col("prefix")
    twos = [F.when(F.size(p) >= j, F.xxhash64(F.least(p[i - 1], p[j - 1]), F.greatest(p[i - 1], p[j - 1])))
            for i, j in ((1, 2), (1, 3), (2, 3))]
    return F.array_compact(F.array(*twos, F.when(F.size(p) == 1, p[0].cast("long"))))


def words_of(part: int, t: float) -> Column:
    """Keys of a line: the words of one pass in its prefix, with its size class."""
    own = F.filter("prefix", lambda w: F.pmod(w, F.lit(PASSES)) == part)
    return F.transform(own, lambda w: F.xxhash64(w, band(F.col("n"), t)))


def settle(sigs: DataFrame, rows: DataFrame, t: float) -> DataFrame:
    """(doc, pos) of lines similar to a leader, the earliest line that shares a
    key and is not settled yet. Copies that have words of their own as their
    rarest ones share no two of these; the words of a pass find them, and each
    further round leaves a part of the lines of a group that the one before it left."""
    settled = verified(stored(by_leader(sigs, two_rarest(), t), "line-pairs"), rows, t)
    for part in range(WORD_ROUNDS):
        left = flagged(sigs, settled, ["doc", "pos"]).where("NOT maybe__").select(*sigs.columns)
        more = verified(stored(by_leader(left, words_of(part, t), t), "line-pairs"), rows, t)
        settled = settled.union(more)  # lines of different rounds
    return settled


def band(size: Column, t: float) -> Column:
    """Number of a line's size class; the similar sizes of a line span few of them."""
    return F.floor(F.ln(size) / math.log(1 / t)).cast("int")


def by_prefix(marked: DataFrame, t: float) -> DataFrame:
    """Pairs of a line not settled yet and an earlier line that pass all filters.
    The longer line of a pair probes with its whole prefix, the shorter one is
    indexed by its shorter prefix, under every size class whose lines can be
    similar to it, so that lines of other lengths never meet. The words are
    dealt to ``PASSES`` joins one after the other, so that only a part of the
    prefixes is on disk at a time."""
    parts = [stored(prefix_pairs(marked, t, part), "line-pairs") for part in range(PASSES)]
    pairs = stored(reduce(DataFrame.union, parts).distinct(), "line-pairs")
    for done in parts:
        discard(done)
    return pairs


def prefix_pairs(marked: DataFrame, t: float, part: int) -> DataFrame:
    """The prefix join on the words of one pass."""
    unsettled = F.lit(1) - F.coalesce("done", F.lit(0))
    short = F.col("n") - F.ceil(2 * t / (1 + t) * F.col("n") - 1e-9).cast("int") + 1

    def postings(prefix: Column, bands: Column) -> DataFrame:
        """One number holds size, place in the prefix and whether unsettled;
        the key is a word and a size class."""
        each = marked.select("doc", "pos", "n", "bits", unsettled.alias("open"), F.posexplode(prefix).alias("place", "word"))
        each = each.where(F.pmod("word", F.lit(PASSES)) == part)
        about = F.call_function("shiftleft", F.col("n").cast("long"), F.lit(32)) + 2 * F.col("place") + F.col("open")
        keyed = each.select("*", about.alias("about"), F.explode(bands).alias("band"))
        return keyed.select(F.xxhash64("word", "band").alias("key"), "doc", "pos", "bits", "about")

    def unpacked(side: str) -> tuple[Column, Column, Column]:
        about = F.col(f"{side}.about")
        low = about.bitwiseAND(F.lit((1 << 32) - 1))
        return F.call_function("shiftright", about, F.lit(32)), F.call_function("shiftright", low, F.lit(1)), low.bitwiseAND(F.lit(1)) == 1

    own, largest = F.col("n"), F.floor(F.col("n") / t + 1e-6)
    x = postings(F.col("prefix"), F.array(band(own, t))).alias("x")
    y = postings(F.slice("prefix", F.lit(1), short), F.sequence(band(own, t), band(largest, t))).alias("y")
    (n, i, open_x), (m, j, open_y) = unpacked("x"), unpacked("y")
    earlier = (F.col("y.doc") < F.col("x.doc")) | ((F.col("y.doc") == F.col("x.doc")) & (F.col("y.pos") < F.col("x.pos")))
    longer = (n > m) | ((n == m) & earlier)
    needed = F.when(earlier, open_x).otherwise(open_y)
    positional = F.least(n - i, m - j) >= F.ceil(t / (1 + t) * (n + m) - 1e-9)
    near = may_match(n, F.col("x.bits"), m, F.col("y.bits"), t)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & near & positional & longer & needed)
    later, first = F.struct("x.doc", "x.pos"), F.struct("y.doc", "y.pos")
    pairs = pairs.select(F.when(earlier, later).otherwise(first).alias("l"), F.when(earlier, first).otherwise(later).alias("e"))
    return pairs.select("l.doc", "l.pos", F.col("e.doc").alias("doc2"), F.col("e.pos").alias("pos2")).distinct()


def sketch(hashes: Column) -> Column:
    """Four parity bitmaps; a word's hash says which, and which bit."""
    def parity(k: int) -> Column:
        own = F.filter(hashes, lambda h: F.pmod(h, F.lit(SKETCH_LONGS)) == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, h: a.bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", h, F.lit(8)).bitwiseAND(F.lit(63)))))

    return F.array(*[parity(k) for k in range(SKETCH_LONGS)])


def verified(pairs: DataFrame, rows: DataFrame, t: float) -> DataFrame:
    """(doc, pos) of the later lines of the stored pairs whose word sets are
    similar; the pairs are used up. Sketches of the lines, which never reject a
    similar pair, are compared before the texts are."""
    named = pairs.select("doc", "pos").union(pairs.select("doc2", "pos2")).distinct()
    named = stored(named, "line-names")
    about = maybe_in(rows, named.select("doc").distinct(), ["doc"])  # before texts are split
    lines = maybe_in(occurrences(about), named, ["doc", "pos"]).join(named, ["doc", "pos"]).select("doc", "pos", "line")
    lines = lines.distinct().withColumn("hashes", F.transform(words_array(F.col("line")), lambda w: F.hash(w)))
    lines = stored(lines.select("doc", "pos", "line", F.size("hashes").alias("n"), sketch(F.col("hashes")).alias("sketch")), "line-texts")

    def sides(of: DataFrame, *carried: str) -> DataFrame:
        """The pairs with columns of both lines, as the structs x and y."""
        one = lines.select("doc", "pos", F.struct(*carried).alias("x"))
        two = lines.select(F.col("doc").alias("doc2"), F.col("pos").alias("pos2"), F.struct(*carried).alias("y"))
        return of.join(one, ["doc", "pos"]).join(two, ["doc2", "pos2"])

    apart = sum(F.bit_count(F.col("x.sketch")[k].bitwiseXOR(F.col("y.sketch")[k])) for k in range(SKETCH_LONGS))
    either = F.col("x.n") + F.col("y.n")
    near = sides(pairs, "n", "sketch").where(apart <= either - 2 * F.ceil(either * (t / (1 + t)) - 1e-9))
    near = stored(near.select("doc", "pos", "doc2", "pos2"), "line-near")
    # The lines travel as text, which takes a quarter of its words as an array.
    words, words2 = (F.array_remove(F.split(spaced(F.col(f"{side}.line")), " "), "") for side in "xy")
    common = F.size(F.array_intersect(words, words2))
    similar = sides(near, "n", "line").where(common * (1 + t) >= either * t - 1e-9)
    similar = stored(similar.select("doc", "pos").distinct(), "lines-similar")
    for done in (pairs, named, lines, near):
        discard(done)
    return similar


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: float = SIMILARITY) -> DataFrame:
    """(doc, pos) of every line that goes; pos counts lines from 0."""
    rows = docs.where(F.col(text_col).isNotNull()).select(
        document(id_col, text_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    sigs = stored(signatures(line_classes(rows), rarity_table(rows), t), "line-signatures")
    settled = settle(sigs, rows, t)
    marked = stored(sigs.join(settled.withColumn("done", F.lit(1)), ["doc", "pos"], "left"), "line-marked")
    discard(sigs)
    similar = settled.union(verified(by_prefix(marked, t), rows, t)).withColumn("gone", F.lit(True))
    first = marked.select("doc", "pos", "key").join(similar, ["doc", "pos"], "left").select(
        F.col("doc").alias("doc1"), F.col("pos").alias("pos1"), "key", F.coalesce("gone", F.lit(False)).alias("gone"))
    every = occurrences(rows).select("doc", "pos", F.unhex(F.md5("line")).alias("key"))
    stays = (F.col("doc") == F.col("doc1")) & (F.col("pos") == F.col("pos1")) & ~F.col("gone")
    gone = stored(every.join(first, "key").where(~stays).select("doc", "pos"), "lines-gone")
    discard(marked)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: float = SIMILARITY) -> DataFrame:
    """The documents with similar later lines removed from the text, all columns
    kept, plus n_lines_removed.

    Blank lines and null texts stay as they are; a document may become empty.
    Ids are integers; rows with a null id come last, and rows of one id are
    ordered by a hash of their text. Only rows that share id and text count as
    one document. An empty table gives no rows.
    """
    gone = removed_lines(docs, id_col, text_col, t).groupBy("doc").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("doc").alias("gone_doc__"), F.col("gone").alias("gone_lines__"))
    of = document(id_col, text_col) == F.col("gone_doc__")
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains("gone_lines__", i))
    text = F.when(F.col("gone_lines__").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = docs.join(gone, of, "left")
    return out.select(*[text.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns],
                      F.coalesce(F.size("gone_lines__"), F.lit(0)).alias("n_lines_removed"))
