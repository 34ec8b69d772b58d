"""Groups of spelling variants by one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols, so that all strings one edit away from a
reduced word can be written down: its deletions, its replacements and
insertions over the symbols, and itself. Two words one edit apart have reduced
words at most one edit apart, so they meet when the neighbourhoods are joined
with the reduced vocabulary; what meets is verified on the words themselves.

Every pair meets once: of a neighbourhood only the strings not after the
reduced word (by length, then alphabet) are looked up, since the others find
the word from their own side. Strings that are no reduced word are dropped by
bitmaps before the join. All steps are DataFrame functions.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import maybe_in, stored

SYMBOLS = 8
LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
DELETE_EVERY = 31
CAPITALS = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
LETTERS = CAPITALS.lower() + "".join(map(chr, range(0xC0, 0x100)))


def reduced(word: Column, symbols: int) -> Column:
    """The word over the reduced alphabet: a letter's symbol is its hash."""
    hashed = "".join(chr(ord("a") + zlib.crc32(c.encode()) % symbols) for c in LETTERS)
    return F.translate(word, LETTERS, hashed)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words long and frequent enough."""
    # A match of the least length or more is a whole run: shorter runs have none, and a match goes on to the run's end.
    long_runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.explode(long_runs).alias("run"))
    runs = runs.select("doc", F.translate("run", CAPITALS, CAPITALS.lower()).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    place = F.pmod("h", F.char_length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    word = F.when(F.pmod("h", F.lit(DELETE_EVERY)) == 0, shorter).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def neighbourhood(word: Column, symbols: int) -> Column:
    """All distinct strings at most one edit from a word over the symbols:
    itself, deletions, replacements and insertions."""
    alphabet = [chr(ord("a") + i) for i in range(symbols)]
    place, gap = F.sequence(F.lit(1), F.char_length(word)), F.sequence(F.lit(1), F.char_length(word) + 1)

    def before(i: Column) -> Column:
        return F.substr(word, F.lit(1), i - 1)

    def with_symbols(places: Column, skipped: int) -> Column:
        return F.flatten(F.transform(places, lambda i: F.array(*[
            F.concat(before(i), F.lit(s), F.substr(word, i + skipped)) for s in alphabet])))

    deleted = F.transform(place, lambda i: F.concat(before(i), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), deleted, with_symbols(place, 1), with_symbols(gap, 0)))


def looked_up(word: Column, symbols: int) -> Column:
    """The part of the neighbourhood that isn't after the word by length, then
    alphabet."""
    size = F.char_length(word)
    return F.filter(neighbourhood(word, symbols), lambda s: (F.char_length(s) < size) | ((F.char_length(s) == size) & (s <= word)))


def near_pairs(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words exactly one edit apart,
    from stored (word, n)."""
    coded = stored(vocabulary.select("word", "n", reduced(F.col("word"), symbols).alias("key")), "spelling-reduced")
    asked = coded.select("word", "n", F.col("key").alias("own"), F.explode(looked_up(F.col("key"), symbols)).alias("key"))
    asked = maybe_in(asked, coded.select("key"), ["key"])
    x, y = asked.alias("x"), coded.alias("y")
    once = (F.col("x.own") != F.col("x.key")) | (F.col("x.word") < F.col("y.word"))
    one_edit = F.levenshtein(F.col("x.word"), F.col("y.word"), 1) == 1
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & once & one_edit)
    ways = F.array(F.struct(F.col("x.word").alias("word"), F.col("y.word").alias("near"), F.col("y.n").alias("near_n")),
                   F.struct(F.col("y.word").alias("word"), F.col("x.word").alias("near"), F.col("x.n").alias("near_n")))
    return met.select(F.explode(ways).alias("way")).select("way.*")


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) from (word, form): the form at the end of the way. Each form
    is ``FACTOR`` times as frequent as its word, so a word of at most ``most``
    occurrences ends few chains; a round doubles the steps taken."""
    steps = math.log(max(most, LEAST_COUNT) / LEAST_COUNT, FACTOR) + 1
    way = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(math.ceil(math.log2(steps)) + 1):
        onward = way.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        way = stored(way.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "spelling-roots")
    return way


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", symbols: int = SYMBOLS) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    Words are runs of letters (A-Z in lower case) as ``words`` finds them; a
    form is the most frequent word one edit away, ties to the smaller one in
    code-point order, if it is ``FACTOR`` times as frequent. A null text has no
    words, a null id counts as the empty text in the hash of a run, and rows
    that repeat are counted each. Other columns are left out; an empty table, or
    one without words, gives no rows.
    """
    vocabulary = stored(words(docs, id_col, text_col), "spelling-words")
    best = near_pairs(vocabulary, symbols).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    known = vocabulary.join(best, "word", "left")
    has_form = F.col("near_n") >= FACTOR * F.col("n")
    known = stored(known.select("word", F.when(has_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(has_form, F.col("near_n")).alias("form_n")), "spelling-forms")
    most = vocabulary.agg(F.max("n")).first()[0] or 0
    ends = roots(known.where("form IS NOT NULL"), most)
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
