"""Benchmark decontamination by Wu-Manber multi-pattern search.

Documents and benchmark items become byte strings of lower-case words, one
space around each word. A pattern is a window of consecutive item words. A
table of the blocks in the patterns' first ``m`` bytes says how far the search
may jump; where it may not jump, patterns that share the block are taken from
a bucket and compared with the document directly.

Patterns are a stated query set: they reach the tasks in blocks of bounded
size, and the documents are read once per block and never shuffled by word.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import column, stored

WINDOW_WORDS = 10
PATTERN_BLOCK_BYTES = 32 << 20
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
# Bytes that are no part of a word become spaces; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32
              for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(words: list[bytes], n: int) -> list[bytes]:
    """Patterns of an item: every run of n words, or the whole shorter item."""
    return [b" %b " % b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


class Group:
    """Search tables for patterns of at least ``m`` bytes."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        # Wu and Manber take blocks of about log(2 m r) letters; words of one
        # language use few of the 256 byte values, so the base is small.
        self.block = b = min(m, max(2, (2 * m * len(patterns)).bit_length() // 3 + 2))
        self.step = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for q in range(b, m + 1):
                key = p[q - b:q]
                self.shift[key] = min(self.shift.get(key, self.step), m - q)
            self.buckets[p[m - b:m]].append(p)

    def find(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        m, b, step, n = self.m, self.block, self.step, len(data)
        jump, buckets = self.shift.get, self.buckets
        end = m
        while end <= n:
            skip = jump(data[end - b:end], step)
            if skip:
                end += skip
                continue
            at = end - m
            for p in buckets[data[end - b:end]]:
                if data.startswith(p, at):
                    yield at, p
            end += 1


class Search:
    """All patterns, grouped by length so that short ones don't shorten the
    jumps of long ones."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.items: dict[bytes, list[str]] = defaultdict(list)
        for item, words in items:
            for p in set(windows(words, window)):
                self.items[p].append(item)
        by_length = defaultdict(list)
        for p in self.items:
            by_length[len(p).bit_length()].append(p)
        self.groups = [Group(ps) for _, ps in sorted(by_length.items())]

    def hits(self, words: list[bytes]) -> tuple[set[int], set[str]]:
        """Places of the words inside occurrences, and the items that occur."""
        data = b" %b " % b" ".join(words)
        places: set[int] = set()
        found: set[str] = set()
        for g in self.groups:
            first = counted = 0  # words before a place; places come in order
            for at, p in g.find(data):
                first, counted = first + data.count(b" ", counted, at), at
                places.update(range(first, first + p.count(b" ") - 1))
                found.update(self.items[p])
        return places, found


def pattern_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list]:
    """Items in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    for item, text in rows.distinct().toLocalIterator():
        block.append((str(item) if item is not None else "null", words_of(text)))
        size += len(text)
        if size > block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS,
                  block_bytes: int = PATTERN_BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, spans (start, end) of hit words, items
    that occur, and n_hit, n_items, items_sha256, contaminated made from them.

    A null text has no words; a null item text gives no pattern and a null item
    id is written ``null``. Repeated rows are judged each; an empty benchmark
    hits nothing. Other columns are left out. A benchmark larger than one block
    takes one pass over the documents per block.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = pattern_blocks(benchmark, item_col, item_text_col, block_bytes)
    block, found = next(blocks, []), None
    while block is not None:
        following = next(blocks, None)
        found = search_block(rows if found is None else found, block, window, keep_text=following is not None)
        if following is not None:
            found = stored(found, "hits")
        block = following
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
        "spans", "items")


def search_block(rows: DataFrame, block: list, window: int, keep_text: bool) -> DataFrame:
    """Search one block of patterns; earlier blocks' spans and items are joined in."""
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, spans array<struct<start:int,end:int>>, items array<string>"
    schema += ", text string" if keep_text else ""
    patterns = rows.sparkSession.sparkContext.broadcast(block)  # about block_bytes of text at most
    again = "spans" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(patterns.value, window)
        for batch in batches:
            n_words, all_spans, all_items = [], [], []
            for i, text in enumerate(column(batch, "text").to_pylist()):
                words = words_of(text)
                places, items = search.hits(words)
                if again:
                    for s in column(batch, "spans")[i].as_py():
                        places.update(range(s["start"], s["end"]))
                    items.update(column(batch, "items")[i].as_py())
                n_words.append(len(words))
                all_spans.append(spans(places))
                all_items.append(sorted(items))
            out = {"doc_id": column(batch, "doc_id"), "n_words": pa.array(n_words, pa.int64()),
                   "spans": pa.array(all_spans, SPANS), "items": pa.array(all_items, pa.list_(pa.string()))}
            if keep_text:
                out["text"] = column(batch, "text")
            yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, schema)


def spans(places: set[int]) -> list[dict]:
    """Runs of consecutive places."""
    out: list[dict] = []
    for p in sorted(places):
        if out and out[-1]["end"] == p:
            out[-1]["end"] = p + 1
        else:
            out.append({"start": p, "end": p + 1})
    return out
