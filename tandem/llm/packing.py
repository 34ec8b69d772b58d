"""Best-fit packing of token sequences.

Bounded-space online best fit: pieces of a shard come one by one, a piece goes
to the open bin it fills best, and when more than ``open_bins`` bins are open
the fullest one closes. Open bins are found by a bitset with one bit per free
space, so a placement costs a shift and a lowest-bit lookup.

A shard is one Spark partition of piece lengths; the ids themselves are never
shuffled. Every shard leaves at most ``open_bins`` unfilled sequences.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import column, shards, slices

SEQUENCE_TOKENS = 2048
SEPARATOR_ID = 0
OPEN_BINS = 4096
DOCS_PER_SHARD = 16_000
BATCH_BYTES = 1 << 20
CACHED_WORDS = 250_000  # a worker keeps them between stages, about 200 bytes each
WORDS_PER_CALL = 1000
OTHER_SPACE = re.compile(r" (?:\s|\Z)").search


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; every machine has them installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    ``path`` is the tokenizer's file, ``ranks`` holds the same vocabulary as
    byte strings. A space after which no white space follows always begins a
    new word of the tokenizer, so a text cut before such spaces gives the ids
    of the whole. Words are merged by the ranks once, many in one call, and
    then looked up; the cache is emptied when it holds ``CACHED_WORDS`` words.
    Texts with other spaces, or that spell a token added to the vocabulary, go
    to the tokenizer whole.
    """

    def __init__(self, path: str, ranks: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A text that spells one of the vocabulary's own tokens gets that token's id.
        self.has_own_token = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)").search
        with open(ranks, "rb") as lines:
            order = {base64.b64decode(token): int(i) for token, i in map(bytes.split, lines)}
        self.merge = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=order,
                                       special_tokens={}).encode_ordinary
        self.n_bytes = np.zeros(max(order.values()) + 1, np.int64)
        for token, i in order.items():
            self.n_bytes[i] = len(token)
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), WORDS_PER_CALL):
            part = words[at:at + WORDS_PER_CALL]
            ids = np.array(self.merge(" " + " ".join(part)), "<u4")
            ends = np.cumsum([len(w.encode()) + 1 for w in part])
            cuts = (4 * (np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1)).tolist()
            data = ids.tobytes()
            self.known.update(zip(part, [data[s:e] for s, e in zip([0, *cuts], cuts)]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        out, found, lacking, other = [b""] * len(texts), {}, set(), []
        for i, text in enumerate(texts):
            if text and (OTHER_SPACE(text) or self.has_own_token(text)):
                other.append(i)
            elif text:
                head, *rest = text.split(" ")
                out[i] = np.array(self.merge(head), "<u4").tobytes()
                found[i] = rest, (got := list(map(self.known.get, rest)))
                if None in got:
                    lacking.update([w for w, g in zip(rest, got) if g is None])
        self._learn(list(lacking))
        for i, (rest, got) in found.items():
            if None in got:
                got = [self.known[w] if g is None else g for w, g in zip(rest, got)]
            out[i] += b"".join(got)
        for i, e in zip(other, self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out


@cache
def worker_encoder(path: str, ranks: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker."""
    return WordEncoder(path, ranks)


def piece_bounds(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, a shorter one first."""
    if n <= limit:
        return [(0, n)]
    first = n % limit
    bounds = [(0, first)] if first else []
    return bounds + [(s, limit) for s in range(first, n, limit)]


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, path: str, ranks: str,
                     limit: int, with_ids: bool) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if with_ids else ""
    end = np.array([SEPARATOR_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, ranks)
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                rows, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, data in enumerate(encoder.encode(column(batch, "text").to_pylist())):
                    data += end
                    for k, (s, n) in enumerate(piece_bounds(len(data) // 4, limit)):
                        part = data[4 * s:4 * (s + n)]
                        rows.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype("i4"))
                out = [column(batch, "doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema)


class Bins:
    """Open bins by free space; ``place`` returns (bin number, offset)."""

    def __init__(self, limit: int, open_bins: int):
        self.limit, self.most = limit, open_bins
        self.free: list[list[int]] = [[] for _ in range(limit + 1)]
        self.bits = self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.limit, self.made
            self.made += 1
        left = space - length
        if left:
            self._put(left, number)
            if self.open > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.limit - space

    def _take(self, space: int) -> int:
        number = self.free[space].pop()
        self.open -= 1
        if not self.free[space]:
            self.bits ^= 1 << space
        return number

    def _put(self, space: int, number: int) -> None:
        if not self.free[space]:
            self.bits |= 1 << space
        self.free[space].append(number)
        self.open += 1


def pack(pieces: DataFrame, limit: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS,
         n_shards: int = 1) -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` of 1 to limit.

    Rows are dealt to shards by all their columns and come in a fixed order
    within a shard, longest first, so a recomputed shard is packed alike.
    """
    fields = [f for f in pieces.schema.fields if f.name not in ("sequence_id", "offset", "ids")]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bins = TaskContext.get().partitionId(), Bins(limit, open_bins)
        for batch in batches:
            placed = [bins.place(n) for n in column(batch, "length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([(shard << 40) + b for b, _ in placed], pa.int64()),
                 pa.array([o for _, o in placed], pa.int64())], [*names, "sequence_id", "offset"])

    rows = pieces.select(*names)
    dealt = rows.repartition(n_shards, *[F.col(n) for n in names])
    return dealt.sortWithinPartitions(F.desc("length"), *[F.col(n) for n in names if n != "length"]).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
                   ranks: str | None = None, limit: int = SEQUENCE_TOKENS, open_bins: int = OPEN_BINS,
                   docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Tokenize, cut and pack documents: one row per piece.

    A null or empty text is one piece holding only the separator. Repeated rows
    are packed as often as they come; a null id is kept. An empty table gives
    no rows; other columns are left out.
    """
    path, ranks = path or tokenizer_file(), ranks or tokenizer_file("byte_bpe_50k.tiktoken")
    pieces = tokenized_pieces(docs, id_col, text_col, path, ranks, limit, with_ids=False)
    return pack(pieces, limit, open_bins, shards(docs.count(), docs_per_shard))
