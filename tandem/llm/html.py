"""Main text of web pages by a linear-chain conditional random field.

A page becomes the sequence of its leaf blocks: runs of text between block
tags, with their ancestors. Features are the ancestors' tags and classes and
properties of the text; labels are boilerplate and main text. The field is
trained by gradient ascent on the likelihood (forward-backward in numpy) from a
bounded sample of pages whose article text is known, and decoded by Viterbi.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import column, slices

SAMPLE_PAGES = 400
SAMPLE_CHARS = 20_000
ANCESTORS = 64  # nearest open tags whose names, classes, ids and roles are features of a block
STEPS = 250
BATCH_BYTES = 4 << 20
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol option p pre section select "
    "summary table tbody td textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN_TAGS = frozenset("script style template".split())
# An open tag of the left kind ends when one of the right kinds begins.
CLOSED_BY = {"p": BLOCK_TAGS - {"br", "button"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
             "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "head": {"body"}}
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’)\]]*$").search


@dataclass
class Block:
    text: str
    parent: str
    marks: list[str]
    linked: int


class Blocks(HTMLParser):
    """Leaf blocks of a page; broken nesting is mended as browsers do."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.open: Counter = Counter()  # tags
        self.marks: list[str] | None = None
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            parent = next((t for t, _ in reversed(self.stack) if t in BLOCK_TAGS), "")
            if self.marks is None:  # blocks of the same ancestors share them
                self.marks = sorted({m for _, marks in self.stack[-ANCESTORS:] for m in marks})
            self.blocks.append(Block(text, parent, self.marks, self.linked))
        self.text, self.linked = [], 0

    def _push(self, tag: str, attrs) -> None:
        marks = tuple([f"tag {tag}"] + [f"{k} {w}" for k, v in attrs if k in ("class", "id", "role") and v for w in v.lower().split()[:8]])
        self.stack.append((tag, marks))
        self.open[tag] += 1
        self.marks = None

    def _pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.open[self.stack.pop()[0]] -= 1
        self.marks = None

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()
            for i in range(len(self.stack) - 1, max(-1, len(self.stack) - 12), -1):
                if tag in CLOSED_BY.get(self.stack[i][0], ()):
                    self._pop_to(i)
                    break
                if self.stack[i][0] in BLOCK_TAGS and self.stack[i][0] not in CLOSED_BY:
                    break
        if tag not in VOID_TAGS:
            self._push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in BLOCK_TAGS:
            self.flush()
        if self.open.get(tag):
            self._pop_to(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag))

    def handle_data(self, data):
        if not any(self.open.get(t) for t in HIDDEN_TAGS):
            self.text.append(data)
            if self.open.get("a"):
                self.linked += len(data)


def blocks_of(html: str | None) -> list[Block]:
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    for i, b in enumerate(blocks):
        words = b.text.split()
        own = [*b.marks, f"parent {b.parent}", "bias", f"words {min(6, int(math.log2(len(words))))}"]
        own.append(f"linked {round(4 * min(1.0, b.linked / len(b.text)))}")
        own.append("sentence" if SENTENCE_END(b.text) else "no sentence")
        if "©" in b.text or "(c)" in b.text.lower():
            own.append("copyright")
        if sum(c.isdigit() for c in b.text) > 0.3 * len(b.text):
            own.append("digits")
        own.append("upper" if b.text[0].isupper() else "lower")
        if i == len(blocks) - 1:
            own.append("last")
        out.append(own)
    return out


@dataclass
class Field:
    """Weights of (feature, label), of label pairs and of the first label."""

    index: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        ids = [[self.index[f] for f in row if f in self.index] for row in rows]
        return np.array([self.emit[i].sum(0) for i in ids]).reshape(-1, 2)

    def decode(self, blocks: list[Block]) -> list[int]:
        """Viterbi."""
        if not blocks:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        emit = self.scores(features(blocks)).tolist()
        a, b = emit[0][0] + self.first[0], emit[0][1] + self.first[1]
        back = []
        for e0, e1 in emit[1:]:
            from0, from1 = b + m10 > a + m00, b + m11 > a + m01
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00) + e0, (b + m11 if from1 else a + m01) + e1
        label = int(b > a)
        path = [label]
        for step in reversed(back):
            label = int(step[label])
            path.append(label)
        return path[::-1]


def train(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS, decay: float = 1e-4) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam on all pages."""
    pages = [p for p in pages if p[0]]
    rows = [features(b) for b, _ in pages]
    model = Field({f: i for i, f in enumerate(sorted({f for page in rows for row in page for f in row}))})
    if not pages:
        return model
    longest = max(len(b) for b, _ in pages)
    n = len(pages)
    page_no = np.concatenate([np.full(len(r), p) for p, r in enumerate(rows)])
    place = np.concatenate([np.arange(len(r)) for r in rows])
    owner = np.concatenate([np.full(len(row), i) for i, row in enumerate(row for page in rows for row in page)])
    ids = np.array([model.index[f] for page in rows for row in page for f in row])
    gold = np.array([y for _, ys in pages for y in ys])
    mask = np.zeros((n, longest), bool)
    mask[page_no, place] = True
    truth = np.zeros((n, longest), int)
    truth[page_no, place] = gold
    params = [np.zeros((len(model.index), 2)), np.zeros((2, 2)), np.zeros(2)]
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (truth[:, :-1][mask[:, 1:]], truth[:, 1:][mask[:, 1:]]), 1)
    seen_first = np.bincount(truth[:, 0], minlength=2)
    onehot = np.eye(2)[gold]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, steps + 1):
        emit, move, first = params
        e = np.zeros((n, longest, 2))
        e[page_no, place] = np.stack([np.bincount(owner, emit[ids, y], len(gold)) for y in (0, 1)], 1)
        fore, back = np.zeros_like(e), np.zeros_like(e)
        fore[:, 0] = e[:, 0] + first
        for t in range(1, longest):
            new = np.logaddexp.reduce(fore[:, t - 1, :, None] + move, axis=1) + e[:, t]
            fore[:, t] = np.where(mask[:, t, None], new, fore[:, t - 1])
        total = np.logaddexp.reduce(fore[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(move + (e[:, t + 1] + back[:, t + 1])[:, None, :], axis=2)
            back[:, t] = np.where(mask[:, t + 1, None], new, 0)
        p = np.exp(fore + back - total[:, None, None])[page_no, place]
        pair = np.exp(fore[:, :-1, :, None] + move + (e + back)[:, 1:, None, :] - total[:, None, None, None])
        pair = (pair * mask[:, 1:, None, None]).sum((0, 1))
        wrong = onehot - p
        grads = [np.stack([np.bincount(ids, wrong[owner, y], len(model.index)) for y in (0, 1)], 1),
                 seen_moves - pair, seen_first - p[place == 0].sum(0)]
        for q, g, m in zip(params, grads, moments):
            g = g / n - decay * q
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            q += 0.1 * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-8)
    model.emit, model.move, model.first = params
    return model


def labels_by_text(blocks: list[Block], article: str) -> list[int] | None:
    """1 for the blocks that make up the known article, in order and without
    overlap, 0 for the others: a title that holds the article's first words is
    none of it where a later block holds them too. None if no blocks make up the
    whole of it. Of several ways one of the fewest blocks is taken, of these the one
    that skips the fewest blocks in between, of these the latest."""
    whole = f"{' '.join(article.split())} "
    reached: dict[int, tuple] = {0: (0, 0, 0, None)}  # end of a part -> number of its blocks, skipped ones, minus the last one's place, the way
    for i, b in enumerate(blocks):
        for at in [at for at in reached if whole.startswith(f"{b.text} ", at)]:
            n, skipped, _, way = reached[at]
            new = (n + 1, skipped + (i - way[0] - 1 if way else 0), -i, (i, way))
            end = at + len(b.text) + 1
            if end not in reached or new[:3] < reached[end][:3]:
                reached[end] = new
    if len(whole) < 2 or len(whole) not in reached:
        return None
    out, last = [0] * len(blocks), reached[len(whole)][3]
    while last:
        out[last[0]], last = 1, last[1]
    return out


# ---- on Spark ---------------------------------------------------------------
def sample(pages: DataFrame, documents: DataFrame, n_pages: int = SAMPLE_PAGES) -> list[tuple[str, str]]:
    """Up to ``n_pages`` (html, article text) pairs, picked by hash: pages of at
    most ``SAMPLE_CHARS`` characters whose URL ends in the id of a document of
    at most as many."""
    number = F.regexp_extract("url", r"://[^/?#]*/[^/?#]+/(\d{1,18})(?:[/?#.]|$)", 1)
    named = pages.where((number != "") & (F.length("html") <= SAMPLE_CHARS)).select(
        number.cast("long").alias("doc_id"), F.xxhash64("page_id").alias("pick"), "html")
    chosen = named.orderBy("pick", "doc_id").limit(n_pages)
    # n_pages rows of at most SAMPLE_CHARS characters.
    known = documents.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return sorted((r.html, r.text) for r in known.limit(2 * n_pages).collect())


def fit(pages: DataFrame, documents: DataFrame) -> Field:
    known = ((blocks_of(h), t) for h, t in sample(pages, documents))
    labelled = ((b, labels_by_text(b, t)) for b, t in known)
    return train([(b, y) for b, y in labelled if y is not None])


def extract(pages: DataFrame, model: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page row: page_id, url, text, n_chars.

    The text is that of the main blocks, white space made single, blocks joined
    by a space; a null or empty html gives an empty text. Broken markup is read
    as far as it goes. Repeated rows and null ids are kept; an empty table gives
    no rows; a model without features gives empty texts.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    carried = rows.sparkSession.sparkContext.broadcast(model)  # features of the sample only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = carried.value
        for whole in batches:
            for batch in slices(whole, "html", BATCH_BYTES):
                texts = []
                for html in column(batch, "html").to_pylist():
                    blocks = blocks_of(html)
                    texts.append(" ".join(b.text for b, y in zip(blocks, own.decode(blocks)) if y))
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()),
                     pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
