"""Language identification by a bidirectional gated recurrent network over
bytes, trained here by backpropagation through time.

Each byte of a text gets its own language probabilities from the states of both
directions; a document's probabilities are the mean over its letter bytes.
Texts are cut into blocks of ``BLOCK_BYTES`` bytes that are read side by side;
every byte is in one block, so texts of any length cost memory per batch only.

The model is a few kilobytes: it is trained on the driver from a bounded sample
of labelled rows (``SAMPLE_PER_LANG`` windows per language) and sent to the
tasks that score all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandem.llm.common import column, slices

HIDDEN = 8
BLOCK_BYTES = 128
SAMPLE_PER_LANG = 1500
SAMPLE_CHARS = 96
MAX_LANGS = 256
STEPS = 400
BATCH_BLOCKS = 192
BATCH_BYTES = 2 << 20
SCORED_BLOCKS = 2048
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}").search
_LETTER_BYTE = np.array([65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in range(256)])


@dataclass
class Model:
    """Per direction: input rows for each byte value, recurrent weights and the
    bias of the candidate's recurrent part; then the output layer."""

    langs: list[str]
    cells: list[dict[str, np.ndarray]]
    out: np.ndarray
    out_bias: np.ndarray


# ---- network ----------------------------------------------------------------
def run_cell(cell: dict, codes: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States (T, H, B) of one direction for byte codes (T, B)."""
    h_size = cell["u"].shape[1]
    h = np.zeros((h_size, codes.shape[1]), np.float32)
    states = np.empty((len(codes), *h.shape), np.float32)
    for t, row in enumerate(codes):
        x = cell["x"].take(row, axis=1)
        r = cell["u"] @ h
        gates = np.tanh(0.5 * (x[:2 * h_size] + r[:2 * h_size]))
        gates *= 0.5
        gates += 0.5
        z, reset = gates[:h_size], gates[h_size:]
        inner = r[2 * h_size:] + cell["b"]
        n = np.tanh(x[2 * h_size:] + reset * inner)
        if trace is not None:
            trace.append((h, z, reset, inner, n))
        h = n + z * (h - n)
        states[t] = h
    return states


def back_through_time(cell: dict, codes: np.ndarray, trace: list, grads: np.ndarray) -> dict:
    """Gradients of a direction's parameters; grads are those of its states."""
    h_size = cell["u"].shape[1]
    out = {k: np.zeros_like(v) for k, v in cell.items()}
    dh = np.zeros_like(grads[0])
    dx = np.empty((len(codes), 3 * h_size, codes.shape[1]), np.float32)
    for t in range(len(codes) - 1, -1, -1):
        h, z, reset, inner, n = trace[t]
        dh = dh + grads[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * inner * reset * (1 - reset)
        di = dn * reset
        rec = np.concatenate([dz, dr, di])
        dx[t] = np.concatenate([dz, dr, dn])
        out["u"] += rec @ h.T
        out["b"] += di.sum(1, keepdims=True)
        dh = dh * z + cell["u"].T @ rec
    flat = dx.transpose(1, 0, 2).reshape(3 * h_size, -1)
    one_hot = codes.ravel()
    for i in range(3 * h_size):
        out["x"][i] = np.bincount(one_hot, flat[i], 256)
    return out


def softmax(logits: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(logits - logits.max(axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def blocks_of(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes (T, blocks), letter mask, text number of each block); zero bytes
    fill up a text's last block."""
    counts = np.array([-(-len(d) // BLOCK_BYTES) for d in data], np.int64)
    padded = b"".join(d.ljust(n * BLOCK_BYTES, b"\0") for d, n in zip(data, counts.tolist()))
    codes = np.frombuffer(padded, np.uint8).reshape(-1, BLOCK_BYTES).T
    return np.ascontiguousarray(codes), _LETTER_BYTE[codes], np.repeat(np.arange(len(data)), counts)


def label_positions(model: Model, codes: np.ndarray) -> np.ndarray:
    """Language probabilities (T, languages, B) of every byte."""
    fore = run_cell(model.cells[0], codes)
    back = run_cell(model.cells[1], codes[::-1])[::-1]
    h_size = fore.shape[1]
    logits = np.matmul(model.out[:, :h_size], fore) + np.matmul(model.out[:, h_size:], back)
    return softmax(logits + model.out_bias, 1)


def pooled(model: Model, data: list[bytes]) -> np.ndarray:
    """Mean probabilities over the letter bytes of each text."""
    codes, letters, owner = blocks_of(data)
    sums = np.zeros((len(data), len(model.langs)))
    counts = np.bincount(owner, letters.sum(0), len(data))
    for at in range(0, len(owner), SCORED_BLOCKS):
        part = slice(at, at + SCORED_BLOCKS)
        p = np.einsum("tlb,tb->bl", label_positions(model, codes[:, part]), letters[:, part].astype(np.float32))
        np.add.at(sums, owner[part], p)
    return sums / np.maximum(counts, 1)[:, None]


def train(samples: list[tuple[bytes, str]], seed: int = 7, steps: int = STEPS, hidden: int = HIDDEN) -> Model:
    """Fit by Adam on batches of blocks; the loss is that of every letter byte."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in samples})

    def matrix(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    cells = [{"x": matrix(3 * hidden, 256, scale=0.3), "u": matrix(3 * hidden, hidden, scale=0.3),
              "b": np.zeros((hidden, 1), np.float32)} for _ in range(2)]
    model = Model(langs, cells, matrix(len(langs), 2 * hidden, scale=0.3), np.zeros((len(langs), 1), np.float32))
    if not samples:
        return model
    params = {**{f"{k}{i}": c[k] for i, c in enumerate(cells) for k in c}, "out": model.out, "bias": model.out_bias}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    codes, letters, owner = blocks_of([d for d, _ in samples])
    target = np.array([langs.index(lang) for _, lang in samples])[owner]
    for step in range(1, steps + 1):
        pick = rng.integers(0, codes.shape[1], BATCH_BLOCKS)
        x, mask = codes[:, pick], letters[:, pick].astype(np.float32)
        traces = [[], []]
        fore = run_cell(cells[0], x, traces[0])
        back = run_cell(cells[1], x[::-1], traces[1])[::-1]
        both = np.concatenate([fore, back], axis=1)
        d = softmax(np.matmul(model.out, both) + model.out_bias, 1)
        d[:, target[pick], np.arange(len(pick))] -= 1
        d *= (mask / max(1.0, mask.sum()))[:, None, :]
        dboth = np.matmul(model.out.T, d)
        grads = {"out": np.einsum("tlb,thb->lh", d, both), "bias": d.sum((0, 2))[:, None]}
        for i, (seq, part) in enumerate(((x, dboth[:, :hidden]), (x[::-1], dboth[::-1, hidden:]))):
            grads |= {f"{k}{i}": v for k, v in back_through_time(cells[i], seq, traces[i], part).items()}
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            params[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
    return model


# ---- on Spark ---------------------------------------------------------------
def held_out(id_col: str) -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> list[tuple[bytes, str]]:
    """Up to ``per_lang`` labelled windows of ``SAMPLE_CHARS`` characters for each
    of the ``MAX_LANGS`` most frequent languages, from rows and places picked by
    hash."""
    pick = F.xxhash64(F.col(id_col), F.lit(1))
    start = F.pmod(F.xxhash64(pick), F.greatest(F.length(text_col) - SAMPLE_CHARS, F.lit(1))) + 1
    windows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(
        F.col(lang_col).cast("string").alias("lang"), pick.alias("pick"),
        F.substring(F.col(text_col).cast("string"), start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    counts = windows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS)
    windows = windows.join(F.broadcast(counts), "lang").where(
        F.pmod("pick", F.lit(1 << 30)) < F.lit(float(1 << 30)) * F.lit(2.0 * per_lang) / F.col("count"))
    ranked = windows.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("pick", "text")))
    rows = ranked.where(F.col("r") <= per_lang).orderBy("lang", "r").collect()  # per_lang rows for each language
    return [(r.text.encode("utf-8"), r.lang) for r in rows]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_lang: int = SAMPLE_PER_LANG) -> Model:
    return train(sample(docs, id_col, text_col, lang_col, per_lang))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, probs (language -> mean).

    A text that is null or has no letter is ``und`` with score 1; so is any text
    if the model has learned no language. Nothing but the text is scored.
    Repeated rows and null ids are kept; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).cast("string").alias("text"))
    schema = (f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, "
              "score double, probs array<double>")
    carried = rows.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = carried.value
        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                texts = column(batch, "text").to_pylist()
                known = [i for i, t in enumerate(texts) if own.langs and t and LETTER(t)]
                preds, scores, probs = [UNDETERMINED] * len(texts), [1.0] * len(texts), [None] * len(texts)
                if known:
                    p = pooled(own, [texts[i].encode("utf-8", "surrogatepass") for i in known])
                    for i, row in zip(known, p.tolist()):
                        scores[i] = min(1.0, max(row))
                        preds[i] = own.langs[row.index(max(row))]
                        probs[i] = row
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id"), column(batch, "held_out"), pa.array(preds, pa.string()),
                     pa.array(scores, pa.float64()), pa.array(probs, pa.list_(pa.float64()))],
                    ["doc_id", "held_out", "lang_pred", "score", "probs"])

    named = F.array(*[F.lit(x) for x in model.langs]).cast("array<string>")
    return rows.mapInArrow(run, schema).select(
        "doc_id", "held_out", "lang_pred", "score",
        F.when(F.col("probs").isNotNull(), F.map_from_arrays(named, "probs")).alias("probs"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that are not held out, then label all rows."""
    return predict(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
