"""LM scoring, whitening and spelling variants against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tandem.llm import queries, spelling, suffixtree, whitening

SCHEMA = "doc_id long, text string"
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(6000))
TEXTS = [(1, "the cat sat on the mat and the cat sat on the mat"), (2, None), (3, ""), (4, " \n\t"), (5, LONG), (6, LONG), (None, "no id at all"),
         (9, "a a b b " * 300), (12, "x x x y x y y y " * 300), (7, "The CAT sat"), (7, "The CAT sat"), (7, "another text of the id"), (8, "Ünï çödé 日本 語 😀 the cat sat on the mat")]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty, blank and long texts, repeats, and clashing columns."""
    return spark.createDataFrame(TEXTS, SCHEMA).selectExpr("*", "'x' AS id", "1L AS hash", "2 AS word", "'y' AS run", "3 AS n", "4 AS key")


# ---- 11 LM scoring --------------------------------------------------------------
def folded(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


class Tree:
    """The same tree with dictionaries of contexts."""

    def __init__(self, texts, depth, penalty):
        self.words, self.after = Counter(), defaultdict(Counter)
        for text in texts:
            t = folded(text)
            self.words.update(t)
            for i in range(len(t)):
                for k in range(1, min(depth, i) + 1):
                    self.after[tuple(t[i - k:i])][t[i]] += 1
        self.total, self.distinct = sum(self.words.values()), len(self.words)
        self.mass = self.total + 0.5 * (self.distinct + 1)
        self.states = set()
        for s, c in self.after.items():
            n = sum(c.values())
            if n >= penalty and max(c.values()) > 1:
                gain = sum(x * math.log(self.p(w, s, True) / self.p(w, s[1:], True)) for w, x in c.items())
                if gain >= penalty * math.log(max(self.total, 2)):
                    self.states.update(s[i:] for i in range(len(s)))

    def p(self, w, s, every=False):
        while s and not (s in self.after if every else s in self.states):
            s = s[1:]
        if not s:
            return (self.words[w] + 0.5) / self.mass
        c = self.after[s]
        return (max(c[w] - 1, 0) + len(c) * self.p(w, s[1:], every)) / sum(c.values())

    def score(self, text, depth):
        t = folded(text)
        return sum(math.log10(self.p(w, tuple(t[max(0, i - depth):i]))) for i, w in enumerate(t))

    def base(self, text):
        return sum(math.log10(self.p(w, ())) for w in folded(text))


def compare(rows, got, depth, penalty):
    def out(i):
        return i is not None and zlib.crc32(str(i).encode()) % 5 == 1

    tree = Tree([t for i, t in rows if not out(i)], depth, penalty)
    wanted = sorted(((i is None, i or 0), out(i), len(folded(t)), sum(tree.words[w] > 0 for w in folded(t)), tree.total,
                     round(tree.base(t), 6), round(tree.score(t, depth), 6)) for i, t in rows)
    found = sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert len(wanted) == len(found)
    for a, b in zip(wanted, found):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-6)
    return tree


def test_tree_by_brute_force(spark, sf_small):
    table = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in table.collect()]
    got = queries.op11_lm_scoring(spark, sf_small).collect()
    tree = compare(rows, got, suffixtree.DEPTH, suffixtree.PENALTY)
    assert {1, 2} <= {len(s) for s in tree.states}
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    # A proper distribution in every state: known words and one unknown.
    for s in sorted(tree.states, key=str)[::max(1, len(tree.states) // 20)] + [()]:
        assert sum(tree.p(w, s) for w in [*tree.words, "an unknown word"]) == pytest.approx(1)


@pytest.mark.parametrize("depth, penalty, size", [(3, 2, 1 << 20), (2, 2.5, 400), (1, 3, 50_000), (4, 2, 10_000)])
def test_tree_edges(spark, edge, monkeypatch, depth, penalty, size):
    """Small batches, buckets and shards, too."""
    for name in ("BATCH_BYTES", "BUCKET_BYTES", "SHARD_BYTES"):
        monkeypatch.setattr(suffixtree, name, size)
    monkeypatch.setattr(suffixtree, "PIECE_BITS", size.bit_length() // 3)
    got = suffixtree.score_texts(edge, depth=depth, penalty=penalty).collect()
    assert {len(s) for s in compare(TEXTS, got, depth, penalty).states} == set(range(1, min(depth, 3) + 1))


def test_word_hashes():
    """Equal words, and only those, have equal hashes, wherever they lie."""
    rng = np.random.default_rng(2)
    letters = ["a", "b", "B", "é", "日", "\u00a0", " ", "\n", "\t\x0b\x0c\r", "x" * 300]
    texts = [None, "", " ", *("".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(3000)), "w" * (3 << 18) + " end", ""]
    array = pa.array(["cut off", *texts])[1:]
    hashes, owner = suffixtree.concatenated(array)
    words = [w for t in texts for w in folded(t)]
    assert owner.tolist() == [i for i, t in enumerate(texts) for _ in folded(t)]
    by_word = {}
    for w, h in zip(words, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word) > 1000


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_equal_hashes_side_by_side(n):
    keys = np.random.default_rng(3).integers(0, 300, n).astype(np.uint64)
    by, starts = suffixtree.grouped(keys)
    values, counts = np.unique(keys, return_counts=True)
    assert keys[by[starts]].tolist() == values.tolist() and np.diff(starts, append=n).tolist() == counts.tolist()


def test_numbers_are_packed_before_they_are_shuffled(monkeypatch):
    """A row per bucket and piece, hashes in order, each with its number."""
    monkeypatch.setattr(suffixtree, "PACKED_ROWS", 700)
    rng = np.random.default_rng(4)
    hashes, kinds = rng.integers(0, 1 << 63, 2000).astype(np.int64) * 2 + 1, np.repeat([0, 1], 1000).astype(np.int32)
    numbers = hashes / 3.0
    batches = pa.table([kinds, hashes, numbers], names=["kind", "hash", "number"]).to_batches(max_chunksize=300)
    got = [r for b in suffixtree.cut(iter(batches), 3) for r in b.to_pylist()]
    assert len(got) <= 8 * 2 * 3
    found = set()
    for r in got:
        keys, values = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["numbers"], np.float64)
        assert (keys >> np.uint64(61) == r["bucket"]).all() and (np.diff(keys.astype(object)) > 0).all()
        found |= {(r["kind"], k, v) for k, v in zip(keys.view(np.int64).tolist(), values.tolist())}
    assert found == set(zip(kinds.tolist(), hashes.tolist(), numbers.tolist()))
    assert not list(suffixtree.cut(iter([]), 3))
    words, _ = suffixtree.concatenated(pa.array(["a b A", "c" * 70 + " b " + "C" * 70]))
    assert suffixtree.different(words).tolist() == sorted(set(words.tolist())) and len(set(words.tolist())) == 4


def test_tree_of_nothing(spark):
    assert suffixtree.score_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = suffixtree.score_texts(spark.createDataFrame([(held, "a b")], SCHEMA)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


# ---- 12 whitening ---------------------------------------------------------------
def reference(vectors):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors])
    n, sums = len(x), [int(s) for s in x.sum(0)]
    centred = np.array([[(n * int(a) - s) / n for a, s in zip(row, sums)] for row in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    dev = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return centred, e[::-1], u[:, ::-1], dev


def test_whitening_by_brute_force(spark, sf_small):
    table = spark.read.parquet(f"{sf_small}/embeddings.parquet").select("vec_id", "embedding")
    rows = {r.vec_id: r.embedding for r in table.collect()}
    got = queries.op12_embedding_whitening(spark, sf_small).collect()
    assert len(got) == 8 * len(rows)
    ids = sorted(rows)
    centred, e, u, dev = reference([rows[i] for i in ids])
    place = {v: i for i, v in enumerate(ids)}
    w = np.zeros((len(ids), 8))
    for r in got:
        w[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(ids) and r.deviation == dev[place[r.vec_id]]
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and 0 <= r.identity_error < 1e-9
    wanted = centred @ u[:, :8] / np.sqrt(e[:8])
    assert np.abs(np.abs(w) - np.abs(wanted)).max() < 1e-6
    assert np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() < 1e-9


def test_spectrum(spark):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    for spectrum in ([7.0] * 5 + [3, 3] + [1e-3] * 13, list(range(20, 0, -1)), [1.0] + [0.0] * 19, [5, 5 - 1e-9, 5 - 2e-9] + [1.0] * 17):
        v = q @ np.diag(spectrum) @ q.T
        v = (v + v.T) / 2
        e, u = whitening.leading(v)
        assert len(e) == min(8, sum(s > 1e-9 for s in spectrum))
        assert np.abs(e - np.sort(spectrum)[::-1][:len(e)]).max() < 1e-12 * spectrum[0] * 20
        assert np.abs(v @ u - u * e).max() < 1e-12 * max(spectrum) and np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12
        for shift in (0.45, 2.5, 6.5, 30.0):
            assert whitening.above(v, shift) == sum(s > shift for s in spectrum)


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>, component int, vector int"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 1, 1), (2, [0.5, -2.0], 1, 1), (2, [0.5, -2.0], 1, 1), (None, [3.0, 1.0], 1, 1), (3, None, 1, 1), (4, [], 1, 1),
            (5, [nan, 1.0], 1, 1), (6, [inf, 1.0], 1, 1), (7, [None, 1.0], 1, 1), (8, [1.0, 2.0, 3.0], 1, 1), (9, [0.0, 0.0], 1, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert Counter((r.vec_id, r.component) for r in got) == {(i, c): 2 if i == 2 else 1 for i in (None, 1, 2, 9) for c in (1, 2)}
    dev = reference([r[1] for r in rows if r[0] in (1, 2, None, 9)])[3]
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(dev)
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame(rows[1:3], schema)).count() == 0  # equal rows: no variance
    wide = spark.createDataFrame([(i, [float(i) * 1e10, 1.0], 1, 1) for i in range(50)], schema)
    beyond = whitening.whiten(wide).collect()
    assert len(beyond) == 50 and None in {r.deviation for r in beyond}  # one component; sums beyond a long are null


# ---- 13 spelling variants ---------------------------------------------------------
def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelling_by_brute_force(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    by_cut = defaultdict(set)
    for w in n:  # words one edit apart share the word less one letter, or are that
        for cut in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            by_cut[cut].add(w)
    near = defaultdict(set)
    for group in by_cut.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def spelled(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def test_spelling_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got, wanted = spelled(queries.op13_spelling_variants(spark, sf)), spelling_by_brute_force(rows)
    assert got == wanted and any(w[1] for w in wanted)


def test_spelling_edges(spark, edge):
    words = ["colouring", "coloring", "colourring", "kolouring", "Éclairages", "éclairages", "ÉCLAIRAGES", "straßenbahn", "strasenbahn"]
    rows = TEXTS + [(i, " ".join([w] * (3 ** (j % 5)))) for i in range(40, 44) for j, w in enumerate(words)] + [(None, "colouring colouring")] * 2
    chain = [("abcdefgh", 2), ("abcdefghi", 20), ("abcdefghij", 200), ("abcdefghijk", 2000)]
    rows += [(None, " ".join([w] * k)) for w, k in chain]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS word", "1 AS n", "'y' AS run", "'z' AS key")
    got, wanted = spelled(spelling.variants(df)), spelling_by_brute_force(rows)
    assert got == wanted
    assert any(r[1] and r[2] != r[1] for r in got)  # a chain of forms
    for symbols in (2, 3):
        assert spelled(spelling.variants(df, symbols=symbols)) == wanted
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "a b")], SCHEMA)).count() == 0


def test_neighbourhood(spark):
    """All strings at most one edit away, none twice."""
    from pyspark.sql import functions as F

    for word in ("a", "abca", "aab"):
        got = spark.createDataFrame([(word,)], ["w"]).select(spelling.neighbourhood(F.col("w"), 3)).first()[0]
        wanted = {word, *(word[:i] + word[i + 1:] for i in range(len(word))),
                  *(word[:i] + c + word[i + k:] for i in range(len(word) + 1) for c in "abc" for k in (0, 1) if i + k <= len(word))}
        assert sorted(got) == sorted(wanted)
