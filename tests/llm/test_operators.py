"""Training-data operators against brute force, round trips and DuckDB."""

import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tandem.llm import decontaminate, html, langid, linededup, neighbours, packing, passages, queries, simhash, urlrules, warc
from tandem.llm.oracle import SQL
from tests.oracle_harness import compare, duck

LONG = " ".join(f"word{i % 977}x{i}" for i in range(6000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today\nsecond line stays here as it is"),
    (2, "The quick brown fox jumps over the lazy cat again and again today\nquite another line of text here"),
    (3, None), (4, ""), (5, "   \n\t"), (6, LONG), (7, LONG + " tail"), (8, "Ünï çödé 日本 語 😀"),
    (9, "one"), (9, "one"), (10, "a b\na b\nA B\n\nb a c"), (None, "no id at all, but some words"), (12, "12 34 !!"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, blank and long texts, repeats, and columns whose names the
    operators use themselves."""
    return spark.createDataFrame(TEXTS, SCHEMA).selectExpr(
        "*", "'x' AS lang", "1 AS piece", "2 AS component_id", "3 AS digest", "CAST(NULL AS string) AS maybe__")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA + ", lang string")


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf_small, name):
    result = compare(spark, duck(sf_small), name, queries.llm_queries()[name], SQL[name], sf_small)
    assert result["columns_match"] and result["values_match"], result


# ---- 1 language identification ------------------------------------------------
def test_language_accuracy_and_edges(spark, docs, nothing):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(table, per_lang=300)
    got = langid.predict(table, model).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    edge = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, model).collect()]
    assert len(edge) == len(TEXTS) and all(0 <= s <= 1 for _, _, s in edge)
    assert {d for d, lang, _ in edge if lang == langid.UNDETERMINED} == {3, 4, 5, 12}
    assert langid.identify(nothing).count() == 0


def test_letters_are_category_l(spark):
    """Fractions, powers and circled digits are no letters."""
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), per_lang=20)
    rows = [(1, "½ ²³ ① Ⅷ 12"), (2, "_-_ ٣"), (3, "½ a"), (4, "ªº"), (5, "日"), (6, "é")]
    got = {r.doc_id: r.lang_pred for r in langid.predict(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert {d for d, lang in got.items() if lang == langid.UNDETERMINED} == {1, 2}


def test_gradients():
    rng = np.random.default_rng(0)
    cell = {"x": rng.normal(size=(6, 256)).astype("f4"), "u": rng.normal(size=(6, 2)).astype("f4"), "b": rng.normal(size=(2, 1)).astype("f4")}
    codes, grads = rng.integers(0, 256, (5, 3)), rng.normal(size=(5, 2, 3)).astype("f4")
    trace = []
    langid.run_cell(cell, codes, trace)
    back = langid.back_through_time(cell, codes, trace, grads)
    for key, at in (("u", (0, 1)), ("u", (3, 0)), ("u", (5, 1)), ("b", (1, 0)), ("x", (4, codes[2, 1]))):
        loss = []
        for step in (1e-2, -1e-2):
            moved = {k: v.copy() for k, v in cell.items()}
            moved[key][at] += step
            loss.append(float((langid.run_cell(moved, codes) * grads).sum()))
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(float(back[key][at]), abs=2e-2)


# ---- 2 passages -----------------------------------------------------------------
def test_compact_windows_cover_every_run_once():
    values = passages.mixed(np.random.default_rng(1).integers(0, 40, 300).astype(np.uint64))
    seen = {}
    for left, c, right in zip(*passages.compact_windows(values, np.array([0, 150]), np.array([150, 300]), 10)):
        for i in range(left, c + 1):
            for j in range(max(c, i + 9), right + 1):
                seen[i, j] = seen.get((i, j), 0) + 1
                assert values[i:j + 1].min() >> np.uint64(20) == values[c] >> np.uint64(20)
    assert set(seen.values()) == {1} and len(seen) == 2 * sum(150 - k + 1 for k in range(10, 151))


def test_repeated_passages(spark, docs, nothing):
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(100 + i, " ".join(f"q{i}n{j}" for j in range(80)) + " " + shared + f" end{i}") for i in range(8)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: r for r in passages.repeated_passages(more).collect()}
    assert {got[100 + i].class_id for i in range(8)} == {100}
    assert got[7].class_id == 6 and got[1].class_id == 1 and got[3].n_links == 0
    assert all(any(p.start <= 80 and p.end >= 140 for p in got[100 + i].passages) for i in range(8))
    assert passages.repeated_passages(nothing).count() == 0


def edited_pair(rng, n, t):
    """Two runs of shingle numbers that share stretches with edits."""
    a = rng.permutation(10 ** 6)[:n]
    b, fresh = [], 2 * 10 ** 6
    rate = rng.choice([0.02, 0.1, 0.2])
    for x in a.tolist():
        if rng.random() < rate:
            fresh += 9
            b += [[], [fresh], [x, *range(fresh, fresh + int(rng.integers(1, 6)))]][int(rng.integers(0, 3))]
        else:
            b.append(x)
    return a.astype(np.uint64), np.array(b, np.uint64)


def similar_places(a, b, t, similarity):
    """(start, end) in a of all passages, by brute force: they begin and end
    with shingles of both."""
    out = set()
    place = {int(x): i for i, x in enumerate(b)}
    at = [place.get(int(x)) for x in a]
    for s, s2 in enumerate(at):
        for e, e2 in enumerate(at[s + t - 1:], s + t - 1):
            if s2 is not None and e2 is not None and e2 - s2 + 1 >= t:
                both = sum(q is not None and s2 <= q <= e2 for q in at[s:e + 1])
                if both >= similarity * (e - s + 1 + e2 - s2 + 1 - both) - 1e-9:
                    out.add((s, e))
    return out


def test_verify_by_brute_force():
    rng = np.random.default_rng(6)
    hits = 0
    for _ in range(200):
        a, b = edited_pair(rng, 60, 12)
        want, got = similar_places(a, b, 12, 0.8), passages.verify(a, b, 12, 0.8)
        hits += bool(want)
        assert bool(got) == bool(want) and all(j >= 0.8 - 1e-9 and (s, e) in want for s, e, _, _, j in got)
        common = set(np.flatnonzero(np.isin(a, b)).tolist())
        inside = {i for s, e in want for i in range(s, e + 1)} & common
        assert inside == {i for s, e, *_ in got for i in range(s, e + 1)} & common
    assert 20 < hits < 200


def test_verify_finds_the_dense_end_of_a_run():
    words = [f"p{i}" for i in range(200)]
    other = list(words)
    for i in (30, *range(60, 200, 10)):
        other[i] = f"changed{i}"
    a, b = (passages.shingles(" ".join(w)) for w in (words, other))
    assert any(s <= 5 and e >= 50 and j >= 0.8 for s, e, _, _, j in passages.verify(a, b, 46, 0.8))
    twice = np.concatenate([a[:60], np.arange(30, dtype=np.uint64), a[:60]])
    assert [x[:4] for x in passages.verify(a[:60], twice, 46, 0.8)][0][:2] == (0, 59)
    same = np.zeros(5000, np.uint64)
    assert passages.verify(same, same, 46, 0.8)


def test_scattered_common_shingles_are_not_aligned(monkeypatch):
    """No stretch is similar where a third of the places are common; the bound
    that says so lets every similar stretch pass."""
    a, b = np.arange(1, 601, dtype=np.uint64), np.arange(10_001, 10_601, dtype=np.uint64)
    b[::3] = a[::3]
    monkeypatch.setattr(passages, "aligned", None)
    assert passages.verify(a, b, 46, 0.8) == []
    rng = np.random.default_rng(8)
    for share in np.linspace(0.6, 1, 60):
        places = np.flatnonzero(rng.random(90) < share)
        similar = any(places[j] - places[i] >= 45 and (j - i + 1) >= 0.8 * (places[j] - places[i] + 1)
                      for i in range(len(places)) for j in range(i, len(places)))
        assert passages.dense(places, 46, 0.8) == similar
    assert not passages.dense(places[:0], 46, 0.8)


def test_near_passages_are_candidates(spark):
    """400 pairs that share 50 words but one."""
    rows = []
    for i in range(400):
        words = [f"p{i}x{j}" for j in range(50)]
        rows.append((2 * i, " ".join(words) + f" end{i}"))
        words[25] = "changed"
        rows.append((2 * i + 1, f"begin{i} " + " ".join(words)))
    got = passages.passage_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {(r.doc, r.doc2) for r in got}
    assert got <= {(2 * i, 2 * i + 1) for i in range(400)} and len(got) >= 398


@pytest.mark.parametrize("between", [8, 40])
def test_no_window_is_left_unmet(spark, monkeypatch, between):
    """Documents between two copies hold all min-hash shingles of the passage,
    not the passage; in large groups, in blocks of a few windows."""
    monkeypatch.setattr(passages, "BLOCK", 8)
    words = [f"p{i}" for i in range(50)]
    h = passages.shingles(" ".join(words))
    least = [int(passages.mixed(h ^ passages.mixed(np.full(1, f + 1, np.uint64))).argmin()) for f in range(passages.FUNCTIONS)]

    def own(i, k):
        return [f"q{i}n{k}n{j}" for j in range(46)]

    rows = [(100, " ".join(own(100, 0) + words)), (200, " ".join(own(200, 0) + words + own(200, 1)))]
    rows.append((201, " ".join(own(201, 0) + words[:20] + ["changed"] + words[21:])))
    for i in range(between):
        rows.append((101 + i, " ".join(w for k, at in enumerate(least) for w in own(i, k) + words[at:at + 5])))
    for name, frame in (("long", spark.createDataFrame(rows, SCHEMA)),
                        ("string", spark.createDataFrame([(f"d{i}", t) for i, t in rows], "doc_id string, text string"))):
        got = {str(r.doc_id).lstrip("d"): (str(r.class_id).lstrip("d"), r.n_links) for r in passages.repeated_passages(frame).collect()}
        assert {got[i][0] for i in ("100", "200", "201")} == {"100"}, name
        assert all(got[str(101 + i)] == (str(101 + i), 0) for i in range(between))


@pytest.mark.parametrize("block", [2048, 8])
def test_links_of_large_groups_are_whole(spark, monkeypatch, block):
    """24 different texts around one passage: each is linked to all others, not
    along a tree; copies of a text lose none of these links."""
    monkeypatch.setattr(passages, "BLOCK", block)
    shared = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"q{i}n{j}" for j in range(80)) + f" {shared} end{i}" for i in range(24)]
    got = passages.repeated_passages(spark.createDataFrame([*enumerate(texts), *((100 + i, texts[0]) for i in range(3))], SCHEMA)).collect()
    assert {r.class_id for r in got} == {0}
    links = {r.doc_id: r.n_links for r in got}
    assert all(links[i] == 26 for i in range(1, 24)) and all(links[i] >= 23 for i in (0, 100, 101, 102))


def test_copies_are_joined_once(spark):
    """20 copies of a text and a text that shares a passage with it: two units,
    one pair, yet every document has a link to each other one."""
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(i, shared + " own end") for i in range(20)] + [(30, " ".join(f"q{j}" for j in range(80)) + " " + shared)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert passages.text_units(frame, "doc_id", "text").select("unit").distinct().count() == 2
    got = passages.repeated_passages(frame).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 20)}
    assert all((0, 62) in [(p.start, p.end) for p in r.passages] for r in got if r.doc_id < 20)


def test_passages_of_an_id_with_two_texts(spark):
    shared, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    rows = [(5, shared), (5, other), (6, shared), (7, other), (8, "short"), (9, "short"), (None, shared), (3, None)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {5: (5, 2), 6: (5, 1), 7: (5, 1), 8: (8, 0), 9: (9, 0), None: (None, 0), 3: (3, 0)}


def test_no_copy_in_a_large_group_loses_links(spark):
    """24 texts of the same words, in other case and spacing, and 24 ids that each
    have this text and one of their own: all are linked to all others."""
    words = [f"p{i}" for i in range(60)]
    rows = [(i, "  ".join(w.upper() if k == i else w for k, w in enumerate(words))) for i in range(24)]
    rows += [row for i in range(24) for row in ((100 + i, " ".join(words)), (100 + i, " ".join(f"q{i}n{k}" for k in range(60))))]
    got = passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 47)}
    assert all([(p.start, p.end) for p in r.passages] == [(0, 60)] for r in got)


def test_alignment_of_repeated_shingles():
    """By bits as one match after the other."""
    rng = np.random.default_rng(9)
    for _ in range(300):
        a, b = (rng.integers(0, int(rng.integers(2, 30)), int(rng.integers(1, 60))) for _ in range(2))
        rows, columns = np.flatnonzero(np.isin(a, b)), np.flatnonzero(np.isin(b, a))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        for p, q in (passages.aligned_by_bits(a, b, rows, columns), passages.aligned(a, b)):
            assert len(p) == best[-1, -1] and (a[p] == b[q]).all() and (np.diff(p) > 0).all() and (np.diff(q) > 0).all()


def test_only_shared_stretches_leave_a_text(spark):
    """Of long texts around one passage, the passage; of texts that share no
    passage, nothing, though a phrase is in all of them."""
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"q{i}n{j}" for j in range(500)) + f" {shared} " + " ".join(f"r{i}n{j}" for j in range(500))) for i in range(3)]
    rows += [(i, " ".join(f"q{i}n{j}" for j in range(500)) + " p0 p1 p2 p3 p4 p5 p6 p7 " + f"end{i} " * 9) for i in range(3, 40)]
    chunks = passages.in_chunks(spark.createDataFrame(rows, "u long, text string")).persist()
    again = passages.occur_again(chunks, 5, 16)
    found = passages.stretches_of(chunks, again, 46, 8, 5, 0.8, 16).collect()
    chunks.unpersist()
    assert sorted(r.u for r in found) == [0, 1, 2]
    assert all(np.frombuffer(r.places, np.int32).tolist() == list(range(500, 556)) for r in found)


def test_pairs_are_the_same_in_blocks_of_any_size(spark, monkeypatch):
    """Texts of several families, some repeating themselves, two by two and at once."""
    rng = np.random.default_rng(11)
    sources = [[f"s{k}w{j % (90 if k else 20)}" for j in range(90)] for k in range(3)]
    rows = [(i, " ".join([f"d{i}w{j}" for j in range(20)] + [f"d{i}e{j}" if rng.random() < 0.02 else w for k in rng.integers(0, 3, 2) for j, w in enumerate(sources[k])]))
            for i in range(24)]
    frame = spark.createDataFrame(rows, SCHEMA)
    runs = [passages.shingles(t) for _, t in rows]
    want = {(i, j) for i in range(24) for j in range(i + 1, 24) if passages.verify(runs[i], runs[j], 46, 0.8)}
    for block in (2048, 3):
        monkeypatch.setattr(passages, "BLOCK", block)
        got = {(r.doc, r.doc2) for r in passages.passage_pairs(frame).collect()}
        assert got == want
    links = {r.doc_id: r.n_links for r in passages.repeated_passages(frame).collect()}
    assert links == {i: sum(i in pair for pair in want) for i in range(24)} and 20 < len(want)


def test_passages_by_brute_force(spark):
    rng = np.random.default_rng(7)
    sources = [[f"s{k}w{j}" for j in range(90)] for k in range(4)]
    rows = []
    for i in range(60):
        text = [f"d{i}w{j}" for j in range(30)]
        source = sources[int(rng.integers(0, 4))]
        at = int(rng.integers(0, 40))
        text += [f"d{i}e{j}" if rng.random() < 0.02 else w for j, w in enumerate(source[at:at + int(rng.integers(40, 90))])]
        rows.append((i, " ".join(text)))
    runs = [passages.shingles(t) for _, t in rows]
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if passages.verify(runs[j], runs[i], 46, 0.8):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(60)] == root and 4 < len(set(root)) < 50


# ---- 3 main text ------------------------------------------------------------------
def test_blocks_and_extraction(spark):
    page = "<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A&amp;B</h1><p>One <b>t</b>wo\n three<p>Four</article><script>x<p></script><footer>&copy; me"
    assert [b.text for b in html.blocks_of(page)] == ["Home", "A&B", "One two three", "Four", "© me"]
    article = "A&B One two three Four more words of the text."
    pages = [(f"<nav><a>Menu</a></nav><article><h1>Title {i}</h1><p>Some words of page {i} go here.<p>Last {i}.</article><footer>&copy; site {i}</footer>",
              f"Title {i} Some words of page {i} go here. Last {i}.") for i in range(30)]
    known = [(html.blocks_of(h), html.labels_by_text(html.blocks_of(h), t)) for h, t in pages]
    assert known[0][1] == [0, 1, 1, 1, 0] and html.labels_by_text(html.blocks_of(page), article) is None
    model = html.train(known)
    frame = spark.createDataFrame([(1, "u", pages[0][0]), (2, None, None), (None, "v", ""), (4, "w", "<p")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(frame.withColumn("text", F.lit("clash")), model).collect()}
    assert got[1] == (pages[0][1], len(pages[0][1])) and got[2] == got[None] == ("", 0)
    assert html.extract(frame.limit(0), model).count() == 0
    twice = html.extract(frame.union(frame), model)
    assert twice.count() == 8 and twice.distinct().count() == 4


def test_labels_tile_the_article():
    """A title and a heading with the article's first words are none of it."""
    page = ("<title>One two three four</title><h1>One two three four</h1><nav>five six</nav>"
            "<p>One two three four five six.</p><aside>seven</aside><p>seven</p><p>eight nine ten eleven</p><footer>eight nine ten eleven</footer>")
    blocks = html.blocks_of(page)
    assert html.labels_by_text(blocks, "One two three four five six. seven eight nine ten eleven") == [0, 0, 0, 1, 1, 0, 1, 0]
    assert html.labels_by_text(blocks, "One two three four") == [0, 1, 0, 0, 0, 0, 0, 0]
    assert html.labels_by_text(blocks, "One two three four and more") is None and html.labels_by_text(blocks, "") is None


def test_extraction_equals_the_articles(spark):
    """Pages that the field was not trained on, against the documents they show."""
    pages, documents = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("pages", "documents"))
    seen = {h for h, _ in html.sample(pages, documents)}
    texts = {r.doc_id: " ".join(r.text.split()) for r in documents.select("doc_id", "text").where("text IS NOT NULL").collect()}
    got = html.extract(pages, html.fit(pages, documents)).join(pages.select("page_id", "html"), "page_id").collect()
    rows = [(re.search(r"/(\d+)(?:[/?#.]|$)", r.url or ""), r) for r in got if r.html not in seen]
    known = [texts[int(m[1])] == r.text for m, r in rows if m and int(m[1]) in texts]
    assert len(known) > 1000 and np.mean(known) >= 0.99


def test_long_and_deep_pages_take_linear_time():
    import time

    def seconds(page):
        began = time.process_time()
        blocks = html.blocks_of(page)
        return time.process_time() - began, len(blocks)

    for make in (lambda n: "".join(f"<div id=i{i} class='c{i} d'>t{i}" for i in range(n)), lambda n: "<div>x" * n, lambda n: "<p id=a>t" * n,
                 lambda n: "<b>" * n + "<div>x</div>" * n):
        small, large = (min(seconds(make(n)) for _ in range(2)) for n in (2000, 16000))
        assert large[1] == 8 * small[1] and large[0] < 24 * small[0] + 0.2


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    blocks = [html.Block(f"t{i}", "p", [], 0) for i in range(7)]
    index = {f: i for i, f in enumerate(sorted({f for row in html.features(blocks) for f in row}))}
    model = html.Field(index, rng.normal(size=(len(index), 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    emit = model.scores(html.features(blocks))

    def score(path):
        return model.first[path[0]] + sum(emit[i, y] for i, y in enumerate(path)) + sum(model.move[a, b] for a, b in zip(path, path[1:]))

    every = [[n >> i & 1 for i in range(7)] for n in range(128)]
    assert model.decode(blocks) == max(every, key=score)


# ---- 4 packing -----------------------------------------------------------------------
def test_word_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    texts = [t or "" for _, t in TEXTS] + ["a  b", " a", "a ", "a\n \nb", "<|endoftext|> x", "x<|endoftext|>y <|endoftext|", "<|endoftext|>", "it's  I'll", "½ x²", "a\x1c b"]
    got = packing.WordEncoder(packing.tokenizer_file(), packing.tokenizer_file("byte_bpe_50k.tiktoken")).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_encoder_holds_few_words():
    """A worker's encoder stays between stages, beside those of other tasks."""
    encoder = packing.WordEncoder(packing.tokenizer_file(), packing.tokenizer_file("byte_bpe_50k.tiktoken"))
    for part in range(4):
        got = encoder.encode([" ".join(f"w{i}" for i in range(part * 100_000, (part + 1) * 100_000))])
        assert len(got[0]) > 400_000 and len(encoder.known) < 350_000


def test_packing(docs, nothing):
    rows = packing.pack_documents(docs).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE_TOKENS
    assert sorted(by_doc[6])[0][2] < 2048 and all(n == 2048 for _, _, n in sorted(by_doc[6])[1:])
    assert by_doc[3] == by_doc[4] == [(0, 0, 1)] and len(by_doc[9]) == 2 and None in by_doc
    assert packing.pack_documents(nothing).count() == 0


def test_fullest_bin_closes_first():
    bins = packing.Bins(10, 2)
    assert [bins.place(n) for n in (5, 7, 8, 2, 3, 5)] == [(0, 0), (1, 0), (2, 0), (1, 7), (0, 5), (3, 0)]


# ---- 5 URLs -----------------------------------------------------------------------------
def test_url_rules(spark):
    urls = ["https://A.b.NET/x", "http://example.net/en/1?q", "https://m.example.com/de/5", "http://x.org/fr/", "http://net/", "http://net",
            "no scheme", None, "http://knet/x", "ftp://h?x=1#f", "http://bad.test/spam/1.html"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("host", F.lit(1))
    labelled = spark.createDataFrame([(f"http://bad.test/spam/{i}.html", "block") for i in range(20)]
                                     + [(f"http://fine.test/news/{i}", "allow") for i in range(60)], "url string, label string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(pages, labelled, queries.URL_RULES).collect()}
    assert got[0] == ("a.b.net", "/x", "net/", "block") and got[1][2:] == ("example.net/en/", "allow")
    assert got[2][2:] == ("example.com/de/", "block") and got[3][2:] == ("org/fr/", "allow") and got[4][2] == "net/"
    assert got[5][2] is None and got[6][:2] == got[7][:2] == ("", "") and got[8][2] is None and got[9][:2] == ("h", "")
    assert got[10][3] == "block"
    assert urlrules.judge(pages.limit(0), labelled.limit(0), queries.URL_RULES).count() == 0


def test_url_tokens_name_all_labels_and_parts(spark):
    urls = ["https://m.casino-win.example.com/a/7/slots/1.html", "http://h"]
    got = [set(r.t) for r in spark.createDataFrame([(u,) for u in urls], "url string").select(urlrules.tokens(F.col("url")).alias("t")).collect()]
    assert {"sub:m", "sub:casino-win", "domain:example.com", "dir:a", "dir:slots", "page:1.html", "end:html"} <= got[0] and "dir:7" not in got[0]
    assert got[1] == {"host:h", "domain:h", "top:h"}
    labelled = spark.createDataFrame([(f"http://s{i}.casino.example.com/x/{i}", "block") for i in range(20)]
                                     + [(f"http://s{i}.news.example.com/x/{i}", "allow") for i in range(40)], "url string, label string")
    pages = spark.createDataFrame([(1, "http://new.casino.example.com/x/9"), (2, "http://new.news.example.com/x/9")], "page_id long, url string")
    assert [r.verdict for r in urlrules.judge(pages, labelled, []).orderBy("page_id").collect()] == ["block", "allow"]


# ---- 6 archives ----------------------------------------------------------------------------
def test_archives(spark, tmp_path):
    import hashlib
    import zipfile

    rows = [(3, "u\r\nx", "same"), (2, None, "same"), (5, "v", "same"), (1, "w", None), (4, "é", ""), (None, "n", "sole 😀"), (7, "x", "b" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = f"file://{tmp_path}/warc"
    got = {r.page_id: r for r in warc.round_trip(pages, folder).collect()}
    for page_id, _, text in rows:
        payload = (text or "").encode()
        assert got[page_id].payload_bytes == len(payload)
        assert got[page_id].payload_digest == warc.digest_of(payload)
    assert [(got[i].record_type, got[i].refers_to) for i in (2, 3, 5, 1, 4)] == [
        ("response", None), ("revisit", 2), ("revisit", 2), ("response", None), ("revisit", 1)]
    assert bytes(got[7].payload) == b"b" * 100_000 and hashlib.sha1(got[7].payload)
    archives = list((tmp_path / "warc").glob("*.zip"))
    assert sum(len(zipfile.ZipFile(a).read(warc.INDEX).splitlines()) for a in archives) == len(rows)
    assert all(zipfile.ZipFile(a).testzip() is None for a in archives)
    assert warc.round_trip(pages.limit(0), f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("zip64", [True, False])
def test_directory(tmp_path, zip64):
    from pyarrow import fs

    path = str(tmp_path / "a.zip")
    with open(path, "wb") as out:
        z = warc.StoredZip(out, zip64)
        for name, data in (("one", b"abc"), ("two", b"defg")):
            z.begin(name)
            z.add(data)
            z.end()
        z.close()
    with fs.LocalFileSystem().open_input_file(path) as source:
        members = warc.directory(source)
        assert {n: source.read_at(m.size, warc.data_offset(source, m)) for n, m in members.items()} == {"one": b"abc", "two": b"defg"}


# ---- 7 lines -------------------------------------------------------------------------------
def test_lines_by_brute_force(docs, nothing):
    got = {(r.doc_id, r.text): r for r in linededup.dedup_lines(docs).collect()}
    seen, want = [], {}
    for doc, text in sorted(((d if d is not None else 1 << 62, t) for d, t in set(TEXTS)), key=lambda x: x[0]):
        kept = []
        for line in (text or "").split("\n"):
            words = set(re.split(r"[ \t\r\f\v]+", line.lower())) - {""}
            if not words or not any(len(words & w) / len(words | w) >= 0.8 for w in seen):
                kept.append(line)
            if words:
                seen.append(words)
        want[doc if doc < 1 << 62 else None] = None if text is None else "\n".join(kept)
    assert {k[0]: k[1] for k in got} == want
    assert linededup.dedup_lines(docs).columns == docs.columns + ["n_lines_removed"]
    assert linededup.dedup_lines(nothing).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    rows = [(1, "x y z"), (None, "x y z"), (None, "a b c"), (None, "d e f\nx y z"), (2, "g h i\nj k l"), (2, "j k l\nm n o"),
            (2, "p q r"), ((1 << 63) - 1, "s t u"), (None, "s t u")]
    got = sorted(((r.doc_id or 0), r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    shared = [t for d, t in got if d == 2]
    assert sorted(line for t in shared for line in t.split("\n") if line) == ["g h i", "j k l", "m n o", "p q r"]
    assert [t for d, t in got if d == 0] == ["", "", "a b c", "d e f"] and [t for d, t in got if d in (1, (1 << 63) - 1)] == ["x y z", "s t u"]


def test_line_dedup_pairs_in_a_group_of_near_copies(spark):
    """Copies with rarest words of their own, and long lines that are not quite
    similar, are not all paired up; what goes is what brute force says."""
    rng = np.random.default_rng(3)

    def group(name: str, words: int, lines: int, changed: int) -> list[str]:
        base = [f"{name}{i}" for i in range(words)]
        out = []
        for k in range(lines):
            line = list(base)
            for i in rng.choice(words, changed, replace=False):
                line[i] = f"{name}own{k}x{i}"
            out.append(" ".join(line))
        return out

    lines = group("a", 70, 60, 3) + group("b", 150, 40, 35)
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], SCHEMA)
    rows = docs.select(linededup.document("doc_id", "text").alias("doc"), "text")
    sigs = linededup.stored(linededup.signatures(linededup.line_classes(rows), linededup.rarity_table(rows), 0.8), "test")
    settled = linededup.settle(sigs, rows, 0.8)
    marked = linededup.stored(sigs.join(settled.withColumn("done", F.lit(1)), ["doc", "pos"], "left"), "test")
    assert linededup.by_prefix(marked, 0.8).count() <= 3 * len(lines)  # of 2550 pairs within the groups
    sets = [set(line.split()) for line in lines]
    gone = [i for i, a in enumerate(sets) if any(len(a & b) / len(a | b) >= 0.8 - 1e-9 for b in sets[:i])]
    assert gone and [r.doc_id for r in linededup.dedup_lines(docs).where("n_lines_removed > 0").orderBy("doc_id").collect()] == gone


# ---- 8 neighbours --------------------------------------------------------------------------
def test_neighbours_search_in_portions():
    """The search verifies few rows of a shard with groups, all if the limit says so."""
    rng = np.random.default_rng(6)
    centres = 50 * rng.normal(size=(30, 16))
    vectors = centres[np.arange(3000) % 30] + rng.normal(size=(3000, 16))
    ids = [np.array([2 * i, 2 * i + 1]) if i % 7 == 0 else np.array([2 * i]) for i in range(3000)]
    stable = rng.standard_normal((16, 12))
    verified = []

    class Counted(neighbours.Shard):
        def named(self, rows, d):
            verified.append(len(rows))
            return super().named(rows, d)

    for limit, most in ((math.inf, 9 * 3000), (neighbours.chi_square_quantile(12, 0.97), 9 * 400)):
        shard = Counted(vectors, ids, stable)
        verified.clear()
        for q, apart in zip(range(0, 900, 100), shard.projected(vectors[0:900:100] @ stable)):
            d, i = neighbours.search(shard, apart, vectors[q], 2 * q, 10, limit)
            true = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
            best = sorted((true[r], x) for r in range(3000) for x in ids[r].tolist() if x != 2 * q)[:10]
            assert i.tolist() == [x for _, x in best] and d == pytest.approx([x for x, _ in best])
        assert sum(verified) <= most


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1500, 16)).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0]), (None, [1.0] * 16), (7, vectors[7].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    got = {}
    for r in neighbours.nearest(frame, rows_per_shard=600, queries_per_block=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 1500, 100))
    found = 0
    for q, hits in got.items():
        d = np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        found += len(set(best.tolist()) & {i for _, i, _ in hits})
        assert all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in hits) and [r for r, _, _ in sorted(hits)] == list(range(1, 11))
    assert found >= 0.95 * 10 * len(got)
    assert neighbours.nearest(frame.limit(0)).count() == 0
    assert neighbours.chi_square_quantile(2, 0.95) == pytest.approx(5.991, abs=1e-3)


def test_neighbours_in_a_large_group_of_copies(spark):
    """More copies than a leaf holds: those with the smallest ids are nearest."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(1800, 16))
    vectors[rng.permutation(1800)[:700]] = vectors[0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame, query_modulus=50, rows_per_shard=700, queries_per_block=16).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    copies = [i for i in range(1800) if (vectors[i] == vectors[0]).all()]
    asked = [q for q in copies if q % 50 == 0]
    assert len(asked) > 5
    for q in asked:
        assert [i for _, i in sorted(got[q])] == [i for i in copies if i != q][:10]


# ---- 9 decontamination -----------------------------------------------------------------------
def test_decontamination_edges(spark, docs, nothing):
    items = spark.createDataFrame([(1, "quick BROWN fox"), (2, None), (None, "one"), (3, LONG[:400]), (1, "quick BROWN fox")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[9].items) == (3, 1, ["null"]) and not got[3].contaminated and got[6].n_items == 1
    blocks = {r.doc_id: r for r in decontaminate.decontaminate(docs, items, block_bytes=1).collect()}
    assert {k: (r.n_hit, r.items_sha256) for k, r in blocks.items()} == {k: (r.n_hit, r.items_sha256) for k, r in got.items()}
    assert decontaminate.decontaminate(nothing, items).count() == 0
    assert not decontaminate.decontaminate(docs, items.limit(0)).where("contaminated").count()


def test_search_finds_all_occurrences():
    rng = np.random.default_rng(2)
    words = [b"ab", b"b", b"abc", b"ca"]
    text = [words[i] for i in rng.integers(0, 4, 400)]
    items = [(str(k), [words[i] for i in rng.integers(0, 4, n)]) for k, n in enumerate((1, 2, 3, 4, 5))]
    places, found = decontaminate.Search(items, 3).hits(text)
    want, names = set(), set()
    for name, item in items:
        n = min(3, len(item))
        for i in range(len(item) - n + 1):
            for j in range(len(text) - n + 1):
                if text[j:j + n] == item[i:i + n]:
                    want |= set(range(j, j + n))
                    names.add(name)
    assert (places, found) == (want, names)


# ---- 10 SimHash --------------------------------------------------------------------------------
def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_decontamination_of_long_texts_takes_linear_time():
    import time

    item = " ".join(f"w{i}" for i in range(40))
    search = decontaminate.Search([("i", decontaminate.words_of(item))], 10)

    def seconds(n):
        words = decontaminate.words_of(" ".join([item] * n))
        began = time.process_time()
        places, found = search.hits(words)
        assert len(places) == 40 * n and found == {"i"}
        return time.process_time() - began

    small, large = (min(seconds(n) for _ in range(2)) for n in (500, 4000))
    assert large < 24 * small + 0.2


def test_simhash_by_brute_force(spark, docs, nothing):
    rows = TEXTS + [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text").collect()]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit(1))
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(frame).collect()}
    fps = {(d, f"{slow_fingerprint(t):016x}") for d, t in rows}
    assert set(got) == fps
    names = sorted({f for _, f in fps})
    root = {f: f for f in names}
    for a in names:
        for b in names:
            if (int(a, 16) ^ int(b, 16)).bit_count() <= 4:
                old, new = root[b], root[a]
                root = {f: new if r == old else r for f, r in root.items()}
    least = {}
    for d, f in fps:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    assert got == {(d, f): least.get(root[f]) for d, f in fps}
    assert simhash.near_duplicates(nothing).count() == 0


def test_anchors_cover_close_pairs():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(300):
        for bit in rng.choice(64, 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    rows, cells, home = simhash.anchors(a, 1)
    rows2, cells2, _ = simhash.anchors(b, 1)
    near = {(r, c) for r, c in zip(rows2, cells2)}
    assert len({r for r, c, h in zip(rows, cells, home) if h and (r, c) in near}) == 300


# ---- pipeline ------------------------------------------------------------------------------------
def test_pipeline_stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    kept = corpus_pipeline.keep_identified(spark, docs, sf_small)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    one = corpus_pipeline.keep_one_of_each_group(spark, docs, sf_small)
    groups = simhash.near_duplicates(docs).select("component_id").distinct().count()
    assert one.columns == docs.columns and one.count() == groups
    clean = corpus_pipeline.drop_contaminated(spark, one, sf_small)
    hit = decontaminate.decontaminate(one, spark.read.parquet(f"{sf_small}/benchmark.parquet")).where("contaminated").count()
    assert clean.count() == one.count() - hit and [n for n, _ in corpus_pipeline.STAGES][0] == "language ID"


def test_stages_judge_rows_not_ids(spark, tmp_path, monkeypatch):
    words = [" ".join(f"{c}{i}word" for i in range(40)) for c in "abcdef"]
    rows = [(None, "12 34"), (None, words[0]), (5, words[1]), (5, "56 78"), (None, None), (6, words[2]), (None, words[2]), (6, words[2]),
            (7, words[2]), (7, words[3]), (None, words[4]), (None, words[4])]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.lit("en"))

    def texts(df):
        return sorted(((r.doc_id or 0), r.text or "") for r in df.collect())

    monkeypatch.setattr(corpus_pipeline, "MIN_LANGUAGE_SCORE", 0.0)
    want = sorted(((d or 0), t) for d, t in rows if t and "word" in t)
    assert texts(corpus_pipeline.keep_identified(spark, docs, "")) == want
    clean = docs.where("text LIKE '%word%'")
    one = corpus_pipeline.keep_one_of_each_group(spark, clean, "")
    assert texts(one) == sorted([(0, words[0]), (5, words[1]), (6, words[2]), (7, words[3]), (0, words[4])]) and one.columns == docs.columns
    spark.createDataFrame([(1, words[0]), (2, words[1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hit = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert texts(hit) == sorted(((d or 0), t or "") for d, t in rows if t not in words[:2])
