"""Operators on pairs of texts, and the pipeline: brute force, planted cases, edge cases."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline

from filinglens.llm import decontamination, jaccard_join
from filinglens.llm.components import components

SF = "/root/testdata/sf0.001"
EDGES = (None, "", "  ", "one", "ONE", "one two three", "One two Three", "é é é é é", "x" * 4000, "x" * 4000)


def _root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def _least(nodes, links):
    parent = {n: n for n in nodes}
    for a, b in links:
        a, b = _root(parent, a), _root(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: _root(parent, n) for n in nodes}


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _by_hand(texts):
    sets = {i: _set(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in _least(sets, links).items()}


def _joined(spark, texts):
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in texts.items()], "doc_id long, text string, n long, component string")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(frame).collect()}


def _family(rng, size, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(size - 1):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_join_equals_all_pairs(spark):
    rng = random.Random(5)
    texts = [*EDGES]
    for size, words, edits in ((90, 120, 6), (25, 60, 4), (12, 400, 30), (6, 30, 2), (40, 7, 1)):
        texts += _family(rng, size, words, edits)
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(n)) for n in (3, 5, 8, 9, 10, 11, 12, 60, 80)]
    texts = dict(enumerate(rng.sample(texts, len(texts))))
    assert _joined(spark, texts) == _by_hand(texts)


def test_join_without_quick_links(spark, monkeypatch):
    """Prefixes alone find every link that quick links would."""
    rng = random.Random(8)
    texts = dict(enumerate([*_family(rng, 60, 150, 5), *_family(rng, 100, 40, 2), *_family(rng, 8, 500, 40)]))
    nothing = spark.createDataFrame([], "u long, v long")
    monkeypatch.setattr(jaccard_join, "_quick_links", lambda *a: nothing)
    monkeypatch.setattr(jaccard_join, "_second_links", lambda *a: nothing)
    monkeypatch.setattr(jaccard_join, "HOT", 16)
    assert _joined(spark, texts) == _by_hand(texts)


def test_join_on_edges(spark):
    assert _joined(spark, dict(enumerate(EDGES))) == {
        0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (1, 8), 9: (1, 8)}
    frame = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, "q")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard_join.near_duplicates(frame).collect())
    assert got == [("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]
    assert jaccard_join.near_duplicates(frame.limit(0)).count() == 0


def test_large_groups_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP", 8)
    texts = dict(enumerate(_family(random.Random(2), 80, 60, 1)))
    assert _joined(spark, texts) == _by_hand(texts)


def test_representatives(spark):
    frame = spark.createDataFrame(
        [(3, "a b c", 1), (2, "a B c", 2), (7, "other words", 3), (None, "n", 4), (9, None, 5)], "doc_id long, text string, n_chars long")
    kept = jaccard_join.representatives(frame)
    assert kept.columns == frame.columns
    assert sorted(r["n_chars"] for r in kept.collect()) == [2, 3, 4, 5]


def test_representatives_go_by_row(spark):
    x, y = "a b c d e f g h", "some quite other words than those"
    rows = [
        (1, x, 1), (1, x, 1), (1, x, 1), (2, x, 2),  # repeated rows of the smallest id
        (2, y, 3),  # an id with two texts, one of them a copy
        (None, "A b c d e f g h", 4),  # a copy without an id
        (None, "no id here at all", 5), (None, "no id here at all", 5), (None, "no id here at all", 6),
        (4, None, 7), (4, "", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    kept = [tuple(r) for r in jaccard_join.representatives(frame.repartition(3)).collect()]
    texts = [r[:2] for r in kept]
    assert sorted(r[2] for r in kept if r[1] and r[0]) == [1, 3] and len(kept) == 5
    assert texts.count((None, "no id here at all")) == 1 and (4, None, 7) in kept and (4, "", 8) in kept


@pytest.mark.parametrize("clash, nulls", [(31, 3), (99, 0)])
def test_representatives_in_doubt(spark, monkeypatch, clash, nulls):
    """Full bit arrays and columns with inner names change nothing."""
    rng = random.Random(3)
    texts = [t for t in _family(rng, 30, 50, 2) + _family(rng, 5, 40, 1) + ["alone in its class"] * 2]
    rows = [(i % clash, t, i % clash, "x") for i, t in enumerate(texts)] + [(None, texts[0], 1, "x")] * nulls
    frame = spark.createDataFrame(rows, "doc_id long, text string, _node long, _kind string")
    want = sorted(map(str, jaccard_join.representatives(frame).collect()))
    full = jaccard_join.shared.bit_array
    monkeypatch.setattr(jaccard_join.shared, "bit_array", lambda keys, bits=jaccard_join.shared.BITS: full(keys, bits) | np.uint8(0 if keys.isEmpty() else 255))
    assert sorted(map(str, jaccard_join.representatives(frame).collect())) == want


def test_components(spark):
    rng = random.Random(1)
    for nodes, n in ((40, 25), (300, 280), (10, 0)):
        links = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]
        want = {x: c for x, c in _least(range(nodes), links).items() if any(x in e and e[0] != e[1] for e in links)}
        got = components(spark.createDataFrame(links, "u long, v long"))
        assert {r["node"]: r["component"] for r in got.collect()} == want
    path = [(i, i + 1) for i in range(70)]
    assert {r["component"] for r in components(spark.createDataFrame(path, "u long, v long")).collect()} == {0}


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(50):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(1, 15))], [rng.randrange(6) for _ in range(rng.randrange(20))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontamination.common_subsequence(a, b) == best[-1][-1]


def _words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_leaks_are_the_verbatim_passages(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()}
    grams, size = {}, {}
    for r in items.collect():
        w = _words(r["text"])
        size[r["item_id"]] = len(w) - 4
        for i in range(len(w) - 4):
            grams.setdefault(tuple(w[i : i + 5]), set()).add((r["item_id"], i))
    held = {}
    for r in docs.collect():
        w = _words(r["text"])
        for i in range(len(w) - 4):
            for item, at in grams.get(tuple(w[i : i + 5]), ()):
                held.setdefault((r["doc_id"], item), set()).add(at)
    want = {k for k, v in held.items() if len(v) >= 0.5 * size[k[1]]}
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(got)


def test_paraphrases_and_clean_texts(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    items = [[word() for _ in range(30)] for _ in range(12)]
    reworded = [w if i >= 20 or i % 3 else word() for i, w in enumerate(items[0])]
    texts = [
        " ".join([word() for _ in range(100)] + reworded + [word() for _ in range(50)]), " ".join(items[1]).upper(),
        " ".join(word() for _ in range(200)), " ".join(items[2][:6]), None, "", "x" * 3000,
        " ".join(items[3] + [word() for _ in range(500)] + items[4])]
    docs = spark.createDataFrame([(i, t, 0.1) for i, t in enumerate(texts)], "doc_id long, text string, cosine double")
    bench = spark.createDataFrame(
        [(i, " ".join(w[:20]) + ". " + " ".join(w[20:]), 0) for i, w in enumerate(items)] + [(50, None, 0), (51, "", 0)],
        "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()}
    assert got == {(0, 0), (1, 1), (7, 3), (7, 4)}
    assert sorted(r["doc_id"] for r in decontamination.clean(docs, bench).collect()) == [2, 3, 4, 5, 6]
    assert decontamination.leaks(docs.limit(0), bench).count() == 0
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_parts_of_long_items_and_rows_without_id(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    filler = lambda n: [word() for _ in range(n)]
    items = [filler(n) for n in (120, 200, 120, 1000, 130)]
    cuts = [(0, 31, 91), (1, 7, 107), (2, 0, 80), (3, 517, 577), (4, 70, 130), (0, 10, 30), (3, 100, 125)]
    texts = [" ".join(filler(150) + items[i][a:b] + filler(90)) for i, a, b in cuts]
    clear = " ".join(filler(300))
    rows = [*enumerate(texts), (None, texts[0]), (0, clear), (None, clear), (9, clear), (9, None)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, digest string, _leaked string")
    bench = spark.createDataFrame([(i, " ".join(w) + ".") for i, w in enumerate(items)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(0, 0), (None, 0), (1, 1), (2, 2), (3, 3), (4, 4)], key=str)
    kept = [(r["doc_id"], r["text"]) for r in decontamination.clean(docs, bench).collect()]
    assert sorted(kept, key=str) == sorted([(5, texts[5]), (6, texts[6]), (0, clear), (None, clear), (9, clear), (9, None)], key=str)


def test_blocks_find_what_one_block_finds(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 16)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(docs, items).collect()} == one


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "slot", "shard"]
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert kept and all(texts[i] == t for i, t in kept.items())
    left = _by_hand(kept)
    assert all(c == i for i, (_, c) in left.items())
    leaked = {r["doc_id"] for r in decontamination.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert not leaked & set(kept)


def test_stages_on_edges(spark):
    docs = spark.createDataFrame(
        [(i, t, "en", "s", 3, "more") for i, t in enumerate(EDGES)],
        "doc_id long, text string, lang string, source string, n_chars long, shard string")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, SF)
            assert out.count() <= rows.count()
            assert name == "sharding" or out.columns == docs.columns
