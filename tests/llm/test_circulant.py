"""Circulant MinHash dedup: all pairs by hand, the exact way of crowded buckets, edge cases."""

import random
import re

import numpy as np
import pytest

from filinglens.llm import circulant_minhash as cm
from filinglens.llm import text as tx
from filinglens.llm.jaccard_join import Sets
from filinglens.session import Scratch

EDGES = (None, "", "  ", "one", "ONE", "one two three", "One two Three", "é é é é é", "x" * 4000, "x" * 4000)


def _set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _by_hand(texts):
    sets, parent = {i: _set(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in texts}


def _found(spark, texts):
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in texts.items()], "doc_id long, text string, key long, component string")
    return {r[0]: (r[1], r[2], r[3]) for r in cm.near_duplicates(frame).collect()}


def _edited(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def _words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def _corpus(rng):
    texts = list(EDGES)
    for size, words, edits in ((60, 120, 4), (25, 60, 2), (12, 400, 14), (6, 30, 1), (40, 7, 1)):
        base = _words(rng, words)
        texts += [" ".join(base)] + [_edited(rng, base, rng.randrange(edits + 1)) for _ in range(size - 1)]
    # one template with own endings: similar above, at and below the threshold
    template = _words(rng, 200)
    texts += [" ".join(template + _words(rng, rng.randrange(6, 30))) for _ in range(60)]
    # the same, with one word of the template changed: the frequent shingles differ
    for i in range(12):
        texts += [" ".join(template[:i] + [f"t{i}"] + template[i + 1 :] + _words(rng, rng.randrange(2, 20))) for _ in range(4)]
    return dict(enumerate(rng.sample(texts, len(texts))))


def test_dedup_equals_all_pairs(spark):
    texts = _corpus(random.Random(3))
    assert _found(spark, texts) == _by_hand(texts)


@pytest.mark.parametrize("small", [2, 8])
def test_crowded_buckets(spark, monkeypatch, small):
    """Without hubs, and with every bucket of more than ``small`` members going the exact way."""
    texts = _corpus(random.Random(4))
    monkeypatch.setattr(cm, "SMALL", small)
    monkeypatch.setattr(cm, "LEVELS", (2, 4))
    monkeypatch.setattr(cm, "PART", 7)
    monkeypatch.setattr(cm, "_hub_pairs", lambda met: met.select("u", met["doc_id"].alias("v")).where("false"))
    assert _found(spark, texts) == _by_hand(texts)


@pytest.mark.parametrize("hub", [0, 1, 2])
def test_crowded_way_alone(spark, monkeypatch, hub):
    """The exact way gives every link among the members of a hub, however far from them the hub is."""
    texts = {i: t for i, t in _corpus(random.Random(6)).items() if _set(t)}
    monkeypatch.setattr(cm, "LEVELS", (2, 4))
    hub = sorted(texts, key=lambda i: (len(texts[i]), i))[(len(texts) - 1) * hub // 2]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    scratch = Scratch(spark, "test")
    crowd = docs.selectExpr(f"{hub}L AS u", "doc_id", "doc_id AS component")
    links = cm._confirmed(docs, cm._crowded_pairs(docs, crowd, scratch), scratch)
    got = {r["node"]: r["component"] for r in cm.components(links).collect()}
    assert {i: got.get(i, i) for i in texts} == {i: v[1] for i, v in _by_hand(texts).items()}


def test_signature_estimates_similarity():
    """All coordinates come from two permutations; their share of agreement is the similarity."""
    rng = random.Random(9)
    words = _words(rng, 1200)
    pair = [" ".join(words[:1000]), " ".join(words[200:])]
    data = [t.encode() for t in pair]
    t = tx.Texts(0, np.frombuffer(b"".join(data), np.uint8), np.array([0, len(data[0]), len(data[0]) + len(data[1])]))
    same = np.mean([m[0] == m[1] for m in cm.signature(Sets(t), 2048)])
    a, b = map(_set, pair)
    assert abs(same - len(a & b) / len(a | b)) < 0.04


def test_edges(spark):
    assert _found(spark, dict(enumerate(EDGES))) == {
        0: (0, 0, True), 1: (0, 1, True), 2: (0, 2, True), 3: (1, 3, True), 4: (1, 3, False), 5: (1, 5, True), 6: (1, 5, False),
        7: (1, 7, True), 8: (1, 8, True), 9: (1, 8, False)}
    assert _found(spark, {}) == {}


def test_null_and_repeated_ids(spark):
    a, b = "a b c d e f g", "h i j k l m n"
    rows = [(None, a), (None, b), (None, None), (5, a), (3, a), (7, "x y"), (7, "x y"), (7, a)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in cm.near_duplicates(frame).collect()), key=str)
    assert found == sorted([(None, 3, 3, False), (None, 3, None, True), (None, 0, None, True), (5, 3, 3, False), (3, 3, 3, True),
                            (7, 1, 3, False), (7, 1, 3, False), (7, 3, 3, False)], key=str)


def test_long_text(spark):
    rng = random.Random(2)
    words = _words(rng, 200_000)
    texts = {0: " ".join(words), 1: _edited(rng, words, 2000), 2: " ".join(words[:150_000]), 3: "y" * 3_000_000}
    found = _found(spark, texts)
    assert {i: v[1] for i, v in found.items()} == {0: 0, 1: 0, 2: 2, 3: 3}
    assert found[0][0] == len(_set(texts[0]))
