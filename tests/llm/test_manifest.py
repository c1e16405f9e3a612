"""Merkle manifest: a plain recursive version, tampering, edge cases."""

import hashlib
import zlib

import pytest

from filinglens.llm import merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _tree(nodes):
    """Root, and per node the (left, right) digests of its way up."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(place):
            run = nodes[i - i % 3 : i - i % 3 + 3]
            paths[k].append((run[: i % 3], run[i % 3 + 1 :]))
        nodes, place = [_h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in place]
    return nodes[0], paths


def _by_hand(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, _leaf(row, row[1]), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, upper = _tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, upper):
        for (known, _, leaf, row), path in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1]):
            bad = known and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            folded = _leaf(row, row[1].replace("\n", "")) if bad else leaf
            for left, right in path + top:
                folded = _h(*left, folded, *right)
            proof = _h(*[x for left, right in path + top for x in left + right])
            out.append((row[0], leaf, trees[g][0], root, proof, folded, folded == root))
    return sorted(out, key=str)


def _found(spark, rows, schema=SCHEMA, **kw):
    return sorted((tuple(r) for r in merkle_manifest.manifest(spark.createDataFrame(rows, schema), **kw).collect()), key=str)


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_equals_recursion(spark, height):
    """Sources of 1 to 100 rows: lone leaves, ragged runs at every level, many rounds of exchange."""
    rows, n = [], 0
    for source, size in (("a", 1), ("b", 2), (None, 3), ("é", 4), ("", 10), ("Z", 28), ("hot", 100), ("q", 82)):
        for _ in range(size):
            rows.append((n, f"line {n}\nmore\n" if n % 3 else f"line {n}", "en" if n % 5 else None, source, n if n % 7 else None))
            n += 1
    rows.reverse()
    expected = _by_hand(rows)
    assert _found(spark, rows, height=height) == expected
    assert {r[-1] for r in expected} == {True, False}


def test_many_sources(spark):
    """More sources than one block holds: the tree of subroots is exchanged as well."""
    rows = [(i, "a\nb", "en", f"s{i // 2}", 3) for i in range(40)]
    assert _found(spark, rows, height=1) == _by_hand(rows)


def test_edges(spark):
    """Null ids, repeated rows and ids, nulls, empty and long texts, an extra column with an inner name."""
    rows = [(None, "x\ny", None, None, None), (None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0), (1, "other", "", "", 0),
            (2, "x" * 300_000 + "\n", "de", "s", 300_001), (3, "\n", "de", "s", 1), (-4, "é\n", "de", "s", 2)]
    expected = _by_hand(rows)
    assert _found(spark, rows, height=1) == expected
    wide = [(*r, "g", 7) for r in rows]
    assert _found(spark, wide, SCHEMA + ", node string, pos int", height=1) == expected
    assert _found(spark, rows[:1], height=1) == _by_hand(rows[:1])
    assert _found(spark, []) == []
