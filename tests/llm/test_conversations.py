"""Conversation repair: every edit script by hand, long conversations by segments, edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from filinglens.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            out += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def _scripts(rows):
    """Every edit script with up to three insertions a place: cost, audit, result."""
    best = None
    gaps = [[()] + [tuple("ua"[(i + k) % 2] for k in range(n)) for n in (1, 2, 3) for i in (0, 1)] for _ in range(len(rows) + 1)]
    ways = []
    for role, text, drop, late in rows:
        options = [("D", 2, None)]
        if not drop:
            extra = 5 if late else 0
            options += [("K", extra, (role, text)), *(("R", 1 + extra, (r, text)) for r in ("user", "assistant"))]
        ways.append(options)
    for chosen in itertools.product(*ways):
        for ins in itertools.product(*gaps):
            out, audit, cost = [], "", 0
            for i, gap in enumerate(ins):
                out += [({"u": "user", "a": "assistant"}[x], "") for x in gap]
                audit, cost = audit + "I" * len(gap), cost + 5 * len(gap)
                if i < len(rows):
                    edit, more, row = chosen[i]
                    audit, cost = audit + edit, cost + more
                    out += [row] if row else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best


def _by_hand(rows):
    """All but the repair."""
    seen, counts, facts = set(), [0, 0, 0], []
    for _, role, text in rows:
        blank, again = not text.strip(SPACE), (role, text) in seen
        late = not blank and text.strip(SPACE)[-1] not in ".!?"
        seen.add((role, text))
        for i, fault in enumerate((blank, again, late)):
            if fault:
                counts[i] += 1
                break
        facts.append((role, text, blank or again, late))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *counts, illegal), facts


def _found(spark, rows, schema=SCHEMA, **kw):
    return {r["conv_id"]: tuple(r)[1:] for r in cr.repaired(spark.createDataFrame(rows, schema), **kw).collect()}


def _conversations(rng, n, most):
    texts = ["a.", "b!", "c", "d", " ", "", "e?\n", None, "é."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool"]
    return [(c, None if rng.random() < 0.1 else rng.randrange(12), rng.choice(roles), rng.choice(texts))
            for c in range(n) for _ in range(rng.randrange(1, most + 1))]


def test_cheapest_of_all_scripts(spark):
    rows = _conversations(random.Random(1), 60, 3)
    found = _found(spark, rows)
    for conv, group in itertools.groupby(rows, key=lambda r: r[0]):
        after = _damaged(group)
        head, facts = _by_hand(after)
        cost, audit, text = _scripts(facts)
        assert found[conv] == (*head, cost, audit, hashlib.sha256(text.encode()).hexdigest()), (conv, after)


def _plain(facts):
    """The cheapest repair by a table over (rows read, state of the role pattern), insertions relaxed."""
    moves = {"-": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def relaxed(table):
        for _ in range(4):
            for state, (cost, audit, out) in list(table.items()):
                for r, after in moves[state].items():
                    if r != "s":
                        table[after] = min(table.get(after, (1 << 60,)), (cost + 5, audit + "I", out + (f"{names[r]}:",)))
        return table

    table = relaxed({"-": (0, "", ())})
    for role, text, drop, late in facts:
        new, extra = {}, 5 if late else 0
        for state, (cost, audit, out) in table.items():
            ways = [(state, (cost + 2, audit + "D", out))]
            if not drop:
                if role[:1] in moves[state]:
                    ways.append((moves[state][role[:1]], (cost + extra, audit + "K", out + (f"{role}:{text}",))))
                ways += [(after, (cost + 1 + extra, audit + "R", out + (f"{names[r]}:{text}",)))
                         for r, after in moves[state].items() if r != "s"]
            for after, way in ways:
                new[after] = min(new.get(after, (1 << 60,)), way)
        table = relaxed(new)
    cost, audit, out = min(table[s] for s in ("-", "a") if s in table)
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


@pytest.mark.parametrize("long", [2048, 5])
def test_longer_conversations(spark, monkeypatch, long):
    """Equal results whether conversations stream whole or go by segments."""
    monkeypatch.setattr(cr, "SEGMENT", 4)
    rng = random.Random(2)
    rows = _conversations(rng, 40, 25)
    for i in range(60):
        rows.append((100, i, ("user", "assistant")[i % 2], f"t{i}" if i % 7 == 0 else f"t{i}."))
    rows += [(None, i % 4, "user", "same.") for i in range(30)]
    rows += [(101, i, "system", "s.") for i in range(9)]
    found = _found(spark, rows, long=long)
    convs = {c: [r for r in rows if r[0] == c] for c in {r[0] for r in rows}}
    assert set(found) == set(convs)
    for conv, group in convs.items():
        head, facts = _by_hand(_damaged(group))
        assert found[conv] == (*head, *_plain(facts)), conv


def test_edges(spark):
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    rows = [(7, gone, "user", "x."), (None, None, None, None), (8, None, "user", "q" * 2_000_000 + "."), (8, None, "assistant", "r.")]
    found = _found(spark, rows)
    assert found[7] == empty
    for conv in (None, 8):
        head, facts = _by_hand(_damaged([r for r in rows if r[0] == conv]))
        assert found[conv] == (*head, *_plain(facts))
    assert _found(spark, [(*r, "a", 3) for r in rows], SCHEMA + ", g string, pos int") == found
    assert _found(spark, []) == {}
