"""Repair of conversation structure by generalised LR parsing with weighted edits.

Roles go by their first character. A sound conversation follows ``(s?(ua)+)?``, as
the grammar C -> | B | s B, B -> u a | B u a, whose LR automaton is below. Rows are
first damaged on purpose (``damaged``), by the CRC of their conversation and turn.
Each row's first fault counts: blank (nothing but separators), duplicate (role and
text seen earlier in the conversation), truncated (the last character that is no
separator is none of ``.!?``).

The parse keeps a graph-structured stack: its tops after a row are nodes (LR state,
node below), shared by all ways that lead there. Every row may be kept (0) or
reroled to user or assistant (1), unless blank or duplicate, or deleted (2); empty
rows may be inserted anywhere (5); a truncated row that stays adds 5. Ways that
reach the same top merge into the least (cost, audit), the audit being the initials
of the edits. Two ways to one top over the same rows never have audits of which one
begins the other at equal cost, so merging loses no optimum.

A conversation's rows are in the order of (turn, nulls first, role, text); rows equal
in all are interchangeable. Conversations of up to ``LONG`` rows and ``LONG_BYTES``
bytes are parsed as they stream by, one in memory at a time. For longer ones, rows
are placed by range partitions; first holders of a (role, text) come from an
aggregate; segments of ``SEGMENT`` rows are parsed from every possible top at once,
which gives a table (from, to) of least edits; the tables are folded in order; and a
last pass streams the rows through the repair into one digest, as SHA-256 is
sequential. No step holds the rows of a long conversation.

Null texts, roles and parts of the CRC key read as one space. A null conv_id is a
conversation; null turns come first and do not count for gaps. A conversation whose
rows are all dropped has zeros and an empty audit. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm import text as tx
from filinglens.llm.placed import placed
from filinglens.session import Scratch

LONG = 2048
LONG_BYTES = 1 << 25
SEGMENT = 1024
SEPARATORS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}

#: The LR automaton: state and next role to state; completed rules (left side, length); state and left side to state.
SHIFT = {(0, "s"): 2, (0, "u"): 3, (2, "u"): 3, (1, "u"): 4, (5, "u"): 4, (3, "a"): 6, (4, "a"): 7}
REDUCE = {6: ("B", 2), 7: ("B", 3)}
GOTO = {(0, "B"): 1, (2, "B"): 5}
ACCEPT = {0, 1, 5}


def _pushed(top: tuple, role: str) -> tuple | None:
    """The stack top after a role: one shift and the reductions it completes."""
    state = SHIFT.get((top[0], role))
    if state is None:
        return None
    top = (state, top)
    while top[0] in REDUCE:
        left, length = REDUCE[top[0]]
        for _ in range(length):
            top = top[1]
        top = (GOTO[top[0], left], top)
    return top


def _tops() -> list[tuple]:
    """Every stack the grammar can build; left recursion keeps them few."""
    found = [(0, None)]
    for top in found:
        for role in "sua":
            after = _pushed(top, role)
            if after is not None and after not in found:
                found.append(after)
    return found


TOPS = _tops()
STEP = [{r: TOPS.index(p) for r in "sua" if (p := _pushed(t, r)) is not None} for t in TOPS]
ENDS = [i for i, t in enumerate(TOPS) if t[0] in ACCEPT]


def _offer(tops: dict, top: int, cost: int, audit: str) -> bool:
    if top not in tops or (cost, audit) < tops[top]:
        tops[top] = (cost, audit)
        return True
    return False


def inserted(tops: dict) -> dict:
    """The tops with all insertions that pay."""
    new = list(tops)
    while new:
        top = new.pop()
        cost, audit = tops[top]
        for role in ROLES:
            after = STEP[top].get(role)
            if after is not None and _offer(tops, after, cost + INSERT, audit + "I"):
                new.append(after)
    return tops


def stepped(tops: dict, initial: str, drop: bool, late: bool) -> dict:
    """The tops after one more row: ``drop`` if it has to go, ``late`` if it is truncated."""
    found: dict = {}
    extra = TRUNCATED if late else 0
    for top, (cost, audit) in tops.items():
        _offer(found, top, cost + DELETE, audit + "D")
        if drop:
            continue
        if initial in STEP[top]:
            _offer(found, STEP[top][initial], cost + extra, audit + "K")
        for role in ROLES:
            if role in STEP[top]:
                _offer(found, STEP[top][role], cost + REROLE + extra, audit + "R")
    return inserted(found)


class Rebuilt:
    """The digest of a repaired conversation, fed with its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.top, self.hash, self.first = audit, 0, 0, hashlib.sha256(), True

    def _line(self, role: str, text: str) -> None:
        self.hash.update((f"{role}:{text}" if self.first else f"\n{role}:{text}").encode())
        self.first = False

    def _role(self) -> str:
        role = next(r for r in ROLES if r in STEP[self.top])
        self.top = STEP[self.top][role]
        return ROLES[role]

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._line(self._role(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.top = STEP[self.top][role[:1]]
            self._line(role, text)
        elif edit == "R":
            self._line(self._role(), text)

    def digest(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def _or_space(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """g (the conversation), turn, role, text, and what the text alone tells of faults, after the damage."""
    rows = conversations.select(
        _or_space("conv_id").alias("g"), F.col("turn").cast("long").alias("turn"), _or_space("role").alias("role"), _or_space("text").alias("text"),
        (F.crc32(F.concat(_or_space("conv_id"), F.lit(":"), _or_space("turn")).cast("binary")) % 20).alias("hit")).where("hit <> 0")
    rows = rows.select(
        "g", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
    end = F.rtrim("text", F.lit(SEPARATORS))
    return rows.select("*", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("late"))


_ORDER = ("turn", "role", "text")
_RESULT = pa.schema([("g", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])
_SOUND = {"su", "ua", "au"}


def _repair(batches):
    """Whole conversations, sorted by g and order."""
    name, rows = None, []

    def finished():
        tops, seen, counts, illegal = inserted({0: (0, "")}), set(), [0, 0, 0], 0
        turns = {r[0] for r in rows if r[0] is not None}
        for i, (_, role, text, blank, late) in enumerate(rows):
            again = (role, text) in seen
            seen.add((role, text))
            fault = 0 if blank else 1 if again else 2 if late else None
            if fault is not None:
                counts[fault] += 1
            illegal += i > 0 and rows[i - 1][1][:1] + role[:1] not in _SOUND
            tops = stepped(tops, role[:1], blank or again, late)
        cost, audit = min(tops[t] for t in ENDS if t in tops)
        rebuilt = Rebuilt(audit)
        for _, role, text, _, _ in rows:
            rebuilt.row(role, text)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        return (name, gaps, *counts, illegal, cost, audit, rebuilt.digest())

    for batch in batches:
        out = []
        for g, *row in zip(*[batch.column(c).to_pylist() for c in ("g", *_ORDER, "blank", "late")]):
            if g != name:
                if rows:
                    out.append(finished())
                name, rows = g, []
            rows.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT)], schema=_RESULT)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(finished(), _RESULT)], schema=_RESULT)


_SQL_RESULT = "g string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _in_order(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g", *columns)


_CELLS = "array<struct<start:int,top:int,cost:long,audit:string>>"


def _tables(batches):
    """Per segment: least edits from every top to every top, and its adjacent roles."""
    for batch in batches:
        cells, illegal, ends = [], [], []
        for rows in batch.column("rows").to_pylist():
            table = []
            for start in range(len(TOPS)):
                tops = {start: (0, "")}
                for r in rows:
                    tops = stepped(tops, r["initial"], r["drop"], r["late"])
                table += [{"start": start, "top": t, "cost": c, "audit": a} for t, (c, a) in tops.items()]
            cells.append(table)
            initials = [r["initial"] for r in rows]
            illegal.append(sum(x + y not in _SOUND for x, y in zip(initials, initials[1:])))
            ends.append((initials[0], initials[-1]))
        cell = pa.struct([("start", pa.int32()), ("top", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("g"), batch.column("segment"), pa.array(cells, pa.list_(cell)), pa.array(illegal, pa.int64()),
             pa.array([e[0] for e in ends], pa.string()), pa.array([e[1] for e in ends], pa.string())],
            ["g", "segment", "cells", "illegal", "first", "last"])


def _folded(batches):
    """Cost, audit and adjacent roles of a conversation, from its segments' tables in order."""
    name, tops, illegal, last = None, None, 0, ""

    def finished():
        cost, audit = min(tops[t] for t in ENDS if t in tops)
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([illegal], pa.int64()), pa.array([cost], pa.int64()), pa.array([audit])],
            ["g", "illegal", "cost", "audit"])

    for batch in batches:
        for g, cells, wrong, first, end in zip(*[batch.column(c).to_pylist() for c in ("g", "cells", "illegal", "first", "last")]):
            if g != name:
                if name is not None:
                    yield finished()
                name, tops, illegal = g, inserted({0: (0, "")}), 0
            else:
                illegal += last + first not in _SOUND
            found: dict = {}
            for c in cells:
                if c["start"] in tops:
                    cost, audit = tops[c["start"]]
                    _offer(found, c["top"], cost + c["cost"], audit + c["audit"])
            tops, illegal, last = found, illegal + wrong, end
    if name is not None:
        yield finished()


def _digests(batches):
    """Digests of repaired conversations: rows sorted by g and pos, the audit before the first."""
    name, rebuilt = None, None
    for batch in batches:
        done = []
        for g, pos, role, text in zip(*[batch.column(c).to_pylist() for c in ("g", "pos", "role", "text")]):
            if pos < 0:
                if rebuilt is not None:
                    done.append((name, rebuilt.digest()))
                name, rebuilt = g, Rebuilt(text)
            else:
                rebuilt.row(role, text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["g", "repaired_sha256"])
    if rebuilt is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rebuilt.digest()])], ["g", "repaired_sha256"])


def _long(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The result for long conversations, by segments."""
    order = [F.col(c) for c in _ORDER]
    rows = scratch.keep(placed(scratch.keep(rows), "g", order, scratch))
    pair = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("pair")
    firsts = scratch.keep(rows.groupBy("g", pair).agg(F.min("pos").alias("first_pos")))
    facts = rows.select("g", pair, "pos", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "late").join(firsts, ["g", "pair"])
    again = F.col("pos") > F.col("first_pos")
    facts = scratch.keep(facts.select("g", "pos", "turn", "initial", (F.col("blank") | again).alias("drop"), "late", "blank", again.alias("again")))
    segments = facts.groupBy("g", F.floor(F.col("pos") / SEGMENT).alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "initial", "drop", "late"))).alias("rows"))
    tables = segments.mapInArrow(_tables, f"g string, segment long, cells {_CELLS}, illegal long, first string, last string")
    best = scratch.keep(_in_order(scratch.keep(tables), "segment").mapInArrow(_folded, "g string, illegal long, cost long, audit string"))

    def total(x: Column) -> Column:
        return F.sum(x.cast("long"))

    clean = ~F.col("blank") & ~F.col("again")
    counts = facts.groupBy("g").agg(
        total(F.col("blank")).alias("blank"), total(~F.col("blank") & F.col("again")).alias("duplicate"),
        total(clean & F.col("late")).alias("truncated"))
    turns = facts.where("turn IS NOT NULL").select("g", "turn").distinct().groupBy("g").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    audits = best.select("g", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    digests = _in_order(rows.select("g", "pos", "role", "text").unionByName(audits), "pos").mapInArrow(
        _digests, "g string, repaired_sha256 string")
    return best.join(counts, "g").join(turns, "g", "left").join(digests, "g").select(
        "g", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """One row per conv_id: faults after the damage, and the cheapest repair."""
    scratch = Scratch(conversations.sparkSession, "conversations")
    rows = damaged(conversations)
    sizes = rows.groupBy("g").agg(F.count("*").alias("c"), F.sum(F.octet_length("role") + F.octet_length("text")).alias("bytes"))
    longs = scratch.keep(sizes.where((F.col("c") > long) | (F.col("bytes") > LONG_BYTES)).select("g"))
    none = longs.isEmpty()
    short = rows if none else rows.join(longs, "g", "left_anti")
    found = _in_order(short, *_ORDER).mapInArrow(_repair, _SQL_RESULT)
    if not none:
        found = found.unionByName(_long(rows.join(longs, "g", "left_semi"), scratch))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), _or_space("conv_id").alias("g")).distinct()
    zero = F.lit(0).cast("long")
    return ids.join(found, "g", "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation."""
    return repaired(tx.table(spark, sf_dir, "conversations"))


def _moves_sql() -> tuple[str, str]:
    """The automaton as rows: starts (top, cost, edits), and moves of one row with the insertions after it."""
    def grown(top, cost, edits):
        return [(t, cost + c, edits + a) for t, (c, a) in inserted({top: (0, "")}).items()]

    starts = [f"({t}, {c}, '{a}')" for t, c, a in grown(0, 0, "")]
    moves = []
    for top, step in enumerate(STEP):
        ways = [("D", "", top, DELETE), *(("K", r, t, 0) for r, t in step.items()), *(("R", "", step[r], REROLE) for r in ROLES if r in step)]
        for edit, role, after, cost in ways:
            moves += [f"({top}, '{edit}', '{role}', {t}, {c}, '{a}')" for t, c, a in grown(after, cost, edit)]
    return ", ".join(starts), ", ".join(moves)


def _oracle() -> str:
    """DuckDB: the same shortest ways, one row of every conversation per step of a recursion."""
    starts, moves = _moves_sql()
    crc = ("xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), "
           "lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
           "lambda a, z: xor(a >> 1, (a & 1) * 3988292384::BIGINT))))")
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') AS g, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, {crc} % 20 AS hit FROM k),
m AS (
  SELECT g, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS u(copy) WHERE hit <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS pos, role[1:1] AS initial,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS late FROM m),
d AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY pos) > 1 AS again,
    lag(initial) OVER (PARTITION BY g ORDER BY pos) AS before FROM o),
f AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (late AND NOT blank AND NOT again) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM d GROUP BY g),
v(top, edit, role, after, cost, edits) AS (VALUES {moves}),
w AS (
  SELECT g, 0::BIGINT AS pos, s.top, {{'cost': s.cost::BIGINT, 'audit': s.edits}} AS best FROM f, (VALUES {starts}) s(top, cost, edits)
  UNION ALL
  SELECT w.g, d.pos, v.after, min({{'cost': (w.best.cost + v.cost + CASE WHEN d.late AND v.edit <> 'D' THEN {TRUNCATED} ELSE 0 END)::BIGINT,
    'audit': w.best.audit || v.edits}})
  FROM w JOIN d ON d.g = w.g AND d.pos = w.pos + 1
    JOIN v ON v.top = w.top AND (v.edit = 'D' OR NOT (d.blank OR d.again) AND (v.edit = 'R' OR v.role = d.initial))
  GROUP BY w.g, d.pos, v.after),
b AS MATERIALIZED (SELECT w.g, min(w.best) AS best FROM w JOIN f ON f.g = w.g AND f.n = w.pos WHERE w.top IN ({", ".join(map(str, ENDS))})
  GROUP BY w.g),
e AS (SELECT g, i, best.audit[i:i] AS edit FROM b, unnest(range(1, length(best.audit) + 1)) AS u(i)),
p AS (SELECT *, sum((edit <> 'I')::INT) OVER (PARTITION BY g ORDER BY i) AS pos,
    sum((edit <> 'D')::INT) OVER (PARTITION BY g ORDER BY i) AS place FROM e),
q AS (SELECT p.g, p.i, p.edit, p.place, d.role, CASE WHEN edit = 'I' THEN '' ELSE d.text END AS text,
    max((edit = 'K' AND place = 1 AND d.initial = 's')::INT) OVER (PARTITION BY p.g) AS lead
  FROM p LEFT JOIN d ON d.g = p.g AND d.pos = p.pos),
r AS (SELECT g, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
    chr(10) ORDER BY i)) AS digest FROM q WHERE edit <> 'D' GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
  coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM k) LEFT JOIN f USING (g) LEFT JOIN b USING (g) LEFT JOIN r USING (g)
"""


OP11_SQL = _oracle()
