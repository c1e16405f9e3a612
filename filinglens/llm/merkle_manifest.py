"""Merkle manifest of a dataset: every row gets a digest, a proof and a check of it.

H is the lowercase hex SHA-256; a node's digest is hashed as its hex text. A row
is a leaf: H of doc_id, source, lang, n_chars and text, each ``-`` if null, else
its UTF-8 byte count, ``:`` and the value. Per source the leaves ascend by doc_id
(rows without one first, equal ids by leaf); runs of ``FANOUT`` consecutive nodes
become their H, also a run of one, until one node is left, the subroot. A lone
leaf is its own subroot. The subroots, by source (null first, then by bytes),
make the root in the same way.

1. Positions come from a range partitioning (``placed``): a source with a third
   of all rows is cut into aligned blocks of FANOUT ** HEIGHT leaves, each a
   complete subtree below one node, computed in one task.
2. Butterfly exchange. Block b holds the digest of its ancestor at level r. In
   round r, the FANOUT blocks whose numbers differ in digit r only, in base
   FANOUT, swap these digits' digests and each hashes the common parent for
   itself. After the last round every block holds the subroot and the siblings of
   all its ancestors, without a pass back down, and no group ever has more than
   FANOUT rows. Where the last ancestor of a level has fewer blocks than the
   others, its blocks send copies in place of the missing ones.
3. The subroots go through the same two steps as leaves of one tree.
4. Each block folds its leaves through the runs of its subtree, its own upper
   siblings and those of its source.

What moves is digests and ids; texts are read and hashed where they lie. A null
text is a leaf as any other. Extra columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm import text as tx
from filinglens.llm.placed import placed
from filinglens.session import Scratch

FANOUT = 3
#: Levels computed within one block; a block has FANOUT ** HEIGHT leaves.
HEIGHT = 6
_PATH = "array<struct<l:string,r:string>>"


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def _digest(text: Column) -> Column:
    return F.sha2(F.concat(*[_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], _field(text)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """source, doc_id and leaf digest of every row; ``bad`` is the leaf of a tampered text, null where nothing changes."""
    changed = F.col("text").contains("\n") & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    text = F.col("text").cast("string")
    rows = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), "lang", "n_chars", text.alias("text"))
    return rows.select("source", "doc_id", _digest(F.col("text")).alias("node"),
                       F.when(changed, _digest(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("bad"))


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _subtree(nodes: list[str], fanout: int, height: int | None) -> tuple[str, list[list[tuple[str, str]]]]:
    """The top of a block, and per level the digests left and right of each node in its run.

    ``height`` levels are made, or as many as lead to one node.
    """
    levels = []
    while len(nodes) > 1 if height is None else len(levels) < height:
        beside, above = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            beside += [("".join(run[:i]), "".join(run[i + 1 :])) for i in range(len(run))]
            above.append(_h("".join(run)))
        levels.append(beside)
        nodes = above
    return nodes[0], levels


def _height(n: int, fanout: int, height: int) -> int | None:
    """The levels within a block: all of them for a tree of one block."""
    return height if n > fanout**height else None


def _tops(fanout: int, height: int):
    def work(batches):
        for batch in batches:
            nodes, n = batch.column("nodes").to_pylist(), batch.column("n").to_pylist()
            tops = [_subtree(x, fanout, _height(k, fanout, height))[0] for x, k in zip(nodes, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), batch.column("block"), batch.column("n"), pa.array(tops, pa.string())],
                ["g", "block", "n", "node"])

    return work


def _round(rows: DataFrame, span: int, fanout: int) -> DataFrame:
    """One exchange: blocks of ``span``-block ancestors get the digests beside their ancestor, and its parent."""
    above, last = F.floor(F.col("block") / span), F.floor((F.col("blocks") - 1) / span)
    size = F.col("blocks") - last * span  # blocks below the last ancestor
    place = F.col("block") % span
    # the last ancestor stands in for its missing blocks, unless it is alone in its run
    copies = (above == last) & (size < span) & (last % fanout != 0)
    sent = rows.select(
        "*", above.alias("above"), place.alias("own"),
        F.explode(F.when(copies, F.sequence(place, F.lit(span - 1).cast("long"), size)).otherwise(F.array(place))).alias("place"))
    met = sent.groupBy("g", F.floor(F.col("above") / fanout).alias("run"), "place").agg(F.array_sort(F.collect_list(F.struct(
        "above", "own", "block", "blocks", "n", "node", "path"))).alias("met"))
    met = met.select("g", "place", F.col("met.node").alias("nodes"), F.posexplode("met").alias("i", "m")).where("m.own = place")
    beside = F.struct(F.array_join(F.expr("slice(nodes, 1, i)"), "").alias("l"),
                      F.array_join(F.expr(f"slice(nodes, i + 2, {fanout})"), "").alias("r"))
    return met.select("g", "m.block", "m.blocks", "m.n", F.sha2(F.array_join("nodes", "").cast("binary"), 256).alias("node"),
                      F.concat("m.path", F.array(beside)).alias("path"))


def butterfly(tops: DataFrame, fanout: int, width: int) -> DataFrame:
    """Per block (g, block, n, node): the root of its tree and the digests beside its ancestors, from the block up."""
    rows = tops.select("g", "block", F.ceil(F.col("n") / width).alias("blocks"), "n", "node", F.array().cast(_PATH).alias("path"))
    most = tops.agg(F.max(F.ceil(F.col("n") / width))).head()[0] or 0
    span = 1
    while span < most:
        rows = _round(rows.where(F.col("blocks") > span), span, fanout).unionByName(rows.where(F.col("blocks") <= span))
        span *= fanout
    return rows


def _trees(rows: DataFrame, order: list[Column], fanout: int, height: int, scratch: Scratch) -> DataFrame:
    """Blocks of the trees of each ``g``: their rows in order, the tree's root and the digests beside the ancestors."""
    width, names = fanout**height, [c for c in rows.columns if c != "g"]
    blocks = placed(rows, "g", order, scratch).groupBy("g", F.floor(F.col("pos") / width).alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", *names))).alias("rows"))
    blocks = scratch.keep(blocks)
    tops = blocks.select("g", "block", "n", F.col("rows.node").alias("nodes")).mapInArrow(
        _tops(fanout, height), "g string, block long, n long, node string")
    found = butterfly(scratch.keep(tops), fanout, width)
    return blocks.join(found.select("g", "block", F.col("node").alias("root"), "path"), ["g", "block"])


def _paths(batch: pa.RecordBatch, fanout: int, height: int):
    """Per block of a batch: its rows, its index and, per row, the digests beside it from the leaf up."""
    columns = [batch.column(c).to_pylist() for c in ("rows", "n", "path")]
    for at, (rows, n, upper) in enumerate(zip(*columns)):
        _, levels = _subtree([r["node"] for r in rows], fanout, _height(n, fanout, height))
        upper = [(p["l"], p["r"]) for p in upper]
        yield at, rows, [[level[i // fanout**k] for k, level in enumerate(levels)] + upper for i in range(len(rows))]


def _sources(fanout: int, height: int):
    """Per source: the digests beside its subroot and above it."""
    def work(batches):
        for batch in batches:
            roots, out = batch.column("root").to_pylist(), []
            for at, rows, paths in _paths(batch, fanout, height):
                out += [{"g": r["name"], "top": [{"l": x, "r": y} for x, y in p], "root": roots[at]} for r, p in zip(rows, paths)]
            kind = pa.struct([("l", pa.string()), ("r", pa.string())])
            yield pa.RecordBatch.from_pylist(out, pa.schema([("g", pa.string()), ("top", pa.list_(kind)), ("root", pa.string())]))

    return work


def _proofs(fanout: int, height: int):
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")),
                        ("verified", pa.bool_())])

    def work(batches):
        for batch in batches:
            roots, subroots, tops = (batch.column(c).to_pylist() for c in ("top_root", "root", "top"))
            for at, rows, paths in _paths(batch, fanout, height):
                top, out = [(p["l"], p["r"]) for p in tops[at]], []
                for row, path in zip(rows, paths):
                    folded, beside = row["bad"] or row["node"], []
                    for left, right in path + top:
                        folded = _h(left + folded + right)
                        beside.append(left + right)
                    out.append((row["doc_id"], row["node"], subroots[at], roots[at], _h("".join(beside)), folded, folded == roots[at]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return work


def manifest(docs: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    # null sources come first: every other key begins with a later character
    key = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))
    rows = scratch.keep(leaves(docs).select(key.alias("g"), "doc_id", "node", "bad"))
    blocks = _trees(rows, [F.col("doc_id"), F.col("node")], fanout, height, scratch)
    blocks = scratch.keep(blocks)
    subroots = scratch.keep(blocks.where("block = 0").select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("node")))
    sources = _trees(subroots, [F.col("name")], fanout, height, scratch)
    sources = scratch.keep(sources.mapInArrow(_sources(fanout, height), f"g string, top {_PATH}, root string"))
    scratch.drop(*[f for f, _ in scratch.kept if f is not blocks and f is not sources])
    joined = blocks.join(sources.select("g", "top", F.col("root").alias("top_root")), "g")
    return joined.mapInArrow(_proofs(fanout, height), "doc_id long, leaf string, subroot string, root string, "
                             "proof_sha256 string, folded_root string, verified boolean")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, proof and check of every document."""
    return manifest(tx.table(spark, sf_dir, "documents"))


def _tree_sql(name: str, base: str, levels: int) -> str:
    """CTEs of the levels of the trees over ``base`` (g, i, node), and of the digests beside each node."""
    parts = [f"{name}0 AS MATERIALIZED (SELECT g, i, node, count(*) OVER (PARTITION BY g) AS n FROM {base})"]
    for k in range(levels):
        parts.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY i)) "
            f"ELSE any_value(node) END AS node, (any_value(n) + 2) // 3 AS n FROM {name}{k} GROUP BY g, i // 3)")
        parts.append(
            f"{name}s{k} AS MATERIALIZED (SELECT a.g, a.i, coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, "
            f"coalesce(string_agg(b.node, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r "
            f"FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.g, a.i)")
    return ",\n".join(parts)


def _fold_sql(name: str, base: str, tree: str, levels: int) -> str:
    """CTEs that fold ``base`` (id, g, i, node, proof) up through the levels of a tree."""
    parts, before = [], base
    for k in range(levels):
        parts.append(
            f"{name}{k} AS MATERIALIZED (SELECT id, g, f.i // 3 AS i, CASE WHEN s.l IS NULL THEN node ELSE sha256(s.l || node || s.r) END "
            f"AS node, proof || coalesce(s.l || s.r, '') AS proof FROM {before} f LEFT JOIN {tree}s{k} s USING (g, i))")
        before = f"{name}{k}"
    return ",\n".join(parts)


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value} END"


def _oracle(levels: int = 16, top: int = 10) -> str:
    """DuckDB: the levels one by one, for up to 3 ** levels documents a source and 3 ** top sources."""
    head = " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))
    whole, changed = _field_sql("text"), _field_sql("replace(text, chr(10), '')")
    crc = ("xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), "
           "lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
           "lambda a, z: xor(a >> 1, (a & 1) * 3988292384::BIGINT))))")
    return f"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, sha256({head} || {whole}) AS leaf,
  CASE WHEN {crc} % 2 = 0 THEN sha256({head} || {changed}) END AS bad FROM documents),
e AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS id,
  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
{_tree_sql("t", "(SELECT g, i, leaf AS node FROM e)", levels)},
u AS MATERIALIZED (SELECT g AS name, '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, node FROM t{levels}),
{_tree_sql("v", "u", top)},
{_fold_sql("f", "(SELECT id, g, i, coalesce(bad, leaf) AS node, '' AS proof FROM e)", "t", levels)},
x AS MATERIALIZED (SELECT id, '' AS g, u.i, f.node, proof, u.node AS subroot FROM f{levels - 1} f JOIN u ON u.name = f.g),
{_fold_sql("y", "x", "v", top)}
SELECT e.doc_id, e.leaf, x.subroot, v.node AS root, sha256(y.proof) AS proof_sha256, y.node AS folded_root, y.node = v.node AS verified
FROM e JOIN x USING (id) JOIN y{top - 1} y USING (id) CROSS JOIN v{top} v
"""


OP12_SQL = _oracle()
