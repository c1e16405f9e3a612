"""Near-duplicate classes by circulant MinHash, confirmed by exact Jaccard similarity.

A document's set is its distinct shingles of five lower-cased (A-Z) words; a text
of one to four words has its whole sequence as its one shingle; a null or empty
text has none and links with nothing. Two documents link when 100 * |A and B| >=
85 * |A or B|.

1. Signatures. Two permutations of the 64-bit integers do for all coordinates:
   the first scatters the shingles, the second is shifted by one place, modulo
   2 ** 64, from each coordinate to the next. A pair at the threshold shares no
   band of ``ROWS`` coordinates out of ``BANDS`` with probability 6e-11.
2. Classes. Documents of equal sets (a 128-bit sum) are one; only the smallest
   doc_id goes on.
3. Hubs. In each bucket the member that meets most others over all its buckets
   is compared with every member, which joins a family of copies by a number of
   pairs linear in its size.
4. Buckets that still hold several components: the pairs across components of a
   bucket of up to ``SMALL`` members are compared directly.
5. Larger ones take an exact way that forms no pairs of a bucket. Each member is
   written as its differences from the bucket's hub: the shingles it lacks, and
   those it has beside. Two members share the hub's shingles that neither lacks,
   and the differences they have in common. Where the former are enough, both link
   with the member nearest to the hub; otherwise the gap to the nearest member of
   another component says how many differences a pair has to share, so a prefix of
   each member's, rare ones first, finds it. What a family or a template has in
   common is never joined on.
6. Every pair so found is confirmed on the whole sets, members streaming past the
   one set they are compared with. The confirmed links give the components.

Rows that share a doc_id are one node. A row without a doc_id gets the component of
its class, or null, and is kept in the latter case. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm import shared
from filinglens.llm import text as tx
from filinglens.llm.components import components
from filinglens.llm.jaccard_join import OP3_SQL, Sets, by_id, only
from filinglens.session import Scratch

PERCENT = 85
ROWS = 4
BANDS = 32
#: Buckets of up to so many members are compared pair by pair across components.
SMALL = 64
#: Members that one task compares with the same document.
PART = 256
#: Counts, within parts of a hub's members, at which a difference moves to the next place in the order of prefixes.
LEVELS = (4, 16, 64)
_SCATTER = np.uint64(0xA0761D6478BD642F)
_MIX = np.uint64(0xE7037ED1A0B428DB)


def signature(s: Sets, coordinates: int) -> list[np.ndarray]:
    """Least value of the second permutation, shifted by 1, 2, ... places, over each scattered set."""
    scattered = tx.mixed(s.values ^ _SCATTER)
    return [s.least(tx.mixed(scattered - np.uint64(k))) for k in range(1, coordinates + 1)]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending distinct sets reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < PERCENT * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sketch(batch, t):
    s = Sets(t)
    a = s.sums(tx.mixed(s.values + np.uint64(77)))
    b = s.sums(tx.mixed(s.values ^ np.uint64(0x5851F42D4C957F2D)))
    mins, bands = signature(s, ROWS * BANDS), []
    for i in range(BANDS):
        key = np.full(len(t), i + 1, np.uint64)
        for m in mins[i * ROWS : (i + 1) * ROWS]:
            key = tx.mixed(key * _MIX + m)
        bands.append(key.view(np.int64))
    offsets = pa.array(np.arange(len(t) + 1, dtype=np.int32) * BANDS)
    lists = pa.ListArray.from_arrays(offsets, pa.array(np.stack(bands, axis=1).ravel() if len(t) else np.zeros(0, np.int64)))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(s.sizes.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists],
        ["doc_id", "n", "s1", "s2", "bands"])


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: set size, 128-bit set sum and band keys."""
    return tx.documents(docs).mapInArrow(tx.per_chunk(_sketch), "doc_id long, n long, s1 long, s2 long, bands array<long>")


def _sizes_allow(a: str, b: str) -> Column:
    return (100 * F.col(a) >= PERCENT * F.col(b)) & (100 * F.col(b) >= PERCENT * F.col(a))


def _met(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (key, doc_id, n) of buckets that hold several, with their number c and the hub u of hub_n shingles."""
    several = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    met = scratch.keep(rows.join(several, "key"))
    weight = met.groupBy("doc_id").agg(F.sum("c").alias("weight"))
    hubs = met.join(weight, "doc_id").groupBy("key").agg(
        F.max(F.struct("weight", (-F.col("doc_id")).alias("late"), F.col("n").alias("hub_n"))).alias("hub"))
    out = scratch.keep(met.join(hubs.select("key", (-F.col("hub.late")).alias("u"), "hub.hub_n"), "key"))
    scratch.drop(met)
    return out


def _hub_pairs(met: DataFrame) -> DataFrame:
    """(hub, member) of every bucket."""
    pairs = met.where((F.col("doc_id") != F.col("u")) & _sizes_allow("n", "hub_n"))
    return pairs.select("u", F.col("doc_id").alias("v")).distinct()


def _compare(batches):
    """Links among rows sorted by key, salt and rank: those of rank 0 are held, the others stream past them."""
    key, held = None, []
    for batch in batches:
        out = []
        keys = list(zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist()))
        ranks, ids = batch.column("rank").to_pylist(), batch.column("doc_id").to_pylist()
        for t in tx.texts(batch.column("text")):
            s = Sets(t)
            for i in range(len(t)):
                row = t.row + i
                if keys[row] != key:
                    key, held = keys[row], []
                if ranks[row]:
                    if any(linked(h, s.of(i)) for h in held):
                        out.append((key[0], ids[row]))
                elif not any(np.array_equal(h, s.of(i)) for h in held):
                    held.append(s.of(i).copy())
        if out:
            u, v = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _required(a: str, b: str) -> Column:
    """Keys that two documents have to share beside what both have of their hub, by their weights (w) and its size."""
    return F.ceil((F.col(a) + F.col(b) - (100 + PERCENT) * F.col("size")) / F.lit(100 + PERCENT))


def _streamed(docs: DataFrame, pairs: DataFrame, work, schema: str, scratch: Scratch) -> DataFrame:
    """``work`` on the texts of the members (v) of each hub (u), the hub's own coming first in every part of them."""
    parts = pairs.groupBy(F.col("u").alias("key")).agg(F.ceil(F.count("*") / F.lit(PART)).alias("parts"))
    members = pairs.join(parts, pairs["u"] == parts["key"]).select(
        "key", F.pmod(F.xxhash64("v"), "parts").alias("salt"), F.lit(1).alias("rank"), F.col("v").alias("doc_id"))
    hubs = parts.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("rank"),
                        F.col("key").alias("doc_id"))
    places = scratch.keep(members.unionByName(hubs))
    found = only(docs, shared.send(docs, shared.bit_array(by_id(places.select("doc_id").distinct()))))
    rows = places.join(found, "doc_id").select("key", "salt", "rank", "doc_id", "text")
    rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "rank")
    out = scratch.keep(rows.mapInArrow(work, schema))
    scratch.drop(places)
    return out


def _confirmed(docs: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) that reach the threshold."""
    return _streamed(docs, pairs, _compare, "u long, v long", scratch)


def _component(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with the component of their doc_id so far."""
    found = components(links)
    return nodes.join(found, nodes["doc_id"] == found["node"], "left").select(
        nodes["*"], F.coalesce("component", "doc_id").alias("component"))


def _differences(batches):
    """Per member its shingles that the hub lacks and those of the hub it lacks, as keys of this hub, from rows sorted as for ``_compare``.

    A row without doc_id lists the keys that many members of one part have, and n of them.
    """
    names = ("u", "doc_id", "n", "size", "missing", "keys", "often")
    key, held, hub, seen, n_seen, out = None, [], None, [], 0, {c: [] for c in names}

    def put(*values):
        for c, v in zip(names, values):
            out[c].append(v)

    def counted():
        nonlocal seen, n_seen
        if seen:
            keys, n = np.unique(np.concatenate(seen), return_counts=True)
            put(key[0], None, 0, 0, 0, keys[n >= LEVELS[0]].view(np.int64), n[n >= LEVELS[0]])
        seen, n_seen = [], 0

    def ready():
        nonlocal out
        done, out = out, {c: [] for c in names}
        return pa.RecordBatch.from_arrays(
            [*(pa.array(done[c], pa.int64()) for c in names[:-2]), *(pa.array(done[c], pa.list_(pa.int64())) for c in names[-2:])], list(names))

    for batch in batches:
        keys = list(zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist()))
        ranks, ids = batch.column("rank").to_pylist(), batch.column("doc_id").to_pylist()
        for t in tx.texts(batch.column("text")):
            s = Sets(t)
            for i in range(len(t)):
                row = t.row + i
                if keys[row] != key:
                    counted()
                    key, held, hub = keys[row], [], None
                if not ranks[row]:
                    held.append(s.of(i).copy())
                    continue
                if hub is None:  # the same one in every part, should the id have several texts
                    hub = min(held, key=lambda h: (len(h), h.tobytes()))
                own = s.of(i)
                lacks, more = np.setdiff1d(hub, own, True), np.setdiff1d(own, hub, True)
                salt = tx.mixed(np.array([key[0]], np.int64).view(np.uint64))
                found = np.concatenate((tx.mixed(lacks ^ salt ^ _SCATTER), tx.mixed(more ^ salt)))
                put(key[0], ids[row], len(own), len(hub), len(lacks), found.view(np.int64), [])
                seen.append(found)
                n_seen += len(found)
                if n_seen > 1 << 20:
                    counted()
        if out["u"]:
            yield ready()
    counted()
    if out["u"]:
        yield ready()


def _prefixes(levels):
    """The first keys of each document, by level, then by value: any two that have to share ``need`` keys share one of these."""
    def work(batches):
        for batch in batches:
            lists, need = batch.column("keys"), batch.column("need").to_numpy()
            counts = lists.value_lengths().to_numpy().astype(np.int64)
            first = np.concatenate(([0], np.cumsum(counts)))
            own = np.repeat(np.arange(len(counts)), counts)
            keys = lists.flatten().to_numpy().view(np.uint64)
            level = np.zeros(len(keys), np.int64)
            for i, row in enumerate(levels.value):
                level[shared.maybe(row, keys)] = i + 1
            order = np.lexsort((keys, level, own))
            place = np.arange(len(keys)) - first[:-1][own]
            keep = place <= (counts - need)[own]
            at = pa.array(own[keep])
            rows = [batch.column(c).take(at) for c in ("u", "doc_id", "component", "n", "w", "size")]
            yield pa.RecordBatch.from_arrays(
                [*rows, pa.array((counts[own] - place)[keep]), pa.array(keys[order][keep].view(np.int64))],
                ["u", "doc_id", "component", "n", "w", "size", "ahead", "key"])

    return work


def _crowded_pairs(docs: DataFrame, crowd: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate pairs across components among the members (doc_id) of each hub (u), by what tells them from the hub."""
    schema = "u long, doc_id long, n long, size long, missing long, keys array<long>, often array<long>"
    found = scratch.keep(_streamed(docs, crowd.select("u", F.col("doc_id").alias("v")), _differences, schema, scratch))
    counts = found.where("doc_id IS NULL").select(F.explode(F.arrays_zip("keys", "often")).alias("x"))
    levels = shared.send(docs, shared.levels(counts.select(F.col("x.keys").alias("key"), F.col("x.often").alias("n")), LEVELS))
    w = (100 + PERCENT) * F.col("missing") + PERCENT * F.col("n")
    rows = found.drop("often").join(crowd, ["u", "doc_id"]).withColumn("w", w)
    least = rows.groupBy("u").agg(F.min(F.struct("w", "doc_id", "component", "n")).alias("least"))
    # a pair shares no more keys than either has, so a document far from the hub links with none near to it
    alike = F.ceil((2 * PERCENT * F.col("w") - 100 * (100 - PERCENT) * F.col("n") - PERCENT * (100 + PERCENT) * F.col("size"))
                   / F.lit(PERCENT * (100 + PERCENT)))
    # partners are of other components, so beside the least's own component it is the nearest of another that counts
    rows = rows.join(least, "u")
    other = rows.where(F.col("component") != F.col("least.component")).groupBy("u").agg(F.min("w").alias("other"))
    rows = rows.join(other, "u").withColumn("near", F.when(F.col("component") == F.col("least.component"), F.col("other")).otherwise(F.col("least.w")))
    rows = scratch.keep(rows.withColumn("need", F.greatest(F.lit(1).cast("long"), _required("w", "near"), alike)))
    # what the hub and the two have in common is enough: the nearest to the hub links with all that any other would
    pairs = rows.where((_required("w", "least.w") <= 0) & (F.col("component") != F.col("least.component")) & _sizes_allow("n", "least.n"))
    pairs = pairs.select(F.col("least.doc_id").alias("u"), F.col("doc_id").alias("v"))
    keys = scratch.keep(rows.drop("least", "other", "near").mapInArrow(
        _prefixes(levels), "u long, doc_id long, component long, n long, w long, size long, ahead long, key long"))
    other = keys.select("key", *[F.col(c).alias(f"{c}_") for c in ("doc_id", "component", "n", "w", "ahead")])
    enough = F.least("ahead", "ahead_") >= F.greatest(F.lit(1), _required("w", "w_"))
    met = keys.join(other, "key").where((F.col("component") < F.col("component_")) & _sizes_allow("n", "n_") & enough)
    pairs = pairs.unionByName(met.select(F.col("doc_id").alias("u"), F.col("doc_id_").alias("v")))
    out = scratch.keep(pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    scratch.drop(found, rows, keys)
    return out


def _late_pairs(docs: DataFrame, met: DataFrame, labelled: DataFrame, tried: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate pairs across components that the hubs left apart."""
    rows = met.join(labelled.select("doc_id", "component").distinct(), "doc_id")
    mixed = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rows = scratch.keep(rows.join(mixed, "key", "left_semi"))
    few = rows.where(F.col("c") <= SMALL).select("key", F.col("doc_id").alias("u"), "n", "component")
    pairs = few.join(few.toDF("key", "v", "vn", "vc"), "key").where((F.col("component") < F.col("vc")) & _sizes_allow("n", "vn"))
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    crowd = scratch.keep(rows.where(F.col("c") > SMALL).select("u", "doc_id", "component").distinct())
    if not crowd.isEmpty():
        pairs = pairs.unionByName(_crowded_pairs(docs, crowd, scratch))
    tried = tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    out = scratch.keep(pairs.distinct().join(tried, ["u", "v"], "left_anti"))
    scratch.drop(rows, crowd)
    return out


def _same_ids(sketch: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links from an id with several texts to the classes of these."""
    rows = sketch.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", F.struct("n", "s1", "s2").alias("set"))
    several = rows.groupBy("doc_id").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo <> hi").select("doc_id")
    rows = rows.join(several, "doc_id", "left_semi").distinct()
    reps = nodes.select(F.struct("n", "s1", "s2").alias("set"), F.col("doc_id").alias("v"))
    return rows.join(reps, "set").select(F.col("doc_id").alias("u"), "v").where("u <> v").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    scratch = Scratch(docs.sparkSession, "circulant")
    docs = tx.documents(docs)
    sketch = scratch.keep(sketches(docs))
    classes = scratch.keep(sketch.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    nodes = classes.select("n", "s1", "s2", "doc_id")
    met = _met(classes.select("doc_id", "n", F.explode("bands").alias("key")), scratch)
    tried = scratch.keep(_hub_pairs(met))
    links = _confirmed(docs, tried, scratch)
    links = scratch.keep(links.unionByName(_same_ids(sketch, nodes)))
    labelled = scratch.keep(_component(nodes, links))
    late = _late_pairs(docs, met, labelled, tried, scratch)
    scratch.drop(met, tried)
    if not late.isEmpty():
        more = _confirmed(docs, late, scratch)
        if not more.isEmpty():
            scratch.drop(labelled)
            labelled = scratch.keep(_component(nodes, links.unionByName(more)))
        scratch.drop(more)
    found = scratch.keep(sketch.select("doc_id", "n", "s1", "s2"))
    scratch.drop(sketch, classes, links, late)
    known = labelled.select("n", "s1", "s2", "component")
    component = F.coalesce("component", "doc_id")
    return found.join(known, ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and near-duplicate class of every document."""
    return near_duplicates(tx.table(spark, sf_dir, "documents"))


#: DuckDB: as the other exact join, at this threshold.
OP13_SQL = "SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM (" + OP3_SQL.replace(
    "100 * c >= 80 *", f"100 * c >= {PERCENT} *") + ")"
