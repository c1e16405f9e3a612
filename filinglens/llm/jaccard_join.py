"""Exact Jaccard join on word 5-grams with adaptive multi-match prefixes.

A document's set is its distinct shingles of five lower-cased (A-Z) words; a text
of one to four words has its whole sequence as its one shingle; a null or empty
text has none and links with nothing. Two documents link when 100 * |A and B| >=
80 * |A or B|. Shingles are compared by 64-bit hashes, in hash order.

1. Classes. Documents of equal sets form a class (a 128-bit sum of the set); only
   its smallest document goes on.
2. Quick links. Representatives that share a min-hash meet in groups of bounded
   size, where the most central member is compared with the others. Groups are
   salted when large, with their hub copied to every part. This joins most
   families of near copies before any pair of them is formed.
3. Adaptive multi-match prefixes, for whatever quick links missed. With a(n) =
   ceil(0.8 n), the first n - a(n) + l shingles, in any one order of shingles, of
   two linked documents share at least l. First the order of hashes is used: only
   prefix shingles held by several components matter, and only documents that hold
   l of them for every l stay live. Then the shingles of live documents are counted
   and ordered rare ones first. Those held by ``HOT`` live documents or more are
   expensive. Each document takes the l whose estimated candidates (postings of its
   cheap prefix shingles over the matches required) are fewest, and leaves out its h
   expensive prefix shingles by requiring l - h >= 1 cheap matches; a document for
   which no l gives that keeps all. A pair is a candidate when its shared shingles,
   within the prefixes that its two sizes allow, reach the requirement of the one
   with the smaller l (1 if both kept all). Every candidate across components is
   verified on whole sets. As l is at most ``_longest(0.8 n)``, the prefix of a
   document that kept all covers the l of every partner: no link is lost.
4. The union of all links gives the components.

Rows that share a doc_id are one node. Rows without a doc_id get the component of
their class, or null. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm import shared
from filinglens.llm import text as tx
from filinglens.llm.components import components
from filinglens.session import Scratch

SHINGLE = 5
HOT = 64
LONGEST = 24
#: Rows of one min-hash that one task compares; more are dealt to several.
GROUP = 512
#: Counts at which a shingle moves to the next place in the order of prefixes.
LEVELS = (2, 5, 17)
#: Least size of a min-hash group to be salted is rows / HEAVY_KEYS, which bounds the broadcast list.
HEAVY_KEYS = 4096
LEADERS = 16
N_MINS = 4
_SEEDS = [np.uint64(0), *(np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i in range(1, N_MINS))]


class Sets:
    """The distinct shingle hashes of each text of a chunk, ascending."""

    def __init__(self, t: tx.Texts):
        t = tx.Texts(t.row, tx.LOWER[t.data], t.offsets)
        w = tx.words(t)
        h = tx.span_hashes(t.data, w.starts, w.ends)
        counts = w.counts()
        size = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        values = tx.ngram_hashes(h, SHINGLE)
        for i in short.tolist():
            a, b = w.first[i], w.first[i + 1]
            values[a] = tx.ngram_hashes(np.append(h[a:b], np.uint64(b - a)), int(b - a) + 1)[0]
        within = np.arange(len(h)) - np.repeat(w.first[:-1], counts)
        values = values[within < np.repeat(size, counts)]
        edges = np.concatenate(([0], np.cumsum(size)))
        bounds = edges.tolist()
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a > 1:
                values[a:b].sort()
        fresh = np.ones(len(values), bool)
        fresh[1:] = values[1:] != values[:-1]
        fresh[edges[:-1][size > 0]] = True
        self.values = values[fresh]
        self.first = np.concatenate(([0], np.cumsum(fresh)))[edges]
        self.sizes = np.diff(self.first)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.first[i] : self.first[i + 1]]

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def place(self) -> np.ndarray:
        return np.arange(len(self.values)) - np.repeat(self.first[:-1], self.sizes)

    def sums(self, x: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
        return total[self.first[1:]] - total[self.first[:-1]]

    def least(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sizes), np.uint64)
        full = self.sizes > 0
        if full.any():
            out[full] = np.minimum.reduceat(x, self.first[:-1][full])
        return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending distinct sets reach the threshold."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < 80 * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def _mins(s: Sets) -> list[np.ndarray]:
    return [s.least(s.values if i == 0 else tx.mixed(s.values + seed)) for i, seed in enumerate(_SEEDS)]


def _sketch(batch, t):
    s = Sets(t)
    a = s.sums(tx.mixed(s.values + np.uint64(77)))
    b = s.sums(tx.mixed(s.values ^ np.uint64(0x5851F42D4C957F2D)))
    columns = [s.sizes.astype(np.int64), a.view(np.int64), b.view(np.int64), *(m.view(np.int64) for m in _mins(s))]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), *(pa.array(c) for c in columns)],
        ["doc_id", "n", "s1", "s2", *(f"m{i}" for i in range(N_MINS))])


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: set size, 128-bit set sum, min-hashes."""
    schema = "doc_id long, n long, s1 long, s2 long, " + ", ".join(f"m{i} long" for i in range(N_MINS))
    return tx.documents(docs).mapInArrow(tx.per_chunk(_sketch), schema)


def _id_key(ids: np.ndarray) -> np.ndarray:
    return tx.mixed(ids.astype(np.int64).view(np.uint64))


def _ids(batch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False)


def by_id(ids: DataFrame) -> DataFrame:
    """Keys of doc_id values whose bits ``_id_key`` finds: the same mixer in Spark."""
    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_id_key(_ids(batch)).view(np.int64))], ["key"])

    return ids.select("doc_id").mapInArrow(work, "key long")


def only(docs: DataFrame, bits) -> DataFrame:
    """Rows whose doc_id may be in the bits."""
    def work(batches):
        for batch in batches:
            keep = shared.maybe(bits.value, _id_key(_ids(batch)))
            if keep.any():
                yield batch.filter(pa.array(keep))

    return docs.where("doc_id IS NOT NULL").mapInArrow(work, docs.schema)


def _groups(reps, mins, heavy):
    """Representatives of shared first min-hashes, under key and salt, with whole texts."""
    def work(batch, t):
        ids = _ids(batch)
        s = Sets(t)
        m = s.least(s.values)
        keep = (s.sizes > 0) & shared.maybe(reps.value, _id_key(ids)) & shared.maybe(mins.value, m)
        at = np.flatnonzero(keep)
        if not len(at):
            return None
        rows, salts = [], []
        for i, key in zip(at.tolist(), m[at].view(np.int64).tolist()):
            parts, hub = heavy.value.get(key, (1, None))
            own = range(parts) if ids[i] == hub else [int(ids[i]) % parts]
            rows.extend([i] * len(own))
            salts.extend(own)
        take = pa.array(rows)
        hubs = [ids[i] == heavy.value.get(int(m[i].view(np.int64)), (1, None))[1] for i in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array(m[rows].view(np.int64)), pa.array(salts, pa.int64()), pa.array(np.where(hubs, 0, 1).astype(np.int64)),
             batch.column("doc_id").take(take), batch.column("text").take(take)], ["key", "salt", "rank", "doc_id", "text"])

    return tx.per_chunk(work)


def _central(members: list[tuple[int, np.ndarray]]) -> tuple[list[tuple[int, int]], tuple[int, np.ndarray]]:
    """Links of a bounded group around its most central members, and the first of them."""
    sizes = np.array([len(v) for _, v in members])
    values = np.concatenate([v for _, v in members])
    own = np.repeat(np.arange(len(members)), sizes)
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    weight = np.bincount(own, counts[inverse], len(members)) / np.maximum(1, sizes)
    order = np.argsort(-weight, kind="stable")
    left, links, best = order.tolist(), [], members[int(order[0])]
    for _ in range(LEADERS):
        if len(left) < 2:
            break
        hub, rest = left[0], []
        for i in left[1:]:
            if linked(members[hub][1], members[i][1]):
                links.append((members[hub][0], members[i][0]))
            else:
                rest.append(i)
        left = rest
    return links, best


def _cluster(batches):
    """Quick links of rows sorted by key, salt and rank; at most GROUP sets are held, and a group's hub goes along."""
    key, held, hub = None, [], None

    def flush():
        nonlocal held, hub
        out = []
        if hub is not None and all(i != hub[0] for i, _ in held):
            held = [hub, *held]
        if len(held) > 1:
            out, hub = _central(held)
        held = []
        return out

    for batch in batches:
        links = []
        keys = list(zip(batch.column("key").to_pylist(), batch.column("salt").to_pylist()))
        ids = _ids(batch).tolist()
        for t in tx.texts(batch.column("text")):
            s = Sets(t)
            for i in range(len(t)):
                row = t.row + i
                if keys[row] != key:
                    links += flush()
                    key, hub = keys[row], None
                held.append((ids[row], s.of(i).copy()))
                if len(held) >= GROUP:
                    links += flush()
        if links:
            u, v = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    links = flush()
    if links:
        u, v = zip(*links)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _clustered(rows: DataFrame) -> DataFrame:
    sorted_rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "rank", "doc_id")
    return sorted_rows.mapInArrow(_cluster, "u long, v long").where("u <> v")


def _quick_links(docs: DataFrame, classes: DataFrame, reps) -> DataFrame:
    context = docs.sparkSession.sparkContext
    sized = classes.groupBy(F.col("m0").alias("key")).agg(F.count("*").alias("c"), F.max_by("doc_id", "copies").alias("hub"))
    sized = sized.where("c > 1")
    mins = shared.send(docs, shared.bit_array(sized))
    least = max(GROUP, -(-classes.count() // HEAVY_KEYS))
    heavy = {r["key"]: (-(-r["c"] // GROUP), r["hub"]) for r in sized.where(F.col("c") > least).collect()}
    rows = docs.where("doc_id IS NOT NULL").mapInArrow(
        _groups(reps, mins, context.broadcast(heavy)), "key long, salt long, rank long, doc_id long, text string")
    return _clustered(rows)


def _labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Representatives with their component so far."""
    found = components(links)
    return classes.join(found, classes["doc_id"] == found["node"], "left").select(
        classes["*"], F.coalesce("component", "doc_id").alias("component"))


def _second_links(docs: DataFrame, labelled: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Links between components that share another min-hash, by the best linked member of each."""
    ends = links.select(F.col("u").alias("doc_id")).unionByName(links.select(F.col("v").alias("doc_id")))
    degree = ends.groupBy("doc_id").agg(F.count("*").alias("degree"))
    rows = labelled.join(degree, "doc_id", "left").select(
        "doc_id", "component", F.coalesce("degree", F.lit(0)).alias("degree"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"m{i}").alias("m")) for i in range(N_MINS)])).alias("x"))
    rows = rows.groupBy("x", "component").agg(F.max_by("doc_id", "degree").alias("doc_id"), F.max("degree").alias("degree"))
    several = rows.groupBy("x").agg(F.count("*").alias("c")).where("c > 1")
    rows = scratch.keep(rows.join(several, "x").select(
        F.xxhash64("x").alias("key"), F.pmod("doc_id", F.ceil(F.col("c") / F.lit(GROUP))).alias("salt"),
        (-F.col("degree")).alias("rank"), "doc_id"))
    found = only(docs, shared.send(docs, shared.bit_array(by_id(rows))))
    out = scratch.keep(_clustered(rows.join(found, "doc_id").select("key", "salt", "rank", "doc_id", "text")))
    scratch.drop(rows)
    return out


def _longest(n):
    """The largest number of matches a prefix of a set of n may ask for."""
    return np.minimum(LONGEST, (4 * n + 4) // 5)


def _prefixes(reps, bits=None):
    """Prefix shingles of representatives: keys counted, or one row of shared ones per document."""
    def work(batch, t):
        ids = _ids(batch)
        s = Sets(t)
        take = s.sizes - (4 * s.sizes + 4) // 5 + _longest(s.sizes)
        rep = shared.maybe(reps.value, _id_key(ids))
        own, place = s.owner(), s.place()
        keep = (place < take[own]) & rep[own]
        if bits is None:
            keys, n = np.unique(s.values[keep], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])
        keep &= shared.maybe(bits.value, s.values)
        counts = np.bincount(own[keep], minlength=len(t))
        some = counts > 0
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(s.sizes), tx.ragged(place[keep].astype(np.int32), counts),
             tx.ragged(s.values[keep].view(np.int64), counts)], ["doc_id", "n", "place", "key"]).filter(pa.array(some))

    return tx.per_chunk(work)


def _live(spread):
    """Documents whose prefixes hold enough shingles of several components, for every number of matches."""
    def run(batches):
        for batch in batches:
            n = batch.column("n").to_numpy()
            keys = batch.column("key")
            own = np.repeat(np.arange(len(n)), keys.value_lengths().to_numpy())
            near = shared.maybe(spread.value, keys.flatten().to_numpy().view(np.uint64))
            place, own = batch.column("place").flatten().to_numpy()[near], own[near]
            base, alive = n - (4 * n + 4) // 5, np.ones(len(n), bool)
            for matches in range(1, LONGEST + 1):
                held = np.bincount(own[place < base[own] + matches], minlength=len(n))
                alive &= (held >= matches) | (matches > (4 * n + 4) // 5)
            yield batch.select(["doc_id", "component"]).filter(pa.array(alive))

    return run


def _rare_first(live, levels=None):
    """All shingles of the live documents, counted; or, per document, its shared prefix shingles, rare ones first.

    The order over shingles is by the level of their count, then by hash; the
    levels are a function of the shingle alone, so the order is one for all.
    """
    def work(batches):
        for batch in batches:
            kept = batch.filter(pa.array(shared.maybe(live.value, _id_key(_ids(batch)))))
            if not kept.num_rows:
                continue
            for t in tx.texts(kept.column("text")):
                s = Sets(t)
                if levels is None:
                    keys, n = np.unique(s.values, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])
                    continue
                own, level = s.owner(), np.zeros(len(s.values), np.int64)
                for i, row in enumerate(levels.value):
                    level[shared.maybe(row, s.values)] = i + 1
                order = np.argsort(own * 8 + level, kind="stable")
                take = s.sizes - (4 * s.sizes + 4) // 5 + _longest(s.sizes)
                keep = (s.place() < take[own]) & (level[order] > 0)
                counts = np.bincount(own[keep], minlength=len(t))
                some = pa.array(counts > 0)
                most = s.sizes - np.bincount(own[level == 0], minlength=len(t))
                yield pa.RecordBatch.from_arrays(
                    [kept.column("doc_id").slice(t.row, len(t)), pa.array(s.sizes), pa.array(most),
                     tx.ragged(s.place()[keep].astype(np.int32), counts), tx.ragged(s.values[order][keep].view(np.int64), counts)],
                    ["doc_id", "n", "most", "place", "key"]).filter(some)

    return work


def _choose(batches):
    """The matches l each document asks for, and the prefix shingles it is found by.

    ``cap`` is the largest set with which its shingles that others also hold could
    reach the threshold; l is null where every shingle of the prefix has to serve.
    """
    names = ("key", "place", "doc_id", "component", "n", "cap", "l", "need")
    for batch in batches:
        out = {k: [] for k in names}
        for row in batch.to_pylist():
            n = row["n"]
            cap = 180 * row["most"] // 80 - n
            if 100 * cap < 80 * n:
                continue
            items = sorted(row["items"], key=lambda x: x["place"])
            base, best, i, hot, postings, cheap = n - (4 * n + 4) // 5, None, 0, 0, 0, []
            for l in range(1, int(_longest((4 * n + 4) // 5)) + 1):
                while i < len(items) and items[i]["place"] < base + l:
                    if items[i]["df"] < HOT:
                        cheap.append(items[i])
                        postings += items[i]["df"] - 1
                    else:
                        hot += 1
                    i += 1
                if l > hot and (best is None or postings / (l - hot) < best[0]):
                    best = (postings / (l - hot), l, l - hot, len(cheap))
            if best is None:
                l, need, used = None, 1, items
            else:
                l, need, used = best[1], best[2], cheap[: best[3]]
            for x in used:
                for k, v in zip(names, (x["key"], x["place"], row["doc_id"], row["component"], n, cap, l, need)):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))


def _candidates(docs: DataFrame, labelled: DataFrame, reps, scratch: Scratch) -> DataFrame:
    """Pairs of representatives in different components that reach the required prefix matches."""
    counted = docs.mapInArrow(_prefixes(reps), "key long, n long")
    bits = shared.send(docs, shared.repeated(counted))
    known, schema = docs.where("doc_id IS NOT NULL"), "doc_id long, n long, place array<int>, key array<long>"
    lists = scratch.keep(known.mapInArrow(_prefixes(reps, bits), schema).join(labelled.select("doc_id", "component"), "doc_id"))
    spread = shared.send(docs, shared.spread(lists.select(F.explode("key").alias("key"), "component"), F.col("component")))
    live = scratch.keep(lists.mapInArrow(_live(spread), "doc_id long, component long"))
    scratch.drop(lists)
    ids = shared.send(docs, shared.bit_array(by_id(live)))
    levels = shared.send(docs, shared.levels(known.mapInArrow(_rare_first(ids), "key long, n long"), LEVELS))
    schema = schema.replace("place", "most long, place")
    rows = known.mapInArrow(_rare_first(ids, levels), schema).join(live, "doc_id").select(
        "doc_id", "component", "n", "most", F.explode(F.arrays_zip("place", "key")).alias("x"))
    shingles = scratch.keep(rows.select("doc_id", "component", "n", "most", "x.place", "x.key"))
    scratch.drop(live)
    df = shingles.groupBy("key").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    rows = shingles.join(df.where("lo < hi").select("key", "df"), "key")
    per_doc = rows.groupBy("doc_id", "component", "n", "most").agg(F.collect_list(F.struct("place", "key", "df")).alias("items"))
    chosen = scratch.keep(per_doc.mapInArrow(
        _choose, "key long, place long, doc_id long, component long, n long, cap long, l long, need long"))
    scratch.drop(shingles)
    both = F.expr("(4 * (a.n + b.n) + 8) div 9")  # the least overlap of two linked sets of these sizes
    l = F.coalesce(F.least("a.l", "b.l"), F.lit(1))
    need = (
        F.when(F.col("a.l") < F.col("b.l"), F.col("a.need")).when(F.col("b.l") < F.col("a.l"), F.col("b.need"))
        .when(F.col("a.l").isNull(), F.col("b.need")).when(F.col("b.l").isNull(), F.col("a.need"))
        .otherwise(F.least("a.need", "b.need")))
    met = chosen.alias("a").join(
        chosen.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component"))
        & (F.col("a.n") <= F.col("b.cap")) & (F.col("b.n") <= F.col("a.cap"))
        & (100 * F.col("a.n") >= 80 * F.col("b.n")) & (100 * F.col("b.n") >= 80 * F.col("a.n"))
        & (F.col("a.place") < F.col("a.n") - both + l) & (F.col("b.place") < F.col("b.n") - both + l))
    pairs = met.select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v"), need.alias("need"))
    pairs = pairs.groupBy("u", "v").agg(F.count("*").alias("c"), F.min("need").alias("need"))
    out = scratch.keep(pairs.where("c >= need").select("u", "v"))
    scratch.drop(chosen)
    return out


def _verify(batches):
    for batch in batches:
        left = list(tx.texts(batch.column("a"), 1 << 62))[0]
        right = list(tx.texts(batch.column("b"), 1 << 62))[0]
        x, y = Sets(left), Sets(right)
        good = [linked(x.of(i), y.of(i)) for i in range(batch.num_rows)]
        yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))


def _small_batches(work, size=64):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                yield from work([batch.slice(i, size)])

    return run


def _verified(docs: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs that reach the threshold on their whole sets."""
    ends = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    found = scratch.keep(only(docs, shared.send(docs, shared.bit_array(by_id(ends)))).join(ends, "doc_id", "left_semi"))
    left = found.select(F.col("doc_id").alias("u"), F.col("text").alias("a"))
    right = found.select(F.col("doc_id").alias("v"), F.col("text").alias("b"))
    out = scratch.keep(pairs.join(left, "u").join(right, "v").mapInArrow(_small_batches(_verify), "u long, v long"))
    scratch.drop(found)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = tx.documents(docs)
    sketch = scratch.keep(sketches(rows))
    classes = scratch.keep(
        sketch.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(
            F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(N_MINS)]))
    found = scratch.keep(sketch.select("doc_id", "n", "s1", "s2"))
    scratch.drop(sketch)
    reps = shared.send(rows, shared.bit_array(by_id(classes)))
    links = scratch.keep(_quick_links(rows, classes, reps))
    labelled = scratch.keep(_labelled(classes, links))
    links = scratch.keep(links.unionByName(_second_links(rows, labelled, links, scratch)))
    scratch.drop(labelled)
    labelled = scratch.keep(_labelled(classes, links))
    pairs = _candidates(rows, labelled, reps, scratch)
    if not pairs.isEmpty():
        late = _verified(rows, pairs, scratch)
        if not late.isEmpty():
            scratch.drop(labelled)
            labelled = scratch.keep(_labelled(classes, links.unionByName(late)))
    known = scratch.keep(labelled.select("n", "s1", "s2", "component"))
    scratch.drop(*[f for f, _ in scratch.kept if f is not known and f is not found])
    return found.join(known, ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _of_kind(kinds, node: str, wanted: int | None):
    """Rows whose node can only be of the wanted kind; without one, rows whose node may be of several."""
    def run(batches):
        for batch in batches:
            flags = np.array([shared.maybe(row, _id_key(batch.column(node).to_numpy())) for row in kinds.value])
            keep = flags.sum(axis=0) > 1 if wanted is None else flags[wanted] & (flags.sum(axis=0) == 1)
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``: the smallest doc_id, rows without one last, then by a hash of the row.

    Components are those of the rows, whatever their doc_id: a row goes by its own text only. Rows that are equal in
    every column count as one. A row without shingles stays, and so does one whose 64-bit hash meets that of another.

    A row is a node by its doc_id where that tells all rows apart, and by its hash otherwise. Which go is decided on these. Each row is then told by bit arrays of the nodes that stay, go, or stay
    once; only rows of nodes that these leave in doubt are joined with the exact list.
    """
    scratch, own = Scratch(docs.sparkSession, "representatives"), "_"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    node = f"{own}node"
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("c"))
    row = F.col("doc_id").cast("long") if ids.where("c > 1 OR doc_id IS NULL").isEmpty() else tx.row_hash(docs)
    rows = docs.withColumns({node: row, f"{own}id": F.col("doc_id").cast("long"), f"{own}h2": tx.row_hash(docs, "2")})
    schema = rows.schema
    found = near_duplicates(rows.select(F.col(node).alias("doc_id"), "text"))
    found = found.groupBy(F.col("doc_id").alias(node)).agg(
        F.max("n_shingles").alias("n"), F.min("component_id").alias("component"), F.count("*").alias("copies"))
    facts = rows.groupBy(node).agg(F.min(f"{own}id").alias("id"), F.min(f"{own}h2").alias("lo"), F.max(f"{own}h2").alias("hi"))
    # a node that holds nothing, or two different rows, stays as it is
    free = (F.col("n") == 0) | ((F.col("copies") > 1) & (F.col("lo") != F.col("hi")))
    found = scratch.keep(found.join(facts, node).withColumn("free", free))
    best = found.where("NOT free").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", node)).alias("best"))
    best = best.select(F.col(f"best.{node}").alias(node), F.lit(1).alias("won"))
    # 0 stays, 1 goes, 2 stays once
    kind = F.when(F.col("free"), 0).when(F.col("won").isNull(), 1).when(F.col("copies") > 1, 2).otherwise(0)
    nodes = scratch.keep(found.join(best, node, "left").select(node, kind.alias("kind")))
    scratch.drop(found)
    bits = [shared.bit_array(by_id(nodes.where(F.col("kind") == i).select(F.col(node).alias("doc_id")))) for i in range(3)]
    kinds = shared.send(docs, np.stack(bits))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = rows.mapInArrow(_of_kind(kinds, node, 0), schema).select(*columns)
    once = None if nodes.where("kind = 2").isEmpty() else rows.mapInArrow(_of_kind(kinds, node, 2), schema)
    doubtful = scratch.keep(nodes.mapInArrow(_of_kind(kinds, node, None), nodes.schema))
    if not doubtful.isEmpty():
        doubt = rows.mapInArrow(_of_kind(kinds, node, None), schema).join(doubtful.withColumnRenamed("kind", f"{own}kind"), node)
        kept = kept.unionByName(doubt.where(f"{own}kind = 0").select(*columns))
        once = once and once.unionByName(doubt.where(f"{own}kind = 2").drop(f"{own}kind"))
    return kept.unionByName(once.dropDuplicates([node]).select(*columns)) if once else kept


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document."""
    return near_duplicates(tx.table(spark, sf_dir, "documents"))


#: DuckDB: all pairs that share a shingle, then the transitive closure by least label.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g
  FROM w, unnest(range(1, greatest(len(words) - 3, CASE WHEN len(words) > 0 THEN 2 ELSE 1 END))) AS u(i)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, min(r.b)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
"""
