"""Operator 2, MinHash near-dedup: ProbMinHash signatures over weighted shingles, banding, exact verification.

A document's elements are its 3-word shingles (the whole text where it has fewer words), weighted by how often they
occur. Each element is a Poisson process whose rate is its weight; arrivals fall on random registers, a register keeps
its earliest arrival's element, and an element stops as soon as its next arrival is later than every register of its
document. Two registers agree with the probability Jaccard similarity of the documents. Registers are hashed in bands;
documents that share a band are candidates, and a candidate counts only if its exact similarity reaches the threshold.

Documents with equal elements are joined first, by a 128-bit hash, so that thousands of exact copies cost one candidate.
In a bucket every document is compared with a leader, the least one; then the leader leaves, and the next is the least
that missed all leaders so far. It is compared with those that matched them, too: only pairs that are already in one
component are left out, which changes no group. Buckets whose documents are not in one component after `star_rounds`
rounds are compared pair by pair, in tiles of `TILE` by `TILE` documents spread over the tasks: no candidate is capped or
dropped. Keys that hold very many rows (equal texts, buckets, leaders, hubs of a component) are salted and aggregated before
the shuffle (see `skew`). Groups are the connected components of the verified pairs, and the least doc_id of each stays.

Results, case by case: a null doc_id or text and a text without words are in no group; rows that share an id are one
document and stay or go together; ties cannot arise, as the least id stays; an empty table gives no rows; extra columns
are ignored; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import skew
from graphloom.llm.repeats import signed, texts
from graphloom.llm.session import cut, documents
from graphloom.llm.text import Words, mix, pieces, release

SHINGLE = 3
REGISTERS = 64
#: 21 bands of 3: a pair at the threshold shares a band with probability 1 - (1 - 0.5**3)**21 = 0.94, a likelier one more.
ROWS = 3
THRESHOLD = 0.5
STAR_ROUNDS = 3
LEADER_ROWS = 4096
TILE = 64


def elements(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) pairs in order, and how often each occurs."""
    n = len(w)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.row[: n - k + 1] == w.row[k - 1 :]) if n >= k else np.zeros(0, np.int64)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    row = np.concatenate([w.row[at], short])
    h = np.concatenate([w.span_hash(at, at + k), w.span_hash(w.first[short], w.first[short + 1])])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    head = np.flatnonzero(new)
    return row[head], h[head], np.diff(np.append(head, len(row)))


def signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, n_rows: int, m: int = REGISTERS) -> np.ndarray:
    """n_rows x m winning elements; a row without elements keeps zeros."""
    best = np.full(n_rows * m, np.inf)
    won = np.zeros(n_rows * m, dtype=np.uint64)
    t = np.zeros(len(row))
    r = 0
    while len(row):
        r += 1
        u = mix(h + np.uint64((2 * r * 0xD1342543DE82EF95) % (1 << 64)))
        reg = (mix(h ^ np.uint64(((2 * r + 1) * 0xAF251AF3B0F025B5) % (1 << 64))) >> np.uint64(11)) % np.uint64(m)
        t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / weight
        slot = row * m + reg.astype(np.int64)
        np.minimum.at(best, slot, t)
        win = best[slot] == t
        won[slot[win]] = h[win]
        last = best.reshape(n_rows, m).max(axis=1)
        go = t < last[row]
        row, h, weight, t = row[go], h[go], weight[go], t[go]
    return won.reshape(n_rows, m)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets, each as sorted distinct hashes and weights."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    if not both.any():
        return 0.0
    ca, cb = wa[both].astype(float), wb[at[both]].astype(float)
    if ca.max() == 1 and cb.max() == 1 and wa.max() == 1 and wb.max() == 1:
        return len(ca) / (len(ha) + len(hb) - len(ca))
    ratio = ca / cb
    order = np.argsort(ratio)
    ca, cb, ratio = ca[order], cb[order], ratio[order]
    above = wa.sum() - ca.sum() + np.concatenate([np.cumsum(ca[::-1])[::-1], [0.0]])  # by a's weights, at or after i
    below = wb.sum() - cb.sum() + np.concatenate([[0.0], np.cumsum(cb)])
    i = np.arange(len(ca))
    return float((1.0 / (above[i] / ca + below[i] / cb)).sum())


def sketches(docs: DataFrame, shingle: int, registers: int, rows: int) -> DataFrame:
    """(doc_id, c1, c2, bands): a hash of all elements, and the bands' keys. docs: doc_id, text."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    n_bands = registers // rows

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big):
                w = Words(batch.column("text"))
                row, h, weight = elements(w, shingle)
                n = batch.num_rows
                sig = signatures(row, h, weight, n, registers)
                c = np.zeros((2, n), dtype=np.uint64)
                np.add.at(c[0], row, mix(h) * weight.astype(np.uint64))
                np.add.at(c[1], row, mix(h ^ np.uint64(0x5851F42D4C957F2D)) * weight.astype(np.uint64))
                key = np.full((n, n_bands), 0, dtype=np.uint64) + np.arange(1, n_bands + 1, dtype=np.uint64)
                for i in range(rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, i::rows][:, :n_bands])
                some = np.flatnonzero(w.counts > 0)
                flat = signed(np.ascontiguousarray(key[some]).ravel())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * n_bands), flat)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), signed(c[0][some]), signed(c[1][some]), bands], names=["doc_id", "c1", "c2", "bands"])
            release()

    return docs.mapInArrow(scan, f"doc_id {id_type}, c1 long, c2 long, bands array<long>")


def verify(docs: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """(leader, doc_id, similarity) of each distinct pair (leader, doc_id). Each leader's text goes once to each salt."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    pairs = cut(pairs)
    top = skew.heavy(pairs.select("leader"), ["leader"], LEADER_ROWS, pairs.count())
    member = skew.salted(pairs, ["leader"], ["doc_id"], top).select("doc_id", "leader", "salt", F.lit(1).alias("part"))
    leader = skew.spread(pairs.select("leader").distinct(), ["leader"], top).select(F.col("leader").alias("doc_id"), "leader", "salt", F.lit(0).alias("part"))
    rows = docs.join(member.unionByName(leader), "doc_id").select("leader", "salt", "part", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead = None, []
        for big in batches:
            for batch in pieces(big):
                w = Words(batch.column("text"))
                row, h, weight = elements(w, shingle)
                bound = np.searchsorted(row, np.arange(batch.num_rows + 1))
                found = []
                for i, (key, salt, part) in enumerate(zip(batch.column("leader").to_pylist(), batch.column("salt").to_pylist(), batch.column("part").to_pylist())):
                    own = h[bound[i] : bound[i + 1]], weight[bound[i] : bound[i + 1]]
                    if (key, salt) != now:
                        now, lead = (key, salt), []
                    if part == 0:
                        lead.append((own[0].copy(), own[1].copy()))
                    else:
                        found.append((i, max((similarity(x, own) for x in lead), default=0.0)))
                at = pa.array([i for i, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("leader").take(at), batch.column("doc_id").take(at), pa.array([s for _, s in found], pa.float64())], names=["leader", "doc_id", "similarity"])
            release()

    out = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", "part").mapInArrow(run, f"leader {id_type}, doc_id {id_type}, similarity double")
    return out.groupBy("leader", "doc_id").agg(F.max("similarity").alias("similarity"))


def components(edges: DataFrame, salt_rows: int = skew.SALT_ROWS) -> DataFrame:
    """(doc_id, keeper) for every node of the edges (u, v), by alternating large and small stars; keeper is the least.

    A node with very many neighbours is aggregated before the shuffle (see `skew`).
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    n, state = now.count(), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        top = skew.heavy(both.select("u"), ["u"], salt_rows, 2 * n)
        large = skew.over_keys(both, ["u"], ["v"], top, m=F.min("v")).withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        if 2 * n > salt_rows:
            large = cut(large)
        small = skew.over_keys(large, ["u"], ["v"], skew.heavy(large.select("u"), ["u"], salt_rows, 2 * n), m=F.min("v"))
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        fresh = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if fresh == state:
            return now.select(F.col("u").alias("doc_id"), F.col("v").alias("keeper"))
        state, n = fresh, fresh[0]


def unsettled(buckets: DataFrame, top: DataFrame | None) -> DataFrame:
    """The rows of buckets whose documents are not all in one component. top: the heavy buckets."""
    return skew.over_keys(buckets, ["key"], ["doc_id"], top, least=F.min("label"), most=F.max("label")).where("least <> most").drop("least", "most")


def crowds(docs: DataFrame, members: DataFrame, top: DataFrame | None, threshold: float, shingle: int) -> DataFrame:
    """(u, v) that reach the threshold, enough to join the components of every two that do. members: key, doc_id, label, bands.

    A pair is compared in the first bucket that it shares, unless its components, in the tile at least, are one by then.
    Heavy buckets (top) are cut into tiles by hash, others in order of components, so that more tiles hold one only.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    one = Window.partitionBy("key")
    normal = members if top is None else members.join(F.broadcast(top), "key", "left_anti")
    placed = normal.withColumn("b", F.floor((F.row_number().over(one.orderBy("label", "doc_id")) - 1) / TILE).cast("int")).withColumn("last", F.max("b").over(one.orderBy("label", "doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    if top is not None:
        large = skew.over_keys(members.join(F.broadcast(top.select("key")), "key"), ["key"], ["doc_id"], top, last=F.count(F.lit(1))).withColumn("last", F.ceil(F.col("last") / TILE).cast("int") - 1)
        placed = placed.unionByName(large.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.col("last") + 1).cast("int")))
    tiles = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("last")))).select("key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), (F.col("b") > F.col("o")).cast("int").alias("side"), "doc_id", "label", "bands")
    whole = Window.partitionBy("key", "i", "j")
    tiles = tiles.withColumn("least", F.min("label").over(whole)).withColumn("most", F.max("label").over(whole)).where("least <> most").drop("least", "most")
    rows = docs.join(tiles, "doc_id").select("key", "i", "j", "side", "doc_id", "label", "bands", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, root = None, [], {}

        def find(x: object) -> object:
            while root.get(x, x) != x:
                x = root[x]
            return x

        for big in batches:
            for batch in pieces(big):
                w = Words(batch.column("text"))
                row, h, weight = elements(w, shingle)
                bound = np.searchsorted(row, np.arange(batch.num_rows + 1))
                found = []
                for r, (key, i, j, side, doc, label, bands) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "side", "doc_id", "label", "bands")))):
                    own = h[bound[r] : bound[r + 1]].copy(), weight[bound[r] : bound[r + 1]].copy()
                    bands = np.array(bands, dtype=np.int64)
                    if (key, i, j) != now:
                        now, held, root = (key, i, j), [], {}
                    if i == j or side == 1:
                        for other, their, at, theirs in held:
                            a, b = find(label), find(their)
                            if a == b:
                                continue
                            same = bands == at
                            if bands[same.argmax()] == key and similarity(theirs, own) >= threshold:
                                root[max(a, b)] = min(a, b)
                                found.append((doc, other))
                    if i == j or side == 0:
                        held.append((doc, label, bands, own))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], batch.column("doc_id").type) for k in (0, 1)], names=["u", "v"])
            release()

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(run, f"u {id_type}, v {id_type}")


def near_duplicates(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, shingle: int = SHINGLE, registers: int = REGISTERS, rows: int = ROWS, star_rounds: int = STAR_ROUNDS,
    salt_rows: int = skew.SALT_ROWS,
) -> DataFrame:
    """(doc_id, keeper_id): every document that goes, with the one of its group that stays."""
    docs = texts(docs, text_col, id_col)
    sketch = cut(sketches(docs, shingle, registers, rows))
    n = sketch.count()
    top = skew.heavy(sketch.select("c1", "c2"), ["c1", "c2"], salt_rows, n)
    equal = skew.over_keys(sketch.select("doc_id", "c1", "c2"), ["c1", "c2"], ["doc_id"], top, rep=F.min("doc_id"))
    exact = equal.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    reps = cut(sketch.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "bands")).alias("r")).select("r.doc_id", "r.bands"))
    raw = reps.select(F.explode("bands").alias("key"), "doc_id", F.col("doc_id").alias("label"), F.lit(False).alias("met"))
    top = skew.heavy(raw.select("key"), ["key"], salt_rows, reps.count() * (registers // rows))
    buckets = cut(unsettled(raw, top))
    checked: DataFrame | None = None
    crowded: DataFrame | None = None
    for _ in range(star_rounds):
        led = skew.over_keys(buckets, ["key"], ["doc_id"], top, first=F.min(F.struct("met", "doc_id", "label")))
        led = cut(led.select("key", "doc_id", "label", "met", F.col("first.doc_id").alias("leader"), F.col("first.label").alias("led")).where("doc_id <> leader"))
        pairs = led.where("label <> led").select("leader", "doc_id").distinct()
        if checked is not None:
            pairs = pairs.join(checked.select("leader", "doc_id"), ["leader", "doc_id"], "left_anti")
        found = cut(verify(docs, pairs, shingle))
        checked = found if checked is None else checked.unionByName(found)
        joined = components(checked.where(F.col("similarity") >= threshold).select(F.col("doc_id").alias("u"), F.col("leader").alias("v")), salt_rows)
        led = led.select("key", "doc_id", "met", "leader").join(joined.withColumnRenamed("keeper", "own"), "doc_id", "left")
        led = led.join(joined.select(F.col("doc_id").alias("leader"), F.col("keeper").alias("led")), "leader", "left")
        label = F.coalesce("own", "doc_id")
        buckets = cut(unsettled(led.select("key", "doc_id", label.alias("label"), (F.col("met") | (label == F.coalesce("led", "leader"))).alias("met")), top))
        if buckets.isEmpty():
            break
    else:
        crowded = cut(crowds(docs, buckets.join(reps, "doc_id"), top, threshold, shingle))
    edges = exact
    if checked is not None:
        edges = edges.unionByName(checked.where(F.col("similarity") >= threshold).select(F.col("doc_id").alias("u"), F.col("leader").alias("v")))
    if crowded is not None:
        edges = edges.unionByName(crowded)
    return components(edges, salt_rows).select("doc_id", F.col("keeper").alias("keeper_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """docs, all columns, with one document of each group; rows with a null id or text stay."""
    gone = near_duplicates(docs, **options).select(F.col("doc_id").alias("__gl_id"))
    return docs.join(gone, docs["doc_id"] == gone["__gl_id"], "left_anti")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
