"""Graphs cut into blocks of arrays, for algorithms that go over all edges again and again (K4-K6).

Nodes are numbered 0..n-1 in the order of their ids; node x is in block x % parts, at place x // parts. A block's links are
one row of arrays, kept by block through all rounds. In a round each block sends what its nodes hold to each block with a
neighbour, once a node and block, in an order that both know; so only values are moved, and a task holds one block.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.session import cut

BLOCK_LINKS = 500_000
ROWS = "blk int, src int, data binary"
SCHEMA = pa.schema([("blk", pa.int32()), ("src", pa.int32()), ("data", pa.binary())])
OWN = -1  # as src: what the block itself holds
#: In a block's links: the start of each place's links; the number in the received values, and the weight, of each link;
#: the places to send, by block; how many go to and come from each block.
Links = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def rows(found: list[tuple[int, int, tuple]]) -> pa.Table:
    return pa.Table.from_pydict({"blk": [x[0] for x in found], "src": [x[1] for x in found], "data": [pickle.dumps(x[2], protocol=5) for x in found]}, schema=SCHEMA)


def loaded(t: pa.Table) -> dict[int, tuple]:
    """The arrays of a block's rows by src, in its order."""
    return {s: pickle.loads(d) for s, d in sorted(zip(t["src"].to_pylist(), t["data"].to_pylist(), strict=True))}


def place(blk: int, n: int, parts: int) -> np.ndarray:
    """The numbers of a block's nodes."""
    return np.arange(blk, n, parts)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def summed(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(w, first) if len(first) else w[:0]


def numbered(edges: DataFrame, *extra: Column) -> tuple[DataFrame, int, int]:
    """(id, x, extra...): the edges' ends, numbered in the order of their ids; how many ids and ends there are."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("__ends"))
    at = cut(ends.orderBy("id").select("id", "__ends", F.monotonically_increasing_id().alias("__at"))).withColumn("__part", F.shiftright("__at", 33))
    counts = at.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.sum("__ends").alias("__ends"))
    n, e = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.coalesce(F.sum("__ends"), F.lit(0))).first()
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # one row for each partition of the sort
    return at.join(F.broadcast(before), "__part").select("id", (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).alias("x"), *extra), n, e


def links_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(a, b, w): each edge from both of its ends, as numbers."""
    key = lambda c, to: ids.select(F.col("id").alias(c), F.col("x").alias(to)).hint("shuffle_hash")
    x = edges.select("source", "target").join(key("source", "s"), "source").select("s", "target").join(key("target", "t"), "target")
    return x.select(F.explode(F.array(F.struct(F.col("s").alias("a"), F.col("t").alias("b")), F.struct(F.col("t").alias("a"), F.col("s").alias("b")))).alias("l")).select("l.a", "l.b", F.lit(1.0).alias("w"))


@dataclass
class Blocks:
    """The links of n nodes in `parts` blocks: a row of arrays for each block that has any."""

    n: int
    parts: int
    rows: DataFrame

    @classmethod
    def of(cls, links: DataFrame, n: int, parts: int, weighted: bool = True) -> Blocks:
        """links: (a, b, w), symmetric, without a = b; weights of equal links are added up, or all are 1."""
        span = n // parts + 1

        def build(key: tuple, t: pa.Table) -> pa.Table:
            blk = key[0].as_py()
            a, b, w = (t[c].to_numpy() for c in ("a", "b", "w"))
            order = np.lexsort((b, a))
            a, b, w = a[order], b[order], w[order]
            first = runs(a, b)
            a, b, w = a[first] // parts, b[first], np.add.reduceat(w, first)
            starts = np.searchsorted(a, np.arange((n - blk + parts - 1) // parts + 1)).astype(np.int32)
            wanted, pos = np.unique(b % parts * span + b // parts, return_inverse=True)
            sent = np.unique(b % parts * span + a)
            if not weighted or (w == 1).all():
                w = np.ones(1)
            return rows([(blk, OWN, (starts, pos.astype(np.int32), w, (sent % span).astype(np.int32), np.bincount(sent // span, minlength=parts), np.bincount(wanted // span, minlength=parts)))])

        built = links.withColumn("blk", F.pmod("a", F.lit(parts)).cast("int")).groupBy("blk").applyInArrow(build, ROWS)
        # as many partitions as other shuffles have, at least: else Spark would shuffle these rows again in each round
        wide = max(parts, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return cls(n, parts, built.repartition(wide, "blk").persist(StorageLevel.DISK_ONLY))

    def each(self, other: DataFrame, work: Callable[[int, Links | None, dict[int, tuple]], pa.Table], schema: str = ROWS) -> DataFrame:
        """What work returns of each block, given its links, if it has any, and its rows of `other`, which alone are shuffled."""

        def run(key: tuple, own: pa.Table, t: pa.Table) -> pa.Table:
            return work(key[0].as_py(), pickle.loads(own["data"][0].as_py()) if own.num_rows else None, loaded(t))

        return self.rows.groupBy("blk").cogroup(other.groupBy("blk")).applyInArrow(run, schema)

    def passed(self, state: DataFrame, count: int) -> DataFrame:
        """The state, and for each block the first `count` arrays of it at the places that have neighbours there."""

        def send(blk: int, links: Links | None, held: dict[int, tuple]) -> pa.Table:
            own = held[OWN]
            out = [(blk, OWN, own)]
            if links:
                ends = np.cumsum(links[4])
                for to in np.flatnonzero(links[4]).tolist():
                    at = links[3][ends[to] - links[4][to] : ends[to]]
                    out.append((to, blk, tuple(x[at] for x in own[:count])))
            return rows(out)

        return self.each(state, send)

    def values(self, table: DataFrame) -> DataFrame:
        """(blk, src, data) of a table (x, ...): its other columns as arrays by place, 0 where there is no row."""
        n, parts, cols = self.n, self.parts, [c for c in table.columns if c != "x"]

        def gather(key: tuple, t: pa.Table) -> pa.Table:
            blk, at = key[0].as_py(), t["x"].to_numpy() // parts
            out = []
            for c in cols:
                got = t[c].to_numpy()
                full = np.zeros((n - blk + parts - 1) // parts, got.dtype)
                full[at] = got
                out.append(full)
            return rows([(blk, OWN, tuple(out))])

        return table.withColumn("blk", F.pmod("x", F.lit(parts)).cast("int")).groupBy("blk").applyInArrow(gather, ROWS)

    def table(self, state: DataFrame, schema: str, pick: Callable[[int, tuple], dict[str, np.ndarray]]) -> DataFrame:
        """Rows of a state, of the columns that pick returns."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                for blk, data in zip(t["blk"].to_pylist(), t["data"].to_pylist(), strict=True):
                    yield pa.RecordBatch.from_pydict(pick(blk, pickle.loads(data)))

        return state.mapInArrow(run, schema)


def received(links: Links, held: dict[int, tuple], which: int) -> np.ndarray:
    """The neighbour's value at each link."""
    return np.concatenate([x[which] for src, x in held.items() if src != OWN])[links[1]]


def owner_of(links: Links) -> np.ndarray:
    """The place at which each link begins."""
    return np.repeat(np.arange(len(links[0]) - 1), np.diff(links[0]))


def sums(state: DataFrame, parts: int, answer: bool = False) -> DataFrame:
    """Sums of a state's second array by the node that the first one names: (places, sums) for the named nodes' blocks, or answers."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for blk, data in zip(t["blk"].to_pylist(), t["data"].to_pylist(), strict=True):
                yield from rows([(to, blk, (at, k)) for to, at, k, _, _ in _asked(*pickle.loads(data)[:2], parts)]).to_batches()

    def total(key: tuple, t: pa.Table) -> pa.Table:
        blk, held = key[0].as_py(), loaded(t)
        at, inverse = np.unique(np.concatenate([x[0] for x in held.values()]), return_inverse=True)
        k = np.bincount(inverse, np.concatenate([x[1] for x in held.values()]))
        if not answer:
            return rows([(blk, blk, (at, k))])
        return rows([(src, blk, (k[np.searchsorted(at, x[0])],)) for src, x in held.items()])

    return state.mapInArrow(ask, ROWS).groupBy("blk").applyInArrow(total, ROWS)


def with_sums(state: DataFrame, parts: int) -> DataFrame:
    """The state with one more array, the sum of each place's named node; it comes second."""

    def told(key: tuple, t: pa.Table) -> pa.Table:
        held = loaded(t)
        c, k, *rest = held[OWN]
        s = np.zeros(len(c))
        for to, _, _, inverse, places in _asked(c, k, parts):
            s[places] = held[to][0][inverse]
        return rows([(key[0].as_py(), OWN, (c, s, k, *rest))])

    return state.unionByName(sums(state, parts, answer=True)).groupBy("blk").applyInArrow(told, ROWS)


def _asked(c: np.ndarray, k: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block with nodes named in c: the block, their places, the sums of k, and which of them each of which places names."""
    order = np.argsort(c % parts, kind="stable")
    block = (c % parts)[order]
    first = runs(block)
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=True):
        places = order[lo:hi]
        at, inverse = np.unique(c[places] // parts, return_inverse=True)
        yield int(block[lo]), at, np.bincount(inverse, k[places], minlength=len(at)), inverse, places
