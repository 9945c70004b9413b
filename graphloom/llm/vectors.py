"""Operator 5, embedding near-dedup: product quantisation over coarse inverted lists, exact cosine rerank.

Unit vectors are assigned to about sqrt(n) coarse cells; what a vector leaves over its cell's centre is split into
subspaces, each coded by one of 256 codewords. Centres and codewords are trained by Lloyd's rounds over a sample of at
most about `train_per_cell` vectors a cell (the least hashes of vec_id), so that training stays linear in the table;
every vector is indexed, and every vector is a query. It probes the cells nearest to it, and in each cell a table of its residual's distances to the
codewords gives the distance to any code as a sum of look-ups. A code also carries its own quantisation error, so by
the triangle inequality the table distance less that error never exceeds the true distance: no neighbour in a probed
cell is lost by quantisation. What is left is compared by exact cosine. Only probing is approximate.

A cell of more than `cell_rows` vectors is split by hash into parts of that size, and its queries go to each part: a
task holds one part and reads the queries in a stream, whatever the cell's size. Groups are the connected components of pairs with cosine of at least the threshold; the least vec_id stays. Equal
vectors are joined first, so thousands of copies cost one probe, and each cell passes on a spanning forest of its pairs
in place of all pairs, which leaves the components as they are.

Results, case by case: null ids, null or empty vectors, null, infinite or NaN entries, zero vectors and vectors not of
the most frequent length (the longest of equally frequent ones) are in no group; rows that share an id are one vector
of that id each; the least id of a group stays; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import skew
from graphloom.llm.near import components
from graphloom.llm.session import cut

THRESHOLD = 0.95
ROUNDS = 4
SUBSPACES = 8
CODEWORDS = 256
PROBES = 8
BLOCK = 512
TRAIN_PER_CELL = 64
CELL_ROWS = 20_000


def unit_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, vec): unit vectors of one length, and that length."""
    v = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    v = v.where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 1e150)")
    v = v.withColumn("norm", F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))")).where("norm > 0")
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = sizes[0][0] if sizes else 0
    return v.where(F.size("v") == dim).select("vec_id", F.expr("transform(v, x -> cast(x / norm as float) + 0F)").alias("vec")), dim


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float32).reshape(-1, dim)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def lloyd(vectors: DataFrame, dim: int, codebooks: list[np.ndarray], coarse: np.ndarray | None) -> list[np.ndarray]:
    """One round over all vectors: of the coarse centres (coarse None) or of all residual codebooks at once."""
    shared = vectors.sparkSession.sparkContext.broadcast((codebooks, coarse))  # sqrt(n) and 256 centres
    part = dim // len(codebooks)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, first = shared.value
        total = [np.zeros((len(b), b.shape[1] + 1)) for b in books]
        for batch in batches:
            x = matrix(batch.column("vec"), dim)
            if first is not None and len(x):
                x = x - first[nearest(x, first)]
            for s, b in enumerate(books):
                y = x[:, s * part : s * part + b.shape[1]]
                c = nearest(y, b)
                np.add.at(total[s], c, np.column_stack([y, np.ones(len(y))]))
        s, c = zip(*[(s, c) for s, t in enumerate(total) for c in np.flatnonzero(t[:, -1])]) if any(t[:, -1].any() for t in total) else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(c, pa.int32()), pa.array([total[i][j].tolist() for i, j in zip(s, c)], pa.list_(pa.float64()))], names=["s", "c", "total"])

    out = [b.copy() for b in codebooks]
    wide = max(b.shape[1] for b in codebooks) + 1
    added = vectors.select("vec").mapInArrow(sums, "s int, c int, total array<double>").groupBy("s", "c").agg(*(F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(wide)))
    for r in added.toLocalIterator():
        total = np.array([x for x in r[2:] if x is not None])
        out[r["s"]][r["c"]] = (total[:-1] / total[-1]).astype(np.float32)
    return out


def search(queries: np.ndarray, q_id: np.ndarray, index: np.ndarray, i_id: np.ndarray, codes: np.ndarray, error: np.ndarray, centre: np.ndarray, books: list[np.ndarray], threshold: float, root: dict) -> list[tuple[int, int, float]]:
    """A spanning forest (ids a, b and their cosine) of the pairs of the two sides with cosine of threshold or more, but for those that root joins already."""
    part = queries.shape[1] // len(books)
    radius = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-4

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a in range(0, len(queries), BLOCK):
        q = queries[a : a + BLOCK]
        rest = q - centre
        d2 = np.zeros((len(q), len(index)), dtype=np.float32)
        for s, b in enumerate(books):
            y = rest[:, s * part : s * part + b.shape[1]]
            table = (y * y).sum(axis=1)[:, None] - 2 * y @ b.T + (b * b).sum(axis=1)[None, :]
            d2 += table[:, codes[:, s]]
        r, c = np.nonzero(np.sqrt(np.maximum(d2, 0)) - error[None, :] <= radius)
        cosine = np.einsum("ij,ij->i", q[r].astype(np.float64), index[c].astype(np.float64))
        ok = (cosine >= threshold) & (q_id[a + r] != i_id[c])
        for x, y, z in zip(q_id[a + r[ok]].tolist(), i_id[c[ok]].tolist(), cosine[ok].tolist()):
            fx, fy = find(x), find(y)
            if fx != fy:
                root[max(fx, fy)] = min(fx, fy)
                out.append((x, y, z))
    return out


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, probes: int = PROBES, rounds: int = ROUNDS, subspaces: int = SUBSPACES, train_per_cell: int = TRAIN_PER_CELL, cell_rows: int = CELL_ROWS, salt_rows: int = skew.SALT_ROWS) -> DataFrame:
    """(vec_id, keeper_id): every vector that goes, with the one of its group that stays."""
    spark = df.sparkSession
    rows, dim = unit_vectors(df, id_col, vector_col)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    keys = ["h1", "h2"]
    rows = cut(rows.select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")))  # 128 bits tell vectors apart
    top = skew.heavy(rows.select(*keys), keys, salt_rows, rows.count())
    reps = cut(rows.groupBy(*keys).agg(F.min(F.struct("vec_id", "vec")).alias("r")).select("r.vec_id", "r.vec"))
    equal = skew.over_keys(rows.select("vec_id", *keys), keys, ["vec_id"], top, keeper=F.min("vec_id")).where("vec_id <> keeper").select(F.col("vec_id").alias("u"), F.col("keeper").alias("v"))
    n = reps.count()
    if n < 2:
        return components(equal, salt_rows).select(F.col("doc_id").alias("vec_id"), F.col("keeper").alias("keeper_id"))
    cells = max(1, int(np.sqrt(n)))
    share = train_per_cell * max(cells, CODEWORDS) / n
    hashed = F.xxhash64("vec_id")
    train = reps if share >= 1 else cut(reps.where(hashed <= int((2 * share - 1) * 2**63)).repartition(spark.sparkContext.defaultParallelism))
    start = np.array([r["vec"] for r in train.orderBy(hashed, "vec_id").select("vec").limit(max(cells, CODEWORDS)).collect()], dtype=np.float32)
    coarse = start[:cells]
    for _ in range(rounds):
        coarse = lloyd(train, dim, [coarse], None)[0]
    parts = min(subspaces, dim)
    size = dim // parts
    bounds = [(s * size, dim if s == parts - 1 else (s + 1) * size) for s in range(parts)]
    rest = start - coarse[nearest(start, coarse)]
    books = [np.unique(rest[:CODEWORDS, a:b], axis=0).copy() for a, b in bounds]
    for _ in range(rounds):
        books = lloyd(train, dim, books, coarse)
    shared = spark.sparkContext.broadcast((coarse, books))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, words = shared.value
        k = min(probes, len(first))
        half = (first * first).sum(axis=1) / 2
        for batch in batches:
            x = matrix(batch.column("vec"), dim)
            if not len(x):
                continue
            far = half - x @ first.T
            near = np.argpartition(far, k - 1, axis=1)[:, :k]
            own = np.argmin(far, axis=1)
            r = x - first[own]
            codes = np.column_stack([nearest(r[:, a:b], w) for (a, b), w in zip(bounds, words)]).astype(np.uint8)
            back = np.column_stack([w[codes[:, s]] for s, w in enumerate(words)])
            error = np.sqrt(((r - back) ** 2).sum(axis=1))
            i = np.arange(len(x))
            row = np.concatenate([i, np.repeat(i, k)])
            side = np.concatenate([np.zeros(len(i), np.int32), np.ones(len(i) * k, np.int32)])
            cell = np.concatenate([own, near.ravel()]).astype(np.int32)
            raw = [c.tobytes() for c in codes]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(side), batch.column("vec_id").take(pa.array(row)), batch.column("vec").take(pa.array(row)), pa.array([raw[j] if s == 0 else None for j, s in zip(row, side)], pa.binary()), pa.array(error[row].astype(np.float32))],
                names=["cell", "side", "vec_id", "vec", "codes", "error"],
            )

    placed = cut(reps.select("vec_id", "vec").mapInArrow(place, f"cell int, side int, vec_id {id_type}, vec array<float>, codes binary, error float"))
    sizes = placed.where("side = 0").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias("parts"))  # at most one row a cell
    wide = placed.join(F.broadcast(sizes), "cell")  # a cell without vectors answers no query
    wide = wide.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("part", F.explode(F.when(F.col("side") == 0, F.array("own")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))).drop("own", "parts")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, words = shared.value
        now, held, index, root = None, [], None, {}
        for batch in batches:
            key = np.column_stack([np.asarray(batch.column(c), dtype=np.int64) for c in ("cell", "part", "side")])
            edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, len(key)]):
                if a == b:
                    continue
                rows, (cell, part, side) = batch.slice(a, b - a), key[a].tolist()
                if (cell, part) != now:
                    now, held, index, root = (cell, part), [], None, {}
                if side == 0:
                    held.append(rows)
                    continue
                if index is None and held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
                    index = matrix(t.column("vec").combine_chunks(), dim), np.array(t.column("vec_id").to_pylist(), dtype=object), codes, np.asarray(t.column("error"))
                if index is None:
                    continue
                ids = np.array(rows.column("vec_id").to_pylist(), dtype=object)
                got = search(matrix(rows.column("vec"), dim), ids, *index, first[cell], words, threshold, root)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], batch.column("vec_id").type) for k in (0, 1)], names=["u", "v"])

    pairs = wide.repartition("cell", "part").sortWithinPartitions("cell", "part", "side").mapInArrow(solve, f"u {id_type}, v {id_type}")
    return components(equal.unionByName(pairs.select("u", "v")), salt_rows).select(F.col("doc_id").alias("vec_id"), F.col("keeper").alias("keeper_id"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
