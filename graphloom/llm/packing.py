"""Operator 3, packing: non-negative least squares over shallow length combinations.

Lengths (in words unless a column of lengths is named) are cut into windows of `window`: a longer document gives full
windows and a rest. Pieces are binned by length, rounded up to `grain`. All combinations of at most `depth` bins that
fill a window, up to `slack` bins of waste, are enumerated once; their repeat counts are the non-negative least-squares
solution against the histogram of bins, rounded down and cut back where a bin runs short. What the solution leaves is
packed greedily, best fit by decreasing length.

The table is split by a hash of doc_id into groups of about `group_rows` pieces, however large it is, and each group is
solved on its own histogram, so neither the driver nor a task sees more than a group.

Results, case by case: a null doc_id, a null text and a text without words are not packed; each repeated row is packed
(rows are told apart by `copy`); ties in length are broken by doc_id, then by piece; an empty table gives no rows; extra
columns are ignored; documents of any length are packed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.session import cut, documents
from graphloom.llm.text import Words, pieces

WINDOW = 2048
GRAIN = 64
DEPTH = 4
SLACK = 0
GROUP_ROWS = 50_000


@lru_cache(maxsize=8)
def combinations(bins: int, depth: int, slack: int) -> np.ndarray:
    """Rows are bins 1..bins, columns the multisets of at most depth bins with sum from bins-slack to bins."""
    out: list[list[int]] = []

    def grow(have: list[int], left: int) -> None:
        if have and left <= slack:
            out.append(have)
        if len(have) < depth:
            for b in range(min(left, have[-1] if have else bins), 0, -1):
                grow([*have, b], left - b)

    grow([], bins)
    a = np.zeros((bins, len(out)))
    for j, c in enumerate(out):
        for b in c:
            a[b - 1, j] += 1
    return a


def nnls(a: np.ndarray, y: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """min |a x - y| with x >= 0, by Lawson and Hanson's active sets."""
    m, n = a.shape
    x = np.zeros(n)
    passive = np.zeros(n, dtype=bool)
    gram, proj = a.T @ a, a.T @ y
    tol = 1e-9 * max(1.0, np.abs(proj).max(initial=0.0))
    for _ in range(rounds or 3 * n):
        w = proj - gram @ x
        w[passive] = -np.inf
        j = int(np.argmax(w)) if n else 0
        if not n or w[j] <= tol:
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, p], y, rcond=None)[0]
            if (s > 1e-12).all():
                x[:] = 0
                x[p] = s
                break
            bad = s <= 1e-12
            step = np.min(x[p][bad] / np.maximum(x[p][bad] - s[bad], 1e-300))
            x[p] += step * (s - x[p])
            x[p[x[p] <= 1e-12]] = 0
            passive[p[x[p] <= 1e-12]] = False
    return x


def pack(length: np.ndarray, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH, slack: int = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece (lengths from 1 to window); longest first within a bin, in input order."""
    bins = -(-window // grain)
    kind = -(-length // grain)
    count = np.bincount(kind, minlength=bins + 1)[1:]
    a = combinations(bins, depth, slack)
    times = np.floor(nnls(a, count.astype(float)) + 1e-6).astype(np.int64)
    order = np.lexsort((-length, kind))
    start = np.concatenate([[0], np.cumsum(count)])
    used = np.zeros(bins, dtype=np.int64)
    pack_of = np.full(len(length), -1, dtype=np.int64)
    n_packs = 0
    for j in np.argsort(-times, kind="stable"):
        need = a[:, j].astype(np.int64)
        some = np.flatnonzero(need)
        t = int(min(times[j], ((count - used)[some] // need[some]).min()))
        if t <= 0:
            continue
        for b in some:
            take = order[start[b] + used[b] : start[b] + used[b] + t * need[b]]
            pack_of[take] = n_packs + np.arange(len(take)) % t
            used[b] += t * need[b]
        n_packs += t
    rest = np.flatnonzero(pack_of < 0)
    rest = rest[np.argsort(-length[rest], kind="stable")]
    room: list[list[int]] = [[] for _ in range(window + 1)]  # open windows by free words
    filled = np.bincount(pack_of[pack_of >= 0], weights=length[pack_of >= 0], minlength=n_packs).astype(np.int64)
    for p, f in enumerate(window - filled):
        room[f].append(p)
    full_bits = 0
    for f in range(1, window + 1):
        if room[f]:
            full_bits |= 1 << f
    for i in rest:
        size = int(length[i])
        fits = full_bits >> size
        if fits:
            f = size + (fits & -fits).bit_length() - 1  # the least room that is enough
            p = room[f].pop()
            if not room[f]:
                full_bits &= ~(1 << f)
        else:
            f, p = window, n_packs
            n_packs += 1
        pack_of[i] = p
        left = f - size
        if left:
            room[left].append(p)
            full_bits |= 1 << left
    by = np.lexsort((np.arange(len(length)), pack_of))
    begin = np.cumsum(length[by]) - length[by]
    first = np.ones(len(by), dtype=bool)
    first[1:] = pack_of[by][1:] != pack_of[by][:-1]
    offset = np.empty(len(length), dtype=np.int64)
    offset[by] = begin - begin[first][np.cumsum(first) - 1]
    return pack_of, offset


def lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, length) in words."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(Words(batch.column("text")).counts.astype(np.int32))], names=["doc_id", "length"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, f"doc_id {id_type}, length int")


def pack_documents(docs: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH, slack: int = SLACK, group_rows: int = GROUP_ROWS, sized: DataFrame | None = None) -> DataFrame:
    """(pack_group, pack, pack_offset, doc_id, copy, doc_start, length): where in which window each stretch of a document goes."""
    sized = (lengths(docs) if sized is None else sized).where("length > 0")
    id_type = sized.schema["doc_id"].dataType.simpleString()
    sized = sized.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("length")).cast("int"))
    sized = cut(sized)
    total = sized.agg(F.sum(F.ceil(F.col("length") / window))).first()[0] or 0
    groups = max(1, -(-int(total) // group_rows))
    starts = sized.select("doc_id", "copy", "length", F.explode(F.sequence(F.lit(0), ((F.col("length") - 1) / window).cast("int"))).alias("k"))
    parts = starts.select(
        F.pmod(F.xxhash64("doc_id", "k"), F.lit(groups)).cast("int").alias("pack_group"), "doc_id", "copy", (F.col("k") * window).alias("doc_start"), F.least(F.lit(window), F.col("length") - F.col("k") * window).cast("int").alias("length")
    )

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "copy", "doc_start"], ascending=[False, True, True, True], kind="stable")
        p, offset = pack(rows["length"].to_numpy(dtype=np.int64), window, grain, depth, slack)
        return pd.DataFrame({"pack_group": rows["pack_group"], "pack": p, "pack_offset": offset, "doc_id": rows["doc_id"], "copy": rows["copy"], "doc_start": rows["doc_start"], "length": rows["length"]})

    return parts.groupBy("pack_group").applyInPandas(solve, f"pack_group int, pack long, pack_offset int, doc_id {id_type}, copy int, doc_start int, length int")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
