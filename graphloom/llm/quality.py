"""Operator 10, quality rules: an isolation forest over rule statistics, its threshold calibrated on labelled rows.

The rules' statistics are shares of a document's bytes and words (capitals, symbols, marks at word ends, repeated words
and phrases, stutters, word lengths), drawn towards typical values where a text is short. Some (bars, stutters, marked
words) answer to kinds of junk seen in the tables that this was built on: for another corpus, look at its junk first.
Shares of digits and of repeated lines were tried; random splits on them only diluted the rest (2 % and 6 % of held-out
junk kept at 10,000 and 51,000 documents, against 0 % and 1 %). The forest isolates by
random splits; the shorter the mean path, the more anomalous the document. All labelled rows count in it: each stands in
at least one tree, and in as many as give a tree `sample` rows (half of the trees at most), so trees grow with the labels.
Ranges and leaf masses come from all rows of a tree; masses are scaled to `sample` rows, and rejected rows are weighted
to a share of `contamination` so that they stay anomalies. The threshold is the one with the least cost over all labelled
rows, each scored by the trees it doesn't stand in. A task grows a tree from its rows; costs are counted in sorted parts.
Good rows far from all others are anomalies too: where there are only a few different good texts, rare ones may outrank
junk.
Statistics and decisions cover every document and its whole text.

Results, case by case: a null or wordless text is rejected (score 1); a null doc_id is scored like any other; labels
that are null, repeated or without document are ignored or, if repeated, counted once, and of several texts with one id
the one of least digest counts for the fit; without labels of both kinds, all
documents that have words are kept; repeated rows get equal scores; an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.session import cut, documents
from graphloom.llm.text import Words, mix, pieces

STATISTICS = ("capitals", "symbols", "marks", "marked_words", "word_length", "repeated_words", "repeated_phrases", "stutters", "pipes")
PRIOR_BYTES, PRIOR_WORDS = 120.0, 20.0

_UPPER, _LOWER, _DIGIT, _SYMBOL, _MARK = (np.zeros(256, dtype=bool) for _ in range(5))
_UPPER[65:91] = True
_LOWER[97:123] = True
_LOWER[128:] = True
_DIGIT[48:58] = True
_MARK[[ord(c) for c in "!?.,;:"]] = True
_SYMBOL[33:127] = True
_SYMBOL &= ~(_UPPER | _LOWER | _DIGIT | _MARK)
_SYMBOL[[ord(c) for c in "'\"()-="]] = False


def statistics(col: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    w = Words(col)
    n, data = len(col), w.data

    def per_row(flag: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flag)])
        return (c[w.offsets[1:]] - c[w.offsets[:-1]]).astype(float)

    upper, lower, words = per_row(_UPPER[data]), per_row(_LOWER[data]), w.counts.astype(float)
    size = np.diff(w.offsets).astype(float)
    last = data[w.ends - 1] if len(w) else np.zeros(0, np.uint8)
    back = data[np.maximum(w.ends - 2, w.starts)] if len(w) else last
    odd = _SYMBOL[last] | (_MARK[last] & _MARK[back] & (w.ends - w.starts > 1))
    by_word = lambda x: np.bincount(w.row, weights=x, minlength=n)

    def repeats(k: int) -> np.ndarray:
        if len(w) < k:
            return np.zeros(n)
        at = np.flatnonzero(w.row[: len(w) - k + 1] == w.row[k - 1 :])
        row = w.row[at]
        h = w.hash[at] if k == 1 else w.span_hash(at, at + k)
        key = np.sort((mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) | (row.astype(np.uint64) << np.uint64(40)))
        same = key[1:] == key[:-1]
        return np.bincount((key[1:][same] >> np.uint64(40)).astype(np.int64), minlength=n).astype(float)

    drawn = lambda x, of, typical, weight: (x + typical * weight) / (of + weight)
    return np.column_stack([
        drawn(upper, upper + lower, 0.03, PRIOR_BYTES),
        drawn(per_row(_SYMBOL[data]), size, 0.0, PRIOR_BYTES),
        drawn(per_row(_MARK[data]), size, 0.025, PRIOR_BYTES),
        drawn(by_word(odd.astype(float)), words, 0.0, PRIOR_WORDS),
        drawn(by_word((w.ends - w.starts).astype(float)), words, 6.5, PRIOR_WORDS),
        drawn(repeats(1), words, 0.25, PRIOR_WORDS) / (1.0 + np.log1p(words) / 10.0),
        drawn(repeats(5), words, 0.0, PRIOR_WORDS),
        drawn(np.bincount(w.row[1:][(w.row[1:] == w.row[:-1]) & (w.hash[1:] == w.hash[:-1])], minlength=n).astype(float), words, 0.0, PRIOR_WORDS),
        drawn(per_row(data == ord("|")), size, 0.0, PRIOR_BYTES),
    ])


class Forest:
    """Isolation trees as arrays: at an inner node go left if x[feature] < split; a leaf holds its path length."""

    def __init__(self, x: np.ndarray, rare: np.ndarray, contamination: float, trees: int = 100, sample: int = 256, seed: int = 7, ids: np.ndarray | None = None) -> None:
        """From rows in memory; `ids` are 64-bit hashes that say which trees a row stands in."""
        ids = mix(np.arange(len(x), dtype=np.uint64)) if ids is None else ids
        self._shape(int((~rare).sum()), int(rare.sum()), contamination, trees, sample, seed)
        self.trees = [self.grow(t, x[m], rare[m]) for t in range(trees) for m in [self.stands(ids, t)]]

    def _shape(self, usual: int, rare: int, contamination: float, count: int = 100, sample: int = 256, seed: int = 7) -> None:
        self.count, self.sample, self.seed, self.trees = count, sample, seed, []
        self.share = int(np.clip(np.ceil(sample * count / max(1, usual + rare)), 1, count // 2))  # the number of trees that a row stands in
        self.weight = contamination * usual / ((1 - contamination) * max(1, rare))  # of a rare row

    @classmethod
    def empty(cls, usual: int, rare: int, contamination: float) -> Forest:
        """Without trees yet, for so many rows of each kind."""
        self = cls.__new__(cls)
        self._shape(usual, rare, contamination)
        return self

    def stands(self, ids: np.ndarray, tree: int) -> np.ndarray:
        """Which rows stand in a tree: each in exactly `share` of them."""
        step = np.array([k for k in range(1, self.count) if math.gcd(k, self.count) == 1], dtype=np.uint64)  # so that trees keep apart
        h, n = ids.astype(np.uint64), np.uint64(self.count)
        return (h % n + np.uint64(tree) * step[(h // n) % np.uint64(len(step))]) % n < self.share

    @staticmethod
    def _mean_path(n: float) -> float:
        return float(np.interp(n, [1, 2, 3], [0, 1, 2 * (np.log(2) + 0.5772156649) - 4 / 3])) if n < 3 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n

    def grow(self, tree: int, x: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, ...]:
        """A tree over all these rows, the same in any order of them."""
        rng, limit = np.random.default_rng([self.seed, tree]), int(np.ceil(np.log2(self.sample)))
        feature, split, left, right, value = [], [], [], [], []
        weigh = lambda rows: float(len(rows) - rare[rows].sum() + self.weight * rare[rows].sum())
        scale = min(1.0, self.sample / max(1.0, weigh(np.arange(len(x)))))

        def node(rows: np.ndarray, depth: int) -> int:
            me, mass = len(feature), scale * weigh(rows)
            for a in (feature, split, left, right, value):
                a.append(0)
            span = np.ptp(x[rows], axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
            if depth >= limit or mass <= 1 or not (span > 0).any():
                feature[me], left[me], right[me], value[me] = 0, me, me, depth + self._mean_path(mass)
                split[me] = np.inf
                return me
            f = int(rng.choice(np.flatnonzero(span > 0)))
            s = rng.uniform(x[rows, f].min(), x[rows, f].max())
            go = x[rows, f] < s
            feature[me], split[me] = f, s
            left[me] = node(rows[go], depth + 1)
            right[me] = node(rows[~go], depth + 1)
            return me

        node(np.arange(len(x)), 0)
        return np.array(feature), np.array(split, float), np.array(left), np.array(right), np.array(value, float)

    def score(self, x: np.ndarray, ids: np.ndarray | None = None) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies. With ids, by the trees that a row doesn't stand in."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t, (feature, split, left, right, value) in enumerate(self.trees):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.ceil(np.log2(self.sample)))):
                at = np.where(x[rows, feature[at]] < split[at], left[at], right[at])
            total += value[at] if ids is None else np.where(self.stands(ids, t), 0.0, value[at])
        return 2.0 ** (-total / (len(self.trees) - (0 if ids is None else self.share)) / self._mean_path(self.sample))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """id (a hash of doc_id), bad and STATISTICS of every labelled row, one row an id."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).withColumnRenamed("doc_id", "__gl_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in pieces(big):
                x = statistics(batch.column("text"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "digest")), *(pa.array(c) for c in x.T)], names=["doc_id", "digest", *STATISTICS])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("digest"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(scan, f"doc_id {id_type}, digest long, " + ", ".join(f"{c} double" for c in STATISTICS))  # before the join, so that no text is shuffled
    one = found.groupBy("doc_id").agg(F.min(F.struct("digest", *STATISTICS)).alias("x"))  # one row an id, whatever order rows come in
    return one.join(known, F.col("doc_id") == F.col("__gl_id")).select(F.xxhash64("doc_id").alias("id"), (F.col("quality") == 0).alias("bad"), *(f"x.{c}" for c in STATISTICS))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """STATISTICS and ids of a batch of labelled rows."""
    return np.column_stack([batch.column(c).to_numpy() for c in STATISTICS]), batch.column("id").to_numpy().view(np.uint64)


def grown(rows: DataFrame, forest: Forest) -> Forest:
    """The forest with its trees, each grown by one task over all rows that stand in it."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy().view(np.uint64)
            for tree in range(forest.count):
                part = batch.filter(pa.array(forest.stands(ids, tree))).drop_columns(["id"])
                yield part.append_column("tree", pa.array(np.full(part.num_rows, tree, np.int32)))

    def grow(key: tuple[int], x: pd.DataFrame) -> pd.DataFrame:
        got = forest.grow(int(key[0]), x[list(STATISTICS)].to_numpy(), x["bad"].to_numpy(bool))
        return pd.DataFrame([(key[0], *got)], columns=["tree", "feature", "split", "lower", "upper", "value"])

    spread_to = "bad boolean, " + ", ".join(f"{c} double" for c in STATISTICS) + ", tree int"
    trees = rows.mapInArrow(spread, spread_to).repartition(forest.count, "tree").groupBy("tree").applyInPandas(grow, "tree int, feature array<long>, split array<double>, lower array<long>, upper array<long>, value array<double>")
    found = {r["tree"]: tuple(np.array(c) for c in r[1:]) for r in trees.collect()}  # 100 trees of at most 511 nodes
    none = np.zeros((0, len(STATISTICS))), np.zeros(0, dtype=bool)
    forest.trees = [found.get(t) or forest.grow(t, *none) for t in range(forest.count)]
    return forest


def threshold(rows: DataFrame, cost: float) -> float:
    """The limit of least cost over all rows of (score, bad), where a lost good row costs `cost` and a kept bad one 1.

    It lies between two neighbouring scores; of several such places it is the widest, then the one of highest score.
    """
    ranged = cut(cut(rows).repartitionByRange(F.desc("score")).sortWithinPartitions(F.desc("score")))  # the inner cut as ranges are found by a pass of their own
    parts = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"), F.max("score").alias("most"), F.min("score").alias("least")).orderBy("part").collect()
    before, good, bad, last = {}, 0, 0, parts[0]["most"] + 0.02
    for p in parts:
        before[p["part"]] = good, bad, last
        good, bad, last = good + p["good"], bad + p["bad"], p["least"]
    all_bad = bad

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, (good, bad, last) = None, before.get(TaskContext.get().partitionId(), (0, 0, 0.0))
        for batch in batches:
            if not batch.num_rows:
                continue
            s, b = batch.column("score").to_numpy(), batch.column("bad").to_numpy(zero_copy_only=False)
            above = np.concatenate([[last], s[:-1]])
            lost = cost * (good + np.cumsum(~b) - ~b) + all_bad - (bad + np.cumsum(b) - b)
            lost[above == s] = np.inf  # equal scores stay together
            i = np.lexsort((s - above, lost))[0]
            here = float(lost[i]), float(s[i] - above[i]), -float(above[i]), float(s[i])
            best = here if best is None else min(best, here)
            good, bad, last = good + int((~b).sum()), bad + int(b.sum()), s[-1]
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in best], names=["lost", "width", "above", "below"])

    found = [tuple(r) for r in ranged.mapInArrow(places, "lost double, width double, above double, below double").collect()]  # a row a partition
    _, _, above, below = min([*found, (cost * good, -0.02, -last, last - 0.02)])
    middle = (below - above) / 2
    return middle if middle < -above else below


def fit(docs: DataFrame, labels: DataFrame, contamination: float = 0.03, cost: float = 8.0) -> tuple[Forest, float] | None:
    """The forest and its threshold, from all labelled rows; None without both kinds of label."""
    rows = cut(labelled(docs, labels))
    n = {r["bad"]: r["count"] for r in rows.groupBy("bad").count().collect()}
    if n.get(True, 0) < 2 or n.get(False, 0) < 2:
        return None
    forest = grown(rows, Forest.empty(n[False], n[True], contamination))
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.score(*_columns(batch))), batch.column("bad")], names=["score", "bad"])

    return forest, threshold(rows.mapInArrow(score, "score double, bad boolean"), cost)


def scored(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """docs with quality_score and quality_keep (columns of these names are replaced)."""
    model = fit(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 100 trees of at most 511 nodes

    @F.pandas_udf("double")
    def score(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in text:
            out = []
            for batch in pieces(pa.RecordBatch.from_arrays([pa.array(part, pa.string(), from_pandas=True)], names=["text"])):
                col = batch.column("text")
                some = Words(col).counts > 0
                x = np.zeros(len(col)) if shared.value is None else shared.value[0].score(statistics(col))
                out.append(np.where(some, x, 1.0))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0), index=part.index)

    limit = 0.9999 if model is None else min(model[1], 0.9999)
    return docs.withColumn("quality_score", score(F.col("text").cast("string"))).withColumn("quality_keep", F.col("quality_score") <= limit)


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """docs, all columns, without the documents that the rules reject."""
    out = scored(docs.withColumns({f"__gl_{c}": F.col(c) for c in docs.columns if c in ("quality_score", "quality_keep")}), labels, **options).where("quality_keep")
    return out.select(*(F.col(f"__gl_{c}").alias(c) if c in ("quality_score", "quality_keep") else F.col(f"`{c}`") for c in docs.columns))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with their scores."""
    return scored(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("quality_keep").select("doc_id", "quality_score")
