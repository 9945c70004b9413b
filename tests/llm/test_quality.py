import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality

D = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the driver's tables")
def test_accuracy_on_rows_it_was_not_fitted_to(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    held = F.xxhash64("doc_id") % 2 == 0
    got = quality.scored(docs, labels.where(~held)).join(labels.where(held), "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("quality_keep").cast("int")).alias("kept")).collect()
    good, bad = (next(r for r in got if r["quality"] == q) for q in (1, 0))
    assert good["kept"] >= 0.99 * good["n"] and bad["kept"] <= 0.1 * bad["n"]


def test_statistics_by_hand():
    x = dict(zip(quality.STATISTICS, quality.statistics(pa.array(["AB cd ## cd !!", "", None]))[0]))
    assert abs(x["capitals"] - (2 + 0.03 * 120) / (6 + 120)) < 1e-12
    assert abs(x["symbols"] - 2 / (14 + 120)) < 1e-12
    assert abs(x["marked_words"] - 2 / (5 + 20)) < 1e-12
    assert abs(x["repeated_words"] - ((1 + 5) / 25) / (1 + np.log1p(5) / 10)) < 1e-12


def test_forest_isolates_the_odd_one():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(400, 3)), [[9.0, 9.0, 9.0]]])
    rare = np.zeros(401, dtype=bool)
    rare[-1] = True
    s = quality.Forest(x, rare, 0.01).score(x)
    assert s.argmax() == 400 and (s > 0).all() and (s < 1).all()
    one = quality.Forest(x, rare, 0.01)
    feature, split, left, right, value = one.trees[0]  # a path followed by hand
    at = 0
    while left[at] != at:
        at = left[at] if x[7, feature[at]] < split[at] else right[at]
    assert value[at] > 0


def test_edges(spark):
    good, bad = "A fine sentence of plain words, like any other. ", "BUY!! NOW!! ### $$$ %%% "
    docs = [(i, good * 5 + f" number {i}.") for i in range(60)] + [(100 + i, bad * 9 + str(i)) for i in range(12)] + [(200, None), (201, ""), (None, good * 5), (0, good * 5 + " number 0.")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS quality_score", "2 AS id", "3 AS quality")
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(100 + i, 0) for i in range(10)] + [(None, 1), (5, None), (7, 1), (999, 0)], "doc_id long, quality int")
    got = quality.keep(df, labels)
    assert got.columns == df.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(0) == 2 and None in ids and not {200, 201} & set(ids)
    assert sum(i is not None and i < 60 for i in ids) >= 60 and sum(i is not None and 100 <= i < 112 for i in ids) <= 2
    assert quality.keep(df.limit(0), labels).count() == 0
    assert quality.keep(df, labels.limit(0)).count() == len(docs) - 2
    assert quality.keep(df, labels.where("quality = 1")).count() == len(docs) - 2


def naive(text):
    """The statistics by loops."""
    raw = (text or "").encode()
    words = [x for x in re.split(rb"[\t-\r ]+", raw) if x]
    n, size = len(words), len(raw)
    symbol = set(range(33, 127)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789!?.,;:'\"()-=")
    drawn = lambda x, of, typical, weight: (x + typical * weight) / (of + weight)
    upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 or c >= 128 for c in raw)
    again = lambda xs: len(xs) - len(set(xs))
    odd = sum(w[-1] in symbol or (w[-1] in b"!?.,;:" and len(w) > 1 and w[-2] in b"!?.,;:") for w in words)
    return [
        drawn(upper, upper + lower, 0.03, 120), drawn(sum(c in symbol for c in raw), size, 0, 120), drawn(sum(c in b"!?.,;:" for c in raw), size, 0.025, 120),
        drawn(odd, n, 0, 20), drawn(sum(map(len, words)), n, 6.5, 20), drawn(again(words), n, 0.25, 20) / (1 + np.log1p(n) / 10),
        drawn(again([tuple(words[i : i + 5]) for i in range(n - 4)]), n, 0, 20), drawn(sum(a == b for a, b in zip(words, words[1:])), n, 0, 20),
        drawn(raw.count(b"|"), size, 0, 120),
    ]


def test_statistics_against_a_naive_version():
    r = random.Random(2)
    texts = ["", None, "\n", "a\n\nb\na\n", *("".join(r.choice(["word ", "Word, ", "é", "##", "|", "7 ", "\n", "the the ", "!! ", "x"]) for _ in range(r.randint(1, 80))) for _ in range(200))]
    assert np.allclose(quality.statistics(pa.array(texts)), [naive(t) for t in texts])
    assert quality.statistics(pa.array([], pa.string())).shape == (0, len(quality.STATISTICS))


def test_decisions_against_a_naive_version(spark):
    """Every document's score by walking the trees one node at a time, and the decision by the threshold."""
    good, bad = "A fine sentence of plain words, like any other. ", "BUY!! NOW!! ### $$$ %%% "
    docs = [(i, good * (i % 5 + 1) + f" number {i}.") for i in range(60)] + [(100 + i, bad * (i + 1)) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in docs], "doc_id long, quality int")
    forest, limit = quality.fit(df, labels)
    for r in quality.scored(df, labels).collect():
        x, total = np.array(naive(r["text"])), 0.0
        for feature, split, left, right, value in forest.trees:
            at = 0
            while left[at] != at:
                at = left[at] if x[feature[at]] < split[at] else right[at]
            total += value[at]
        score = 2.0 ** (-total / 100 / (2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256))
        assert r["quality_score"] == pytest.approx(score, abs=1e-9) and r["quality_keep"] == (score <= limit)


def test_two_texts_of_one_labelled_id_give_one_fit_in_any_order(spark):
    good, bad = "A fine sentence of plain words, like any other. ", "BUY!! NOW!! ### $$$ %%% "
    docs = [(i, good * 5 + f" number {i}.") for i in range(40)] + [(100 + i, bad * 9 + str(i)) for i in range(10)] + [(i, bad * 3) for i in range(40)] + [(3, bad * 3)] * 50
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in docs], "doc_id long, quality int")
    limits = set()
    for seed in range(3):
        random.Random(seed).shuffle(docs)
        limits.add(quality.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(1 + 3 * seed), labels)[1])
    assert len(limits) == 1


def test_labels_beyond_any_fixed_number_count(spark):
    """All rejected rows come last in the order by hash, after more than 20,000 others."""
    ids = [r["id"] for r in spark.range(20_600).orderBy(F.xxhash64("id"), "id").collect()]
    bad, r = set(ids[-400:]), random.Random(1)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(500)]
    docs = spark.createDataFrame([(i, "BUY!! NOW!! ### $$$ %%% " * 5 if i in bad else " ".join(r.choice(vocabulary) for _ in range(12)).capitalize() + ".") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in ids], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.keep(docs, labels).select("doc_id").collect()}
    assert not kept & bad and len(kept) >= 0.999 * (len(ids) - len(bad))


def test_fit_against_one_in_memory(spark):
    """Trees over all labelled rows, and the least cost over all of them by trees that they don't stand in."""
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["word", "Word,", "plain", "##" if i % 9 == 0 else "text", "!!" if i % 7 == 0 else "and"]) for _ in range(r.randint(5, 60)))) for i in range(700)]
    bad = {i for i, _ in docs if i % 9 == 0}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in range(700)], "doc_id long, quality int")
    forest, limit = quality.fit(df.repartition(5), labels)
    ids = np.array([x["h"] for x in df.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("doc_id").collect()]).view(np.uint64)
    x, rare = quality.statistics(pa.array([t for _, t in docs])), np.array([i in bad for i, _ in docs])
    one = quality.Forest(x, rare, 0.03, ids=ids)
    assert all(np.array_equal(a, b) for s, t in zip(forest.trees, one.trees, strict=True) for a, b in zip(s, t))
    stands = np.array([one.stands(ids, t) for t in range(100)])
    assert (stands.sum(0) == one.share).all() and (stands.sum(1) > 200).all()
    total = np.zeros(700)
    for k in range(700):
        for (feature, split, left, right, value), there in zip(one.trees, stands[:, k]):
            at = 0
            while left[at] != at:
                at = left[at] if x[k, feature[at]] < split[at] else right[at]
            total[k] += 0 if there else value[at]
    score = 2.0 ** (-total / (100 - one.share) / one._mean_path(256))
    cost = lambda at: 8 * (score[~rare] > at).sum() + (score[rare] <= at).sum()
    assert cost(limit) == min(cost(at) for at in [0.0, *score])


def test_each_row_stands_in_a_tree_however_many_rows():
    ids = quality.mix(np.arange(60_000, dtype=np.uint64))
    forest = quality.Forest.empty(59_000, 1_000, 0.03)
    stands = np.array([forest.stands(ids, t) for t in range(100)])
    assert (stands.sum(0) == 1).all() and stands.sum(1).min() > 500


def test_threshold_against_all_limits(spark):
    r = random.Random(5)
    for n in (1, 2, 30, 300):
        for even in (2, 40, 10**6):  # ties, and hardly any
            rows = [(round(r.random() * even) / even, r.random() < 0.3) for _ in range(n)]
            at = quality.threshold(spark.createDataFrame(rows, "score double, bad boolean").repartition(7), 8.0)
            cost = lambda x: sum((8 * (s > x)) if not b else s <= x for s, b in rows)  # noqa: B023, E731
            assert cost(at) == min(cost(x) for x in [-1.0, *(s for s, _ in rows)])
