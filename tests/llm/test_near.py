import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import near
from graphloom.llm.text import Words, release

DOCS = "doc_id long, text string"


def shingles(text, k=3):
    w = text.split()
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter({tuple(w): 1} if w else {})


def jp(x, y):
    """Probability Jaccard by its definition."""
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in x if i in y)


def corpus():
    r = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    docs = {}
    for g in range(40):
        base = [r.choice(vocabulary) for _ in range(r.randint(20, 120))]
        for _ in range(r.randint(1, 5)):
            w = list(base)
            for _ in range(r.randint(0, len(w) // 8)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            docs[len(docs)] = " ".join(w)
    return docs


def groups(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_similarity_is_exact():
    texts = ["a b c d e a b c", "a b c d f", "a b c a b c a b c", "x", "x y", "q w e r t y"]
    w = Words(pa.array(texts))
    row, h, weight = near.elements(w)
    bound = np.searchsorted(row, np.arange(len(texts) + 1))
    own = [(h[a:b], weight[a:b]) for a, b in zip(bound, bound[1:])]
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            assert abs(near.similarity(own[i], own[j]) - jp(shingles(x), shingles(y))) < 1e-12


def test_registers_estimate_it():
    r = random.Random(1)
    x = [" ".join(r.choice("abcdef") for _ in range(60)) for _ in range(2)]
    x[1] = x[0][:70] + x[1][70:]
    w = Words(pa.array(x))
    row, h, weight = near.elements(w)
    sig = near.signatures(row, h, weight, 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - jp(shingles(x[0]), shingles(x[1]))) < 0.04


@pytest.mark.parametrize("salt_rows", [near.skew.SALT_ROWS, 3])
def test_recall_and_precision(spark, salt_rows):
    docs = corpus()
    s = {i: shingles(t) for i, t in docs.items()}
    true = [(i, j) for i in docs for j in docs if i < j and jp(s[i], s[j]) >= near.THRESHOLD]
    want = {i: k for i, k in groups(true, docs).items() if i != k}
    got = {r["doc_id"]: r["keeper_id"] for r in near.near_duplicates(spark.createDataFrame(list(docs.items()), DOCS).repartition(4), salt_rows=salt_rows).collect()}
    assert len(set(want.items()) & set(got.items())) >= 0.9 * len(want)
    whole = groups(true, docs)
    assert all(whole[i] == whole[k] for i, k in got.items())  # nothing is joined that brute force holds apart


def test_edges(spark, rows):
    docs = [(None, "a b c d"), (1, None), (2, ""), (3, "  "), (5, "a b c d"), (4, "a  b c\nd"), (4, "a b c d"), (6, "one"), (7, "one"), (8, "two"), (9, "a b c d")]
    df = spark.createDataFrame(docs, DOCS)
    assert rows(near.near_duplicates(df)) == [(5, 4), (7, 6), (9, 4)]
    kept = near.drop_near_duplicates(df.selectExpr("*", "1 AS keeper_id", "2 AS leader", "3 AS c1"))
    assert kept.columns == ["doc_id", "text", "keeper_id", "leader", "c1"] and kept.count() == 8
    assert near.near_duplicates(df.limit(0)).count() == 0
    assert near.near_duplicates(df.where("doc_id = 8")).count() == 0


@pytest.mark.parametrize("salt_rows", [near.skew.SALT_ROWS, 50])
def test_many_copies_and_a_crowded_bucket(spark, salt_rows):
    """Thousands of exact copies, and texts that share half their words but aren't near each other."""
    shared = " ".join(f"s{i}" for i in range(12))
    docs = [(i, "the very same words again") for i in range(3000)] + [(5000 + i, shared + " " + " ".join(f"d{i}_{k}" for k in range(12))) for i in range(120)] + [(9000, shared + " " + " ".join(f"d7_{k}" for k in range(11)))]
    got = {r["doc_id"]: r["keeper_id"] for r in near.near_duplicates(spark.createDataFrame(docs, DOCS), salt_rows=salt_rows).collect()}
    assert {i: 0 for i in range(1, 3000)} == {i: k for i, k in got.items() if i < 5000}
    assert {i: k for i, k in got.items() if i >= 5000} == {9000: 5007}


def test_a_long_text(spark):
    r = random.Random(2)
    w = [f"x{r.randrange(10**6)}" for _ in range(150_000)]
    got = near.near_duplicates(spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:140_000])), (3, " ".join(w[:20_000]))], DOCS)).collect()
    assert [(r["doc_id"], r["keeper_id"]) for r in got] == [(2, 1)]


@pytest.mark.parametrize("salt_rows", [near.skew.SALT_ROWS, 20])
def test_a_crowd_between_two_ends(spark, salt_rows):
    """B is near 100 earlier texts, each with other parts of it, and near C, which is near B only."""
    r = random.Random(6)
    base = [f"b{i}" for i in range(100)]
    end = set(base[25:])
    docs = {}
    while len(docs) < 100:
        part = r.sample(base, 75)
        if len(end & set(part)) <= 60:
            docs[len(docs)] = " ".join(part + [f"a{len(docs)}_{k}" for k in range(25)])
    docs |= {100: " ".join(base), 101: " ".join([f"c{k}" for k in range(25)] + base[25:])}
    s = {i: set(t.split()) for i, t in docs.items()}  # no word repeats, so that it is plain Jaccard similarity
    true = [(i, j) for i in docs for j in docs if i < j and len(s[i] & s[j]) / len(s[i] | s[j]) >= near.THRESHOLD]
    assert [p for p in true if 101 in p] == [(100, 101)]
    got = {x["doc_id"]: x["keeper_id"] for x in near.near_duplicates(spark.createDataFrame(list(docs.items()), DOCS), shingle=1, salt_rows=salt_rows).collect()}
    assert got[100] == 0 and got[101] == 0


def test_components_with_hubs(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(1000, 1001 + i) for i in range(200)] + [(3000, 2000 + i) for i in range(200)] + [(4000 + i, 4001 + i) for i in range(60)]
    want = {i: k for i, k in groups(edges, {x for e in edges for x in e}).items() if i != k}
    for salt_rows in (10, 10**6):
        assert {x["doc_id"]: x["keeper"] for x in near.components(spark.createDataFrame(edges, "u long, v long"), salt_rows).collect()} == want


def test_freed_memory_is_given_back():
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Anonymous:")) >> 10

    kept = [np.ones(8000) for _ in range(4000)]  # 244 MB, each too small to be mapped on its own
    full, last = held(), kept[-1]
    del kept
    release()
    assert full - held() > 200 and last.sum() == 8000
