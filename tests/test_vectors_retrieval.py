import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.text import cosine
from graphloom.operators import metrics as M
from graphloom.operators import retrieval as R
from graphloom.operators import vectors as V

VEC = "vec_id long, embedding array<double>, label int"


def table(spark, x, labels=None):
    return spark.createDataFrame([(i, [float(y) for y in v], int(labels[i]) if labels is not None else 0) for i, v in enumerate(x)], VEC)


def brute(x, k):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -np.inf)
    return {i: sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k] for i in range(len(x))}


def test_exact_search_over_blocks(spark):
    x = np.random.default_rng(0).normal(size=(60, 8))
    x[7] = x[3]  # ties
    want = brute(x, 4)
    df = table(spark, x)
    got = {}
    for r in V.knn(df, df, 4, block_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == want
    assert V.knn(df.limit(0), df, 3).count() == 0 and V.knn(df, df.limit(0), 3).count() == 0


def test_odd_vectors(spark, rows):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 0.0], 0), (2, None, 0), (3, [], 0), (4, [1.0], 0), (None, [1.0, 0.0], 0), (5, [2.0, 0.0], 0)], VEC)
    assert (0, 5, 1.0) in rows(V.knn(df, df, 5), "query_id", "vec_id", "score")
    assert rows(V.similar_pairs(df, 0.7), "source", "target") == [(0, 5)]
    assert rows(V.rejected(df, 2), "vec_id", "problem") == sorted([(None, "no id"), (2, "no vector"), (3, "wrong dimension"), (4, "wrong dimension")], key=repr)
    c = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([0.0], [1.0]), ([1.0, 0.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in c.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, -1.0]


def test_approximate_recall(spark):
    x = np.random.default_rng(1).normal(size=(600, 16))
    want, got = brute(x, 5), {}
    df = table(spark, x)
    for r in V.ivf(df, k=5).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[i] & set(want[i])) / 5 for i in want]) >= 0.9
    assert V.ivf(df.limit(0)).count() == 0


def test_filters(spark):
    x = np.random.default_rng(2).normal(size=(40, 4))
    df = table(spark, x, np.arange(40) % 4)
    pre = V.search(df, df, 3, {"label": 1}).groupBy("query_id").count().select("count").distinct().collect()
    assert [r[0] for r in pre] == [3]
    assert V.search(df, df, 3, {"label": {"$in": [1]}}, post_filter=True).count() < 40 * 3


def test_vector_table(spark, tmp_path):
    t = V.create_vector_table("faiss", spark, str(tmp_path / "v"), 2)
    t.add(table(spark, np.array([[1, 0], [0, 1]])))
    t.add(spark.createDataFrame([(1, [1.0, 1.0], 5)], VEC))
    assert t.count() == 2 and t.get(1)["label"] == 5 and t.get(9) is None
    with pytest.raises(ValueError):
        t.add(spark.createDataFrame([(2, [1.0], 0)], VEC))
    with pytest.raises(ValueError):
        t.update(spark.createDataFrame([(7, [1.0, 1.0], 0)], VEC))
    t.delete(spark.createDataFrame([(0,)], "vec_id long"))
    assert V.VectorTable(spark, str(tmp_path / "v"), 2).count() == 1
    with pytest.raises(ValueError):
        V.create_vector_table("magic", spark, "", 2)


def test_mock_embeddings(spark):
    df = V.attach_embeddings(spark.createDataFrame([("a",), (None,), ("a",)], "id string"))
    a, none, b = (r["embedding"] for r in df.collect())
    assert len(a) == 384 and a == b and none is None and a == V.mock_vector("a")


@pytest.mark.parametrize(
    ("text", "tokens", "relation"),
    [
        ("Apple (produces)", ("apple", "produces"), "produces"), ("who rel:works_at, Bob?", ("rel:works_at", "bob?"), "works_at"), ("x relation=a.", ("relation=a.",), "a"), ("(two words)", ("two", "words"), None),
        ("the of a", (), None), ("", (), None), (None, (), None), ("rel:", ("rel:",), None),
    ],
)
def test_query_parse(text, tokens, relation):
    q = R.Query.parse(text)
    assert q.tokens == tokens and q.relation == relation


def test_scores(spark):
    n = spark.createDataFrame([(0, "Apple Inc"), (1, "apple"), (2, "Pineapple"), (3, "Inc"), (4, " ")], "node_idx long, id string")
    got = {r["id"]: r["score"] for r in R.entity_scores(n, R.Query.parse("apple")).collect()}
    assert got == {"Apple Inc": 4.4, "apple": 5.0, "Pineapple": 3.0}


def test_names_in_texts(spark, rows):
    t = spark.createDataFrame([(1, "Business is US"), (2, None), (3, ""), (4, "x"), (5, "the Acme Corp. and acme")], "k long, text string")
    n = spark.createDataFrame([("us",), ("Acme Corp",), ("acme",), ("X",), ("",), ("zzzz",), ("corp. and",)], "name string")
    want = sorted([(k, x) for k, s in [(1, "Business is US"), (4, "x"), (5, "the Acme Corp. and acme")] for x in ("us", "Acme Corp", "acme", "X", "zzzz", "corp. and") if x.lower() in s.lower()], key=repr)
    assert rows(R.containing(t, n, "k")) == want


def test_fusion_cuts_before_it_drops(spark, rows):
    s = "query int, id int, rank int"
    v, g = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], s), spark.createDataFrame([(1, 9, 1), (1, 8, 2), (1, 1, 3)], s)
    assert rows(R.fuse(v, g, 2), "id") == [(1,)]  # 1 and 9 are the best two, 9 has no vector
    assert rows(R.fuse(v, g, 9), "id") == [(1,), (2,)]
    assert rows(R.hybrid(v, g, 1, "other"), "id") == [(1,)] and rows(R.hybrid(v, None, 9), "id") == [(1,), (2,)]


def test_metrics_are_zero_safe(spark):
    s = spark.createDataFrame([], "a int")
    r = M.combined(M.set_counts(s, s, ["a"]), M.set_counts(s, s, ["a"])).first()
    assert tuple(r) == (0.0, 0.0, 0.0, 0.0)
    one, two = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(2,), (3,), (3,), (4,)], "a int")
    r = M.with_prf(M.set_counts(one, two, ["a"])).first()
    assert (r["expected"], r["predicted"], r["correct"]) == (2, 3, 1)
    q = M.retrieval(spark.createDataFrame([(1, 1), (1, 2)], "query int, id int"), spark.createDataFrame([(1, 1), (2, 5)], "query int, id int")).first()
    assert tuple(q) == (0.5, 0.5)
    f = M.failures(spark.createDataFrame([("a", 0.2, None), ("b", 0.0, 0.1)], "dataset string, violation double, precision double"))
    assert sorted((x["dataset"], x["failure"]) for x in f.collect()) == [("a", "entity boundary violations"), ("b", "low retrieval precision")]


def test_scores_of_a_block_come_in_tiles():
    """A block's scores are never in memory as a whole, and every query is answered under its own id."""
    r = np.random.default_rng(3)
    q, v, seen = r.normal(size=(300, 8)), r.normal(size=(500, 8)), []

    def over(x, x_id, y, y_id):
        seen.append(len(x))
        i, j = np.nonzero(x @ y.T > 4)
        return i, j, (x @ y.T)[i, j]

    got = V._tiled(over, q, np.arange(300) + 1000, v, np.arange(500))
    i, j = np.nonzero(q @ v.T > 4)
    assert max(seen) <= V.TILE_ROWS < 300 and sum(seen) == 300
    assert list(zip(got["query_id"], got["vec_id"], strict=True)) == list(zip((i + 1000).tolist(), j.tolist(), strict=True))
