import numpy as np
import pytest

from graphloom.llm import queries, vectors

VEC = "vec_id long, embedding array<float>, label int"


def brute(x, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    root = list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1))):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(x)) if find(i) != i}


@pytest.mark.parametrize("options", [{}, {"cell_rows": 5, "train_per_cell": 2, "salt_rows": 10}])
def test_recall_on_vectors_without_clusters(spark, options):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 64))
    near = x[:400] + rng.normal(size=(400, 64)) * rng.uniform(0.05, 0.3, size=(400, 1))
    x = np.vstack([x, near, x[:30]]).astype(np.float32)
    want = brute(x.astype(np.float64), 0.95)
    got = {r["vec_id"]: r["keeper_id"] for r in vectors.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC), **options).collect()}
    assert len(want) > 200
    assert len(set(got.items()) & set(want.items())) >= 0.9 * len(want)
    assert all(want.get(i) == k or i in want for i, k in got.items())


def test_edges(spark, rows):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [], 0), (6, [nan, 1.0], 0), (7, [inf, 1.0], 0), (8, [1.0, None], 0), (9, [1.0], 0), (None, [1.0, 0.0], 0), (10, [0.0, 1.0], 0), (0, [1.0, 0.001], 0), (2, [2.0, 0.0], 0)]
    df = spark.createDataFrame(data, VEC).selectExpr("*", "1 AS cell", "2 AS vec", "3 AS keeper")
    assert rows(vectors.near_duplicates(df)) == [(1, 0), (2, 0)]
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    assert vectors.near_duplicates(df.where("vec_id = 10")).count() == 0
    named = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.01]), ("c", [0.0, 1.0])], "vec_id string, embedding array<double>")
    assert rows(vectors.near_duplicates(named)) == [("b", "a")]


@pytest.mark.parametrize("cell_rows", [vectors.CELL_ROWS, 50])
def test_a_crowded_cell_and_many_copies(spark, cell_rows):
    """A third of all rows are one vector, another third lie in one narrow cone that a chain of near pairs joins."""
    rng = np.random.default_rng(5)
    one = rng.normal(size=16)
    cone = one[::-1] + rng.normal(size=(400, 16)) * 0.12
    x = np.vstack([rng.normal(size=(400, 16)), np.tile(one, (400, 1)), cone]).astype(np.float32)
    want = brute(x.astype(np.float64), 0.95)
    got = {r["vec_id"]: r["keeper_id"] for r in vectors.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC), cell_rows=cell_rows, salt_rows=100).collect()}
    assert len(want) > 700 and len(set(got.items()) & set(want.items())) >= 0.99 * len(want) and set(got) <= set(want)


def test_the_query_finds_planted_pairs(spark, tmp_path):
    """The registered query on a table like the driver's, with pairs planted in it."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 64))
    x = np.vstack([x, x[:200] + rng.normal(size=(200, 64)) * 0.1])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(x)], VEC).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute(x.astype(np.float64), vectors.THRESHOLD)
    got = {r["vec_id"]: r["keeper_id"] for r in queries.QUERIES["op5_embedding_near_dedup"](spark, str(tmp_path)).collect()}
    assert len(want) == 200 and len(set(got.items()) & set(want.items())) >= 190 and set(got) <= set(want)


def test_rows_of_one_id_with_different_vectors(spark, rows):
    data = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, [0.0, 1.0], 0), (3, [0.01, 1.0], 0), (4, [-1.0, 0.0], 0)]
    assert rows(vectors.near_duplicates(spark.createDataFrame(data, VEC))) == [(2, 1), (3, 1)]
