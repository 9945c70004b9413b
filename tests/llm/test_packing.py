import random

import numpy as np
import pandas as pd

from graphloom.llm import packing

DOCS = "doc_id long, text string"


def test_nnls_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, y = rng.random((12, 20)), rng.random(12) * 10
        x = packing.nnls(a, y)
        grad = a.T @ (a @ x - y)
        assert (x >= 0).all() and (grad > -1e-6).all() and np.abs(grad[x > 1e-9]).max(initial=0) < 1e-6
    assert packing.nnls(np.zeros((3, 0)), np.ones(3)).shape == (0,)


def test_combinations_fill_the_window():
    a = packing.combinations(8, 3, 0)
    assert all(sum((i + 1) * k for i, k in enumerate(c)) == 8 and c.sum() <= 3 for c in a.T)
    assert a.shape[1] == len([1 for i in range(1, 9) for j in range(i + 1) for k in range(j + 1) if i + j + k == 8 and not (j == 0 and k)])


def check(rows, sizes, window):
    """Each document's words once and in order, no window over full, no overlap; returns the share of windows filled."""
    f = pd.DataFrame(rows)
    for _, g in f.groupby(["pack_group", "pack"]):
        g = g.sort_values("pack_offset")
        assert (g["pack_offset"].to_numpy() == np.concatenate([[0], np.cumsum(g["length"])[:-1]])).all() and g["length"].sum() <= window
    got = {}
    for k, g in f.groupby(["doc_id", "copy"]):
        g = g.sort_values("doc_start")
        assert (g["doc_start"].to_numpy() == np.concatenate([[0], np.cumsum(g["length"])[:-1]])).all()
        got.setdefault(k[0], []).append(int(g["length"].sum()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in sizes.items()}
    return f["length"].sum() / (window * len(f[["pack_group", "pack"]].drop_duplicates()))


def test_everything_is_packed_and_well(spark):
    r = random.Random(3)
    sizes = {i: [r.choice([5, 30, 100, 400, 900, 2500, 9000])] for i in range(400)}
    for i in range(0, 400, 2):
        sizes[i] = [r.randint(1, 2000)]
    df = spark.createDataFrame([(i, "w " * n[0]) for i, n in sizes.items()], DOCS)
    got = [r.asDict() for r in packing.pack_documents(df).collect()]
    assert check(got, sizes, packing.WINDOW) > 0.95
    again = [r.asDict() for r in packing.pack_documents(df.repartition(7)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    small = [r.asDict() for r in packing.pack_documents(df, group_rows=50).collect()]
    assert len({r["pack_group"] for r in small}) > 1 and check(small, sizes, packing.WINDOW) > 0.8


def test_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "a " * 2048), (5, "b " * 2049), (3, "a")], DOCS).selectExpr("*", "1 AS pack", "2 AS length", "3 AS copy")
    got = [r.asDict() for r in packing.pack_documents(df).collect()]
    check(got, {3: [1, 2, 2], 4: [2048], 5: [2049]}, packing.WINDOW)
    assert packing.pack_documents(df.limit(0)).count() == 0
    assert packing.pack_documents(df.where("doc_id = 2")).count() == 0


def fewest(lengths, window):
    """The least number of windows, by trying every place for each piece."""
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i]:
                rooms[k] -= lengths[i]
                place(i + 1, rooms)
                rooms[k] += lengths[i]
        place(i + 1, [*rooms, window - lengths[i]])

    place(0, [])
    return best


def test_against_the_fewest_windows_possible():
    r = np.random.default_rng(12)
    over = 0
    for _ in range(60):
        lengths = r.integers(1, 33, r.integers(1, 9))
        p, offset = packing.pack(lengths.astype(np.int64), window=32, grain=4)
        order = np.lexsort((offset, p))
        for k in set(p.tolist()):  # no window is overfull, and no two pieces in it overlap
            own = [i for i in order if p[i] == k]
            assert [int(offset[i]) for i in own] == np.cumsum([0, *lengths[own]])[:-1].tolist() and lengths[own].sum() <= 32
        want = fewest(sorted(lengths.tolist(), reverse=True), 32)
        assert want <= len(set(p.tolist())) <= want + 1
        over += len(set(p.tolist())) > want
    assert over <= 6
