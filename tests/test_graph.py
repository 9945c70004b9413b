import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import clusters as K
from graphloom.operators import exports as E
from graphloom.operators import graph as G
from graphloom.operators import retrieval as R

EDGE = "edge_idx long, source string, relationship_type string, target string"
NODE = "node_idx long, id string, type string"


def graph(spark, pairs, n=None):
    ids = sorted({x for p in pairs for x in p} | {f"n{i}" for i in range(n or 0)})
    return spark.createDataFrame([(i, x, None) for i, x in enumerate(ids)], NODE), spark.createDataFrame([(i, a, "r", b) for i, (a, b) in enumerate(pairs)], EDGE)


def test_first_and_last_wins(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), ("b", 2, "z")], "id string, o int, v string")
    assert rows(G.first_wins(df, ["id"], "o"), "id", "v") == [("a", "x"), ("b", None)]
    assert rows(G.last_wins(df, ["id"], "o"), "id", "v") == [("a", "y"), ("b", "z")]


def test_build(spark, rows):
    t = spark.createDataFrame([(0, "a", "r", "b"), (1, "a", "r", "a"), (2, "b", "q", "a")], EDGE)
    rel = spark.createDataFrame([(0, "r", "old", None), (1, "r", "describes", "detail")], "idx int, name string, description string, detail string")
    assert rows(G.build(t, rel), "edge_idx", "relationship_detail") == [(0, "detail"), (2, "b q a")]


def test_hub_split_and_back(spark, rows):
    pairs = [("h", f"x{i}") for i in range(3)] + [("g", "h"), ("g", "y1"), ("g", "y2"), ("h", "x0")]
    e = spark.createDataFrame([(a, b, "r", f"{a} r {b}") for a, b in pairs], "source string, target string, relationship_type string, relationship_detail string")
    split = G.hub_split(e, 3)
    got = rows(split, "source", "target", "kind")
    assert ("hubproxy::g::r", "h", "hub_split_edge") in got  # between two hubs the source's proxy is taken
    assert ("g", "hubproxy::g::r", "hub_proxy_connector") in got and ("h", "hubproxy::h::r", "hub_proxy_connector") in got
    assert rows(G.flatten_proxies(split), "source", "target") == sorted(set(pairs), key=repr)
    assert all(k == "plain" for *_, k in rows(G.hub_split(e, 50), "source", "target", "kind"))
    with pytest.raises(ValueError):
        G.hub_split(e, 2)


def test_dominance(spark):
    e = spark.createDataFrame([(i, "h", "r", f"x{i}") for i in range(4)], EDGE)
    r = G.hub_dominance(e).first()
    assert (r["edges"], r["top"], r["dominated"]) == (4, 4, True)


def queue_bfs(ids, edges, seeds, max_hops):
    seen = {s: 0 for s in dict.fromkeys(seeds) if s in ids}
    queue, tree = list(seen), []
    while queue:
        n = queue.pop(0)
        if seen[n] > max_hops:
            continue
        for i, (a, b) in enumerate(edges):
            if n in (a, b):
                o = b if a == n else a
                if o not in seen:
                    seen[o] = seen[n] + 1
                    tree.append(i)
                    queue.append(o)
    return [(n, h) for n, h in seen.items() if h <= max_hops], sorted(tree)


def test_traversal_is_a_queue(spark):
    r = random.Random(1)
    for _ in range(4):
        pairs = [(f"n{r.randrange(9)}", f"n{r.randrange(9)}") for _ in range(12)]
        pairs = [p for p in pairs if p[0] != p[1]]
        n, e = graph(spark, pairs, 9)
        want, tree = queue_bfs({f"n{i}" for i in range(9)}, pairs, ["n3", "n1", "n3", "zz"], 2)
        found, picked = R.traverse(n, e, ["n3", "n1", "n3", "zz"], 2)
        assert [(x["id"], x["hop"]) for x in found.orderBy("hop", "rank").collect()] == want
        assert sorted(x["edge_idx"] for x in picked.collect()) == tree
        assert [x["id"] for x in R.bfs(n, e, ["n3", "n1"], 2, 4).orderBy("position").collect()] == [i for i, _ in want][:4]
    assert R.traverse(n, e, ["zz"], 2)[0].count() == 0 and R.traverse(n, e, ["zz"], 2)[1].count() == 0


def test_dfs(spark):
    n, e = graph(spark, [("a", "b"), ("b", "c"), ("a", "d"), ("d", "e")])
    assert [(x["id"], x["depth"]) for x in R.dfs(n, e, ["a"], max_depth=2).orderBy("position").collect()] == [("a", 0), ("b", 1), ("c", 2), ("d", 1), ("e", 2)]
    near = {"a": ["b", "d"], "b": ["a", "c"], "d": ["a", "e"], "c": ["b"], "e": ["d"]}
    assert R.dfs_order(["a"], near, {"a": 1.0, "b": 0.1, "d": 0.9}, 2, 0.3, 50) == [("a", 0), ("d", 1)]  # b is unlike, e has no vector
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("d", [1.0, 0.1])], "id string, embedding array<double>")
    assert [x["id"] for x in R.dfs(n, e, ["a"], v, [1.0, 0.0], 2).orderBy("position").collect()] == ["a", "d"]


def test_components(spark):
    r = random.Random(2)
    pairs = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(25)] + [(f"p{i}", f"p{i + 1}") for i in range(30)]
    n, e = graph(spark, pairs, 40)
    root = {x["id"]: x["id"] for x in n.collect()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {x["id"]: x["component"] for x in K.components(n, e).collect()} == {x: find(x) for x in root}
    assert K.components(n.limit(0), e.limit(0)).count() == 0


def test_ensure_clusters(spark, rows):
    n, e = graph(spark, [("a", "b"), ("c", "d"), ("d", "e")], 1)
    assert rows(K.ensure_clusters(n, e)) == [("cc_1", "c"), ("cc_1", "d"), ("cc_1", "e"), ("cc_2", "a"), ("cc_2", "b")]
    n = spark.createDataFrame([(0, "a", "X"), (1, "b", "X"), (2, "c", None), (3, "z", "Y")], NODE)
    e = spark.createDataFrame([(0, "a", "r", "b"), (1, "b", "r", "c")], EDGE)
    assert rows(K.ensure_clusters(n, e)) == [("type_1_x", "a"), ("type_1_x", "b")]
    assert rows(K.ensure_clusters(n, e.limit(0), min_size=5)) == [("type_1_x", "a"), ("type_1_x", "b")]


def modularity(pairs, part):
    m, deg, inner = len(pairs), {}, 0
    for a, b in pairs:
        deg[a], deg[b] = deg.get(a, 0) + 1, deg.get(b, 0) + 1
        inner += part[a] == part[b]
    total = {}
    for n, d in deg.items():
        total[part[n]] = total.get(part[n], 0) + d
    return inner / m - sum((d / (2 * m)) ** 2 for d in total.values())


def test_communities(spark):
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "abc" for i in range(6) for j in range(i)] + [("a0", "b0"), ("b1", "c1")]
    n, e = graph(spark, pairs)
    for name in ("louvain", "leiden"):
        part = {x["node_id"]: x["community"] for x in K.create_clustering(name)(e).collect()}
        assert set(part) == {x for p in pairs for x in p}
        assert modularity(pairs, part) > 0.5
    part = {x["node_id"]: x["community"] for x in K.spectral(n, e, k=3).collect()}
    assert len(part) == 18 and len(set(part.values())) <= 3
    with pytest.raises(ValueError):
        K.create_clustering("magic")


def test_communities_do_not_depend_on_blocks(spark):
    """Each block sends its nodes' values on, once a block; many small blocks give what one gives."""
    r = random.Random(5)
    pairs = sorted({(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(150)} | {("hub", f"n{i}") for i in range(40)})
    n, e = graph(spark, pairs)
    rows = lambda df: {x["node_id"]: x["community"] for x in df.collect()}
    one = rows(K.louvain(e))
    assert rows(K.louvain(e, block_links=100)) == one and set(one) == {x for p in pairs if p[0] != p[1] for x in p}
    assert K.louvain(e.limit(0)).count() == 0


def test_spectral_in_blocks(spark):
    """Two groups without an edge between them; an end that is no node has no row."""
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "ab" for i in range(6) for j in range(i)] + [("a0", "lost")]
    n, e = graph(spark, pairs)
    part = {x["node_id"]: x["community"] for x in K.spectral(n.where("id <> 'lost'"), e, k=2, rounds=6, block_links=20).collect()}
    assert set(part) == {f"{c}{i}" for c in "ab" for i in range(6)} and len(set(part.values())) <= 2


def test_report_arithmetic(spark):
    n = spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate([("a", "P"), ("b", None), ("c", "P"), ("x", "Q")])], NODE)
    e = spark.createDataFrame([(0, "a", "influences", "b"), (1, "c", "owns", "a"), (2, "x", "owns", "a")], EDGE)
    m = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "c"), ("lone", "x")], "cluster_id string, node_id string")
    got = {r["cluster_id"]: r.asDict(recursive=True) for r in K.reports(n, e, m).collect()}
    k = got["k"]
    assert (k["node_count"], k["edge_count"], round(k["density"], 4)) == (3, 2, 0.3333)
    assert k["themes"] == ["P-centric", "influence networks"]
    assert k["top_actors"][0] == {"node_id": "a", "connections": 3}
    assert [x["node_id"] for x in k["top_actors"]] == ["a", "b", "c"]
    assert k["summary"].endswith("The most common relationship type is 'influences'.")
    assert got["lone"]["themes"] == ["Q-centric", "loosely connected"] and got["lone"]["top_relationships"] is None
    assert "a (3)" in K.report_text(k)
    few = {r["cluster_id"]: r.asDict(recursive=True) for r in K.reports(n, e, m, actors=False).collect()}  # the same without degrees
    assert few == {c: x | {"top_actors": None} for c, x in got.items()}
    s = {r["cluster_id"]: r for r in K.summaries(n, e, m).collect()}
    assert s["k"]["name"] == "a_Community" and round(s["k"]["density"], 4) == 0.6667 and s["lone"]["density"] == 0.0


def test_exports(spark, rows):
    n, e = graph(spark, [("a", "b"), ("b", "c")], 1)
    m = spark.createDataFrame([("k2", "a"), ("k1", "a")], "cluster_id string, node_id string")
    full = e.withColumn("relationship_detail", e["source"])
    assert rows(E.d3_nodes(n, e, m), "position", "id", "group") == [(0, "a", "k1"), (1, "b", "0"), (2, "c", "0")]
    assert rows(E.d3_links(E.d3_nodes(n, e, m), e), "source", "target") == [(0, 1), (1, 2)]
    assert [r["line"] for r in E.mermaid_lines(n, full).orderBy("part", "idx").collect()][0] == "graph TD"
    assert {r["id"] for r in E.cytoscape_nodes(n, e, m).collect()} == {"a", "b", "c"}
    assert E.json_rows(n, full, m).count() == 4 + 2 + 2


def test_keys_that_do_not_fit_are_an_error(spark, tmp_path):
    from pyspark.errors import PySparkException

    from graphloom.sources import tables

    d = "/root/testdata/sf0.001"
    for t in ("customer", "supplier", "nation", "lineitem"):
        rows = spark.read.parquet(f"{d}/{t}.parquet")
        rows = rows.withColumn("l_partkey", F.col("l_partkey") + 10**9) if t == "lineitem" else rows
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    e = tables.edges(spark, str(tmp_path))
    with pytest.raises(PySparkException, match="do not fit"):
        e.agg(F.max("edge_idx")).collect()
    places = e.where("relationship_type = 'located_in'")
    assert places.agg(F.max("edge_idx")).first()[0] > 0 and "lineitem" not in places._jdf.queryExecution().optimizedPlan().toString()
