"""Components, communities, their reports and summaries.

Tables: nodes (node_idx, id, type), edges (edge_idx, source, relationship_type, target), members (cluster_id, node_id).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators import blocks as B
from graphloom.sources.session import cut

MIN_SIZE, MAX_CLUSTERS = 2, 12
THEMES = {"influences": "influence", "collaborates_with": "collaboration", "located_at": "spatial", "caused_by": "causal", "works_with": "work"}


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K1: (id, component), the component named by its least id; isolated nodes are their own.

    Alternating large and small stars: the number of rounds grows with the logarithm of the size, each round is two
    shuffles of the remaining edges, and each round's result is checkpointed.
    """
    now = cut(edges.select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        now = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        fresh = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if fresh == state:
            break
        state = fresh
    return nodes.select("id").distinct().join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def type_groups(nodes: DataFrame) -> DataFrame:
    """K2: (type, n, rank), the largest first, then by name; a null or blank type is Unknown."""
    kind = F.when(F.trim(F.coalesce("type", F.lit(""))) == "", "Unknown").otherwise(F.col("type"))
    g = nodes.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.lower("type"))))  # one row a type


def ensure_clusters(nodes: DataFrame, edges: DataFrame, min_size: int = MIN_SIZE, max_clusters: int = MAX_CLUSTERS) -> DataFrame:
    """K3: members (cluster_id, node_id): the largest components, or where there is one only, the types within it."""
    comp = cut(components(nodes, edges))
    top = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(F.lower("id")).alias("first")).where(F.col("n") >= min_size).orderBy(F.desc("n"), "first").limit(max_clusters).collect()  # max_clusters rows
    spark = nodes.sparkSession
    if len(top) >= 2:
        names = spark.createDataFrame([(r["component"], f"cc_{i}") for i, r in enumerate(top, 1)], "component string, cluster_id string")
        return comp.join(F.broadcast(names), "component").select("cluster_id", F.col("id").alias("node_id"))
    inside = comp.where(F.col("component") == top[0]["component"]).select("id") if top else comp.select("id")
    universe = nodes.join(inside, "id", "left_semi").withColumn("type", F.when(F.trim(F.coalesce("type", F.lit(""))) == "", "Unknown").otherwise(F.col("type")))
    groups = type_groups(universe).orderBy("rank").limit(max_clusters).collect()
    kept = [g for g in groups if g["n"] >= min_size] or groups[:1]
    names = spark.createDataFrame([(g["type"], f"type_{i}_{'_'.join(g['type'].lower().split(' '))}") for i, g in enumerate(kept, 1)], "type string, cluster_id string")
    return universe.join(F.broadcast(names), "type").select("cluster_id", F.col("id").alias("node_id"))


def _communities(edges: DataFrame, rounds: int, levels: int, resolution: float, seed: int, weighted: bool, block_links: int) -> tuple[DataFrame, DataFrame, Blocks]:
    """Numbers (id, x), communities (x, c) by number, and the blocks of the graph, which the caller unpersists."""
    edges = edges.where("source <> target")
    turns = [(F.pmod(F.xxhash64("id", F.lit(seed + level)), F.lit(2)) * 2**level) for level in range(levels)]
    ids, n, ends = B.numbered(edges, sum(turns, F.lit(0)).cast("long").alias("turn"))
    first = now = B.Blocks.of(B.links_of(edges, ids), n, max(1, -(-ends // block_links)), weighted)
    parts = first.parts
    state = first.values(ids.select("x", "turn"))

    def begin(blk: int, links: B.Links | None, held: dict) -> pa.Table:
        size = len(links[0]) - 1
        k = np.bincount(B.owner_of(links), np.broadcast_to(links[2], links[1].shape), minlength=size)
        return B.rows([(blk, B.OWN, (B.place(blk, n, parts), k, held[B.OWN][0]))])

    state = cut(first.each(state, begin))  # c: community, k: degree, turn: a bit for each level
    total = first.table(state, "k double", lambda blk, x: {"k": np.array([x[1].sum()])}).agg(F.sum("k")).first()[0] or 0.0  # twice the edges' weight

    def mover(level: int, r: int) -> Callable[..., pa.Table]:
        def move(blk: int, links: B.Links | None, held: dict) -> pa.Table:
            c, s, k, turn = held[B.OWN]
            at, cs, ss, w = np.arange(len(c)), c, s, np.zeros(len(c))
            if links:
                at, cs = np.r_[B.owner_of(links), at], np.r_[B.received(links, held, 0), cs]
                ss, w = np.r_[B.received(links, held, 1), ss], np.r_[np.broadcast_to(links[2], links[1].shape), w]
            order = np.lexsort((cs, at))
            run = B.runs(at[order], cs[order])
            link = B.summed(w[order], run)
            order = order[run]
            at, cs, ss = at[order], cs[order], ss[order]
            own = cs == c[at]
            gain = link - resolution * k[at] * (ss - np.where(own, k[at], 0.0)) / total
            loss = np.round(-gain, 9)
            best = np.flatnonzero(loss == np.minimum.reduceat(loss, B.runs(at))[at])  # of equal ones, the own community, else the least
            to = cs[best[B.runs(at[best])]]
            stays = best[own[best]]
            to[at[stays]] = cs[stays]
            return B.rows([(blk, B.OWN, (np.where((turn >> level & 1) == r % 2, to, c), k, turn))])

        return move

    def between(blk: int, links: B.Links | None, held: dict) -> pa.Table:
        if not links:
            return pa.table({"a": pa.array([], "int64"), "b": pa.array([], "int64"), "w": pa.array([], "float64")})
        a, b = held[B.OWN][0][B.owner_of(links)], B.received(links, held, 0)
        order = np.lexsort((b, a))
        order = order[a[order] != b[order]]
        run = B.runs(a[order], b[order])
        w = B.summed(np.broadcast_to(links[2], links[1].shape)[order], run)
        return pa.table({"a": a[order][run], "b": b[order][run], "w": w})

    def joined(key: tuple, t: pa.Table) -> pa.Table:
        blk, held = key[0].as_py(), B.loaded(t)
        turn = held.pop(B.OWN)[2]
        k = np.zeros(len(turn))
        for at, sums in held.values():
            k[at] = sums
        return B.rows([(blk, B.OWN, (B.place(blk, n, parts), k, turn))])

    label = None
    for level in range(levels):
        for r in range(rounds):
            state = cut(now.each(now.passed(B.with_sums(state, parts), 2), mover(level, r)))
        moved = now.table(state, "x long, c long", lambda blk, x: {"x": B.place(blk, n, parts)[x[1] > 0], "c": x[0][x[1] > 0]})
        label = cut(moved if label is None else label.join(moved.select(F.col("x").alias("c"), F.col("c").alias("__c")), "c", "left").select("x", F.coalesce("__c", "c").alias("c")))
        if level + 1 < levels:
            links = cut(now.each(now.passed(state, 1), between, "a long, b long, w double"))
            state = cut(state.unionByName(B.sums(state, parts)).groupBy("blk").applyInArrow(joined, B.ROWS))
            now, last = B.Blocks.of(links, n, parts), now
            if last is not first:
                last.rows.unpersist()
    if now is not first:
        now.rows.unpersist()
    return ids, label, first


def _named(ids: DataFrame, label: DataFrame) -> DataFrame:
    """(node_id, community) of (x, c)."""
    key = ids.select("id", "x")
    return label.join(key.select(F.col("id").alias("node_id"), "x"), "x").join(key.select(F.col("id").alias("community"), F.col("x").alias("c")), "c").select("node_id", "community")


def louvain(edges: DataFrame, rounds: int = 4, levels: int = 2, resolution: float = 1.0, seed: int = 42, weighted: bool = True, block_links: int = B.BLOCK_LINKS) -> DataFrame:
    """K4: (node_id, community) by local moves for modularity, level by level, over blocks of arrays.

    In each round about half the nodes (by a hash with the seed) may move to the neighbouring community of most gain, so
    two neighbours seldom swap; then communities become the nodes of the next level. Ties go to the least community id.
    """
    ids, label, blocks = _communities(edges, rounds, levels, resolution, seed, weighted, block_links)
    blocks.rows.unpersist()
    return _named(ids, label)


def leiden(edges: DataFrame, rounds: int = 4, levels: int = 2, resolution: float = 1.0, seed: int = 42, block_links: int = B.BLOCK_LINKS) -> DataFrame:
    """K5: every edge weighs 1; communities that fall apart are split into their connected parts."""
    ids, label, blocks = _communities(edges, rounds, levels, resolution, seed, False, block_links)

    def inside(blk: int, links: B.Links | None, held: dict) -> pa.Table:
        c, x = held[B.OWN]
        at = B.owner_of(links)
        keep = (c[at] == B.received(links, held, 0)) & (x[at] > B.received(links, held, 1))
        return pa.table({"source": x[at][keep], "target": B.received(links, held, 1)[keep]})

    state = blocks.values(label.select("x", "c", F.col("x").alias("own")))
    parts = cut(components(label.select(F.col("x").alias("id")), blocks.each(blocks.passed(state, 2), inside, "source long, target long")).select(F.col("id").alias("x"), F.col("component").alias("c")))
    blocks.rows.unpersist()
    return _named(ids, parts)


def spectral(nodes: DataFrame, edges: DataFrame, k: int = 5, rounds: int = 20, seed: int = 0, block_links: int = B.BLOCK_LINKS) -> DataFrame:
    """K6: power iteration clustering, which scales as spectral clustering doesn't; Spark's own steps, over blocks of arrays. nodes: id.

    The start is a normal number by the hash of each id. Spark's would depend on the tables' partitions.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    edges = edges.where("source <> target")
    uniform = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(2**52)) + 0.5) / 2.0**52
    ids, n, ends = B.numbered(edges, (F.sqrt(-2 * F.log(uniform(2 * seed))) * F.cos(2 * np.pi * uniform(2 * seed + 1))).alias("v"))
    known = ids.join(nodes.select("id"), "id", "left_semi")
    blocks = B.Blocks.of(B.links_of(edges, known), n, max(1, -(-ends // block_links)))
    parts = blocks.parts

    def begin(blk: int, links: B.Links | None, held: dict) -> pa.Table:
        v = held[B.OWN][0]
        linked = np.diff(links[0]) > 0 if links else np.zeros(len(v), bool)
        return B.rows([(blk, B.OWN, (np.where(linked, v, 0.0), np.zeros(len(v)), linked))])

    def step(norm: float) -> Callable[..., pa.Table]:
        def multiply(blk: int, links: B.Links | None, held: dict) -> pa.Table:
            v, _, linked = held[B.OWN]
            new = np.zeros(len(v))
            if links:
                at, w = B.owner_of(links), np.broadcast_to(links[2], links[1].shape)
                degree = np.bincount(at, w, minlength=len(v))
                new = np.bincount(at, w * (B.received(links, held, 0) / norm), minlength=len(v)) / np.where(linked, degree, 1.0)
            return B.rows([(blk, B.OWN, (new, v / norm, linked))])

        return multiply

    def total(state: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> float:
        return blocks.table(state, "s double", lambda blk, x: {"s": np.array([np.abs(of(x[0], x[1])).sum()])}).agg(F.sum("s")).first()[0] or 0.0

    state = cut(blocks.each(blocks.values(ids.select("x", "v")), begin))
    norm, before = total(state, lambda v, old: v) or 1.0, float("inf")
    for _ in range(rounds):
        state = cut(blocks.each(blocks.passed(state, 1), step(norm)))
        norm = total(state, lambda v, old: v) or 1.0
        delta = total(state, lambda v, old, by=norm: v / by - old)
        if abs(delta - before) <= max(1e-5 / max(n, 1), 1e-8):
            break
        before = delta
    blocks.rows.unpersist()
    points = cut(blocks.table(state, "x long, v double", lambda blk, x: {"x": B.place(blk, n, parts)[x[2]], "v": x[0][x[2]] / norm})).withColumn("features", array_to_vector(F.array("v")))
    if points.isEmpty():
        return ids.select(F.col("id").alias("node_id"), F.lit(0).alias("community")).limit(0)
    found = KMeans(k=k, seed=seed, predictionCol="community").fit(points).transform(points)
    return found.join(ids, "x").select(F.col("id").alias("node_id"), "community")


def create_clustering(name: str) -> Callable[..., DataFrame]:
    """K10"""
    known = {"louvain": louvain, "leiden": leiden, "spectral": spectral}
    if name not in known:
        raise ValueError(f"unknown algorithm {name}")
    return known[name]


def internal_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """K7: edges with both ends in one cluster, with its cluster_id."""
    a = members.select("cluster_id", F.col("node_id").alias("source"))
    return edges.join(a, "source").join(members.withColumnRenamed("node_id", "target"), ["cluster_id", "target"])


def cluster_metadata(edges: DataFrame, members: DataFrame, inner: DataFrame | None = None) -> DataFrame:
    """K8: (cluster_id, node_count, edge_count, modularity): counts, and the cluster's part of the modularity of unit edges."""
    inner = internal_edges(edges, members) if inner is None else inner
    n = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("node_count"))
    e = inner.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("edge_count"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    d = members.join(ends, "node_id").groupBy("cluster_id").agg(F.sum("degree").alias("degree"))
    m = edges.agg(F.count(F.lit(1)).alias("m"))
    j = n.join(e, "cluster_id", "left").join(d, "cluster_id", "left").crossJoin(F.broadcast(m)).withColumns({"edge_count": F.coalesce("edge_count", F.lit(0)), "degree": F.coalesce("degree", F.lit(0))})
    share = F.col("degree") / (2 * F.col("m"))
    return j.select("cluster_id", "node_count", "edge_count", (F.col("edge_count") / F.col("m") - share * share).alias("modularity"))


def _top(df: DataFrame, by: str, first: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(by), first))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def top_actors(edges: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """(cluster_id, node_id, connections, rank) over all edges that touch a member; ties by first appearance."""
    ends = edges.select(F.posexplode(F.array("source", "target")).alias("side", "node_id"), "edge_idx")
    deg = ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("connections"), F.min(F.col("edge_idx") * 2 + F.col("side")).alias("first"))
    return _top(members.join(deg, "node_id"), "connections", "first", k).select("cluster_id", "node_id", "connections", "rank")


def top_relationships(inner: DataFrame, k: int = 10) -> DataFrame:
    """(cluster_id, relationship_type, n, rank) over internal edges; ties by first appearance."""
    g = inner.groupBy("cluster_id", "relationship_type").agg(F.count(F.lit(1)).alias("n"), F.min("edge_idx").alias("first"))
    return _top(g, "n", "first", k).select("cluster_id", "relationship_type", "n", "rank")


def dominant_types(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, dominant_type): the most frequent, ties by the least node_idx; a null type is Unknown."""
    t = members.join(nodes.select(F.col("id").alias("node_id"), "type", "node_idx"), "node_id").groupBy("cluster_id", F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count(F.lit(1)).alias("n"), F.min("node_idx").alias("first"))
    return t.groupBy("cluster_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "type"))["type"].alias("dominant_type"))


def themes(dominant_type: Column, dominant_rel: Column, density: Column, k: int = 5) -> Column:
    """K16"""
    named = F.when(dominant_rel.isNull(), None)
    for rel, word in THEMES.items():
        named = named.when(dominant_rel == rel, f"{word} networks")
    named = named.otherwise(F.concat(dominant_rel, F.lit(" networks")))
    kind = F.when(dominant_type != "Unknown", F.concat(dominant_type, F.lit("-centric")))
    return F.slice(F.array_compact(F.array(kind, named, F.when(density > 0.5, "highly connected").when(density < 0.2, "loosely connected"))), 1, k)


def reports(nodes: DataFrame, edges: DataFrame, members: DataFrame, actors: bool = True) -> DataFrame:
    """(cluster_id, node_count, edge_count, density, summary, themes, top_actors, top_relationships) of each cluster.

    Internal edges are found once, for counts and relationships. Without `actors` degrees aren't counted, and top_actors is null.
    """
    kinds = internal_edges(edges, members).groupBy("cluster_id", "relationship_type").agg(F.count(F.lit(1)).alias("n"), F.min("edge_idx").alias("first"))
    kinds = kinds.withColumn("edge_count", F.sum("n").over(Window.partitionBy("cluster_id")))
    n = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("node_count"))
    gather = lambda df, *cols: df.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", *cols))), lambda x: F.struct(*(x[c].alias(c) for c in cols))).alias("__x"), *([F.max("edge_count").alias("edge_count")] if "edge_count" in df.columns else []))
    rels = gather(_top(kinds, "n", "first", 10), "relationship_type", "n").withColumnRenamed("__x", "top_relationships")
    j = n.join(dominant_types(nodes, members), "cluster_id", "left").join(rels, "cluster_id", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))
    if actors:
        j = j.join(gather(top_actors(edges, members), "node_id", "connections").withColumnRenamed("__x", "top_actors"), "cluster_id", "left")
    else:
        j = j.withColumn("top_actors", F.lit(None).cast("array<struct<node_id:string,connections:bigint>>"))
    pairs = F.col("node_count") * (F.col("node_count") - 1)
    j = j.withColumn("density", F.when(F.col("node_count") < 2, 0.0).otherwise(F.col("edge_count") / pairs)).withColumn("rel", F.get("top_relationships", F.lit(0))["relationship_type"])
    kind = F.coalesce("dominant_type", F.lit("entities"))
    text = F.concat_ws(
        " ", F.format_string("Cluster %s contains %d entities", "cluster_id", "node_count"), F.concat(F.lit("primarily of type '"), kind, F.lit("'")), F.format_string("with %d internal relationships.", "edge_count"),
        F.when(F.col("rel").isNotNull(), F.concat(F.lit("The most common relationship type is '"), "rel", F.lit("'."))),
    )
    return j.select("cluster_id", "node_count", "edge_count", "density", text.alias("summary"), themes(F.col("dominant_type"), F.col("rel"), F.col("density")).alias("themes"), "top_actors", "top_relationships")


def report_text(report: dict) -> str:
    """One report as plain text."""
    lines = [f"Community {report['cluster_id']}", report["summary"], "Actors:", *(f"  {a['node_id']} ({a['connections']})" for a in report["top_actors"] or []), "Relationships:", *(f"  {r['relationship_type']} ({r['n']})" for r in report["top_relationships"] or []), "Themes: " + ", ".join(report["themes"])]
    return "\n".join(lines)


def summaries(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, name, description, key_entities, key_relations, node_count, edge_count, density) by template."""
    inner = internal_edges(edges, members)
    m = members.join(nodes.select(F.col("id").alias("node_id"), "node_idx"), "node_id")
    first = m.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("node_idx"))).where("rank <= 10").groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("key_entities"))
    rel = inner.groupBy("cluster_id", "source", "relationship_type", "target").agg(F.count(F.lit(1)).alias("frequency"), F.min("edge_idx").alias("first"))
    rel = _top(rel, "frequency", "first", 5).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "relationship_type", "target", "frequency"))).alias("key_relations"))
    n = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("node_count"))
    e = inner.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("edge_count"))
    j = n.join(e, "cluster_id", "left").join(first, "cluster_id", "left").join(rel, "cluster_id", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))
    text = F.concat(F.format_string("This cluster contains %d entities and %d relationships. Key entities include: ", "node_count", "edge_count"), F.array_join(F.slice("key_entities", 1, 5), ", "), F.lit("."))
    density = F.when(F.col("node_count") <= 1, 0.0).otherwise(2 * F.col("edge_count") / (F.col("node_count") * (F.col("node_count") - 1)))
    return j.select("cluster_id", F.concat(F.get("key_entities", F.lit(0)), F.lit("_Community")).alias("name"), text.alias("description"), "key_entities", "key_relations", "node_count", "edge_count", density.alias("density"))
