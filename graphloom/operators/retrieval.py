"""Deterministic graph queries, traversal, vector and hybrid retrieval, provenance."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import cosine, normalize_query
from graphloom.operators.graph import degrees
from graphloom.operators.vectors import knn
from graphloom.sources.session import cut

STOPWORDS = frozenset("a about an and are at did do does for how in is of on or that the to was were what when where which who why with".split())
GRAM = 4


# Names in texts


def containing(texts: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """(key, name): names that occur in a text as substrings, regardless of case. texts: key, text; names: name.

    Texts and names meet by an equi-join on a name's first four characters, then the whole name is looked for, so no
    text is compared with every name; names under four characters are few and join by their own length's grams.
    """
    n = names.select("name", F.lower("name").alias("low")).where("length(name) > 0").distinct().withColumn("size", F.least(F.length("low"), F.lit(GRAM)))
    n = n.withColumn("gram", F.left("low", F.col("size")))
    sizes = F.broadcast(n.select("size").distinct())  # at most four rows
    low = texts.select(key, F.lower("text").alias("t")).where("length(t) > 0").crossJoin(sizes)
    grams = low.where("length(t) >= size").select(key, "t", "size", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - F.col("size") + 1), lambda i: F.substring(F.col("t"), i, F.col("size"))))).alias("gram"))
    hit = grams.drop("t").join(n, ["size", "gram"]).select(key, "name", "low").distinct()
    return hit.join(texts.select(key, F.lower("text").alias("t")), key).where(F.contains("t", "low")).select(key, "name").distinct()


def text_context(texts: DataFrame, entities: DataFrame, edges: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """R2: entities (id) named in any of the texts, and the distinct edges (source, relation, target) that touch them."""
    found = containing(texts, entities.select(F.col("id").alias("name")), key).select(F.col("name").alias("id")).distinct()
    touched = edges.join(found.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(edges.join(found.withColumnRenamed("id", "target"), "target", "left_semi"))
    return found, touched.select("source", "relation", "target").distinct()


# Deterministic queries


@dataclass(frozen=True)
class Query:
    """A query's normal form, its tokens and the relation that it names."""

    norm: str
    tokens: tuple[str, ...]
    relation: str | None

    @classmethod
    def parse(cls, query: str | None) -> Query:
        raw = (query or "").strip()
        norm = " ".join(raw.lower().split())
        words = norm.translate(str.maketrans("(),", "   ")).split()
        return cls(norm, tuple(w for w in dict.fromkeys(words) if w not in STOPWORDS and len(w) > 1), cls._relation(raw))

    @staticmethod
    def _relation(raw: str) -> str | None:
        first = re.search(r"\(([^)]*)", raw)
        if first and ")" in raw:
            word = first[1].strip()
            if 0 < len(word) <= 64 and " " not in word:
                return word
        low = raw.lower()
        for sep in (":", "="):
            for key in ("relation", "rel"):
                if key + sep in low:
                    after = low.partition(key + sep)[2].split()
                    name = after[0].strip(",.;") if after else ""
                    if name:
                        return name
        return None


def entity_scores(nodes: DataFrame, query: Query) -> DataFrame:
    """(id, node_idx, score), scores over 0 only."""
    return nodes.select("id", "node_idx", entity_score(normalize_query(F.col("id")), query).alias("score")).where("score > 0")


def entity_score(e: Column, query: Query) -> Column:
    """The score of an id in normal form."""
    shared = F.size(F.array_intersect(F.split(e, " "), F.array(*map(F.lit, query.tokens)))) if query.tokens else F.lit(0)
    part = F.when(e.contains(query.norm), 3.0).otherwise(0.0) if query.norm else F.lit(0.0)
    return F.when(e == "", 0.0).when(e == query.norm, 5.0).otherwise(part + F.when(shared > 0, 1.0 + 0.4 * shared).otherwise(0.0))


def best_seeds(nodes: DataFrame, edges: DataFrame, queries: list[Query], k: int = 10) -> list[list[str]]:
    """For each query the k best ids, or where none matches those of highest degree. One pass over the nodes for all
    queries, one over the edges if any has no match; k ids a query reach the driver."""
    k = max(1, k)
    e = normalize_query(F.col("id"))
    found = F.filter(F.array(*(F.struct(F.lit(i).alias("query"), entity_score(e, q).alias("score")) for i, q in enumerate(queries))), lambda x: x["score"] > 0)
    hits = nodes.select("id", F.explode(found).alias("x")).select("id", "x.*")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.lower("id"), "id"))  # cut to k before the shuffle
    out: list[list[str]] = [[] for _ in queries]
    for r in hits.withColumn("rank", rank).where(F.col("rank") <= k).orderBy("query", "rank").collect():
        out[r["query"]].append(r["id"])
    if not all(out):
        d = nodes.select("id").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        top = [r["id"] for r in d.orderBy(F.desc("degree"), F.lower("id"), "id").limit(k).collect()]
        out = [x or top for x in out]
    return out


def seeds_for(nodes: DataFrame, edges: DataFrame, query: Query, k: int = 10) -> DataFrame:
    """(id, rank) of the seeds of one query."""
    got = best_seeds(nodes, edges, [query], k)[0]
    return nodes.sparkSession.createDataFrame([(x, i) for i, x in enumerate(got)], "id string, rank int")


@dataclass
class QueryResult:
    seeds: DataFrame  # id, rank
    edges: DataFrame  # the matched edges
    entities: DataFrame  # id
    answer: str


def execute_queries(nodes: DataFrame, edges: DataFrame, texts: list[str], k_entities: int = 10, k_edges: int = 40, touching: Callable[[list[str]], DataFrame] | None = None) -> list[QueryResult]:
    """For each text its seeds, the first k_edges edges that touch them (of the relation named, if any), and all ids met.

    touching gives the edges at some ids where a source can do that by its keys, so that the scan is pruned (see
    `sources.tables.edges_at`); otherwise the edges are filtered. All texts share one pass.
    """
    spark = nodes.sparkSession
    queries = [Query.parse(t) for t in texts]
    ids = best_seeds(nodes, edges, queries, k_entities)
    every = sorted({x for some in ids for x in some})
    near = touching(every) if touching else edges.where(F.col("source").isin(*every) | F.col("target").isin(*every))

    def meets(i: int, q: Query) -> Column:
        hit = F.col("source").isin(*ids[i]) | F.col("target").isin(*ids[i])
        return hit & (normalize_query(F.col("relationship_type")) == " ".join(q.relation.lower().split())) if q.relation else hit

    tagged = near.withColumn("__query", F.explode(F.array_compact(F.array(*(F.when(meets(i, q), i) for i, q in enumerate(queries))))))
    rank = F.row_number().over(Window.partitionBy("__query").orderBy("edge_idx"))
    found = cut(tagged.withColumn("__rank", rank).where(F.col("__rank") <= k_edges))
    counts = dict(found.groupBy("__query").count().collect())  # one row a query
    out = []
    for i, q in enumerate(queries):
        own = found.where(F.col("__query") == i).select(*edges.columns)
        seeds = spark.createDataFrame([(x, r) for r, x in enumerate(ids[i])], "id string, rank int")
        met = seeds.select("id").unionByName(own.select(F.explode(F.array("source", "target")).alias("id"))).distinct()
        n = counts.get(i, 0)
        out.append(QueryResult(seeds, own, met, f"The relation '{q.relation}' restricts the result: {len(ids[i])} seed entities, {n} related edges." if q.relation else f"{len(ids[i])} relevant entities, {n} related edges."))
    return out


def execute_query(nodes: DataFrame, edges: DataFrame, text: str, k_entities: int = 10, k_edges: int = 40, touching: Callable[[list[str]], DataFrame] | None = None) -> QueryResult:
    """N1 for one text."""
    return execute_queries(nodes, edges, [text], k_entities, k_edges, touching)[0]


# Traversal


def _seed_table(nodes: DataFrame, seeds: list[str]) -> DataFrame:
    """(query, id, rank) of the seeds of one query that are in the graph; as many rows as seeds."""
    given = nodes.sparkSession.createDataFrame([(0, x, i) for i, x in enumerate(dict.fromkeys(seeds))], "query long, id string, rank long")
    return nodes.select("id").join(F.broadcast(given), "id").select("query", "id", "rank")


def traverse_each(edges: DataFrame, seeds: DataFrame, max_hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """R9 for any number of queries. seeds: query, id, rank. Nodes (query, id, hop, rank) up to max_hops, and the trees' edges
    (query and the columns of edges), which lead one hop further.

    One join a level. A node's rank is its path: its seed's place and the indexes of the edges that lead to it. Paths of a
    level are equally long, and their order is that of a queue, so a new node keeps its least path and nothing is sorted
    or numbered, whatever a level's size. Edges are made once; a small front is broadcast to them by the optimiser.
    """
    edges = cut(edges)
    front = cut(seeds.select("query", "id", F.array("rank").alias("rank"), F.lit(0).alias("hop")))
    seen, tree = front, None
    ends = edges.select("edge_idx", F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")))).alias("e")).select("edge_idx", "e.*")
    for hop in range(max_hops + 1):
        met = ends.join(front.select("query", "id", "rank"), "id").select("query", "other", F.concat("rank", F.array("edge_idx")).alias("rank"))
        met = met.groupBy("query", F.col("other").alias("id")).agg(F.min("rank").alias("rank"))
        front = cut(met.join(seen.select("query", "id"), ["query", "id"], "left_anti").withColumn("hop", F.lit(hop + 1)))
        if front.isEmpty():
            break
        led = front.select("query", F.element_at("rank", -1).alias("edge_idx"))
        tree = led if tree is None else tree.unionByName(led)
        seen = seen.unionByName(front.select(*seen.columns))
    columns = ["query", *edges.columns]
    picked = edges.join(tree.distinct(), "edge_idx").select(*columns) if tree is not None else edges.limit(0).withColumn("query", F.lit(0).cast("long")).select(*columns)
    return seen.where(F.col("hop") <= max_hops), picked


def traverse(nodes: DataFrame, edges: DataFrame, seeds: list[str], max_hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, hop, rank) up to max_hops, and the tree's edges, which lead one hop further."""
    found, tree = traverse_each(edges, _seed_table(nodes, seeds), max_hops)
    return found.drop("query"), tree.drop("query")


def bfs_each(edges: DataFrame, seeds: DataFrame, max_hops: int = 2, max_nodes: int = 50) -> DataFrame:
    """(query, id, hop, position): the first max_nodes nodes of each query in order of discovery."""
    found, _ = traverse_each(edges, seeds, max_hops)
    place = F.row_number().over(Window.partitionBy("query").orderBy("hop", "rank", "id"))  # cut to max_nodes before the shuffle
    return found.withColumn("position", place).where(F.col("position") <= max_nodes).select("query", "id", "hop", (F.col("position") - 1).alias("position"))


def bfs(nodes: DataFrame, edges: DataFrame, seeds: list[str], max_hops: int = 2, max_nodes: int = 50) -> DataFrame:
    """(id, hop, position): the first max_nodes nodes in order of discovery."""
    return bfs_each(edges, _seed_table(nodes, seeds), max_hops, max_nodes).drop("query")


def weighted_each(edges: DataFrame, vectors: DataFrame, queries: DataFrame, seeds: DataFrame, max_hops: int = 2, k: int = 10, max_nodes: int = 50) -> DataFrame:
    """(query, id, hop, score, rank): 0.7 of the cosine (0.5 without embedding) and 0.3 of 1 / (1 + hop), the k best of
    each query. vectors: id, embedding; queries: query, vector; seeds: query, id, rank."""
    found = bfs_each(edges, seeds, max_hops, max_nodes)  # max_nodes rows a query
    sim = F.coalesce(cosine(F.col("embedding"), F.col("vector")), F.lit(0.5))
    scored = found.join(vectors.select("id", "embedding"), "id", "left").join(queries.select("query", "vector"), "query")
    scored = scored.select("query", "id", "hop", "position", F.round(0.7 * sim + 0.3 / (1 + F.col("hop")), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "position"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).drop("position")


def weighted(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, seeds: list[str], query: list[float], max_hops: int = 2, k: int = 10, max_nodes: int = 50) -> DataFrame:
    """R6 for one query: (id, hop, score)."""
    one = nodes.sparkSession.createDataFrame([(0, query)], "query long, vector array<double>")
    return weighted_each(edges, vectors, one, _seed_table(nodes, seeds), max_hops, k, max_nodes).orderBy("rank").select("id", "hop", "score")


def dfs_order(start: list[str], near: dict[str, list[str]], sim: dict[str, float] | None, max_depth: int, threshold: float, max_nodes: int) -> list[tuple[str, int]]:
    """R5 on a subgraph: preorder, best neighbours first; without a query vector (sim None) nothing is pruned."""
    out, seen = [], set()
    stack = [(s, 0) for s in reversed(start)]
    while stack and len(out) < max_nodes:
        node, depth = stack.pop()
        if node in seen or depth > max_depth:
            continue
        seen.add(node)
        if sim is not None and depth > 0 and (sim[node] < threshold if node in sim else depth > 1):
            continue
        out.append((node, depth))
        nxt = [x for x in near.get(node, []) if x not in seen]
        if sim is not None:
            nxt.sort(key=lambda x: -sim.get(x, 0.0))
        stack.extend((x, depth + 1) for x in reversed(nxt))
    return out


def dfs(nodes: DataFrame, edges: DataFrame, seeds: list[str], vectors: DataFrame | None = None, query: list[float] | None = None, max_depth: int = 2, threshold: float = 0.3, max_nodes: int = 50) -> DataFrame:
    """(id, depth, position). Nodes within max_depth are found by level joins; only that part is walked, in one task."""
    found, _ = traverse(nodes, edges, seeds, max_depth)
    ids = found.select("id")
    part = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    sims = None
    if vectors is not None and query is not None:
        sims = vectors.join(ids, "id", "left_semi").select("id", cosine(F.col("embedding"), F.array(*map(F.lit, query))).alias("sim"))
    rows = part.select(F.lit(0).alias("kind"), "edge_idx", F.col("source").alias("a"), F.col("target").alias("b"), F.lit(None).cast("double").alias("sim"))
    if sims is not None:
        rows = rows.unionByName(sims.select(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("edge_idx"), F.col("id").alias("a"), F.col("id").alias("b"), "sim"))
    start = [r["id"] for r in _seed_table(nodes, seeds).orderBy("rank").collect()]  # as many as seeds

    prune = sims is not None

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[str]] = {}
        for a, b in g[g["kind"] == 0].sort_values("edge_idx")[["a", "b"]].itertuples(index=False):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        near = {a: list(dict.fromkeys(b)) for a, b in near.items()}
        sim = dict(g[g["kind"] == 1][["a", "sim"]].itertuples(index=False)) if prune else None
        got = dfs_order(start, near, sim, max_depth, threshold, max_nodes)
        return pd.DataFrame([(x, d, i) for i, (x, d) in enumerate(got)], columns=["id", "depth", "position"])

    return rows.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(walk, "id string, depth int, position int")


# Retrieval


def seeds_each(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.5) -> DataFrame:
    """(query, id, node_idx, score, rank) of the k most similar of each query with at least the threshold; null embeddings are skipped,
    ties in node order. vectors: id, node_idx, embedding; queries: query, vector. The two sides meet in blocks (V2)."""
    base = vectors.where("embedding IS NOT NULL").select(F.col("node_idx").alias("vec_id"), "embedding")
    asked = queries.where("vector IS NOT NULL").select(F.col("query").alias("vec_id"), F.col("vector").alias("embedding"))
    best = knn(asked, base, k, same_table=False).where(F.col("score") >= threshold)  # k rows a query
    return best.join(vectors.select(F.col("node_idx").alias("vec_id"), "id"), "vec_id").select(F.col("query_id").alias("query"), "id", F.col("vec_id").alias("node_idx"), "score", "rank")


def seed_entities(vectors: DataFrame, query: list[float], k: int = 10, threshold: float = 0.5) -> DataFrame:
    """R8 for one query: (id, node_idx, score)."""
    s = vectors.where("embedding IS NOT NULL").select("id", "node_idx", F.round(cosine(F.col("embedding"), F.array(*map(F.lit, query))), 9).alias("score"))
    return s.where(F.col("score") >= threshold).orderBy(F.desc("score"), "node_idx").limit(k)


def clusters_each(members: DataFrame, seeds: DataFrame, k: int = 5) -> DataFrame:
    """(query, cluster_id, n_seeds) of the k clusters with most seeds of each query. seeds: query, id."""
    s = seeds.select("query", F.col("id").alias("node_id")).distinct()
    n = members.join(s, "node_id").groupBy("query", "cluster_id").agg(F.count(F.lit(1)).alias("n_seeds"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n_seeds"), "cluster_id"))
    return n.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def relevant_clusters(members: DataFrame, seeds: DataFrame, k: int = 5) -> DataFrame:
    """R10 for one query: (cluster_id, n_seeds)."""
    return clusters_each(members, seeds.select(F.lit(0).alias("query"), "id"), k).orderBy(F.desc("n_seeds"), "cluster_id").drop("query")


def fuse(vector_list: DataFrame, graph_list: DataFrame, k: int = 10, c: int = 60) -> DataFrame:
    """(query, id, score): sums of 1 / (c + rank); the k best of each query are cut first, then those that only the graph gave are dropped."""
    part = lambda df, v: df.select("query", "id", (1.0 / (c + F.col("rank"))).alias("s"), F.lit(v).alias("v"))
    both = part(vector_list, 1).unionByName(part(graph_list, 0)).groupBy("query", "id").agg(F.round(F.sum("s"), 12).alias("score"), F.max("v").alias("v"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return both.withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("v") == 1)).select("query", "id", "score")


def hybrid(vector_list: DataFrame, graph_list: DataFrame | None, k: int = 10, method: str = "rrf") -> DataFrame:
    """Fused lists; a method other than rrf, or no graph list, cuts the vector list."""
    if method == "rrf" and graph_list is not None:
        return fuse(vector_list, graph_list, k)
    return vector_list.where(F.col("rank") <= k).select("query", "id", (1.0 / (60 + F.col("rank"))).alias("score"))


def query_entities(text_col: str = "text") -> Column:
    """The first five words with a capital and more than one letter."""
    return F.slice(F.filter(F.split(F.trim(F.regexp_replace(text_col, r"\s+", " ")), " "), lambda w: (F.length(w) > 1) & w.rlike(r"^\p{Lu}")), 1, 5)


def provenance(spark: SparkSession, query: str, chunks: DataFrame, reports: DataFrame, n_seeds: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label, data) and edges (source, target, type, weight) of query, chunks, communities, summaries, answer.

    chunks: rank from 1, chunk_id, text, score; reports: rank from 1, cluster_id, summary. Five of each are shown.
    """
    node = lambda df, i, t, label, data: df.select(i.alias("id"), F.lit(t).alias("type"), label.alias("label"), data.alias("data"))
    edge = lambda df, a, b, t, w: df.select(a.alias("source"), b.alias("target"), F.lit(t).alias("type"), w.cast("double").alias("weight"))
    c, r = chunks.where("rank <= 5"), reports.where("rank <= 5")
    one = spark.range(1)
    n = F.col("rank").cast("string")
    chunk, comm, summary = F.concat(F.lit("chunk_"), (F.col("rank") - 1).cast("string")), F.concat(F.lit("community_"), "cluster_id"), F.concat(F.lit("summary_"), (F.col("rank") - 1).cast("string"))
    total = reports.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    nodes = (
        node(one, F.lit("query"), "query", F.lit(f"Query: {query[:50]}"), F.lit(query))
        .unionByName(node(c, chunk, "chunk", F.concat(F.lit("Chunk "), n), F.left("text", F.lit(100))))
        .unionByName(node(r, comm, "community", F.concat(F.lit("Community "), n), F.left("summary", F.lit(100))))
        .unionByName(node(r, summary, "summary", F.concat(F.lit("Summary "), n), F.left("summary", F.lit(200))))
        .unionByName(node(total, F.lit("answer"), "answer", F.lit("Answer"), F.concat(F.lit("Based on "), F.col("n").cast("string"), F.lit(f" communities and {n_seeds} entities"))))
    )
    edges = (
        edge(c, F.lit("query"), chunk, "retrieved_from", F.col("score")).unionByName(edge(r, F.lit("query"), comm, "matched_community", F.lit(1.0)))
        .unionByName(edge(r, comm, summary, "summarized_in", F.lit(1.0))).unionByName(edge(r.where("rank = 1"), summary, F.lit("answer"), "generated_from", F.lit(1.0)))
    )
    return nodes, edges


def query_provenance(result: QueryResult, query: str) -> tuple[DataFrame, DataFrame]:
    """Query, answer and up to 20 entities of a deterministic query."""
    spark = result.seeds.sparkSession
    shown = result.entities.orderBy(F.lower("id"), "id").limit(20)
    fixed = spark.createDataFrame([("query", "query", query[:50]), ("answer", "answer", result.answer[:200])], "id string, type string, label string")
    nodes = fixed.unionByName(shown.select("id", F.lit("entity").alias("type"), F.left("id", F.lit(50)).alias("label")))
    edges = spark.createDataFrame([("query", "answer", "generated")], "source string, target string, type string").unionByName(shown.select(F.lit("query").alias("source"), F.col("id").alias("target"), F.lit("matched").alias("type")))
    return nodes, edges


@dataclass
class GraphContext:
    seeds: DataFrame
    nodes: DataFrame
    edges: DataFrame
    clusters: DataFrame


def retrieve_each(edges: DataFrame, members: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, max_hops: int = 2, k_reports: int = 5, threshold: float = 0.5) -> GraphContext:
    """R7 for any number of queries: seeds by similarity, their surroundings, and the clusters that hold most of them, each with
    its query; no seeds, nothing."""
    seeds = cut(seeds_each(vectors, queries, k, threshold))
    found, tree = traverse_each(edges, seeds.select("query", "id", F.col("rank").cast("long").alias("rank")), max_hops)
    return GraphContext(seeds, found, tree, clusters_each(members, seeds, k_reports))


def graph_retrieve(nodes: DataFrame, edges: DataFrame, members: DataFrame, vectors: DataFrame, query: list[float], k: int = 10, max_hops: int = 2, k_reports: int = 5) -> GraphContext:
    """R7 for one query."""
    c = retrieve_each(edges, members, vectors, nodes.sparkSession.createDataFrame([(0, query)], "query long, vector array<double>"), k, max_hops, k_reports)
    return GraphContext(*(x.drop("query") for x in (c.seeds.drop("rank"), c.nodes, c.edges, c.clusters)))
