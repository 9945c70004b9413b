"""Queries over vectors and retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import cosine
from graphloom.operators import retrieval as R
from graphloom.operators import vectors as V
from graphloom.plans.catalog import query
from graphloom.plans.cluster_queries import MEMBERS, members
from graphloom.sources.tables import GRAPH, NODES_SQL, edges, edges_at, nodes, table
from graphloom.sources.textgraph import TRIPLES, chunks, mentions, triples

VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"
#: The queries of searches are the rows whose id is divisible by 100, against all rows.
ALL_PAIRS = f"{VEC}, pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, b.label, round(list_cosine_similarity(a.e, b.e), 9) AS score FROM v a, v b WHERE a.vec_id <> b.vec_id AND a.vec_id % 100 = 0)"
KNN = "SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {src}) WHERE rank <= {k}"


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings")


def asked(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).where("vec_id % 100 = 0")


def shown(found: DataFrame) -> DataFrame:
    """Scores to six places, as they are compared with other engines' sums."""
    return found.withColumn("score", F.round("score", 6))


@query("g18_mock_embeddings")
def g18_mock_embeddings(s: SparkSession, d: str) -> DataFrame:
    return V.attach_embeddings(nodes(s, d).select("id"))


@query("g19_similarity_edges", f"WITH {VEC} SELECT a.vec_id AS source, b.vec_id AS target, round(round(list_cosine_similarity(a.e, b.e), 9), 6) AS score FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.e, b.e), 9) >= 0.35")
def g19_similarity_edges(s: SparkSession, d: str) -> DataFrame:
    return V.similar_pairs(vectors(s, d), 0.35).withColumn("score", F.round("score", 6))


@query("g20_cosine", f"WITH {VEC} SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def g20_cosine(s: SparkSession, d: str) -> DataFrame:
    """Each vector with the next one."""
    v = vectors(s, d)
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("e"))
    return v.join(after, "vec_id").select("vec_id", "other", F.round(cosine(F.col("embedding"), F.col("e")), 6).alias("score"))


@query("v1_validation", "SELECT vec_id, CASE WHEN label = 3 THEN 'no vector' ELSE 'wrong dimension' END AS problem FROM embeddings WHERE label IN (3, 4)")
def v1_validation(s: SparkSession, d: str) -> DataFrame:
    """Vectors of one label are taken away, those of another cut short."""
    v = vectors(s, d).select("vec_id", F.when(F.col("label") == 4, F.slice("embedding", 1, 32)).when(F.col("label") != 3, F.col("embedding")).alias("embedding"))
    return V.rejected(v, 64)


@query("v2_exact_knn", f"WITH {ALL_PAIRS} {KNN.format(src='pairs', k=5)}")
def v2_exact_knn(s: SparkSession, d: str) -> DataFrame:
    return shown(V.knn(asked(s, d), vectors(s, d), 5))


@query("v3_score_transforms", f"""WITH {ALL_PAIRS}, d AS (SELECT query_id, vec_id, 2 - 2 * score AS d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5)
SELECT query_id, vec_id, round(1 - d / 2, 6) AS cosine, round(CASE WHEN d <= 1 THEN 1 - d ELSE 1 / (1 + d) END, 6) AS bounded, round(1 / (1 + d), 6) AS inverse, round(1 - d, 6) AS native FROM d""")
def v3_score_transforms(s: SparkSession, d: str) -> DataFrame:
    found = V.knn(asked(s, d), vectors(s, d), 5).withColumn("d", 2 - 2 * F.col("score"))
    return found.select("query_id", "vec_id", *(F.round(f(F.col("d")), 6).alias(n) for n, f in V.SCORES.items()))


@query("v4_ivf_search")
def v4_ivf_search(s: SparkSession, d: str) -> DataFrame:
    return V.ivf(vectors(s, d), asked(s, d), 5)


@query("v5_filtered_search", f"WITH {ALL_PAIRS} {KNN.format(src='(SELECT * FROM pairs WHERE label IN (1, 2))', k=5)}")
def v5_filtered_search(s: SparkSession, d: str) -> DataFrame:
    return shown(V.search(asked(s, d), vectors(s, d), 5, {"label": {"$in": [1, 2]}}))


@query("v5_post_filtered_search", f"WITH {ALL_PAIRS}, k AS ({KNN.format(src='pairs', k=5)}) SELECT k.* FROM k SEMI JOIN (SELECT vec_id FROM v WHERE label IN (1, 2)) USING (vec_id)")
def v5_post_filtered_search(s: SparkSession, d: str) -> DataFrame:
    return V.search(asked(s, d), vectors(s, d), 5, {"label": {"$in": [1, 2]}}, post_filter=True).transform(shown).select("query_id", "vec_id", "score", "rank")


@query("v6_upsert", "SELECT vec_id, label FROM embeddings WHERE label <> 2 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE label = 2 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE label = 5")
def v6_upsert(s: SparkSession, d: str) -> DataFrame:
    v = vectors(s, d)
    rows = v.where("label = 2").withColumn("label", F.col("label") + 100).unionByName(v.where("label = 5").withColumn("vec_id", F.col("vec_id") + 1_000_000))
    return V.upsert(v, rows).select("vec_id", "label")


@query("v7_delete", "SELECT vec_id, label FROM embeddings WHERE label NOT IN (2, 7)")
def v7_delete(s: SparkSession, d: str) -> DataFrame:
    v = vectors(s, d)
    return V.delete(v, v.where("label IN (2, 7)")).select("vec_id", "label")


@query("v8_metadata_counts", "SELECT label, count(*) AS n, min(vec_id) AS first_id, CAST(max(len(embedding)) AS INTEGER) AS dim FROM embeddings GROUP BY label")
def v8_metadata_counts(s: SparkSession, d: str) -> DataFrame:
    return vectors(s, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.max(F.size("embedding")).alias("dim"))


# Deterministic queries

TEXTS = ("nation:3 (located_in)", "What is part_of region:1?", "supplier:12 rel:supplies", "the zzz")


def _query_sql(i: int, text: str) -> str:
    q = R.Query.parse(text)
    tokens = "[" + ", ".join(f"'{t}'" for t in q.tokens) + "]"
    where = f"AND lower(relationship_type) = '{q.relation}'" if q.relation else ""
    return f"""SELECT {i} AS query, * FROM (WITH s AS (SELECT id, CASE WHEN id = '{q.norm}' THEN 5 ELSE CASE WHEN contains(id, '{q.norm}') THEN 3 ELSE 0 END + CASE WHEN list_contains({tokens}, id) THEN 1.4 ELSE 0 END END AS score FROM nodes),
hits AS (SELECT id, row_number() OVER (ORDER BY score DESC, lower(id)) AS r FROM s WHERE score > 0), tops AS (SELECT id, row_number() OVER (ORDER BY degree DESC, lower(id)) AS r FROM deg WHERE NOT EXISTS (SELECT 1 FROM hits)),
seeds AS (SELECT * FROM (SELECT * FROM hits UNION ALL SELECT * FROM tops) WHERE r <= 10),
found AS (SELECT edge_idx, source, target FROM edges WHERE (source IN (SELECT id FROM seeds) OR target IN (SELECT id FROM seeds)) {where} ORDER BY edge_idx LIMIT 40)
SELECT 'seed' AS kind, id AS value FROM seeds UNION ALL SELECT 'edge', CAST(edge_idx AS VARCHAR) FROM found UNION ALL SELECT 'entity', id FROM (SELECT id FROM seeds UNION SELECT source FROM found UNION SELECT target FROM found))"""


@query("n1_execute_query", f"WITH {GRAPH}, deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) " + " UNION ALL ".join(_query_sql(i, t) for i, t in enumerate(TEXTS)))
def n1_execute_query(s: SparkSession, d: str) -> DataFrame:
    """Seeds, edges and entities of four queries: with a relation, without, with the other form of relation, and with no match."""
    out = []
    for i, r in enumerate(R.execute_queries(nodes(s, d), edges(s, d), list(TEXTS), touching=lambda ids: edges_at(s, d, ids))):
        row = lambda df, kind, v: df.select(F.lit(i).alias("query"), F.lit(kind).alias("kind"), v.alias("value"))  # noqa: E731, B023
        out += [row(r.seeds, "seed", F.col("id")), row(r.edges, "edge", F.col("edge_idx").cast("string")), row(r.entities, "entity", F.col("id"))]
    return reduce(DataFrame.unionByName, out)


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(R.STOPWORDS)) + "]"


@query("n2_query_tokens", f"SELECT item_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[(),]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w)), ' ') AS tokens FROM benchmark")
def n2_query_tokens(s: SparkSession, d: str) -> DataFrame:
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), "[(),]", " "), r"\s+", " ")), " ")
    return table(s, d, "benchmark").select("item_id", F.array_join(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*R.STOPWORDS)), " ").alias("tokens"))


@query("n3_relation_filter", "SELECT event_id, lower(event_type) AS relation FROM events")
def n3_relation_filter(s: SparkSession, d: str) -> DataFrame:
    """Events as queries that name a relation, parsed by expression."""
    q = F.concat(F.lit("who did Relation: "), "event_type", F.lit(", then?"))
    return table(s, d, "events").select("event_id", F.regexp_extract(F.lower(q), r"rel(?:ation)?[:=]\s*([^\s,.;]+)", 1).alias("relation"))


@query("n4_entity_scores", f"WITH nodes AS ({NODES_SQL}) SELECT id, score FROM (SELECT id, CASE WHEN id = 'nation:1' THEN 5.0 ELSE CASE WHEN contains(id, 'nation:1') THEN 3.0 ELSE 0.0 END + CASE WHEN id = 'customer:7' THEN 1.4 ELSE 0.0 END END AS score FROM nodes) WHERE score > 0")
def n4_entity_scores(s: SparkSession, d: str) -> DataFrame:
    """Scores of an exact match, of ids that hold the query, and of an id that shares a token."""
    return R.entity_scores(nodes(s, d), R.Query("nation:1", ("nation:1", "customer:7"), None)).select("id", "score")


@query("n5_fallback_seeds", f"WITH {GRAPH} SELECT id, CAST(row_number() OVER (ORDER BY count(*) DESC, lower(id)) - 1 AS INTEGER) AS rank FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id ORDER BY rank LIMIT 10")
def n5_fallback_seeds(s: SparkSession, d: str) -> DataFrame:
    return R.seeds_for(nodes(s, d), edges(s, d), R.Query.parse("zzz qqq"))


# Retrieval


@query("r2_text_context", f"WITH {TRIPLES}, names AS (SELECT DISTINCT name FROM mentions), b AS (SELECT lower(text) AS t FROM benchmark), found AS (SELECT name FROM names WHERE EXISTS (SELECT 1 FROM b WHERE contains(t, lower(name)))) SELECT DISTINCT source, relation, target FROM triples WHERE source IN (SELECT name FROM found) OR target IN (SELECT name FROM found)")
def r2_text_context(s: SparkSession, d: str) -> DataFrame:
    """Relations of the text graph that touch a name found in any benchmark passage."""
    c = chunks(s, d)
    ids = mentions(c).select(F.col("name").alias("id")).distinct()
    return R.text_context(table(s, d, "benchmark"), ids, triples(c).select("source", "relation", "target"), "item_id")[1]


def node_vectors(s: SparkSession, d: str) -> DataFrame:
    """Parts and, by their number, the vectors: the embedding of part k is vector k."""
    v = vectors(s, d).select(F.concat(F.lit("part:"), F.col("vec_id").cast("string")).alias("id"), "embedding")
    return nodes(s, d).join(v, "id").select("id", "node_idx", "embedding")


NODE_VEC = "nv AS (SELECT id, node_idx, CAST(embedding AS DOUBLE[]) AS e FROM nodes JOIN embeddings ON id = 'part:' || vec_id), q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0), sims AS (SELECT query, id, node_idx, round(list_cosine_similarity(e, q), 9) AS score FROM nv, q)"
#: Seeds of each query: the three most similar parts.
_SEEDS = f"{NODE_VEC}, seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node_idx) AS rank FROM sims WHERE score >= 0.2) WHERE rank <= 3)"
#: Their surroundings: suppliers, and in the tree of edges what lies one hop beyond.
_TREES = f"""{_SEEDS}, ends AS MATERIALIZED (SELECT edge_idx, source AS id, target AS other FROM edges UNION ALL SELECT edge_idx, target, source FROM edges), t0 AS (SELECT query, id, [CAST(rank AS BIGINT)] AS path FROM seeds),
t1 AS MATERIALIZED (SELECT query, other AS id, min(list_append(path, edge_idx)) AS path FROM t0 JOIN ends USING (id) WHERE (query, other) NOT IN (SELECT query, id FROM t0) GROUP BY query, other),
t2 AS MATERIALIZED (SELECT query, other AS id, min(list_append(path, edge_idx)) AS path FROM t1 JOIN ends USING (id) WHERE (query, other) NOT IN (SELECT query, id FROM t0) AND (query, other) NOT IN (SELECT query, id FROM t1) GROUP BY query, other)"""


def node_queries(s: SparkSession, d: str) -> DataFrame:
    return asked(s, d).select(F.col("vec_id").alias("query"), F.col("embedding").cast("array<double>").alias("vector"))


_HOPS = """both_ways AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges), h0 AS (SELECT id FROM nodes WHERE id IN ({seeds})),
h1 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a IN (SELECT id FROM h0) AND b NOT IN (SELECT id FROM h0)), h2 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a IN (SELECT id FROM h1) AND b NOT IN (SELECT id FROM h0) AND b NOT IN (SELECT id FROM h1)),
hops AS (SELECT id, 0 AS hop FROM h0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2)"""


@query("r4_bfs", f"WITH {GRAPH}, {_HOPS.format(seeds=chr(39) + 'nation:3' + chr(39) + ', ' + chr(39) + 'customer:1' + chr(39))} SELECT id, CAST(hop AS INTEGER) AS hop FROM hops")
def r4_bfs(s: SparkSession, d: str) -> DataFrame:
    """All nodes within two hops of two seeds (and one that isn't in the graph)."""
    return R.traverse(nodes(s, d), edges(s, d), ["nation:3", "customer:1", "nowhere"], 2)[0].select("id", "hop")


#: Paths as lists, seed first; a node keeps its least path among those of its level.
_PATHS = """ends AS (SELECT edge_idx, source AS id, target AS other FROM edges UNION ALL SELECT edge_idx, target, source FROM edges), p0 AS (SELECT id, [CAST(list_position([{seeds}], id) - 1 AS BIGINT)] AS path FROM nodes WHERE id IN ({seeds})),
p1 AS (SELECT other AS id, min(list_append(path, edge_idx)) AS path FROM p0 JOIN ends USING (id) WHERE other NOT IN (SELECT id FROM p0) GROUP BY other),
p2 AS (SELECT other AS id, min(list_append(path, edge_idx)) AS path FROM p1 JOIN ends USING (id) WHERE other NOT IN (SELECT id FROM p0) AND other NOT IN (SELECT id FROM p1) GROUP BY other)"""


@query("r4_bfs_order", f"WITH {GRAPH}, {_PATHS.format(seeds=chr(39) + 'nation:3' + chr(39) + ', ' + chr(39) + 'customer:1' + chr(39))} SELECT id, CAST(hop AS INTEGER) AS hop, CAST(row_number() OVER (ORDER BY hop, path, id) - 1 AS INTEGER) AS position FROM (SELECT id, 0 AS hop, path FROM p0 UNION ALL SELECT id, 1, path FROM p1 UNION ALL SELECT id, 2, path FROM p2) ORDER BY position LIMIT 50")
def r4_bfs_order(s: SparkSession, d: str) -> DataFrame:
    return R.bfs(nodes(s, d), edges(s, d), ["nation:3", "customer:1"], 2, 50)


@query("r5_dfs")
def r5_dfs(s: SparkSession, d: str) -> DataFrame:
    return R.dfs(nodes(s, d), edges(s, d), ["nation:3"], max_depth=2)


@query("r6_weighted_search", f"""WITH {GRAPH}, {_TREES}, found AS (SELECT query, id, 0 AS hop, path FROM t0 UNION ALL SELECT query, id, 1, path FROM t1), cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hop, path, id) AS position FROM found) WHERE position <= 50),
sc AS (SELECT c.query, c.id, hop, position, round(0.7 * COALESCE(list_cosine_similarity(e, q), 0.5) + 0.3 / (1 + hop), 9) AS score FROM cut c JOIN q USING (query) LEFT JOIN nv ON nv.id = c.id)
SELECT query, id, CAST(hop AS INTEGER) AS hop, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, position) AS rank FROM sc) WHERE rank <= 10""")
def r6_weighted_search(s: SparkSession, d: str) -> DataFrame:
    """Each query's ten best nodes within a hop of its three most similar parts."""
    v, q = node_vectors(s, d), node_queries(s, d)
    seeds = R.seeds_each(v, q, 3, 0.2).select("query", "id", F.col("rank").cast("long").alias("rank"))
    return R.weighted_each(edges(s, d), v, q, seeds, max_hops=1).withColumn("score", F.round("score", 6))


@query("r7_graph_retrieval", f"""WITH {MEMBERS}, {_TREES}, c AS (SELECT query, cluster_id, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, cluster_id) AS r FROM members JOIN (SELECT DISTINCT query, id AS node_id FROM seeds) USING (node_id) GROUP BY query, cluster_id)
SELECT query, 'seed' AS kind, id AS value FROM seeds UNION ALL SELECT query, 'node', id FROM t0 UNION ALL SELECT query, 'node', id FROM t1 UNION ALL SELECT DISTINCT query, 'edge', CAST(path[-1] AS VARCHAR) FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) UNION ALL SELECT query, 'cluster', cluster_id FROM c WHERE r <= 5""")
def r7_graph_retrieval(s: SparkSession, d: str) -> DataFrame:
    """Everything that each query by vector retrieves, by kind."""
    c = R.retrieve_each(edges(s, d), members(s, d), node_vectors(s, d), node_queries(s, d), k=3, max_hops=1, threshold=0.2)
    row = lambda df, kind, v: df.select("query", F.lit(kind).alias("kind"), v.cast("string").alias("value"))
    return row(c.seeds, "seed", F.col("id")).unionByName(row(c.nodes, "node", F.col("id"))).unionByName(row(c.edges, "edge", F.col("edge_idx"))).unionByName(row(c.clusters, "cluster", F.col("cluster_id")))


@query("r8_seed_entities", f"WITH nodes AS ({NODES_SQL}), {NODE_VEC} SELECT query, id, node_idx, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, node_idx) AS rank FROM sims WHERE score >= 0.2) WHERE rank <= 10")
def r8_seed_entities(s: SparkSession, d: str) -> DataFrame:
    return R.seeds_each(node_vectors(s, d), node_queries(s, d), 10, 0.2).withColumn("score", F.round("score", 6))


@query("r9_traversal_nodes", f"WITH {GRAPH}, {_HOPS.format(seeds=chr(39) + 'supplier:1' + chr(39))} SELECT id, CAST(hop AS INTEGER) AS hop FROM hops")
def r9_traversal_nodes(s: SparkSession, d: str) -> DataFrame:
    return R.traverse(nodes(s, d), edges(s, d), ["supplier:1"], 2)[0].select("id", "hop")


@query("r9_traversal_edges", f"WITH {GRAPH}, {_PATHS.format(seeds=chr(39) + 'nation:3' + chr(39) + ', ' + chr(39) + 'nation:4' + chr(39))} SELECT edge_idx, source, relationship_type, target FROM edges WHERE edge_idx IN (SELECT path[-1] FROM p1 UNION ALL SELECT path[-1] FROM p2)")
def r9_traversal_edges(s: SparkSession, d: str) -> DataFrame:
    return R.traverse(nodes(s, d), edges(s, d), ["nation:3", "nation:4"], 1)[1]


@query("r10_relevant_clusters", f"WITH {MEMBERS} SELECT cluster_id, count(*) AS n_seeds FROM members SEMI JOIN (SELECT id AS node_id FROM nodes WHERE type = 'Supplier') USING (node_id) GROUP BY cluster_id ORDER BY n_seeds DESC, cluster_id LIMIT 5")
def r10_relevant_clusters(s: SparkSession, d: str) -> DataFrame:
    return R.relevant_clusters(members(s, d), nodes(s, d).where("type = 'Supplier'").select("id"), 5)


_LISTS = f"{ALL_PAIRS}, vl AS (SELECT query_id AS query, vec_id AS id, rank FROM ({KNN.format(src='pairs', k=10)})), gl AS (SELECT a.vec_id AS query, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS rank FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"


def _lists(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Of each query: its ten nearest, and the others of its label. Of these, the ones that can count are among the label's
    first eleven ids or the ten nearest, so a label's ids are cut and numbered once, not paired with every query."""
    from pyspark.sql import Window

    v, q = vectors(s, d), asked(s, d).select(F.col("vec_id").alias("query"), "label")
    near = V.knn(asked(s, d), v, 10).select(F.col("query_id").alias("query"), F.col("vec_id").alias("id"), "rank")
    numbered = v.select(F.col("vec_id").alias("id"), "label", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("place"))
    own = numbered.select(F.col("id").alias("query"), F.col("place").alias("own"))
    first = q.join(F.broadcast(numbered.where("place <= 11")), "label").where("query <> id").select("query", "id", "place")
    met = near.select("query", "id").join(q, "query").join(numbered, ["id", "label"]).select("query", "id", "place")
    same = first.unionByName(met).distinct().join(own, "query")
    return near, same.select("query", "id", (F.col("place") - (F.col("place") > F.col("own")).cast("int")).alias("rank"))


_FUSED = f"WITH {_LISTS}, u AS (SELECT query, id, round(sum(s), 12) AS score, max(v) AS v FROM (SELECT query, id, 1 / (60 + rank) AS s, 1 AS v FROM vl UNION ALL SELECT query, id, 1 / (60 + rank), 0 FROM gl) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM u) SELECT query, id, round(score, 6) AS score FROM r WHERE rank <= 10 AND v = 1"


@query("r12_rank_fusion", _FUSED)
def r12_rank_fusion(s: SparkSession, d: str) -> DataFrame:
    """For every vector: its nearest ones fused with those of its label."""
    return R.fuse(*_lists(s, d)).withColumn("score", F.round("score", 6))


@query("r11_hybrid_vector_only", f"WITH {ALL_PAIRS} SELECT query_id AS query, vec_id AS id, round(1 / (60 + rank), 6) AS score FROM ({KNN.format(src='pairs', k=10)})")
def r11_hybrid_vector_only(s: SparkSession, d: str) -> DataFrame:
    near, same = _lists(s, d)
    return R.hybrid(near, same, 10, "weighted").withColumn("score", F.round("score", 6))


@query("r1_rag_retrieve", f"WITH {ALL_PAIRS} SELECT k.query_id, k.vec_id, k.rank, k.score, text FROM ({KNN.format(src='pairs', k=3)}) k JOIN documents ON doc_id = vec_id")
def r1_rag_retrieve(s: SparkSession, d: str) -> DataFrame:
    """Every vector retrieves the texts of its three nearest."""
    found = V.knn(asked(s, d), vectors(s, d), 3)
    return found.join(table(s, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"), "text")


@query("r3_filtered_retrieval", "SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'system')")
def r3_filtered_retrieval(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").where(V.matches({"role": {"$in": ["user", "system"]}})).select("conv_id", "turn", "role")


@query("r13_query_entities", "SELECT item_id, array_to_string(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND regexp_matches(w, '^\\p{Lu}'))[1:5], ' ') AS entities FROM benchmark")
def r13_query_entities(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "benchmark").select("item_id", F.array_join(R.query_entities("text"), " ").alias("entities"))


_TOP_CHUNKS = "c AS (SELECT row_number() OVER (ORDER BY item_id) AS rank, text, 1 / (1 + item_id) AS score FROM benchmark), m AS (SELECT 'nation:' || n_nationkey AS cluster_id, row_number() OVER (ORDER BY n_nationkey) AS rank, 'Places of ' || n_name AS summary FROM nation)"


def _provenance(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rank = (F.col("k") + 1).cast("int").alias("rank")
    c = table(s, d, "benchmark").withColumn("k", F.col("item_id")).select(rank, "text", (1 / (1 + F.col("item_id"))).alias("score"))
    r = table(s, d, "nation").withColumn("k", F.col("n_nationkey")).select(rank, F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("cluster_id"), F.concat(F.lit("Places of "), "n_name").alias("summary"))
    return R.provenance(s, "Which places matter?", c, r, 7)


@query("r14_provenance_nodes", f"""WITH {_TOP_CHUNKS} SELECT 'query' AS id, 'query' AS type, 'Query: Which places matter?' AS label, 'Which places matter?' AS data UNION ALL SELECT 'chunk_' || (rank - 1), 'chunk', 'Chunk ' || rank, left(text, 100) FROM c WHERE rank <= 5
UNION ALL SELECT 'community_' || cluster_id, 'community', 'Community ' || rank, left(summary, 100) FROM m WHERE rank <= 5 UNION ALL SELECT 'summary_' || (rank - 1), 'summary', 'Summary ' || rank, left(summary, 200) FROM m WHERE rank <= 5
UNION ALL SELECT 'answer', 'answer', 'Answer', 'Based on ' || count(*) || ' communities and 7 entities' FROM m""")
def r14_provenance_nodes(s: SparkSession, d: str) -> DataFrame:
    return _provenance(s, d)[0]


@query("r14_provenance_edges", f"""WITH {_TOP_CHUNKS} SELECT 'query' AS source, 'chunk_' || (rank - 1) AS target, 'retrieved_from' AS type, CAST(score AS DOUBLE) AS weight FROM c WHERE rank <= 5 UNION ALL SELECT 'query', 'community_' || cluster_id, 'matched_community', 1 FROM m WHERE rank <= 5
UNION ALL SELECT 'community_' || cluster_id, 'summary_' || (rank - 1), 'summarized_in', 1 FROM m WHERE rank <= 5 UNION ALL SELECT 'summary_0', 'answer', 'generated_from', 1""")
def r14_provenance_edges(s: SparkSession, d: str) -> DataFrame:
    return _provenance(s, d)[1]


@query("r15_query_provenance", f"""WITH {GRAPH}, deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id), x AS MATERIALIZED ({_query_sql(0, TEXTS[0])})
SELECT 'query' AS id, 'query' AS type, '{TEXTS[0]}' AS label UNION ALL SELECT 'answer', 'answer', 'The relation ''located_in'' restricts the result: ' || count(*) FILTER (kind = 'seed') || ' seed entities, ' || count(*) FILTER (kind = 'edge') || ' related edges.' FROM x
UNION ALL SELECT * FROM (SELECT value, 'entity', left(value, 50) FROM x WHERE kind = 'entity' ORDER BY lower(value), value LIMIT 20)""")
def r15_query_provenance(s: SparkSession, d: str) -> DataFrame:
    return R.query_provenance(R.execute_query(nodes(s, d), edges(s, d), TEXTS[0], touching=lambda ids: edges_at(s, d, ids)), TEXTS[0])[0]
