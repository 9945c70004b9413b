"""Queries over schemas, clusters and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import clusters as K
from graphloom.operators import metrics as M
from graphloom.operators import schema as H
from graphloom.operators import vectors as V
from graphloom.plans.catalog import query
from graphloom.sources.tables import GRAPH, edges, nodes, table
from graphloom.sources.textgraph import MENTIONS, chunks, mentions

# Schemas: brands and types of parts stand for declared types, parts for relations between them



def _schema(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = table(s, d, "part")
    types = p.where("p_size > 48").select(F.col("p_brand").alias("type")).unionByName(p.select(F.col("p_type").alias("type")).distinct())
    return types, p.select(F.col("p_name").alias("name"), F.col("p_type").alias("src"), F.col("p_brand").alias("dst")), p.select(F.col("p_type").alias("group"), F.col("p_brand").alias("member")).distinct()


@query("h1_schema_violations", """WITH t AS (SELECT p_brand AS type FROM part WHERE p_size > 48 UNION ALL SELECT DISTINCT p_type FROM part)
SELECT '' AS item, 'blank type' AS problem FROM t WHERE type IS NULL OR trim(type) = '' UNION ALL SELECT type, 'repeated type' FROM t GROUP BY type HAVING count(*) > 1
UNION ALL SELECT DISTINCT name || ':' || type, 'unknown endpoint' FROM (SELECT p_name AS name, p_type AS type FROM part UNION ALL SELECT p_name, p_brand FROM part) WHERE type NOT IN (SELECT type FROM t)
UNION ALL SELECT DISTINCT p_type || ':' || p_brand, 'unknown member' FROM part WHERE p_brand NOT IN (SELECT type FROM t)""")
def h1_schema_violations(s: SparkSession, d: str) -> DataFrame:
    return H.violations(*_schema(s, d))


@query("h2_valid_relations", "SELECT l_orderkey, l_linenumber, 'ships' AS relation, l_returnflag AS src, l_linestatus AS dst FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'))")
def h2_valid_relations(s: SparkSession, d: str) -> DataFrame:
    rel = s.createDataFrame([("ships", "A", "F"), ("ships", "N", "O")], "name string, src string, dst string")
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("ships").alias("relation"), F.col("l_returnflag").alias("src"), F.col("l_linestatus").alias("dst"))
    return H.valid_triples(rows, rel).select("l_orderkey", "l_linenumber", "relation", "src", "dst")


@query("h3_relations_of_type", "SELECT p_type AS type, 'src' AS role, p_name AS name, p_brand AS other FROM part UNION ALL SELECT p_brand, 'dst', p_name, p_type FROM part")
def h3_relations_of_type(s: SparkSession, d: str) -> DataFrame:
    return H.relations_of(_schema(s, d)[1])


@query("h4_flatten_groups", "SELECT DISTINCT p_type AS group, p_name AS name FROM part")
def h4_flatten_groups(s: SparkSession, d: str) -> DataFrame:
    groups = table(s, d, "part").groupBy(F.col("p_type").alias("group")).agg(F.collect_set("p_name").alias("relations"))
    return groups.select("group", F.explode("relations").alias("name"))


# Clusters: the places of a nation

MEMBERS = f"{GRAPH}, members AS (SELECT target AS cluster_id, source AS node_id FROM edges WHERE relationship_type = 'located_in' UNION ALL SELECT id, id FROM nodes WHERE type = 'Nation')"
#: An edge is inside a cluster if it leads from a place to its nation; edges between suppliers and parts, or nations and regions, have an end in no cluster.
INNER = f"{MEMBERS}, member_of AS MATERIALIZED (SELECT * FROM members), edge_list AS MATERIALIZED (SELECT * FROM edges), inner_edges AS MATERIALIZED (SELECT a.cluster_id, e.* FROM edge_list e JOIN member_of a ON a.node_id = e.source JOIN member_of b ON b.node_id = e.target WHERE a.cluster_id = b.cluster_id)"


def members(s: SparkSession, d: str) -> DataFrame:
    m = edges(s, d).where("relationship_type = 'located_in'").select(F.col("target").alias("cluster_id"), F.col("source").alias("node_id"))
    return m.unionByName(nodes(s, d).where("type = 'Nation'").select(F.col("id").alias("cluster_id"), F.col("id").alias("node_id")))


#: Components in three steps: places by their region, regions that share a part, and what hangs on them.
COMPONENTS = f"""{GRAPH}, region_of AS (SELECT 'nation:' || n_nationkey AS id, 'region:' || n_regionkey AS r FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region:' || r_regionkey FROM region
UNION ALL SELECT 'customer:' || c_custkey, 'region:' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey),
part_of AS MATERIALIZED (SELECT DISTINCT 'part:' || l_partkey AS id, 'region:' || n_regionkey AS r FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
links AS MATERIALIZED (SELECT DISTINCT a.r AS x, b.r AS y FROM part_of a JOIN part_of b USING (id)),
reach(x, y) AS (SELECT DISTINCT r, r FROM region_of UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
grouped AS (SELECT x AS r, min(y) AS g FROM reach GROUP BY x), placed AS (SELECT DISTINCT id, g FROM (SELECT * FROM region_of UNION ALL SELECT * FROM part_of) JOIN grouped USING (r)),
named AS (SELECT g, min(id) AS component FROM placed GROUP BY g), comp AS (SELECT n.id, n.type, COALESCE(component, n.id) AS component FROM nodes n LEFT JOIN placed USING (id) LEFT JOIN named USING (g))"""


@query("k1_components", f"WITH RECURSIVE {COMPONENTS} SELECT id, component FROM comp")
def k1_components(s: SparkSession, d: str) -> DataFrame:
    return K.components(nodes(s, d), edges(s, d))


@query("k2_type_groups", f"WITH {GRAPH} SELECT type, n, CAST(row_number() OVER (ORDER BY n DESC, lower(type)) AS INTEGER) AS rank FROM (SELECT COALESCE(NULLIF(trim(type), ''), 'Unknown') AS type, count(*) AS n FROM nodes GROUP BY ALL)")
def k2_type_groups(s: SparkSession, d: str) -> DataFrame:
    return K.type_groups(nodes(s, d))


@query("k3_ensure_clusters", f"""WITH RECURSIVE {COMPONENTS}, sizes AS (SELECT component, count(*) AS n, min(lower(id)) AS first FROM comp GROUP BY component HAVING count(*) >= 2),
c AS (SELECT component, 'cc_' || row_number() OVER (ORDER BY n DESC, first) AS cluster_id FROM sizes), g AS (SELECT type, 'type_' || row_number() OVER (ORDER BY count(*) DESC, lower(type)) || '_' || lower(type) AS cluster_id FROM comp SEMI JOIN sizes USING (component) GROUP BY type HAVING count(*) >= 2)
SELECT cluster_id, id AS node_id FROM comp JOIN c USING (component) WHERE (SELECT count(*) FROM sizes) > 1 AND CAST(substr(cluster_id, 4) AS INTEGER) <= 12 UNION ALL SELECT cluster_id, id FROM comp SEMI JOIN sizes USING (component) JOIN g USING (type) WHERE (SELECT count(*) FROM sizes) = 1""")
def k3_ensure_clusters(s: SparkSession, d: str) -> DataFrame:
    """The largest components; with deliveries the graph is one component as a rule, so its types are the clusters."""
    return K.ensure_clusters(nodes(s, d), edges(s, d))


@query("k4_louvain")
def k4_louvain(s: SparkSession, d: str) -> DataFrame:
    return K.louvain(edges(s, d))


@query("k5_leiden")
def k5_leiden(s: SparkSession, d: str) -> DataFrame:
    return K.leiden(edges(s, d))


@query("k6_spectral")
def k6_spectral(s: SparkSession, d: str) -> DataFrame:
    return K.spectral(nodes(s, d), edges(s, d))


@query("k7_internal_edges", f"WITH {INNER} SELECT cluster_id, edge_idx, source, relationship_type, target FROM inner_edges")
def k7_internal_edges(s: SparkSession, d: str) -> DataFrame:
    return K.internal_edges(edges(s, d), members(s, d)).select("cluster_id", "edge_idx", "source", "relationship_type", "target")


@query("k8_cluster_metadata", f"""WITH {INNER}, deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id),
m AS (SELECT count(*) AS m FROM edges), n AS (SELECT cluster_id, count(*) AS node_count, sum(degree) AS degree FROM members LEFT JOIN deg ON id = node_id GROUP BY cluster_id), e AS (SELECT cluster_id, count(*) AS edge_count FROM inner_edges GROUP BY cluster_id)
SELECT cluster_id, node_count, COALESCE(edge_count, 0) AS edge_count, COALESCE(edge_count, 0) / m - (degree / (2 * m)) * (degree / (2 * m)) AS modularity FROM n LEFT JOIN e USING (cluster_id), m""")
def k8_cluster_metadata(s: SparkSession, d: str) -> DataFrame:
    return K.cluster_metadata(edges(s, d), members(s, d))


_SUMMARY = f"""{INNER}, n AS (SELECT cluster_id, count(*) AS node_count FROM members GROUP BY cluster_id), e AS (SELECT cluster_id, count(*) AS edge_count FROM inner_edges GROUP BY cluster_id),
ranked AS (SELECT cluster_id, node_id, row_number() OVER (PARTITION BY cluster_id ORDER BY node_idx) AS rank FROM members JOIN nodes ON id = node_id),
names AS (SELECT cluster_id, list(node_id ORDER BY rank) AS names FROM ranked WHERE rank <= 10 GROUP BY cluster_id)"""


@query("k11_cluster_summaries", f"""WITH {_SUMMARY} SELECT cluster_id, names[1] || '_Community' AS name, 'This cluster contains ' || node_count || ' entities and ' || COALESCE(edge_count, 0) || ' relationships. Key entities include: ' || array_to_string(names[1:5], ', ') || '.' AS description,
array_to_string(names, '|') AS key_entities, node_count, COALESCE(edge_count, 0) AS edge_count, CASE WHEN node_count <= 1 THEN 0 ELSE 2 * COALESCE(edge_count, 0) / (node_count * (node_count - 1)) END AS density FROM n LEFT JOIN e USING (cluster_id) LEFT JOIN names USING (cluster_id)""")
def k11_cluster_summaries(s: SparkSession, d: str) -> DataFrame:
    return K.summaries(nodes(s, d), edges(s, d), members(s, d)).withColumn("key_entities", F.array_join("key_entities", "|")).drop("key_relations")


_ACTORS = f"""{INNER}, ends AS (SELECT source AS id, edge_idx * 2 AS o FROM edges UNION ALL SELECT target, edge_idx * 2 + 1 FROM edges), deg AS (SELECT id, count(*) AS connections, min(o) AS first FROM ends GROUP BY id),
actors AS (SELECT * FROM (SELECT cluster_id, node_id, connections, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY connections DESC, first) AS INTEGER) AS rank FROM members JOIN deg ON id = node_id) WHERE rank <= 10),
rels AS (SELECT * FROM (SELECT cluster_id, relationship_type, n, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS INTEGER) AS rank FROM (SELECT cluster_id, relationship_type, count(*) AS n, min(edge_idx) AS first FROM inner_edges GROUP BY ALL)) WHERE rank <= 10)"""


@query("k14_top_actors", f"WITH {_ACTORS} SELECT * FROM actors")
def k14_top_actors(s: SparkSession, d: str) -> DataFrame:
    return K.top_actors(edges(s, d), members(s, d))


@query("k15_top_relationships", f"WITH {_ACTORS} SELECT * FROM rels")
def k15_top_relationships(s: SparkSession, d: str) -> DataFrame:
    return K.top_relationships(K.internal_edges(edges(s, d), members(s, d)))


_REPORT = f"""{_ACTORS}, n AS (SELECT cluster_id, count(*) AS node_count FROM members GROUP BY cluster_id), e AS (SELECT cluster_id, count(*) AS edge_count FROM inner_edges GROUP BY cluster_id),
kinds AS (SELECT cluster_id, type, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(node_idx)) AS r FROM members JOIN nodes ON id = node_id GROUP BY cluster_id, type),
base AS (SELECT n.cluster_id, node_count, COALESCE(edge_count, 0) AS edge_count, CASE WHEN node_count < 2 THEN 0 ELSE COALESCE(edge_count, 0) / (node_count * (node_count - 1)) END AS density, type, relationship_type AS rel
  FROM n LEFT JOIN e USING (cluster_id) LEFT JOIN (SELECT * FROM kinds WHERE r = 1) k USING (cluster_id) LEFT JOIN (SELECT * FROM rels WHERE rank = 1) x USING (cluster_id)),
reports AS (SELECT cluster_id, node_count, edge_count, density, 'Cluster ' || cluster_id || ' contains ' || node_count || ' entities primarily of type ''' || type || ''' with ' || edge_count || ' internal relationships.' || CASE WHEN rel IS NULL THEN '' ELSE ' The most common relationship type is ''' || rel || '''.' END AS summary,
  concat_ws('|', type || '-centric', CASE WHEN rel = 'works_with' THEN 'work networks' ELSE rel || ' networks' END, CASE WHEN density > 0.5 THEN 'highly connected' WHEN density < 0.2 THEN 'loosely connected' END) AS themes FROM base)"""


@query("k13_community_reports", f"WITH {_REPORT} SELECT r.*, (SELECT string_agg(node_id || ':' || connections, '|' ORDER BY rank) FROM actors a WHERE a.cluster_id = r.cluster_id) AS actors FROM reports r")
def k13_community_reports(s: SparkSession, d: str) -> DataFrame:
    r = K.reports(nodes(s, d), edges(s, d), members(s, d))
    actors = F.array_join(F.transform("top_actors", lambda a: F.concat_ws(":", a["node_id"], a["connections"].cast("string"))), "|")
    return r.select("cluster_id", "node_count", "edge_count", "density", "summary", F.array_join("themes", "|").alias("themes"), actors.alias("actors"))


@query("k16_themes", f"WITH {_REPORT} SELECT cluster_id, themes FROM reports")
def k16_themes(s: SparkSession, d: str) -> DataFrame:
    return K.reports(nodes(s, d), edges(s, d), members(s, d), actors=False).select("cluster_id", F.array_join("themes", "|").alias("themes"))


@query("k17_summary_sentences", f"WITH {_REPORT} SELECT cluster_id, summary FROM reports")
def k17_summary_sentences(s: SparkSession, d: str) -> DataFrame:
    return K.reports(nodes(s, d), edges(s, d), members(s, d), actors=False).select("cluster_id", "summary")


# Metrics

_SETS = """ee AS (SELECT DISTINCT l_returnflag AS ex, l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_quantity > 25), ep AS (SELECT DISTINCT l_returnflag AS ex, l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_discount > {cut}),
re AS (SELECT DISTINCT l_returnflag AS ex, l_orderkey AS a, l_linenumber AS b FROM lineitem WHERE l_tax > 0.04), rp AS (SELECT DISTINCT l_returnflag AS ex, l_orderkey AS a, l_linenumber AS b FROM lineitem WHERE l_discount > {cut}),
ec AS (SELECT ex, count(*) AS c FROM ee SEMI JOIN ep USING (ex, a, b) GROUP BY ex), rc AS (SELECT ex, count(*) AS c FROM re SEMI JOIN rp USING (ex, a, b) GROUP BY ex),
x AS (SELECT ex, (SELECT count(*) FROM ee WHERE ee.ex = g.ex) AS ee, (SELECT count(*) FROM ep WHERE ep.ex = g.ex) AS ep, COALESCE(ec.c, 0) AS ec, (SELECT count(*) FROM re WHERE re.ex = g.ex) AS re, (SELECT count(*) FROM rp WHERE rp.ex = g.ex) AS rp, COALESCE(rc.c, 0) AS rc
  FROM (SELECT DISTINCT l_returnflag AS ex FROM lineitem) g LEFT JOIN ec USING (ex) LEFT JOIN rc USING (ex))"""
_PRF = """p AS (SELECT *, CASE WHEN ep > 0 THEN ec / ep ELSE 0 END AS epr, CASE WHEN ee > 0 THEN ec / ee ELSE 0 END AS ere, CASE WHEN rp > 0 THEN rc / rp ELSE 0 END AS rpr, CASE WHEN re > 0 THEN rc / re ELSE 0 END AS rre FROM {src}),
f AS (SELECT {keys} 0.6 * epr + 0.4 * rpr AS precision, 0.6 * ere + 0.4 * rre AS recall, 0.6 * CASE WHEN epr + ere > 0 THEN 2 * epr * ere / (epr + ere) ELSE 0 END + 0.4 * CASE WHEN rpr + rre > 0 THEN 2 * rpr * rre / (rpr + rre) ELSE 0 END AS f1,
  CASE WHEN ee + re > 0 THEN (ec + rc) / (ee + re) ELSE 0 END AS accuracy FROM p)"""
_ALL = "SELECT sum(ee) AS ee, sum(ep) AS ep, sum(ec) AS ec, sum(re) AS re, sum(rp) AS rp, sum(rc) AS rc FROM x"


def _combined(s: SparkSession, d: str, cut: float, by: list[str] | None = None) -> DataFrame:
    """Deliveries of large quantity stand for expected entities, taxed lines for expected relations, discounted ones for predictions."""
    t = table(s, d, "lineitem").withColumnRenamed("l_returnflag", "example")
    pick = lambda cond, a, b: t.where(cond).select("example", F.col(a).alias("a"), F.col(b).alias("b"))
    keys = [*([] if by else ["example"]), "a", "b"]
    e = M.set_counts(pick("l_quantity > 25", "l_suppkey", "l_partkey"), pick(f"l_discount > {cut}", "l_suppkey", "l_partkey"), keys, by)
    r = M.set_counts(pick("l_tax > 0.04", "l_orderkey", "l_linenumber"), pick(f"l_discount > {cut}", "l_orderkey", "l_linenumber"), keys, by)
    return M.combined(e, r, by)


@query("m1_metrics", f"WITH {_SETS.format(cut=0.05)}, {_PRF.format(src=f'({_ALL})', keys='')} SELECT * FROM f")
def m1_metrics(s: SparkSession, d: str) -> DataFrame:
    return _combined(s, d, 0.05)


def _one(cut: float, t: str) -> str:
    return f"{t} AS (WITH {_SETS.format(cut=cut)}, {_PRF.format(src=f'({_ALL})', keys='')} SELECT * FROM f)"


@query("m2_compare", f"""WITH {_one(0.05, 'b')}, {_one(0.02, 'c')}, l AS (SELECT unnest(['precision', 'recall', 'f1', 'accuracy']) AS metric, unnest([b.precision, b.recall, b.f1, b.accuracy]) AS before, unnest([c.precision, c.recall, c.f1, c.accuracy]) AS after FROM b, c)
SELECT metric, before, after, after - before AS difference, CASE WHEN before > 0 THEN (after - before) / before * 100 ELSE 0 END AS percent FROM l""")
def m2_compare(s: SparkSession, d: str) -> DataFrame:
    return M.compared(_combined(s, d, 0.05), _combined(s, d, 0.02))


@query("m3_macro_average", f"WITH {_SETS.format(cut=0.05)}, {_PRF.format(src='x', keys='ex,')} SELECT avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, avg(accuracy) AS accuracy FROM f")
def m3_macro_average(s: SparkSession, d: str) -> DataFrame:
    return M.macro(_combined(s, d, 0.05, ["example"]))


_KNN10 = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
knn AS (SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.e, b.e), 9) DESC, b.vec_id) AS rank FROM v a, v b WHERE a.vec_id <> b.vec_id AND a.vec_id % 100 = 0) WHERE rank <= 10)"""


@query("m4_retrieval", f"WITH {_KNN10}, want AS (SELECT a.vec_id AS query, b.vec_id AS id FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), hit AS (SELECT query, count(*) AS hits FROM knn SEMI JOIN want USING (query, id) GROUP BY query), n AS (SELECT query, count(*) AS got FROM knn GROUP BY query), w AS (SELECT query, count(*) AS want FROM want GROUP BY query) SELECT round(avg(COALESCE(hits, 0) / got), 9) AS precision_at_k, round(avg(COALESCE(hits, 0) / want), 9) AS recall_at_k FROM n FULL JOIN w USING (query) LEFT JOIN hit USING (query)")
def m4_retrieval(s: SparkSession, d: str) -> DataFrame:
    """Every hundredth vector asks for its ten nearest; those of its label are expected."""
    v = table(s, d, "embeddings")
    got = V.knn(v.where("vec_id % 100 = 0"), v, 10).select(F.col("query_id").alias("query"), F.col("vec_id").alias("id"))
    return M.retrieval_by_class(got, v.select(F.col("vec_id").alias("id"), F.col("label").alias("class")))


@query("m5_entity_coverage", "WITH t AS (SELECT lower(text) AS t FROM conversations WHERE text IS NOT NULL), names AS (SELECT DISTINCT lower(w) AS name FROM (SELECT unnest(list_filter(list_transform(regexp_extract_all(text, '\\S+'), lambda w: regexp_extract(w, '^([A-Z][a-z]{3,})[.,;:!?]*$', 1)), lambda w: w <> '')) AS w FROM benchmark)), f AS (SELECT count(*) AS found FROM names WHERE EXISTS (SELECT 1 FROM t WHERE contains(t, name))), c AS (SELECT count(*) AS chunks FROM conversations), n AS (SELECT count(*) AS names FROM names), p AS (SELECT found, chunks, names, CASE WHEN chunks > 0 THEN found / chunks ELSE 0 END AS precision, CASE WHEN names > 0 THEN found / names ELSE 0 END AS recall FROM f, c, n) SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM p")
def m5_entity_coverage(s: SparkSession, d: str) -> DataFrame:
    """Names of the benchmark's items, looked for in all turns of all conversations."""
    from graphloom.sources.textgraph import found_names

    names = table(s, d, "benchmark").select(F.explode(found_names(F.col("text"))).alias("m")).select("m.name").distinct()
    return M.coverage(table(s, d, "conversations").select("text"), names)


@query("m6_failures", f"""WITH {MENTIONS}, e AS (SELECT source AS dataset, avg(CASE WHEN regexp_matches(text, '[.!?]\\s*$') THEN 0 ELSE 1 END) AS violation FROM chunks GROUP BY source), q AS (SELECT source AS dataset, CAST(count(DISTINCT name) AS DOUBLE) / count(*) AS precision FROM mentions JOIN documents USING (doc_id) GROUP BY source)
SELECT dataset, 'entity boundary violations' AS failure, violation AS value FROM e WHERE violation > 0.1 UNION ALL SELECT dataset, 'low retrieval precision', COALESCE(precision, 1) FROM e LEFT JOIN q USING (dataset) WHERE COALESCE(precision, 1) < 0.5""")
def m6_failures(s: SparkSession, d: str) -> DataFrame:
    """Sources compared by the share of chunks that end inside a sentence, and of names that are distinct."""
    c = chunks(s, d)
    e = c.groupBy(F.col("source").alias("dataset")).agg(F.avg(F.when(F.regexp_replace("text", r"\s+$", "").rlike(r"[.!?]$"), 0).otherwise(1)).alias("violation"))
    q = mentions(c).join(table(s, d, "documents").select("doc_id", F.col("source").alias("dataset")), "doc_id").groupBy("dataset").agg((F.count_distinct("name") / F.count(F.lit(1))).alias("precision"))
    return M.failures(e.join(q, "dataset", "left"))
