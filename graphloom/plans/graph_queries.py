"""Queries over the graph: construction, statistics, shaping, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.plans.catalog import query
from graphloom.sources.tables import EDGES_SQL, GRAPH, NODES_SQL, edges, nodes, table

DETAIL_SQL = "source || ' ' || relationship_type || ' ' || target AS relationship_detail"


def detail() -> Column:
    return F.concat_ws(" ", "source", "relationship_type", "target").alias("relationship_detail")


@query("g0_nodes", NODES_SQL)
def g0_nodes(s: SparkSession, d: str) -> DataFrame:
    return nodes(s, d)


@query("g0_edges", EDGES_SQL)
def g0_edges(s: SparkSession, d: str) -> DataFrame:
    return edges(s, d)


@query("g1_from_typed", f"WITH {GRAPH} SELECT id, type FROM nodes WHERE type IN ('Customer', 'Supplier') UNION ALL SELECT DISTINCT id, CAST(NULL AS VARCHAR) FROM (SELECT source AS id FROM edges UNION SELECT target FROM edges) e WHERE id NOT IN (SELECT id FROM nodes WHERE type IN ('Customer', 'Supplier'))")
def g1_from_typed(s: SparkSession, d: str) -> DataFrame:
    """Entities are given for customers and suppliers only; nations and regions come in as endpoints."""
    entities = nodes(s, d).where(F.col("type").isin("Customer", "Supplier")).select(F.col("node_idx").alias("idx"), F.col("id").alias("name"), "type")
    return G.from_typed(entities, edges(s, d))


@query("g2_from_triples", f"WITH {GRAPH} SELECT source AS id FROM edges UNION SELECT target FROM edges")
def g2_from_triples(s: SparkSession, d: str) -> DataFrame:
    return G.endpoints(edges(s, d))


@query("g3_upsert_nodes", "SELECT p_name AS id, max_by(p_type, p_partkey) AS type, max_by(p_brand, p_partkey) AS brand FROM part GROUP BY p_name")
def g3_upsert_nodes(s: SparkSession, d: str) -> DataFrame:
    """Nodes by name, the last part of a name wins."""
    parts = table(s, d, "part").select(F.col("p_name").alias("id"), "p_partkey", F.col("p_type").alias("type"), F.col("p_brand").alias("brand"))
    return G.last_wins(parts, ["id"], "p_partkey").drop("p_partkey")


@query("g3_edge_validation", f"WITH {GRAPH}, known AS (SELECT id FROM nodes WHERE type <> 'Nation') SELECT edge_idx, 'source' AS side FROM edges WHERE source NOT IN (SELECT id FROM known) UNION ALL SELECT edge_idx, 'target' FROM edges WHERE target NOT IN (SELECT id FROM known)")
def g3_edge_validation(s: SparkSession, d: str) -> DataFrame:
    return G.missing_endpoints(edges(s, d), nodes(s, d).where("type <> 'Nation'"))


RELATIONS = [(0, "located_in", "Customer", "Nation", "lives in", None), (1, "located_in", "Supplier", "Nation", "is based in", "registered seat"), (2, "supplies", "Supplier", "Part", "delivers", None), (3, "part_of", "Nation", "Region", None, None)]
RELATIONS_SQL = "relations AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in RELATIONS) + ") t(idx, name, src, dst, description, detail))"


def relations(s: SparkSession) -> DataFrame:
    return s.createDataFrame(RELATIONS, "idx int, name string, src string, dst string, description string, detail string")


@query("g4_build", f"WITH {GRAPH}, {RELATIONS_SQL}, known AS (SELECT name, arg_max(COALESCE(detail, description), idx) AS known FROM relations WHERE COALESCE(detail, description) IS NOT NULL GROUP BY name) SELECT edge_idx, source, relationship_type, target, COALESCE(known, source || ' ' || relationship_type || ' ' || target) AS relationship_detail FROM edges LEFT JOIN known ON name = relationship_type WHERE source <> target")
def g4_build(s: SparkSession, d: str) -> DataFrame:
    return G.build(edges(s, d), relations(s)).select("edge_idx", "source", "relationship_type", "target", "relationship_detail")


@query("g5_enriched_edges", "SELECT 'order:' || l_orderkey AS source, 'part:' || l_partkey AS target, 'contains' AS relationship_type, 1 - l_discount AS confidence, 'line:' || l_linenumber AS source_ref, CAST(strftime(l_shipdate, '%Y-%m-%d') AS VARCHAR) AS start_time, l_returnflag = 'R' AS is_negated FROM lineitem")
def g5_enriched_edges(s: SparkSession, d: str) -> DataFrame:
    """Edges with confidence, source reference, time and negation from order lines."""
    return table(s, d, "lineitem").select(
        F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"), F.lit("contains").alias("relationship_type"),
        (1 - F.col("l_discount")).alias("confidence"), F.concat(F.lit("line:"), F.col("l_linenumber").cast("string")).alias("source_ref"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("start_time"), (F.col("l_returnflag") == "R").alias("is_negated"),
    )


@query("g6_relationship_checks", """SELECT l_orderkey, l_linenumber, CASE WHEN source = '' THEN 'empty source' WHEN target = '' THEN 'empty target' WHEN source = target THEN 'self relation' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence out of range' END AS problem
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN '' ELSE CAST(l_suppkey AS VARCHAR) END AS source, CAST(l_partkey AS VARCHAR) AS target, l_quantity / 45 AS confidence FROM lineitem)""")
def g6_relationship_checks(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7), "").otherwise(F.col("l_suppkey").cast("string")).alias("source"), F.col("l_partkey").cast("string").alias("target"), (F.col("l_quantity") / 45).alias("confidence"))
    return G.checked_relationships(rows).select("l_orderkey", "l_linenumber", "problem")


DEGREES_SQL = "deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id)"


@query("g12_degrees", f"WITH {GRAPH}, {DEGREES_SQL} SELECT * FROM deg")
def g12_degrees(s: SparkSession, d: str) -> DataFrame:
    return G.degrees(edges(s, d))


@query("g13_statistics", f"WITH {GRAPH} SELECT 'node_type' AS kind, COALESCE(type, 'Unknown') AS label, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'relationship_type', relationship_type, count(*) FROM edges GROUP BY ALL UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges")
def g13_statistics(s: SparkSession, d: str) -> DataFrame:
    return G.statistics(nodes(s, d), edges(s, d))


HUB_SQL = f"""
WITH {GRAPH}, {DEGREES_SQL}, hubs AS (SELECT id FROM deg WHERE degree >= 60),
det AS (SELECT *, {DETAIL_SQL}, CASE WHEN source IN (SELECT id FROM hubs) THEN source WHEN target IN (SELECT id FROM hubs) THEN target END AS hub FROM edges),
split AS (
  SELECT DISTINCT CASE WHEN hub = source THEN 'hubproxy::' || hub || '::' || relationship_type ELSE source END AS source,
    CASE WHEN hub <> source THEN 'hubproxy::' || hub || '::' || relationship_type ELSE target END AS target, relationship_type, relationship_detail,
    CASE WHEN hub IS NULL THEN 'plain' ELSE 'hub_split_edge' END AS kind FROM det
  UNION ALL
  SELECT DISTINCT id, 'hubproxy::' || id || '::' || relationship_type, relationship_type, 'hub split connector', 'hub_proxy_connector'
  FROM (SELECT source AS id, relationship_type FROM edges UNION SELECT target, relationship_type FROM edges) WHERE id IN (SELECT id FROM hubs))
"""


def _split(s: SparkSession, d: str) -> DataFrame:
    return G.hub_split(edges(s, d).select("source", "target", "relationship_type", detail()), 60)


@query("g14_hub_split", HUB_SQL + "SELECT * FROM split")
def g14_hub_split(s: SparkSession, d: str) -> DataFrame:
    return _split(s, d)


@query("g15_flatten_proxies", f"WITH {GRAPH} SELECT DISTINCT source, target, relationship_type, {DETAIL_SQL} FROM edges")
def g15_flatten_proxies(s: SparkSession, d: str) -> DataFrame:
    return G.flatten_proxies(_split(s, d))


@query("x21_hub_dominance", f"WITH {GRAPH}, {DEGREES_SQL} SELECT edges, top, top / edges AS share, (edges - top) / edges AS rest, (top / edges > 0.30) OR ((edges - top) / edges < 0.50) AS dominated FROM (SELECT count(*) AS edges FROM edges), (SELECT max(degree) AS top FROM deg)")
def x21_hub_dominance(s: SparkSession, d: str) -> DataFrame:
    return G.hub_dominance(edges(s, d))


@query("k9_multiplicity", "SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS weight FROM (SELECT 'supplier:' || l_suppkey AS source, 'part:' || l_partkey AS target FROM lineitem) GROUP BY ALL")
def k9_multiplicity(s: SparkSession, d: str) -> DataFrame:
    lines = table(s, d, "lineitem").select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"))
    return G.multiplicity(lines)


@query("s3_kg_load", f"WITH {GRAPH} SELECT id, type FROM nodes WHERE type <> 'Nation' UNION ALL SELECT DISTINCT id, CAST(NULL AS VARCHAR) FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) WHERE id NOT IN (SELECT id FROM nodes WHERE type <> 'Nation')")
def s3_kg_load(s: SparkSession, d: str) -> DataFrame:
    """A graph as read from files: endpoints that are no nodes are added without type."""
    from graphloom.sources.files import with_endpoints

    return with_endpoints(nodes(s, d).where("type <> 'Nation'").select("id", "type"), edges(s, d))


@query("s7_pipeline_summary", f"WITH {GRAPH} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT count(DISTINCT type) FROM nodes) AS node_types, (SELECT count(DISTINCT relationship_type) FROM edges) AS relationship_types")
def s7_pipeline_summary(s: SparkSession, d: str) -> DataFrame:
    n = nodes(s, d).agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("type").alias("node_types"))
    e = edges(s, d).agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("relationship_type").alias("relationship_types"))
    return table(s, d, "documents").agg(F.count(F.lit(1)).alias("documents")).crossJoin(n).crossJoin(e)


@query("s9_property_nodes", f"WITH {GRAPH} SELECT id, name, 'Entity|' || type AS labels FROM nodes")
def s9_property_nodes(s: SparkSession, d: str) -> DataFrame:
    from graphloom.sources.files import property_nodes

    return property_nodes(nodes(s, d)).select("id", "name", "labels")


@query("s10_property_edges", """SELECT source, target, upper(replace('ships to', ' ', '_')) AS label, max({'i': edge_idx, 'w': confidence}).w AS weight FROM
(SELECT 'supplier:' || l_suppkey AS source, 'part:' || l_partkey AS target, 1 - l_discount AS confidence, l_orderkey * 10 + l_linenumber AS edge_idx FROM lineitem) GROUP BY source, target""")
def s10_property_edges(s: SparkSession, d: str) -> DataFrame:
    from graphloom.sources.files import property_edges

    rows = table(s, d, "lineitem").select(
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"), F.lit("ships to").alias("relationship_type"),
        (1 - F.col("l_discount")).alias("confidence"), F.lit(None).cast("double").alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_idx"),
    )
    return property_edges(rows)


@query("s11_property_clusters", f"WITH {GRAPH} SELECT target AS cluster_id, source AS node_id, 'MEMBER_OF' AS label FROM edges WHERE relationship_type = 'located_in'")
def s11_property_clusters(s: SparkSession, d: str) -> DataFrame:
    from graphloom.sources.files import property_clusters

    clusters = edges(s, d).where("relationship_type = 'located_in'").groupBy(F.col("target").alias("cluster_id")).agg(F.collect_list("source").alias("node_ids"))
    return property_clusters(clusters)


@query("s12_property_stats", f"WITH {GRAPH} SELECT 'Entity' AS kind, type AS label, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'relationship', upper(replace(relationship_type, ' ', '_')), count(*) FROM edges GROUP BY relationship_type")
def s12_property_stats(s: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1)).alias("n")
    a = nodes(s, d).groupBy(F.col("type").alias("label")).agg(n).select(F.lit("Entity").alias("kind"), "label", "n")
    return a.unionByName(edges(s, d).groupBy(F.upper(F.replace("relationship_type", F.lit(" "), F.lit("_"))).alias("label")).agg(n).select(F.lit("relationship").alias("kind"), "label", "n"))
