"""Queries for the export shapes (E1-E11) and the graph service's own conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import exports as E
from graphloom.operators.relations import TYPES
from graphloom.plans.catalog import query
from graphloom.plans.cluster_queries import MEMBERS, members
from graphloom.plans.graph_queries import DETAIL_SQL, detail
from graphloom.plans.service import standard_types
from graphloom.plans.retrieval_queries import _TOP_CHUNKS, _provenance
from graphloom.sources.tables import EDGES_SQL, NODES_SQL, edges, nodes, table
from graphloom.sources.textgraph import MENTIONS, chunks, mentions

WEIGHTED = "we AS (SELECT 'order:' || l_orderkey AS source, 'part:' || l_partkey AS target, 'located_at' AS relationship_type, 1 - l_discount AS w FROM lineitem)"
FULL = f"{MEMBERS}, full_edges AS (SELECT *, {DETAIL_SQL} FROM edges), deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id), comm AS (SELECT node_id AS id, min(cluster_id) AS community FROM members GROUP BY ALL)"


def full_edges(s: SparkSession, d: str) -> DataFrame:
    return edges(s, d).select("*", detail())


def weighted_edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("source"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target"), F.lit("located_at").alias("relationship_type"), (1 - F.col("l_discount")).alias("confidence"))


@query("e1_legacy_nodes", f"SELECT id, type FROM ({NODES_SQL})")
def e1_legacy_nodes(s: SparkSession, d: str) -> DataFrame:
    return E.legacy_nodes(nodes(s, d))


@query("e2_json_rows")
def e2_json_rows(s: SparkSession, d: str) -> DataFrame:
    return E.json_rows(nodes(s, d), full_edges(s, d), members(s, d))


@query("e3_graphrag_relationships", f"SELECT source, target, relationship_type, {DETAIL_SQL} FROM ({EDGES_SQL})")
def e3_graphrag_relationships(s: SparkSession, d: str) -> DataFrame:
    return E.graphrag_relationships(full_edges(s, d))


@query("e4_json_ld_nodes", f"SELECT 'kg:node/' || id AS at_id, type AS at_type, id AS identifier, name FROM ({NODES_SQL})")
def e4_json_ld_nodes(s: SparkSession, d: str) -> DataFrame:
    return E.json_ld_nodes(nodes(s, d)).select("at_id", "at_type", "identifier", F.col("properties")["kg:prop/name"].alias("name"))


@query("e4_json_ld_edges", f"SELECT 'kg:edge/' || source || '-' || target AS at_id, 'Relationship' AS at_type, 'kg:node/' || source AS source, 'kg:node/' || target AS target, relationship_type, relationship_detail FROM (SELECT *, {DETAIL_SQL} FROM ({EDGES_SQL}))")
def e4_json_ld_edges(s: SparkSession, d: str) -> DataFrame:
    return E.json_ld_edges(full_edges(s, d))


@query("e5_cytoscape_nodes", f"WITH {FULL} SELECT n.id, n.id AS label, type, degree AS connection_count, greatest(1, least(10, degree)) AS weight, '{E.NODE_DEFAULT}' AS colour, community FROM nodes n JOIN deg USING (id) LEFT JOIN comm USING (id)")
def e5_cytoscape_nodes(s: SparkSession, d: str) -> DataFrame:
    return E.cytoscape_nodes(nodes(s, d), edges(s, d), members(s, d))


@query("e5_cytoscape_edges", f"WITH {WEIGHTED} SELECT source || '-' || target AS id, source, target, relationship_type AS label, w AS weight, greatest(3, least(10, w * 5)) AS width, '#95E1D3' AS colour FROM we")
def e5_cytoscape_edges(s: SparkSession, d: str) -> DataFrame:
    return E.cytoscape_edges(weighted_edges(s, d))


@query("e6_vis_nodes", f"WITH {FULL} SELECT n.id, n.id AS label, 'Type: ' || type || E'\\nID: ' || n.id AS title, '{E.NODE_DEFAULT}' AS colour, community AS group FROM nodes n JOIN deg USING (id) LEFT JOIN comm USING (id)")
def e6_vis_nodes(s: SparkSession, d: str) -> DataFrame:
    return E.vis_nodes(nodes(s, d), edges(s, d), members(s, d))


@query("e6_vis_edges", f"WITH {FULL} SELECT source || '-' || target AS id, source AS \"from\", target AS \"to\", relationship_type AS label, relationship_type || E'\\n' || relationship_detail AS title, CAST(1 AS DOUBLE) AS value FROM full_edges")
def e6_vis_edges(s: SparkSession, d: str) -> DataFrame:
    return E.vis_edges(full_edges(s, d))


_D3 = f"{FULL}, placed AS (SELECT row_number() OVER (ORDER BY node_idx) - 1 AS position, n.id, type, COALESCE(community, '0') AS group FROM nodes n JOIN deg USING (id) LEFT JOIN comm USING (id))"


@query("e7_d3_nodes", f"WITH {_D3} SELECT * FROM placed")
def e7_d3_nodes(s: SparkSession, d: str) -> DataFrame:
    return E.d3_nodes(nodes(s, d), edges(s, d), members(s, d))


@query("e7_d3_links", f"WITH {_D3} SELECT edge_idx, a.position AS source, b.position AS target, CAST(1 AS DOUBLE) AS value, relationship_type AS type FROM edges JOIN placed a ON a.id = source JOIN placed b ON b.id = target")
def e7_d3_links(s: SparkSession, d: str) -> DataFrame:
    return E.d3_links(E.d3_nodes(nodes(s, d), edges(s, d), members(s, d)), edges(s, d))


@query("e8_cluster_colours", f"WITH {MEMBERS} SELECT cluster_id, list_extract({list(E.PALETTE)}, CAST((row_number() OVER (ORDER BY cluster_id) - 1) % 10 + 1 AS BIGINT)) AS colour FROM (SELECT DISTINCT cluster_id FROM members)")
def e8_cluster_colours(s: SparkSession, d: str) -> DataFrame:
    return E.cluster_colours(members(s, d))


@query("e9_provenance_edges", f"""WITH {_TOP_CHUNKS}, e AS (SELECT 'query' AS source, 'chunk_' || (rank - 1) AS target, 'retrieved_from' AS type, score AS w FROM c WHERE rank <= 5 UNION ALL SELECT 'query', 'community_' || cluster_id, 'matched_community', 1 FROM m WHERE rank <= 5
UNION ALL SELECT 'community_' || cluster_id, 'summary_' || (rank - 1), 'summarized_in', 1 FROM m WHERE rank <= 5 UNION ALL SELECT 'summary_0', 'answer', 'generated_from', 1) SELECT source || '-' || target AS id, source, target, type, greatest(1, least(5, w * 3)) AS width FROM e""")
def e9_provenance_edges(s: SparkSession, d: str) -> DataFrame:
    return E.provenance_elements(*_provenance(s, d))[1]


@query("e10_type_colours", "SELECT doc_id, name, CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.NODE_COLOURS.items()) + f" ELSE '{E.NODE_DEFAULT}' END AS colour FROM (WITH {MENTIONS} SELECT doc_id, name, type FROM mentions)")
def e10_type_colours(s: SparkSession, d: str) -> DataFrame:
    return mentions(chunks(s, d)).select("doc_id", "name", E.colour(F.col("type"), E.NODE_COLOURS, E.NODE_DEFAULT).alias("colour"))


@query("e11_mermaid_lines", f"""WITH {FULL}, p AS (SELECT 'N' || (row_number() OVER (ORDER BY node_idx) - 1) AS safe, row_number() OVER (ORDER BY node_idx) - 1 AS position, id, type FROM nodes)
SELECT 0 AS part, CAST(0 AS BIGINT) AS idx, 'graph TD' AS line UNION ALL SELECT 1, position, '    ' || safe || '["' || id || '<br/>(' || type || ')"]' FROM p UNION ALL SELECT 1, position, '    classDef style_' || safe || ' fill:{E.NODE_DEFAULT},stroke:#333,stroke-width:2px' FROM p
UNION ALL SELECT 1, position, '    class ' || safe || ' style_' || safe FROM p UNION ALL SELECT 2, edge_idx, '    ' || a.safe || ' -->|"' || left(relationship_type, 20) || CASE WHEN length(relationship_detail) <= 50 THEN '\\n(' || relationship_detail || ')' ELSE '' END || '"| ' || b.safe FROM full_edges JOIN p a ON a.id = source JOIN p b ON b.id = target""")
def e11_mermaid_lines(s: SparkSession, d: str) -> DataFrame:
    return E.mermaid_lines(nodes(s, d), full_edges(s, d))


_ENUM = "[" + ", ".join(f"'{t}'" for t, _ in TYPES) + "]"


@query("a7_service_edges", f"SELECT edge_idx, source, target, CASE WHEN list_contains({_ENUM}, relationship_type) THEN relationship_type ELSE 'related_to' END AS relationship_type, CASE WHEN list_contains({_ENUM}, relationship_type) THEN source || ' ' || relationship_type || ' ' || target ELSE relationship_type || ': ' || source || ' ' || relationship_type || ' ' || target END AS relationship_detail FROM ({EDGES_SQL})")
def a7_service_edges(s: SparkSession, d: str) -> DataFrame:
    return standard_types(full_edges(s, d))

