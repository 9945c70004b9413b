"""Export shapes of a graph (E1-E11): every one a projection with joins, so it is written by the executors.

nodes: node_idx, id, type; edges: edge_idx, source, relationship_type, target, relationship_detail, and optionally
confidence, weight, source_ref; members: cluster_id, node_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.graph import degrees, positions


def _colours(text: str) -> dict[str, str]:
    return {k: f"#{v}" for k, _, v in (pair.partition("=") for pair in text.split())}


NODE_COLOURS = _colours("Company=95E1D3 Event=FFE66D Location=4ECDC4 Organization=95E1D3 Person=FF6B6B Product=F38181")
EDGE_COLOURS = _colours("caused_by=4ECDC4 collaborates_with=FFE66D influences=FF6B6B located_at=95E1D3 works_with=FFE66D")
PROVENANCE_COLOURS = _colours("answer=F38181 chunk=4ECDC4 community=FFE66D query=FF6B6B summary=95E1D3")
NODE_DEFAULT, EDGE_DEFAULT = "#A8A8A8", "#CCCCCC"
PALETTE = tuple(f"#{c}" for c in "FF6B6B 4ECDC4 FFE66D 95E1D3 F38181 A8E6CF FFD3B6 FFAAA5 FF8B94 C7CEEA".split())


def colour(value: Column, table: dict[str, str], default: str) -> Column:
    """E10"""
    out = None
    for k, v in table.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return default if out is None else out.otherwise(default)


def cluster_colours(members: DataFrame) -> DataFrame:
    """(cluster_id, colour), the palette in order of cluster_id."""
    ids = members.select("cluster_id").distinct().withColumn("i", F.row_number().over(Window.orderBy("cluster_id")) - 1)  # one row a cluster
    return ids.select("cluster_id", F.element_at(F.array(*map(F.lit, PALETTE)), (F.col("i") % len(PALETTE) + 1).cast("int")).alias("colour"))


def first_cluster(members: DataFrame) -> DataFrame:
    """(id, community): the first cluster that holds a node."""
    return members.groupBy(F.col("node_id").alias("id")).agg(F.min("cluster_id").alias("community"))


def edge_weight(edges: DataFrame) -> Column:
    known = [F.col(c) for c in ("confidence", "weight") if c in edges.columns]
    return F.coalesce(*known, F.lit(1.0)).cast("double")


def _connected(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    kind = F.coalesce("type", F.lit("Unknown"))
    return nodes.join(degrees(edges), "id").join(first_cluster(members), "id", "left").withColumn("type", kind)


def legacy_nodes(nodes: DataFrame) -> DataFrame:
    """E1"""
    return nodes.select("id", "type")


def json_rows(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(kind, json), a JSON object for each node, edge and cluster; null fields are left out."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*[c for c in nodes.columns if c != "node_idx"])).alias("json"))
    e = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*[c for c in edges.columns if c != "edge_idx"])).alias("json"))
    c = members.groupBy("cluster_id").agg(F.array_sort(F.collect_list("node_id")).alias("node_ids"))
    return n.unionByName(e).unionByName(c.select(F.lit("cluster").alias("kind"), F.to_json(F.struct(F.col("cluster_id").alias("id"), "node_ids")).alias("json")))


def graphrag_relationships(edges: DataFrame) -> DataFrame:
    """Of the metadata only confidence and source_ref."""
    keep = [c for c in ("confidence", "source_ref") if c in edges.columns]
    return edges.select("source", "target", "relationship_type", "relationship_detail", *keep)


def json_ld_nodes(nodes: DataFrame) -> DataFrame:
    """(at_id, at_type, identifier, properties), properties under kg:prop/."""
    props = F.create_map(F.lit("name"), F.col("name")) if "name" in nodes.columns else F.create_map()
    return nodes.select(F.concat(F.lit("kg:node/"), "id").alias("at_id"), F.coalesce("type", F.lit("Thing")).alias("at_type"), F.col("id").alias("identifier"), F.transform_keys(props, lambda k, v: F.concat(F.lit("kg:prop/"), k)).alias("properties"))


def json_ld_edges(edges: DataFrame) -> DataFrame:
    """E4"""
    at = lambda c: F.concat(F.lit("kg:node/"), c)
    return edges.select(F.concat(F.lit("kg:edge/"), "source", F.lit("-"), "target").alias("at_id"), F.lit("Relationship").alias("at_type"), at("source").alias("source"), at("target").alias("target"), "relationship_type", "relationship_detail")


def cytoscape_nodes(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """E5: connected nodes; weight is the degree between 1 and 10."""
    return _connected(nodes, edges, members).select("id", F.col("id").alias("label"), "type", F.col("degree").alias("connection_count"), F.greatest(F.lit(1), F.least(F.lit(10), "degree")).cast("long").alias("weight"), colour(F.col("type"), NODE_COLOURS, NODE_DEFAULT).alias("colour"), "community")


def cytoscape_edges(edges: DataFrame) -> DataFrame:
    """E5: width is five times the weight, between 3 and 10."""
    w = edge_weight(edges)
    return edges.select(F.concat("source", F.lit("-"), "target").alias("id"), "source", "target", F.col("relationship_type").alias("label"), w.alias("weight"), F.greatest(F.lit(3.0), F.least(F.lit(10.0), w * 5)).alias("width"), colour(F.col("relationship_type"), EDGE_COLOURS, EDGE_DEFAULT).alias("colour"))


def vis_nodes(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """E6"""
    return _connected(nodes, edges, members).select("id", F.col("id").alias("label"), F.concat(F.lit("Type: "), "type", F.lit("\nID: "), "id").alias("title"), colour(F.col("type"), NODE_COLOURS, NODE_DEFAULT).alias("colour"), F.col("community").alias("group"))


def vis_edges(edges: DataFrame) -> DataFrame:
    """E6"""
    return edges.select(F.concat("source", F.lit("-"), "target").alias("id"), F.col("source").alias("from"), F.col("target").alias("to"), F.col("relationship_type").alias("label"), F.concat("relationship_type", F.lit("\n"), "relationship_detail").alias("title"), edge_weight(edges).alias("value"))


def d3_nodes(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(position, id, type, group): positions from 0 in node order, found by range counts and not by a global sort."""
    c = _connected(nodes, edges, members)
    return positions(c, F.col("node_idx"), "node_idx", "position").select(F.col("position").cast("long").alias("position"), "id", "type", F.coalesce("community", F.lit("0")).alias("group"))


def d3_links(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between positions."""
    side = lambda c, p: placed.select(F.col("id").alias(c), F.col("position").alias(p))
    w = edge_weight(edges)
    return edges.join(side("source", "a"), "source").join(side("target", "b"), "target").select("edge_idx", F.col("a").alias("source"), F.col("b").alias("target"), w.alias("value"), F.col("relationship_type").alias("type"))


def provenance_elements(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A provenance graph as elements; width is three times the weight, between 1 and 5."""
    n = nodes.select("id", "label", "type", colour(F.col("type"), PROVENANCE_COLOURS, NODE_DEFAULT).alias("colour"))
    return n, edges.select(F.concat("source", F.lit("-"), "target").alias("id"), "source", "target", "type", F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.col("weight") * 3)).alias("width"))


def mermaid_lines(nodes: DataFrame, edges: DataFrame, direction: str = "TD") -> DataFrame:
    """(part, idx, line): the lines of a diagram, in order of part and idx."""
    placed = positions(nodes, F.col("node_idx"), "node_idx", "position")
    safe = F.concat(F.lit("N"), F.col("position").cast("long").cast("string"))
    label = F.replace(F.concat("id", F.lit("<br/>("), F.coalesce("type", F.lit("Entity")), F.lit(")")), F.lit('"'), F.lit("'"))
    style = F.concat(F.lit("    classDef style_"), safe, F.lit(" fill:"), colour(F.col("type"), NODE_COLOURS, NODE_DEFAULT), F.lit(",stroke:#333,stroke-width:2px"))
    head = nodes.sparkSession.createDataFrame([(0, 0, f"graph {direction}")], "part int, idx long, line string")
    n = placed.select(F.lit(1).alias("part"), F.col("position").cast("long").alias("p"), F.explode(F.array(F.concat(F.lit("    "), safe, F.lit('["'), label, F.lit('"]')), style, F.concat(F.lit("    class "), safe, F.lit(" style_"), safe))).alias("line"))
    n = n.select("part", F.col("p").alias("idx"), "line")
    side = lambda c, p: placed.select(F.col("id").alias(c), F.concat(F.lit("N"), F.col("position").cast("long").cast("string")).alias(p))
    rel = F.left(F.replace("relationship_type", F.lit('"'), F.lit("'")), F.lit(20))
    text = F.when(F.length("relationship_detail") <= 50, F.concat(rel, F.lit("\\n("), "relationship_detail", F.lit(")"))).otherwise(rel)
    e = edges.join(side("source", "a"), "source").join(side("target", "b"), "target").select(F.lit(2).alias("part"), F.col("edge_idx").alias("idx"), F.concat(F.lit("    "), "a", F.lit(' -->|"'), text, F.lit('"| '), "b").alias("line"))
    return head.unionByName(n).unionByName(e)
