"""Readers and writers (S1-S15): texts, schemas, graphs, reports, vector tables, property-graph sinks."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row a file, read as UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_schema(path: str) -> dict:
    """A schema file of either form, with its relations and entity types as lists of rows.

    A missing file raises FileNotFoundError, bad JSON ValueError. source and target are read for src and dst.
    """
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is no valid JSON: {e}") from e

    def relation(group: str | None, r: dict) -> dict:
        return {"group": group, "name": r["name"], "src": r.get("src", r.get("source")), "dst": r.get("dst", r.get("target")), "description": r.get("description", ""), "detail": r.get("detail", "")}

    if "entity_types" in raw:
        types = [{"name": t["name"], "description": t.get("description", ""), "examples": t.get("examples", []), "properties": t.get("properties", {})} for t in raw["entity_types"]]
        return {"form": "enhanced", "entity_types": types, "relations": [relation(g["name"], r) for g in raw.get("relation_groups", []) for r in g.get("relations", [])], "auto_discovery": raw.get("auto_discovery", False)}
    types = [{"name": e["name"] if isinstance(e, dict) else e, "description": "", "examples": [], "properties": {}} for e in raw.get("entities", [])]
    return {"form": "legacy", "entity_types": types, "relations": [relation(None, r) for r in raw.get("relations", [])], "auto_discovery": False}


def with_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """S3: nodes (id, type) and, without type, the endpoints that are no nodes."""
    from graphloom.operators.graph import endpoints

    return nodes.unionByName(endpoints(edges).join(nodes, "id", "left_anti").withColumn("type", F.lit(None).cast("string")))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and clusters of a graph file, with defaults for what is left out."""
    schema = "nodes array<struct<id:string,type:string,properties:map<string,string>,metadata:map<string,string>>>, edges array<struct<source:string,target:string,relationship_type:string,relationship_detail:string,metadata:map<string,string>>>, clusters array<struct<id:string,node_ids:array<string>,metadata:map<string,string>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    rows = lambda c: raw.select(F.explode(F.coalesce(c, F.array())).alias("r")).select("r.*")
    edges = rows("edges").withColumn("relationship_detail", F.coalesce("relationship_detail", F.concat_ws(" ", "source", "relationship_type", "target")))
    return with_endpoints(rows("nodes").select("id", "type"), edges), edges, rows("clusters")


def save_json(payload: object, path: str) -> None:
    """One JSON document written by the driver (results of the size of a report); folders are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, ensure_ascii=False, indent=2), "utf-8")


def save_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines, written by the executors."""
    reports.write.mode("overwrite").json(path)


def property_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id, the last one wins; labels are Entity and the type."""
    from graphloom.operators.graph import last_wins

    return last_wins(nodes, ["id"], "node_idx").withColumn("labels", F.concat_ws("|", F.lit("Entity"), "type"))


def property_edges(edges: DataFrame) -> DataFrame:
    """One row for (source, label, target), the last one wins (of equal edge_idx the heaviest); weight is confidence, else weight, else 1."""
    label = F.upper(F.replace(F.coalesce("relationship_type", F.lit("relates to")), F.lit(" "), F.lit("_")))
    return edges.withColumn("label", label).groupBy("source", "label", "target").agg(F.max(F.struct("edge_idx", F.coalesce("confidence", "weight", F.lit(1.0)).alias("w")))["w"].alias("weight"))


def property_clusters(clusters: DataFrame) -> DataFrame:
    """Membership rows of clusters (cluster_id, node_ids)."""
    return clusters.select("cluster_id", F.explode("node_ids").alias("node_id"), F.lit("MEMBER_OF").alias("label"))


def write_property_graph(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, path: str, clear_existing: bool = False) -> None:
    """The three tables of a property graph as Parquet, the form that bulk loaders take."""
    mode = "overwrite" if clear_existing else "append"
    property_nodes(nodes).write.mode(mode).parquet(f"{path}/nodes")
    property_edges(edges).write.mode(mode).partitionBy("label").parquet(f"{path}/edges")
    property_clusters(clusters).write.mode(mode).parquet(f"{path}/members")
