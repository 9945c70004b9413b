"""The service surface (A1-A8, N6) as plain Python over DataFrames, and the command line. No server is started.

Results that a caller reads at once (one query's answer, statistics, a page of reports) are collected; whole graphs are
handed out as DataFrames, or written by the executors.
"""

from __future__ import annotations

import argparse
import json
import os
import random
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import clusters as K
from graphloom.operators import exports as E
from graphloom.operators import extraction as X
from graphloom.operators import graph as G
from graphloom.operators import relations as REL
from graphloom.operators import retrieval as R
from graphloom.operators.chunking import create_chunker
from graphloom.operators.schema import CLI_DEFAULT, EntityType, Relation, Schema
from graphloom.sources import files, textgraph


def standard_types(edges: DataFrame) -> DataFrame:
    """Relations outside the taxonomy become related_to, their own name kept in the detail."""
    known = F.col("relationship_type").isin(*(t for t, _ in REL.TYPES))
    detail = F.when(known, F.col("relationship_detail")).otherwise(F.concat("relationship_type", F.lit(": "), "relationship_detail"))
    return edges.select("edge_idx", "source", "target", F.when(known, F.col("relationship_type")).otherwise("related_to").alias("relationship_type"), detail.alias("relationship_detail"))


@dataclass
class Throttle:
    """At least `interval` seconds between calls of one worker, and a repeatable jitter."""

    interval: float = 0.0
    jitter: float = 0.0
    seed: int = 0
    _last: float = field(default=0.0, repr=False)

    def wait(self, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic) -> float:
        pause = max(0.0, self._last + self.interval + random.Random(self.seed).random() * self.jitter - now()) if self._last else 0.0
        if pause:
            sleep(pause)
        self._last = now()
        self.seed += 1
        return pause


@dataclass
class ModelConfig:
    """Which model an extractor plug-in calls; keys stay in the environment and never enter a plan."""

    model: str = "offline"
    temperature: float = 0.0

    @classmethod
    def from_env(cls) -> ModelConfig:
        name = os.environ.get("GRAPHLOOM_MODEL", "offline").strip()
        if "/" not in name and name != "offline":
            name = ("gemini/" if name.startswith("gemini") else "openai/") + name
        return cls(name, float(os.environ.get("GRAPHLOOM_TEMPERATURE", "0")))

    def key_name(self) -> str | None:
        provider = self.model.partition("/")[0]
        return f"{provider.upper()}_API_KEY" if provider in ("gemini", "openai", "openrouter") else None


def extract(docs: DataFrame, schema: Schema, preset: str = "small", resolve: bool = True) -> tuple[DataFrame, DataFrame]:
    """Entities (doc_id, name, type) and triples (doc_id, source, relation, target, idx) of docs (doc_id, text), held to the schema."""
    c = create_chunker(preset=preset)(docs)
    types, relations = schema.tables(docs.sparkSession)
    m = textgraph.mentions(c)
    typed = X.first_types(m, types)
    t = X.gate(textgraph.triples(c), typed, relations).select("doc_id", "idx", "source", "relation", "target")
    if not resolve:
        return typed, X.distinct_triples(t, ("doc_id",))
    names = m.groupBy("doc_id", "name").agg(F.min("idx").alias("idx")).join(typed, ["doc_id", "name"])
    return typed, X.map_relations(t, X.resolve(names).select("doc_id", "name", "canonical"))


class GraphService:
    """A graph with its clusters and the answers given so far."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, members: DataFrame | None = None) -> None:
        self.nodes, self.edges = nodes, edges
        self.members = K.ensure_clusters(nodes, edges) if members is None else members
        self.answers: dict[str, tuple[DataFrame, DataFrame]] = {}

    def graph(self) -> DataFrame:
        return E.json_rows(self.nodes, self.edges, self.members)

    def stats(self) -> list[dict]:
        return [r.asDict() for r in G.statistics(self.nodes, self.edges).collect()]

    def communities(self) -> DataFrame:
        return K.reports(self.nodes, self.edges, self.members)

    def community(self, cluster_id: str) -> dict:
        row = self.communities().where(F.col("cluster_id") == cluster_id).first()
        if row is None:
            raise KeyError(cluster_id)
        return row.asDict(recursive=True)

    def visualization(self, shape: str) -> tuple[DataFrame, DataFrame]:
        e = self.edges if "relationship_detail" in self.edges.columns else self.edges.withColumn("relationship_detail", F.concat_ws(" ", "source", "relationship_type", "target"))
        if shape == "cytoscape":
            return E.cytoscape_nodes(self.nodes, e, self.members), E.cytoscape_edges(e)
        if shape in ("vis", "vis-network"):
            return E.vis_nodes(self.nodes, e, self.members), E.vis_edges(e)
        if shape == "d3":
            placed = E.d3_nodes(self.nodes, e, self.members)
            return placed, E.d3_links(placed, e)
        raise ValueError(f"unknown format {shape}")

    def query(self, text: str, k_entities: int = 10) -> dict:
        """An empty query is a ValueError; the answer's provenance is kept under its id."""
        if not (text or "").strip():
            raise ValueError("the query is empty")
        r = R.execute_query(self.nodes, self.edges, text.strip(), k_entities, max(20, 6 * k_entities))
        key = f"q{len(self.answers) + 1}"
        self.answers[key] = R.query_provenance(r, text.strip())
        return {"id": key, "answer": r.answer, "seeds": [x["id"] for x in r.seeds.orderBy("rank").collect()], "entities": sorted((x["id"] for x in r.entities.collect()), key=str.lower), "edges": [x.asDict() for x in r.edges.orderBy("edge_idx").collect()]}

    def provenance(self, key: str) -> tuple[DataFrame, DataFrame]:
        return self.answers[key]

    def sync(self, path: str, clear_existing: bool = False) -> None:
        """To a property-graph folder."""
        e = self.edges.withColumns({"confidence": F.lit(None).cast("double"), "weight": F.lit(None).cast("double")})
        files.write_property_graph(self.nodes, e, self.members.groupBy("cluster_id").agg(F.collect_list("node_id").alias("node_ids")), path, clear_existing)


class ToolServer:
    """JSON-RPC tools over schemas, texts and graphs."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.schemas: dict[str, Schema] = {}
        self.graphs: dict[str, GraphService] = {}
        self.tools = {"define_schema": self._define_schema, "extract": self._extract, "build_kg": self._build_kg, "get_kg": self._get_kg, "export_kg": self._export_kg, "list_schemas": lambda: sorted(self.schemas), "get_schema": self._get_schema}

    def handle(self, request: dict) -> dict:
        out: dict[str, Any] = {"jsonrpc": "2.0", "id": request.get("id")}
        method, params = request.get("method"), request.get("params") or {}
        try:
            if method == "list_tools":
                out["result"] = list(self.tools)
            elif method in self.tools:
                out["result"] = self.tools[method](**params)
            else:
                out["error"] = {"code": -32601, "message": f"no method {method}"}
        except (ValueError, KeyError, TypeError) as e:
            out["error"] = {"code": -32602, "message": str(e)}
        except Exception as e:  # noqa: BLE001 - the protocol reports every failure
            out["error"] = {"code": -32603, "message": str(e)}
        return out

    def _define_schema(self, name: str, entities: list[str], relations: list[dict]) -> dict:
        self.schemas[name] = Schema([EntityType(e) for e in entities], [Relation(*map(r.__getitem__, ("name", "src", "dst")), r.get("description", "")) for r in relations])
        return self.schemas[name].summary()

    def _get_schema(self, name: str) -> dict:
        return self.schemas[name].summary()

    def _extract(self, text: str, schema: str) -> dict:
        docs = self.spark.createDataFrame([(0, text)], "doc_id long, text string")
        e, t = extract(docs, self.schemas[schema])
        return {"entities": sorted((r["name"], r["type"]) for r in e.collect()), "relations": [tuple(r) for r in t.orderBy("idx").select("source", "relation", "target").collect()]}

    def _build_kg(self, name: str, entities: list, relations: list) -> dict:
        ids = {e[0] for e in entities}
        for s, _, t in relations:
            if s not in ids or t not in ids or s == t:
                raise ValueError(f"an endpoint of {s} -> {t} is missing, or both are one")
        n = self.spark.createDataFrame([(i, *e) for i, e in enumerate(dict.fromkeys(map(tuple, entities)))], "node_idx long, id string, type string")
        e = self.spark.createDataFrame([(i, s, t, r, f"{s} {r} {t}") for i, (s, r, t) in enumerate(relations)], "edge_idx long, source string, target string, relationship_type string, relationship_detail string")
        self.graphs[name] = GraphService(G.last_wins(n, ["id"], "node_idx").withColumn("node_idx", F.xxhash64("id")) if len(ids) < len(entities) else n, standard_types(e))
        return {"nodes": len(ids), "edges": len(relations)}

    def _get_kg(self, name: str) -> list[dict]:
        return self.graphs[name].stats()

    def _export_kg(self, name: str, format: str = "json") -> list:  # noqa: A002
        g = self.graphs[name]
        frames = {"json": [g.graph()], "jsonld": [E.json_ld_nodes(g.nodes), E.json_ld_edges(g.edges)], "graphrag": [E.legacy_nodes(g.nodes), E.graphrag_relationships(g.edges)]}
        if format not in frames:
            raise ValueError(f"unknown format {format}")
        return [r.asDict(recursive=True) for f in frames[format] for r in f.collect()]


def main(argv: list[str] | None = None) -> int:
    """A text file, or - for standard input, to a graph as JSON."""
    p = argparse.ArgumentParser(prog="graphloom", description="Extract a knowledge graph from a text.")
    p.add_argument("input")
    p.add_argument("-o", "--output")
    p.add_argument("-s", "--schema")
    args = p.parse_args(argv)
    from graphloom.sources.session import local_session

    spark = local_session()
    text = sys.stdin.read() if args.input == "-" else Path(args.input).read_text(encoding="utf-8")
    schema = Schema.load(args.schema) if args.schema else CLI_DEFAULT
    entities, triples = extract(spark.createDataFrame([(0, text)], "doc_id long, text string"), schema)
    out = {"nodes": [{"id": r["name"], "type": r["type"]} for r in entities.orderBy("name").collect()], "edges": [{"source": r["source"], "type": r["relation"], "target": r["target"]} for r in triples.orderBy("idx").collect()]}
    if args.output:
        files.save_json(out, args.output)
    else:
        print(json.dumps(out, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
