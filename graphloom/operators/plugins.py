"""Extractors as plug-ins (X1, X5, X6, X17): any model behind two methods, called once a chunk on the executors.

The calls are spread by chunk. Each worker keeps its own throttle, so the total rate is the interval times the number of
workers. What an extractor returns is held to the schema here, whatever the model says: blank names, types that the
schema doesn't have and relations between names that weren't found are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.extraction import distinct_entities
from graphloom.operators.schema import Schema


class Extractor(Protocol):
    """What a model must offer. Both get the schema as instructions; relations also get the names found so far."""

    def entities(self, text: str, instructions: str) -> list[tuple[str, str]]: ...

    def relations(self, text: str, instructions: str, entities: list[tuple[str, str]]) -> list[tuple[str, str, str]]: ...


def _calls(rows: DataFrame, schema: str, call) -> DataFrame:  # noqa: ANN001
    """call(row) gives tuples of three strings; each becomes a row with its chunk and place."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                got = call(row)
                if got:
                    n = len(got)
                    cols = [pa.array(list(c), pa.string()) for c in zip(*got)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]] * n, batch.column("doc_id").type), pa.array([row["sequence_index"]] * n, pa.int32()), pa.array(range(n), pa.int32()), *cols], names=["doc_id", "sequence_index", "pos", *schema.split()])

    return rows.mapInArrow(run, f"doc_id {id_type}, sequence_index int, pos int, " + ", ".join(f"{c} string" for c in schema.split()))


def extract_entities(chunks: DataFrame, extractor: Extractor, schema: Schema, throttle=None) -> DataFrame:  # noqa: ANN001
    """First pass: (doc_id, sequence_index, pos, name, type). chunks: doc_id, sequence_index, text."""
    text, types = schema.prompt(), {t.name for t in schema.entity_types}

    def call(row: dict) -> list[tuple[str, str]]:
        if not (row["text"] or "").strip():
            return []
        if throttle is not None:
            throttle.wait()
        return [(n.strip(), t) for n, t in extractor.entities(row["text"], text) if n and n.strip() and t in types]

    return _calls(chunks.select("doc_id", "sequence_index", "text"), "name type", call)


def contexts(entities: DataFrame, chunks: DataFrame, accumulate: bool) -> DataFrame:
    """chunks with `context`: the document's distinct names (X5), or with accumulate those of the chunks so far."""
    idx = F.col("sequence_index").cast("long") * 1_000_000 + F.col("pos")
    names = distinct_entities(entities.withColumn("idx", idx), ("doc_id",)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "name", "type"))).alias("known"))
    known = F.coalesce("known", F.array().cast("array<struct<idx:bigint,name:string,type:string>>"))
    seen = F.filter(known, lambda x: F.floor(x["idx"] / 1_000_000) <= F.col("sequence_index")) if accumulate else known
    return chunks.select("doc_id", "sequence_index", "text").join(names, "doc_id", "left").select("doc_id", "sequence_index", "text", F.transform(seen, lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"))).alias("context"))


def extract_triples(chunks: DataFrame, entities: DataFrame, extractor: Extractor, schema: Schema, accumulate: bool = False, throttle=None) -> DataFrame:  # noqa: ANN001
    """Second pass: (doc_id, sequence_index, pos, source, relation, target) between names of the context."""
    text = schema.prompt()

    def call(row: dict) -> list[tuple[str, str, str]]:
        known = [(x["name"], x["type"]) for x in row["context"]]
        if not known or not (row["text"] or "").strip():
            return []
        if throttle is not None:
            throttle.wait()
        names = {n for n, _ in known}
        return [(s, r, t) for s, r, t in extractor.relations(row["text"], text, known) if s in names and t in names and r and s != t]

    return _calls(contexts(entities, chunks, accumulate), "source relation target", call)
