"""The text graph: documents as chunks, typed mentions of names in them, and triples of neighbouring mentions.

Mentions come from the offline extractor (X1): words of four letters or more with a capital, typed by how they end or
stand. All of it is native expressions without a shuffle, and is stated in SQL beside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.chunking import token_chunks
from graphloom.sources.tables import table

SIZE, OVERLAP = 256, 0.15
STEP = SIZE - int(SIZE * OVERLAP)
NAME = r"^([A-Z][a-z]{3,})[.,;:!?]*$"
#: Type by pattern, the first that fits; the last is for the rest.
TYPES = ((r"[.]$", "Location"), (r"^[A-Z][a-z]*(tion|ment|ness|heit|keit)[,;:!?]*$", "Concept"), (r"^[A-Z][a-z]*(er|or|en|ar)[,;:!?]*$", "Person"), (r"^[A-Z][a-z]*(ed|es|is|os)[,;:!?]*$", "Event"), ("", "Thing"))
#: Relation by the target's type.
RELATION_OF = {"Person": "works_with", "Location": "located_at", "Concept": "influences", "Event": "participated_in", "Thing": "related_to"}
CHUNK_STEP = 10**4


def chunks(spark: SparkSession, sf_dir: str, size: int = SIZE, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, lang, source, n_chunks, sequence_index, text, token_count, char_count)"""
    return token_chunks(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), size, overlap)


def _typed(word: Column) -> Column:
    kind = F.when(word.rlike(TYPES[0][0]), TYPES[0][1])
    for pattern, name in TYPES[1:-1]:
        kind = kind.when(word.rlike(pattern), name)
    return kind.otherwise(TYPES[-1][1])


def found_names(text: Column) -> Column:
    """X1 offline: array of struct<name, type> in text order."""
    words = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    return F.transform(F.filter(words, lambda w: w.rlike(NAME)), lambda w: F.struct(F.regexp_extract(w, NAME, 1).alias("name"), _typed(w).alias("type")))


def place(sequence_index: str = "sequence_index", pos: str = "pos") -> Column:
    """The order of a mention within its document. Documents are told apart by doc_id beside it, of whatever type."""
    return F.col(sequence_index).cast("long") * CHUNK_STEP + F.col(pos)


def mentions(chunked: DataFrame) -> DataFrame:
    """(doc_id, sequence_index, pos, idx, name, type), idx in order of chunk and place within the document."""
    m = chunked.select("doc_id", "sequence_index", F.posexplode(found_names(F.col("text"))).alias("pos", "m"))
    return m.select("doc_id", "sequence_index", "pos", place().alias("idx"), "m.name", "m.type")


def mentions_and_next(chunked: DataFrame) -> DataFrame:
    """Mentions with the name and type of the next one of their chunk (null for the last): mentions and triples from one pass over the texts."""
    m = chunked.select("doc_id", "sequence_index", found_names(F.col("text")).alias("m"))
    m = m.select("doc_id", "sequence_index", F.posexplode(F.zip_with("m", F.slice("m", 2, F.greatest(F.size("m"), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("pos", "p"))
    return m.select("doc_id", "sequence_index", "pos", place().alias("idx"), F.col("p.a.name").alias("name"), F.col("p.a.type").alias("type"), F.col("p.b.name").alias("target"), F.col("p.b.type").alias("target_type"))


def triples_of(pairs: DataFrame) -> DataFrame:
    """The triples of mentions_and_next."""
    return pairs.where("target IS NOT NULL").select("doc_id", "sequence_index", "pos", "idx", F.col("name").alias("source"), relation_of(F.col("target_type")).alias("relation"), "target")


def relation_of(kind: Column) -> Column:
    out = None
    for k, v in RELATION_OF.items():
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out


def triples(chunked: DataFrame) -> DataFrame:
    """(doc_id, sequence_index, pos, idx, source, relation, target): each mention with the next one of its chunk."""
    m = chunked.select("doc_id", "sequence_index", found_names(F.col("text")).alias("m"))
    # the two slices side by side; a filter on the size would be pushed down and extract the names twice
    pairs = F.zip_with(F.slice("m", 1, F.greatest(F.size("m") - 1, F.lit(0))), F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    p = m.select("doc_id", "sequence_index", F.posexplode(pairs).alias("pos", "p"))
    return p.select("doc_id", "sequence_index", "pos", place().alias("idx"), F.col("p.a.name").alias("source"), relation_of(F.col("p.b.type")).alias("relation"), F.col("p.b.name").alias("target"))


_CASE = "CASE " + " ".join(f"WHEN regexp_matches(w, '{p}') THEN '{n}'" for p, n in TYPES[:-1]) + f" ELSE '{TYPES[-1][1]}' END"
_REL_CASE = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RELATION_OF.items()) + " END"
CHUNKS = f"""
doc_tokens AS (SELECT doc_id, lang, source, text, regexp_extract_all(text, '\\s*\\S+') AS t FROM documents WHERE text IS NOT NULL),
chunks AS (
  SELECT doc_id, lang, source, n_chunks, CAST(i AS INTEGER) AS sequence_index, CASE WHEN n_chunks = 1 THEN text ELSE array_to_string(list_slice(t, i * {STEP} + 1, i * {STEP} + {SIZE}), '') END AS text,
    CAST(CASE WHEN n_chunks = 1 THEN len(t) ELSE least({SIZE}, len(t) - i * {STEP}) END AS INTEGER) AS token_count
  FROM (SELECT *, unnest(range(n_chunks)) AS i FROM (SELECT *, CAST(CASE WHEN len(t) <= {SIZE} THEN 1 ELSE 1 + ceil((len(t) - {SIZE}) / {STEP}) END AS INTEGER) AS n_chunks FROM doc_tokens)))"""
MENTIONS = f"""{CHUNKS},
chunk_words AS (SELECT doc_id, sequence_index, list_filter(regexp_extract_all(text, '\\S+'), lambda w: regexp_matches(w, '{NAME}')) AS ws FROM chunks),
mentions AS (
  SELECT doc_id, sequence_index, CAST(i AS INTEGER) AS pos, CAST(sequence_index AS BIGINT) * {CHUNK_STEP} + i AS idx, regexp_extract(w, '{NAME}', 1) AS name, {_CASE} AS type
  FROM (SELECT doc_id, sequence_index, i, ws[i + 1] AS w FROM (SELECT *, unnest(range(len(ws))) AS i FROM chunk_words)))"""
TRIPLES = f"""{MENTIONS},
triples AS (
  SELECT doc_id, sequence_index, pos, idx, source, {_REL_CASE} AS relation, target FROM (
    SELECT doc_id, sequence_index, pos, idx, name AS source, lead(name) OVER w AS target, lead(type) OVER w AS t FROM mentions WINDOW w AS (PARTITION BY doc_id, sequence_index ORDER BY pos)) WHERE target IS NOT NULL)"""
