"""Queries over text: chunking and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import schema_sample, tokens
from graphloom.operators import chunking as C
from graphloom.plans.catalog import query
from graphloom.sources.tables import table
from graphloom.sources.textgraph import CHUNKS, MENTIONS, chunks, mentions


@query("c1_tokens", "SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '')) AS joined FROM (SELECT doc_id, regexp_extract_all(text, '\\s*\\S+') AS t FROM documents)")
def c1_tokens(s: SparkSession, d: str) -> DataFrame:
    """Token counts, and a digest of the tokens put together again."""
    t = table(s, d, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", "")).alias("joined"))


@query("c2_token_chunks", f"WITH {CHUNKS} SELECT doc_id, sequence_index, text, token_count, length(text) AS char_count FROM chunks")
def c2_token_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).select("doc_id", "sequence_index", "text", "token_count", F.col("char_count").cast("long").alias("char_count"))


@query("c3_aligned_chunks")
def c3_aligned_chunks(s: SparkSession, d: str) -> DataFrame:
    return C.python_chunks(table(s, d, "documents"), "aligned", 256, 0.15)


@query("c2_bpe_chunks")
def c2_bpe_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks of 512 tokens of a public byte-level BPE vocabulary."""
    return C.create_chunker("token", 512, 0.15, tokenizer=C.BpeTokenizer())(table(s, d, "documents"))


@query("c4_boundaries", "SELECT doc_id, len(regexp_extract_all(text, '[.!?]\\s+')) AS sentence_ends, len(regexp_extract_all(text, '\\n\\s*\\n')) AS paragraph_ends FROM documents")
def c4_boundaries(s: SparkSession, d: str) -> DataFrame:
    return C.sentence_marks(table(s, d, "documents")).select("doc_id", F.col("sentence_ends").cast("long").alias("sentence_ends"), F.col("paragraph_ends").cast("long").alias("paragraph_ends"))


@query("c5_sentence_chunks")
def c5_sentence_chunks(s: SparkSession, d: str) -> DataFrame:
    return C.python_chunks(table(s, d, "documents"), "sentence", 512, 2)


@query("c6_chunk_ids", f"WITH {CHUNKS} SELECT doc_id, sequence_index, source || '_' || doc_id || '_chunk_' || lpad(CAST(sequence_index AS VARCHAR), CAST(greatest(3, length(CAST(sequence_index AS VARCHAR))) AS INTEGER), '0') AS chunk_id FROM chunks")
def c6_chunk_ids(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).select("doc_id", "sequence_index", C.chunk_id(F.col("source"), F.col("doc_id"), F.col("sequence_index")).alias("chunk_id"))


@query("c7_boundary_flags", f"""WITH {CHUNKS} SELECT doc_id, sequence_index, regexp_matches(text, '^\\s*\\p{{Lu}}') AS starts_at_sentence, regexp_matches(text, '[.!?]\\s*$') AS ends_at_sentence,
sequence_index = 0 AS starts_at_paragraph, n_chunks = 1 AS ends_at_paragraph FROM chunks""")
def c7_boundary_flags(s: SparkSession, d: str) -> DataFrame:
    c = C.boundary_flags(chunks(s, d).withColumn("text", F.regexp_replace("text", r"^\s+", "")), F.col("n_chunks"))
    return c.select("doc_id", "sequence_index", "starts_at_sentence", "ends_at_sentence", "starts_at_paragraph", "ends_at_paragraph")


@query("c8_presets", "SELECT * FROM (VALUES ('graphrag', 'token', 200, 30), ('large', 'token', 768, 115), ('medium', 'token', 512, 76), ('rag', 'token', 512, 102), ('sentence', 'sentence', 512, 2), ('small', 'token', 256, 38), ('xlarge', 'token', 1024, 153)) t(preset, strategy, size, overlap)")
def c8_presets(s: SparkSession, d: str) -> DataFrame:
    rows = [(k, how, size, int(size * o) if how == "token" else int(o)) for k, (how, size, o) in C.PRESETS.items()]
    return s.createDataFrame(rows, "preset string, strategy string, size int, overlap int")


@query("c9_preset_chunk_counts", "SELECT preset, sum(CASE WHEN n <= size THEN 1 ELSE 1 + ceil((n - size) / (size - overlap)) END)::BIGINT AS chunks FROM (SELECT len(regexp_extract_all(text, '\\s*\\S+')) AS n FROM documents), (VALUES ('graphrag', 200, 30), ('large', 768, 115), ('rag', 512, 102)) t(preset, size, overlap) GROUP BY preset")
def c9_preset_chunk_counts(s: SparkSession, d: str) -> DataFrame:
    docs, out = table(s, d, "documents").select("doc_id", "text"), None
    for preset in ("graphrag", "large", "rag"):
        n = C.create_chunker(preset=preset)(docs).agg(F.count(F.lit(1)).alias("chunks")).select(F.lit(preset).alias("preset"), "chunks")
        out = n if out is None else out.unionByName(n)
    return out


_AS_CHUNKS = "SELECT source AS origin, doc_id AS position, source || '_' || substr(md5(text), 1, 8) AS chunk_id, CAST(n_chars AS INTEGER) AS sequence_index, text, CAST(len(regexp_extract_all(text, '\\s*\\S+')) AS INTEGER) AS token_count FROM documents"


@query("c10_validate_chunks", f"""WITH c AS ({_AS_CHUNKS}), b AS (SELECT *, lag(sequence_index) OVER (PARTITION BY origin ORDER BY position) AS before FROM c)
SELECT chunk_id, 'empty text' AS issue FROM c WHERE trim(text) = '' UNION ALL SELECT chunk_id, 'zero tokens' FROM c WHERE token_count = 0 UNION ALL SELECT chunk_id, 'negative index' FROM c WHERE sequence_index < 0
UNION ALL SELECT chunk_id, 'out of order' FROM b WHERE sequence_index <= before UNION ALL SELECT chunk_id, 'duplicate id' FROM c GROUP BY chunk_id HAVING count(*) > 1 UNION ALL SELECT NULL, 'no chunks' FROM c HAVING count(*) = 0""")
def c10_validate_chunks(s: SparkSession, d: str) -> DataFrame:
    """Documents taken as chunks of their source, with their size as index: many are out of order, copies share an id."""
    t = table(s, d, "documents")
    c = t.select(F.col("source").alias("origin"), F.col("doc_id").alias("position"), F.concat("source", F.lit("_"), F.left(F.md5("text"), F.lit(8))).alias("chunk_id"), F.col("n_chars").cast("int").alias("sequence_index"), "text", F.size(tokens(F.col("text"))).alias("token_count"))
    return C.chunk_issues(c)


@query("c11_overlap_consistency", "SELECT origin, sequence_index, previous FROM (SELECT l_orderkey AS origin, l_linenumber AS sequence_index, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS previous FROM lineitem) WHERE previous IS NOT NULL AND sequence_index <> previous + 1")
def c11_overlap_consistency(s: SparkSession, d: str) -> DataFrame:
    return C.overlap_breaks(table(s, d, "lineitem").select(F.col("l_orderkey").alias("origin"), F.col("l_linenumber").alias("sequence_index")))


@query("c12_chunk_quality", f"""WITH {MENTIONS}, names AS (SELECT DISTINCT lower(name) AS name FROM mentions), c AS (SELECT lower(trim(text, ' ')) AS t, token_count FROM chunks),
sizes AS (SELECT DISTINCT length(name) AS size FROM names), e AS (SELECT row_number() OVER () AS r, t FROM c),
hits AS (SELECT count(*) AS hits FROM (SELECT DISTINCT r, name FROM (SELECT r, left(t, size) AS name FROM e, sizes WHERE size <= length(t) UNION ALL SELECT r, right(t, size) FROM e, sizes WHERE size <= length(t))) SEMI JOIN names USING (name))
SELECT mean_tokens, std_tokens, n_chunks, hits, n_names, hits / n_names AS violation FROM (SELECT avg(token_count) AS mean_tokens, stddev_pop(token_count) AS std_tokens, count(*) AS n_chunks FROM c), hits, (SELECT count(*) AS n_names FROM names)""")
def c12_chunk_quality(s: SparkSession, d: str) -> DataFrame:
    c = chunks(s, d)
    return C.chunk_quality(c, mentions(c).select("name").distinct())


_GAP = "E'\\n\\n[... truncated ...]\\n\\n'"


@query("c13_schema_sample", f"""SELECT doc_id, md5(CASE WHEN n > 15000 THEN substr(text, 1, 3500) || {_GAP} || substr(text, n // 4 + 1, 3500) || {_GAP} || substr(text, 2 * (n // 4) + 1, 3500) || {_GAP} || right(text, 3500)
WHEN n > 12000 THEN substr(text, 1, 4000) || {_GAP} || substr(text, n // 3 + 1, 4000) || {_GAP} || right(text, 4000) WHEN n > 8000 THEN substr(text, 1, 4000) || {_GAP} || right(text, 4000) ELSE text END) AS sample FROM (SELECT doc_id, text, length(text) AS n FROM documents)""")
def c13_schema_sample(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.md5(schema_sample(F.col("text"))).alias("sample"))


@query("c14_budget_sample")
def c14_budget_sample(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", C.budget_sample("text").alias("sample"))
