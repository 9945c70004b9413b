"""Chunking and its checks.

Fixed windows are closed-form expressions: a document's tokens become an array once and its windows are slices of it,
so there is no shuffle and no Python. Boundary-aligned and sentence chunks depend on the chunk before; they run per
document in Arrow batches, which also needs no shuffle.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.functions.text import TRUNCATED, tokens

#: Name -> (strategy, size, overlap share or overlapping sentences).
PRESETS = {"small": ("token", 256, 0.15), "medium": ("token", 512, 0.15), "large": ("token", 768, 0.15), "xlarge": ("token", 1024, 0.15), "graphrag": ("token", 200, 0.15), "rag": ("token", 512, 0.2), "sentence": ("sentence", 512, 2)}
_SENTENCE, _PARAGRAPH, _TOKEN = re.compile(r"[.!?]\s+"), re.compile(r"\n\s*\n"), re.compile(r"\s*\S+")
SCHEMA = "sequence_index int, text string, token_count int, char_count int"


def chunk_id(dataset: Column, doc: Column, index: Column) -> Column:
    """C6"""
    return F.format_string("%s_%s_chunk_%03d", dataset.cast("string"), doc.cast("string"), index)


def boundary_flags(df: DataFrame, n_chunks: Column) -> DataFrame:
    """The flags of a chunk's two ends; the end of a paragraph is known only for a document of one chunk."""
    first = F.substring(F.ltrim("text"), 1, 1)
    ends = F.regexp_replace("text", r"\s+$", "").rlike(r"[.!?]$")
    return df.withColumns({"starts_at_sentence": first.rlike(r"^\p{Lu}"), "ends_at_sentence": ends, "starts_at_paragraph": F.col("sequence_index") == 0, "ends_at_paragraph": n_chunks == 1})


class Tokenizer(Protocol):
    """What a chunk's size is counted in. Implementations are small and picklable: they are sent to the workers."""

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where in the text each token lies, by code points; a token that holds a part of a character begins where that does."""
        ...


@lru_cache(maxsize=8)
def _encoding(path: str, pattern: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass(frozen=True)
class BpeTokenizer:
    """Byte-level BPE from a file of ranks, loaded once a process. The path is a parameter; no vocabulary comes with the library."""

    path: str = os.environ.get("GRAPHLOOM_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    pattern: str = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def encode(self, text: str) -> list[int]:
        return _encoding(self.path, self.pattern).encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return _encoding(self.path, self.pattern).decode(list(ids))

    def spans(self, text: str) -> list[tuple[int, int]]:
        ids = self.encode(text)
        at = np.cumsum([0, *(len(x) for x in _encoding(self.path, self.pattern).decode_tokens_bytes(ids))]) if ids else np.zeros(1, np.int64)
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        chars = np.concatenate([np.cumsum((raw & 0xC0) != 0x80) - 1, [len(text)]])  # the character that each byte belongs to
        return list(zip(chars[at[:-1]].tolist(), chars[at[1:]].tolist()))


@dataclass(frozen=True)
class SpaceTokenizer:
    """White-space tokens, each with the space before it; numbered by a hash, so decoding needs the text."""

    def encode(self, text: str) -> list[int]:
        return [zlib.crc32(x.encode()) for x in _TOKEN.findall(text)]

    def decode(self, ids: list[int]) -> str:
        raise NotImplementedError("white-space tokens have no vocabulary")

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in _TOKEN.finditer(text)]


def tokenized_chunks(docs: DataFrame, tokenizer: Tokenizer, size: int = 512, overlap: float = 0.15) -> DataFrame:
    """C2 by any tokenizer: (doc_id, sequence_index, text, token_count, char_count): windows of `size` tokens, in Arrow batches without
    a shuffle. A boundary inside a character moves to the character's begin, so chunks are text. A null text has no chunks."""
    if not 0 <= overlap < 1 or size < 1:
        raise ValueError("the overlap must be a share under 1, the size positive")
    step = max(1, size - int(size * overlap))

    def cut(text: str, *_: object) -> list[tuple[str, int]]:
        at = tokenizer.spans(text)
        n = len(at)
        if n <= size:
            return [(text, n)]
        last = -(-(n - size) // step)
        return [(text[at[i * step][0] : at[i * step + size][0] if i * step + size < n else len(text)], min(size, n - i * step)) for i in range(last + 1)]

    return python_chunks(docs, cut, size, overlap)


def token_chunks(docs: DataFrame, size: int = 256, overlap: float = 0.15) -> DataFrame:
    """Docs with sequence_index, text, token_count, char_count, n_chunks: windows of `size` tokens. A null text has no chunks."""
    if not 0 <= overlap < 1 or size < 1:
        raise ValueError("the overlap must be a share under 1, the size positive")
    step = max(1, size - int(size * overlap))
    rest = [c for c in docs.columns if c != "text"]
    t = docs.where("text IS NOT NULL").withColumn("__t", tokens(F.col("text"))).withColumn("__n", F.size("__t"))
    last = F.when(F.col("__n") <= size, 0).otherwise(F.ceil((F.col("__n") - size) / step)).cast("int")
    cut = t.withColumn("n_chunks", last + 1).select(*rest, "n_chunks", F.col("text").alias("__text"), "__t", "__n", F.explode(F.sequence(F.lit(0), last)).alias("sequence_index"))
    text = F.when(F.col("n_chunks") == 1, F.col("__text")).otherwise(F.array_join(F.slice("__t", F.col("sequence_index") * step + 1, size), ""))
    count = F.when(F.col("n_chunks") == 1, F.col("__n")).otherwise(F.least(F.lit(size), F.col("__n") - F.col("sequence_index") * step))
    return cut.select(*rest, "n_chunks", "sequence_index", text.alias("text"), count.cast("int").alias("token_count")).withColumn("char_count", F.length("text"))


def sentence_marks(docs: DataFrame) -> DataFrame:
    """C4: numbers of sentence and paragraph ends of each text."""
    return docs.withColumns({"sentence_ends": F.regexp_count("text", F.lit(r"[.!?]\s+")), "paragraph_ends": F.regexp_count("text", F.lit(r"\n\s*\n"))})


def aligned(text: str, size: int, overlap: float) -> list[tuple[str, int]]:
    """Windows whose ends, but for the first one's, move to the nearest sentence end (else paragraph end) within a tenth of the text."""
    toks = [m.span() for m in _TOKEN.finditer(text)]
    n = len(toks)
    if n <= size:
        return [(text, n)]
    ends = [b for _, b in toks]
    marks = [[m.end() for m in p.finditer(text)] for p in (_SENTENCE, _PARAGRAPH)]
    keep, out, start = int(size * overlap), [], 0
    while True:
        stop = min(start + size, n)
        if out and stop < n:
            at = ends[stop - 1]
            for found in marks:
                k = bisect.bisect_left(found, at)
                near = min(found[max(0, k - 1) : k + 1], key=lambda p: abs(p - at), default=None)
                if near is not None and abs(near - at) < len(text) / 10:
                    stop = max(bisect.bisect_right(ends, near), start + keep + 1)  # the next window must begin later than this one
                    stop = min(stop, n)
                    break
        out.append((text[toks[start][0] : ends[stop - 1]], stop - start))
        if stop >= n:
            return out
        start = max(stop - keep, start + 1)


def by_sentences(text: str, size: int, overlap: int) -> list[tuple[str, int]]:
    """Sentences until `size` tokens; the last `overlap` sentences come again; a sentence over the size stands alone."""
    cuts = [0, *(m.end() for m in _SENTENCE.finditer(text)), len(text)]
    parts = [(p, len(_TOKEN.findall(p))) for p in (text[a:b] for a, b in zip(cuts, cuts[1:])) if p.strip()]
    out: list[tuple[str, int]] = []
    held: list[tuple[str, int]] = []
    fresh = False
    for p, n in parts:
        if held and sum(x for _, x in held) + n > size:
            if fresh:
                out.append(("".join(x for x, _ in held), sum(x for _, x in held)))
            held, fresh = (held[-overlap:] if overlap else []), False
            if sum(x for _, x in held) + n > size:
                held = []
        held, fresh = [*held, (p, n)], True
    if held and fresh:
        out.append(("".join(x for x, _ in held), sum(x for _, x in held)))
    return out


def sampled(text: str, parts: int = 4, part_chars: int = 1500, budget: int = 12_000) -> str:
    """C14: the first and the last part, then parts outwards from the middle while the budget lasts, in text order."""
    slots = max(parts, 2)
    if len(text) <= budget or len(text) <= slots * part_chars:
        return text
    at = [round(i * (len(text) - part_chars) / (slots - 1)) for i in range(slots)]
    order = [0, slots - 1, *sorted(range(1, slots - 1), key=lambda i: (abs(i - (slots - 1) / 2), i))]
    chosen = sorted(order[: max(2, budget // part_chars)])
    return TRUNCATED.join(text[at[i] : at[i] + part_chars] for i in chosen)


@F.pandas_udf(StringType())
def budget_sample(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else sampled(t) for t in text], index=text.index, dtype=object)


def python_chunks(docs: DataFrame, strategy: str | Callable[[str, int, float], list[tuple[str, int]]], size: int, overlap: float) -> DataFrame:
    """C3, C5 over a table (doc_id, text): strategy "aligned" or "sentence", or a function of (text, size, overlap). A null text has no chunks."""
    cut = {"aligned": aligned, "sentence": by_sentences}[strategy] if isinstance(strategy, str) else strategy
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(batch.column("text").to_pylist()):
                got = cut(t, size, overlap) if t is not None else []
                if got:
                    texts, counts = zip(*got)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([i] * len(got))), pa.array(range(len(got)), pa.int32()), pa.array(texts), pa.array(counts, pa.int32()), pa.array([len(x) for x in texts], pa.int32())], names=["doc_id", "sequence_index", "text", "token_count", "char_count"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {SCHEMA}")


@dataclass(frozen=True)
class Chunker:
    """A strategy with its size and overlap, as a function of documents."""

    strategy: str = "token"
    size: int = 512
    overlap: float = 0.15
    tokenizer: Tokenizer | None = None

    def __call__(self, docs: DataFrame) -> DataFrame:
        if self.strategy == "token" and self.tokenizer is not None:
            return tokenized_chunks(docs, self.tokenizer, self.size, self.overlap)
        return token_chunks(docs, self.size, self.overlap) if self.strategy == "token" else python_chunks(docs, self.strategy, self.size, self.overlap if self.strategy == "aligned" else int(self.overlap))


def create_chunker(strategy: str = "token", chunk_size: int = 512, overlap: float = 0.15, preset: str | None = None, tokenizer: Tokenizer | None = None) -> Chunker:
    """A preset overrides the other arguments but the tokenizer; without one, token chunks count white-space tokens by native expressions."""
    if preset is not None:
        if preset not in PRESETS:
            raise ValueError(f"unknown preset {preset}")
        return Chunker(*PRESETS[preset], tokenizer=tokenizer)
    if strategy not in ("token", "aligned", "sentence"):
        raise ValueError(f"unknown strategy {strategy}")
    return Chunker(strategy, chunk_size, overlap, tokenizer)


def chunk_issues(chunks: DataFrame) -> DataFrame:
    """(chunk_id, issue) of chunks (origin, chunk_id, sequence_index, text, token_count); an empty table gives one row of its own."""
    issue = lambda cond, name: F.when(cond, F.lit(name))
    before = F.lag("sequence_index").over(Window.partitionBy("origin").orderBy("position"))
    own = chunks.withColumn("__before", before).select(
        "chunk_id",
        F.explode(F.array_compact(F.array(
            issue(F.trim(F.coalesce("text", F.lit(""))) == "", "empty text"), issue(F.col("token_count") == 0, "zero tokens"),
            issue(F.col("sequence_index") < 0, "negative index"), issue(F.col("sequence_index") <= F.col("__before"), "out of order"),
        ))).alias("issue"),
    )
    twice = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id", F.lit("duplicate id").alias("issue"))
    none = chunks.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("chunk_id"), F.lit("no chunks").alias("issue"))
    return own.unionByName(twice).unionByName(none)


def overlap_breaks(chunks: DataFrame) -> DataFrame:
    """C11: adjacent chunks of an origin whose indexes aren't consecutive."""
    w = Window.partitionBy("origin").orderBy("sequence_index")
    return chunks.withColumn("previous", F.lag("sequence_index").over(w)).where("previous IS NOT NULL AND sequence_index <> previous + 1").select("origin", "sequence_index", "previous")


def chunk_quality(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """One row: mean and population deviation of token counts, and boundary hits of names per name.

    A hit is a chunk that begins or ends with a name. Names are matched by equality on what a chunk begins or ends with,
    one candidate for each length that a name has, so the join is an equi-join.
    """
    entities = names.select(F.lower("name").alias("name")).where("length(name) > 0").distinct()
    sizes = entities.select(F.length("name").alias("size")).distinct()  # a few dozen lengths at most
    edge = chunks.select(F.lower(F.trim("text")).alias("t")).crossJoin(F.broadcast(sizes)).where(F.col("size") <= F.length("t"))
    found = edge.select(F.explode(F.array_distinct(F.array(F.left("t", F.col("size")), F.right("t", F.col("size"))))).alias("name")).join(entities, "name")
    stats = chunks.agg(F.avg("token_count").alias("mean_tokens"), F.stddev_pop("token_count").alias("std_tokens"), F.count(F.lit(1)).alias("n_chunks"))
    return stats.crossJoin(found.agg(F.count(F.lit(1)).alias("hits"))).crossJoin(entities.agg(F.count(F.lit(1)).alias("n_names"))).withColumn("violation", F.when(F.col("n_names") > 0, F.col("hits") / F.col("n_names")).otherwise(0.0))
