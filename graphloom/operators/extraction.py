"""Extraction, resolution and text analytics over mentions and triples."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from graphloom.functions.text import PRONOUN_LIKE, PRONOUNS, evidence, negated, whole_word, year_span
from graphloom.operators.graph import first_wins

MIN_ANCHOR, MAX_ANCHORS = 3, 8


def distinct_entities(mentions: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (lower(name), type), within `keys` if given; the first spelling stays."""
    return first_wins(mentions.select(*keys, F.lower("name").alias("key"), "type", "name", "idx"), [*keys, "key", "type"], "idx").drop("key")


def context_sizes(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, sequence_index, n_context): how many names chunks before this one have; a running sum over first occurrences."""
    first = mentions.groupBy("doc_id", F.lower("name").alias("name")).agg(F.min("sequence_index").alias("sequence_index"))
    new = first.groupBy("doc_id", "sequence_index").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("doc_id").orderBy("sequence_index").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select("doc_id", "sequence_index").join(new, ["doc_id", "sequence_index"], "left").select("doc_id", "sequence_index", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_context"))


def distinct_triples(triples: DataFrame, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("idx",)) -> DataFrame:
    """Each triple once, at its first place; order: the columns that tell it, such as doc_id and idx over several documents."""
    if len(order) == 1:
        return triples.groupBy(*keys, "source", "relation", "target").agg(F.min(order[0]).alias(order[0]))
    return triples.groupBy(*keys, "source", "relation", "target").agg(F.min(F.struct(*order)).alias("__first")).select(*keys, "source", "relation", "target", "__first.*")


def first_types(mentions: DataFrame, types: DataFrame) -> DataFrame:
    """(doc_id, name, type) of names with a type in the schema; of several types the first stays."""
    kept = mentions.join(F.broadcast(types.select("type").distinct()), "type", "left_semi")  # a schema's types
    return kept.groupBy("doc_id", "name").agg(F.min_by("type", "idx").alias("type"))


def gate(triples: DataFrame, typed: DataFrame, relations: DataFrame) -> DataFrame:
    """Triples whose (type, relation, type) the schema has. relations: name, src, dst."""
    a, b = typed.select("doc_id", F.col("name").alias("source"), F.col("type").alias("src")), typed.select("doc_id", F.col("name").alias("target"), F.col("type").alias("dst"))
    allowed = F.broadcast(relations.select(F.col("name").alias("relation"), "src", "dst").distinct())  # a schema's relations
    return triples.join(a, ["doc_id", "source"]).join(b, ["doc_id", "target"]).join(allowed, ["relation", "src", "dst"], "left_semi")


def _letters(low: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How often each of 32 classes of characters occurs in each name, and the names' lengths."""
    out = np.zeros((len(low), 32), dtype=np.int16)
    for i, x in enumerate(low):
        for c in x:
            out[i, ord(c) & 31] += 1
    return out, np.array([len(x) for x in low])


def resolve_names(names: list[str], threshold: float = 0.85) -> dict[str, str]:
    """Name -> canonical name, of one type, in order: an earlier canonical name that is similar, else a new group around the name.

    Names are similar if difflib's ratio reaches the threshold. The ratio is at most twice the characters that two names
    share over all their characters, so it is computed only where that bound, taken for a name and all others at once,
    reaches the threshold: the result is that of comparing all.
    """
    if len(names) < 2:
        return {}
    names = list(dict.fromkeys(names))
    low = [n.lower().strip() for n in names]
    count, size = _letters(low)
    matcher = SequenceMatcher(None)
    out: dict[str, str] = {}
    canonical: list[int] = []

    def similar(i: int, others: np.ndarray) -> Iterator[int]:
        """Those of the others, in order, that name i is similar to; i is the matcher's first text."""
        if not len(others):
            return
        both = np.minimum(count[others], count[i]).sum(axis=1)
        whole = size[others] + size[i]
        matcher.set_seq1(low[i])
        for j in others[2.0 * both >= threshold * whole - 1e-9].tolist():
            if low[i] == low[j]:
                yield j
                continue
            matcher.set_seq2(low[j])
            if matcher.quick_ratio() >= threshold and matcher.ratio() >= threshold:
                yield j

    free = np.ones(len(names), dtype=bool)
    for i, name in enumerate(names):
        if not free[i]:
            continue
        free[i] = False
        known = next(similar(i, np.array(canonical, dtype=np.int64)), None)
        if known is not None:
            out[name] = names[known]
            continue
        group = [i, *similar(i, i + 1 + np.flatnonzero(free[i + 1 :]))]
        best = max(group, key=lambda k: len(names[k]))
        canonical.append(best)
        free[group] = False
        out |= {names[k]: names[best] for k in group}
    return out


@F.pandas_udf(ArrayType(StringType()))
def _canonical(names: pd.Series) -> pd.Series:
    out = []
    for n in names:
        got = resolve_names(list(n))
        out.append([got.get(x) for x in n])
    return pd.Series(out, index=names.index)


def resolve(entities: DataFrame) -> DataFrame:
    """(doc_id, type, name, canonical) of entities (doc_id, type, name, idx), for each type of each document by itself.

    A type with one name has no mapping. Names are gathered into one array a group, so that a batch carries many groups.
    """
    first = entities.groupBy("doc_id", "type", "name").agg(F.min("idx").alias("idx"))
    groups = first.groupBy("doc_id", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]).alias("names")).where("size(names) > 1")
    got = groups.select("doc_id", "type", F.explode(F.arrays_zip("names", _canonical("names").alias("canonical"))).alias("x"))
    return got.select("doc_id", "type", F.col("x.names").alias("name"), F.col("x.canonical").alias("canonical"))


def map_relations(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """X11: endpoints by the mapping (doc_id, name, canonical), no self relations, each triple once."""
    side = lambda c: mapping.select("doc_id", F.col("name").alias(c), F.col("canonical").alias(f"__{c}"))
    m = triples.join(side("source"), ["doc_id", "source"], "left").join(side("target"), ["doc_id", "target"], "left")
    m = m.select("doc_id", "idx", "relation", F.coalesce("__source", "source").alias("source"), F.coalesce("__target", "target").alias("target")).where("source <> target")
    return distinct_triples(m, ("doc_id",))


def antecedent(text: Column, names: Column, word: Column) -> Column:
    """For a pronoun, the first of the names that occurs in the text before it; other words stay."""
    low = F.lower(text)
    at = F.position(F.lower(word), low)
    before = F.filter(names, lambda n: (F.position(F.lower(n), low) > 0) & (F.position(F.lower(n), low) < at))
    return F.when(F.lower(word).isin(*PRONOUNS) & (F.size(before) > 0), F.get(before, F.lit(0))).otherwise(word)


@F.pandas_udf(ArrayType(StringType()))
def evidence_windows(text: pd.Series, pairs: pd.Series) -> pd.Series:
    return pd.Series([[evidence(t, p["a"], p["b"]) for p in ps] for t, ps in zip(text, pairs)], index=text.index)


def with_metadata(windows: DataFrame) -> DataFrame:
    """Negation and years of windows (lang, relation, evidence); other languages than English get neither."""
    english = F.col("lang") == "en"
    out = windows.withColumn("is_negated", F.when(english, negated(F.col("evidence"), F.col("relation"))))
    span = F.when(english, year_span(F.col("evidence")))
    return out.withColumns({"start_time": span["start"], "end_time": span["end"]})


def inverted_index(mentions: DataFrame) -> DataFrame:
    """(doc_id, name, chunks): where in its document each lower-cased name occurs."""
    return mentions.groupBy("doc_id", F.lower("name").alias("name")).agg(F.array_sort(F.collect_set("sequence_index")).alias("chunks"))


def occurrences(text: Column, name: Column) -> Column:
    """Whole-word occurrences, regardless of case; by Unicode words."""
    return F.regexp_count(text, F.concat(F.lit(r"(?iU)(?<!\w)\Q"), name, F.lit(r"\E(?!\w)")))


def anchors(chunks: DataFrame, mentions: DataFrame | None = None, min_len: int = MIN_ANCHOR, top: int = MAX_ANCHORS) -> DataFrame:
    """(doc_id, sequence_index, name, score, rank): names of a chunk by tf-idf within the document.

    The names are the column `names` of the chunks, an array, so that the texts are read once and never shuffled; or, if
    they come as a table of mentions, they are joined to the chunks first. Names of one word are counted among those words
    of the chunk that are a name at all. Only rows of names and counts are shuffled, once, by document.
    """
    key = ["doc_id", "sequence_index"]
    if mentions is not None:
        chunks = chunks.join(mentions.groupBy(*key).agg(F.collect_set("name").alias("names")), key)
    low = F.transform(F.array_distinct("names"), lambda n: F.struct(n.alias("name"), F.lower(n).alias("low")))
    c = chunks.select(*key, "n_chunks", "text", low.alias("names"))
    hits = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: F.array_contains(F.col("names.low"), w))
    c = c.withColumn("hits", hits)
    count = lambda n: F.when(n["name"].rlike(r"^[\p{L}\p{N}_]+$"), F.size(F.filter("hits", lambda w: w == n["low"]))).otherwise(occurrences(F.col("text"), n["name"]))
    tf = c.select(*key, "n_chunks", F.explode(F.transform("names", lambda n: F.struct(n["name"].alias("name"), n["low"].alias("low"), count(n).alias("tf")))).alias("x")).select(*key, "n_chunks", "x.*")
    tf = tf.repartition("doc_id")  # both windows below keep this partitioning
    df = F.size(F.collect_set("sequence_index").over(Window.partitionBy("doc_id", "low")))  # every name of a chunk is in tf, so no second pass over the texts
    fit = (F.length("name") >= min_len) & ~F.col("low").isin(*PRONOUN_LIKE) & ~F.col("name").rlike(r"^\d+$") & (F.col("tf") > 0)
    score = F.col("tf") * (F.log((F.col("n_chunks") + 1) / (F.col("df") + 1)) + 1) * (1 + F.least(F.length("name") / 20.0, F.lit(1.0)) * 0.1)
    got = tf.withColumn("df", df).where(fit).withColumn("score", F.round(score, 9))
    return got.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "sequence_index").orderBy(F.desc("score"), "low"))).where(F.col("rank") <= top).select(*key, "name", "score", "rank")


def snippets_of(texts: dict[int, str], names: dict[int, list[str]], index: dict[str, set[int]], most: int = 3, reach: int = 350, budget: int = 1200) -> Iterator[tuple[int, int, str]]:
    """X20 for one document: (chunk, other chunk, snippet): others that share an anchor, most anchors first, then the nearest."""
    seen: dict[tuple[str, int], int] = {}

    def find(name: str, j: int) -> int:
        if (name, j) not in seen:
            m = whole_word(name).search(texts[j])
            seen[name, j] = m.start() if m else -1
        return seen[name, j]

    for i, own in names.items():
        others = {j for n in own for j in index.get(n.lower(), ()) if j != i}
        ranked = sorted((-hits, abs(j - i), j) for j in others if (hits := sum(find(n, j) >= 0 for n in own)))
        total = 0
        for _, _, j in ranked[:most]:
            at = max(0, next(find(n, j) for n in own if find(n, j) >= 0) - reach // 2)
            s = f"Chunk {j + 1} excerpt: {texts[j][at : at + reach].strip()}"
            if total + len(s) > budget:
                break
            total += len(s)
            yield i, j, s


def snippets(chunks: DataFrame, mentions: DataFrame, anchored: DataFrame) -> DataFrame:
    """(doc_id, sequence_index, other, snippet), document by document."""
    key = ["doc_id", "sequence_index"]
    own = anchored.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("anchors"))
    held = mentions.groupBy(*key).agg(F.collect_set(F.lower("name")).alias("held"))
    rows = chunks.where("n_chunks > 1").select(*key, "text").join(own, key, "left").join(held, key, "left")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        texts = dict(zip(g["sequence_index"], g["text"]))
        names = {i: list(a) for i, a in zip(g["sequence_index"], g["anchors"]) if a is not None}
        index: dict[str, set[int]] = {}
        for i, h in zip(g["sequence_index"], g["held"]):
            for n in h if h is not None else ():
                index.setdefault(n, set()).add(i)
        got = list(snippets_of(texts, dict(sorted(names.items())), index))
        return pd.DataFrame([(key[0], *x) for x in got], columns=["doc_id", "sequence_index", "other", "snippet"])

    doc = chunks.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("doc_id").applyInPandas(run, f"doc_id {doc}, sequence_index int, other int, snippet string")


def cross_entity_ratio(relations: DataFrame) -> DataFrame:
    """One row: relations, those that don't start at the first declared type, their share, and its grade. relations: idx, src."""
    first = relations.agg(F.min_by("src", "idx").alias("first"), F.count(F.lit(1)).alias("relations"))
    got = relations.crossJoin(F.broadcast(first.select("first"))).agg(F.sum((F.col("src") != F.col("first")).cast("int")).alias("other")).crossJoin(first.select("relations"))
    share = F.col("other") / F.col("relations")
    return got.select("relations", "other", share.alias("ratio"), F.when(share < 0.4, "poor").when(share >= 0.6, "good").otherwise("fair").alias("grade"))
