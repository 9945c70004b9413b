"""Extraction and retrieval metrics (M1-M6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY_WEIGHT, RELATION_WEIGHT = 0.6, 0.4


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def set_counts(expected: DataFrame, predicted: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, expected, predicted, correct): sizes of two sets of keys and of what they share, by one union and one aggregate."""
    by = by or []
    both = expected.select(*by, *keys, F.lit(1).alias("e"), F.lit(0).alias("p")).unionByName(predicted.select(*by, *keys, F.lit(0).alias("e"), F.lit(1).alias("p")))
    one = both.groupBy(*by, *keys).agg(F.max("e").alias("e"), F.max("p").alias("p"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return one.groupBy(*by).agg(total(F.col("e")).alias("expected"), total(F.col("p")).alias("predicted"), total(F.col("e") * F.col("p")).alias("correct"))


def with_prf(counts: DataFrame) -> DataFrame:
    c = counts.withColumns({"precision": _share(F.col("correct"), F.col("predicted")), "recall": _share(F.col("correct"), F.col("expected"))})
    return c.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def combined(entities: DataFrame, relations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """M1: entity and relation counts as precision, recall, F1 (0.6 to 0.4) and accuracy (correct over expected)."""
    by = by or []
    tag = lambda df, t: with_prf(df).select(*by, *(F.col(c).alias(f"{t}_{c}") for c in ("expected", "predicted", "correct", "precision", "recall", "f1")))
    e, r = tag(entities, "e"), tag(relations, "r")
    j = e.join(r, by, "full") if by else e.crossJoin(r)
    j = j.na.fill(0)
    mix = {c: ENTITY_WEIGHT * F.col(f"e_{c}") + RELATION_WEIGHT * F.col(f"r_{c}") for c in ("precision", "recall", "f1")}
    accuracy = _share(F.col("e_correct") + F.col("r_correct"), F.col("e_expected") + F.col("r_expected"))
    return j.select(*by, *(v.alias(k) for k, v in mix.items()), accuracy.alias("accuracy"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """M2: (metric, before, after, difference, percent) of two one-row tables of combined metrics."""
    names = ["precision", "recall", "f1", "accuracy"]
    flat = lambda df, c: df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias(c)) for n in names))).alias("x")).select("x.*")
    j = flat(before, "before").join(flat(after, "after"), "metric").withColumn("difference", F.col("after") - F.col("before"))
    return j.withColumn("percent", F.when(F.col("before") > 0, F.col("difference") / F.col("before") * 100).otherwise(0.0))


def macro(per_example: DataFrame) -> DataFrame:
    """M3: the mean over examples; all zero without examples."""
    return per_example.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


def retrieval(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """M4: precision and recall at k of (query, id) tables; queries without results don't count for precision, nor those without expectation for recall."""
    per = set_counts(expected, retrieved, ["id"], ["query"])
    mean = lambda of: F.round(F.avg(F.when(F.col(of) > 0, F.col("correct") / F.col(of))), 9)  # noqa: E731 - sums depend on order in the last digits
    return per.agg(mean("predicted").alias("precision_at_k"), mean("expected").alias("recall_at_k"))


def retrieval_by_class(retrieved: DataFrame, classes: DataFrame) -> DataFrame:
    """M4 where what is expected of a query is all others of its class: the same figures from counts, without the pairs.

    retrieved: query, id; classes: id, class, one row an id, the queries among them.
    """
    own = classes.select(F.col("id").alias("query"), F.col("class").alias("own"))
    size = classes.groupBy(F.col("class").alias("own")).agg((F.count(F.lit(1)) - 1).alias("expected"))
    per = retrieved.join(own, "query").join(classes, "id").groupBy("query", "own").agg(F.count(F.lit(1)).alias("predicted"), F.sum((F.col("class") == F.col("own")).cast("long")).alias("correct")).join(size, "own")
    mean = lambda of: F.round(F.avg(F.when(F.col(of) > 0, F.col("correct") / F.col(of))), 9)
    return per.agg(mean("predicted").alias("precision_at_k"), mean("expected").alias("recall_at_k"))


def coverage(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """M5: names found in any chunk, over chunks (called precision, though it can exceed 1), over names, and their F1."""
    from graphloom.operators.retrieval import containing

    found = containing(chunks.select(F.monotonically_increasing_id().alias("chunk"), "text"), names, "chunk").select(F.lower("name").alias("name")).distinct()
    n = F.count(F.lit(1))
    j = found.agg(n.alias("found")).crossJoin(chunks.agg(n.alias("chunks"))).crossJoin(names.select(F.lower("name").alias("name")).distinct().agg(n.alias("names")))
    j = j.withColumns({"precision": _share(F.col("found"), F.col("chunks")), "recall": _share(F.col("found"), F.col("names"))})
    return j.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def failures(table: DataFrame, max_violation: float = 0.1, min_precision: float = 0.5) -> DataFrame:
    """M6: (dataset, failure, value) of a comparison table (dataset, violation, precision); a missing precision counts as 1."""
    a = table.where(F.col("violation") > max_violation).select("dataset", F.lit("entity boundary violations").alias("failure"), F.col("violation").alias("value"))
    p = F.coalesce("precision", F.lit(1.0))
    return a.unionByName(table.where(p < min_precision).select("dataset", F.lit("low retrieval precision").alias("failure"), p.alias("value")))
