"""Relation types, their categories, and the rule-based classifier, and models in its place."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: Category -> types; the last three groups have no category of their own.
_TYPES = {
    "causal": "caused_by causes results_in triggers", "spatial": "contains inside located_at near outside", "temporal": "follows occurs_after occurs_before occurs_during",
    "social": "belongs_to collaborates_with influenced_by influences member_of owns works_with", "hierarchical": "child_of has_part parent_of part_of",
    "action": "consumes creates destroys modifies produces", "communication": "communicates_with informs requests responds_to", "emotional": "dislikes fears hates likes loves trusts",
    None: "equivalent_to knows leaves meets related_to returns_to similar_to visits",
}
TYPES = [(t, c) for c, names in _TYPES.items() for t in names.split()]
#: Type, confidence and the phrases that show it, in order of precedence.
RULES = (
    ("causes", 0.9, "causes|caused|leads to|results in"), ("caused_by", 0.9, "because|due to|result of"), ("located_at", 0.8, "located|at|in|place"), ("contains", 0.8, "contains|includes|has"),
    ("occurs_before", 0.8, "before|prior|earlier"), ("occurs_after", 0.8, "after|later|subsequent"), ("influences", 0.85, "influences|affects|impacts"), ("collaborates_with", 0.85, "collaborates|works with|partners"),
    ("owns", 0.9, "owns|possesses|has ownership"), ("member_of", 0.85, "member|belongs|part of group"), ("parent_of", 0.9, "parent|father|mother"), ("child_of", 0.9, "child|son|daughter"), ("part_of", 0.8, "part of|component|belongs to"),
)
#: What two entity types suggest where no phrase does.
BY_TYPES = {("Person", "Person"): (("related_to", 0.5), ("knows", 0.4)), ("Person", "Location"): (("located_at", 0.6), ("visits", 0.5)), ("Event", "Person"): (("influences", 0.5), ("results_in", 0.4))}
FALLBACK = (("related_to", 0.3),)


def relationship_types(spark: SparkSession) -> DataFrame:
    """The dimension (type, category)."""
    return spark.createDataFrame(TYPES, "type string, category string")


def _candidates(items) -> Column:  # noqa: ANN001
    return F.array(*(F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence")) for t, c in items))


def by_rules(text: Column, source_type: Column, target_type: Column) -> Column:
    """Array of struct<type, confidence>, in the order of the rules; phrases match anywhere, inside words too."""
    low = F.lower(text)

    def hit(phrases: str) -> Column:
        first, *rest = phrases.split("|")
        out = low.contains(first)
        for p in rest:
            out = out | low.contains(p)
        return out

    found = F.array_compact(F.array(*(F.when(hit(p), F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))) for t, c, p in RULES)))
    out = F.when(F.size(found) > 0, found)
    for (a, b), items in BY_TYPES.items():
        out = out.when((source_type == a) & (target_type == b), _candidates(items))
    return out.otherwise(_candidates(FALLBACK))


def constrained(candidates: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates (keys, src, dst, ordinal, type, confidence) that the schema (name, src, dst) has; a part of a name counts 0.8; a key left with none keeps all."""
    names = F.broadcast(valid.groupBy("src", "dst").agg(F.collect_set(F.lower("name")).alias("names")))  # a schema's relations
    w = Window.partitionBy(*keys)
    j = candidates.join(names, ["src", "dst"], "left")
    part = F.exists("names", lambda n: n.contains(F.col("type")) | F.col("type").contains(n))
    weight = F.when(F.array_contains("names", F.col("type")), F.col("confidence")).when(part, F.col("confidence") * 0.8)
    j = j.withColumn("__w", weight).withColumn("__any", F.max("__w").over(w))
    return j.where("names IS NULL OR __any IS NULL OR __w IS NOT NULL").select(*keys, "src", "dst", "ordinal", "type", F.coalesce("__w", "confidence").alias("confidence"))


def classified(found: Column) -> Column:
    """G9 without a model: the first three as they stand if the very first is sure (0.8), else the best five, each type once."""
    sure = F.get(found, F.lit(0))["confidence"] >= 0.8
    best = F.slice(F.transform(F.array_sort(F.transform(found, lambda x, i: F.struct((-x["confidence"]).alias("c"), i.alias("i"), x["type"].alias("type")))), lambda x: F.struct(x["type"].alias("type"), (-x["c"]).alias("confidence"))), 1, 5)
    return F.when(sure, F.slice(found, 1, 3)).otherwise(best)


class Classifier(Protocol):
    """A model that classifies relations, called once a batch on the executors; it is sent to them, so it must be picklable."""

    def classify(self, rows: list[tuple[str, str | None, str | None]]) -> list[list[tuple[str, float]]]:
        """For each (text, source type, target type) its types with confidence, the best first; an empty list for no answer."""
        ...


def classified_by(rows: DataFrame, classifier: Classifier, keys: list[str]) -> DataFrame:
    """(keys, found): rows (keys, text, src, dst) by a model, and by the rules where it has no answer or fails.

    Confidences are brought into 0 to 1 and answers without a type dropped, so what follows (G8, G9) sees the same shape.
    """
    kind = ArrayType(StructType([StructField("type", StringType()), StructField("confidence", DoubleType())]))

    @F.pandas_udf(kind)
    def model(text: pd.Series, src: pd.Series, dst: pd.Series) -> pd.Series:
        try:
            got = classifier.classify(list(zip(text, src, dst)))
            if len(got) != len(text):
                raise ValueError("as many answers as rows are needed")
        except Exception:  # noqa: BLE001 - a model's failure of whatever kind leaves the batch to the rules
            got = [[] for _ in text]
        clean = [[{"type": t, "confidence": min(1.0, max(0.0, float(c)))} for t, c in x or [] if t and t.strip()] for x in got]
        return pd.Series(clean, index=text.index)

    both = rows.withColumn("__model", model("text", "src", "dst")).withColumn("__rules", by_rules(F.col("text"), F.col("src"), F.col("dst")))
    return both.select(*keys, F.when(F.size("__model") > 0, F.col("__model")).otherwise(F.col("__rules")).alias("found"))
