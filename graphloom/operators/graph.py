"""Graph construction, statistics and shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the one that comes first; one aggregate, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*")


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*")


def from_typed(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """G1: nodes (id, type) of entities (idx, name, type) and triples (source, target); the first type wins, endpoints without entity get none."""
    typed = entities.groupBy("name").agg(F.min_by("type", "idx").alias("type")).withColumnRenamed("name", "id")
    ends = endpoints(triples)
    return typed.unionByName(ends.join(typed, "id", "left_anti").withColumn("type", F.lit(None).cast("string")))


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct endpoints (id)."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).where("id IS NOT NULL").distinct()


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an endpoint that is no node."""
    ids = nodes.select("id")
    bad = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").select("edge_idx", F.lit("source").alias("side"))
    return bad.unionByName(edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select("edge_idx", F.lit("target").alias("side")))


def build(triples: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges of triples (edge_idx, source, relationship_type, target), without self loops; the detail is the relation's detail, else its description, else the triple as words."""
    known = relations.groupBy(F.col("name").alias("relationship_type")).agg(F.max_by(F.coalesce("detail", "description"), "idx").alias("known"))
    return (
        triples.where("source <> target")
        .join(known, "relationship_type", "left")
        .withColumn("relationship_detail", F.coalesce("known", F.concat_ws(" ", "source", "relationship_type", "target")))
        .drop("known")
    )


def checked_relationships(df: DataFrame) -> DataFrame:
    """Each row with the first rule that it breaks, null if none."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return df.withColumn(
        "problem",
        F.when(blank("source"), "empty source").when(blank("target"), "empty target").when(F.col("source") == F.col("target"), "self relation").when(F.col("confidence").isNull() | ~F.col("confidence").between(0.0, 1.0), "confidence out of range"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree), each edge counting at both ends."""
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, label, n): counts, node types (null: Unknown) and relations."""
    n = F.count(F.lit(1)).alias("n")
    return (
        nodes.select(F.lit("node_type").alias("kind"), F.coalesce("type", F.lit("Unknown")).alias("label")).groupBy("kind", "label").agg(n)
        .unionByName(edges.select(F.lit("relationship_type").alias("kind"), F.col("relationship_type").alias("label")).groupBy("kind", "label").agg(n))
        .unionByName(nodes.agg(n).select(F.lit("total").alias("kind"), F.lit("nodes").alias("label"), "n"))
        .unionByName(edges.agg(n).select(F.lit("total").alias("kind"), F.lit("edges").alias("label"), "n"))
    )


def hub_split(edges: DataFrame, threshold: int = 10) -> DataFrame:
    """(source, target, relationship_type, relationship_detail, kind): hub edges re-routed through a proxy for each hub and relation."""
    if threshold < 3:
        raise ValueError("the hub threshold must be at least 3")
    hubs = degrees(edges).where(F.col("degree") >= threshold).select("id")
    routed = (
        edges.join(hubs.select(F.col("id").alias("source"), F.lit(True).alias("hub_source")), "source", "left")
        .join(hubs.select(F.col("id").alias("target"), F.lit(True).alias("hub_target")), "target", "left")
        .withColumn("hub", F.when(F.col("hub_source"), F.col("source")).when(F.col("hub_target"), F.col("target")))
    )
    proxy = F.concat(F.lit("hubproxy::"), F.col("hub"), F.lit("::"), F.col("relationship_type"))
    kept = routed.select(
        F.when(F.col("hub") == F.col("source"), proxy).otherwise(F.col("source")).alias("source"),
        F.when(F.col("hub").isNotNull() & (F.col("hub") != F.col("source")), proxy).otherwise(F.col("target")).alias("target"),
        "relationship_type", "relationship_detail", F.when(F.col("hub").isNull(), "plain").otherwise("hub_split_edge").alias("kind"),
    ).distinct()
    both = edges.select("relationship_type", F.explode(F.array("source", "target")).alias("hub")).distinct().join(hubs.withColumnRenamed("id", "hub"), "hub", "left_semi")
    connectors = both.select(F.col("hub").alias("source"), proxy.alias("target"), "relationship_type", F.lit("hub split connector").alias("relationship_detail"), F.lit("hub_proxy_connector").alias("kind"))
    return connectors.unionByName(kept)


def flatten_proxies(split: DataFrame) -> DataFrame:
    """The edges before the split: connectors go, proxy ids give back their hub, duplicates are merged."""
    hub_of = lambda c: F.when(F.col(c).startswith("hubproxy::"), F.regexp_replace(F.substring(F.col(c), 11, 1 << 30), "::[^:]*$", "")).otherwise(F.col(c))
    return split.where("kind <> 'hub_proxy_connector'").select(hub_of("source").alias("source"), hub_of("target").alias("target"), "relationship_type", "relationship_detail").distinct()


def hub_dominance(edges: DataFrame, max_share: float = 0.30, min_rest: float = 0.50) -> DataFrame:
    """One row: edges, the top entity's count, its share, the rest's share, and whether the gate trips."""
    total = edges.agg(F.count(F.lit(1)).alias("edges"))
    top = degrees(edges).agg(F.max("degree").alias("top"))
    out = total.crossJoin(top).withColumn("share", F.col("top") / F.col("edges")).withColumn("rest", (F.col("edges") - F.col("top")) / F.col("edges"))
    return out.withColumn("dominated", (F.col("share") > max_share) | (F.col("rest") < min_rest))


def multiplicity(edges: DataFrame) -> DataFrame:
    """K9: undirected pairs with the number of edges between them."""
    return edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count(F.lit(1)).alias("weight"))


def positions(df: DataFrame, key: Column, order: str, alias: str, step: int = 1_000_000) -> DataFrame:
    """Zero-based position in the order of a BIGINT column, without a global sort: ranks within ranges of keys, plus the counts before."""
    ranged = df.withColumn("__range", F.floor(key / step).cast("long"))
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))  # one row for each range
    return ranged.join(before, "__range").withColumn(alias, F.col("__before") + F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1).drop("__range", "__before")
