"""The typed graph that the star-schema tables hold, and the text graph over documents.

Every node and edge carries a BIGINT index that states its order without a global sort: the code of its type or
relation in the high digits, its keys in the low ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_TYPES = (("Customer", "customer", "c_custkey", "c_name"), ("Nation", "nation", "n_nationkey", "n_name"), ("Part", "part", "p_partkey", "p_name"), ("Region", "region", "r_regionkey", "r_name"), ("Supplier", "supplier", "s_suppkey", "s_name"))
NODE_STEP = 10**15
EDGE_STEP = 10**18
KEY_STEP = 10**9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_idx, id, type, name)"""
    out = None
    for code, (kind, name, key, label) in enumerate(NODE_TYPES):
        part = table(spark, sf_dir, name).select((F.col(key).cast("long") + code * NODE_STEP).alias("node_idx"), F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out


def _edge(df: DataFrame, code: int, relation: str, src: str, src_key: str, dst: str, dst_key: str) -> DataFrame:
    a, b = F.col(src_key).cast("long"), F.col(dst_key).cast("long")
    over = F.raise_error(F.lit(f"keys of {KEY_STEP} and more do not fit into edge_idx")).cast("long")  # rather than equal indexes of different edges
    return df.select(
        F.when((a >= KEY_STEP) | (b >= KEY_STEP), over).otherwise(F.lit(code * EDGE_STEP) + a * KEY_STEP + b).alias("edge_idx"),
        F.concat(F.lit(f"{src}:"), F.col(src_key).cast("string")).alias("source"),
        F.lit(relation).alias("relationship_type"),
        F.concat(F.lit(f"{dst}:"), F.col(dst_key).cast("string")).alias("target"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(edge_idx, source, relationship_type, target). A filter on the relation leaves the tables of the others unread."""
    t = lambda n: table(spark, sf_dir, n)
    out = _edge(t("customer"), 0, "located_in", "customer", "c_custkey", "nation", "c_nationkey")
    out = out.unionByName(_edge(t("supplier"), 1, "located_in", "supplier", "s_suppkey", "nation", "s_nationkey"))
    out = out.unionByName(_edge(t("nation"), 2, "part_of", "nation", "n_nationkey", "region", "n_regionkey"))
    return out.unionByName(_edge(t("lineitem").select("l_suppkey", "l_partkey").distinct(), 3, "supplies", "supplier", "l_suppkey", "part", "l_partkey"))


def edges_at(spark: SparkSession, sf_dir: str, ids: list[str]) -> DataFrame:
    """The edges with an end among some ids: keys are read back from the ids, so that the filter reaches the scan of each table."""
    t = lambda n: table(spark, sf_dir, n)

    def at(df: DataFrame, src: str, src_key: str, dst: str, dst_key: str) -> DataFrame:
        keys = {kind: [int(x[len(kind) + 1 :]) for x in ids if x.startswith(f"{kind}:") and x[len(kind) + 1 :].lstrip("-").isdigit()] for kind in (src, dst)}
        return df.where(F.col(src_key).isin(keys[src]) | F.col(dst_key).isin(keys[dst]))

    parts = [("customer", "located_in", "customer", "c_custkey", "nation", "c_nationkey"), ("supplier", "located_in", "supplier", "s_suppkey", "nation", "s_nationkey"), ("nation", "part_of", "nation", "n_nationkey", "region", "n_regionkey"), ("lineitem", "supplies", "supplier", "l_suppkey", "part", "l_partkey")]
    out = None
    for code, (name, relation, *ends) in enumerate(parts):
        rows = at(t(name), *ends).select(ends[1], ends[3])
        part = _edge(rows.distinct() if name == "lineitem" else rows, code, relation, *ends)
        out = part if out is None else out.unionByName(part)
    return out


NODES_SQL = " UNION ALL ".join(f"SELECT CAST({key} AS BIGINT) + {code * NODE_STEP} AS node_idx, '{name}:' || {key} AS id, '{kind}' AS type, {label} AS name FROM {name}" for code, (kind, name, key, label) in enumerate(NODE_TYPES))


def _edge_sql(frm: str, code: int, relation: str, src: str, src_key: str, dst: str, dst_key: str) -> str:
    return f"SELECT CAST({code * EDGE_STEP} AS BIGINT) + CAST({src_key} AS BIGINT) * {KEY_STEP} + CAST({dst_key} AS BIGINT) AS edge_idx, '{src}:' || {src_key} AS source, '{relation}' AS relationship_type, '{dst}:' || {dst_key} AS target FROM {frm}"


PLACE_SQL = " UNION ALL ".join([_edge_sql("customer", 0, "located_in", "customer", "c_custkey", "nation", "c_nationkey"), _edge_sql("supplier", 1, "located_in", "supplier", "s_suppkey", "nation", "s_nationkey"), _edge_sql("nation", 2, "part_of", "nation", "n_nationkey", "region", "n_regionkey")])
EDGES_SQL = PLACE_SQL + " UNION ALL " + _edge_sql("(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)", 3, "supplies", "supplier", "l_suppkey", "part", "l_partkey")
#: Common table expressions for a query's SQL.
GRAPH = f"nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL})"
