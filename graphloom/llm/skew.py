"""Keys that hold a large share of all rows: found by counts, spread by a salt, aggregated before they are shuffled.

A key is *heavy* if it has more than `salt_rows` rows. Of the heavy keys the `MOST_HEAVY` with most rows are salted; any
other key holds at most 1/MOST_HEAVY of all rows, which is no more than one task's share. So the list of salted keys,
and an aggregate of one row for each of them, have a fixed bound and can be broadcast whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.session import cut

SALT_ROWS = 100_000
MOST_HEAVY = 50_000


def heavy(rows: DataFrame, keys: list[str], salt_rows: int = SALT_ROWS, total: int | None = None) -> DataFrame | None:
    """(keys, salts) of the heavy keys, at most MOST_HEAVY rows; None if there are none. total: the number of rows, if it is known."""
    if total is not None and total <= salt_rows:
        return None
    counts = rows.groupBy(*keys).count().where(F.col("count") > salt_rows)
    top = cut(counts.orderBy(F.desc("count"), *keys).limit(MOST_HEAVY).select(*keys, F.ceil(F.col("count") / salt_rows).cast("int").alias("salts")))
    return None if top.isEmpty() else top


def salted(rows: DataFrame, keys: list[str], by: list[str], top: DataFrame | None) -> DataFrame:
    """rows with `salt`: a hash of the columns `by` for rows of heavy keys, 0 for others."""
    if top is None:
        return rows.withColumn("salt", F.lit(0))
    wide = rows.join(F.broadcast(top), keys, "left")
    return wide.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("salts")), F.lit(0)).cast("int")).drop("salts")


def spread(rows: DataFrame, keys: list[str], top: DataFrame | None) -> DataFrame:
    """rows of the small side of a join (one a key), once for each salt of its key."""
    if top is None:
        return rows.withColumn("salt", F.lit(0))
    wide = rows.join(F.broadcast(top), keys, "left")
    return wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def over_keys(rows: DataFrame, keys: list[str], by: list[str], top: DataFrame | None, **aggregates: Column) -> DataFrame:
    """rows with an aggregate over all rows of its key in each. Heavy keys are aggregated before the shuffle, and joined by broadcast."""
    if top is None:
        return rows.withColumns({n: a.over(Window.partitionBy(*keys)) for n, a in aggregates.items()})
    whole = rows.join(F.broadcast(top.select(*keys)), keys).groupBy(*keys).agg(*(a.alias(f"__{n}") for n, a in aggregates.items()))
    local = salted(rows, keys, by, top).withColumns({n: a.over(Window.partitionBy(*keys, "salt")) for n, a in aggregates.items()})
    return local.join(F.broadcast(whole), keys, "left").withColumns({n: F.coalesce(f"__{n}", n) for n in aggregates}).drop("salt", *(f"__{n}" for n in aggregates))
