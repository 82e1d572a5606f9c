"""Splitting hot join keys.

A key is hot when one side holds more than ``limit`` rows of it, so a table of hot keys has at most rows / limit
entries. That bound is what allows it to be broadcast. Rows of a hot key are spread over parts by a hash of the row and
the other side is repeated once per part, so every pair still meets exactly once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

HOT_ROWS = 1_000_000
SALT = "__salt"


def hot_keys(
    left: DataFrame, right: DataFrame, keys: Sequence[str], limit: int, split_right: bool = True
) -> DataFrame:
    """Keys with more than ``limit`` rows on a side, with the number of parts for each side."""
    tagged = left.select(*keys, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(
        right.select(*keys, F.lit(0).alias("__l"), F.lit(1).alias("__r"))
    )
    counts = tagged.groupBy(*keys).agg(F.sum("__l").alias("__nl"), F.sum("__r").alias("__nr"))
    hot = counts.where((F.col("__nl") > limit) | (F.col("__nr") > limit))
    right_parts = F.ceil(F.greatest(F.col("__nr"), F.lit(1)) / limit).cast("int") if split_right else F.lit(1)
    return hot.select(
        *keys,
        F.ceil(F.greatest(F.col("__nl"), F.lit(1)) / limit).cast("int").alias("__pl"),
        right_parts.alias("__pr"),
    )


def split_hot(
    left: DataFrame, right: DataFrame, keys: Sequence[str], limit: int | None = HOT_ROWS, split_right: bool = True
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a salt column, and the keys to join on.

    Without ``split_right`` every part of the left side meets the whole right side of its key.
    """
    keys = list(keys)
    if limit is None:
        return left, right, keys
    hot = F.broadcast(hot_keys(left, right, keys, limit, split_right))

    def salted(df: DataFrame, mine: str, other: str, mine_first: bool) -> DataFrame:
        own = F.when(F.col(mine).isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*df.columns), F.coalesce(F.col(mine), F.lit(1))).cast("int")
        )
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        df = df.join(hot, keys, "left").withColumn("__own", own).withColumn("__copy", copies)
        a, b = (("__own", "__copy") if mine_first else ("__copy", "__own"))
        width: Column = F.coalesce(F.col("__pr"), F.lit(1))
        return df.withColumn(SALT, F.col(a) * width + F.col(b)).drop("__own", "__copy", "__pl", "__pr")

    return salted(left, "__pl", "__pr", True), salted(right, "__pr", "__pl", False), [*keys, SALT]
