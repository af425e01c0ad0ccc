"""Upserts expressed as joins of the stored table with the incoming rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def insert_if_absent(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet; one row per key."""
    return incoming.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def replace_by_key(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored table with incoming rows put in, replacing rows of equal key."""
    kept = stored.join(incoming.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(incoming)


def changed(left: DataFrame, right: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Rows of ``right`` that are new or differ from ``left`` in a measure (nulls compare equal)."""
    before = left.select(*keys, F.struct(*measures).alias("_before"))
    after = right.withColumn("_after", F.struct(*measures))
    joined = after.join(before, list(keys), "left")
    return joined.where(~F.col("_after").eqNullSafe(F.col("_before"))).drop("_after", "_before")


def snapshot_diff(
    left: DataFrame, right: DataFrame, keys: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Keys added, removed or altered between two snapshots; empty when both are equal."""
    a = left.select(*keys, F.struct(*measures).alias("_a"))
    b = right.select(*keys, F.struct(*measures).alias("_b"))
    return (
        a.join(b, list(keys), "full_outer")
        .where(~F.col("_a").eqNullSafe(F.col("_b")))
        .select(
            *keys,
            F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed")
            .otherwise("altered").alias("change"),
        )
    )
