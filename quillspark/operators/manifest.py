"""Order-free checksums of row sets, manifest comparison and run lineage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import hash_parts

BUCKET_DIGITS = 6
FOLD_DIGITS = 3
SAMPLE_IDS = 100


def _digest_of(sorted_values: Column) -> Column:
    return F.sha2(F.array_join(sorted_values, "\n"), 256)


def manifest_checksum(
    rows: DataFrame, parts: list[Column | str], header: list[str], groups: list[str] | None = None
) -> DataFrame:
    """``(groups..., row_count, checksum)``: a function of the row set and the header only.

    Rows are bucketed by a prefix of their own hash, so buckets are even whatever the keys
    look like: six hex digits keep a bucket near 60k rows for 10^12 rows. Bucket digests are
    folded 4096 at a time until one is left, so no list grows with the table.
    """
    groups = list(groups or [])
    level = (
        rows.select(*groups, hash_parts(*parts).alias("h"))
        .groupBy(*groups, F.substring("h", 1, BUCKET_DIGITS).alias("bucket"))
        .agg(_digest_of(F.sort_array(F.collect_list("h"))).alias("digest"), F.count("*").alias("row_count"))
    )
    for digits in range(BUCKET_DIGITS - FOLD_DIGITS, -1, -FOLD_DIGITS):
        ordered = F.sort_array(F.collect_list(F.struct("bucket", "digest")))
        level = level.groupBy(*groups, F.substring("bucket", 1, digits).alias("bucket")).agg(
            _digest_of(F.transform(ordered, lambda s: s["digest"])).alias("digest"),
            F.sum("row_count").alias("row_count"),
        )
    return level.select(
        *groups, "row_count", hash_parts(*[F.lit(h) for h in header], "digest").alias("checksum")
    )


def union_manifest(parts: dict[str, Column | DataFrame]) -> DataFrame:
    """Keys of several relations as one ``(item_type, item_key)`` list."""
    result = None
    for kind, keys in parts.items():
        rows = keys.select(F.lit(kind).alias("item_type"), F.col(keys.columns[0]).alias("item_key"))
        result = rows if result is None else result.unionByName(rows)
    return result


def compare_manifests(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Every key of either side with its status: exact, missing, orphan or mismatched."""
    e = expected.select(key, F.col(value).alias("expected_hash"), F.lit(True).alias("_e"))
    a = actual.select(key, F.col(value).alias("actual_hash"), F.lit(True).alias("_a"))
    return e.join(a, key, "full_outer").select(
        key,
        F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "orphan")
        .when(F.col("expected_hash").eqNullSafe(F.col("actual_hash")), "exact").otherwise("mismatched")
        .alias("status"),
    )


def digest_tree(rows: DataFrame, key: str, parts: list[Column | str]) -> DataFrame:
    """``level, bucket, digest, row_count``: digests of a row set in leaves (level 2) and branches of leaves (level 1).

    A row lies in the leaf that the first digits of its key's hash name, so equal sets have equal
    trees and a changed, missing or added row changes one leaf and its branch. Stored beside a
    manifest, the tree lets a later comparison read the leaves that differ only.
    """
    leaves = rows.select(_leaf_of(key).alias("bucket"), hash_parts(*parts).alias("h")).groupBy("bucket").agg(
        _digest_of(F.sort_array(F.collect_list("h"))).alias("digest"), F.count("*").alias("row_count"))
    ordered = F.sort_array(F.collect_list(F.struct("bucket", "digest")))
    branches = leaves.groupBy(F.substring("bucket", 1, FOLD_DIGITS).alias("branch")).agg(
        _digest_of(F.transform(ordered, lambda s: s["digest"])).alias("digest"), F.sum("row_count").alias("row_count"))
    return leaves.select(F.lit(2).alias("level"), "bucket", "digest", "row_count").unionByName(
        branches.select(F.lit(1).alias("level"), F.col("branch").alias("bucket"), "digest", "row_count"))


def _leaf_of(key: str) -> Column:
    return F.substring(F.sha2(F.col(key).cast("string"), 256), 1, BUCKET_DIGITS)


def differing_leaves(stored: DataFrame, actual: DataFrame) -> DataFrame:
    """``bucket`` of the leaves in which two trees differ, descending from the branches that do."""

    def differing(level: int, within: DataFrame | None = None) -> DataFrame:
        sides = []
        for tree, name in ((stored, "_stored"), (actual, "_actual")):
            side = tree.where(F.col("level") == level).select("bucket", F.col("digest").alias(name))
            sides.append(side if within is None else side.join(within, F.substring("bucket", 1, FOLD_DIGITS) == F.col("_branch"), "left_semi"))
        return sides[0].join(sides[1], "bucket", "full_outer").where(~F.col("_stored").eqNullSafe(F.col("_actual"))).select("bucket")

    return differing(2, differing(1).withColumnRenamed("bucket", "_branch"))


def compare_by_tree(expected: DataFrame, stored_tree: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """``compare_manifests`` without the exact rows: only leaves whose digest differs are joined row by row.

    ``stored_tree`` is the ``digest_tree`` of ``expected`` over key and value, as it was stored.
    """
    leaves = differing_leaves(stored_tree, digest_tree(actual, key, [key, value]))
    near = lambda rows: rows.join(leaves, _leaf_of(key) == F.col("bucket"), "left_semi")
    return compare_manifests(near(expected), near(actual), key, value).where("status <> 'exact'")


def id_sample(rows: DataFrame, key: str, limit: int = SAMPLE_IDS) -> DataFrame:
    """The lowest ids of a report as one array."""
    first = rows.select(key).orderBy(key).limit(limit)
    return first.agg(F.sort_array(F.collect_list(key)).alias("sample_ids"), F.count("*").alias("sample_size"))


def record_checksum(columns: list[str]) -> Column:
    """Checksum of one record: JSON of its columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def run_record(
    spark, run_id: str, started_at: dt.datetime, status: str, counts: dict[str, int], error: str | None = None
) -> DataFrame:
    """One lineage row for a job run, to be appended to the ``runs`` table."""
    if not run_id.strip():
        raise ValueError("run_id is required")
    if status not in ("running", "completed", "failed"):
        raise ValueError(f"unknown run status {status!r}")
    return spark.createDataFrame(
        [(run_id, started_at, status, dict(counts), (error or "")[:4000])],
        "run_id string, started_at timestamp, status string, counts map<string,bigint>, error_message string",
    )
