"""Derived counters rebuilt from interaction rows, drift and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.operators.facts import hot_score
from quillspark.operators.ordering import with_row

NOTE_COUNTERS = ["like_count", "collect_count", "comment_count", "share_count"]


def tag_interactions(
    likes: DataFrame, collects: DataFrame, comments: DataFrame, shares: DataFrame
) -> DataFrame:
    """Four interaction tables as one relation, so the counts need a single shuffle."""
    tagged = None
    for kind, part in (("like", likes), ("collect", collects), ("comment", comments), ("share", shares)):
        status = F.col("status") if kind == "comment" else F.lit(1)
        rows = part.select("note_id", F.lit(kind).alias("kind"), status.cast("int").alias("status"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged


def note_counts(interactions: DataFrame) -> DataFrame:
    """Likes, collects, live comments and shares per note that has any."""
    kind = F.col("kind")
    return interactions.groupBy("note_id").agg(
        F.count_if(kind == "like").alias("like_count"),
        F.count_if(kind == "collect").alias("collect_count"),
        F.count_if((kind == "comment") & (F.col("status") == 1)).alias("comment_count"),
        F.count_if(kind == "share").alias("share_count"),
    )


def rebuild_note_counters(notes: DataFrame, interactions: DataFrame) -> DataFrame:
    """Every note with counters recomputed from its interaction rows; notes without any get zeros."""
    counts = note_counts(interactions).select(
        F.col("note_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in NOTE_COUNTERS]
    )
    joined = notes.join(counts, "id", "left")
    fresh = {c: F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in NOTE_COUNTERS}
    score = hot_score({"view_count": F.col("view_count"), **fresh})
    kept = [c for c in notes.columns if c not in (*NOTE_COUNTERS, "hot_score")]
    return joined.select(*kept, *[expr.alias(c) for c, expr in fresh.items()], score.alias("hot_score"))


def comment_counts(comments: DataFrame, likes: DataFrame) -> DataFrame:
    """Likes and live replies per comment id, from one aggregation over both kinds of rows."""
    rows = likes.select(F.col("comment_id").alias("id"), F.lit(True).alias("is_like")).unionByName(
        comments.where("status = 1 AND parent_id > 0")
        .select(F.col("parent_id").alias("id"), F.lit(False).alias("is_like"))
    )
    return rows.groupBy("id").agg(
        F.count_if(F.col("is_like")).alias("like_count"),
        F.count_if(~F.col("is_like")).alias("reply_count"),
    )


def rebuild_comment_counters(comments: DataFrame, likes: DataFrame) -> DataFrame:
    kept = [c for c in comments.columns if c not in ("like_count", "reply_count")]
    return comments.select(*kept).join(comment_counts(comments, likes), "id", "left").fillna(
        0, ["like_count", "reply_count"]
    )


def counter_drift(stored: DataFrame, rebuilt: DataFrame, measures: list[str]) -> DataFrame:
    """Rows whose stored counters differ from the rebuilt ones, with both values."""
    a = stored.select("id", *[F.col(m).alias(f"stored_{m}") for m in measures])
    b = rebuilt.select("id", *[F.col(m).alias(f"actual_{m}") for m in measures])
    differs = F.lit(False)
    for m in measures:
        differs = differs | ~F.col(f"stored_{m}").eqNullSafe(F.col(f"actual_{m}"))
    return a.join(b, "id").where(differs)


def repair_batch(table: DataFrame, last_id: int, limit: int) -> DataFrame:
    """The next ``limit`` ids after a cursor; starts again from the lowest id once none is left."""
    after = table.where(F.col("id") > last_id).select("id").orderBy("id").limit(limit)
    if last_id <= 0:
        return after
    again = table.select("id").orderBy("id").limit(limit)
    ahead = after.select(F.count("*").alias("_ahead"))
    wrapped = with_row(again, ahead).where("_ahead = 0").select("id")
    return after.unionByName(wrapped)


def status_histogram(table: DataFrame, status: str = "status") -> DataFrame:
    return table.groupBy(status).agg(F.count("*").alias("row_count"))


def oldest_unsent_age(outbox: DataFrame, now: Column, sent: str = "sent") -> DataFrame:
    """Seconds since the oldest unsent row was created, never below zero; zero when none is."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.min("created_at"))
    return outbox.where(F.col("status") != sent).agg(
        F.coalesce(F.greatest(F.lit(0), age), F.lit(0)).cast("bigint").alias("oldest_age_seconds"),
        F.count("*").alias("unsent_count"),
    )


def table_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """One labelled count per relation."""
    result = None
    for label, part in parts.items():
        row = part.agg(F.count("*").alias("row_count")).select(F.lit(label).alias("label"), "row_count")
        result = row if result is None else result.unionByName(row)
    return result


def count_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    return (
        before.withColumnRenamed("row_count", "before_count")
        .join(after.withColumnRenamed("row_count", "after_count"), "label", "full_outer")
        .fillna(0, ["before_count", "after_count"])
        .withColumn("delta", F.col("after_count") - F.col("before_count"))
    )


def checkpoint_backfill(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Highest chunk id and chunk count per run; runs without chunks get zero."""
    per_run = chunks.groupBy("run_id").agg(
        F.max("chunk_id").alias("checkpoint_chunk_id"), F.count("*").alias("checkpoint_points")
    )
    return runs.join(per_run, "run_id", "left").fillna(0, ["checkpoint_chunk_id", "checkpoint_points"])
