"""Materialized top-k tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions.contract import COMMENT_LIKE_WEIGHT
from quillspark.operators.ordering import top_per_group


def note_rankings(notes: DataFrame, limit: int) -> DataFrame:
    """Best published notes overall and per category, tagged with their scope."""
    scored = notes.where("status = 'published'").select("id", "category", F.col("hot_score").alias("score"))
    best_first = [F.desc("score"), F.desc("id")]
    overall = scored.orderBy(*best_first).limit(limit).withColumn("scope", F.lit("global"))
    by_category = top_per_group(scored, ["category"], best_first, limit).drop("rn")
    return overall.unionByName(by_category.withColumn("scope", F.lit("category")))


def comment_rankings(comments: DataFrame, notes: DataFrame, limit: int) -> DataFrame:
    """Most liked live comments of every published note."""
    live = comments.where("status = 1").join(
        notes.where("status = 'published'").select(F.col("id").alias("note_id")), "note_id", "left_semi"
    )
    top = top_per_group(live, ["note_id"], [F.desc("like_count"), F.desc("id")], limit)
    return top.select("id", "note_id", (F.col("like_count") * COMMENT_LIKE_WEIGHT).cast("double").alias("score"))


def sample_comments(comments: DataFrame, notes: DataFrame, note_limit: int, per_note: int) -> DataFrame:
    """Best comments of the first published notes by id."""
    chosen = notes.where("status = 'published'").select(F.col("id").alias("note_id")).orderBy("note_id").limit(note_limit)
    live = comments.where("status = 1").join(chosen, "note_id", "left_semi")
    top = top_per_group(live, ["note_id"], [F.desc("like_count"), F.desc("id")], per_note, "position")
    return top.select("note_id", "id", F.col("position").cast("bigint").alias("position"))


def top_activity(events: DataFrame, subject: str, limit: int = 20) -> DataFrame:
    """Most active subjects, ties by id."""
    return (
        events.where(F.col(subject).isNotNull()).groupBy(F.col(subject).alias("id"))
        .agg(F.count("*").alias("events")).orderBy(F.desc("events"), "id").limit(limit)
    )


def hydrate(ranking: DataFrame, readable: DataFrame) -> DataFrame:
    """Ranked ids joined with the rows the reader may see; unreadable ids fall out, order is kept."""
    return ranking.join(readable, "id").orderBy(F.desc("score"), F.desc("id"))
