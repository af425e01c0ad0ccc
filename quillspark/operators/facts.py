"""Daily behaviour facts and event naming."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.contract import (
    DOMAIN_EVENTS, HOT_WEIGHTS, INTERACTION_EVENTS, NOTE_VIEW_EVENTS, USER_VIEW_EVENTS,
)

NOTE_FACT_KEYS = ["project_id", "note_id", "fact_date"]
NOTE_FACT_MEASURES = [
    "view_count", "like_count", "collect_count", "comment_count", "share_count",
    "unique_user_count", "event_count",
]
USER_FACT_KEYS = ["project_id", "user_id", "fact_date"]
USER_FACT_MEASURES = [
    "view_count", "interaction_count", "content_count", "comment_count", "active_note_count", "event_count",
]


def in_window(df: DataFrame, column: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Half-open time window; the bounds reach the scan as pushed filters."""
    if not start < end:
        raise ValueError("the window must satisfy start < end")
    kind = df.schema[column].dataType  # a bound of the column's own type keeps the filter pushable
    low, high = (F.lit(t.isoformat(sep=" ")).cast(kind) for t in (start, end))
    return df.where((F.col(column) >= low) & (F.col(column) < high))


def _count_of(types: list[str]) -> Column:
    return F.count_if(F.col("event_type").isin(types))


def note_daily_facts(events: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Counts by event kind, distinct users and total per project, note and day."""
    return (
        in_window(events, "occurred_at", start, end)
        .where(F.col("note_id").isNotNull())
        .groupBy("project_id", "note_id", F.to_date("occurred_at").alias("fact_date"))
        .agg(
            _count_of(NOTE_VIEW_EVENTS).alias("view_count"),
            _count_of(["note_liked"]).alias("like_count"),
            _count_of(["note_collected"]).alias("collect_count"),
            _count_of(["comment_created"]).alias("comment_count"),
            _count_of(["note_shared"]).alias("share_count"),
            F.count_distinct("user_id").alias("unique_user_count"),
            F.count("*").alias("event_count"),
        )
    )


def user_daily_facts(events: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Views, interactions, content, comments, distinct notes and total per project, user and day."""
    return (
        in_window(events, "occurred_at", start, end)
        .groupBy("project_id", "user_id", F.to_date("occurred_at").alias("fact_date"))
        .agg(
            _count_of(USER_VIEW_EVENTS).alias("view_count"),
            _count_of(INTERACTION_EVENTS).alias("interaction_count"),
            _count_of(["note_created"]).alias("content_count"),
            _count_of(["comment_created"]).alias("comment_count"),
            F.count_distinct("note_id").alias("active_note_count"),
            F.count("*").alias("event_count"),
        )
    )


def behavior_event_type(event_type: Column) -> Column:
    """``note.liked`` becomes ``note_liked``; unknown names stay as they are."""
    return F.when(event_type.isin(DOMAIN_EVENTS), F.translate(event_type, ".", "_")).otherwise(event_type)


def hot_score(counters: dict[str, Column] | None = None) -> Column:
    """Weighted sum of a note's counters."""
    counters = counters or {name: F.col(name) for name in HOT_WEIGHTS}
    total = F.lit(0.0)
    for name, weight in HOT_WEIGHTS.items():
        total = total + counters[name].cast("double") * float(weight)
    return total
