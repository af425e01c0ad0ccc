"""Domain-event envelopes: stream source, validation, and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillspark.operators.facts import behavior_event_type

MAX_ATTEMPTS = 5
ENVELOPE = (
    "event_id string, event_type string, aggregate_type string, aggregate_id bigint, schema_version int, "
    "producer string, correlation_id string, trace_id string, payload string, occurred_at timestamp"
)
PAYLOAD = "user_id bigint, project_id bigint, note_id bigint, comment_id bigint, parent_id bigint"


def envelope_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Newline-delimited envelopes from a directory, one ``value`` per message."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def parse(messages: DataFrame) -> DataFrame:
    """Typed events with a ``failure`` column, null when the message is valid.

    The raw text stays in ``value`` so that rejected messages can be replayed unchanged.
    """
    envelope = F.from_json("value", ENVELOPE)
    typed = messages.withColumn("e", envelope).withColumn("p", F.from_json("e.payload", PAYLOAD))
    version = F.when(F.coalesce("e.schema_version", F.lit(0)) == 0, 1).otherwise(F.col("e.schema_version"))
    missing = (F.coalesce("e.event_id", F.lit("")) == "") | (F.coalesce("e.event_type", F.lit("")) == "")
    failure = (
        F.when(F.col("e").isNull() | missing, "event_id and event_type are required")
        .when(version != 1, F.concat(F.lit("unsupported event schema version "), version.cast("string")))
        .when(F.col("e.payload").isNotNull() & F.try_parse_json("e.payload").isNull(), "payload is not valid JSON")
        .when(F.coalesce("p.user_id", F.lit(0)) <= 0, "missing user_id")
    )
    blank = lambda c: F.nullif(F.col(c), F.lit(0))
    return typed.select(
        "value", F.col("e.event_id").alias("source_event_id"), F.col("e.event_type").alias("domain_event_type"),
        behavior_event_type(F.col("e.event_type")).alias("event_type"), F.col("p.project_id").alias("project_id"),
        F.col("p.user_id").alias("user_id"), blank("p.note_id").alias("note_id"), blank("p.comment_id").alias("comment_id"),
        F.coalesce("e.payload", F.lit("{}")).alias("event_payload"), F.col("e.occurred_at").alias("occurred_at"),
        failure.alias("failure"),
    )


def split_attempts(failed: DataFrame, earlier: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed messages still to be retried, and those out of attempts.

    ``earlier`` holds ``(message_hash, attempts)`` of earlier rounds.
    """
    counted = failed.withColumn("message_hash", F.sha2("value", 256)).join(earlier, "message_hash", "left").withColumn(
        "attempts", F.coalesce("attempts", F.lit(0)) + 1
    )
    return counted.where(F.col("attempts") < MAX_ATTEMPTS), counted.where(F.col("attempts") >= MAX_ATTEMPTS)


def dead_letters(rejected: DataFrame, failed_at: Column) -> DataFrame:
    return rejected.select(
        F.coalesce("source_event_id", F.lit("")).alias("event_id"), F.coalesce("domain_event_type", F.lit("")).alias("event_type"),
        F.col("attempts").cast("bigint").alias("deliveries"), "failure", F.col("value").alias("original_message"),
        failed_at.alias("failed_at"),
    )


def inspect_dead_letters(letters: DataFrame, event_id: str | None = None, limit: int = 100) -> DataFrame:
    """Dead letters, newest first, optionally of one event."""
    rows = letters if event_id is None else letters.where(F.col("event_id") == event_id)
    return rows.orderBy(F.desc("failed_at"), "event_id").limit(limit)


def replay_dead_letters(letters: DataFrame, source_path: str) -> None:
    """Write the original messages back to the stream's source directory."""
    letters.select(F.col("original_message").alias("value")).write.mode("append").text(source_path)


def event_lag(events: DataFrame, now: Column) -> DataFrame:
    """Seconds between occurrence and processing."""
    return events.withColumn("lag_seconds", F.unix_timestamp(now) - F.unix_timestamp("occurred_at"))
