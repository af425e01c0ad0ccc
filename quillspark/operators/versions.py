"""Versioned source registry, payload capture, dataset snapshots and fact versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions.contract import SNAPSHOT_SCHEME
from quillspark.functions.text import col, hash_parts
from quillspark.operators.manifest import manifest_checksum
from quillspark.operators.merge import replace_by_key
from quillspark.operators.ordering import running_changes, with_row

SOURCE_KEY = ["project_id", "source_type", "source_id"]


def first_active_dataset(projects: DataFrame, datasets: DataFrame, slug: str = "community") -> DataFrame:
    """Lowest active dataset id of each project under the given slug, null when there is none."""
    first = (
        datasets.where((F.col("status") == "active") & (F.col("slug") == slug))
        .groupBy("project_id").agg(F.min("id").alias("dataset_id"))
    )
    return projects.select(F.col("id").alias("project_id")).join(first, "project_id", "left")


def canonical_note(title, body):
    return F.concat_ws("\n\n", F.nullif(col(title), F.lit("")), F.nullif(col(body), F.lit("")))


def content_versions(history: DataFrame, keys: list[str], order: list[str], watched: list[str]) -> DataFrame:
    """Version of every row of a change history: one more whenever a watched column changed.

    One ordered scan whose carry is the last watched values and the changes so far, so a key
    with very many changes is spread out.
    """
    counted = running_changes(history, keys, order, watched, "_changes")
    return counted.select(*history.columns, (F.col("_changes") + 1).alias("content_version"))


def note_sources(notes: DataFrame, default_dataset: DataFrame) -> DataFrame:
    """Registry rows of notes: hash over title, body, status and visibility; a note without any text has a null text."""
    live = (F.col("status") != "deleted") & F.col("deleted_at").isNull()
    return notes.join(default_dataset, "project_id", "left").select(
        "project_id", "dataset_id", F.lit("note").alias("source_type"), F.col("id").alias("source_id"),
        F.col("content_version").cast("bigint").alias("source_version"), "visibility",
        hash_parts("title", "body", "status", "visibility").alias("content_hash"),
        F.when(live, "pending").otherwise("deleted").alias("index_status"),
        F.when(~live, F.coalesce("deleted_at", "updated_at")).alias("deleted_at"),
        F.nullif(canonical_note("title", "body"), F.lit("")).alias("canonical_text"),
        F.col("id").alias("note_id"), F.lit(None).cast("int").alias("media_position"),
        F.to_json(F.struct("body", "category", "status", "title", "visibility")).alias("source_payload"),
    )


def _parent(notes: DataFrame) -> DataFrame:
    gone = (F.col("status") == "deleted") | F.col("deleted_at").isNotNull()
    return notes.select(
        F.col("id").alias("note_id"), "project_id", "visibility",
        F.when(gone, F.coalesce("deleted_at", "updated_at")).alias("note_deleted_at"), gone.alias("note_gone"),
    )


def media_sources(media: DataFrame, notes: DataFrame, default_dataset: DataFrame) -> DataFrame:
    """Registry rows of media; visibility and deletion come from the note."""
    return media.join(_parent(notes), "note_id").join(default_dataset, "project_id", "left").select(
        "project_id", "dataset_id", F.lit("note_media").alias("source_type"), F.col("id").alias("source_id"),
        F.lit(1).cast("bigint").alias("source_version"), "visibility",
        hash_parts("media_type", "url", "caption", "ocr_text", "position").alias("content_hash"),
        F.when(F.col("note_gone"), "deleted").otherwise("pending").alias("index_status"),
        F.col("note_deleted_at").alias("deleted_at"),
        canonical_note("caption", "ocr_text").alias("canonical_text"), "note_id",
        F.col("position").cast("int").alias("media_position"),
        F.to_json(F.struct("caption", "media_type", "note_id", "ocr_text", "position", "url")).alias("source_payload"),
    )


def comment_sources(comments: DataFrame, notes: DataFrame, default_dataset: DataFrame) -> DataFrame:
    """Registry rows of comments; dead when the comment or its note is."""
    alive = ~F.col("note_gone") & (F.col("comment_status") == 1) & F.col("comment_deleted_at").isNull()
    renamed = comments.select(
        F.col("id").alias("source_id"), "note_id", F.col("status").alias("comment_status"),
        F.col("deleted_at").alias("comment_deleted_at"), F.col("updated_at").alias("comment_updated_at"),
        "content", "parent_id", "intent", "sentiment", "topic_id",
    )
    return renamed.join(_parent(notes), "note_id").join(default_dataset, "project_id", "left").select(
        "project_id", "dataset_id", F.lit("note_comment").alias("source_type"), "source_id",
        F.lit(1).cast("bigint").alias("source_version"), "visibility",
        hash_parts("content", "comment_status", "parent_id").alias("content_hash"),
        F.when(alive, "pending").otherwise("deleted").alias("index_status"),
        F.when(~alive, F.coalesce("comment_deleted_at", "note_deleted_at", "comment_updated_at")).alias("deleted_at"),
        F.col("content").alias("canonical_text"), "note_id", F.lit(None).cast("int").alias("media_position"),
        F.to_json(F.struct("content", "intent", "note_id", "parent_id", "sentiment", "topic_id")).alias("source_payload"),
    )


def source_registry(notes: DataFrame, media: DataFrame, comments: DataFrame, default_dataset: DataFrame) -> DataFrame:
    return (
        note_sources(notes, default_dataset)
        .unionByName(media_sources(media, notes, default_dataset))
        .unionByName(comment_sources(comments, notes, default_dataset))
    )


def close_older_versions(sources: DataFrame) -> DataFrame:
    """Every version below the newest one of its key is marked deleted (SCD-2 closing)."""
    newest = sources.groupBy(*SOURCE_KEY).agg(
        F.max("source_version").alias("_newest"), F.max_by("updated_at", "source_version").alias("_closed_at")
    )
    older = F.col("source_version") < F.col("_newest")
    return (
        sources.join(newest, SOURCE_KEY)
        .withColumn("deleted_at", F.when(older, F.coalesce("deleted_at", "_closed_at")).otherwise(F.col("deleted_at")))
        .withColumn("index_status", F.when(older, "deleted").otherwise(F.col("index_status")))
        .drop("_newest", "_closed_at")
    )


def capture_payloads(sources: DataFrame) -> DataFrame:
    """Canonical text, payload and payload hash of every registry row."""
    return sources.select(
        *SOURCE_KEY, "source_version", "canonical_text", "source_payload",
        F.sha2("source_payload", 256).alias("payload_hash"),
    )


def live_sources(sources: DataFrame) -> DataFrame:
    return sources.where("deleted_at IS NULL AND index_status <> 'deleted'")


def latest_version(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of highest version per key, without ordering whole groups."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), version).alias("_row"))
    return picked.select(*keys, "_row.*")


def has_newer(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Flag rows for which a higher version of the same key exists."""
    newest = rows.groupBy(*keys).agg(F.max(version).alias("_newest"))
    return rows.join(newest, keys).withColumn("has_newer", F.col("_newest") > F.col(version)).drop("_newest")


def corpus_members(scenarios: DataFrame, sources: DataFrame) -> DataFrame:
    """Live sources that belong to the notes of a content run, by own id or payload note id."""
    parent = F.when(F.col("source_type") == "note", F.col("source_id")).otherwise(
        F.get_json_object("source_payload", "$.note_id").cast("bigint")
    )
    return live_sources(sources).withColumn("member_note_id", parent).join(
        scenarios.select(F.col("note_id").alias("member_note_id")).distinct(), "member_note_id", "left_semi"
    )


def freeze(sources: DataFrame, project_id: int, dataset_id: int, latest: DataFrame) -> DataFrame:
    """Manifest row of a snapshot: checksum, and the version it gets or reuses.

    ``latest`` holds earlier manifests ``(dataset_id, version, manifest_checksum)``.
    """
    members = live_sources(sources).where(F.col("project_id") == project_id)
    parts = ["project_id", "source_type", "source_id", "source_version", "content_hash", "visibility"]
    checksum = manifest_checksum(members, parts, [SNAPSHOT_SCHEME, str(dataset_id), str(project_id)])
    known = latest.where(F.col("dataset_id") == dataset_id).agg(
        F.max("version").alias("_last"), F.max_by("manifest_checksum", "version").alias("_last_checksum")
    )
    joined = with_row(checksum, known)
    reused = F.coalesce(F.col("checksum") == F.col("_last_checksum"), F.lit(False))
    return joined.select(
        F.lit(dataset_id).cast("bigint").alias("dataset_id"),
        F.when(reused, F.col("_last")).otherwise(F.coalesce("_last", F.lit(0)) + 1).cast("bigint").alias("version"),
        F.col("row_count").alias("source_count"), F.col("checksum").alias("manifest_checksum"), reused.alias("reused"),
    )


def write_snapshot(sources: DataFrame, manifest: DataFrame, path: str) -> None:
    """Publish a new version as an immutable directory; a reused version writes nothing."""
    head = manifest.first()
    if head["reused"]:
        return
    target = f"{path}/dataset={head['dataset_id']}/version={head['version']}"
    live_sources(sources).write.mode("errorifexists").parquet(f"{target}/members")
    manifest.write.mode("errorifexists").parquet(f"{target}/manifest")


def capture_fact_versions(previous: DataFrame, facts: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """New payload versions: version 1 for new keys, one more where a measure changed."""
    latest = latest_version(previous.select(*keys, "source_version", *measures), keys, "source_version")
    before = latest.select(*keys, "source_version", F.struct(*measures).alias("_before"))
    joined = facts.withColumn("_after", F.struct(*measures)).join(before, keys, "left")
    return joined.where(~F.col("_after").eqNullSafe(F.col("_before"))).select(
        *keys, *measures, (F.coalesce("source_version", F.lit(0)) + 1).cast("bigint").alias("source_version"),
    )


def run_fact_inputs(note_facts: DataFrame, user_facts: DataFrame, member_notes: DataFrame) -> DataFrame:
    """Latest payload per fact key: notes of the snapshot, and every user."""
    keys = ["project_id", "subject_id", "fact_date"]
    notes = latest_version(note_facts, keys, "source_version").join(
        member_notes.select(F.col("note_id").alias("subject_id")).distinct(), "subject_id", "left_semi"
    )
    users = latest_version(user_facts, keys, "source_version")
    return notes.withColumn("fact_type", F.lit("note_daily_fact")).unionByName(
        users.withColumn("fact_type", F.lit("user_daily_fact"))
    )


def run_sources(members: DataFrame, payloads: DataFrame) -> DataFrame:
    """Snapshot members with their payloads."""
    return members.join(payloads, [*SOURCE_KEY, "source_version"])


def missing_payloads(members: DataFrame, payloads: DataFrame) -> DataFrame:
    """Frozen references without a payload; must be empty."""
    return members.join(payloads, [*SOURCE_KEY, "source_version"], "left_anti")


def repoint_to_canonical(sources: DataFrame, datasets: DataFrame) -> DataFrame:
    """Sources moved to the active community dataset of their project."""
    canonical = datasets.where("slug = 'community' AND status = 'active'").groupBy("project_id").agg(
        F.min("id").alias("_canonical")
    )
    moved = ~F.col("dataset_id").eqNullSafe(F.col("_canonical")) & F.col("_canonical").isNotNull()
    return sources.join(canonical, "project_id", "left").withColumn("repointed", moved).withColumn(
        "dataset_id", F.coalesce("_canonical", "dataset_id")
    ).drop("_canonical")


def drop_obsolete_memberships(memberships: DataFrame, datasets: DataFrame) -> DataFrame:
    """Memberships whose dataset is not the canonical one of its project are removed."""
    canonical = datasets.where("slug = 'community' AND status = 'active'").groupBy("project_id").agg(
        F.min("id").alias("_canonical")
    )
    obsolete = datasets.join(canonical, "project_id").where("id <> _canonical").select(F.col("id").alias("dataset_id"))
    return memberships.join(obsolete, "dataset_id", "left_anti")


def default_memberships(notes: DataFrame, default_dataset: DataFrame, stored: DataFrame) -> DataFrame:
    """Membership rows of the default dataset; stored rows of equal key get the current version."""
    current = notes.join(default_dataset.where("dataset_id IS NOT NULL"), "project_id").select(
        "dataset_id", F.col("id").alias("note_id"), F.col("content_version").cast("bigint").alias("note_version")
    )
    return replace_by_key(stored, current, ["dataset_id", "note_id"])
