"""Documents, chunks and citations built from sources, with reuse, lifecycle and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions.chunks import chunk_points, chunk_ranges
from quillspark.functions.contract import (
    CHUNKER_VERSION, COMMENT_CLUSTER_SIZE, COMMENT_VALUE_BONUS, NOTE_FACT_TEXT, PARSER_VERSION,
    USER_FACT_TEXT,
)
from quillspark.functions.text import byte_slice, hash_parts, normalize_newlines, tokenize
from quillspark.operators.manifest import manifest_checksum, union_manifest
from quillspark.operators.ordering import running

DOCUMENT_COLUMNS = [
    "project_id", "document_type", "source_type", "source_id", "source_key", "source_version",
    "source_content_hash", "visibility", "canonical_text", "note_id", "media_position",
]
SEGMENT_COLUMNS = [
    "source_type", "source_id", "source_version", "content_hash", "source_order", "start_byte", "end_byte", "fact_date",
]


def _segment(start: Column, end: Column, order: Column | None = None, fact_date: Column | None = None) -> Column:
    """What a stretch of a document cites: a source version, or a version of a fact by kind, key and date."""
    return F.struct(
        F.col("source_type").alias("source_type"),
        F.col("source_id").alias("source_id"),
        F.col("source_version").alias("source_version"),
        F.col("content_hash").alias("content_hash"),
        (order if order is not None else F.lit(0)).cast("int").alias("source_order"),
        start.cast("int").alias("start_byte"),
        end.cast("int").alias("end_byte"),
        (fact_date if fact_date is not None else F.lit(None)).cast("date").alias("fact_date"),
    )


def _finish(documents: DataFrame, dataset_version_id: int) -> DataFrame:
    """Content hash and content-addressed key."""
    content_hash = hash_parts(F.lit(PARSER_VERSION), "canonical_text")
    return documents.withColumn("content_hash", content_hash).withColumn(
        "document_key",
        hash_parts(
            F.lit(dataset_version_id), "document_type", "source_key", "source_version",
            "source_content_hash", F.lit(PARSER_VERSION), "content_hash",
        ),
    )


def direct_documents(sources: DataFrame, dataset_version_id: int) -> DataFrame:
    """One document per note or media source with text."""
    text = normalize_newlines("canonical_text")
    rows = sources.where(F.col("source_type").isin("note", "note_media")).withColumn("canonical_text", text)
    return _finish(
        rows.where("canonical_text <> ''").select(
            "project_id", F.col("source_type").alias("document_type"), "source_type", "source_id",
            F.concat_ws(":", "source_type", F.col("source_id").cast("string")).alias("source_key"),
            "source_version", F.col("content_hash").alias("source_content_hash"), "visibility",
            "canonical_text", "note_id", "media_position",
            F.array(_segment(F.lit(0), F.octet_length("canonical_text"))).alias("segments"),
        ),
        dataset_version_id,
    )


def comment_value(text: Column, intent: Column, sentiment: Column, topic_id: Column) -> Column:
    """Length plus bonuses for labelled comments."""
    return (
        F.char_length(text)
        + F.when(F.coalesce(intent, F.lit("")) != "", COMMENT_VALUE_BONUS["intent"]).otherwise(0)
        + F.when(F.coalesce(sentiment, F.lit("")) != "", COMMENT_VALUE_BONUS["sentiment"]).otherwise(0)
        + F.when(F.coalesce(topic_id, F.lit(0)) > 0, COMMENT_VALUE_BONUS["topic"]).otherwise(0)
    )


def comment_clusters(comments: DataFrame, dataset_version: int, dataset_version_id: int) -> DataFrame:
    """Comments of a note, best first, joined in groups of twelve into one document each.

    Ranks come from the skew-safe ``running``; after that a group is at most twelve rows.
    Empty comments keep their place in the ranking but add no text.
    """
    value = comment_value(F.col("canonical_text"), F.col("intent"), F.col("sentiment"), F.col("topic_id"))
    ranked = running(
        comments.withColumn("value", value), ["project_id", "note_id"], [F.desc("value"), F.asc("source_id")]
    )
    texts = ranked.select(
        "*",
        F.floor((F.col("rn") - 1) / COMMENT_CLUSTER_SIZE).cast("int").alias("cluster_index"),
        normalize_newlines("canonical_text").alias("text"),
    ).where("text <> ''")
    in_cluster = Window.partitionBy("project_id", "note_id", "cluster_index").orderBy("rn")
    header = F.concat(F.lit("[comment "), F.col("source_id").cast("string"), F.lit("]\n"))
    gap = F.when(F.row_number().over(in_cluster) > 1, F.lit("\n\n")).otherwise(F.lit(""))
    members = (
        texts.withColumn("source_order", (F.row_number().over(in_cluster) - 1).cast("int"))
        .withColumn("lead_in", F.concat(gap, header))
        .withColumn("piece", F.concat("lead_in", "text"))
        .withColumn(
            "piece_end",
            F.sum(F.octet_length("piece")).over(in_cluster.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .withColumn("seg_start", F.col("piece_end") - F.octet_length("text"))
    )
    grouped = members.groupBy("project_id", "note_id", "cluster_index").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "source_order", "piece", _segment(F.col("seg_start"), F.col("piece_end"), F.col("source_order")).alias("segment"),
                    F.concat_ws("\x1f", F.col("source_id").cast("string"), F.col("source_version").cast("string"), "content_hash").alias("identity"),
                )
            )
        ).alias("m"),
        F.bool_or(F.col("visibility") == "project").alias("restricted"),
    )
    return _finish(
        grouped.select(
            "project_id", F.lit("note_comment_cluster").alias("document_type"),
            F.lit("note_comment_cluster").alias("source_type"), F.col("note_id").alias("source_id"),
            F.format_string("note:%d:comment-cluster:%04d", "note_id", "cluster_index").alias("source_key"),
            F.lit(dataset_version).cast("bigint").alias("source_version"),
            F.sha2(F.array_join("m.identity", "\x1f"), 256).alias("source_content_hash"),
            F.when(F.col("restricted"), "project").otherwise("public").alias("visibility"),
            F.array_join("m.piece", "").alias("canonical_text"), "note_id",
            F.lit(None).cast("int").alias("media_position"), F.col("m.segment").alias("segments"),
        ),
        dataset_version_id,
    )


def fact_text(fact_type: str) -> Column:
    date = F.date_format("fact_date", "yyyy-MM-dd")
    if fact_type == "note_daily_fact":
        names = ["note_id", "view_count", "like_count", "collect_count", "comment_count", "share_count", "unique_user_count", "event_count"]
        return F.format_string(NOTE_FACT_TEXT, date, *names)
    if fact_type == "user_daily_fact":
        names = ["user_id", "view_count", "interaction_count", "content_count", "comment_count", "active_note_count", "event_count"]
        return F.format_string(USER_FACT_TEXT, date, *names)
    raise ValueError(f"unsupported daily fact type {fact_type!r}")


def fact_documents(facts: DataFrame, fact_type: str, dataset_version_id: int) -> DataFrame:
    """One document per daily fact version (``content_hash`` and ``source_version`` from the capture)."""
    subject = F.col("note_id" if fact_type == "note_daily_fact" else "user_id")
    rows = facts.select(
        "project_id", F.lit(fact_type).alias("document_type"), F.lit(fact_type).alias("source_type"),
        subject.alias("source_id"),
        F.concat_ws(":", F.lit(fact_type), subject.cast("string"), F.date_format("fact_date", "yyyy-MM-dd")).alias("source_key"),
        "source_version", "content_hash", F.lit("project").alias("visibility"),
        fact_text(fact_type).alias("canonical_text"),
        (subject if fact_type == "note_daily_fact" else F.lit(None).cast("bigint")).alias("note_id"),
        F.lit(None).cast("int").alias("media_position"), "fact_date",
    )
    segment = _segment(F.lit(0), F.octet_length("canonical_text"), fact_date=F.col("fact_date"))
    with_segment = rows.withColumn("segments", F.array(segment)).drop("fact_date")
    return _finish(
        with_segment.withColumnRenamed("content_hash", "source_content_hash"), dataset_version_id
    )


def cited_versions(documents: DataFrame) -> DataFrame:
    """``document_key, project_id, source_type, source_id, source_version, fact_date`` of what documents cite."""
    return documents.select("document_key", "project_id", F.explode("segments").alias("s")).select(
        "document_key", "project_id", "s.source_type", "s.source_id", "s.source_version", "s.fact_date")


def chunks(documents: DataFrame) -> DataFrame:
    """One row per chunk with exact byte and character ranges, hashes and tokens."""
    passthrough = [c for c in documents.columns if c not in ("content_hash",)]
    pointed = documents.select(*passthrough, chunk_points("canonical_text").alias("_points"))
    cut = pointed.select(*passthrough, F.explode(chunk_ranges(F.col("_points"))).alias("r"))
    ranged = cut.select(*passthrough, "r.*").withColumn(
        "content", byte_slice("canonical_text", F.col("start_byte"), F.col("end_byte"))
    ).drop("canonical_text")
    return (
        ranged.withColumn("content_hash", hash_parts("content"))
        .withColumn(
            "chunk_key",
            hash_parts("document_key", "chunk_index", "start_byte", "end_byte", "content_hash", F.lit(CHUNKER_VERSION)),
        )
        .withColumn("lexemes", tokenize("content"))
    )


def in_parts(documents: DataFrame, parts: int) -> list[DataFrame]:
    """Disjoint parts of documents by their source; a part is known before any text is looked at."""
    return [documents.where(F.pmod(F.xxhash64("source_id"), F.lit(parts)) == i) for i in range(parts)]


def citations(chunk_rows: DataFrame) -> DataFrame:
    """Overlap of every chunk with the source segments of its document.

    Segments travel with the chunk as an array (one for direct documents, at most twelve
    for clusters), so the overlap needs no join.
    """
    seg = F.col("s")
    start = F.greatest(F.col("start_byte"), seg["start_byte"])
    end = F.least(F.col("end_byte"), seg["end_byte"])
    overlapping = (
        chunk_rows.select("document_key", "chunk_key", "start_byte", "end_byte", "content", F.explode("segments").alias("s"))
        .select(
            "document_key", "chunk_key", "start_byte", "content",
            seg["source_type"].alias("source_type"), seg["source_id"].alias("source_id"),
            seg["source_version"].alias("source_version"), seg["content_hash"].alias("source_content_hash"), seg["fact_date"].alias("fact_date"),
            start.alias("document_start_byte"), end.alias("document_end_byte"),
            (start - seg["start_byte"]).alias("source_start_byte"), (end - seg["start_byte"]).alias("source_end_byte"),
        )
        .where("document_start_byte < document_end_byte")
    )
    quoted = overlapping.withColumn(
        "quote",
        byte_slice("content", F.col("document_start_byte") - F.col("start_byte"), F.col("document_end_byte") - F.col("start_byte")),
    ).drop("content", "start_byte")
    return quoted.withColumn("quote_hash", hash_parts("quote")).withColumn(
        "citation_key",
        hash_parts(
            "chunk_key", "source_type", "source_id", "source_version", "document_start_byte",
            "document_end_byte", "source_start_byte", "source_end_byte", "quote_hash",
        ),
    )


def link_reusable(built: DataFrame, stored: DataFrame) -> DataFrame:
    """Built documents with their disposition: reused when key, hash and chunk count agree."""
    known = stored.select("document_key", "content_hash", "chunk_count").withColumn("_known", F.lit(True))
    return built.join(known, ["document_key", "content_hash", "chunk_count"], "left").select(
        *built.columns, F.when(F.col("_known"), "reused").otherwise("created").alias("disposition")
    )


def supersede(documents: DataFrame) -> DataFrame:
    """Only the last ingested ready document of a (project, type, key) stays ready."""
    keys = ["project_id", "source_type", "source_key"]
    last = documents.where("lifecycle_status = 'ready'").groupBy(*keys).agg(F.max("ingest_order").alias("_last"))
    return documents.join(last, keys, "left").withColumn(
        "lifecycle_status",
        F.when((F.col("lifecycle_status") == "ready") & (F.col("ingest_order") < F.col("_last")), "superseded")
        .otherwise(F.col("lifecycle_status")),
    ).drop("_last")


def latest_live_version(sources: DataFrame) -> DataFrame:
    """Highest version of every source that is neither deleted nor marked deleted."""
    return (
        sources.where("deleted_at IS NULL AND index_status <> 'deleted'")
        .groupBy("project_id", "source_type", "source_id").agg(F.max("source_version").alias("live_version"))
    )


def source_flags(document_sources: DataFrame, sources: DataFrame, facts: DataFrame) -> DataFrame:
    """Per document: does it cite a deleted source, one with a newer live version, a replaced fact."""
    key = ["project_id", "source_type", "source_id"]
    captured = sources.select(
        *key, "source_version",
        (F.col("deleted_at").isNotNull() | (F.col("index_status") == "deleted")).alias("gone"),
    ).join(latest_live_version(sources), key, "left")
    newest_fact = facts.groupBy("project_id", "source_type", "source_id", "fact_date").agg(F.max("source_version").alias("newest_fact"))
    versions = document_sources.join(captured, [*key, "source_version"], "left").join(
        newest_fact, [*key, "fact_date"], "left"
    )
    return versions.groupBy("document_key").agg(
        F.coalesce(F.bool_or("gone"), F.lit(False)).alias("source_gone"),
        F.coalesce(F.bool_or(F.col("gone") & (F.col("live_version") > F.col("source_version"))), F.lit(False)).alias("newer_live"),
        F.coalesce(F.bool_or(F.col("newest_fact") > F.col("source_version")), F.lit(False)).alias("fact_replaced"),
    )


def reconcile_lifecycle(documents: DataFrame, flags: DataFrame) -> DataFrame:
    """New lifecycle state of every document; the first rule that applies wins."""
    kind = F.col("document_type")
    direct = kind.isin("note", "note_media")
    state = (
        F.when(F.col("lifecycle_status") != "ready", F.col("lifecycle_status"))
        .when((kind == "note_comment_cluster") & F.col("source_gone"), "stale")
        .when(direct & F.col("newer_live"), "superseded")
        .when(direct & F.col("source_gone"), "deleted")
        .when(kind.isin("note_daily_fact", "user_daily_fact") & F.col("fact_replaced"), "superseded")
        .otherwise(F.col("lifecycle_status"))
    )
    return documents.join(flags, "document_key", "left").withColumn("new_status", state).drop(
        "source_gone", "newer_live", "fact_replaced"
    )


def run_totals(run_documents: DataFrame, chunk_rows: DataFrame, citation_rows: DataFrame) -> DataFrame:
    """Documents, chunks, citations and reused documents of one run."""
    per_chunk = citation_rows.groupBy("document_key").agg(F.count("*").alias("citations"))
    per_doc = chunk_rows.groupBy("document_key").agg(F.count("*").alias("chunks"))
    return (
        run_documents.join(per_doc, "document_key", "left").join(per_chunk, "document_key", "left")
        .agg(
            F.count("*").alias("document_count"),
            F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunk_count"),
            F.coalesce(F.sum("citations"), F.lit(0)).alias("citation_count"),
            F.count_if(F.col("disposition") == "reused").alias("reused_document_count"),
        )
    )


def mark_indexed(sources: DataFrame, citation_rows: DataFrame) -> DataFrame:
    """Live sources cited by the run become indexed."""
    key = ["source_type", "source_id", "source_version"]
    cited = citation_rows.select(*key).distinct().withColumn("_cited", F.lit(True))
    live = F.col("deleted_at").isNull() & (F.col("index_status") != "deleted")
    return sources.join(cited, key, "left").withColumn(
        "index_status", F.when(F.col("_cited") & live, "indexed").otherwise(F.col("index_status"))
    ).drop("_cited")


def audit(
    documents: DataFrame, chunk_rows: DataFrame, citation_rows: DataFrame, flags: DataFrame,
    project_id: Column | None = None, stored: DataFrame | None = None,
) -> DataFrame:
    """Violation counts per check; a run is healthy when every count is zero.

    ``stored`` is the output checksum the run recorded (``item_type, checksum``); it is compared
    with ``output_checksum`` of what is there now, kind by kind. Chunks and citations are counted per document and per chunk first, then joined once;
    a document's text meets its chunks in one join, and only the verdict goes on from there.
    """
    per_doc = chunk_rows.groupBy("document_key").agg(F.count("*").alias("_chunks"))
    texts = documents.select("document_key", F.col("canonical_text").alias("_text"))
    doc_checks = (
        documents.join(per_doc, "document_key", "left").join(flags, "document_key", "left")
        .agg(
            F.count_if(F.col("lifecycle_status").isin("building", "failed")).alias("incomplete_documents"),
            F.count_if(F.coalesce("_chunks", F.lit(0)) != F.col("chunk_count")).alias("chunk_count_mismatch"),
            F.count_if((F.col("lifecycle_status") == "ready") & F.coalesce("source_gone", F.lit(False))).alias("active_deleted_source"),
            F.count_if(F.col("project_id") != project_id if project_id is not None else F.lit(False)).alias("scope_mismatch"),
        )
    )
    sliced = chunk_rows.select("document_key", "chunk_key", "start_byte", "end_byte", "content", "content_hash").join(texts, "document_key").select("chunk_key", (
        (F.col("start_byte") < 0) | (F.col("end_byte") > F.octet_length("_text"))
        | (byte_slice("_text", F.col("start_byte"), F.col("end_byte")) != F.col("content"))
        | (hash_parts("content") != F.col("content_hash"))
    ).alias("_invalid"))
    cited = citation_rows.groupBy("chunk_key").agg(F.count("*").alias("_citations"))
    chunk_checks = sliced.join(cited, "chunk_key", "left").agg(
        F.count_if("_invalid").alias("invalid_chunk_slice"),
        F.count_if(F.col("_citations").isNull()).alias("chunks_without_citation"),
    )
    ranges = chunk_rows.select("chunk_key", "start_byte", "end_byte")
    citation_checks = citation_rows.join(ranges, "chunk_key").join(texts, "document_key").agg(
        F.count_if(
            (F.col("document_start_byte") < F.col("start_byte")) | (F.col("document_end_byte") > F.col("end_byte"))
            | (hash_parts(byte_slice("_text", F.col("document_start_byte"), F.col("document_end_byte"))) != F.col("quote_hash"))
        ).alias("invalid_citation_slice")
    )

    def long_form(row: DataFrame) -> DataFrame:
        pairs = ", ".join(f"'{c}', {c}" for c in row.columns)
        return row.selectExpr(f"stack({len(row.columns)}, {pairs}) AS (check_name, violations)")

    result = long_form(doc_checks).unionByName(long_form(chunk_checks)).unionByName(long_form(citation_checks))
    if stored is None:
        return result
    actual = output_checksum(documents, chunk_rows, citation_rows)
    agreed = stored.select("item_type", F.col("checksum").alias("_stored")).join(actual, "item_type", "full_outer")
    return result.unionByName(long_form(agreed.agg(F.count_if(~F.col("_stored").eqNullSafe(F.col("checksum"))).alias("output_checksum_mismatch"))))


def output_checksum(documents: DataFrame, chunk_rows: DataFrame, citation_rows: DataFrame) -> DataFrame:
    """``item_type, row_count, checksum`` over the keys and contents of documents, chunks and citations."""
    parts = {
        "document": documents.select(F.concat_ws("\x1f", "document_key", hash_parts("canonical_text"))),
        "chunk": chunk_rows.select(F.concat_ws("\x1f", "chunk_key", hash_parts("content"))),
        "citation": citation_rows.select(F.concat_ws("\x1f", "citation_key", hash_parts("quote"))),
    }
    return manifest_checksum(union_manifest(parts), ["item_key"], ["output_v1"], ["item_type"])
