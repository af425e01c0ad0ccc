"""Source registry, snapshots, documents, chunks and citations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.contract import SNAPSHOT_SCHEME
from quillspark.functions.text import hash_parts
from quillspark.operators import evidence, facts, manifest, merge, ordering, versions
from quillspark.plans.community import END, START
from quillspark.plans.registry import REGISTRY
from quillspark.sources import model

query, define = REGISTRY.query, REGISTRY.define
DATASET_VERSION, DATASET_VERSION_ID = 3, 11

# Spark side --------------------------------------------------------------------------


def note_rows(spark, sf):
    docs = model.spread(model.documents(spark, sf))
    return docs.select(
        "id", "project_id", F.lit("").alias("title"), "body", "category", "visibility", "status",
        F.when(F.col("status") == "deleted", F.col("created_at")).alias("deleted_at"),
        F.col("created_at").alias("updated_at"), F.lit(1).cast("bigint").alias("content_version"),
    )


def comment_rows(spark, sf):
    c = model.comments(spark, sf)
    return c.withColumn("deleted_at", F.when(F.col("status") == 0, F.col("created_at"))).withColumnRenamed(
        "created_at", "updated_at"
    )


def default_dataset(spark, sf):
    return versions.first_active_dataset(model.projects(spark, sf), model.datasets(spark, sf))


def registry(spark, sf):
    return versions.source_registry(
        note_rows(spark, sf), model.media(spark, sf), comment_rows(spark, sf), default_dataset(spark, sf)
    )


def versioned(spark, sf):
    """Note sources plus an edited second version of every labelled document."""
    first = versions.note_sources(note_rows(spark, sf), default_dataset(spark, sf)).select(
        *versions.SOURCE_KEY, "source_version", "visibility", "content_hash", "index_status", "deleted_at",
        F.timestamp_seconds(F.lit(model.EPOCH) + F.col("source_id") - 1).alias("updated_at"),
    )
    labels = model.table(spark, sf, "labels").select((F.col("doc_id") + 1).alias("source_id"), "toxic")
    second = first.join(labels, "source_id").select(
        *versions.SOURCE_KEY, F.lit(2).cast("bigint").alias("source_version"), "visibility",
        hash_parts("content_hash", F.lit("edited")).alias("content_hash"),
        F.when(F.col("toxic") == 1, "deleted").otherwise("pending").alias("index_status"),
        F.when(F.col("toxic") == 1, F.expr("updated_at + INTERVAL 1 HOUR")).alias("deleted_at"),
        F.expr("updated_at + INTERVAL 1 HOUR").alias("updated_at"),
    )
    return first.unionByName(second)


def live_comment_sources(spark, sf):
    live = versions.live_sources(registry(spark, sf)).where("source_type = 'note_comment'")
    labels = model.comments(spark, sf).select(F.col("id").alias("source_id"), "intent", "sentiment", "topic_id")
    return live.join(labels, "source_id")


def direct_docs(spark, sf):
    return evidence.direct_documents(versions.live_sources(registry(spark, sf)), DATASET_VERSION_ID)


def cluster_docs(spark, sf):
    return evidence.comment_clusters(live_comment_sources(spark, sf), DATASET_VERSION, DATASET_VERSION_ID)


def built_documents(spark, sf):
    return direct_docs(spark, sf).unionByName(cluster_docs(spark, sf))


def all_chunks(spark, sf):
    return evidence.chunks(built_documents(spark, sf))


#: Parts in which the chunks of notes and media are handed to an index; comments are another.
DIRECT_PARTS = 4


def chunk_parts(direct, clusters):
    """The chunks of a run in disjoint parts, to be stored one after the other."""
    return [evidence.chunks(part) for part in (clusters, *evidence.in_parts(direct, DIRECT_PARTS))]


# SQL side ----------------------------------------------------------------------------

define("default_dataset", """
    SELECT p.id AS project_id, (SELECT min(d.id) FROM datasets d WHERE d.project_id = p.id
           AND d.status = 'active' AND d.slug = 'community') AS dataset_id FROM projects p""")
define("sources", """
    SELECT d.project_id, g.dataset_id, 'note' AS source_type, d.id AS source_id, CAST(1 AS BIGINT) AS source_version,
           d.visibility, sha256(concat_ws(chr(31), '', d.body, d.status, d.visibility)) AS content_hash,
           CASE WHEN d.status = 'deleted' THEN 'deleted' ELSE 'pending' END AS index_status,
           CASE WHEN d.status = 'deleted' THEN d.created_at END AS deleted_at, nullif(d.body, '') AS canonical_text,
           d.id AS note_id, CAST(NULL AS INTEGER) AS media_position
    FROM docs d LEFT JOIN default_dataset g USING (project_id)
    UNION ALL
    SELECT d.project_id, g.dataset_id, 'note_media', m.id, 1, d.visibility,
           sha256(concat_ws(chr(31), m.media_type, m.url, m.caption, m.ocr_text, m.position)),
           CASE WHEN d.status = 'deleted' THEN 'deleted' ELSE 'pending' END,
           CASE WHEN d.status = 'deleted' THEN d.created_at END,
           concat_ws(chr(10) || chr(10), nullif(m.caption, ''), nullif(m.ocr_text, '')), m.note_id, m.position
    FROM media m JOIN docs d ON d.id = m.note_id LEFT JOIN default_dataset g USING (project_id)
    UNION ALL
    SELECT d.project_id, g.dataset_id, 'note_comment', c.id, 1, d.visibility,
           sha256(concat_ws(chr(31), c.content, c.status, c.parent_id)),
           CASE WHEN d.status = 'deleted' OR c.status = 0 THEN 'deleted' ELSE 'pending' END,
           CASE WHEN c.status = 0 THEN c.created_at WHEN d.status = 'deleted' THEN d.created_at END,
           c.content, c.note_id, NULL
    FROM comments c JOIN docs d ON d.id = c.note_id LEFT JOIN default_dataset g USING (project_id)""")
define("versioned", """
    SELECT s.project_id, s.source_type, s.source_id, s.source_version, s.visibility, s.content_hash,
           s.index_status, s.deleted_at, d.created_at AS updated_at
    FROM sources s JOIN docs d ON d.id = s.source_id WHERE s.source_type = 'note'
    UNION ALL
    SELECT s.project_id, s.source_type, s.source_id, 2, s.visibility, sha256(s.content_hash || chr(31) || 'edited'),
           CASE WHEN l.toxic = 1 THEN 'deleted' ELSE 'pending' END,
           CASE WHEN l.toxic = 1 THEN d.created_at + INTERVAL 1 HOUR END, d.created_at + INTERVAL 1 HOUR
    FROM sources s JOIN docs d ON d.id = s.source_id JOIN labels l ON l.doc_id + 1 = s.source_id
    WHERE s.source_type = 'note'""")
define("comment_ranks", """
    SELECT s.*, CAST(floor((row_number() OVER (PARTITION BY s.project_id, s.note_id ORDER BY
             length(s.canonical_text) + CASE WHEN c.intent <> '' THEN 80 ELSE 0 END
             + CASE WHEN c.sentiment <> '' THEN 40 ELSE 0 END + CASE WHEN c.topic_id > 0 THEN 20 ELSE 0 END DESC,
             s.source_id) - 1) / 12) AS INTEGER) AS cluster_index,
           row_number() OVER (PARTITION BY s.project_id, s.note_id ORDER BY
             length(s.canonical_text) + CASE WHEN c.intent <> '' THEN 80 ELSE 0 END
             + CASE WHEN c.sentiment <> '' THEN 40 ELSE 0 END + CASE WHEN c.topic_id > 0 THEN 20 ELSE 0 END DESC,
             s.source_id) AS rn
    FROM sources s JOIN comments c ON c.id = s.source_id
    WHERE s.source_type = 'note_comment' AND s.deleted_at IS NULL AND s.index_status <> 'deleted'""")
define("plain_docs", """
    SELECT project_id, source_type AS document_type, source_type, source_id,
           source_type || ':' || source_id AS source_key, source_version, content_hash AS source_content_hash,
           visibility, replace(replace(canonical_text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS canonical_text,
           note_id, media_position
    FROM sources WHERE source_type IN ('note', 'note_media') AND deleted_at IS NULL AND canonical_text <> ''
    UNION ALL
    SELECT project_id, 'note_comment_cluster', 'note_comment_cluster', note_id,
           'note:' || note_id || ':comment-cluster:' || lpad(CAST(cluster_index AS VARCHAR), 4, '0'), 3,
           sha256(string_agg(source_id || chr(31) || source_version || chr(31) || content_hash, chr(31) ORDER BY rn)),
           CASE WHEN bool_or(visibility = 'project') THEN 'project' ELSE 'public' END,
           string_agg('[comment ' || source_id || ']' || chr(10) || canonical_text, chr(10) || chr(10) ORDER BY rn),
           note_id, NULL
    FROM comment_ranks GROUP BY project_id, note_id, cluster_index""")
define("built_docs", """
    SELECT *, sha256(concat_ws(chr(31), '11', document_type, source_key, source_version, source_content_hash,
                               'evidence_parser_v1', content_hash)) AS document_key
    FROM (SELECT *, sha256('evidence_parser_v1' || chr(31) || canonical_text) AS content_hash FROM plain_docs)""")
define("cut", r"""
    SELECT document_key, canonical_text AS t, -1 AS chunk_index, 0 AS sb, 0 AS sc, 0 AS eb, 0 AS ec FROM built_docs
    UNION ALL
    SELECT document_key, t, chunk_index + 1, nsb, nsc, nsb + strlen(substr(t, nsc + 1, n)), nsc + n
    FROM (SELECT *, CASE WHEN strlen(t) - nsb <= 1200 THEN length(t) - nsc
                         WHEN pre <> '' AND strlen(pre) - strlen(right(pre, 1)) >= 720 THEN length(pre) ELSE lim END AS n
    FROM (SELECT *, regexp_extract(substr(win, 1, lim), '^(?s:.*)[\n.!?;:,。！？；：，]') AS pre
    FROM (SELECT *, CASE WHEN strlen(win) <= 1200 THEN length(win) ELSE
             list_max(list_filter(range(300, 1201), lambda i: strlen(substr(win, 1, i)) <= 1200)) END AS lim
    FROM (SELECT *, substr(t, nsc + 1, 1200) AS win
    FROM (SELECT document_key, t, chunk_index, CASE WHEN chunk_index < 0 THEN 0 ELSE ec - tail END AS nsc,
                 CASE WHEN chunk_index < 0 THEN 0 ELSE eb - strlen(substr(t, ec - tail + 1, tail)) END AS nsb
    FROM (SELECT *, CASE WHEN chunk_index < 0 THEN 0 WHEN strlen(substr(t, ec - 159, 160)) = 160 THEN 160 ELSE
             list_max(list_filter(range(0, 161), lambda i: strlen(substr(t, ec - i + 1, i)) <= 160)) END AS tail
          FROM cut WHERE eb < strlen(t)))))))""")
define("chunk_rows", """
    SELECT d.document_key, d.project_id, d.document_type, d.source_type, d.source_id, d.visibility, d.note_id,
           d.media_position, d.source_version, c.chunk_index, c.sb AS start_byte, c.eb AS end_byte, c.sc AS start_char,
           c.ec AS end_char, substr(c.t, c.sc + 1, c.ec - c.sc) AS content,
           sha256(substr(c.t, c.sc + 1, c.ec - c.sc)) AS content_hash,
           sha256(concat_ws(chr(31), d.document_key, c.chunk_index, c.sb, c.eb,
                  sha256(substr(c.t, c.sc + 1, c.ec - c.sc)), 'utf8_paragraph_1200_160_v1')) AS chunk_key
    FROM cut c JOIN built_docs d USING (document_key) WHERE c.chunk_index >= 0""")
define("segments", """
    SELECT document_key, source_type, source_id, source_version, source_content_hash AS content_hash,
           0 AS seg_start, strlen(canonical_text) AS seg_end
    FROM built_docs WHERE document_type <> 'note_comment_cluster'
    UNION ALL
    SELECT d.document_key, 'note_comment', r.source_id, r.source_version, r.content_hash,
           r.upto - strlen(r.canonical_text), r.upto
    FROM (SELECT *, sum(strlen('[comment ' || source_id || ']' || chr(10) || canonical_text)
                        + CASE WHEN (rn - 1) % 12 = 0 THEN 0 ELSE 2 END)
                 OVER (PARTITION BY project_id, note_id, cluster_index ORDER BY rn) AS upto FROM comment_ranks) r
    JOIN built_docs d ON d.document_type = 'note_comment_cluster' AND d.project_id = r.project_id
     AND d.source_key = 'note:' || r.note_id || ':comment-cluster:' || lpad(CAST(r.cluster_index AS VARCHAR), 4, '0')""")
define("citation_rows", """
    SELECT document_key, chunk_key, source_type, source_id, source_version, source_content_hash, document_start_byte,
           document_end_byte, source_start_byte, source_end_byte, quote, sha256(quote) AS quote_hash,
           sha256(concat_ws(chr(31), chunk_key, source_type, source_id, source_version, document_start_byte, document_end_byte,
                            source_start_byte, source_end_byte, sha256(quote))) AS citation_key
    FROM (SELECT c.document_key, c.chunk_key, s.source_type, s.source_id, s.source_version,
                 s.content_hash AS source_content_hash,
                 greatest(c.start_byte, s.seg_start) AS document_start_byte, least(c.end_byte, s.seg_end) AS document_end_byte,
                 greatest(c.start_byte, s.seg_start) - s.seg_start AS source_start_byte,
                 least(c.end_byte, s.seg_end) - s.seg_start AS source_end_byte,
                 decode(array_slice(encode(c.content), greatest(c.start_byte, s.seg_start) - c.start_byte + 1,
                                    least(c.end_byte, s.seg_end) - c.start_byte)) AS quote
          FROM chunk_rows c JOIN segments s USING (document_key)
          WHERE greatest(c.start_byte, s.seg_start) < least(c.end_byte, s.seg_end))""")

# Registry and versions ---------------------------------------------------------------


@query("source_registry", "V2 J3 J18 F2 F7", """
    SELECT project_id, dataset_id, source_type, source_id, source_version, visibility, content_hash, index_status,
           deleted_at, note_id, media_position FROM sources""")
def source_registry(spark, sf):
    return registry(spark, sf).drop("canonical_text", "source_payload")


@query("payload_capture", "V4 F7", """
    SELECT source_type, source_id, canonical_text, length(canonical_text) AS characters FROM sources""")
def payload_capture(spark, sf):
    captured = versions.capture_payloads(registry(spark, sf))
    return captured.select("source_type", "source_id", "canonical_text", F.char_length("canonical_text").cast("bigint").alias("characters"))


@query("closed_versions", "V3", """
    SELECT project_id, source_type, source_id, source_version,
           CASE WHEN source_version < newest THEN 'deleted' ELSE index_status END AS index_status,
           CASE WHEN source_version < newest THEN coalesce(deleted_at, closed_at) ELSE deleted_at END AS deleted_at
    FROM (SELECT *, max(source_version) OVER k AS newest,
                 last_value(updated_at) OVER (PARTITION BY project_id, source_type, source_id ORDER BY source_version
                   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS closed_at
          FROM versioned WINDOW k AS (PARTITION BY project_id, source_type, source_id))""")
def closed_versions(spark, sf):
    closed = versions.close_older_versions(versioned(spark, sf))
    return closed.select(*versions.SOURCE_KEY, "source_version", "index_status", "deleted_at")


@query("latest_versions", "W4", """
    SELECT project_id, source_type, source_id, source_version, content_hash, index_status FROM (
      SELECT *, row_number() OVER (PARTITION BY project_id, source_type, source_id ORDER BY source_version DESC) AS rn
      FROM versioned) WHERE rn = 1""")
def latest_versions(spark, sf):
    rows = versioned(spark, sf).select(*versions.SOURCE_KEY, "source_version", "content_hash", "index_status")
    return versions.latest_version(rows, versions.SOURCE_KEY, "source_version")


@query("newer_version_flag", "J6", """
    SELECT v.source_id, v.source_version, EXISTS (SELECT 1 FROM versioned n WHERE n.project_id = v.project_id
           AND n.source_type = v.source_type AND n.source_id = v.source_id AND n.source_version > v.source_version) AS has_newer
    FROM versioned v""")
def newer_version_flag(spark, sf):
    return versions.has_newer(versioned(spark, sf), versions.SOURCE_KEY, "source_version").select(
        "source_id", "source_version", "has_newer")


@query("content_versions", "W6", """
    SELECT o_custkey, o_orderkey, 1 + CAST(sum(bump) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS content_version
    FROM (SELECT *, CASE WHEN row_number() OVER w > 1 AND (o_orderstatus, o_orderpriority) IS DISTINCT FROM
                 (lag(o_orderstatus) OVER w, lag(o_orderpriority) OVER w) THEN 1 ELSE 0 END AS bump
          FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""")
def content_versions(spark, sf):
    history = model.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    found = versions.content_versions(history, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])
    return found.select("o_custkey", "o_orderkey", "content_version")


@query("default_memberships", "V5", """
    SELECT g.dataset_id, d.id AS note_id, CAST(1 AS BIGINT) AS note_version
    FROM docs d JOIN default_dataset g USING (project_id) WHERE g.dataset_id IS NOT NULL
    UNION ALL
    SELECT s.id + 1000, d.id, 9 FROM docs d JOIN datasets s ON s.project_id = d.project_id WHERE s.status = 'archived'""")
def default_memberships(spark, sf):
    stored = model.documents(spark, sf).join(
        model.datasets(spark, sf).where("status = 'archived'").select("project_id", (F.col("id") + 1000).alias("dataset_id")), "project_id"
    ).select("dataset_id", F.col("id").alias("note_id"), F.lit(9).cast("bigint").alias("note_version"))
    return versions.default_memberships(note_rows(spark, sf), default_dataset(spark, sf), stored)


@query("canonical_repoint", "J21", """
    SELECT s.source_type, s.source_id, coalesce(g.dataset_id, s.source_id % 25 + 1) AS dataset_id,
           g.dataset_id IS NOT NULL AND g.dataset_id IS DISTINCT FROM s.source_id % 25 + 1 AS repointed
    FROM sources s LEFT JOIN default_dataset g USING (project_id)""")
def canonical_repoint(spark, sf):
    stray = registry(spark, sf).withColumn("dataset_id", F.col("source_id") % 25 + 1)
    return versions.repoint_to_canonical(stray, model.datasets(spark, sf)).select("source_type", "source_id", "dataset_id", "repointed")


@query("obsolete_memberships", "J21", """
    SELECT m.dataset_id, count(*) AS kept FROM (SELECT id % 25 + 1 AS dataset_id FROM docs) m
    WHERE NOT EXISTS (SELECT 1 FROM datasets d JOIN default_dataset g USING (project_id)
                      WHERE d.id = m.dataset_id AND d.id <> g.dataset_id) GROUP BY 1""")
def obsolete_memberships(spark, sf):
    stored = model.documents(spark, sf).select((F.col("id") % 25 + 1).alias("dataset_id"))
    kept = versions.drop_obsolete_memberships(stored, model.datasets(spark, sf))
    return kept.groupBy("dataset_id").agg(F.count("*").alias("kept"))


@query("corpus_members", "V6 J18 P12", """
    SELECT s.source_type, s.source_id FROM sources s
    WHERE s.deleted_at IS NULL AND s.index_status <> 'deleted'
      AND s.note_id IN (SELECT doc_id + 1 FROM labels WHERE quality = 1)""")
def corpus_members(spark, sf):
    scenarios = model.table(spark, sf, "labels").where("quality = 1").select((F.col("doc_id") + 1).alias("note_id"))
    return versions.corpus_members(scenarios, registry(spark, sf)).select("source_type", "source_id")


def checksum_sql(rows: str, header: list[str], group: str | None = None) -> str:
    """SQL of the folded checksum over ``rows``, a query giving ``h`` (and the group column)."""
    g, by = (f"{group}, ", f"{group}, ") if group else ("", "")
    head = ", ".join(f"'{h}'" for h in header)
    return f"""
    SELECT {g}CAST(sum(n) AS BIGINT) AS row_count,
           sha256(concat_ws(chr(31), {head}, sha256(string_agg(d, chr(10) ORDER BY b)))) AS checksum
    FROM (SELECT {g}substr(b, 1, 3) AS b, sha256(string_agg(d, chr(10) ORDER BY b)) AS d, sum(n) AS n
          FROM (SELECT {g}substr(h, 1, 6) AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS d, count(*) AS n
                FROM ({rows}) GROUP BY {by}substr(h, 1, 6)) GROUP BY {by}substr(b, 1, 3))
    {f"GROUP BY {group}" if group else ""}"""


FREEZE_SQL = checksum_sql("""SELECT sha256(concat_ws(chr(31), project_id, source_type, source_id, source_version,
    content_hash, visibility)) AS h FROM sources
    WHERE project_id = 2 AND deleted_at IS NULL AND index_status <> 'deleted'""", [SNAPSHOT_SCHEME, "2", "2"])


@query("dataset_freeze", "V7 A29 P12", f"""
    SELECT CAST(2 AS BIGINT) AS dataset_id, CAST(5 AS BIGINT) AS version, row_count AS source_count,
           checksum AS manifest_checksum, false AS reused FROM ({FREEZE_SQL})""")
def dataset_freeze(spark, sf):
    """A project with four earlier (different) versions gets version five."""
    earlier = model.table(spark, sf, "region").select(
        F.lit(2).cast("bigint").alias("dataset_id"), F.col("r_regionkey").cast("bigint").alias("version"),
        F.sha2("r_name", 256).alias("manifest_checksum"),
    )
    return versions.freeze(registry(spark, sf), 2, 2, earlier)


@query("row_set_checksum", "A29", checksum_sql("""
    SELECT sha256(concat_ws(chr(31), o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) AS h FROM orders""", ["orders_v1"]))
def row_set_checksum(spark, sf):
    rows = model.table(spark, sf, "orders")
    return manifest.manifest_checksum(rows, ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], ["orders_v1"])


NOTE_KEYS = ["project_id", "note_id", "fact_date"]
MEASURES = ["view_count", "collect_count", "comment_count", "event_count"]


@query("fact_versions", "V8 P5", """
    SELECT f.project_id, f.note_id, f.fact_date, f.view_count, f.collect_count, f.comment_count, f.event_count,
           CAST(coalesce(o.v, 0) + 1 AS BIGINT) AS source_version
    FROM note_facts f LEFT JOIN (
      SELECT project_id, note_id, fact_date, view_count, collect_count, comment_count,
             CASE WHEN note_id % 2 = 0 THEN event_count ELSE event_count + 1 END AS event_count,
             CASE WHEN note_id % 5 = 0 THEN 4 ELSE 1 END AS v
      FROM note_facts WHERE note_id % 3 <> 0) o USING (project_id, note_id, fact_date)
    WHERE (f.view_count, f.collect_count, f.comment_count, f.event_count) IS DISTINCT FROM
          (o.view_count, o.collect_count, o.comment_count, o.event_count)""")
def fact_versions(spark, sf):
    """Stored payloads lack some notes and disagree on others; only those get a new version."""
    current = facts.note_daily_facts(model.behavior(spark, sf), START, END).select(*NOTE_KEYS, *MEASURES)
    stored = current.where("note_id % 3 <> 0").withColumn(
        "event_count", F.when(F.col("note_id") % 2 == 0, F.col("event_count")).otherwise(F.col("event_count") + 1)
    ).withColumn("source_version", F.when(F.col("note_id") % 5 == 0, 4).otherwise(1).cast("bigint"))
    return versions.capture_fact_versions(stored, current, NOTE_KEYS, MEASURES)


def fact_payloads(spark, sf, subject):
    """Two captured versions of each daily fact."""
    build = facts.note_daily_facts if subject == "note_id" else facts.user_daily_facts
    rows = build(model.behavior(spark, sf), START, END).select("project_id", F.col(subject).alias("subject_id"), "fact_date", "event_count")
    return rows.withColumn("source_version", F.lit(1).cast("bigint")).unionByName(
        rows.where("event_count > 1").withColumn("source_version", F.lit(2).cast("bigint")))


@query("run_fact_inputs", "V9 W4", f"""
    SELECT project_id, subject_id, fact_date, event_count, CAST(CASE WHEN event_count > 1 THEN 2 ELSE 1 END AS BIGINT) AS source_version, fact_type
    FROM (SELECT project_id, note_id AS subject_id, fact_date, event_count, 'note_daily_fact' AS fact_type FROM note_facts
          WHERE note_id IN (SELECT note_id FROM sources WHERE deleted_at IS NULL AND index_status <> 'deleted' AND source_type = 'note')
          UNION ALL
          SELECT project_id, user_id, CAST(occurred_at AS DATE), count(*), 'user_daily_fact' FROM behavior
          WHERE occurred_at >= TIMESTAMP '2024-01-02' AND occurred_at < TIMESTAMP '2024-01-29' GROUP BY 1, 2, 3)""")
def run_fact_inputs(spark, sf):
    members = versions.live_sources(registry(spark, sf)).where("source_type = 'note'").select("note_id")
    return versions.run_fact_inputs(fact_payloads(spark, sf, "note_id"), fact_payloads(spark, sf, "user_id"), members)


@query("run_source_load", "V20", """
    SELECT source_type, count(*) AS loaded, CAST(sum(length(canonical_text)) AS BIGINT) AS characters
    FROM sources WHERE deleted_at IS NULL AND index_status <> 'deleted' GROUP BY 1""")
def run_source_load(spark, sf):
    rows = registry(spark, sf)
    members = versions.live_sources(rows).select(*versions.SOURCE_KEY, "source_version", "content_hash")
    loaded = versions.run_sources(members, versions.capture_payloads(rows))
    return loaded.groupBy("source_type").agg(F.count("*").alias("loaded"), F.sum(F.char_length("canonical_text")).alias("characters"))


@query("missing_payloads", "U4", """
    SELECT source_type, source_id FROM sources WHERE deleted_at IS NULL AND index_status <> 'deleted' AND source_id % 50 = 0""")
def missing_payloads(spark, sf):
    """Payloads of every fiftieth source are lost; exactly those references come back."""
    rows = registry(spark, sf)
    members = versions.live_sources(rows).select(*versions.SOURCE_KEY, "source_version")
    payloads = versions.capture_payloads(rows.where("source_id % 50 <> 0"))
    return versions.missing_payloads(members, payloads).select("source_type", "source_id")


@query("snapshot_diff", "V19 J12", """
    SELECT source_id, CASE WHEN source_id % 40 = 1 THEN 'removed' WHEN source_id % 40 = 2 THEN 'altered' END AS change
    FROM sources WHERE source_type = 'note' AND source_id % 40 IN (1, 2)""")
def snapshot_diff(spark, sf):
    """A frozen copy compared with a tampered one."""
    frozen = registry(spark, sf).where("source_type = 'note'").select("source_id", "content_hash", "visibility")
    tampered = frozen.where("source_id % 40 <> 1").withColumn(
        "visibility", F.when(F.col("source_id") % 40 == 2, "open").otherwise(F.col("visibility")))
    return merge.snapshot_diff(frozen, tampered, ["source_id"], ["content_hash", "visibility"])


# Documents, chunks and citations -------------------------------------------------------


@query("direct_documents", "V10 F1 F2", """
    SELECT document_key, document_type, source_key, visibility, content_hash, strlen(canonical_text) AS bytes
    FROM built_docs WHERE document_type <> 'note_comment_cluster'""")
def direct_documents(spark, sf):
    return direct_docs(spark, sf).select(
        "document_key", "document_type", "source_key", "visibility", "content_hash",
        F.octet_length("canonical_text").cast("bigint").alias("bytes"))


@query("comment_clusters", "V11 W5 W14 F9", """
    SELECT document_key, project_id, note_id, source_key, source_content_hash, visibility, canonical_text
    FROM built_docs WHERE document_type = 'note_comment_cluster'""")
def comment_clusters(spark, sf):
    return cluster_docs(spark, sf).select(
        "document_key", "project_id", "note_id", "source_key", "source_content_hash", "visibility", "canonical_text")


@query("cluster_segments", "V11 W14", """
    SELECT s.document_key, s.source_id, CAST(s.seg_start AS INTEGER) AS start_byte, CAST(s.seg_end AS INTEGER) AS end_byte
    FROM segments s WHERE s.source_type = 'note_comment'""")
def cluster_segments(spark, sf):
    return cluster_docs(spark, sf).select("document_key", F.explode("segments").alias("s")).select(
        "document_key", "s.source_id", "s.start_byte", "s.end_byte")


def fact_docs(spark, sf):
    """Documents of the first version of every note and user fact."""
    kinds = {
        "note_daily_fact": (facts.note_daily_facts, facts.NOTE_FACT_MEASURES), "user_daily_fact": (facts.user_daily_facts, facts.USER_FACT_MEASURES),
    }
    found = None
    for kind, (build, measures) in kinds.items():
        rows = build(model.behavior(spark, sf), START, END).withColumn("source_version", F.lit(1).cast("bigint")).withColumn("content_hash", manifest.record_checksum(measures))
        part = evidence.fact_documents(rows, kind, DATASET_VERSION_ID)
        found = part if found is None else found.unionByName(part)
    return found


def json_sql(measures):
    """The JSON of some counts, names in order."""
    return "'{' || " + " || ',' || ".join(f"'\"{m}\":' || {m}" for m in sorted(measures)) + " || '}'"


define("fact_docs", f"""
    SELECT *, sha256(concat_ws(chr(31), '11', document_type, source_key, '1', source_content_hash, 'evidence_parser_v1', sha256('evidence_parser_v1' || chr(31) || canonical_text))) AS document_key
    FROM (SELECT project_id, 'note_daily_fact' AS document_type, note_id AS source_id, fact_date, 'note_daily_fact:' || note_id || ':' || fact_date AS source_key, sha256({json_sql(facts.NOTE_FACT_MEASURES)}) AS source_content_hash,
           '笔记日事实' || chr(10) || '日期: ' || fact_date || chr(10) || '笔记ID: ' || note_id || chr(10) || '浏览: ' || view_count
           || chr(10) || '点赞: ' || like_count || chr(10) || '收藏: ' || collect_count || chr(10) || '评论: ' || comment_count
           || chr(10) || '分享: ' || share_count || chr(10) || '独立用户: ' || unique_user_count || chr(10) || '事件总数: ' || event_count AS canonical_text
    FROM note_facts
    UNION ALL
    SELECT project_id, 'user_daily_fact', user_id, fact_date, 'user_daily_fact:' || user_id || ':' || fact_date, sha256({json_sql(facts.USER_FACT_MEASURES)}),
           '用户日事实' || chr(10) || '日期: ' || fact_date || chr(10) || '用户ID: ' || user_id || chr(10) || '浏览: ' || view_count
           || chr(10) || '互动: ' || interaction_count || chr(10) || '发帖: ' || content_count || chr(10) || '评论: ' || comment_count
           || chr(10) || '活跃笔记: ' || active_note_count || chr(10) || '事件总数: ' || event_count
    FROM user_facts)""")
define("fact_chunk_rows", """
    SELECT *, strlen(canonical_text) AS n, sha256(canonical_text) AS content_hash,
           sha256(concat_ws(chr(31), document_key, 0, 0, strlen(canonical_text), sha256(canonical_text), 'utf8_paragraph_1200_160_v1')) AS chunk_key FROM fact_docs""")


@query("fact_documents", "V12 F8", "SELECT document_key, source_key, canonical_text FROM fact_docs")
def fact_documents(spark, sf):
    return fact_docs(spark, sf).select("document_key", "source_key", "canonical_text")


@query("fact_chunks", "V12 V13", """
    SELECT document_key, chunk_key, 0 AS chunk_index, 0 AS start_byte, CAST(n AS INTEGER) AS end_byte, content_hash FROM fact_chunk_rows""")
def fact_chunks(spark, sf):
    return evidence.chunks(fact_docs(spark, sf)).select("document_key", "chunk_key", "chunk_index", "start_byte", "end_byte", "content_hash")


@query("fact_citations", "V13 J10 F26", """
    SELECT chunk_key, document_type AS source_type, source_id, fact_date, CAST(1 AS BIGINT) AS source_version, source_content_hash, canonical_text AS quote,
           sha256(concat_ws(chr(31), chunk_key, document_type, source_id, 1, 0, n, 0, n, sha256(canonical_text))) AS citation_key FROM fact_chunk_rows""")
def fact_citations(spark, sf):
    return evidence.citations(evidence.chunks(fact_docs(spark, sf))).select(
        "chunk_key", "source_type", "source_id", "fact_date", "source_version", "source_content_hash", "quote", "citation_key")


@query("fact_lifecycle", "V17 V12", """
    SELECT document_key, CASE WHEN source_id % 3 = 0 THEN 'superseded' ELSE 'ready' END AS new_status FROM fact_docs""")
def fact_lifecycle(spark, sf):
    """Every third subject's facts were captured again with other measures."""
    docs = fact_docs(spark, sf).withColumn("lifecycle_status", F.lit("ready"))
    cites = evidence.cited_versions(docs)
    again = cites.where("source_id % 3 = 0").withColumn("source_version", F.col("source_version") + 1)
    columns = ["project_id", "source_type", "source_id", "fact_date", "source_version"]
    flags = evidence.source_flags(cites, registry(spark, sf), cites.select(*columns).unionByName(again.select(*columns)))
    return evidence.reconcile_lifecycle(docs, flags).select("document_key", "new_status")


@query("document_chunks", "V13 F4 F5 F6", """
    SELECT document_key, chunk_key, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(start_byte AS INTEGER) AS start_byte,
           CAST(end_byte AS INTEGER) AS end_byte, CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char,
           content_hash FROM chunk_rows""")
def document_chunks(spark, sf):
    return all_chunks(spark, sf).select(
        "document_key", "chunk_key", "chunk_index", "start_byte", "end_byte", "start_char", "end_char", "content_hash")


@query("chunk_tokens", "F3", r"""
    SELECT chunk_key, list_transform(regexp_extract_all(content, '[\p{L}\p{Nd}]+'), lambda w: lower(w)) AS lexemes FROM chunk_rows""")
def chunk_tokens(spark, sf):
    return all_chunks(spark, sf).select("chunk_key", "lexemes")


@query("chunk_citations", "V13 J10 F26", """
    SELECT document_key, chunk_key, source_type, source_id, source_version, source_content_hash,
           CAST(document_start_byte AS INTEGER) AS document_start_byte, CAST(document_end_byte AS INTEGER) AS document_end_byte,
           CAST(source_start_byte AS INTEGER) AS source_start_byte, CAST(source_end_byte AS INTEGER) AS source_end_byte,
           quote, quote_hash, citation_key FROM citation_rows""")
def chunk_citations(spark, sf):
    return evidence.citations(all_chunks(spark, sf)).drop("fact_date")


@query("run_totals", "A10 J16 V14 V16", """
    SELECT (SELECT count(*) FROM built_docs) AS document_count, (SELECT count(*) FROM chunk_rows) AS chunk_count,
           (SELECT count(*) FROM citation_rows) AS citation_count,
           (SELECT count(*) FROM built_docs WHERE document_type = 'note') AS reused_document_count""")
def run_totals(spark, sf):
    """A run after the notes were already stored: those are reused, the rest created."""
    from quillspark.session import materialize

    rows = materialize(all_chunks(spark, sf).select("document_key", "document_type", "chunk_key", "chunk_index", "start_byte", "end_byte", "content", "segments"))
    counted = rows.groupBy("document_key", "document_type").agg(F.count("*").alias("chunk_count"))
    docs = built_documents(spark, sf).select("document_key", "content_hash").join(counted, "document_key")
    linked = evidence.link_reusable(docs, docs.where("document_type = 'note'"))
    return evidence.run_totals(linked, rows, evidence.citations(rows))


@query("output_manifest", "U3 A29", checksum_sql("""
    SELECT 'document' AS item_type, sha256(document_key) AS h FROM built_docs
    UNION ALL SELECT 'chunk', sha256(chunk_key) FROM chunk_rows
    UNION ALL SELECT 'citation', sha256(citation_key) FROM citation_rows""", ["output_v1"], "item_type"))
def output_manifest(spark, sf):
    from quillspark.session import materialize

    chunks = materialize(all_chunks(spark, sf).select("document_key", "chunk_key", "start_byte", "end_byte", "content", "segments"))
    rows = manifest.union_manifest({
        "document": built_documents(spark, sf).select("document_key"), "chunk": chunks.select("chunk_key"),
        "citation": evidence.citations(chunks).select("citation_key")})
    return manifest.manifest_checksum(rows, ["item_key"], ["output_v1"], ["item_type"])


@query("document_reuse", "V14", """
    SELECT document_key, CASE WHEN source_id % 3 = 0 THEN 'reused' ELSE 'created' END AS disposition
    FROM built_docs WHERE document_type = 'note'""")
def document_reuse(spark, sf):
    """Stored notes: one third equal, one third other text, one third other chunk count."""
    notes = direct_docs(spark, sf).where("document_type = 'note'").select("document_key", "content_hash", "source_id", F.lit(1).alias("chunk_count"))
    stored = notes.withColumn("content_hash", F.when(F.col("source_id") % 3 == 1, "other").otherwise(F.col("content_hash"))).withColumn(
        "chunk_count", F.when(F.col("source_id") % 3 == 2, 9).otherwise(F.col("chunk_count")))
    return evidence.link_reusable(notes, stored).select("document_key", "disposition")


@query("document_supersede", "V15 W13", """
    SELECT source_id, source_version, CASE WHEN source_version < newest AND index_status <> 'deleted' THEN 'superseded'
           WHEN index_status = 'deleted' THEN 'deleted' ELSE 'ready' END AS lifecycle_status
    FROM (SELECT *, max(source_version) FILTER (WHERE index_status <> 'deleted') OVER (PARTITION BY project_id, source_type, source_id) AS newest FROM versioned)""")
def document_supersede(spark, sf):
    docs = versioned(spark, sf).select(
        "project_id", "source_type", "source_id", "source_version",
        F.concat_ws(":", "source_type", F.col("source_id").cast("string")).alias("source_key"),
        F.when(F.col("index_status") == "deleted", "deleted").otherwise("ready").alias("lifecycle_status"),
        F.col("source_version").alias("ingest_order"))
    return evidence.supersede(docs).select("source_id", "source_version", "lifecycle_status")


@query("sources_indexed", "V16", """
    SELECT source_type, source_id, CASE WHEN deleted_at IS NULL AND index_status <> 'deleted' AND canonical_text <> ''
           THEN 'indexed' ELSE index_status END AS index_status FROM sources""")
def sources_indexed(spark, sf):
    rows = registry(spark, sf)
    cited = built_documents(spark, sf).select(F.explode("segments").alias("s")).select("s.source_type", "s.source_id", "s.source_version")
    return evidence.mark_indexed(rows, cited).select("source_type", "source_id", "index_status")


def lifecycle_documents(spark, sf):
    """First-version documents cited against the versioned registry, one kind per id class."""
    kind = F.expr("CASE source_id % 4 WHEN 0 THEN 'note_comment_cluster' WHEN 1 THEN 'note_daily_fact' ELSE 'note' END")
    docs = versioned(spark, sf).where("source_version = 1").select(
        F.concat_ws("/", kind, F.col("source_id").cast("string")).alias("document_key"), kind.alias("document_type"),
        "project_id", "source_type", "source_id", "source_version", F.lit(None).cast("date").alias("fact_date"),
        F.when(F.col("source_id") % 9 == 0, "failed").otherwise("ready").alias("lifecycle_status"))
    return docs.withColumn("fact_date", F.when(F.col("document_type") == "note_daily_fact", F.lit("2024-01-05").cast("date")))


def lifecycle_flags(spark, sf, docs):
    registry_rows = versions.close_older_versions(versioned(spark, sf))
    fact_rows = docs.where("document_type = 'note_daily_fact'").select(
        "project_id", "source_type", "source_id", "fact_date", (F.col("source_version") + F.col("source_id") % 2 + F.col("source_id") % 3 - 1).alias("source_version"))
    return evidence.source_flags(docs, registry_rows, fact_rows)


@query("lifecycle_reconcile", "V17 J5 J6", """
    SELECT d.source_id, d.document_type, CASE
             WHEN d.source_id % 9 = 0 THEN 'failed'
             WHEN d.document_type = 'note_comment_cluster' AND gone THEN 'stale'
             WHEN d.document_type = 'note' AND gone AND live > 1 THEN 'superseded'
             WHEN d.document_type = 'note' AND gone THEN 'deleted'
             WHEN d.document_type = 'note_daily_fact' AND d.source_id % 3 = 1 THEN 'superseded'
             ELSE 'ready' END AS new_status
    FROM (SELECT v.source_id, CASE v.source_id % 4 WHEN 0 THEN 'note_comment_cluster' WHEN 1 THEN 'note_daily_fact' ELSE 'note' END AS document_type,
                 v.index_status = 'deleted' OR EXISTS (SELECT 1 FROM versioned n WHERE n.source_id = v.source_id AND n.source_version = 2) AS gone,
                 (SELECT max(n.source_version) FROM versioned n WHERE n.source_id = v.source_id AND n.index_status <> 'deleted'
                    AND (n.source_version = 2 OR NOT EXISTS (SELECT 1 FROM versioned m WHERE m.source_id = n.source_id AND m.source_version = 2))) AS live
          FROM versioned v WHERE v.source_version = 1) d WHERE d.source_id % 3 <> 2 OR d.document_type <> 'note_daily_fact'
    UNION ALL
    SELECT source_id, 'note_daily_fact', CASE WHEN source_id % 9 = 0 THEN 'failed' ELSE 'superseded' END
    FROM versioned WHERE source_version = 1 AND source_id % 4 = 1 AND source_id % 3 = 2""")
def lifecycle_reconcile(spark, sf):
    docs = lifecycle_documents(spark, sf)
    return evidence.reconcile_lifecycle(docs, lifecycle_flags(spark, sf, docs)).select("source_id", "document_type", "new_status")


@query("evidence_audit", "V18 V16 F26", """
    SELECT 'incomplete_documents' AS check_name, CAST(0 AS BIGINT) AS violations UNION ALL
    SELECT 'chunk_count_mismatch', count(*) FROM built_docs WHERE document_type = 'note_media' UNION ALL
    SELECT 'active_deleted_source', 0 UNION ALL
    SELECT 'scope_mismatch', count(*) FROM built_docs WHERE project_id <> 2 UNION ALL
    SELECT 'invalid_chunk_slice', count(*) FROM chunk_rows WHERE chunk_index = 1 UNION ALL
    SELECT 'chunks_without_citation', 0 UNION ALL
    SELECT 'invalid_citation_slice', 0 UNION ALL
    SELECT 'output_checksum_mismatch', CASE WHEN EXISTS (SELECT 1 FROM chunk_rows WHERE chunk_index = 1) THEN 1 ELSE 0 END""")
def evidence_audit(spark, sf):
    """The run's second chunks are damaged, its media claim a wrong chunk count, its scope is project 2."""
    from quillspark.session import materialize

    docs = built_documents(spark, sf)
    rows = materialize(evidence.chunks(docs).select("document_key", "chunk_key", "chunk_index", "start_byte", "end_byte", "content", "content_hash", "segments"))
    cited = evidence.citations(rows)
    counted = rows.groupBy("document_key").agg(F.count("*").alias("chunk_count"))
    stored = docs.join(counted, "document_key").withColumn("lifecycle_status", F.lit("ready")).withColumn(
        "chunk_count", F.when(F.col("document_type") == "note_media", F.col("chunk_count") + 1).otherwise(F.col("chunk_count")))
    damaged = rows.withColumn("content", F.when(F.col("chunk_index") == 1, F.concat("content", F.lit("?"))).otherwise(F.col("content")))
    cites = evidence.cited_versions(stored)
    flags = evidence.source_flags(cites, registry(spark, sf), cites.where("fact_date IS NOT NULL"))
    recorded = materialize(evidence.output_checksum(stored, rows, cited))
    return evidence.audit(stored, damaged, cited, flags, F.lit(2), recorded)


@query("output_checksum_check", "V18 A29", """
    SELECT 'intact' AS output, CAST(0 AS BIGINT) AS mismatches
    UNION ALL SELECT 'one_quote_changed', 1 UNION ALL SELECT 'documents_lost', 3""")
def output_checksum_check(spark, sf):
    """A run's output against the checksum it recorded: as it was, with one quote changed, and without its media."""
    from quillspark.session import materialize

    docs = materialize(direct_docs(spark, sf).select("document_key", "document_type", "canonical_text", "segments"))
    rows = materialize(evidence.chunks(docs).select("document_key", "document_type", "chunk_key", "start_byte", "end_byte", "content", "segments"))
    cited = evidence.citations(rows)
    recorded = materialize(evidence.output_checksum(docs, rows, cited))
    first = cited.agg(F.min("citation_key").alias("first"))
    changed = ordering.with_row(cited, first).withColumn("quote", F.when(F.col("citation_key") == F.col("first"), "changed").otherwise(F.col("quote"))).drop("first")
    docs_kept, rows_kept = (x.where("document_type <> 'note_media'") for x in (docs, rows))
    outputs = {
        "intact": (docs, rows, cited), "one_quote_changed": (docs, rows, changed),
        "documents_lost": (docs_kept, rows_kept, evidence.citations(rows_kept)),
    }
    found = None
    for name, output in outputs.items():
        both = recorded.select("item_type", F.col("checksum").alias("stored")).join(evidence.output_checksum(*output), "item_type", "full_outer")
        row = both.agg(F.count_if(~F.col("stored").eqNullSafe(F.col("checksum"))).alias("mismatches")).select(F.lit(name).alias("output"), "mismatches")
        found = row if found is None else found.unionByName(row)
    return found


def stored_points(spark, sf):
    """Chunks of all document types as points, and what a store holds of them: some lost, some changed, some strays."""
    from quillspark.session import materialize

    rows = materialize(all_chunks(spark, sf).select("chunk_key", "content_hash", "start_byte"))
    actual = rows.where("start_byte % 3 <> 0").select(
        "chunk_key", F.when(F.col("start_byte") % 3 == 1, F.lit("changed")).otherwise(F.col("content_hash")).alias("content_hash"))
    strays = model.table(spark, sf, "embeddings").select(
        F.concat(F.lit("orphan-"), F.col("vec_id").cast("string")).alias("chunk_key"), F.lit("x").alias("content_hash"))
    return rows, actual.unionByName(strays)


@query("manifest_compare", "J12 R20", """
    SELECT chunk_key, CASE WHEN m = 0 THEN 'missing' WHEN m = 1 THEN 'mismatched' ELSE 'exact' END AS status
    FROM (SELECT chunk_key, start_byte % 3 AS m FROM chunk_rows)
    UNION ALL SELECT 'orphan-' || vec_id, 'orphan' FROM embeddings""")
def manifest_compare(spark, sf):
    rows, actual = stored_points(spark, sf)
    return manifest.compare_manifests(rows, actual, "chunk_key", "content_hash")


@query("manifest_tree_compare", "V18 R20 A29", """
    SELECT chunk_key, CASE WHEN start_byte % 3 = 0 THEN 'missing' ELSE 'mismatched' END AS status FROM chunk_rows WHERE start_byte % 3 <> 2
    UNION ALL SELECT 'orphan-' || vec_id, 'orphan' FROM embeddings""")
def manifest_tree_compare(spark, sf):
    from quillspark.session import materialize

    rows, actual = stored_points(spark, sf)
    tree = materialize(manifest.digest_tree(rows, "chunk_key", ["chunk_key", "content_hash"]))
    return manifest.compare_by_tree(rows, tree, actual, "chunk_key", "content_hash")


@query("audit_id_sample", "K9", """
    SELECT list(id ORDER BY id) AS sample_ids, count(*) AS sample_size
    FROM (SELECT id FROM docs WHERE status = 'deleted' ORDER BY id LIMIT 100)""")
def audit_id_sample(spark, sf):
    return manifest.id_sample(model.documents(spark, sf).where("status = 'deleted'"), "id")
