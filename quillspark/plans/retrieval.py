"""Lexical, vector and hybrid search of all benchmark passages over the evidence chunks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quillspark.functions import contract as C
from quillspark.functions.embedding import DIMENSION, hashed_words
from quillspark.functions.text import hash_parts
from quillspark.operators import evidence, index, lexical, search, vector, versions
from quillspark.operators.containment import containment
from quillspark.operators.versions import close_older_versions
from quillspark.plans import evidence as ev
from quillspark.plans.registry import REGISTRY
from quillspark.session import fingerprint, materialize, passing, scratch_dir
from quillspark.sources import model

query, define = REGISTRY.query, REGISTRY.define

# Spark side --------------------------------------------------------------------------


#: The ingestion run of the corpus, and the tables it is built from.
RUN = f"run-{ev.DATASET_VERSION_ID}"
CORPUS_TABLES = ["documents", "pages", "conversations", "region", "nation"]


def ingestion_runs(spark, sf):
    """One completed run per project."""
    return model.projects(spark, sf).select(
        F.col("id").alias("project_id"), F.lit(RUN).alias("run_id"), F.lit(ev.DATASET_VERSION_ID).alias("dataset_version_id"),
        F.to_timestamp(F.lit("2024-03-01")).alias("completed_at"), F.lit("completed").alias("status"))


def empty_index(spark, sf):
    """The index that belongs to this state of the tables; a later search of the same state finds what an earlier one stored."""
    state = fingerprint(spark, [f"{sf}/{t}.parquet" for t in CORPUS_TABLES])
    versions = f"{C.PARSER_VERSION}-{C.CHUNKER_VERSION}-{C.LEXICAL_INDEX_VERSION}"
    return index.LexicalIndex(spark, f"{scratch_dir(spark)}/quillspark/lexical-{versions}-{state}", int(spark.conf.get("spark.sql.shuffle.partitions")))


def stored_index(spark, sf):
    stored = empty_index(spark, sf)
    if not stored.has(RUN):
        with passing(spark):  # the index holds all that was ranked on the way
            stored.add_run(RUN, ev.DATASET_VERSION_ID, F.to_timestamp(F.lit("2024-03-01")),
                           ev.chunk_parts(ev.direct_docs(spark, sf), ev.cluster_docs(spark, sf)), model.projects(spark, sf))
    return stored


def dead_documents(spark, sf):
    """Documents of labelled-toxic notes: their second version is deleted and closed the first."""
    cites = ev.direct_docs(spark, sf).where("document_type = 'note'").select(
        "document_key", "project_id", "source_type", "source_id", "source_version")
    return lexical.dead_documents(cites, close_older_versions(ev.versioned(spark, sf)))


def gold_pairs(spark, sf):
    """Published notes that contain a benchmark passage word for word."""
    texts = model.spread(model.documents(spark, sf).where("status = 'published'").select(F.col("id").alias("text_id"), F.col("body").alias("text")))
    anchors = model.query_table(spark, sf).select(F.col("query_id").alias("anchor_id"), F.col("query").alias("anchor"))
    return containment(texts, anchors).select(F.col("anchor_id").alias("query_id"), F.col("text_id").alias("note_id"))


def cases(spark, sf, gold=None):
    """One case per passage, asked in a project holding it; private projects test authorization.

    Written once: what resolves scopes reads them several times, and each would look through all texts again.
    """
    homes = (gold_pairs(spark, sf) if gold is None else gold).join(
        model.documents(spark, sf).select(F.col("id").alias("note_id"), F.col("project_id").alias("home")), "note_id"
    ).groupBy("query_id").agg(F.min("home").alias("home"))
    private = model.projects(spark, sf).where("visibility <> 'public'").select(F.col("id").alias("project_id"), F.lit(True).alias("private"))
    allowed = model.members(spark, sf).where("status = 'active'").groupBy("project_id").agg(F.min("user_id").alias("member_id"))
    rows = model.query_table(spark, sf).join(homes, "query_id", "left").withColumn(
        "project_id", F.coalesce("home", "project_id")
    ).join(private, "project_id", "left").join(allowed, "project_id", "left")
    task = (
        F.when(F.col("home").isNull(), C.NO_RELEVANT_TASKS[0]).when(F.col("private"), C.AUTHORIZATION_TASK)
        .otherwise("semantic_paraphrase")
    )
    none = F.lit(None).cast("array<string>")
    return materialize(rows.withColumn("task_type", task).select(
        "query_id", "query", "project_id",
        F.when(F.col("task_type") == C.AUTHORIZATION_TASK, F.col("member_id")).otherwise(F.lit(0)).cast("bigint").alias("user_id"),
        "task_type", none.alias("document_types"), none.alias("source_types"),
    ))


ANONYMOUS = 1_000_000_000


def planned_cases(spark, sf, anonymous=False, gold=None):
    """Planned requests; with ``anonymous`` every authorization case is asked a second time by nobody."""
    asked = cases(spark, sf, gold)
    if anonymous:
        again = asked.where(F.col("task_type") == C.AUTHORIZATION_TASK).withColumn(
            "query_id", F.col("query_id") + ANONYMOUS).withColumn("user_id", F.lit(0).cast("bigint"))
        asked = asked.unionByName(again)
    scoped = search.resolve_access(asked, model.projects(spark, sf), model.members(spark, sf))
    latest = scoped.withColumn("wanted_version", F.lit(None).cast("int")).withColumn("wanted_run", F.lit(None).cast("string"))
    return materialize(lexical.plan_queries(search.in_runs(latest, ingestion_runs(spark, sf)).drop("wanted_version", "wanted_run")))


def searched(spark, sf, planned):
    """The planned cases against the stored index; chunks carry their lifecycle in ``hidden`` only."""
    return search.IndexedSearch(planned, stored_index(spark, sf), dead_documents(spark, sf))


def plain(rows):
    """Rows with the chunk keys of the run's output instead of the index's."""
    return rows.withColumn("chunk_key", index.plain_key("chunk_key"))


def lexical_rows(spark, sf, planned):
    session = searched(spark, sf, planned)
    return session.lexical_candidates(session.term_statistics())


def vector_queries(planned, embedded):
    return planned.join(embedded, "query_id").select(
        "query_id", "embedding", "project_id", "access_scope",
        F.coalesce("document_types", F.array("preferred_type")).alias("document_types"),
        F.col("hinted_note_ids").alias("hints"), "preferred_position")


POINT_COLUMNS = ["document_key", "project_id", "project_open", "visibility", "document_type", "note_id", "media_position"]


def text_vectors(planned, chunks):
    asked = vector.embed(planned, "query_id", "query", hashed_words, DIMENSION, C.QUERY_INSTRUCTION)
    stored = vector.embed(chunks, "chunk_key", "content", hashed_words, DIMENSION, carried=POINT_COLUMNS)
    return asked.where("error IS NULL").drop("error"), stored.where("error IS NULL").drop("error")


# SQL side ----------------------------------------------------------------------------

define("gold_pairs", """
    SELECT q.query_id, d.id AS note_id, d.project_id FROM queries q JOIN docs d ON contains(d.body, q.query)
    WHERE d.status = 'published'""")
define("eval_cases", """
    SELECT q.query_id, q.query, coalesce(h.home, q.project_id) AS project_id,
           CASE WHEN h.home IS NULL THEN 'no_relevant_document' WHEN p.visibility <> 'public' THEN 'authorization_boundary'
                ELSE 'semantic_paraphrase' END AS task_type,
           CASE WHEN h.home IS NOT NULL AND p.visibility <> 'public' THEN
                (SELECT min(m.user_id) FROM members m WHERE m.status = 'active' AND m.project_id = h.home) ELSE 0 END AS user_id
    FROM queries q LEFT JOIN (SELECT query_id, min(project_id) AS home FROM gold_pairs GROUP BY 1) h USING (query_id)
    LEFT JOIN projects p ON p.id = coalesce(h.home, q.project_id)""")
define("access", """
    SELECT c.*, CASE WHEN p.id IS NULL THEN 'none' WHEN EXISTS (SELECT 1 FROM members m WHERE m.project_id = c.project_id
                AND m.user_id = c.user_id AND m.status = 'active') THEN 'member'
                WHEN p.visibility = 'public' THEN 'public' ELSE 'none' END AS access_scope
    FROM eval_cases c LEFT JOIN projects p ON p.id = c.project_id AND p.status = 'active'""")
define("toks", r"""
    SELECT c.project_id, c.chunk_key, c.visibility, p.visibility = 'public' AND c.visibility = 'public' AS open,
           unnest(w) AS term, generate_subscripts(w, 1) AS position
    FROM (SELECT *, list_transform(regexp_extract_all(content, '[\p{L}\p{Nd}]+'), lambda x: lower(x)) AS w FROM chunk_rows) c
    JOIN projects p ON p.id = c.project_id""")
define("scope_sizes", """
    SELECT c.project_id, s.access_scope, count(*) FILTER (WHERE s.access_scope = 'member' OR (p.visibility = 'public' AND c.visibility = 'public')) AS n
    FROM chunk_rows c JOIN projects p ON p.id = c.project_id, (VALUES ('member'), ('public')) s(access_scope) GROUP BY 1, 2""")
define("scope_stats", """
    SELECT t.project_id, s.access_scope, t.term, count(DISTINCT t.chunk_key) AS chunk_frequency, count(*) AS occurrence_count,
           ln((any_value(z.n)::DOUBLE + 1.0::DOUBLE) / (count(DISTINCT t.chunk_key)::DOUBLE + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf
    FROM toks t, (VALUES ('member'), ('public')) s(access_scope)
    JOIN scope_sizes z ON z.project_id = t.project_id AND z.access_scope = s.access_scope
    WHERE s.access_scope = 'member' OR t.open GROUP BY 1, 2, 3""")
define("q_terms", r"""
    SELECT query_id, project_id, access_scope, term, row_number() OVER (PARTITION BY query_id ORDER BY p) - 1 AS term_no
    FROM (SELECT query_id, project_id, access_scope, term, min(p) AS p
          FROM (SELECT query_id, project_id, access_scope, unnest(w) AS term, generate_subscripts(w, 1) AS p
                FROM (SELECT *, list_transform(regexp_extract_all(query, '[\p{L}\p{Nd}]+'), lambda x: lower(x)) AS w FROM access))
          WHERE length(term) >= 2 OR regexp_matches(term, '^\d+$') GROUP BY ALL)
    QUALIFY term_no < 64""")
define("q_stats", """
    SELECT q.*, s.idf FROM q_terms q LEFT JOIN scope_stats s USING (project_id, access_scope, term)""")
define("cand_terms", r"""
    SELECT query_id, project_id, term, idf, row_number() OVER (PARTITION BY query_id ORDER BY tier, idf DESC, term_no) AS term_rank
    FROM (SELECT *, CASE WHEN num AND row_number() OVER (PARTITION BY query_id, num ORDER BY idf DESC, term_no) <= 4 THEN 1 ELSE 2 END AS tier
          FROM (SELECT *, regexp_matches(term, '^\d+$') AS num FROM q_stats WHERE idf IS NOT NULL))
    QUALIFY term_rank <= 12""")
define("dead_docs", """
    SELECT b.document_key FROM built_docs b JOIN labels l ON l.doc_id + 1 = b.source_id AND l.toxic = 1 WHERE b.document_type = 'note'""")
define("hit_rows", """
    SELECT c.query_id, t.chunk_key, t.position, c.term_rank FROM toks t JOIN cand_terms c ON c.project_id = t.project_id AND c.term = t.term
    WHERE c.term_rank <= 6""")
define("matched", """
    SELECT h.query_id, h.chunk_key, n.term_count,
           list_sum(list(h.gain ORDER BY h.position)) AS cover, count(*) AS hits
    FROM (SELECT *, CASE WHEN lag(term_rank) OVER w <> term_rank THEN 0.1::DOUBLE / (position - lag(position) OVER w)::DOUBLE ELSE 0.0::DOUBLE END AS gain
          FROM hit_rows WINDOW w AS (PARTITION BY query_id, chunk_key ORDER BY position)) h
    JOIN (SELECT query_id, least(count(*), 6) AS term_count FROM cand_terms GROUP BY 1) n USING (query_id)
    GROUP BY 1, 2, 3 HAVING count(DISTINCT h.term_rank) >= least(2, n.term_count)""")
define("freq", """
    SELECT query_id, chunk_key, list_sum(list(g ORDER BY term_rank)) AS total FROM (
      SELECT query_id, chunk_key, term_rank, 0.1::DOUBLE * list_sum(list_transform(range(1, count(*) + 1), lambda j: 1.0::DOUBLE / (j * j)::DOUBLE)) / 1.64493406685::DOUBLE AS g
      FROM hit_rows GROUP BY 1, 2, 3) GROUP BY 1, 2""")
define("pre_ranked", """
    SELECT m.query_id, m.chunk_key, raw / (raw + 1.0::DOUBLE) AS fts_score
    FROM (SELECT m.*, CASE WHEN m.term_count = 1 THEN m.hits * 0.1::DOUBLE ELSE m.cover END AS raw,
                 f.total / m.term_count AS quick
          FROM matched m JOIN freq f USING (query_id, chunk_key) JOIN access a USING (query_id)
          JOIN chunk_rows c USING (chunk_key) JOIN projects p ON p.id = c.project_id
          WHERE c.document_type = 'note' AND c.document_key NOT IN (SELECT document_key FROM dead_docs)
            AND (a.access_scope = 'member' OR (a.access_scope = 'public' AND p.visibility = 'public' AND c.visibility = 'public'))
          QUALIFY row_number() OVER (PARTITION BY m.query_id ORDER BY quick / (quick + 1) DESC, m.chunk_key) <= 480) m
    QUALIFY row_number() OVER (PARTITION BY m.query_id ORDER BY fts_score DESC, m.chunk_key) <= 240""")
define("weights", """
    SELECT query_id, list_sum(list(coalesce(idf, 8.0::DOUBLE) ORDER BY term_no)) AS total_weight FROM q_stats GROUP BY 1""")
define("grams", r"""
    SELECT key, list_distinct(flatten(list_transform(list_distinct(regexp_extract_all(lower(txt), '[\p{L}\p{Nd}]+')),
             lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g
    FROM (SELECT chunk_key AS key, content AS txt FROM chunk_rows WHERE document_type = 'note'
          UNION ALL SELECT 'q' || query_id, query FROM access)""")
define("lexical_scored", """
    SELECT r.query_id, r.chunk_key, c.document_key, c.note_id, r.fts_score, v.coverage,
           len(list_intersect(gc.g, gq.g))::DOUBLE / (len(gc.g) + len(gq.g) - len(list_intersect(gc.g, gq.g)))::DOUBLE AS trigram_score,
           v.coverage * 0.78::DOUBLE + r.fts_score / (r.fts_score + 0.25::DOUBLE) * 0.14::DOUBLE
             + len(list_intersect(gc.g, gq.g))::DOUBLE / (len(gc.g) + len(gq.g) - len(list_intersect(gc.g, gq.g)))::DOUBLE * 0.08::DOUBLE
             + 0.14::DOUBLE AS score
    FROM pre_ranked r JOIN chunk_rows c USING (chunk_key)
    JOIN (SELECT r.query_id, r.chunk_key, coalesce(list_sum(list(q.idf ORDER BY q.term_no)), 0) / any_value(w.total_weight) AS coverage
          FROM pre_ranked r JOIN weights w USING (query_id)
          LEFT JOIN (SELECT DISTINCT chunk_key, term FROM toks) t ON t.chunk_key = r.chunk_key
          LEFT JOIN q_stats q ON q.query_id = r.query_id AND q.term = t.term WHERE q.idf IS NOT NULL GROUP BY 1, 2) v USING (query_id, chunk_key)
    JOIN grams gc ON gc.key = r.chunk_key JOIN grams gq ON gq.key = 'q' || r.query_id""")
DIVERSE_SQL = """
    SELECT query_id, chunk_key, document_key, note_id, score, confidence,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tie DESC, chunk_key) AS rank
    FROM (SELECT * FROM (SELECT *, first_value(confidence) OVER (PARTITION BY query_id ORDER BY score DESC, tie DESC, chunk_key) AS top
                         FROM (SELECT *, least(1, greatest(0, score)) AS confidence FROM {rows}))
          WHERE top >= {t} AND confidence >= greatest({t}, top * 0.72)
          QUALIFY row_number() OVER (PARTITION BY query_id, document_key ORDER BY score DESC, tie DESC, chunk_key) = 1)
    QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(CAST(note_id AS VARCHAR), document_key) ORDER BY score DESC, tie DESC, chunk_key) <= 2"""
define("lexical_found", f"""
    SELECT * FROM ({DIVERSE_SQL.format(rows="(SELECT *, fts_score AS tie FROM lexical_scored)", t="0.30::DOUBLE")}) WHERE rank <= 10""")

# Queries -----------------------------------------------------------------------------


@query("verbatim_gold", "J7", "SELECT query_id, note_id FROM gold_pairs")
def verbatim_gold(spark, sf):
    return gold_pairs(spark, sf)


@query("eval_cases", "B1 E1", "SELECT query_id, project_id, user_id, task_type FROM eval_cases")
def eval_cases(spark, sf):
    return cases(spark, sf).select("query_id", "project_id", "user_id", "task_type")


@query("access_scopes", "R4 R19", """
    SELECT query_id, CASE WHEN p.id IS NULL THEN 'none' WHEN EXISTS (SELECT 1 FROM members m WHERE m.project_id = q.project_id
           AND m.user_id = q.user_id AND m.status = 'active') THEN 'member'
           WHEN p.visibility = 'public' THEN 'public' ELSE 'none' END AS access_scope
    FROM queries q LEFT JOIN projects p ON p.id = q.project_id AND p.status = 'active'""")
def access_scopes(spark, sf):
    return search.resolve_access(model.query_table(spark, sf), model.projects(spark, sf), model.members(spark, sf)).select("query_id", "access_scope")


@query("redacted_answers", "R19", """
    SELECT query_id, 'no_relevant_document' AS status, 'no authorized evidence' AS reason, CAST(0 AS BIGINT) AS candidate_count,
           CAST(0 AS BIGINT) AS indexed_terms, '' AS run_id
    FROM queries q JOIN projects p ON p.id = q.project_id WHERE p.visibility <> 'public' AND NOT EXISTS (
      SELECT 1 FROM members m WHERE m.project_id = q.project_id AND m.user_id = q.user_id AND m.status = 'active')""")
def redacted_answers(spark, sf):
    return search.redacted(search.resolve_access(model.query_table(spark, sf), model.projects(spark, sf), model.members(spark, sf)))


@query("scope_resolution", "R3 W4", """
    SELECT q.query_id, arg_max(r.run_id, (r.completed_at, r.run_id)) AS run_id,
           arg_max(r.dataset_version_id, (r.completed_at, r.run_id)) AS dataset_version_id
    FROM (SELECT *, CASE WHEN query_id % 3 = 1 THEN 1 + query_id % 7 END AS wanted_version,
                 CASE WHEN query_id % 3 = 2 THEN 'run-' || query_id * 11 END AS wanted_run FROM queries) q
    JOIN (SELECT 'run-' || o_orderkey AS run_id, 1 + o_custkey % 5 AS project_id, 1 + o_orderkey % 7 AS dataset_version_id,
                 o_orderdate AS completed_at FROM orders WHERE o_orderstatus = 'F') r ON r.project_id = q.project_id
     AND (q.wanted_version IS NULL OR q.wanted_version = r.dataset_version_id) AND (q.wanted_run IS NULL OR q.wanted_run = r.run_id)
    GROUP BY 1""")
def scope_resolution(spark, sf):
    runs = model.table(spark, sf, "orders").select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), (F.lit(1) + F.col("o_custkey") % 5).alias("project_id"),
        (F.lit(1) + F.col("o_orderkey") % 7).alias("dataset_version_id"), F.col("o_orderdate").alias("completed_at"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'failed' END").alias("status"))
    asked = model.query_table(spark, sf).withColumn(
        "wanted_version", F.when(F.col("query_id") % 3 == 1, F.lit(1) + F.col("query_id") % 7)
    ).withColumn("wanted_run", F.when(F.col("query_id") % 3 == 2, F.concat(F.lit("run-"), (F.col("query_id") * 11).cast("string"))))
    return search.resolve_scope(asked, runs)


@query("query_plans", "R5 F11 F12 J15", """
    SELECT a.query_id, 'note' AS preferred_type, (SELECT list(term ORDER BY term_no) FROM q_terms t WHERE t.query_id = a.query_id) AS terms FROM access a""")
def query_plans(spark, sf):
    return planned_cases(spark, sf).select("query_id", "preferred_type", "terms")


@query("term_statistics", "A11 R1", """
    SELECT project_id, term, chunk_frequency, occurrence_count, round(idf, 6) AS idf FROM scope_stats WHERE access_scope = 'member'""")
def term_statistics(spark, sf):
    stats = lexical.term_statistics(ev.all_chunks(spark, sf).select("project_id", "lexemes"))
    return stats.withColumn("idf", F.round("idf", 6))


@query("scoped_statistics", "A12 R2", """
    SELECT project_id, access_scope, term, chunk_frequency, occurrence_count, round(idf, 6) AS idf FROM scope_stats""")
def scoped_statistics(spark, sf):
    rows = ev.all_chunks(spark, sf).select("project_id", "visibility", "lexemes")
    return lexical.scoped_statistics(rows, model.projects(spark, sf)).withColumn("idf", F.round("idf", 6))


@query("candidate_terms", "R6 K6", "SELECT query_id, term, CAST(term_rank AS BIGINT) AS term_rank FROM cand_terms")
def candidate_terms(spark, sf):
    planned = planned_cases(spark, sf)
    stored = stored_index(spark, sf)
    terms = lexical.candidate_terms(index.term_statistics(planned, stored, stored.scoped_to(planned.where("run_id IS NOT NULL"))))
    return terms.select("query_id", "term", F.col("term_rank").cast("bigint").alias("term_rank"))


@query("dead_documents", "J5 R8", "SELECT DISTINCT document_key FROM dead_docs")
def dead_document_keys(spark, sf):
    return dead_documents(spark, sf)


@query("lexical_candidates", "R7 R8 R9 F13 F17 K5 U2", "SELECT query_id, chunk_key, round(fts_score, 6) AS fts_score FROM pre_ranked")
def lexical_candidates(spark, sf):
    session = searched(spark, sf, planned_cases(spark, sf))
    ranked = session.ranked(lexical.candidate_terms(session.term_statistics()), True)
    return ranked.select("query_id", index.plain_key("chunk_key").alias("chunk_key"), F.round("fts_score", 6).alias("fts_score"))


@query("lexical_rerank", "R10 F16 F22", """
    SELECT query_id, chunk_key, round(coverage, 6) AS coverage, round(trigram_score, 6) AS trigram_score, round(score, 6) AS lexical_score
    FROM lexical_scored""")
def lexical_rerank(spark, sf):
    rows = lexical_rows(spark, sf, planned_cases(spark, sf))
    return rows.select("query_id", index.plain_key("chunk_key").alias("chunk_key"), *[F.round(c, 6).alias(c) for c in ("coverage", "trigram_score", "lexical_score")])


@query("lexical_search", "R1 R10 R16 R17 W9", """
    SELECT query_id, chunk_key, note_id, rank, round(confidence, 6) AS confidence FROM lexical_found""")
def lexical_search(spark, sf):
    rows = lexical_rows(spark, sf, planned_cases(spark, sf))
    found = search.select_diverse(search.lexical_results(rows), C.THRESHOLDS["lexical"])
    return found.select("query_id", index.plain_key("chunk_key").alias("chunk_key"), "note_id", F.col("rank").cast("bigint").alias("rank"), F.round("confidence", 6).alias("confidence"))


@query("lexical_decisions", "R16", """
    SELECT a.query_id, a.access_scope, round(coalesce(max(least(1, greatest(0, s.score))), 0), 6) AS top_confidence,
           count(s.chunk_key) AS candidate_count,
           CASE WHEN max(s.score) >= 0.30 THEN 'candidates' ELSE 'no_relevant_document' END AS status
    FROM access a LEFT JOIN lexical_scored s USING (query_id) GROUP BY 1, 2""")
def lexical_decisions(spark, sf):
    planned = planned_cases(spark, sf)
    rows = search.lexical_results(lexical_rows(spark, sf, planned))
    return search.decide(planned, rows, C.THRESHOLDS["lexical"]).withColumn("top_confidence", F.round("top_confidence", 6))


@query("result_citations", "R18 F5 J16", """
    SELECT f.query_id, f.rank, c.source_type, c.source_id, CAST(c.document_start_byte AS INTEGER) AS document_start_byte,
           CAST(c.document_end_byte AS INTEGER) AS document_end_byte, c.quote
    FROM lexical_found f JOIN citation_rows c USING (chunk_key)""")
def result_citations(spark, sf):
    session = searched(spark, sf, planned_cases(spark, sf))
    rows = session.lexical_candidates(session.term_statistics())
    found = materialize(search.select_diverse(search.lexical_results(rows), C.THRESHOLDS["lexical"]).select("query_id", "rank", "chunk_key"))
    cited = search.attach_citations(plain(found), evidence.citations(plain(session.chunks_of(found))))
    return cited.select("query_id", F.col("rank").cast("bigint").alias("rank"), F.inline("citations")).select(
        "query_id", "rank", "source_type", "source_id", "document_start_byte", "document_end_byte", "quote")


# Two runs in one index -----------------------------------------------------------------

SECOND_VERSION = 12
SECOND_RUN = f"run-{SECOND_VERSION}"


def second_sources(spark, sf):
    """The live sources a second ingestion reads: labelled notes were edited, those labelled toxic are gone."""
    labels = model.table(spark, sf, "labels").select(F.lit("note").alias("source_type"), (F.col("doc_id") + 1).alias("source_id"), "toxic")
    rows = versions.live_sources(ev.registry(spark, sf)).join(labels, ["source_type", "source_id"], "left").where("toxic IS NULL OR toxic = 0")
    edited = F.col("toxic").isNotNull()
    return rows.withColumn("canonical_text", F.when(edited, F.concat(F.lit("revised "), "canonical_text")).otherwise(F.col("canonical_text"))).withColumn(
        "source_version", F.when(edited, 2).otherwise(F.col("source_version")).cast("bigint")
    ).withColumn("content_hash", F.when(edited, hash_parts("content_hash", F.lit("edited"))).otherwise(F.col("content_hash"))).drop("toxic")


def second_documents(spark, sf):
    """Those of notes and media, and those of comments."""
    clusters = evidence.comment_clusters(ev.live_comment_sources(spark, sf), ev.DATASET_VERSION, SECOND_VERSION)
    return evidence.direct_documents(second_sources(spark, sf), SECOND_VERSION), clusters


def both_runs(spark, sf):
    first = ingestion_runs(spark, sf)
    return first.unionByName(first.withColumn("run_id", F.lit(SECOND_RUN)).withColumn("dataset_version_id", F.lit(SECOND_VERSION)).withColumn(
        "completed_at", F.to_timestamp(F.lit("2024-04-01"))))


def hidden_documents(spark, sf):
    """Documents of both runs that no search may return: cited sources are gone, or their own state is not searchable.

    The second run's documents superseded the first's of the same key, which stay searchable in
    their run; some of the second failed.
    """
    first, second = ev.direct_docs(spark, sf), evidence.direct_documents(second_sources(spark, sf), SECOND_VERSION)
    columns = ["document_key", "document_type", "project_id", "source_type", "source_id", "source_key", "source_version"]
    # Written once, as keys follow from hashes of all texts.
    docs = materialize(first.select(*columns, F.lit(1).alias("ingest_order")).unionByName(second.select(*columns, F.lit(2).alias("ingest_order"))))
    failed = (F.col("ingest_order") == 2) & (F.col("source_id") % 31 == 5)
    states = evidence.supersede(docs.withColumn("lifecycle_status", F.when(failed, "failed").otherwise("ready")))
    dead = lexical.dead_documents(docs.where("document_type = 'note'"), close_older_versions(ev.versioned(spark, sf)))
    return dead.unionByName(states.where(~F.col("lifecycle_status").isin(*C.SEARCHABLE_STATES)).select("document_key")).distinct()


def scoped_cases(spark, sf):
    """Requests that name a run, a dataset version, nothing, or a run that does not exist."""
    q = F.col("query_id")
    asked = cases(spark, sf).withColumn("query", F.concat(F.lit("revised "), "query")).withColumn(
        "wanted_run", F.when(q % 10 == 9, "run-99").when(q % 3 == 0, RUN)
    ).withColumn("wanted_version", F.when((q % 10 != 9) & (q % 3 == 1), SECOND_VERSION))
    scoped = search.resolve_access(asked, model.projects(spark, sf), model.members(spark, sf))
    return materialize(lexical.plan_queries(search.in_runs(scoped, both_runs(spark, sf))))


def two_run_index(spark, sf):
    """The index of the corpus with a second run beside the first."""
    stored = stored_index(spark, sf)
    if not stored.has(SECOND_RUN):
        with passing(spark):
            second = ev.chunk_parts(*second_documents(spark, sf))
            stored.add_run(SECOND_RUN, SECOND_VERSION, F.to_timestamp(F.lit("2024-04-01")), second, model.projects(spark, sf))
    return stored


define("plain_docs_r", """
    SELECT 11 AS run_no, * FROM plain_docs
    UNION ALL
    SELECT 12, project_id, document_type, source_type, source_id, source_key, CASE WHEN l.toxic IS NULL THEN source_version ELSE 2 END,
           CASE WHEN l.toxic IS NULL THEN source_content_hash ELSE sha256(source_content_hash || chr(31) || 'edited') END, visibility,
           CASE WHEN l.toxic IS NULL THEN canonical_text ELSE 'revised ' || canonical_text END, note_id, media_position
    FROM plain_docs p LEFT JOIN labels l ON p.document_type = 'note' AND l.doc_id + 1 = p.source_id WHERE l.toxic IS NULL OR l.toxic = 0""")
define("built_docs_r", """
    SELECT * REPLACE (project_id + 1000 * run_no AS project_id),
           sha256(concat_ws(chr(31), run_no, document_type, source_key, source_version, source_content_hash, 'evidence_parser_v1', content_hash)) AS document_key
    FROM (SELECT *, sha256('evidence_parser_v1' || chr(31) || canonical_text) AS content_hash FROM plain_docs_r)""")
define("projects_r", "SELECT p.* REPLACE (p.id + 1000 * v.r AS id) FROM projects p, (VALUES (11), (12)) v(r)")
define("access_r", """
    SELECT * REPLACE ('revised ' || query AS query, project_id + 1000 * (CASE WHEN query_id % 3 = 0 THEN 11 ELSE 12 END) AS project_id)
    FROM access WHERE query_id % 10 <> 9""")
define("dead_docs_r", """
    SELECT b.document_key FROM built_docs_r b JOIN labels l ON l.doc_id + 1 = b.source_id AND l.toxic = 1 WHERE b.document_type = 'note'
    UNION SELECT document_key FROM built_docs_r WHERE project_id > 12000 AND document_type <> 'note_comment_cluster' AND source_id % 31 = 5""")
#: The single run's relations over both runs: a project of a run is a project of its own.
RUN_RELATIONS = [
    "built_docs", "cut", "chunk_rows", "projects", "access", "toks", "scope_sizes", "scope_stats", "q_terms", "q_stats", "cand_terms", "dead_docs", "hit_rows",
    "matched", "freq", "pre_ranked", "weights", "grams", "lexical_scored",
]
for relation in RUN_RELATIONS:
    if f"{relation}_r" not in REGISTRY.shared_sql:
        define(f"{relation}_r", re.sub(rf"\b({'|'.join(RUN_RELATIONS)})\b", r"\1_r", REGISTRY.shared_sql[relation]))


@query("run_scoped_search", "R1 R3 R7", f"""
    SELECT f.query_id, 'run-' || c.project_id // 1000 AS run_id, f.chunk_key, f.rank, round(f.confidence, 6) AS confidence
    FROM ({DIVERSE_SQL.format(rows="(SELECT *, fts_score AS tie FROM lexical_scored_r)", t="0.30::DOUBLE")}) f JOIN chunk_rows_r c USING (chunk_key) WHERE f.rank <= 10""")
def run_scoped_search(spark, sf):
    session = search.IndexedSearch(scoped_cases(spark, sf), two_run_index(spark, sf), hidden_documents(spark, sf))
    rows = session.lexical_candidates(session.term_statistics())
    found = search.select_diverse(search.lexical_results(rows), C.THRESHOLDS["lexical"]).join(session.planned.select("query_id", "run_id"), "query_id")
    return found.select("query_id", "run_id", index.plain_key("chunk_key").alias("chunk_key"), F.col("rank").cast("bigint").alias("rank"), F.round("confidence", 6).alias("confidence"))


@query("index_runs", "R1", """
    SELECT 'run-' || c.run_no AS run_id, c.run_no AS dataset_version_id, c.n AS chunk_count, t.terms AS term_count, t.postings AS posting_count
    FROM (SELECT project_id // 1000 AS run_no, count(*) AS n FROM chunk_rows_r GROUP BY 1) c
    JOIN (SELECT project_id // 1000 AS run_no, count(DISTINCT (project_id, term)) AS terms, count(*) AS postings FROM toks_r GROUP BY 1) t USING (run_no)""")
def index_runs(spark, sf):
    return two_run_index(spark, sf).runs().select("run_id", "dataset_version_id", "chunk_count", "term_count", "posting_count")


# Vectors -----------------------------------------------------------------------------

define("centroids", """
    SELECT label AS query_id, list(m ORDER BY i) AS embedding FROM (
      SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1""")
define("vector_points", """
    SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS chunk_key, embedding, 1 + label % 2 AS project_id,
           CASE WHEN vec_id % 4 = 0 THEN 'project' ELSE 'public' END AS visibility,
           CASE WHEN vec_id % 5 = 0 THEN 'note_media' ELSE 'note' END AS document_type, vec_id % 3 + 1 AS media_position, vec_id % 40 AS note_id
    FROM embeddings""")


def centroids(spark, sf):
    """Query vectors: the mean vector of every label."""
    parts = model.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("embedding"))


def vector_points(spark, sf):
    v = F.col("vec_id")
    return model.table(spark, sf, "embeddings").select(
        F.lpad(v.cast("string"), 9, "0").alias("chunk_key"), "embedding", (F.lit(1) + F.col("label") % 2).cast("bigint").alias("project_id"),
        F.lit(True).alias("project_open"), F.when(v % 4 == 0, "project").otherwise("public").alias("visibility"),
        F.when(v % 5 == 0, "note_media").otherwise("note").alias("document_type"), (v % 40).alias("note_id"),
        (v % 3 + 1).cast("int").alias("media_position"))


@query("vector_topk", "R12 K8 P13", """
    SELECT query_id, chunk_key, round(s, 6) AS vector_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_key) AS vector_rank
    FROM (SELECT q.query_id, p.chunk_key, list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), q.embedding) AS s
          FROM (SELECT *, 1 + query_id % 2 AS project_id, CASE WHEN query_id % 3 = 0 THEN 'public' ELSE 'member' END AS scope FROM centroids) q
          JOIN vector_points p ON p.project_id = q.project_id
          WHERE (q.scope = 'member' OR p.visibility = 'public') AND (q.query_id % 4 <> 1 OR p.document_type = 'note')
            AND (q.query_id % 5 <> 2 OR p.media_position = 2))
    QUALIFY vector_rank <= 50""")
def vector_topk(spark, sf):
    q = F.col("query_id")
    asked = centroids(spark, sf).select(
        "query_id", "embedding", (F.lit(1) + q % 2).alias("project_id"), F.when(q % 3 == 0, "public").otherwise("member").alias("access_scope"),
        F.when(q % 4 == 1, F.array(F.lit("note"))).alias("document_types"), F.lit(None).cast("array<bigint>").alias("hints"),
        F.when(q % 5 == 2, 2).alias("preferred_position"))
    hits = vector.vector_candidates(asked, vector_points(spark, sf), 50)
    return hits.select("query_id", "chunk_key", F.round("vector_score", 6).alias("vector_score"), F.col("vector_rank").cast("bigint").alias("vector_rank"))


define("embed_terms", r"""
    SELECT key, list_transform(regexp_extract_all(lower(txt), '[\p{L}\p{Nd}]+'), lambda w: w) AS w
    FROM (SELECT chunk_key AS key, content AS txt FROM chunk_rows
          UNION ALL SELECT 'q' || query_id, 'Instruct: Given a creator-content platform question, retrieve Chinese evidence passages that answer the query' || chr(10) || 'Query: ' || query FROM access)""")
define("embed_dims", """
    SELECT key, slot, sum(sign)::DOUBLE AS x FROM (
      SELECT key, ('0x' || substr(h, 1, 2))::INTEGER % 64 AS slot, CASE WHEN ('0x' || substr(h, 3, 2))::INTEGER % 2 = 0 THEN 1 ELSE -1 END AS sign
      FROM (SELECT key, sha256(t) AS h FROM (SELECT key, unnest(w) AS t FROM embed_terms))) GROUP BY 1, 2""")
define("embed_norms", "SELECT key, sqrt(sum(x * x)) AS norm FROM embed_dims GROUP BY 1")
define("vector_scored", """
    SELECT a.query_id, c.chunk_key, c.document_key, c.note_id, s.dot / (nq.norm * nc.norm) AS score
    FROM access a JOIN chunk_rows c ON c.project_id = a.project_id JOIN projects p ON p.id = c.project_id
    JOIN (SELECT q.key AS qk, d.key AS ck, sum(q.x * d.x) AS dot FROM embed_dims q JOIN embed_dims d USING (slot)
          WHERE q.key LIKE 'q%' AND d.key NOT LIKE 'q%' GROUP BY 1, 2) s ON s.qk = 'q' || a.query_id AND s.ck = c.chunk_key
    JOIN embed_norms nq ON nq.key = s.qk JOIN embed_norms nc ON nc.key = s.ck
    WHERE c.document_type = 'note' AND c.document_key NOT IN (SELECT document_key FROM dead_docs)
      AND (a.access_scope = 'member' OR (a.access_scope = 'public' AND p.visibility = 'public' AND c.visibility = 'public'))
    QUALIFY row_number() OVER (PARTITION BY a.query_id ORDER BY round(score, 12) DESC, c.chunk_key) <= 240""")


def vector_hits(session):
    """Best chunks of documents that are not hidden; chunks become vectors where they are stored, only those are moved."""
    asked, stored = text_vectors(session.planned, session.everything)
    hits = vector.vector_candidates(vector_queries(session.planned, asked), session.shown(stored))
    return hits.withColumn("vector_score", F.round("vector_score", 12))


@query("embedding_norms", "R11", """
    SELECT key AS chunk_key, round(norm, 4) AS norm FROM embed_norms WHERE key NOT LIKE 'q%'""")
def embedding_norms(spark, sf):
    """Norms of all chunks with a word; words may cancel each other out, and the norm is 0 then."""
    chunks = ev.all_chunks(spark, sf).where(F.col("content").rlike(r"[\p{L}\p{Nd}]")).select("chunk_key", "content")
    stored = vector.embed(chunks, "chunk_key", "content", hashed_words, DIMENSION)
    squares = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return stored.where("error IS NULL").select("chunk_key", F.round(F.sqrt(squares), 4).alias("norm"))


@query("vector_search", "R11 R12 R13 R14 R17", f"""
    SELECT query_id, chunk_key, rank, round(confidence, 6) AS confidence FROM (
      {DIVERSE_SQL.format(rows="(SELECT *, 0 AS tie FROM (SELECT query_id, chunk_key, document_key, note_id, round(score, 12) AS score FROM vector_scored))", t="0.45::DOUBLE")}) WHERE rank <= 10""")
def vector_search(spark, sf):
    session = searched(spark, sf, planned_cases(spark, sf))
    rows = search.vector_results(vector_hits(session), session.everything, session.planned)
    found = search.select_diverse(rows, C.THRESHOLDS["vector"])
    return found.select("query_id", index.plain_key("chunk_key").alias("chunk_key"), F.col("rank").cast("bigint").alias("rank"), F.round("confidence", 6).alias("confidence"))


define("fused", """
    SELECT query_id, chunk_key, coalesce(l.fts_score, 0) AS fts_score, coalesce(l.trigram_score, 0) AS trigram_score,
           coalesce(v.score, 0) AS vector_score,
           coalesce(1.0::DOUBLE / (60 + l.r)::DOUBLE, 0) + coalesce(1.0::DOUBLE / (60 + v.r)::DOUBLE, 0) AS rrf
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fts_score DESC, trigram_score DESC, chunk_key) AS r FROM lexical_scored) l
    FULL OUTER JOIN (SELECT query_id, chunk_key, round(score, 12) AS score,
                            row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_key) AS r FROM vector_scored) v
    USING (query_id, chunk_key)""")
define("hybrid_scored", """
    SELECT f.query_id, f.chunk_key, c.document_key, c.note_id,
           least(1, f.rrf * 30.5::DOUBLE) * 0.45::DOUBLE + least(1, greatest(0, f.vector_score)) * 0.35::DOUBLE
             + least(1, greatest(0, v.coverage * 0.78::DOUBLE + f.fts_score / (f.fts_score + 0.25::DOUBLE) * 0.14::DOUBLE
                                    + f.trigram_score * 0.08::DOUBLE + 0.14::DOUBLE)) * 0.20::DOUBLE AS score
    FROM fused f JOIN chunk_rows c USING (chunk_key)
    JOIN (SELECT f.query_id, f.chunk_key, coalesce(list_sum(list(q.idf ORDER BY q.term_no) FILTER (WHERE q.idf IS NOT NULL)), 0) / any_value(w.total_weight) AS coverage
          FROM fused f JOIN weights w USING (query_id) LEFT JOIN (SELECT DISTINCT chunk_key, term FROM toks) t ON t.chunk_key = f.chunk_key
          LEFT JOIN q_stats q ON q.query_id = f.query_id AND q.term = t.term GROUP BY 1, 2) v USING (query_id, chunk_key)""")


@query("hybrid_search", "R15 R16 R17 W10 J11", f"""
    SELECT query_id, chunk_key, rank, round(confidence, 6) AS confidence FROM (
      {DIVERSE_SQL.format(rows="(SELECT *, 0 AS tie FROM hybrid_scored)", t="0.60::DOUBLE")}) WHERE rank <= 10""")
def hybrid_search(spark, sf):
    session = searched(spark, sf, planned_cases(spark, sf))
    stats = materialize(session.term_statistics())
    lex = materialize(session.lexical_candidates(stats, hybrid=True))
    vec = search.vector_results(vector_hits(session), session.everything, session.planned)
    rows = search.hybrid_results(lex, vec, session.planned, session.everything, stats)
    found = search.select_diverse(rows, C.THRESHOLDS["hybrid"])
    return found.select("query_id", index.plain_key("chunk_key").alias("chunk_key"), F.col("rank").cast("bigint").alias("rank"), F.round("confidence", 6).alias("confidence"))


# Vector index upkeep -------------------------------------------------------------------


def point_manifest(spark, sf):
    """Expected points in key order with their hashes; the store lost, altered and kept strays."""
    v = F.col("vec_id")
    expected = model.table(spark, sf, "embeddings").select(
        v.alias("position"), F.lpad(v.cast("string"), 9, "0").alias("chunk_key"), F.sha2(v.cast("string"), 256).alias("content_hash"))
    kept = expected.where("position % 11 <> 5").select(
        "chunk_key", F.when(F.col("position") % 13 == 7, F.lit("other")).otherwise(F.col("content_hash")).alias("content_hash"))
    strays = expected.where("position % 17 = 3").select(F.concat(F.lit("x"), "chunk_key").alias("chunk_key"), "content_hash")
    return expected, kept.unionByName(strays)


@query("vector_index_audit", "R21 J12", """
    SELECT count(*) AS expected_points,
           count(*) FILTER (WHERE vec_id % 11 <> 5) + count(*) FILTER (WHERE vec_id % 17 = 3) AS actual_points,
           count(*) FILTER (WHERE vec_id % 11 = 5) AS missing_points, count(*) FILTER (WHERE vec_id % 17 = 3) AS orphan_points,
           count(*) FILTER (WHERE vec_id % 13 = 7 AND vec_id % 11 <> 5) AS mismatched_points, false AS exact FROM embeddings""")
def vector_index_audit(spark, sf):
    return vector.audit_index(*point_manifest(spark, sf))


@query("vector_orphan_repair", "R21", "SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS chunk_key FROM embeddings WHERE vec_id % 11 <> 5")
def vector_orphan_repair(spark, sf):
    expected, actual = point_manifest(spark, sf)
    return vector.remove_orphans(actual, expected).select("chunk_key")


@query("vector_resume", "R22", """
    SELECT CAST(coalesce(min(vec_id) FILTER (WHERE vec_id % 11 = 5 OR vec_id % 13 = 7), 60) AS BIGINT) AS resume_points,
           count(*) FILTER (WHERE vec_id % 11 = 5 OR vec_id % 13 = 7) AS broken_points FROM embeddings WHERE vec_id < 60""")
def vector_resume(spark, sf):
    expected, actual = point_manifest(spark, sf)
    return vector.resume_position(expected, actual, 60)


@query("vector_rebuild_rows", "R22", """
    SELECT vec_id AS position FROM embeddings WHERE vec_id >= (SELECT min(vec_id) FROM embeddings WHERE vec_id % 11 = 5 OR vec_id % 13 = 7)""")
def vector_rebuild_rows(spark, sf):
    expected, actual = point_manifest(spark, sf)
    return vector.rows_to_rebuild(expected, vector.resume_position(expected, actual, 60)).select("position")


@query("vector_index_state", "A27", """
    SELECT o_orderstatus AS status, count(*) AS build_count, max(greatest(o_orderkey % 97 - o_custkey % 89, 0)) AS checkpoint_lag,
           CAST(max(epoch(TIMESTAMP '2002-01-01') - epoch(o_orderdate)) AS BIGINT) AS oldest_update_age FROM orders GROUP BY 1""")
def vector_index_state(spark, sf):
    builds = model.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 97).alias("chunk_count"), (F.col("o_custkey") % 89).alias("checkpoint_points"),
        F.col("o_orderdate").alias("updated_at"))
    return vector.index_state(builds, F.to_timestamp(F.lit("2002-01-01")))
