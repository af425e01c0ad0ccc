"""Distribution, corpus and request reports, contract checks, retention and lineage audits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillspark.functions import contract as C
from quillspark.operators import lineage, ordering, quality
from quillspark.plans.registry import REGISTRY
from quillspark.sources import model

query, define = REGISTRY.query, REGISTRY.define


@query("event_distribution", "A20", """
    SELECT 'total' AS dimension, '' AS label, count(*) AS events FROM behavior UNION ALL
    SELECT 'event_type', event_type, count(*) FROM behavior GROUP BY 2 UNION ALL
    SELECT 'project_id', CAST(project_id AS VARCHAR), count(*) FROM behavior GROUP BY 2""")
def event_distribution(spark, sf):
    return quality.distribution(model.behavior(spark, sf), ["event_type", "project_id"])


define("note_activity", "SELECT note_id, count(*) AS n FROM behavior WHERE note_id IS NOT NULL GROUP BY 1")
define("user_activity", "SELECT user_id, count(*) AS n FROM behavior GROUP BY 1")
SHARE_SQL = """SELECT round(sum(n) FILTER (WHERE rn <= greatest(1, ceil(total * {f}))) / sum(n)::DOUBLE, 4)
    FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS rn, count(*) OVER () AS total FROM {t})"""


def population(rows, key):
    return rows.where(F.col(key).isNotNull()).agg(F.count_distinct(key).alias("size"))


@query("note_concentration", "A21", f"SELECT ({SHARE_SQL.format(f='0.01', t='note_activity')}) AS share")
def note_concentration(spark, sf):
    events = model.behavior(spark, sf)
    return quality.top_share(events, "note_id", population(events, "note_id"), 0.01)


@query("user_concentration", "A21", f"SELECT ({SHARE_SQL.format(f='0.10', t='user_activity')}) AS share")
def user_concentration(spark, sf):
    events = model.behavior(spark, sf)
    return quality.top_share(events, "user_id", population(events, "user_id"), 0.10)


define("session_stats", """
    SELECT round(sum(n) / count(*), 4) AS average_events, round(sum(b) / sum(n)::DOUBLE, 4) AS burst_ratio,
           quantile_disc(n, 0.5) AS p50_events, quantile_disc(n, 0.95) AS p95_events
    FROM (SELECT session_id, count(*) AS n, count(*) FILTER (WHERE value > 60) AS b FROM behavior GROUP BY 1)""")


@query("session_lengths", "A22 A14", "SELECT * FROM session_stats")
def session_lengths(spark, sf):
    return quality.session_lengths(model.behavior(spark, sf), F.col("value") > 60)


@query("distribution_gates", "A23", f"""
    WITH r AS (SELECT s.*, ({SHARE_SQL.format(f="0.01", t="note_activity")}) AS note_share, ({SHARE_SQL.format(f="0.10", t="user_activity")}) AS user_share,
                      (SELECT count(DISTINCT event_type) FROM behavior) AS kinds, (SELECT count(DISTINCT project_id) FROM behavior) AS personas FROM session_stats s)
    SELECT 'multi_step_sessions' AS name, average_events AS value, '>= 2.0' AS target, average_events >= 2 AS passed FROM r UNION ALL
    SELECT 'zipf_note_concentration', note_share, '0.08 to 0.80', note_share BETWEEN 0.08 AND 0.80 FROM r UNION ALL
    SELECT 'active_user_concentration', user_share, '0.20 to 0.80', user_share BETWEEN 0.20 AND 0.80 FROM r UNION ALL
    SELECT 'persona_diversity', CAST(personas AS DOUBLE), '>= 6', personas >= 6 FROM r UNION ALL
    SELECT 'event_type_diversity', CAST(kinds AS DOUBLE), '>= 8', kinds >= 8 FROM r UNION ALL
    SELECT 'burst_visibility', burst_ratio, '>= 0.13', burst_ratio >= 0.13 FROM r""")
def distribution_gates(spark, sf):
    events = model.behavior(spark, sf)
    with_row = ordering.with_row
    report = quality.session_lengths(events, F.col("value") > 60)
    report = with_row(report, quality.top_share(events, "note_id", population(events, "note_id"), 0.01).withColumnRenamed("share", "note_share"))
    report = with_row(report, quality.top_share(events, "user_id", population(events, "user_id"), 0.10).withColumnRenamed("share", "user_share"))
    report = with_row(report, events.agg(F.count_distinct("event_type").alias("event_types"), F.count_distinct("project_id").alias("personas")))
    return quality.distribution_gates(report, organic=False, burst_fraction=0.2)


@query("session_transitions", "W7", """
    SELECT transition, count(*) AS events FROM (
      SELECT coalesce(lag(event_type) OVER (PARTITION BY session_id ORDER BY occurred_at, event_id), 'start') || '->' || event_type AS transition
      FROM behavior) GROUP BY 1""")
def session_transitions(spark, sf):
    return quality.transitions(model.behavior(spark, sf))


@query("session_sequences", "W8", """
    WITH s AS (SELECT session_id, event_id, event_type, row_number() OVER (PARTITION BY session_id ORDER BY occurred_at, event_id)
                      + CASE WHEN user_id % 10 = 3 THEN 1 ELSE 0 END AS no FROM behavior),
    kept AS (SELECT * FROM s WHERE NOT (no = 2 AND event_id % 4 = 0)),
    g AS (SELECT session_id, min(no) AS low, max(no) AS high, count(*) AS n, arg_min(event_type, no) AS first_type FROM kept GROUP BY 1)
    SELECT session_id, 'does_not_start_at_one' AS violation FROM g WHERE low <> 1 UNION ALL
    SELECT session_id, 'not_contiguous' FROM g WHERE high - low + 1 <> n UNION ALL
    SELECT session_id, 'wrong_first_event' FROM g WHERE first_type NOT IN ('note_viewed', 'media_viewed', 'note_created', 'note_collected')""")
def session_sequences(spark, sf):
    """Numbered sessions where some start late and some lost their second event."""
    rows = model.behavior(spark, sf).select("session_id", "occurred_at", "event_id", "event_type", "user_id", "source_event_id")
    numbered = ordering.running(rows, ["session_id"], ["occurred_at", "event_id"], "sequence_no").withColumn(
        "sequence_no", F.col("sequence_no") + F.when(F.col("user_id") % 10 == 3, 1).otherwise(0))
    kept = numbered.where("NOT (sequence_no = 2 AND event_id % 4 = 0)")
    return quality.sequence_violations(kept, ["note_viewed", "media_viewed", "note_created", "note_collected"])


CASE_TASKS = ["fact", "summary", "compare", "source", "privacy", "time", "typo", "none"]
TASK_SQL = "CASE item_id % 8 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(CASE_TASKS)) + " END"
define("corpus_row", f"""
    SELECT n.*, m.*, c.*, e.* FROM
      (SELECT count(*) AS notes, count(DISTINCT category) AS categories, round(count(DISTINCT title) / count(*), 4) AS unique_title_ratio,
              min(length(body)) AS minimum_body, round(avg(length(body)), 4) AS average_body FROM corpus_notes) n,
      (SELECT count(*) AS media, min(length(ocr_text)) AS minimum_ocr FROM media) m,
      (SELECT count(*) AS comments, round((count(*) - count(DISTINCT content)) / count(*), 4) AS duplicate_comment_ratio, min(length(content)) AS minimum_comment,
              round(avg(CASE WHEN (subject <> '' AND contains(content, subject)) OR len(list_filter(phrases, lambda p: contains(content, p))) > 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS semantic_alignment_ratio
       FROM comments LEFT JOIN corpus_notes USING (note_id)) c,
      (SELECT count(*) AS eval_cases, count(DISTINCT {TASK_SQL}) AS eval_tasks FROM benchmark) e""")
define("corpus_notes", r"""SELECT id AS note_id, category, split_part(body, chr(10), 1) AS title, body, regexp_extract(body, '^\p{L}+') AS subject,
    regexp_extract_all(body, '\p{L}{6,}')[1:6] AS phrases FROM docs""")


def corpus_parts(spark, sf):
    """Notes whose first long words stand for topics, praise and concerns; media; comments; cases."""
    long_words = F.regexp_extract_all("body", F.lit(r"\p{L}{6,}"), 0)
    notes = model.documents(spark, sf).select(
        F.col("id").alias("note_id"), "category", F.substring_index("body", "\n", 1).alias("title"), "body", F.regexp_extract("body", r"^\p{L}+", 0).alias("subject"),
        F.slice(long_words, 1, 2).alias("topics"), F.slice(long_words, 3, 2).alias("praise"), F.slice(long_words, 5, 2).alias("concerns"))
    cases = model.table(spark, sf, "benchmark").select(F.expr(TASK_SQL).alias("task_type"))
    return notes, model.media(spark, sf), model.comments(spark, sf).select("note_id", "content", "intent", "sentiment"), cases


def corpus(spark, sf):
    return quality.corpus_report(*corpus_parts(spark, sf))


@query("corpus_report", "A24", "SELECT * FROM corpus_row")
def corpus_report(spark, sf):
    return corpus(spark, sf)


@query("corpus_counts", "A24", f"""
    SELECT 'category' AS kind, category AS value, count(*) AS rows FROM docs GROUP BY 2 UNION ALL
    SELECT 'intent', intent, count(*) FROM comments GROUP BY 2 UNION ALL SELECT 'sentiment', sentiment, count(*) FROM comments GROUP BY 2 UNION ALL
    SELECT 'task', {TASK_SQL}, count(*) FROM benchmark GROUP BY 2""")
def corpus_counts(spark, sf):
    notes, _, comments, cases = corpus_parts(spark, sf)
    return quality.corpus_counts(notes, comments, cases)


@query("corpus_gates", "A25", """
    SELECT name, value, target, passed FROM (
      SELECT 'category_diversity' AS name, CAST(categories AS DOUBLE) AS value, '>= 4' AS target, categories >= 4 AS passed FROM corpus_row UNION ALL
      SELECT 'unique_titles', unique_title_ratio, '>= 0.98', unique_title_ratio >= 0.98 FROM corpus_row UNION ALL
      SELECT 'substantive_note_body', minimum_body, '>= 300 characters', minimum_body >= 300 FROM corpus_row UNION ALL
      SELECT 'substantive_media_ocr', minimum_ocr, '>= 30 characters', minimum_ocr >= 30 FROM corpus_row UNION ALL
      SELECT 'substantive_comments', minimum_comment, '>= 35 characters', minimum_comment >= 35 FROM corpus_row UNION ALL
      SELECT 'low_comment_duplication', duplicate_comment_ratio, '<= 0.01', duplicate_comment_ratio <= 0.01 FROM corpus_row UNION ALL
      SELECT 'semantic_alignment', semantic_alignment_ratio, '>= 0.98', semantic_alignment_ratio >= 0.98 FROM corpus_row UNION ALL
      SELECT 'eval_task_diversity', eval_tasks, '>= 8', eval_tasks >= 8 FROM corpus_row)""")
def corpus_gates(spark, sf):
    return quality.corpus_gates(corpus(spark, sf), 4, 10)


@query("request_summary", "A32", """
    SELECT l_returnflag AS mode, l_linestatus AS band, count(*) AS requests, round(avg((l_discount > 0.095)::INTEGER), 4) AS error_rate,
           round(avg((l_tax > 0.075)::INTEGER), 4) AS timeout_rate, round(avg((l_quantity > 48)::INTEGER), 4) AS rate_limited_rate,
           round(avg((l_linenumber = 7)::INTEGER), 4) AS invalid_citation_rate, quantile_disc(l_extendedprice, 0.95) AS p95_latency_ms
    FROM lineitem GROUP BY 1, 2""")
def request_summary(spark, sf):
    log = model.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("band"), (F.col("l_discount") > 0.095).alias("error"),
        (F.col("l_tax") > 0.075).alias("timeout"), (F.col("l_quantity") > 48).alias("rate_limited"), (F.col("l_linenumber") == 7).alias("invalid_citation"),
        F.col("l_extendedprice").alias("latency_ms"))
    return quality.request_summary(log, ["mode", "band"])


@query("contract_violations", "P8", """
    SELECT 'like_ratio' AS violation, count(*) AS rows FROM orders WHERE NOT (o_totalprice / 400000 <= 1) UNION ALL
    SELECT 'status', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL
    SELECT 'title_length', count(*) FROM orders WHERE length(o_orderpriority) > 8""")
def contract_violations(spark, sf):
    rules = {
        "status": F.col("o_orderstatus").isin("F", "O"), "like_ratio": (F.col("o_totalprice") / 400000).between(0, 1),
        "title_length": F.char_length("o_orderpriority") <= 8, "author": F.col("o_custkey") >= 0}
    return quality.violation_counts(quality.violations(model.table(spark, sf, "orders"), "o_orderkey", rules))


NOW = dt.datetime(2001, 8, 1)


def sessions(spark, sf):
    """Orders as login sessions of sixty days; low priority means revoked."""
    return model.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("session_id"), (F.col("o_orderpriority") == "5-LOW").alias("revoked"),
        (F.col("o_orderdate") + F.expr("INTERVAL 60 DAY")).alias("expires_at"), F.col("o_orderdate").alias("updated_at"))


@query("session_purge", "S12", """
    SELECT o_orderkey AS session_id FROM orders
    WHERE NOT ((o_orderpriority = '5-LOW' OR o_orderdate + INTERVAL 60 DAY < TIMESTAMP '2001-08-01') AND o_orderdate < TIMESTAMP '2001-07-02')""")
def session_purge(spark, sf):
    old = F.col("updated_at") < F.lit(NOW - dt.timedelta(days=30))
    return quality.purge(sessions(spark, sf), quality.dead_session(F.lit(NOW)) & old).select("session_id")


@query("retention_preview", "S12", """
    SELECT 'outbox' AS target, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '2001-07-25') AS expired FROM orders UNION ALL
    SELECT 'processed', count(*), count(*) FILTER (WHERE l_shipdate < TIMESTAMP '2001-07-02') FROM lineitem UNION ALL
    SELECT 'sessions', count(*), count(*) FILTER (WHERE (o_orderpriority = '5-LOW' OR o_orderdate + INTERVAL 60 DAY < TIMESTAMP '2001-08-01') AND o_orderdate < TIMESTAMP '2001-07-02') FROM orders""")
def retention_preview(spark, sf):
    week, month = F.lit(NOW - dt.timedelta(days=7)), F.lit(NOW - dt.timedelta(days=30))
    return quality.expired({
        "outbox": (model.table(spark, sf, "orders"), (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < week)),
        "processed": (model.table(spark, sf, "lineitem"), F.col("l_shipdate") < month),
        "sessions": (sessions(spark, sf), quality.dead_session(F.lit(NOW)) & (F.col("updated_at") < month))})


@query("retention_purge", "S12", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '2001-07-25')")
def retention_purge(spark, sf):
    expired = (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit(NOW - dt.timedelta(days=7)))
    return quality.purge(model.table(spark, sf, "orders"), expired).select("o_orderkey")


@query("cleaned_rows", "F29 F30", """
    SELECT s_suppkey, trim(s_name) AS title, lower(trim(s_name)) AS category, CASE WHEN s_suppkey % 3 = 0 THEN 'public' ELSE 'project' END AS visibility,
           CASE WHEN s_suppkey % 2 = 0 THEN 'unknown' ELSE s_name END AS body, ['supplier', 'nation ' || s_nationkey] AS tags FROM supplier""")
def cleaned_rows(spark, sf):
    key = F.col("s_suppkey")
    raw = model.table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit("  "), "s_name", F.lit(" ")).alias("title"), F.concat("s_name", F.lit(" ")).alias("category"),
        F.when(key % 3 == 0, F.lit(" ")).otherwise("project").alias("visibility"),
        F.when(key % 2 == 0, F.when(key % 4 == 0, F.lit(""))).otherwise(F.col("s_name")).alias("body"),
        F.array(F.lit(" Supplier"), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")), F.lit("SUPPLIER"), F.lit(" ")).alias("tags"))
    return quality.clean_notes(quality.backfill(raw, {"body": "unknown"}))


def raw_notes(spark, sf):
    """Suppliers as notes sent in: some without author, title or category, some too long, with media that lack types and places."""
    key = F.col("s_suppkey")
    media = F.array(
        F.struct(F.lit(" VIDEO ").alias("media_type"), F.concat(F.lit(" u"), key.cast("string")).alias("url"), F.lit(" c ").alias("caption"), F.lit("").alias("ocr_text"), F.lit(7).alias("position")),
        F.struct(F.lit(" ").alias("media_type"), F.repeat(F.lit("x"), F.when(key % 11 == 4, 600).otherwise(5)).alias("url"), F.lit("").alias("caption"), F.lit(" o ").alias("ocr_text"), F.lit(0).alias("position")))
    return model.table(spark, sf, "supplier").select(
        "s_suppkey", (key % 9).alias("author_id"), F.when(key % 5 == 0, 0).otherwise(key % 4 + 1).alias("project_id"),
        F.when(key % 7 == 2, F.lit("  ")).otherwise(F.concat(F.lit(" "), "s_name")).alias("title"), F.repeat(F.lit("é"), F.when(key % 13 == 1, 10001).otherwise(9)).alias("body"),
        F.when(key % 6 == 1, F.lit(None)).otherwise(F.lit(" News ")).alias("category"), F.when(key % 8 == 3, F.lit("secret")).otherwise(F.lit("")).alias("visibility"),
        F.array().cast("array<string>").alias("tags"), media.alias("media"))


@query("cleaned_media", "F30", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE s_suppkey % 4 + 1 END AS project_id, CAST(place AS INTEGER) AS position,
           CASE WHEN place = 7 THEN 'video' ELSE 'image' END AS media_type,
           CASE WHEN place = 7 THEN 'u' || s_suppkey WHEN s_suppkey % 11 = 4 THEN repeat('x', 600) ELSE 'xxxxx' END AS url FROM supplier, (VALUES (7), (2)) v(place)""")
def cleaned_media(spark, sf):
    return quality.clean_notes(raw_notes(spark, sf)).select("s_suppkey", "project_id", F.inline("media")).select("s_suppkey", "project_id", "position", "media_type", "url")


@query("note_input_violations", "F30 P8", """
    SELECT s_suppkey, unnest(list_filter([
      CASE WHEN s_suppkey % 9 = 0 THEN 'author_id' END, CASE WHEN s_suppkey % 8 = 3 THEN 'visibility' END, CASE WHEN s_suppkey % 7 = 2 THEN 'title_required' END,
      CASE WHEN s_suppkey % 13 = 1 THEN 'body_length' END, CASE WHEN s_suppkey % 6 = 1 THEN 'category_required' END, CASE WHEN s_suppkey % 11 = 4 THEN 'media_url_length' END],
      lambda v: v IS NOT NULL)) AS violation FROM supplier""")
def note_input_violations(spark, sf):
    return quality.violations(quality.clean_notes(raw_notes(spark, sf)), "s_suppkey", quality.note_rules(with_media=True))


# Lineage -----------------------------------------------------------------------------


def runs(spark, sf):
    return model.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), (F.lit(1) + F.col("o_custkey") % 5).alias("project_id"), (F.col("o_orderkey") % 50).alias("ingestion_run_id"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'failed' ELSE 'cancelled' END").alias("status"))


def claims(spark, sf):
    return model.table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("claim_id"),
        F.col("l_orderkey").alias("run_id"), F.when(F.col("l_linestatus") == "O", "supported").otherwise("unsupported").alias("support_status"),
        F.when(F.col("l_returnflag") == "R", "supports").otherwise("context").alias("relationship"), F.col("l_partkey").alias("citation_id"))


@query("unsupported_claims", "L1", """
    WITH c AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS claim_id, l_orderkey AS run_id, l_linestatus, l_returnflag FROM lineitem)
    SELECT run_id, count(*) AS unsupported_claims FROM c WHERE run_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
      AND (l_linestatus <> 'O' OR claim_id NOT IN (SELECT claim_id FROM c WHERE l_returnflag = 'R')) GROUP BY 1""")
def unsupported_claims(spark, sf):
    rows = claims(spark, sf)
    return lineage.unsupported_claims(runs(spark, sf), rows, rows)


@query("citation_scope", "L2", """
    WITH cc AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS claim_id, l_orderkey AS run_id, l_partkey AS citation_id FROM lineitem),
    x AS (SELECT cc.*, 1 + o.o_custkey % 5 AS run_project, o.o_orderkey % 50 AS ingestion, p.p_partkey, 1 + p.p_size % 5 AS project_id, p.p_size AS doc, p.p_partkey % 100 = 7 AS stale
          FROM cc JOIN orders o ON o.o_orderkey = cc.run_id LEFT JOIN part p ON p.p_partkey = cc.citation_id AND p.p_partkey % 20 <> 0)
    SELECT claim_id, citation_id, 'unknown_citation' AS violation FROM x WHERE p_partkey IS NULL UNION ALL
    SELECT claim_id, citation_id, 'out_of_scope' FROM x WHERE p_partkey IS NOT NULL AND (project_id <> run_project OR doc > ingestion) UNION ALL
    SELECT claim_id, citation_id, 'stale_quote' FROM x WHERE p_partkey IS NOT NULL AND stale""")
def citation_scope(spark, sf):
    """Run n links documents 0..n of the size column; some citations are unknown or changed."""
    part = model.table(spark, sf, "part")
    citations = part.where("p_partkey % 20 <> 0").select(
        F.col("p_partkey").alias("citation_id"), (F.lit(1) + F.col("p_size") % 5).cast("bigint").alias("project_id"), F.col("p_size").cast("string").alias("document_key"),
        F.when(F.col("p_partkey") % 100 == 7, "changed").otherwise("same").alias("quote_hash"))
    ingestion = runs(spark, sf).select("ingestion_run_id").distinct()
    linked = ingestion.select("ingestion_run_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "ingestion_run_id")).alias("n")).select(
        "ingestion_run_id", F.col("n").cast("string").alias("document_key"))
    rows = claims(spark, sf).select("claim_id", "run_id", "citation_id").distinct()
    cc = rows.select("claim_id", "citation_id", F.lit("same").alias("quote_hash_snapshot"))
    return lineage.citation_scope_violations(cc, rows, runs(spark, sf), citations, linked)


@query("budget_overruns", "L3", """
    SELECT run_id, budget FROM (SELECT l_orderkey AS run_id, count(*) > 5 AS c, sum(CAST(l_quantity AS BIGINT)) > 150 AS t FROM lineitem GROUP BY 1),
      (VALUES ('steps'), ('tokens')) b(budget) WHERE (budget = 'steps' AND c) OR (budget = 'tokens' AND t)""")
def budget_overruns(spark, sf):
    used = model.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.count("*").alias("used_steps"), F.sum(F.col("l_quantity").cast("bigint")).alias("used_tokens"))
    return lineage.budget_overruns(used.withColumn("max_steps", F.lit(5)).withColumn("max_tokens", F.lit(150)), ["steps", "tokens"])


@query("invalid_transitions", "L4", """
    SELECT custkey, step, previous, status FROM (
      SELECT o_custkey AS custkey, s AS status, row_number() OVER w AS step, lag(s) OVER w AS previous
      FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS s FROM orders)
      WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    WHERE previous IS NOT NULL AND previous <> status AND NOT (previous = 'queued' AND status = 'running') AND NOT (previous = 'running' AND status = 'succeeded')""")
def invalid_transitions(spark, sf):
    history = model.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("custkey"), "o_orderdate", "o_orderkey",
        F.expr("CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END").alias("status"))
    return lineage.invalid_transitions(history, ["custkey"], ["o_orderdate", "o_orderkey"])


@query("idempotency_conflicts", "L6", """
    SELECT o_custkey AS requester, o_orderpriority AS idempotency_key, count(DISTINCT o_orderstatus) AS hashes FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderstatus) > 1""")
def idempotency_conflicts(spark, sf):
    return lineage.idempotency_conflicts(model.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("requester"), F.col("o_orderpriority").alias("idempotency_key"), F.col("o_orderstatus").alias("request_hash")))
