"""Facts, counters, rankings and listings over the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillspark.operators import counters, facts, listing, merge, rankings
from quillspark.plans.registry import REGISTRY
from quillspark.sources import model

query = REGISTRY.query

START, END = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 29)
WINDOW_SQL = "occurred_at >= TIMESTAMP '2024-01-02' AND occurred_at < TIMESTAMP '2024-01-29'"
VIEWER = 7

NOTE_FACT_SQL = """
    SELECT project_id, note_id, CAST(occurred_at AS DATE) AS fact_date,
           count(*) FILTER (WHERE event_type IN ('note_viewed', 'media_viewed')) AS view_count,
           count(*) FILTER (WHERE event_type = 'note_liked') AS like_count,
           count(*) FILTER (WHERE event_type = 'note_collected') AS collect_count,
           count(*) FILTER (WHERE event_type = 'comment_created') AS comment_count,
           count(*) FILTER (WHERE event_type = 'note_shared') AS share_count,
           count(DISTINCT user_id) AS unique_user_count, count(*) AS event_count
    FROM behavior WHERE note_id IS NOT NULL AND {window} GROUP BY 1, 2, 3"""
REGISTRY.define("note_facts", NOTE_FACT_SQL.format(window=WINDOW_SQL))
REGISTRY.define("rebuilt_notes", """
    SELECT n.* EXCLUDE (like_count, collect_count, comment_count, share_count),
           coalesce(i.likes, 0) AS like_count, coalesce(i.collects, 0) AS collect_count,
           coalesce(i.live, 0) AS comment_count, coalesce(i.shares, 0) AS share_count,
           CAST(n.view_count + 3 * coalesce(i.likes, 0) + 8 * coalesce(i.collects, 0)
                + 6 * coalesce(i.live, 0) + 5 * coalesce(i.shares, 0) AS DOUBLE) AS hot_score
    FROM notes n LEFT JOIN (
        SELECT note_id, count(*) FILTER (WHERE kind = 'like') AS likes,
               count(*) FILTER (WHERE kind = 'collect') AS collects,
               count(*) FILTER (WHERE kind = 'comment' AND status = 1) AS live,
               count(*) FILTER (WHERE kind = 'share') AS shares
        FROM interactions GROUP BY note_id) i ON i.note_id = n.id""")
REGISTRY.define("rebuilt_comments", """
    SELECT c.*, (SELECT count(*) FROM comment_likes l WHERE l.comment_id = c.id) AS like_count,
           (SELECT count(*) FROM comments r WHERE r.parent_id = c.id AND r.status = 1) AS reply_count
    FROM comments c""")


@query("note_daily_facts", "A1 P6 S1", "SELECT * FROM note_facts")
def note_daily_facts(spark, sf):
    return facts.note_daily_facts(model.behavior(spark, sf), START, END)


REGISTRY.define("user_facts", f"""
    SELECT project_id, user_id, CAST(occurred_at AS DATE) AS fact_date,
           count(*) FILTER (WHERE event_type IN ('note_viewed', 'media_viewed', 'comments_viewed')) AS view_count,
           count(*) FILTER (WHERE event_type IN ('note_liked', 'note_unliked', 'note_collected',
               'note_uncollected', 'note_shared', 'comment_liked', 'comment_unliked')) AS interaction_count,
           count(*) FILTER (WHERE event_type = 'note_created') AS content_count,
           count(*) FILTER (WHERE event_type = 'comment_created') AS comment_count,
           count(DISTINCT note_id) AS active_note_count, count(*) AS event_count
    FROM behavior WHERE {WINDOW_SQL} GROUP BY 1, 2, 3""")


@query("user_daily_facts", "A2 P6", "SELECT * FROM user_facts")
def user_daily_facts(spark, sf):
    return facts.user_daily_facts(model.behavior(spark, sf), START, END)


@query("fact_upsert", "S10 S9 V8", """
    SELECT project_id, note_id, fact_date, event_count, origin FROM (
      SELECT project_id, note_id, CAST(occurred_at AS DATE) AS fact_date, count(*) AS event_count, 'first' AS origin
      FROM behavior WHERE note_id IS NOT NULL AND occurred_at >= TIMESTAMP '2024-01-02'
        AND occurred_at < TIMESTAMP '2024-01-16' GROUP BY 1, 2, 3)
    UNION ALL
    SELECT project_id, note_id, CAST(occurred_at AS DATE), count(*), 'second'
    FROM behavior WHERE note_id IS NOT NULL AND occurred_at >= TIMESTAMP '2024-01-16'
      AND occurred_at < TIMESTAMP '2024-01-29' GROUP BY 1, 2, 3""")
def fact_upsert(spark, sf):
    """Two materialization runs whose windows overlap; the later one replaces its days."""
    events = model.behavior(spark, sf)
    columns = [*facts.NOTE_FACT_KEYS, "event_count"]
    first = facts.note_daily_facts(events, START, dt.datetime(2024, 1, 22)).select(*columns).withColumn("origin", F.lit("first"))
    second = facts.note_daily_facts(events, dt.datetime(2024, 1, 16), END).select(*columns).withColumn("origin", F.lit("second"))
    return merge.replace_by_key(first, second, facts.NOTE_FACT_KEYS)


@query("event_type_rename", "F10 A8", """
    SELECT event_type, count(*) AS row_count FROM (
      SELECT CASE kind WHEN 'like' THEN 'note_liked' WHEN 'collect' THEN 'note_collected'
                  WHEN 'share' THEN 'note_shared' ELSE 'note.other' END AS event_type FROM interactions)
    GROUP BY 1""")
def event_type_rename(spark, sf):
    named = model.interactions(spark, sf).select(
        facts.behavior_event_type(
            F.expr("CASE kind WHEN 'like' THEN 'note.liked' WHEN 'collect' THEN 'note.collected' "
                   "WHEN 'share' THEN 'note.shared' ELSE 'note.other' END")
        ).alias("event_type")
    )
    return counters.status_histogram(named, "event_type")


@query("note_counters", "A3 A5 J2", """
    SELECT id, view_count, like_count, collect_count, comment_count, share_count, hot_score FROM rebuilt_notes""")
def note_counters(spark, sf):
    rebuilt = counters.rebuild_note_counters(model.notes(spark, sf), model.interactions(spark, sf))
    return rebuilt.select("id", "view_count", *counters.NOTE_COUNTERS, "hot_score")


@query("comment_counters", "A4", "SELECT id, note_id, like_count, reply_count FROM rebuilt_comments")
def comment_counters(spark, sf):
    rebuilt = counters.rebuild_comment_counters(model.comments(spark, sf), model.note_like_events(spark, sf))
    return rebuilt.select("id", "note_id", "like_count", "reply_count")


@query("counter_drift", "A6 P5", """
    SELECT n.id, n.like_count AS stored_like_count, n.collect_count AS stored_collect_count,
           n.comment_count AS stored_comment_count, n.share_count AS stored_share_count,
           r.like_count AS actual_like_count, r.collect_count AS actual_collect_count,
           r.comment_count AS actual_comment_count, r.share_count AS actual_share_count
    FROM notes n JOIN rebuilt_notes r ON r.id = n.id
    WHERE (n.like_count, n.collect_count, n.comment_count, n.share_count)
          IS DISTINCT FROM (r.like_count, r.collect_count, r.comment_count, r.share_count)""")
def counter_drift(spark, sf):
    notes = model.notes(spark, sf)
    rebuilt = counters.rebuild_note_counters(notes, model.interactions(spark, sf))
    return counters.counter_drift(notes, rebuilt, counters.NOTE_COUNTERS)


@query("counter_consistency", "A26", """
    SELECT count(*) AS checked_count,
           count(*) FILTER (WHERE n.comment_count IS DISTINCT FROM r.comment_count) AS inconsistent_count
    FROM notes n JOIN rebuilt_notes r ON r.id = n.id""")
def counter_consistency(spark, sf):
    notes = model.notes(spark, sf)
    rebuilt = counters.rebuild_note_counters(notes, model.interactions(spark, sf))
    both = notes.select("id", F.col("comment_count").alias("stored")).join(
        rebuilt.select("id", F.col("comment_count").alias("actual")), "id"
    )
    return both.agg(
        F.count("*").alias("checked_count"),
        F.count_if(~F.col("stored").eqNullSafe(F.col("actual"))).alias("inconsistent_count"),
    )


@query("repair_batch_wraps", "A7", """
    SELECT id FROM (SELECT id FROM notes WHERE id > (SELECT max(id) FROM notes)
                    UNION ALL SELECT id FROM notes) ORDER BY id LIMIT 1000""")
def repair_batch_wraps(spark, sf):
    """A cursor past the last id starts again from the lowest one."""
    return counters.repair_batch(model.notes(spark, sf), 1 << 60, 1000)


@query("repair_batch_next", "A7", "SELECT id FROM notes WHERE id > 400 ORDER BY id LIMIT 1000")
def repair_batch_next(spark, sf):
    return counters.repair_batch(model.notes(spark, sf), 400, 1000)


@query("outbox_monitor", "A8 A9", """
    SELECT CAST(greatest(0, epoch(TIMESTAMP '2001-09-01') - epoch(min(o_orderdate))) AS BIGINT) AS oldest_age_seconds,
           count(*) AS unsent_count FROM orders WHERE o_orderstatus <> 'F'""")
def outbox_monitor(spark, sf):
    outbox = model.table(spark, sf, "orders").select(
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'O' THEN 'pending' ELSE 'retry' END").alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )
    return counters.oldest_unsent_age(outbox, F.lit(dt.datetime(2001, 9, 1)))


@query("checkpoint_backfill", "A33", """
    SELECT p.id AS run_id, coalesce(max(d.id), 0) AS checkpoint_chunk_id, count(d.id) AS checkpoint_points
    FROM projects p LEFT JOIN docs d ON d.project_id = p.id GROUP BY 1""")
def checkpoint_backfill(spark, sf):
    runs = model.projects(spark, sf).select(F.col("id").alias("run_id"))
    chunks = model.documents(spark, sf).select(F.col("project_id").alias("run_id"), F.col("id").alias("chunk_id"))
    return counters.checkpoint_backfill(runs, chunks)


@query("table_count_delta", "U7", """
    SELECT 'notes' AS label, count(*) FILTER (WHERE created_at < TIMESTAMP '1999-01-01') AS before_count,
           count(*) AS after_count, count(*) FILTER (WHERE created_at >= TIMESTAMP '1999-01-01') AS delta FROM notes
    UNION ALL
    SELECT 'interactions', count(*) FILTER (WHERE created_at < TIMESTAMP '1999-01-01'), count(*),
           count(*) FILTER (WHERE created_at >= TIMESTAMP '1999-01-01') FROM interactions
    UNION ALL
    SELECT 'behavior', count(*) FILTER (WHERE occurred_at < TIMESTAMP '1999-01-01'), count(*),
           count(*) FILTER (WHERE occurred_at >= TIMESTAMP '1999-01-01') FROM behavior""")
def table_count_delta(spark, sf):
    parts = {
        "notes": model.notes(spark, sf),
        "interactions": model.interactions(spark, sf),
        "behavior": model.behavior(spark, sf).withColumnRenamed("occurred_at", "created_at"),
    }
    cut = F.lit(dt.datetime(1999, 1, 1))
    before = {label: part.where(F.col("created_at") < cut) for label, part in parts.items()}
    return counters.count_delta(counters.table_counts(before), counters.table_counts(parts))


@query("note_rankings", "W1 K4 U1 T6", """
    WITH ranked AS (
      SELECT id, category, hot_score AS score,
             row_number() OVER (PARTITION BY category ORDER BY hot_score DESC, id DESC) AS rn
      FROM rebuilt_notes WHERE status = 'published')
    SELECT * FROM (SELECT id, category, score, 'global' AS scope FROM ranked ORDER BY score DESC, id DESC LIMIT 50)
    UNION ALL SELECT id, category, score, 'category' FROM ranked WHERE rn <= 50""")
def note_rankings(spark, sf):
    rebuilt = counters.rebuild_note_counters(model.notes(spark, sf), model.interactions(spark, sf))
    return rankings.note_rankings(rebuilt, 50)


@query("comment_rankings", "W2", """
    SELECT id, note_id, CAST(like_count * 5 AS DOUBLE) AS score FROM (
      SELECT c.*, row_number() OVER (PARTITION BY c.note_id ORDER BY like_count DESC, c.id DESC) AS rn
      FROM rebuilt_comments c JOIN docs d ON d.id = c.note_id AND d.status = 'published' WHERE c.status = 1)
    WHERE rn <= 3""")
def comment_rankings(spark, sf):
    rebuilt = counters.rebuild_comment_counters(model.comments(spark, sf), model.note_like_events(spark, sf))
    return rankings.comment_rankings(rebuilt, model.documents(spark, sf), 3)


@query("comment_sample", "W3", """
    SELECT note_id, id, position FROM (
      SELECT c.note_id, c.id, row_number() OVER (PARTITION BY c.note_id ORDER BY like_count DESC, c.id DESC) AS position
      FROM rebuilt_comments c
      WHERE c.status = 1 AND c.note_id IN (SELECT id FROM docs WHERE status = 'published' ORDER BY id LIMIT 40))
    WHERE position <= 2""")
def comment_sample(spark, sf):
    rebuilt = counters.rebuild_comment_counters(model.comments(spark, sf), model.note_like_events(spark, sf))
    return rankings.sample_comments(rebuilt, model.documents(spark, sf), 40, 2)


@query("top_active_users", "K7", """
    SELECT user_id AS id, count(*) AS events FROM behavior GROUP BY 1 ORDER BY events DESC, id LIMIT 20""")
def top_active_users(spark, sf):
    return rankings.top_activity(model.behavior(spark, sf), "user_id")


@query("ranking_hydrate", "J17 P3", f"""
    SELECT n.id, n.title, n.author_id, r.hot_score AS score
    FROM (SELECT id, hot_score FROM rebuilt_notes WHERE status = 'published'
          ORDER BY hot_score DESC, id DESC LIMIT 200) r JOIN notes n USING (id)
    WHERE n.visibility = 'public' OR EXISTS (SELECT 1 FROM members m WHERE m.project_id = n.project_id
          AND m.user_id = {VIEWER} AND m.status = 'active')""")
def ranking_hydrate(spark, sf):
    notes = model.notes(spark, sf)
    rebuilt = counters.rebuild_note_counters(notes, model.interactions(spark, sf))
    ranking = rebuilt.where("status = 'published'").select("id", F.col("hot_score").alias("score")).orderBy(
        F.desc("score"), F.desc("id")).limit(200)
    readable = listing.visible_to(notes, model.members(spark, sf), VIEWER).select("id", "title", "author_id")
    return rankings.hydrate(ranking, readable)


@query("visible_notes", "P3", f"""
    SELECT id, project_id, visibility FROM notes n WHERE visibility = 'public' OR EXISTS (
      SELECT 1 FROM members m WHERE m.project_id = n.project_id AND m.user_id = {VIEWER} AND m.status = 'active')""")
def visible_notes(spark, sf):
    notes = model.notes(spark, sf).select("id", "project_id", "visibility")
    return listing.visible_to(notes, model.members(spark, sf), VIEWER)


@query("note_listing", "P1 P2 S1", """
    SELECT id, category, substring(body, 1, 600) AS body FROM docs
    WHERE status = 'published' AND category = 'en' AND contains(lower(body), 'the')""")
def note_listing(spark, sf):
    notes = model.documents(spark, sf).withColumn("title", F.lit(""))
    found = listing.listed(listing.entity_scan(notes), category="en", search="The")
    return listing.summary(found).select("id", "category", "body")


@query("note_keyset_page", "K1 P2", """
    SELECT true AS has_more, CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) - 1 AS INTEGER) AS position,
           created_at, id, title
    FROM (SELECT * FROM notes WHERE status = 'published' AND (created_at, id) < (TIMESTAMP '1999-06-01', 3000)
          ORDER BY created_at DESC, id DESC LIMIT 25)""")
def note_keyset_page(spark, sf):
    rows = listing.listed(model.notes(spark, sf)).select("created_at", "id", "title")
    cursor = [F.lit(dt.datetime(1999, 6, 1)), F.lit(3000).cast("bigint")]
    return listing.keyset_page(rows, ["created_at", "id"], cursor, 25)


@query("comment_keyset_page", "K2", """
    SELECT false AS has_more, CAST(row_number() OVER (ORDER BY created_at DESC, id DESC) - 1 AS INTEGER) AS position,
           created_at, id, intent FROM comments WHERE note_id = 8 AND status = 1
    ORDER BY created_at DESC, id DESC LIMIT 25""")
def comment_keyset_page(spark, sf):
    rows = model.comments(spark, sf).where("note_id = 8 AND status = 1").select("created_at", "id", "intent")
    return listing.keyset_page(rows, ["created_at", "id"], None, 25)


@query("ids_in_order", "J8", """
    SELECT l.doc_id AS request_id, CAST(l.i - 1 AS INTEGER) AS position, n.id, n.title
    FROM (SELECT doc_id, i, 1 + (doc_id * 37 + i * 101) % 20000 AS id
          FROM (SELECT doc_id, unnest(range(1, 2 + doc_id % 8)) AS i FROM documents)) l
    JOIN notes n ON n.id = l.id""")
def ids_in_order(spark, sf):
    """Each document asks for a short list of notes; answers keep the list's order."""
    doc = F.col("doc_id")
    requests = model.table(spark, sf, "documents").select(
        doc.alias("request_id"),
        F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(1) + doc % 8), lambda i: F.lit(1) + (doc * 37 + i * 101) % 20000).alias("ids"))
    return listing.in_given_order(requests, model.notes(spark, sf).select("id", "title"))


@query("author_attach", "J13", """
    SELECT n.id, n.author_id, c.c_name AS author_name FROM notes n LEFT JOIN customer c ON c.c_custkey = n.author_id""")
def author_attach(spark, sf):
    users = model.table(spark, sf, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("author_name"))
    return listing.attach_authors(model.notes(spark, sf).select("id", "author_id"), users)


@query("viewer_flags", "J14", f"""
    SELECT n.id,
           EXISTS (SELECT 1 FROM interactions i WHERE i.note_id = n.id AND i.user_id = {VIEWER} AND i.kind = 'like') AS liked,
           EXISTS (SELECT 1 FROM interactions i WHERE i.note_id = n.id AND i.user_id = {VIEWER} AND i.kind = 'collect') AS collected
    FROM notes n""")
def viewer_flags(spark, sf):
    return listing.viewer_flags(model.notes(spark, sf).select("id"), model.interactions(spark, sf), VIEWER)


@query("note_details", "J20 J13", """
    SELECT d.id, d.author_id, c.c_name AS author_name, coalesce(m.urls, []) AS media_urls
    FROM (SELECT id, id % 100 AS author_id FROM docs) d LEFT JOIN customer c ON c.c_custkey = d.author_id
    LEFT JOIN (SELECT note_id, list(url ORDER BY position, id) AS urls FROM media GROUP BY 1) m ON m.note_id = d.id""")
def note_details(spark, sf):
    users = model.table(spark, sf, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("author_name"))
    notes = model.documents(spark, sf).select("id", (F.col("id") % 100).alias("author_id"))
    return listing.note_details(notes, model.media(spark, sf), users)


@query("comment_project", "J1", """
    SELECT c.id AS comment_id, d.project_id FROM comments c JOIN docs d ON d.id = c.note_id""")
def comment_project(spark, sf):
    parents = model.documents(spark, sf).select(F.col("id").alias("note_id"), "project_id")
    return model.comments(spark, sf).select(F.col("id").alias("comment_id"), "note_id").join(parents, "note_id").drop("note_id")


@query("thread_roots", "J19", """
    WITH RECURSIVE walk AS (
      SELECT id, 0 AS root_id, 0 AS depth FROM comments WHERE parent_id = 0
      UNION ALL
      SELECT c.id, CASE WHEN w.root_id = 0 THEN w.id ELSE w.root_id END, w.depth + 1
      FROM comments c JOIN walk w ON w.id = c.parent_id)
    SELECT id, CAST(root_id AS BIGINT) AS root_id, CAST(depth AS BIGINT) AS depth FROM walk""")
def thread_roots(spark, sf):
    return listing.thread_roots(model.comments(spark, sf))


@query("first_active_dataset", "J3", """
    SELECT p.id AS project_id, (SELECT min(d.id) FROM datasets d WHERE d.project_id = p.id AND d.status = 'active'
           AND d.slug = 'community') AS dataset_id FROM projects p""")
def first_active_dataset(spark, sf):
    from quillspark.operators import versions

    return versions.first_active_dataset(model.projects(spark, sf), model.datasets(spark, sf))
