"""Streams over the given tables, run to completion; their results are checked as batch tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from quillspark.operators import rankings
from quillspark.operators.ordering import nearest_rank
from quillspark.plans.registry import REGISTRY
from quillspark.session import materialize, scratch_dir
from quillspark.sources import model
from quillspark.streaming import daily, envelopes, limits, pipeline, windows

query, define = REGISTRY.query, REGISTRY.define


def processing_time():
    return F.to_timestamp(F.lit("2024-02-01"))


NOTE_STATUS = "CASE WHEN {x} % 7 = 3 THEN 'deleted' ELSE 'published' END"


def workspace(spark) -> str:
    return f"{scratch_dir(spark)}/quillspark/stream-{uuid.uuid4().hex}"


#: Events that stand in for some of the given ones: likes and their ends, comments' likes and ends, notes that come, change and go.
PLANTED_SQL = """CASE event_id % 9 WHEN 4 THEN 'note_liked' WHEN 5 THEN 'note_unliked' WHEN 6 THEN 'note_uncollected' ELSE
    CASE event_id % 27 WHEN 7 THEN 'comment_liked' WHEN 16 THEN 'comment_unliked' WHEN 25 THEN 'comment_deleted' ELSE
    CASE event_id % 81 WHEN 8 THEN 'note_deleted' WHEN 35 THEN 'note_updated' WHEN 62 THEN 'note_created' ELSE event_type END END END"""
COMMENT_SQL = "CASE WHEN kind LIKE 'comment_%' AND NOT (kind = 'comment_created' AND event_id % 5 = 0) THEN note_id * 100 + user_id % 10 END"
PARENT_SQL = "CASE WHEN kind IN ('comment_created', 'comment_deleted') AND user_id % 2 = 0 THEN note_id * 100 + 99 END"


def write_messages(spark, sf, path):
    """Envelopes of all events in four files; some are repeated, some broken on purpose."""
    n = F.col("event_id")
    events = model.behavior(spark, sf).withColumn("kind", F.expr(PLANTED_SQL)).withColumn("comment_id", F.expr(COMMENT_SQL)).withColumn("parent_id", F.expr(PARENT_SQL))
    payload = F.to_json(F.struct(F.when(n % 50 == 1, 0).otherwise(F.col("user_id")).alias("user_id"), "project_id", "note_id", "comment_id", "parent_id"))
    message = F.to_json(F.struct(
        F.col("source_event_id").alias("event_id"), F.replace("kind", F.lit("_"), F.lit(".")).alias("event_type"), F.when(n % 50 == 0, 2).otherwise(1).alias("schema_version"),
        payload.alias("payload"), F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("occurred_at")))
    broken = F.when(n % 50 == 2, F.concat(F.lit("{"), F.col("source_event_id"))).otherwise(message)
    copies = F.explode(F.sequence(F.lit(1), F.when(n % 20 == 3, 2).otherwise(1)))
    events.select(broken.alias("value"), copies.alias("copy")).select("value").repartition(4).write.text(path)


def note_list(spark, sf):
    """Notes the events speak of, with category and status."""
    note = F.col("note_id")
    return model.behavior(spark, sf).where("note_id IS NOT NULL").select("note_id").distinct().select(
        note.alias("id"), F.concat(F.lit("c"), (note % 4).cast("string")).alias("category"), F.expr(NOTE_STATUS.format(x="note_id")).alias("status"))


def run_pipeline(spark, sf):
    root = workspace(spark)
    write_messages(spark, sf, f"{root}/source")
    job = pipeline.EventPipeline(spark, root, note_list(spark, sf), processing_time(), 10)
    following = pipeline.run_available(
        envelopes.envelope_stream(spark, f"{root}/source", 2), job.apply, f"{root}/checkpoint")
    job.drain(following, spark)
    return job


define("accepted", f"""
    SELECT *, {COMMENT_SQL} AS comment_id, {PARENT_SQL} AS parent_id FROM (
      SELECT *, {PLANTED_SQL} AS kind FROM behavior WHERE event_id % 50 > 2 AND user_id > 0)""")
define("stream_states", """
    SELECT 'note' AS what, note_id AS id, 'like' AS counter, CAST(user_id AS VARCHAR) AS holder, kind = 'note_liked' AS held, occurred_at, source_event_id FROM accepted WHERE kind IN ('note_liked', 'note_unliked')
    UNION ALL SELECT 'note', note_id, 'collect', CAST(user_id AS VARCHAR), kind = 'note_collected', occurred_at, source_event_id FROM accepted WHERE kind IN ('note_collected', 'note_uncollected')
    UNION ALL SELECT 'note', note_id, 'comment', coalesce(CAST(comment_id AS VARCHAR), source_event_id), kind = 'comment_created', occurred_at, source_event_id FROM accepted WHERE kind IN ('comment_created', 'comment_deleted')
    UNION ALL SELECT 'note', note_id, 'live', 'note', kind <> 'note_deleted', occurred_at, source_event_id FROM accepted WHERE kind IN ('note_created', 'note_updated', 'note_deleted')
    UNION ALL SELECT 'comment', comment_id, 'like', CAST(user_id AS VARCHAR), kind = 'comment_liked', occurred_at, source_event_id FROM accepted WHERE kind IN ('comment_liked', 'comment_unliked')
    UNION ALL SELECT 'comment', parent_id, 'reply', coalesce(CAST(comment_id AS VARCHAR), source_event_id), kind = 'comment_created', occurred_at, source_event_id FROM accepted WHERE kind IN ('comment_created', 'comment_deleted')""")
define("stream_holders", """
    SELECT what, id, counter, holder, arg_max(held, (occurred_at, source_event_id)) AS held FROM stream_states WHERE id > 0 GROUP BY 1, 2, 3, 4""")
define("stream_counts", f"""
    SELECT v.note_id, v.view_count, coalesce(h.likes, 0) AS like_count, coalesce(h.collects, 0) AS collect_count, coalesce(h.comments, 0) AS comment_count, coalesce(h.live, true) AS live
    FROM (SELECT note_id, count(*) FILTER (WHERE kind = 'note_viewed' AND {NOTE_STATUS.format(x="note_id")} = 'published') AS view_count
          FROM accepted WHERE note_id > 0 AND kind IN ('note_viewed', 'note_liked', 'note_unliked', 'note_collected', 'note_uncollected', 'comment_created', 'comment_deleted', 'note_created', 'note_updated', 'note_deleted')
          GROUP BY 1) v
    LEFT JOIN (SELECT id, count(*) FILTER (WHERE counter = 'like' AND held) AS likes, count(*) FILTER (WHERE counter = 'collect' AND held) AS collects,
                      count(*) FILTER (WHERE counter = 'comment' AND held) AS comments, bool_and(held) FILTER (WHERE counter = 'live') AS live
               FROM stream_holders WHERE what = 'note' GROUP BY 1) h ON h.id = v.note_id""")


@query("stream_behavior_facts", "T1 T2 T3 S5 S6 S9 P7", """
    SELECT source_event_id, project_id, user_id, note_id, CASE WHEN kind = 'media_viewed' THEN 'media.viewed' ELSE kind END AS event_type, occurred_at FROM accepted""")
def stream_behavior_facts(spark, sf):
    return run_pipeline(spark, sf).facts().select("source_event_id", "project_id", "user_id", "note_id", "event_type", "occurred_at")


@query("stream_dead_letters", "T7 S7", """
    SELECT CASE WHEN event_id % 50 = 2 THEN '' ELSE source_event_id END AS event_id, CAST(5 AS BIGINT) AS deliveries,
           CASE event_id % 50 WHEN 0 THEN 'unsupported event schema version 2' WHEN 2 THEN 'event_id and event_type are required' ELSE 'missing user_id' END AS failure
    FROM behavior WHERE event_id % 50 <= 2 OR user_id <= 0""")
def stream_dead_letters(spark, sf):
    return run_pipeline(spark, sf).letters.read().select("event_id", "deliveries", "failure")


@query("stream_note_counters", "T4 T5", """
    SELECT * EXCLUDE (live), CAST(view_count + 3 * like_count + 8 * collect_count + 6 * comment_count AS DOUBLE) AS hot_score FROM stream_counts""")
def stream_note_counters(spark, sf):
    return pipeline.current(run_pipeline(spark, sf).counters.read(), "note_id").select("note_id", "view_count", "like_count", "collect_count", "comment_count", "hot_score")


@query("stream_comment_counters", "T4", """
    SELECT id AS comment_id, count(*) FILTER (WHERE counter = 'like' AND held) AS like_count, count(*) FILTER (WHERE counter = 'reply' AND held) AS reply_count
    FROM stream_holders WHERE what = 'comment' GROUP BY 1""")
def stream_comment_counters(spark, sf):
    return pipeline.current(run_pipeline(spark, sf).comment_counters.read(), "comment_id")


@query("stream_rankings", "T6", f"""
    SELECT category, list(note_id ORDER BY score DESC, note_id DESC) AS ids FROM (
      SELECT note_id, 'c' || note_id % 4 AS category, view_count + 3 * like_count + 8 * collect_count + 6 * comment_count AS score FROM stream_counts
      WHERE {NOTE_STATUS.format(x="note_id")} = 'published' AND live
      QUALIFY row_number() OVER (PARTITION BY note_id % 4 ORDER BY score DESC, note_id DESC) <= 10) GROUP BY 1""")
def stream_rankings(spark, sf):
    return pipeline.current(run_pipeline(spark, sf).rankings.read(), "category").where("size(ids) > 0")


def event_stream(spark, sf):
    """The events table as a stream source."""
    raw = model.stream_table(spark, sf, "events")
    note = F.get_json_object("props", "$.k").cast("bigint")
    return raw.select(
        "event_id", F.col("event_id").cast("string").alias("source_event_id"), (F.lit(1) + note % 3).alias("project_id"), "user_id",
        F.nullif(note, F.lit(0)).alias("note_id"),
        F.expr("CASE event_type WHEN 'view' THEN 'note_viewed' WHEN 'click' THEN 'media_viewed' ELSE event_type END").alias("event_type"),
        F.col("ts").cast("timestamp").alias("occurred_at"))


def collect_stream(spark, rows, mode, keys):
    """Final value per key of a windowed stream, through a per-batch table."""
    root = workspace(spark)
    table = pipeline.BatchTable(spark, f"{root}/out", rows.schema)
    started = rows.writeStream.outputMode(mode).foreachBatch(table.write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    out = table.read()
    others = [c for c in rows.columns if c not in keys]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("r")).select(*keys, "r.*")


@query("stream_daily_facts", "T8", """
    SELECT project_id, note_id, CAST(occurred_at AS DATE) AS fact_date, count(*) FILTER (WHERE event_type IN ('note_viewed', 'media_viewed')) AS view_count,
           count(*) AS event_count FROM behavior WHERE note_id IS NOT NULL GROUP BY 1, 2, 3""")
def stream_daily_facts(spark, sf):
    rows = windows.daily_note_counts(windows.unique_events(event_stream(spark, sf)), delay=None)
    return collect_stream(spark, rows, "update", ["project_id", "note_id", "fact_date"])


@query("stream_daily_repair", "T8", """
    SELECT project_id, note_id, CAST(occurred_at AS DATE) AS fact_date, count(*) FILTER (WHERE event_type IN ('note_viewed', 'media_viewed')) AS view_count,
           count(*) AS event_count FROM behavior WHERE note_id IS NOT NULL GROUP BY 1, 2, 3""")
def stream_daily_repair(spark, sf):
    """Events arrive by day in four files; some come with the last file, days behind the watermark, and some twice."""
    root = workspace(spark)
    events = model.behavior(spark, sf).select("event_id", "source_event_id", "project_id", "user_id", "note_id", "event_type", F.col("occurred_at").cast("timestamp").alias("occurred_at"))
    held_back = F.col("event_id") % 40 == 7
    quarter = F.ntile(4).over(Window.orderBy("day"))
    days = events.select(F.to_date("occurred_at").alias("day")).distinct().select("day", quarter.alias("quarter"))
    dealt = events.withColumn("day", F.to_date("occurred_at")).join(days, "day").withColumn("file", F.when(held_back, 4).otherwise(F.col("quarter"))).drop("day", "quarter")
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("event_id") % 25 == 3, 2).otherwise(1)))
    dealt = materialize(dealt.withColumn("copy", copies).drop("copy"))
    for n in range(1, 5):  # one write after the other, so that files have an order
        dealt.where(F.col("file") == n).drop("file").coalesce(1).write.mode("append").parquet(f"{root}/source")
    source = spark.readStream.schema(dealt.drop("file").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/source")
    job = daily.DailyFacts(spark, root, "1 day")
    counted = windows.daily_note_counts(windows.unique_events(source), delay=None)
    sinks = [(counted, "update", job.counted.write, "counts"), (source, "append", job.observe, "observed")]
    started = [
        rows.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{root}/{name}").trigger(availableNow=True).start()
        for rows, mode, sink, name in sinks
    ]
    for stream in started:
        stream.awaitTermination()
    job.settle()
    job.repair(spark.read.schema(dealt.drop("file").schema).parquet(f"{root}/source"), 0)
    return job.read()


@query("stream_view_counts", "T5", "SELECT note_id, count(*) AS view_count FROM behavior WHERE event_type = 'note_viewed' AND note_id IS NOT NULL GROUP BY 1")
def stream_view_counts(spark, sf):
    rows = windows.view_counts(event_stream(spark, sf).where("note_id IS NOT NULL"))
    return collect_stream(spark, rows, "update", ["note_id"])


ALERT_SQL = """
    SELECT w AS window_start, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failures,
           round(count(*) FILTER (WHERE event_type = 'error')::DOUBLE / count(*), 6) AS error_rate
    FROM (SELECT event_type, unnest(range(0, 3)) AS i, ts, time_bucket(INTERVAL 2 HOUR, ts) - to_hours(CAST(i * 2 AS INTEGER)) AS w FROM events)
    WHERE ts >= w AND ts < w + INTERVAL 6 HOUR GROUP BY 1"""
define("alert_windows", ALERT_SQL)


def alert_stream(spark, sf):
    requests = event_stream(spark, sf).select("occurred_at", (F.col("event_type") == "error").alias("failed"))
    return collect_stream(spark, windows.alert_rates(requests, "6 hours", "2 hours"), "update", ["window_start"])


@query("stream_alert_rates", "T9", "SELECT * FROM alert_windows")
def stream_alert_rates(spark, sf):
    return alert_stream(spark, sf).withColumn("error_rate", F.round("error_rate", 6))


@query("stream_alert_firing", "T9", """
    SELECT firing_at FROM (SELECT a.window_start AS firing_at FROM (SELECT window_start, window_start - INTERVAL 2 HOUR AS b, window_start - INTERVAL 4 HOUR AS c FROM alert_windows
      UNION ALL SELECT window_start + INTERVAL 2 HOUR, window_start, window_start - INTERVAL 2 HOUR FROM alert_windows WHERE window_start = (SELECT max(window_start) FROM alert_windows)
      ) a WHERE (SELECT count(*) FROM alert_windows x WHERE x.window_start IN (a.window_start, a.b, a.c) AND x.failures::DOUBLE / x.requests > 0.2) = 3)""")
def stream_alert_firing(spark, sf):
    return windows.sustained(alert_stream(spark, sf), 0.2, 3, 7200)


define("group_windows", """
    SELECT event_type, w AS window_start, count(*) AS requests, count(*) FILTER (WHERE value > 50) AS failures, quantile_disc(value, 0.95) AS p95
    FROM (SELECT event_type, value, ts, time_bucket(INTERVAL 2 HOUR, ts) - to_hours(CAST(i * 2 AS INTEGER)) AS w FROM (SELECT *, unnest(range(0, 3)) AS i FROM events))
    WHERE ts >= w AND ts < w + INTERVAL 6 HOUR GROUP BY 1, 2""")
HELD_SQL = """
    SELECT event_type, window_start AS firing_at FROM (
      SELECT a.event_type, a.window_start, (SELECT count(*) FROM group_windows x WHERE x.event_type = a.event_type AND {high}
             AND x.window_start IN (a.window_start, a.window_start - INTERVAL 2 HOUR)) AS n
      FROM (SELECT event_type, window_start FROM group_windows UNION SELECT event_type, window_start + INTERVAL 2 HOUR FROM group_windows) a) WHERE n = 2"""


def group_stream(spark, sf):
    """Requests per dependency (the event type): slow ones count as failed."""
    raw = model.stream_table(spark, sf, "events")
    return raw.select("event_type", F.col("ts").cast("timestamp").alias("occurred_at"), F.col("value").cast("double").alias("latency"), (F.col("value") > 50).alias("failed"))


@query("stream_latency_quantiles", "T9 A14", "SELECT event_type, window_start, requests, p95 AS latency FROM group_windows")
def stream_latency_quantiles(spark, sf):
    counts = windows.latency_counts(group_stream(spark, sf), "6 hours", "2 hours", by=["event_type"])
    return windows.latency_quantiles(collect_stream(spark, counts, "update", ["event_type", "window_start", "latency"]), by=["event_type"])


@query("stream_latency_firing", "T9", HELD_SQL.format(high="x.p95 > 100"))
def stream_latency_firing(spark, sf):
    return windows.sustained(stream_latency_quantiles(spark, sf), 100.0, 2, 7200, "latency", ["event_type"])


@query("stream_group_firing", "T9", HELD_SQL.format(high="x.failures::DOUBLE / x.requests > 0.4"))
def stream_group_firing(spark, sf):
    rates = windows.alert_rates(group_stream(spark, sf), "6 hours", "2 hours", by=["event_type"])
    return windows.sustained(collect_stream(spark, rates, "update", ["event_type", "window_start"]), 0.4, 2, 7200, by=["event_type"])


@query("stream_failure_growth", "T9", """
    SELECT a.event_type, a.window_start AS firing_at, a.failures - coalesce(b.failures, 0) AS increase
    FROM group_windows a LEFT JOIN group_windows b ON b.event_type = a.event_type AND b.window_start = a.window_start - INTERVAL 2 HOUR
    WHERE a.failures > coalesce(b.failures, 0)""")
def stream_failure_growth(spark, sf):
    rates = windows.alert_rates(group_stream(spark, sf), "6 hours", "2 hours", by=["event_type"])
    return windows.increases(collect_stream(spark, rates, "update", ["event_type", "window_start"]), "failures", 7200, by=["event_type"])


@query("stream_rate_limit", "T10", """
    WITH RECURSIVE h AS (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id) FROM events),
    e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM h),
    walk AS (SELECT user_id, event_id, rn, t AS start_ms, CAST(1 AS BIGINT) AS hits FROM e WHERE rn = 1
             UNION ALL
             SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.t >= w.start_ms + 43200000 THEN e.t ELSE w.start_ms END,
                    CASE WHEN e.t >= w.start_ms + 43200000 THEN 1 ELSE w.hits + 1 END
             FROM walk w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
    SELECT user_id AS key, event_id, hits, greatest(2 - hits, 0) AS remaining, start_ms + 43200000 AS reset_ms, hits <= 2 AS allowed FROM walk""")
def stream_rate_limit(spark, sf):
    """Two events per user and half day, counted from the first one; every third event is of user 1."""
    user = F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id"))
    events = event_stream(spark, sf).select(user.cast("bigint").alias("key"), "event_id", F.unix_millis("occurred_at").alias("occurred_ms"))
    root = workspace(spark)
    job = limits.RateLimit(spark, root, 2, 12 * 3600 * 1000)
    pipeline.run_available(events, job.apply, f"{root}/checkpoint")
    return job.decisions.read().drop("batch_id")


@query("event_lag", "T11 A14", """
    SELECT event_type, quantile_disc(lag, 0.5) AS p50_lag, quantile_disc(lag, 0.95) AS p95_lag FROM (
      SELECT event_type, CAST(floor(epoch(TIMESTAMP '2024-02-01')) - floor(epoch(occurred_at)) AS BIGINT) AS lag FROM behavior) GROUP BY 1""")
def event_lag(spark, sf):
    rows = envelopes.event_lag(model.behavior(spark, sf), processing_time())
    return nearest_rank(rows.select("event_type", "lag_seconds"), ["event_type"], "lag_seconds", {"p50_lag": 0.50, "p95_lag": 0.95})


@query("stream_source_changes", "T12 V3 W6", """
    WITH c AS (SELECT o_custkey AS source_id, o_orderkey AS no, o_orderstatus AS h, o_orderdate AS changed, o_orderpriority = '5-LOW' AS del FROM orders),
    b AS (SELECT *, CASE WHEN NOT del AND (h IS DISTINCT FROM lag(h) OVER w OR lag(del) OVER w) THEN 1 ELSE 0 END AS opens FROM c
          WINDOW w AS (PARTITION BY source_id ORDER BY no)),
    v AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY source_id ORDER BY no) AS BIGINT) AS source_version FROM b),
    r AS (SELECT source_id, source_version, max(changed) FILTER (WHERE del) AS deleted_at FROM v WHERE opens = 1 OR del GROUP BY 1, 2)
    SELECT source_id, source_version, CASE WHEN source_version < max(source_version) OVER (PARTITION BY source_id) OR deleted_at IS NOT NULL THEN 'deleted' ELSE 'pending' END AS index_status FROM r""")
def stream_source_changes(spark, sf):
    """Orders as a change log of their customers: status is the content, low priority deletes."""
    changes = model.stream_table(spark, sf, "orders").select(
        F.lit(1).cast("bigint").alias("project_id"), F.lit("note").alias("source_type"), F.col("o_custkey").alias("source_id"),
        F.col("o_orderkey").alias("change_no"), F.when(F.col("o_orderpriority") == "5-LOW", "delete").otherwise("update").alias("operation"),
        F.col("o_orderstatus").alias("content_hash"), F.lit("public").alias("visibility"), F.col("o_orderdate").alias("changed_at"))
    root = workspace(spark)
    table = pipeline.BatchTable(spark, f"{root}/registry", (
        "project_id bigint, source_type string, source_id bigint, source_version bigint, content_hash string, visibility string, "
        "deleted_at timestamp, changed_at timestamp, change_no bigint"))

    def apply(batch, batch_id):
        table.write(windows.apply_changes(table.read(batch_id), batch), batch_id)

    pipeline.run_available(changes, apply, f"{root}/checkpoint")
    return windows.registry_state(table.read()).select("source_id", "source_version", "index_status")
