from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators.merge import snapshot_diff
from quillspark.streaming import daily, envelopes, limits, pipeline, windows

NOTES = [(1, "c1", "published"), (2, "c1", "published"), (3, "c2", "deleted")]
KINDS = ["note.viewed", "note.liked", "note.collected", "comment.created", "note.shared", "note.unliked"]


def envelope(i, kind=None, note=None, user=9, version=1):
    return json.dumps({
        "event_id": f"e{i}", "event_type": kind or KINDS[i % 7 % 6], "schema_version": version,
        "payload": json.dumps({"user_id": user, "project_id": 1, "note_id": note if note is not None else 1 + i % 3}),
        "occurred_at": f"2024-01-{1 + i % 28:02d}T00:00:00Z"})


GOOD = [envelope(i, user=1 + i % 4) for i in range(60)]
POISON = [envelope(900, user=0), envelope(901, version=2), "{broken", json.dumps({"event_type": "x"})]


def write(path, name, lines):
    path.mkdir(exist_ok=True, parents=True)
    (path / name).write_text("\n".join(lines) + "\n")


def run(spark, root, files):
    notes = spark.createDataFrame(NOTES, "id bigint, category string, status string")
    job = pipeline.EventPipeline(spark, str(root), notes, F.to_timestamp(F.lit("2024-03-01")), 5)
    for n, lines in enumerate(files):
        write(root / "source", f"{n:03d}.txt", lines)
        following = pipeline.run_available(envelopes.envelope_stream(spark, f"{root}/source", 1), job.apply, f"{root}/checkpoint")
    job.drain(following, spark)
    return job


def state(job):
    counters = {r["note_id"]: tuple(r)[1:] for r in pipeline.current(job.counters.read(), "note_id").drop("live").collect()}
    facts = sorted(tuple(r)[:8] for r in job.facts().collect())
    return facts, counters, {r["category"]: r["ids"] for r in pipeline.current(job.rankings.read(), "category").collect()}


@pytest.fixture(scope="module")
def single(spark, tmp_path_factory):
    return run(spark, tmp_path_factory.mktemp("single"), [GOOD + POISON])


def held(events, note, kind):
    """Users whose newest event of the kind set it."""
    newest = {}
    for e in sorted(events, key=lambda e: (e["occurred_at"], e["event_id"])):
        payload = json.loads(e["payload"])
        if payload["note_id"] == note and e["event_type"] in (f"note.{kind}", f"note.un{kind}"):
            newest[payload["user_id"]] = e["event_type"] == f"note.{kind}"
    return sum(newest.values())


def test_a_like_counts_once_and_an_unlike_alone_not_at_all(spark, tmp_path):
    days = iter(range(1, 20))
    like = lambda kind, user, i: json.dumps(json.loads(envelope(i, kind, 1, user)) | {"occurred_at": f"2024-02-{next(days):02d}T00:00:00Z"})
    batches = [[like("note.liked", 1, 1), like("note.liked", 1, 2), like("note.unliked", 2, 3)], [like("note.liked", 3, 4), like("note.unliked", 1, 5)], [like("note.liked", 1, 6)]]
    late = json.dumps(json.loads(envelope(7, "note.unliked", 1, 3)) | {"occurred_at": "2024-01-01T00:00:00Z"})
    _, counters, _ = state(run(spark, tmp_path, [*batches, [late]]))
    assert counters[1][1] == 2


def test_stream_counts_match_the_events(single):
    facts, counters, ranks = state(single)
    assert len(facts) == 60
    events = [json.loads(g) for g in GOOD]
    for note, (views, likes, collects, comments, shares, hot) in counters.items():
        n = lambda kind: sum(json.loads(e["payload"])["note_id"] == note and e["event_type"] == kind for e in events)
        assert views == (0 if note == 3 else n("note.viewed"))
        assert (likes, collects, comments, shares) == (held(events, note, "liked"), held(events, note, "collected"), n("comment.created"), n("note.shared"))
        assert hot == views + 3 * likes + 8 * collects + 6 * comments + 5 * shares
    assert sorted(ranks) == ["c1"] and sorted(ranks["c1"]) == [1, 2]


def event(i, kind, day, **payload):
    return json.dumps({"event_id": f"x{i}", "event_type": kind, "schema_version": 1, "payload": json.dumps({"user_id": 1, "project_id": 1} | payload), "occurred_at": f"2024-02-{day:02d}T00:00:00Z"})


def test_comment_counters_follow_likes_and_replies(spark, tmp_path):
    made = [event(0, "comment.created", 1, note_id=1, comment_id=10), event(1, "comment.created", 2, note_id=1, comment_id=11, parent_id=10),
            event(2, "comment.created", 3, note_id=1, comment_id=12, parent_id=10), event(3, "comment.liked", 3, note_id=1, comment_id=10, user_id=5)]
    later = [event(4, "comment.deleted", 4, note_id=1, comment_id=11, parent_id=10), event(5, "comment.liked", 5, note_id=1, comment_id=10, user_id=6),
             event(6, "comment.unliked", 4, note_id=1, comment_id=10, user_id=5), event(3, "comment.liked", 3, note_id=1, comment_id=10, user_id=5)]
    job = run(spark, tmp_path, [made, later])
    counts = {r["comment_id"]: (r["like_count"], r["reply_count"]) for r in pipeline.current(job.comment_counters.read(), "comment_id").collect()}
    assert counts == {10: (1, 1)}
    assert state(job)[1][1][3] == 2  # comments of the note that stand


def test_rankings_lose_deleted_notes_and_fill_up_again(spark, tmp_path):
    notes = spark.createDataFrame([(i, "c", "published") for i in range(1, 13)], "id bigint, category string, status string")
    job = pipeline.EventPipeline(spark, str(tmp_path), notes, F.to_timestamp(F.lit("2024-03-01")), 2)
    likes = [event(100 * n + u, "note.liked", 1, note_id=n, user_id=u) for n in range(1, 13) for u in range(1, n + 1)]
    batches = [likes, [event(5000 + n, "note.deleted", 2, note_id=n) for n in (12, 11, 10)], [event(6000, "note.updated", 3, note_id=11)],
               [event(7000 + u, "note.unliked", 4, note_id=11, user_id=u) for u in range(1, 6)], [event(8000 + n, "note.deleted", 5, note_id=n) for n in (9, 8, 7, 6)]]
    shown = []
    for batch_id, lines in enumerate(batches):
        job.apply(spark.createDataFrame([(m,) for m in lines], "value string"), batch_id)
        job.advance()
        shown.append(pipeline.current(job.rankings.read(), "category").first()["ids"])
    assert shown == [[12, 11], [9, 8], [11, 9], [9, 8], [11, 5]]


def test_late_days_are_repaired(spark, tmp_path):
    rows = [(f"e{d}-{k}", 1, 1 + k % 2, "note_viewed", d) for d in range(1, 9) for k in range(4)]
    late = [("late1", 1, 1, "note_viewed", 2), ("late2", 1, 2, "note_liked", 3), ("late1", 1, 1, "note_viewed", 2)]
    schema = "source_event_id string, project_id bigint, note_id bigint, event_type string, day int"
    timed = lambda part: spark.createDataFrame(part, schema).withColumn("occurred_at", F.to_timestamp(F.concat(F.lit("2024-01-0"), F.col("day").cast("string")))).drop("day")
    for part in (rows[:16], rows[16:], late):
        timed(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
    source = spark.readStream.schema(timed(rows).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/source")
    job = daily.DailyFacts(spark, str(tmp_path), "1 day")
    counted = windows.daily_note_counts(windows.unique_events(source), delay=None)
    pipeline.run_available(counted, job.counted.write, f"{tmp_path}/c1", "update")
    pipeline.run_available(source, job.observe, f"{tmp_path}/c2")
    job.settle()
    before = {tuple(r) for r in job.read().select("note_id", F.dayofmonth("fact_date"), "event_count").collect()}
    assert (1, 2, 2) in before and (2, 3, 2) in before  # what the stream could not count
    assert sorted(r[0] for r in job.dirty_days().select(F.dayofmonth("fact_date")).collect()) == [2, 3]
    log = spark.read.schema(timed(rows).schema).parquet(f"{tmp_path}/source")
    job.repair(log, 0)
    after = {tuple(r) for r in job.read().select("note_id", F.dayofmonth("fact_date"), "event_count").collect()}
    assert after == (before - {(1, 2, 2), (2, 3, 2)}) | {(1, 2, 3), (2, 3, 3)}
    assert job.dirty_days().count() == 0


def walked(hits, limit, window):
    """Fixed windows by walking each key's hits in order."""
    out, open_ = {}, {}
    for key, event_id, at in sorted(hits, key=lambda h: (h[0], h[2], h[1])):
        start, n = open_.get(key, (None, 0))
        if start is None or at >= start + window:
            start, n = at, 0
        open_[key] = start, n + 1
        out[event_id] = (n + 1, max(limit - n - 1, 0), start + window, n + 1 <= limit)
    return out


def test_rate_limits_equal_a_walk_over_batches_and_hot_keys(spark, tmp_path):
    rng = random.Random(6)
    hits = [(1 if rng.random() < .5 else rng.randrange(2, 9), n, n * 10 + rng.randrange(60)) for n in range(400)]
    job = limits.RateLimit(spark, str(tmp_path), 3, 500)
    order = sorted(hits, key=lambda h: (h[2], h[1]))
    for batch_id, (a, b) in enumerate([(0, 150), (150, 151), (151, 400)]):
        job.apply(spark.createDataFrame(order[a:b], "key bigint, event_id bigint, occurred_ms bigint"), batch_id)
    got = {r["event_id"]: (r["hits"], r["remaining"], r["reset_ms"], r["allowed"]) for r in job.decisions.read().collect()}
    assert got == walked(hits, 3, 500)


def test_poison_messages_end_as_dead_letters(single):
    letters = {r["original_message"]: (r["deliveries"], r["failure"]) for r in single.letters.read().collect()}
    assert set(letters) == set(POISON)
    assert {d for d, _ in letters.values()} == {envelopes.MAX_ATTEMPTS}
    assert letters[POISON[1]][1] == "unsupported event schema version 2"
    shown = envelopes.inspect_dead_letters(single.letters.read(), "e900").collect()
    assert [r["failure"] for r in shown] == ["missing user_id"]


def test_shuffled_and_repeated_input_over_batches_gives_the_same_state(spark, single, tmp_path):
    mixed = GOOD + random.Random(2).sample(GOOD, 30)
    random.Random(1).shuffle(mixed)
    job = run(spark, tmp_path, [mixed[:40], mixed[40:] + POISON[:1], GOOD[:5]])
    assert state(job) == state(single)


def test_a_batch_that_runs_twice_changes_nothing(spark, single, tmp_path):
    notes = spark.createDataFrame(NOTES, "id bigint, category string, status string")
    job = pipeline.EventPipeline(spark, str(tmp_path), notes, F.to_timestamp(F.lit("2024-03-01")), 5)
    messages = spark.createDataFrame([(m,) for m in GOOD], "value string")
    for batch_id in (0, 0, 1, 1):
        job.apply(messages.limit(60), batch_id)
        job.advance()
    assert state(job) == state(single)


def test_domain_events_keep_unknown_names(spark):
    rows = spark.createDataFrame([(envelope(1, "media.viewed"),), (envelope(2, "note.liked"),)], "value string")
    assert [r["event_type"] for r in envelopes.parse(rows).collect()] == ["media.viewed", "note_liked"]


CHANGES = "project_id bigint, source_type string, source_id bigint, change_no bigint, operation string, content_hash string, visibility string, changed_at timestamp"
REGISTRY = "project_id bigint, source_type string, source_id bigint, source_version bigint, content_hash string, visibility string, deleted_at timestamp, changed_at timestamp, change_no bigint"


def test_changes_in_batches_equal_changes_at_once(spark, tmp_path):
    rng = random.Random(4)
    rows = [(1, "note", rng.randrange(6), n, "delete" if rng.random() < .2 else "update", rng.choice("abc"), "public", None) for n in range(80)]
    df = spark.createDataFrame(rows, CHANGES).withColumn("changed_at", F.timestamp_seconds(F.col("change_no")))

    def build(cuts, name):
        table = pipeline.BatchTable(spark, str(tmp_path / name), REGISTRY)
        for n, (low, high) in enumerate(zip(cuts, cuts[1:])):
            table.write(windows.apply_changes(table.read(n), df.where((F.col("change_no") >= low) & (F.col("change_no") < high))), n)
        return windows.registry_state(table.read()).drop("opened_at")

    whole, parts = build([0, 80], "whole"), build([0, 13, 40, 80], "parts")
    columns = ["content_hash", "index_status"]
    assert snapshot_diff(whole, parts, ["source_id", "source_version"], columns).count() == 0
    by_source = {}
    for source, _, operation, content in sorted((r[2], r[3], r[4], r[5]) for r in rows):
        last, gone, version = by_source.get(source, (None, False, 0))
        opens = operation != "delete" and (gone or content != last)
        by_source[source] = (content, operation == "delete", version + opens)
    assert {r["source_id"]: r["v"] for r in whole.groupBy("source_id").agg(F.max("source_version").alias("v")).collect()} == {k: v[2] for k, v in by_source.items()}
    assert whole.groupBy("source_id").agg(F.count_if(F.col("index_status") == "pending").alias("n")).where("n > 1").count() == 0


def test_sustained_alerts_need_every_window(spark):
    rates = spark.createDataFrame([(n * 60, r) for n, r in enumerate([.1, .9, .9, .9, .1, .9, .9])], "s bigint, error_rate double").select(
        F.timestamp_seconds("s").alias("window_start"), "error_rate")
    got = [r["t"] for r in windows.sustained(rates, .5, 3, 60).select(F.unix_timestamp("firing_at").alias("t")).collect()]
    assert got == [180]


def test_streams_read_files_and_folders_alike(spark, tmp_path):
    from quillspark.sources import model

    rows = spark.range(40).selectExpr("id AS event_id", "id % 3 AS user_id")
    for layout, parts in (("one", 1), ("many", 3)):
        root = tmp_path / layout
        rows.repartition(parts).write.parquet(f"{root}/written")
        (root / "tables").mkdir()
        if parts == 1:
            next((root / "written").glob("part-*.parquet")).rename(root / "tables" / "events.parquet")
        else:
            (root / "written").rename(root / "tables" / "events.parquet")
        (root / "tables" / "other.parquet").mkdir()
        stream = model.stream_table(spark, f"{root}/tables", "events")
        done = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        done.awaitTermination()
        assert spark.read.parquet(f"{root}/out").count() == 40


def test_latency_quantiles_are_exact_in_windows_of_many_values(spark, tmp_path):
    from quillspark.plans import streams

    n = 60_000
    rows = spark.range(n).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 'view' ELSE 'click' END AS event_type", "timestamp_seconds(1704074400 + id % 7000) AS ts", "CAST(id * 7919 % 60000 AS double) AS value")
    rows.unionByName(spark.sql("SELECT 'view' AS event_type, timestamp_seconds(1704074400) AS ts, CAST(NULL AS double) AS value")).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["event_type"], r["requests"], r["latency"]) for r in streams.stream_latency_quantiles(spark, str(tmp_path)).collect()}
    # odd values are clicks, even ones views: the 28,500th of 30,000
    assert got == {("click", n // 2, 56_999.0), ("view", n // 2 + 1, 56_998.0)}
