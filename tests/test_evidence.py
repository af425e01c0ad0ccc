from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import evidence, listing

SOURCE = (
    "project_id bigint, source_type string, source_id bigint, source_version bigint, visibility string, content_hash string, "
    "canonical_text string, note_id bigint, media_position int, intent string, sentiment string, topic_id bigint"
)


def comment(i, text, intent="", visibility="public"):
    return (1, "note_comment", i, 1, visibility, f"h{i}", text, 77, None, intent, "", 0)


@pytest.fixture(scope="module")
def thirteen(spark):
    rows = [comment(i, f"comment number {i} " + "x" * i, "ask" if i % 2 else "", "project" if i == 13 else "public") for i in range(1, 14)]
    return spark.createDataFrame(rows + [comment(99, "")], SOURCE)


def test_thirteen_comments_make_two_clusters(thirteen):
    docs = {r["source_key"]: r for r in evidence.comment_clusters(thirteen, 4, 9).collect()}
    assert sorted(docs) == ["note:77:comment-cluster:0000", "note:77:comment-cluster:0001"]
    first, second = docs["note:77:comment-cluster:0000"], docs["note:77:comment-cluster:0001"]
    assert len(first["segments"]) == 12 and len(second["segments"]) == 1
    assert first["visibility"] == "project" and second["visibility"] == "public"
    assert first["canonical_text"].startswith("[comment 13]\ncomment number 13")
    for doc in (first, second):
        data = doc["canonical_text"].encode()
        for s in doc["segments"]:
            assert data[s["start_byte"]:s["end_byte"]].decode().startswith(f"comment number {s['source_id']} ")


def test_clusters_do_not_depend_on_input_order(thirteen):
    key = lambda df: sorted(r["document_key"] for r in evidence.comment_clusters(df, 4, 9).collect())
    assert key(thirteen) == key(thirteen.orderBy(F.desc("source_id")).repartition(3))


def test_citations_slice_back_to_their_sources(spark, thirteen):
    body = "标题\r\n\r\n" + "这是可引用的正文。" * 200
    note = spark.createDataFrame([(1, "note", 5, 2, "public", "hn", body, 5, None, "", "", 0)], SOURCE)
    docs = evidence.direct_documents(note, 9).unionByName(evidence.comment_clusters(thirteen, 4, 9))
    rows = evidence.chunks(docs)
    sources = {("note", 5): body.replace("\r\n", "\n")} | {("note_comment", r["source_id"]): r["canonical_text"] for r in thirteen.collect()}
    cites = evidence.citations(rows).collect()
    for c in cites:
        data = sources[(c["source_type"], c["source_id"])].encode()
        assert data[c["source_start_byte"]:c["source_end_byte"]].decode() == c["quote"]
    assert {r["chunk_key"] for r in rows.collect()} == {c["chunk_key"] for c in cites}
    assert len({c["citation_key"] for c in cites}) == len(cites)


def test_rebuild_gives_the_same_keys(thirteen):
    build = lambda: sorted(r[0] for r in evidence.chunks(evidence.comment_clusters(thirteen, 4, 9)).select("chunk_key").collect())
    assert build() == build()


def test_lifecycle_first_rule_wins(spark):
    docs = spark.createDataFrame([
        ("cluster", "note_comment_cluster", "ready"), ("both", "note", "ready"), ("gone", "note", "ready"),
        ("fact", "user_daily_fact", "ready"), ("old", "note", "failed"), ("fine", "note_media", "ready")],
        "document_key string, document_type string, lifecycle_status string")
    flags = spark.createDataFrame([
        ("cluster", True, True, True), ("both", True, True, False), ("gone", True, False, False),
        ("fact", False, False, True), ("old", True, True, True)], "document_key string, source_gone boolean, newer_live boolean, fact_replaced boolean")
    got = {r["document_key"]: r["new_status"] for r in evidence.reconcile_lifecycle(docs, flags).collect()}
    assert got == {"cluster": "stale", "both": "superseded", "gone": "deleted", "fact": "superseded", "old": "failed", "fine": "ready"}


def test_fact_text(spark):
    row = spark.sql("SELECT DATE'2024-01-05' fact_date, 7L note_id, 1L view_count, 2L like_count, 3L collect_count, 4L comment_count, 5L share_count, 6L unique_user_count, 15L event_count")
    text = row.select(evidence.fact_text("note_daily_fact")).first()[0]
    assert text.splitlines()[:4] == ["笔记日事实", "日期: 2024-01-05", "笔记ID: 7", "浏览: 1"]
    with pytest.raises(ValueError):
        evidence.fact_text("other")


def test_thread_roots_refuse_loops(spark):
    rows = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "id bigint, parent_id bigint")
    with pytest.raises(ValueError, match="ancestors"):
        listing.thread_roots(rows)


def test_thread_roots_with_an_orphan(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3), (5, 0), (6, 5), (7, 99)], "id bigint, parent_id bigint")
    got = {r["id"]: (r["root_id"], r["depth"]) for r in listing.thread_roots(rows).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (0, 0), 6: (5, 1), 7: (99, 1)}


def test_content_versions_follow_watched_columns(spark):
    from quillspark.operators.versions import content_versions

    rows = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "a", "y"), (1, 3, "b", "y"), (1, 4, None, "y"), (1, 5, None, "z")], "id int, at int, title string, other string")
    got = [r["content_version"] for r in content_versions(rows, ["id"], ["at"], ["title"]).orderBy("at").collect()]
    assert got == [1, 1, 2, 3, 3]


def test_freeze_reuses_an_unchanged_snapshot(spark, tmp_path):
    from quillspark.operators.versions import freeze, write_snapshot

    rows = spark.createDataFrame([(2, "note", 1, 1, "h", "public", None, "pending"), (2, "note", 2, 1, "h", "public", None, "deleted")],
                                 "project_id bigint, source_type string, source_id bigint, source_version bigint, content_hash string, visibility string, deleted_at timestamp, index_status string")
    none = spark.createDataFrame([], "dataset_id bigint, version bigint, manifest_checksum string")
    first = freeze(rows, 2, 9, none)
    head = first.first()
    assert (head["version"], head["source_count"], head["reused"]) == (1, 1, False)
    write_snapshot(rows, first, str(tmp_path / "snap"))
    again = freeze(rows, 2, 9, first.select("dataset_id", "version", "manifest_checksum")).first()
    assert (again["version"], again["reused"]) == (1, True)
    grown = rows.withColumn("source_version", F.lit(2).cast("bigint"))
    assert freeze(grown, 2, 9, first.select("dataset_id", "version", "manifest_checksum")).first()["version"] == 2
    assert spark.read.parquet(str(tmp_path / "snap/dataset=9/version=1/members")).count() == 1


def test_an_audit_does_not_carry_texts_past_the_join_with_their_chunks(spark):
    docs = spark.createDataFrame([("d", 1, "note", "ready", 1, "some text")], "document_key string, project_id bigint, document_type string, lifecycle_status string, chunk_count bigint, canonical_text string")
    rows = spark.createDataFrame([("d", "c", 0, 9, "some text", "x")], "document_key string, chunk_key string, start_byte int, end_byte int, content string, content_hash string")
    cites = spark.createDataFrame([("d", "c", 0, 9, "x")], "document_key string, chunk_key string, document_start_byte int, document_end_byte int, quote_hash string")
    flags = spark.createDataFrame([("d", False)], "document_key string, source_gone boolean")
    plan = evidence.audit(docs, rows, cites, flags)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    after = [plan[at + 1] for at, line in enumerate(plan) if "Join LeftOuter, (chunk_key" in line]
    assert after and not any(re.search(r"[\[ ]_text#\d+[,\]]", line) for line in after)


def test_a_note_without_text_is_captured_with_a_null_text(spark):
    from quillspark.operators import versions

    columns = "id bigint, project_id bigint, title string, body string, category string, visibility string, status string, deleted_at timestamp, updated_at timestamp, content_version bigint"
    notes = spark.createDataFrame([(i, 1, "", body, "en", "public", "published", None, None, 1) for i, body in enumerate(["text", "", None])], columns)
    dataset = spark.createDataFrame([(1, 7)], "project_id bigint, dataset_id bigint")
    captured = versions.capture_payloads(versions.note_sources(notes, dataset))
    assert sorted(tuple(r) for r in captured.select("source_id", "canonical_text").collect()) == [(0, "text"), (1, None), (2, None)]
