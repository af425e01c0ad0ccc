from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.operators import agreement, benchmark, evaluation, quality

PAIRS = "task_type string, a int, b int"


def kappa(spark, rows, categories):
    return {r["task_type"]: r for r in agreement.agreement(spark.createDataFrame(rows, PAIRS), "a", "b", categories, "task_type").collect()}


def test_kappa_edges(spark):
    perfect = kappa(spark, [("t", i % 4, i % 4) for i in range(20)], 4)["(all)"]
    assert (perfect["kappa"], perfect["quadratic_kappa"], perfect["exact_agreement"]) == (1.0, 1.0, 1.0)
    chance = kappa(spark, [("t", a, b) for a in (0, 1) for b in (0, 1)], 2)["(all)"]
    assert (chance["kappa"], chance["quadratic_kappa"]) == (0.0, 0.0)
    single = kappa(spark, [("t", 1, 1)] * 5, 2)["(all)"]
    assert (single["kappa"], single["quadratic_kappa"]) == (1.0, 1.0)


def test_one_low_stratum_fails_the_gates(spark):
    rows = [("good", i % 4, i % 4) for i in range(40)] + [("bad", i % 4, (i + 2) % 4) for i in range(8)]
    both = agreement.agreement(spark.createDataFrame(rows, PAIRS), "a", "b", 4, "task_type")
    gates = {r["task_type"]: r["passed"] for r in agreement.agreement_gates(both, both, "task_type").collect()}
    assert gates["good"] and not gates["bad"]


CASES = "query_id bigint, task_type string"
GOLD = "query_id bigint, source_type string, note_id bigint, position int"
CITED = "query_id bigint, rank int, source_type string, note_id bigint, position int, valid boolean"
LEAKS = "query_id bigint, unauthorized_results bigint, metadata_leak boolean"


def test_case_metrics(spark):
    cases = spark.createDataFrame([(1, "semantic_paraphrase"), (2, "no_relevant_document"), (3, "no_relevant_document"), (4, "authorization_boundary"), (5, "ocr_detail"), (6, "insufficient_evidence")], CASES)
    gold = spark.createDataFrame([(1, "note", 10, 0), (1, "note", 10, 3), (1, "note", 11, 0), (4, "note", 12, 0), (5, "note_media", 13, 2), (6, "note", 14, 0)], GOLD)
    cited = spark.createDataFrame([
        (1, 1, "note", 99, None, True), (1, 2, "note", 10, None, True), (3, 1, "note", 1, None, True), (4, 1, "note", 12, None, True),
        (5, 1, "note_media", 13, 1, True), (5, 2, "note_media", 13, 2, False)], CITED)
    leaks = spark.createDataFrame([(4, 1, False)], LEAKS)
    got = {r["query_id"]: r for r in evaluation.case_metrics(cases, gold, cited, leaks).collect()}
    one = got[1]
    assert (one["gold_count"], one["recall"], one["reciprocal_rank"], one["source_precision"]) == (2, 0.5, 0.5, 0.5)
    assert one["ndcg"] == pytest.approx((1 / 1.584962500721156) / (1 + 1 / 1.584962500721156))
    assert got[2]["rejected"] and got[2]["citation_precision"] == 1.0 and got[2]["failure_category"] == ""
    assert got[3]["failure_category"] == "false_positive_no_relevant"
    assert got[4]["failure_category"] == "authorization_leak"
    assert (got[5]["reciprocal_rank"], got[5]["citation_precision"], got[5]["failure_category"]) == (0.5, 0.5, "ranking_error")
    assert (got[6]["citation_precision"], got[6]["failure_category"]) == (0.0, "missed_all_gold")
    overall = {r["task_type"]: r for r in evaluation.aggregate_metrics(spark.createDataFrame(list(got.values()))).collect()}
    total = overall["(all)"]
    assert (total["case_count"], total["gold_case_count"], total["recall_at_10"]) == (6, 4, 0.625)
    assert (total["no_relevant_rejection_accuracy"], total["authorization_non_leakage_accuracy"]) == (0.5, 0.0)
    assert total["citation_precision"] == round(5 / 6, 4)
    assert overall["insufficient_evidence"]["insufficient_evidence_source_recall"] == 0.0


def test_split_meets_quotas_and_is_seeded(spark):
    cases = spark.createDataFrame([(i, "big" if i % 3 else "small") for i in range(300)], "case_id bigint, task_type string")
    quotas = spark.createDataFrame([("big", 50), ("small", 20)], "task_type string, quota bigint")
    pick = lambda seed: {r["case_id"] for r in benchmark.stratified_split(cases, quotas, seed).where("split = 'development'").collect()}
    assert len(pick(1)) == 70 and pick(1) == pick(1) and pick(1) != pick(2)


def test_tampering_is_found(spark):
    cases = spark.createDataFrame([(1, "t", "q", "a", "n1"), (2, "t", "r", "b", "n2")], "case_id int, task_type string, query string, expected_answer string, commitment_nonce string")
    sealed = benchmark.seal(cases, ["task_type", "query", "expected_answer"])
    assert benchmark.verify_cases(sealed, ["task_type", "query", "expected_answer"]).count() == 0
    changed = sealed.withColumn("query", F.when(F.col("case_id") == 2, F.lit("z")).otherwise(F.col("query")))
    assert [tuple(r) for r in benchmark.verify_cases(changed, ["task_type", "query", "expected_answer"]).collect()] == [(2, "checksum")]


def test_distinguishability_states(spark):
    cases = spark.createDataFrame([(1, "see the red maple tree"), (2, "see the shared phrase"), (3, "note 42 please"), (4, "nothing"), (5, "missing gold")], "case_id int, query string")
    gold = spark.createDataFrame([(1, 41, "trees"), (2, 41, "trees"), (3, 42, "trees"), (5, 77, "x")], "case_id int, note_id bigint, topic string")
    scenarios = spark.createDataFrame([(41, "trees", '{"a": ["red  maple", "shared phrase"], "n": 3}'), (42, "trees", '{"b": {"c": "shared phrase"}}')], "note_id bigint, subject string, payload string")
    got = benchmark.distinguishability(cases, gold, scenarios, benchmark.payload_anchors(scenarios))
    assert {r["case_id"]: (r["status"], r["matched_anchors"], r["unique_anchors"], r["topic_cohort"]) for r in got.collect()} == {
        1: ("pass", 1, 1, 2), 2: ("review", 1, 0, 2), 3: ("pass", 0, 0, 2), 4: ("not_applicable", 0, 0, 0), 5: ("invalid", 0, 0, 0)}


def test_notes_are_counted_for_anchors_of_queries_only(spark):
    """Lines that no query holds are left out before anything is grouped by anchor."""
    cases = spark.createDataFrame([(1, "see the shared phrase")], "case_id int, query string")
    gold = spark.createDataFrame([(1, 41, "trees")], "case_id int, note_id bigint, topic string")
    scenarios = spark.range(41, 61).select(F.col("id").alias("note_id"), F.lit("trees").alias("subject"))
    anchors = scenarios.select("note_id", F.explode(F.array(F.lit("shared phrase"), F.concat(F.lit("line "), F.col("note_id").cast("string")))).alias("anchor"))
    got = benchmark.distinguishability(cases, gold, scenarios, anchors)
    assert "LeftSemi, (anchor#" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["matched_anchors"], r["unique_anchors"], r["status"]) for r in got.collect()] == [(1, 0, "review")]


def test_top_share_takes_part_of_a_level(spark):
    events = spark.createDataFrame([(u,) for u, n in ((1, 5), (2, 3), (3, 3), (4, 1)) for _ in range(n)], "u int")
    size = spark.range(1).select(F.lit(4).alias("size"))
    assert quality.top_share(events, "u", size, 0.5).first()["share"] == round(8 / 12, 4)
    assert quality.top_share(events, "u", size, 0.01).first()["share"] == round(5 / 12, 4)


def test_request_counters_and_peaks(spark, tmp_path):
    from quillspark.sources import files

    for moment, hits, misses in (("before", 10, 2), ("after", 40, 12)):
        folder = tmp_path / "run1" / moment
        folder.mkdir(parents=True)
        (folder / "api-metrics.prom").write_text(f'cache_hit_total{{cache="note"}} {hits}\ncache_miss_total{{cache="note"}} {misses}\nother 3\n')
    (tmp_path / "run1" / "docker-stats.tsv").write_text('t\t{"Name":"api","CPUPerc":"12.5%"}\nbroken\nt\t{"Name":"api","CPUPerc":"80.25%"}\n')
    rates = files.cache_hit_rates(files.cache_counters(spark, f"{tmp_path}/*/*/api-metrics.prom")).first()
    assert (rates["run"], rates["hit_rate"]) == ("run1", 75.0)
    assert [tuple(r) for r in files.resource_peaks(spark, f"{tmp_path}/*/docker-stats.tsv").collect()] == [("run1", "api", 80.25)]


def test_bad_json_line_fails_or_is_set_aside(spark, tmp_path):
    from quillspark.sources import files

    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(tmp_path), "a int").collect()
    good, bad = files.quarantine_json_lines(spark, str(tmp_path), "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 3]
    assert [(r["line_number"], r["line"]) for r in bad.collect()] == [(2, '{"a": ')]


def test_bad_lines_are_numbered_per_file(spark, tmp_path):
    from quillspark.sources import files

    for n in range(3):
        (tmp_path / f"{n}.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": \n{"a": 3}\n')
    (tmp_path / "long.jsonl").write_text('{"a": 1}\n' * 5000 + "{\n")
    for most in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            _, bad = files.quarantine_json_lines(spark, str(tmp_path), "a int")
            assert sorted((r["file"].rsplit("/", 1)[1], r["line_number"]) for r in bad.collect()) == [("0.jsonl", 3), ("1.jsonl", 3), ("2.jsonl", 3), ("long.jsonl", 5001)]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_existing_run_is_refused(spark, tmp_path):
    from quillspark.sources import files

    rows = spark.range(3)
    files.write_run({"events": rows}, str(tmp_path), "r1")
    with pytest.raises(Exception):
        files.write_run({"events": rows}, str(tmp_path), "r1")
    files.write_run({"events": rows.limit(1)}, str(tmp_path), "r1", replace=True)
    assert files.read_run(spark, str(tmp_path), "events", "id bigint").count() == 1
    with pytest.raises(ValueError):
        files.write_run({"events": rows}, str(tmp_path), "../r1")
