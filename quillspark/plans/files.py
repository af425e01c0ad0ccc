"""Sources and sinks driven with rows of the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quillspark.functions.text import body_sections
from quillspark.operators import evaluation, lexical, manifest
from quillspark.plans.registry import REGISTRY
from quillspark.plans.streams import note_list, processing_time, workspace, write_messages
from quillspark.sources import files, model
from quillspark.streaming import envelopes, pipeline

query, define = REGISTRY.query, REGISTRY.define
DOC = "doc_id bigint, lang string, text string"


@query("json_lines_roundtrip", "S2 S3", "SELECT doc_id, lang, text FROM documents")
def json_lines_roundtrip(spark, sf):
    path = f"{workspace(spark)}/documents"
    files.write_json_lines(model.table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    return files.read_json_lines(spark, path, DOC)


@query("json_lines_quarantine", "S2", """
    SELECT lang, count(*) FILTER (WHERE doc_id % 10 <> 3) AS good, count(*) FILTER (WHERE doc_id % 10 = 3) AS bad FROM documents GROUP BY 1""")
def json_lines_quarantine(spark, sf):
    """Every tenth line lost its closing brace."""
    path = f"{workspace(spark)}/documents"
    line = F.to_json(F.struct("doc_id", "lang"))
    rows = model.table(spark, sf, "documents")
    rows.select(F.when(F.col("doc_id") % 10 == 3, F.rtrim(line, F.lit("}"))).otherwise(line).alias("value")).write.text(path)
    good, bad = files.quarantine_json_lines(spark, path, "doc_id bigint, lang string")
    lost = bad.select(F.regexp_extract("line", '"lang":"([a-z]+)"', 1).alias("lang"), F.lit(0).alias("g"), F.lit(1).alias("b"))
    return good.select("lang", F.lit(1).alias("g"), F.lit(0).alias("b")).unionByName(lost).groupBy("lang").agg(
        F.sum("g").alias("good"), F.sum("b").alias("bad"))


@query("run_scoped_output", "S4", """
    SELECT 'run-a' AS run_id, event_type, count(*) AS events FROM behavior WHERE user_id % 2 = 0 GROUP BY 2 UNION ALL
    SELECT 'run-b', event_type, count(*) FROM behavior WHERE user_id % 2 = 1 GROUP BY 2""")
def run_scoped_output(spark, sf):
    root = workspace(spark)
    events = model.behavior(spark, sf).select("event_type", "user_id")
    files.write_run({"events": events}, root, "run-a")
    files.write_run({"events": events.where("user_id % 2 = 0")}, root, "run-a", replace=True)
    files.write_run({"events": events.where("user_id % 2 = 1")}, root, "run-b")
    return files.read_run(spark, root, "events", "event_type string, user_id bigint").groupBy("run_id", "event_type").agg(F.count("*").alias("events"))


@query("dead_letter_replay", "S8 S7", """
    SELECT event_id % 50 AS kind, count(*) AS letters FROM behavior WHERE event_id % 50 = 0 OR (user_id <= 0 AND event_id % 50 > 2) OR event_id % 50 IN (1, 2) GROUP BY 1""")
def dead_letter_replay(spark, sf):
    """Dead letters written back to the source directory are rejected again, one by one."""
    root = workspace(spark)
    write_messages(spark, sf, f"{root}/source")
    job = pipeline.EventPipeline(spark, f"{root}/first", note_list(spark, sf), processing_time())
    following = pipeline.run_available(envelopes.envelope_stream(spark, f"{root}/source"), job.apply, f"{root}/checkpoint")
    job.drain(following, spark)
    envelopes.replay_dead_letters(job.letters.read(), f"{root}/again")
    replayed = envelopes.parse(spark.read.text(f"{root}/again")).where("failure IS NOT NULL")
    number = F.regexp_extract("value", "evt-([0-9]+)", 1).cast("bigint")
    return replayed.groupBy((number % 50).alias("kind")).agg(F.count("*").alias("letters"))


@query("report_save", "S11", """
    SELECT o_orderpriority AS task_type, count(*) AS case_count, 'r1' AS run_id FROM orders GROUP BY 1""")
def report_save(spark, sf):
    root = workspace(spark)
    cases = model.table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("task_type"))
    metrics = cases.groupBy("task_type").agg(F.count("*").alias("case_count"))
    evaluation.save_report(metrics, cases, "r1", root)
    saved = spark.read.schema("query_id bigint, task_type string, run_id string").parquet(f"{root}/case_results")
    return saved.groupBy("task_type", "run_id").agg(F.count("*").alias("case_count"))


@query("load_run_index", "S13", """
    SELECT CAST(s_nationkey AS VARCHAR) AS run, count(*)::DOUBLE AS requests, max(s_acctbal) AS slowest,
           100 * (2 * count(*))::DOUBLE / (2 * count(*) + 1) AS hit_rate FROM supplier GROUP BY 1""")
def load_run_index(spark, sf):
    """Suppliers of a nation as one load run: summary document plus counters before and after."""
    root = workspace(spark)
    runs = model.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("run")).agg(
        F.count("*").alias("n"), F.max("s_acctbal").alias("slowest"))
    summary = F.to_json(F.struct(F.struct(
        F.struct(F.col("n").cast("double").alias("count")).alias("http_reqs"), F.struct(F.col("slowest").alias("max")).alias("http_req_duration")).alias("metrics")))
    runs.select("run", summary.alias("value")).repartition("run").write.partitionBy("run").text(f"{root}/summaries")
    lines = runs.select("run", F.explode(F.array(
        F.struct(F.lit("before").alias("moment"), F.lit('cache_hit_total{cache="note"} 5').alias("value")),
        F.struct(F.lit("before").alias("moment"), F.lit('cache_miss_total{cache="note"} 1').alias("value")),
        F.struct(F.lit("after").alias("moment"), F.format_string('cache_hit_total{cache="note"} %d', F.lit(5) + 2 * F.col("n")).alias("value")),
        F.struct(F.lit("after").alias("moment"), F.lit('cache_miss_total{cache="note"} 2').alias("value")))).alias("l"))
    lines.select("run", "l.moment", "l.value").repartition("run", "moment").write.partitionBy("run", "moment").text(f"{root}/counters")
    clean = lambda c: F.regexp_extract(c, "=(.*)$", 1)
    metrics = files.load_run_summaries(spark, f"{root}/summaries/*/*.txt").groupBy(clean("run").alias("run")).agg(
        F.max(F.when(F.col("metric") == "http_reqs", F.col("value"))).alias("requests"),
        F.max(F.when(F.col("metric") == "http_req_duration", F.col("value"))).alias("slowest"))
    counters = files.cache_counters(spark, f"{root}/counters/*/*/*.txt").withColumn("moment", clean("moment"))
    rates = files.cache_hit_rates(counters).select(clean("run").alias("run"), "hit_rate")
    return metrics.join(rates, "run")


@query("resource_peaks", "S13", """
    SELECT CAST(s_nationkey AS VARCHAR) AS run, 'box' || s_suppkey % 3 AS container, CAST(max(round(s_suppkey % 97 + 0.25, 2)) AS DOUBLE) AS peak_cpu FROM supplier GROUP BY 1, 2""")
def resource_peaks(spark, sf):
    """A sample line per supplier, with broken lines between, in one file per nation."""
    root, key = workspace(spark), F.col("s_suppkey")
    sample = F.to_json(F.struct(F.concat(F.lit("box"), (key % 3).cast("string")).alias("Name"), F.format_string("%d.25%%", key % 97).alias("CPUPerc")))
    lines = F.explode(F.array(F.concat(F.lit("t\t"), sample), F.lit("no tab here"), F.lit("t\t{broken")))
    model.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("run"), lines.alias("value")).repartition("run").write.partitionBy("run").text(f"{root}/stats")
    return files.resource_peaks(spark, f"{root}/stats/*/*.txt").withColumn("run", F.regexp_extract("run", "=(.*)$", 1))


@query("run_records", "S14", """
    SELECT run_id, status, note_facts, error_message FROM (VALUES ('job-1', 'running', CAST(NULL AS BIGINT), ''),
      ('job-1', 'completed', (SELECT count(*) FROM note_facts), ''), ('job-2', 'failed', NULL, 'window is empty')) v(run_id, status, note_facts, error_message)""")
def run_records(spark, sf):
    """Lineage rows of a finished and a failed job; the row count comes from the job's own metrics."""
    from pyspark.sql import Observation

    from quillspark.operators import facts
    from quillspark.plans.community import END, START

    root = workspace(spark)
    started = dt.datetime(2024, 2, 1)
    counted = Observation("facts")
    manifest.run_record(spark, "job-1", started, "running", {}).write.mode("append").parquet(f"{root}/runs")
    rows = facts.note_daily_facts(model.behavior(spark, sf), START, END).observe(counted, F.count(F.lit(1)).alias("note_facts"))
    rows.write.parquet(f"{root}/facts")
    manifest.run_record(spark, "job-1", started, "completed", counted.get).write.mode("append").parquet(f"{root}/runs")
    manifest.run_record(spark, "job-2", started, "failed", {}, "window is empty").write.mode("append").parquet(f"{root}/runs")
    return spark.read.parquet(f"{root}/runs").select("run_id", "status", F.col("counts")["note_facts"].alias("note_facts"), "error_message")


@query("filter_whitelist", "P9", """
    SELECT query_id, 'kind' || query_id % 3 AS unsupported FROM queries WHERE query_id % 3 > 0""")
def filter_whitelist(spark, sf):
    q = F.col("query_id")
    asked = model.query_table(spark, sf).select("query_id", F.array(F.lit("note"), F.when(q % 3 > 0, F.concat(F.lit("kind"), (q % 3).cast("string"))).otherwise(F.lit("note_media"))).alias("document_types"),
                                                F.lit(None).cast("array<string>").alias("source_types"))
    return lexical.filter_violations(asked)


@query("body_sections", "F19", """
    SELECT o_orderkey, o_custkey AS days, o_orderkey % 90 AS records, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey + 3 END AS budget,
           CASE WHEN o_orderkey % 3 = 0 THEN '全文' ELSE o_orderpriority END AS conclusion,
           CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN '原文描述的目标读者'
                WHEN o_orderkey % 13 = 0 THEN repeat('x', 60) ELSE '读者' || o_custkey END AS audience,
           CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 7 ELSE o_custkey + 1 END AS record_number FROM orders""")
def body_sections_query(spark, sf):
    """Templated bodies written from orders, then read back; parts are missing here and there."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    number = lambda c: c.cast("string")
    body = F.concat(
        # no audience; one of 120 bytes or more; the second mark first; a long one in few bytes
        F.when(key % 5 == 0, F.lit("")).when(key % 7 == 0, F.concat(F.lit("对"), F.repeat(F.lit("读"), 39), F.lit("而言，")))
        .when(key % 11 == 0, F.lit("而言，对读者而言")).when(key % 13 == 0, F.concat(F.lit("对"), F.repeat(F.lit("x"), 60), F.lit("而言对他而言")))
        .otherwise(F.concat(F.lit("对读者"), number(cust), F.lit("而言，"))), F.lit("做了"), number(cust), F.lit("天记录，共完成"), number(key % 90), F.lit("次记录"),
        F.when(key % 4 == 0, F.lit("。")).otherwise(F.concat(F.lit("，预算约"), number(cust + 3), F.lit("元。"))),
        F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("【先说结论】 "), F.col("o_orderpriority"), F.lit(" 【具体过程】略"))))
    title = F.when(key % 2 == 0, F.concat(F.lit("样本记录 "), number(key + 7))).otherwise(F.lit("无编号"))
    rows = model.table(spark, sf, "orders").select("o_orderkey", body.alias("body"), title.alias("title"), F.lit("全文").alias("whole"), (cust + 1).alias("note_id"))
    return rows.select("o_orderkey", *[c.alias(n) for n, c in body_sections("body", "title", "whole", "note_id").items()])
