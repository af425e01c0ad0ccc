"""Retrieval evaluation: per-case metrics, aggregates, gates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import contract as C
from quillspark.functions.text import round4


def gold_position(source_type: Column, position: Column) -> Column:
    """Positions tell media apart; for every other source they do not matter."""
    return F.when(source_type == "note_media", F.coalesce(position, F.lit(0))).otherwise(F.lit(0)).cast("int")


def distinct_gold(gold: DataFrame) -> DataFrame:
    return gold.select(
        "query_id", "source_type", "note_id", gold_position(F.col("source_type"), F.col("position")).alias("position")
    ).distinct()


def dcg(relevant_ranks: Column) -> Column:
    """Discounted gain of an array of 1-based ranks that hold a relevant result."""
    return F.aggregate(relevant_ranks, F.lit(0.0), lambda acc, r: acc + 1.0 / F.log2(r.cast("double") + 1.0))


def case_metrics(cases: DataFrame, gold: DataFrame, cited: DataFrame, leaks: DataFrame, k: int = 10) -> DataFrame:
    """One row per case.

    ``cases``: query_id, task_type. ``cited``: one row per citation of a result with
    query_id, rank, source_type, note_id, position, valid. ``leaks``: query_id,
    unauthorized_results, metadata_leak from the anonymous pass.
    """
    unique = distinct_gold(gold)
    top = cited.where(F.col("rank") <= k).withColumn("position", gold_position(F.col("source_type"), F.col("position")))
    key = ["query_id", "source_type", "note_id", "position"]
    judged = top.join(unique.withColumn("_gold", F.lit(True)), key, "left").withColumn("relevant", F.coalesce("_gold", F.lit(False)))
    per_case = judged.groupBy("query_id").agg(
        F.count("*").alias("citation_count"),
        F.count_if("valid").alias("valid_citations"),
        F.count_if("relevant").alias("relevant_citations"),
        F.count_distinct(F.when(F.col("relevant"), F.struct("source_type", "note_id", "position"))).alias("gold_found"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_relevant_rank"),
        F.sort_array(F.collect_set(F.when(F.col("relevant"), F.col("rank")))).alias("relevant_ranks"),
        F.count_distinct("rank").alias("result_count"),
    )
    gold_counts = unique.groupBy("query_id").agg(F.count("*").alias("gold_count"))
    zeros = ["gold_count", "citation_count", "valid_citations", "relevant_citations", "gold_found", "result_count", "unauthorized_results"]
    rows = (
        cases.join(gold_counts, "query_id", "left").join(per_case, "query_id", "left").join(leaks, "query_id", "left")
        .fillna(0, zeros).fillna(False, ["metadata_leak"])
    )
    has_gold = F.col("gold_count") > 0
    ideal = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), F.least(F.col("gold_count"), F.lit(k).cast("bigint")))),
        F.lit(0.0), lambda acc, r: acc + 1.0 / F.log2(r.cast("double") + 1.0),
    )
    empty_precision = F.when(has_gold, 0.0).otherwise(1.0)

    def precision(part: str) -> Column:
        return F.when(F.col("citation_count") > 0, F.col(part) / F.col("citation_count")).otherwise(empty_precision)

    return rows.select(
        *cases.columns, "gold_count", "result_count", "citation_count", "valid_citations", "relevant_citations",
        F.when(has_gold, F.col("gold_found") / F.col("gold_count")).otherwise(0.0).alias("recall"),
        F.coalesce(1.0 / F.col("first_relevant_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(has_gold, dcg(F.coalesce("relevant_ranks", F.array().cast("array<bigint>"))) / ideal).otherwise(0.0).alias("ndcg"),
        precision("valid_citations").alias("citation_precision"), precision("relevant_citations").alias("source_precision"),
        (F.col("result_count") == 0).alias("rejected"),
        ((F.col("unauthorized_results") > 0) | F.col("metadata_leak")).alias("authorization_leak"),
    ).withColumn("failure_category", failure_category())


def failure_category() -> Column:
    """First rule that applies; empty for a good case."""
    gold = F.col("gold_count")
    return (
        F.when((F.col("task_type") == C.AUTHORIZATION_TASK) & F.col("authorization_leak"), "authorization_leak")
        .when(F.col("task_type").isin(C.NO_RELEVANT_TASKS) & ~F.col("rejected"), "false_positive_no_relevant")
        .when((gold > 0) & (F.col("recall") == 0), "missed_all_gold")
        .when((gold > 1) & (F.col("recall") < 1), "partial_gold_recall")
        .when((gold > 0) & (F.col("reciprocal_rank") < 1), "ranking_error")
        .when((F.col("citation_count") > 0) & (F.col("source_precision") < 1), "citation_contamination")
        .otherwise("")
    )


def failure_histogram(case_rows: DataFrame) -> DataFrame:
    return case_rows.where("failure_category <> ''").groupBy("failure_category").agg(F.count("*").alias("case_count"))


def aggregate_metrics(case_rows: DataFrame) -> DataFrame:
    """Overall and per task in one pass; the overall row has task ``(all)``."""
    gold = F.col("gold_count") > 0

    def mean_if(condition: Column, value: Column) -> Column:
        return round4(F.coalesce(F.avg(F.when(condition, value)), F.lit(0.0)))

    def micro(part: str) -> Column:
        total = F.sum("citation_count")
        return round4(F.when(total > 0, F.sum(part) / total).otherwise(1.0))

    no_relevant = F.col("task_type").isin(C.NO_RELEVANT_TASKS)
    insufficient = F.col("task_type") == C.INSUFFICIENT_TASK
    authorization = F.col("task_type") == C.AUTHORIZATION_TASK
    grouped = case_rows.groupingSets([["task_type"], []], "task_type").agg(
        F.grouping_id().alias("_overall"),
        F.count("*").alias("case_count"), F.count_if(gold).alias("gold_case_count"),
        mean_if(gold, F.col("recall")).alias("recall_at_10"),
        mean_if(gold, F.col("reciprocal_rank")).alias("mrr_at_10"),
        mean_if(gold, F.col("ndcg")).alias("ndcg_at_10"),
        micro("valid_citations").alias("citation_precision"), micro("relevant_citations").alias("source_precision"),
        mean_if(no_relevant, F.col("rejected").cast("double")).alias("no_relevant_rejection_accuracy"),
        mean_if(insufficient, F.col("recall")).alias("insufficient_evidence_source_recall"),
        mean_if(authorization, (~F.col("authorization_leak")).cast("double")).alias("authorization_non_leakage_accuracy"),
    )
    return grouped.withColumn(
        "task_type", F.when(F.col("_overall") == 1, "(all)").otherwise(F.col("task_type"))
    ).drop("_overall")


def development_gate(metrics: DataFrame, dataset_contract_matched: bool = True) -> DataFrame:
    """One row per check of the overall metrics."""
    overall = metrics.where("task_type = '(all)'")
    entries = ", ".join(f"'{name}', {name}, {floor}D" for name, floor in C.DEVELOPMENT_GATES.items())
    matched = 1.0 if dataset_contract_matched else 0.0
    entries += f", 'dataset_contract_matched', {matched}D, 1.0D"
    return overall.selectExpr(
        f"stack({len(C.DEVELOPMENT_GATES) + 1}, {entries}) AS (check_name, value, minimum)"
    ).withColumn("passed", F.col("value") >= F.col("minimum"))


def compare_runs(left: DataFrame, right: DataFrame, measures: list[str]) -> DataFrame:
    """Metric by metric difference of two runs under the same contract."""
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in measures)
    long = f"stack({len(measures)}, {pairs}) AS (metric, value)"
    a = left.selectExpr("task_type", long).withColumnRenamed("value", "left_value")
    b = right.selectExpr("task_type", long).withColumnRenamed("value", "right_value")
    return a.join(b, ["task_type", "metric"], "full_outer").withColumn("difference", F.col("right_value") - F.col("left_value"))


def save_report(metrics: DataFrame, case_rows: DataFrame, run_id: str, path: str) -> None:
    """Report and per-case results of one run; an existing run is never overwritten."""
    for name, rows in (("reports", metrics), ("case_results", case_rows)):
        rows.write.mode("errorifexists").parquet(f"{path}/{name}/run_id={run_id}")
