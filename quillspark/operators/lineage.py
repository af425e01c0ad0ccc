"""Audits of agent run lineage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.functions import contract as C
from quillspark.operators.ordering import running, shifted


def unsupported_claims(runs: DataFrame, claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Per succeeded run: claims that are not supported or lack a supporting citation."""
    supporting = citations.where("relationship = 'supports'").select("claim_id").distinct().withColumn("_cited", F.lit(True))
    succeeded = runs.where("status = 'succeeded'").select("run_id")
    broken = claims.join(supporting, "claim_id", "left").where((F.col("support_status") != "supported") | F.col("_cited").isNull())
    return broken.join(succeeded, "run_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("unsupported_claims"))


def citation_scope_violations(
    claim_citations: DataFrame, claims: DataFrame, runs: DataFrame, citations: DataFrame, run_documents: DataFrame
) -> DataFrame:
    """Claim citations outside the run's project or documents, or with a stale quote hash."""
    scoped = (
        claim_citations.join(claims.select("claim_id", "run_id"), "claim_id")
        .join(runs.select("run_id", F.col("project_id").alias("run_project"), "ingestion_run_id"), "run_id")
        .join(citations.select("citation_id", "project_id", "document_key", "quote_hash"), "citation_id", "left")
        .join(run_documents.select("ingestion_run_id", "document_key").distinct().withColumn("_linked", F.lit(True)), ["ingestion_run_id", "document_key"], "left")
    )
    problem = F.array_compact(F.array(
        F.when(F.col("quote_hash").isNull(), "unknown_citation"),
        F.when((F.col("project_id") != F.col("run_project")) | (F.col("quote_hash").isNotNull() & F.col("_linked").isNull()), "out_of_scope"),
        F.when(F.col("quote_hash") != F.col("quote_hash_snapshot"), "stale_quote"),
    ))
    return scoped.select("claim_id", "citation_id", F.explode(problem).alias("violation"))


def budget_overruns(runs: DataFrame, budgets: list[str]) -> DataFrame:
    """Runs that used more than allowed, one row per budget."""
    over = F.array_compact(F.array(*[F.when(F.col(f"used_{b}") > F.col(f"max_{b}"), F.lit(b)) for b in budgets]))
    return runs.select("run_id", F.explode(over).alias("budget"))


def invalid_transitions(history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Status changes that no rule allows; staying in a status is allowed."""
    ranked = running(history.select(*keys, *order, "status"), keys, order, "step")
    stepped = shifted(ranked, keys, "step", {"previous": "status"}).where("previous IS NOT NULL AND previous <> status")
    allowed = F.lit(False)
    for before, after in C.TRANSITIONS.items():
        allowed = allowed | ((F.col("previous") == before) & F.col("status").isin(after))
    return stepped.where(~allowed).select(*keys, "step", "previous", "status")


def idempotency_conflicts(requests: DataFrame) -> DataFrame:
    """Requester and key pairs used with more than one request body."""
    return requests.groupBy("requester", "idempotency_key").agg(F.count_distinct("request_hash").alias("hashes")).where("hashes > 1")
