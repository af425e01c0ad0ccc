"""Reviewer agreement, review validation, adjudication and approved gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import contract as C
from quillspark.functions.text import round4
from quillspark.operators.ordering import with_row


def agreement(pairs: DataFrame, a: str, b: str, categories: int, stratum: str) -> DataFrame:
    """Exact agreement, Cohen's kappa and quadratic weighted kappa, overall and per stratum.

    ``pairs`` holds two integer ratings in ``0..categories-1`` per row. They are counted
    into a confusion table first; everything after that works on its few rows.
    """
    confusion = pairs.groupBy(stratum, a, b).agg(F.count("*").alias("n"))
    span = float((categories - 1) ** 2)
    distance = (F.col(a) - F.col(b)).cast("double")

    def marginal(rater: str, category: int) -> Column:
        return F.sum(F.when(F.col(rater) == category, F.col("n")).otherwise(0)).cast("double")

    sums = confusion.groupingSets([[stratum], []], stratum).agg(
        F.grouping_id().alias("_overall"),
        F.sum("n").alias("judgment_count"),
        F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("_agree"),
        F.sum(F.col("n") * distance * distance / span).alias("_distance"),
        *[marginal(a, c).alias(f"_a{c}") for c in range(categories)],
        *[marginal(b, c).alias(f"_b{c}") for c in range(categories)],
    )
    n = F.col("judgment_count").cast("double")
    observed = F.col("_agree") / n
    chance = F.lit(0.0)
    expected_distance = F.lit(0.0)
    for i in range(categories):
        chance = chance + F.col(f"_a{i}") / n * (F.col(f"_b{i}") / n)
        for j in range(categories):
            expected_distance = expected_distance + float((i - j) ** 2) / span * (F.col(f"_a{i}") / n) * (F.col(f"_b{j}") / n)
    observed_distance = F.col("_distance") / n
    kappa = F.when(chance == 1, F.when(observed == 1, 1.0).otherwise(0.0)).otherwise((observed - chance) / (1 - chance))
    weighted = F.when(expected_distance == 0, F.when(observed_distance == 0, 1.0).otherwise(0.0)).otherwise(
        1 - observed_distance / expected_distance
    )
    return sums.select(
        F.when(F.col("_overall") == 1, "(all)").otherwise(F.col(stratum)).alias(stratum),
        "judgment_count", round4(observed).alias("exact_agreement"), round4(kappa).alias("kappa"),
        round4(weighted).alias("quadratic_kappa"),
    )


def agreement_gates(answers: DataFrame, grades: DataFrame, stratum: str) -> DataFrame:
    """Whether every stratum (and the whole) reaches the kappa floors."""
    a = answers.select(stratum, F.col("kappa").alias("answerability_kappa"))
    g = grades.select(stratum, F.col("quadratic_kappa").alias("relevance_kappa"))
    return a.join(g, stratum, "full_outer").fillna(0.0, ["answerability_kappa", "relevance_kappa"]).withColumn(
        "passed",
        (F.col("answerability_kappa") >= C.ANSWERABILITY_KAPPA_GATE) & (F.col("relevance_kappa") >= C.RELEVANCE_KAPPA_GATE),
    )


def review_violations(expected: DataFrame, reviews: DataFrame) -> DataFrame:
    """Broken rules of a review file, one row per (case, rule).

    ``expected``: case_id, author_id, refs (array of strings). ``reviews``: case_id,
    reviewer_id, answerability, reviewed_at, judgments array<struct<ref, grade>>.
    """
    first = reviews.groupBy("case_id").agg(
        F.count("*").alias("_copies"), F.min(F.struct("reviewer_id", "answerability", "reviewed_at", "judgments")).alias("r")
    )
    reviewer = reviews.groupBy("reviewer_id").agg(F.count("*").alias("n")).agg(F.max_by("reviewer_id", F.struct("n", "reviewer_id")).alias("_main"))
    rows = with_row(expected.join(first, "case_id", "full_outer"), reviewer)
    refs = F.col("r.judgments.ref")
    known = F.col("author_id").isNotNull()
    given = F.col("_copies").isNotNull()
    rules = {
        "missing_review": known & ~given,
        "unknown_case": ~known & given,
        "duplicate_review": F.col("_copies") > 1,
        "reviewer_is_author": F.col("r.reviewer_id") == F.col("author_id"),
        "mixed_reviewers": given & (F.col("r.reviewer_id") != F.col("_main")),
        "incomplete_review": given & (~F.coalesce(F.col("r.answerability").isin("answerable", "insufficient_evidence", "no_relevant_document"), F.lit(False)) | F.col("r.reviewed_at").isNull()),
        "judgment_count": known & given & (F.size(refs) != F.size("refs")),
        "judgment_outside_pool": known & given & (F.size(F.array_except(refs, F.col("refs"))) > 0),
        "duplicate_judgment": known & given & (F.size(F.array_distinct(refs)) < F.size(refs)),
        "grade_out_of_range": given & F.exists("r.judgments", lambda j: (j["grade"] < 0) | (j["grade"] > 3)),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return rows.select("case_id", F.explode(found).alias("violation"))


def disagreements(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per case whether two reviewers differ in the answer or in any grade.

    Inputs: case_id, answerability, ref, grade (one row per judgment).
    """
    a = first.select("case_id", "ref", F.col("grade").alias("grade_a"), F.col("answerability").alias("answer_a"))
    b = second.select("case_id", "ref", F.col("grade").alias("grade_b"), F.col("answerability").alias("answer_b"))
    return a.join(b, ["case_id", "ref"]).groupBy("case_id").agg(
        F.bool_or(F.col("answer_a") != F.col("answer_b")).alias("answer_differs"),
        F.count_if(F.col("grade_a") != F.col("grade_b")).alias("grade_differences"),
    ).withColumn("disagrees", F.col("answer_differs") | (F.col("grade_differences") > 0))


def adjudication_queue(pairs: DataFrame, adjudicated: DataFrame) -> DataFrame:
    """Cases still to be adjudicated and whether they need a decision or a confirmation."""
    return pairs.join(adjudicated.select("case_id"), "case_id", "left_anti").select(
        "case_id", F.when(F.col("disagrees"), "resolution_required").otherwise("confirmation_required").alias("status")
    )


def label_violations(judgments: DataFrame) -> DataFrame:
    """Adjudicated cases whose label contradicts the task.

    Input: one row per judgment with case_id, task_type, answerability, grade. Only counts
    per case are kept.
    """
    cases = judgments.groupBy("case_id", "task_type", "answerability").agg(
        F.count_if(F.col("grade") >= 2).alias("high_grades"), F.count_if(F.col("grade") >= 1).alias("_related")
    )
    high, answer = F.col("high_grades"), F.col("answerability")
    ok = (
        F.when(F.col("task_type").isin(C.NO_RELEVANT_TASKS), (answer == "no_relevant_document") & (high == 0))
        .when(F.col("task_type") == C.INSUFFICIENT_TASK, (answer == "insufficient_evidence") & (high == 0) & (F.col("_related") > 0))
        .otherwise((answer == "answerable") & (high > 0))
    )
    return cases.where(~ok).drop("_related")


def approved_gold(judgments: DataFrame) -> DataFrame:
    """Gold sources, one row each: grade 2 and up, 1 and up where evidence is insufficient by design.

    Input: case_id, task_type, source_type, note_id, position, grade.
    """
    floor = F.when(F.col("task_type") == C.INSUFFICIENT_TASK, 1).otherwise(2)
    kept = judgments.where((F.col("grade") >= floor) & ~F.col("task_type").isin(C.NO_RELEVANT_TASKS))
    return kept.select("case_id", "source_type", "note_id", "position").distinct()
