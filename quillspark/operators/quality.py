"""Distribution reports, quality gates, request-log summaries, retention and contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import contract as C
from quillspark.functions.text import round4
from quillspark.operators.ordering import nearest_rank, running, shifted, with_row


def distribution(events: DataFrame, dimensions: list[str]) -> DataFrame:
    """Event counts in total and by each dimension, in one pass."""
    grouped = events.groupingSets([[], *[[d] for d in dimensions]], *dimensions).agg(
        F.grouping_id().alias("_set"), F.count("*").alias("events")
    )
    full = (1 << len(dimensions)) - 1
    kind, label = F.lit("total"), F.lit("")
    for position, name in enumerate(dimensions):
        only = full ^ (1 << (len(dimensions) - 1 - position))
        kind = F.when(F.col("_set") == only, name).otherwise(kind)
        label = F.when(F.col("_set") == only, F.col(name).cast("string")).otherwise(label)
    return grouped.select(kind.alias("dimension"), label.alias("label"), "events")


def top_share(events: DataFrame, subject: str, population: DataFrame, fraction: float) -> DataFrame:
    """Share of events held by the most active ``fraction`` of the population.

    ``population`` is one row with ``size``. Subjects are grouped by their count first, so
    only as many rows as there are different counts are ordered.
    """
    per_subject = events.where(F.col(subject).isNotNull()).groupBy(subject).agg(F.count("*").alias("n"))
    levels = per_subject.groupBy("n").agg(F.count("*").alias("subjects"))
    summed = running(levels, [], [F.desc("n")], rank=None, sums={"upto": F.col("subjects")})
    take = F.greatest(F.lit(1), F.ceil(F.round(F.col("size") * fraction, 9)))
    taken = F.greatest(F.lit(0), F.least(F.col("subjects"), take - (F.col("upto") - F.col("subjects"))))
    return with_row(summed, population).agg(
        round4(F.sum(taken * F.col("n")) / F.sum(F.col("subjects") * F.col("n"))).alias("share")
    )


def session_lengths(events: DataFrame, burst: Column) -> DataFrame:
    """Average, median and 95th percentile events per session, and the burst share."""
    per_session = events.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(burst).alias("b"))
    totals = per_session.agg(
        round4(F.sum("n") / F.count("*")).alias("average_events"), round4(F.sum("b") / F.sum("n")).alias("burst_ratio")
    )
    return with_row(totals, nearest_rank(per_session, [], "n", {"p50_events": 0.50, "p95_events": 0.95}))


def transitions(events: DataFrame) -> DataFrame:
    """Counts of consecutive event types inside sessions, ``start->`` first."""
    ranked = running(events.select("session_id", "occurred_at", "event_id", "event_type"), ["session_id"], ["occurred_at", "event_id"])
    stepped = shifted(ranked, ["session_id"], "rn", {"previous": "event_type"})
    name = F.concat(F.coalesce("previous", F.lit("start")), F.lit("->"), F.col("event_type"))
    return stepped.groupBy(name.alias("transition")).agg(F.count("*").alias("events"))


def sequence_violations(events: DataFrame, first_types: list[str]) -> DataFrame:
    """Sessions that do not start at one, have gaps or repeats, or begin with a wrong event."""
    per_session = events.groupBy("session_id").agg(
        F.min("sequence_no").alias("low"), F.max("sequence_no").alias("high"), F.count("*").alias("n"),
        F.count_distinct("sequence_no").alias("distinct_numbers"), F.count_distinct("source_event_id").alias("distinct_ids"),
        F.min_by("event_type", "sequence_no").alias("first_type"),
    )
    found = F.array_compact(F.array(
        F.when(F.col("low") != 1, "does_not_start_at_one"),
        F.when((F.col("high") - F.col("low") + 1 != F.col("n")) | (F.col("distinct_numbers") != F.col("n")), "not_contiguous"),
        F.when(F.col("distinct_ids") != F.col("n"), "duplicate_event_id"),
        F.when(~F.col("first_type").isin(first_types), "wrong_first_event"),
    ))
    return per_session.select("session_id", F.explode(found).alias("violation"))


def checks(row: DataFrame, gates: list[tuple[str, str, str, str]]) -> DataFrame:
    """Gate table from a one-row report: (name, value column, target text, SQL condition)."""
    entries = ", ".join(f"'{name}', CAST({value} AS DOUBLE), '{target}', {condition}" for name, value, target, condition in gates)
    return row.selectExpr(f"stack({len(gates)}, {entries}) AS (name, value, target, passed)")


def distribution_gates(report: DataFrame, organic: bool, burst_fraction: float = 0.0) -> DataFrame:
    """Limits every simulated or real event stream must keep (one-row report in)."""
    gates = list(C.DISTRIBUTION_GATES)
    if organic:
        gates.append(("organic_burst_ratio", "burst_ratio", "= 0", "burst_ratio = 0"))
    else:
        floor = burst_fraction * 0.65
        gates.append(("burst_visibility", "burst_ratio", f">= {floor:.2f}", f"burst_ratio >= {floor}"))
    return checks(report, gates)


def corpus_report(notes: DataFrame, media: DataFrame, comments: DataFrame, cases: DataFrame) -> DataFrame:
    """One-row quality report of a corpus.

    ``notes``: note_id, category, title, body, subject, and the phrases a comment may take up
    (topics, praise, concerns; arrays). ``media``: ocr_text. ``comments``: note_id, content.
    ``cases``: task_type. A comment is aligned when it holds its note's subject or one of the phrases.
    """
    note_part = notes.agg(
        F.count("*").alias("notes"), F.count_distinct("category").alias("categories"),
        round4(F.count_distinct("title") / F.count("*")).alias("unique_title_ratio"),
        F.min(F.char_length("body")).cast("bigint").alias("minimum_body"), round4(F.avg(F.char_length("body"))).alias("average_body"),
    )
    media_part = media.agg(F.count("*").alias("media"), F.min(F.char_length("ocr_text")).cast("bigint").alias("minimum_ocr"))
    copies = comments.groupBy(F.sha2("content", 256)).agg(F.count("*").alias("n"))
    copy_part = copies.agg(
        F.sum("n").alias("comments"), round4(F.sum(F.col("n") - 1) / F.sum("n")).alias("duplicate_comment_ratio"))
    phrases = F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("topics", "praise", "concerns")])
    taken_up = F.exists(phrases, lambda p: (p != "") & F.contains("content", p))
    aligned = (F.contains("content", "subject") & (F.col("subject") != "")) | taken_up
    comment_part = comments.join(notes.select("note_id", "subject", "topics", "praise", "concerns"), "note_id", "left").agg(
        F.min(F.char_length("content")).cast("bigint").alias("minimum_comment"),
        round4(F.avg(F.when(F.coalesce(aligned, F.lit(False)), 1.0).otherwise(0.0))).alias("semantic_alignment_ratio"),
    )
    case_part = cases.agg(F.count("*").alias("eval_cases"), F.count_distinct("task_type").alias("eval_tasks"))
    return with_row(with_row(with_row(with_row(note_part, media_part), copy_part), comment_part), case_part)


def corpus_counts(notes: DataFrame, comments: DataFrame, cases: DataFrame) -> DataFrame:
    """``kind, value, rows``: notes per category, comments per intent and sentiment, cases per task."""
    found = None
    for kind, rows, column in (("category", notes, "category"), ("intent", comments, "intent"), ("sentiment", comments, "sentiment"), ("task", cases, "task_type")):
        part = rows.groupBy(F.coalesce(F.col(column), F.lit("")).alias("value")).agg(F.count("*").alias("rows")).select(F.lit(kind).alias("kind"), "value", "rows")
        found = part if found is None else found.unionByName(part)
    return found


def corpus_gates(report: DataFrame, expected_categories: int, cases_per_note: int) -> DataFrame:
    tasks = min(C.MOST_EVAL_TASKS, cases_per_note)
    return checks(report, [
        ("category_diversity", "categories", f">= {expected_categories}", f"categories >= {expected_categories}"), *C.CORPUS_GATES,
        ("eval_task_diversity", "eval_tasks", f">= {tasks}", f"eval_tasks >= {tasks}"),
    ])


def request_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    """Error, timeout, rate-limit and invalid-citation rates and p95 latency per group."""
    rate = lambda flag: round4(F.avg(F.col(flag).cast("double")))
    rates = log.groupBy(*keys).agg(
        F.count("*").alias("requests"), rate("error").alias("error_rate"), rate("timeout").alias("timeout_rate"),
        rate("rate_limited").alias("rate_limited_rate"), rate("invalid_citation").alias("invalid_citation_rate"),
    )
    slow = nearest_rank(log, keys, "latency_ms", {"p95_latency_ms": 0.95})
    return rates.join(slow, keys)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule; a rule is a condition that must hold (unknown counts as broken)."""
    found = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.explode(found).alias("violation"))


def violation_counts(broken: DataFrame) -> DataFrame:
    return broken.groupBy("violation").agg(F.count("*").alias("rows"))


def expired(targets: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Rows due for deletion per target; nothing is changed."""
    result = None
    for name, (rows, condition) in targets.items():
        part = rows.agg(F.count("*").alias("total"), F.count_if(condition).alias("expired")).select(F.lit(name).alias("target"), "total", "expired")
        result = part if result is None else result.unionByName(part)
    return result


def dead_session(now: Column) -> Column:
    """Whether a login session (revoked, expires_at) can no longer be used."""
    return F.coalesce(F.col("revoked"), F.lit(False)) | (F.col("expires_at") < now)


def purge(rows: DataFrame, condition: Column) -> DataFrame:
    """What an applied retention run keeps; rows of unknown age stay."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def clean_notes(rows: DataFrame) -> DataFrame:
    """Trimmed text, lowercased tokens, defaults for project and visibility, and the same for media where there are any.

    ``media`` is an array of (media_type, url, caption, ocr_text, position): types are lowercased and
    default to images, positions that are not positive become the place in the array, from 1.
    """
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    cleaned = rows.withColumn("title", F.trim("title")).withColumn("body", F.trim("body")).withColumn(
        "category", F.lower(F.trim("category"))
    ).withColumn("visibility", F.lower(F.coalesce(blank("visibility"), F.lit(C.DEFAULT_VISIBILITY)))).withColumn(
        "tags", F.array_distinct(F.filter(F.transform("tags", lambda t: F.lower(F.trim(t))), lambda t: t != ""))
    )
    if "project_id" in rows.columns:
        cleaned = cleaned.withColumn("project_id", F.when(F.col("project_id") > 0, F.col("project_id")).otherwise(F.lit(1)))
    if "media" in rows.columns:
        cleaned = cleaned.withColumn("media", F.transform("media", lambda m, i: F.struct(
            F.lower(F.coalesce(blank(m["media_type"]), F.lit(C.DEFAULT_MEDIA_TYPE))).alias("media_type"), F.trim(m["url"]).alias("url"), F.trim(m["caption"]).alias("caption"),
            F.trim(m["ocr_text"]).alias("ocr_text"), F.when(m["position"] > 0, m["position"]).otherwise(i + 1).cast("int").alias("position"))))
    return cleaned


def note_rules(with_media: bool = False) -> dict[str, Column]:
    """What a cleaned note must satisfy: required fields, known visibility, lengths in bytes."""
    rules = {"author_id": F.col("author_id") > 0, "visibility": F.col("visibility").isin(*C.VISIBILITIES)}
    for name, cap in C.NOTE_CAPS.items():
        rules[f"{name}_required"] = F.coalesce(F.col(name), F.lit("")) != ""
        rules[f"{name}_length"] = F.octet_length(F.coalesce(F.col(name), F.lit(""))) <= cap
    if with_media:
        for name, cap in C.MEDIA_CAPS.items():
            rules[f"media_{name}_length"] = _media_fit(name, cap)
    return rules


def _media_fit(name: str, cap: int) -> Column:
    return F.coalesce(F.forall("media", lambda m: F.octet_length(F.coalesce(m[name], F.lit(""))) <= cap), F.lit(True))


def backfill(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Null and empty strings replaced by their defaults."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(value)))
    return rows
