"""Benchmark construction, sealing, verification and distinguishability audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions import contract as C
from quillspark.functions.leaves import json_leaves
from quillspark.functions.text import collapse_spaces, hash_parts, query_fingerprint, stable_index, typo_variant
from quillspark.operators.containment import containment
from quillspark.operators.ordering import running, top_per_group, with_row
from quillspark.session import materialize

ANCHOR_CHARS = 4


def with_peer(sources: DataFrame) -> DataFrame:
    """``sources`` with the columns of the source some places ahead in note order, going round."""
    ranked = running(sources, [], ["note_id"], rank="place").withColumn("place", F.col("place") - 1)
    counted = with_row(ranked, sources.agg(F.count("*").alias("total")))
    ahead = (F.col("place") + C.CASE_PEER_DISTANCE) % F.col("total")
    ahead = F.when(ahead == F.col("place"), (ahead + 1) % F.col("total")).otherwise(ahead)
    peers = ranked.select(F.col("place").alias("ahead"), *[F.col(c).alias(f"peer_{c}") for c in ("note_id", "subject", "metric", "audience", "conclusion")])
    return counted.withColumn("ahead", ahead).join(peers, "ahead").drop("ahead", "place", "total")


def generate_cases(sources: DataFrame) -> DataFrame:
    """Each source asked with the template of its task; equal queries keep their lowest note.

    ``sources``: note_id, project_id, task_type, subject, metric, audience, context, goal,
    conclusion. Blank slots take the task's fallback words. Comparing cases name two gold
    notes, unanswerable ones none.
    """
    values = {c: F.col(c) for c in ("subject", "metric", "audience", "context", "goal", "peer_subject", "peer_metric", "peer_audience")}
    values |= {"typo": typo_variant("subject"), "project": F.col("project_id").cast("string")}
    values |= {c: F.rtrim(F.col(c), F.lit(C.CASE_ANSWER_ENDS)) for c in ("conclusion", "peer_conclusion")}

    def filled(task: str, pattern: str) -> Column:
        text = F.lit(pattern)
        for slot, value in values.items():
            if f"{{{slot}}}" in pattern:
                instead = (C.CASE_FALLBACKS | C.CASE_OWN_FALLBACKS.get(task, {})).get(slot)
                value = value if instead is None else F.when(F.trim(value) != "", value).otherwise(F.lit(instead))
                text = F.replace(text, F.lit(f"{{{slot}}}"), value)
        return text

    query, answer, gold = F.lit(None).cast("string"), F.col("conclusion"), F.array("note_id")
    for task, pattern in C.CASE_TEMPLATES.items():
        query = F.when(F.col("task_type") == task, filled(task, pattern)).otherwise(query)
    for task, pattern in C.CASE_ANSWERS.items():
        answer = F.when(F.col("task_type") == task, filled(task, pattern)).otherwise(answer)
    gold = F.when(F.col("task_type") == "cross_note_compare", F.array("note_id", "peer_note_id")).when(F.col("task_type") == "no_answer", F.array().cast("array<bigint>")).otherwise(gold)
    cases = with_peer(sources).select("note_id", "task_type", query.alias("query"), answer.alias("expected_answer"), gold.alias("gold_notes")).where("query IS NOT NULL")
    return cases.groupBy("query").agg(F.min_by(F.struct("note_id", "task_type", "expected_answer", "gold_notes"), "note_id").alias("c")).select("query", "c.*")


def stratified_split(cases: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """Exactly ``quota`` development cases per task, picked by seeded hash; the rest is holdout."""
    keyed = cases.withColumn("_pick", hash_parts(F.lit(seed), F.col("case_id")))
    ranked = running(keyed, ["task_type"], ["_pick", "case_id"], "_rn")
    return ranked.join(quotas, "task_type").withColumn(
        "split", F.when(F.col("_rn") <= F.col("quota"), "development").otherwise("holdout")
    ).drop("_pick", "_rn", "quota")


def case_checksum(columns: list[str]) -> Column:
    """Checksum over the case's content columns (never over nonce or commitment)."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def seal(cases: DataFrame, content: list[str]) -> DataFrame:
    """Case checksum and nonce commitment."""
    return cases.withColumn("case_checksum", case_checksum(content)).withColumn(
        "commitment_hash", hash_parts("commitment_nonce", "case_checksum")
    )


def duplicates(cases: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Values that occur more than once, per kind of key.

    Values may be whole texts: their hashes are counted, and only repeated values are moved.
    """
    result = None
    for kind, value in columns.items():
        hashed = cases.select(value.alias("value")).withColumn("_hash", F.coalesce(F.sha2("value", 256), F.lit("")))
        repeated = hashed.groupBy("_hash").agg(F.count("*").alias("copies")).where("copies > 1")
        rows = hashed.join(repeated, "_hash").groupBy("_hash").agg(F.any_value("value").alias("value"), F.any_value("copies").alias("copies"))
        rows = rows.select(F.lit(kind).alias("kind"), "value", "copies")
        result = rows if result is None else result.unionByName(rows)
    return result


def quota_violations(cases: DataFrame, quotas: DataFrame) -> DataFrame:
    """Task and split combinations whose case count differs from the quota."""
    have = cases.groupBy("task_type", "split").agg(F.count("*").alias("case_count"))
    return have.join(quotas, ["task_type", "split"], "full_outer").fillna(0, ["case_count", "quota"]).where("case_count <> quota")


def manifest_counts(cases: DataFrame) -> DataFrame:
    """Cases by split, task and review state in one pass."""
    grouped = cases.groupingSets([["split"], ["task_type"], ["review_status"]], "split", "task_type", "review_status").agg(
        F.count("*").alias("case_count")
    )
    return grouped.select(
        F.when(F.col("split").isNotNull(), "split").when(F.col("task_type").isNotNull(), "task").otherwise("review").alias("kind"),
        F.coalesce("split", "task_type", "review_status").alias("label"), "case_count",
    )


def public_artifacts(sealed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full development cases, and the bare commitments of the holdout."""
    development = sealed.where("split = 'development'").drop("commitment_nonce")
    holdout = sealed.where("split = 'holdout'").select("case_id", "task_type", "commitment_hash")
    return development, holdout


def verify_cases(cases: DataFrame, content: list[str]) -> DataFrame:
    """Cases whose stored checksum or commitment no longer fits their content."""
    checked = cases.withColumn("_checksum", case_checksum(content)).withColumn("_commitment", hash_parts("commitment_nonce", "case_checksum"))
    broken = F.array_compact(F.array(
        F.when(F.col("_checksum") != F.col("case_checksum"), "checksum"),
        F.when(F.col("_commitment") != F.col("commitment_hash"), "commitment"),
    ))
    return checked.select("case_id", F.explode(broken).alias("violation"))


def holdout_match(sealed: DataFrame, submitted: DataFrame) -> DataFrame:
    """Sealed and submitted commitments compared: lost, foreign and repeated ones."""
    a, b = sealed.select("commitment_hash"), submitted.select("commitment_hash")
    copies = b.groupBy("commitment_hash").agg(F.count("*").alias("n"))
    return (
        a.join(b, "commitment_hash", "left_anti").select("commitment_hash", F.lit("missing").alias("problem"))
        .unionByName(b.join(a, "commitment_hash", "left_anti").select("commitment_hash", F.lit("foreign").alias("problem")))
        .unionByName(copies.where("n > 1").select("commitment_hash", F.lit("repeated").alias("problem")))
    )


def task_rule_violations(cases: DataFrame) -> DataFrame:
    """Cases whose gold or metadata does not suit their task.

    Input: case_id, task_type, answerable, gold_types (array), required_project_id,
    authorized_expected, unauthorized_expected.
    """
    gold = F.size("gold_types")
    not_answerable = ~F.coalesce("answerable", F.lit(True))
    ok = (
        F.when(F.col("task_type").isin(C.NO_RELEVANT_TASKS), (gold == 0) & not_answerable)
        .when(F.col("task_type") == C.INSUFFICIENT_TASK, (gold > 0) & not_answerable)
        .when(
            F.col("task_type") == C.AUTHORIZATION_TASK,
            (gold > 0) & (F.coalesce("required_project_id", F.lit(0)) > 0) & (F.coalesce("authorized_expected", F.lit(0)) > 0)
            & F.coalesce(F.col("unauthorized_expected") == 0, F.lit(False)),
        )
        .when(F.col("task_type") == "ocr_detail", F.array_contains("gold_types", "note_media"))
        .otherwise((gold > 0) & F.coalesce("answerable", F.lit(True)))
    )
    known = F.forall("gold_types", lambda t: t.isin("note", "note_body", "note_media", "note_comment"))
    return cases.where(~(ok & known)).select("case_id", "task_type")


def candidate_pool(targets: DataFrame, sources: DataFrame, media: DataFrame, size: int = 6) -> DataFrame:
    """At most ``size`` candidate sources per case: target, same-subject peers, media, distractors.

    ``targets``: case_id, note_id, subject. ``sources``: note_id, subject. Peers of a subject
    come from a ring: every source knows the next few of its subject, so no case ever joins
    with a whole subject. Distractors are the sources at hashed positions of the whole list.
    """
    listed = running(sources, ["subject"], ["note_id"], "subject_no")
    sizes = listed.groupBy("subject").agg(F.max("subject_no").alias("subject_size"))
    own = targets.join(listed.select("note_id", "subject_no"), "note_id").join(sizes, "subject")
    peers = own.select("case_id", "subject", "note_id", "subject_no", "subject_size", F.explode(F.array(F.lit(1), F.lit(2))).alias("step")).select(
        "case_id", "subject", F.col("note_id").alias("target"),
        ((F.col("subject_no") - 1 + F.col("step")) % F.col("subject_size") + 1).alias("subject_no"), "step",
    ).join(listed, ["subject", "subject_no"]).where("note_id <> target").select(
        "case_id", F.lit("note").alias("source_type"), F.col("note_id").alias("source_id"), (F.col("step") + 0).alias("tier")
    )
    numbered = running(sources, [], ["note_id"], "source_no")
    total = numbered.agg(F.max("source_no").alias("total"))
    offsets = F.explode(F.sequence(F.lit(1), F.lit(size + 2))).alias("offset")
    distractors = with_row(targets.select("case_id", F.col("note_id").alias("target"), offsets), total).select(
        "case_id", "target", "offset",
        (F.pmod(stable_index(F.col("case_id").cast("string"), F.col("total")) + F.col("offset") * 193, F.col("total")) + 1).alias("source_no"),
    ).join(numbered, "source_no").where("note_id <> target").select(
        "case_id", F.lit("note").alias("source_type"), F.col("note_id").alias("source_id"), (F.col("offset") + 10).alias("tier")
    )
    target = targets.select("case_id", F.lit("note").alias("source_type"), F.col("note_id").alias("source_id"), F.lit(0).alias("tier"))
    pictures = targets.join(media.select("note_id", F.col("id").alias("media_id")), "note_id").select(
        "case_id", F.lit("note_media").alias("source_type"), F.col("media_id").alias("source_id"), F.lit(5).alias("tier")
    )
    pool = target.unionByName(peers).unionByName(pictures).unionByName(distractors)
    unique = pool.groupBy("case_id", "source_type", "source_id").agg(F.min("tier").alias("tier"))
    chosen = top_per_group(unique, ["case_id"], ["tier", "source_type", "source_id"], size)
    order = hash_parts(F.col("case_id"), "source_type", "source_id")
    return chosen.withColumn("shuffle_key", order).drop("rn")


def resolve_candidates(cases: DataFrame, members: DataFrame, citations: DataFrame) -> DataFrame:
    """Candidate references (a JSON list per case) checked against the snapshot and its citations."""
    refs = cases.select(
        "case_id", F.inline(F.from_json("candidate_refs", "array<struct<source_type:string,source_id:bigint,source_version:bigint>>"))
    )
    key = ["source_type", "source_id", "source_version"]
    known = members.select(*key).distinct().withColumn("in_snapshot", F.lit(True))
    cited = citations.select(*key).distinct().withColumn("cited", F.lit(True))
    return refs.join(known, key, "left").join(cited, key, "left").fillna(False, ["in_snapshot", "cited"]).withColumn(
        "resolved", F.col("in_snapshot") & F.col("cited")
    )


def blind_assignments(cases: DataFrame, refs: DataFrame, reviewers: list[str]) -> DataFrame:
    """The cases once per reviewer, without author, answer or split; candidates in hashed order."""
    lists = refs.groupBy("case_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("shuffle_key", "source_type", "source_id"))),
                    lambda r: F.struct(r["source_type"].alias("source_type"), r["source_id"].alias("source_id"))).alias("candidates")
    )
    return cases.select("case_id", "task_type", "query", F.explode(F.array(*[F.lit(r) for r in reviewers])).alias("reviewer_id")).join(lists, "case_id")


def draft_corpus(sources: DataFrame, citations: DataFrame) -> DataFrame:
    """Frozen notes and media that some chunk cites, with their parsed payload."""
    cited = citations.select("source_type", "source_id", "source_version").distinct()
    rows = sources.where(F.col("source_type").isin("note", "note_media")).join(cited, ["source_type", "source_id", "source_version"], "left_semi")
    payload = F.from_json("source_payload", "title string, body string, category string, caption string, ocr_text string, note_id bigint, position int")
    return rows.withColumn("payload", payload)


def stride_pairs(items: DataFrame, key: str, stride: int = 10) -> DataFrame:
    """Item ``i`` with item ``i + stride`` for every ``stride``-th item in key order."""
    ranked = running(items.select(key), [], [key], "rn")
    right = ranked.select((F.col("rn") - stride).alias("rn"), F.col(key).alias(f"paired_{key}"))
    return ranked.where((F.col("rn") - 1) % stride == 0).join(right, "rn").select(key, f"paired_{key}")


def draft_report(cases: DataFrame, refs: DataFrame) -> DataFrame:
    """Candidates per case (least, most, all) and how many different ones there are."""
    per_case = refs.groupBy("case_id").agg(F.count("*").alias("n"))
    stats = cases.select("case_id").join(per_case, "case_id", "left").fillna(0, ["n"]).agg(
        F.count("*").alias("case_count"), F.min("n").alias("candidate_minimum"), F.max("n").alias("candidate_maximum"),
        F.sum("n").alias("candidate_total"),
    )
    return with_row(stats, refs.agg(F.count_distinct("source_type", "source_id").alias("distinct_candidates")))


def payload_anchors(scenarios: DataFrame) -> DataFrame:
    """Distinct normalized string leaves of at least four characters per note."""
    rows = scenarios.select("note_id", F.explode(json_leaves("payload")).alias("leaf")).select(
        "note_id", collapse_spaces("leaf").alias("anchor")
    )
    return rows.where(F.char_length("anchor") >= ANCHOR_CHARS).distinct()


def distinguishability(cases: DataFrame, gold: DataFrame, scenarios: DataFrame, anchors: DataFrame) -> DataFrame:
    """Pass, review, invalid or not applicable per case, with the counts behind it.

    ``cases``: case_id, query. ``gold``: case_id, note_id, topic. ``scenarios``: note_id,
    subject. ``anchors``: note_id, anchor (distinct).
    """
    cohort = scenarios.select("note_id", collapse_spaces("subject").alias("topic")).where("topic <> ''").groupBy("topic").agg(
        F.count_distinct("note_id").alias("cohort"))
    wanted = anchors.join(gold.select("note_id").distinct(), "note_id", "left_semi").select("anchor").distinct()
    found = containment(
        cases.select(F.col("case_id").alias("text_id"), F.col("query").alias("text")),
        wanted.select(F.sha2("anchor", 256).alias("anchor_id"), "anchor"),
    )
    named = gold.select("case_id", "note_id").distinct().join(anchors, "note_id").withColumn("anchor_id", F.sha2("anchor", 256))
    # notes are counted for the anchors some query holds, not for every line of the corpus
    met = materialize(named.join(found.withColumnRenamed("text_id", "case_id"), ["case_id", "anchor_id"]).select("case_id", "anchor").distinct())
    spread = anchors.join(met.select("anchor").distinct(), "anchor", "left_semi").groupBy("anchor").agg(F.count("*").alias("notes"))
    matched = met.join(spread, "anchor").groupBy("case_id").agg(
        F.count_distinct("anchor").alias("matched_anchors"), F.count_distinct(F.when(F.col("notes") == 1, F.col("anchor"))).alias("unique_anchors"))
    known = scenarios.select("note_id").distinct().withColumn("_known", F.lit(True))
    per_case = (
        gold.join(cases, "case_id").join(known, "note_id", "left")
        .join(cohort, collapse_spaces(gold["topic"]) == cohort["topic"], "left")
        .groupBy("case_id").agg(
            F.count_distinct("note_id").alias("gold_notes"),
            F.count_distinct(F.when(F.col("_known").isNull(), F.col("note_id"))).alias("missing_notes"),
            F.bool_or(F.col("_known") & F.contains("query", F.col("note_id").cast("string"))).alias("mentions_id"),
            F.max("cohort").alias("topic_cohort"),
        )
    )
    zeros = ["gold_notes", "missing_notes", "matched_anchors", "unique_anchors", "topic_cohort"]
    rows = cases.select("case_id").join(per_case, "case_id", "left").join(matched, "case_id", "left").fillna(0, zeros).fillna(False, ["mentions_id"])
    status = (
        F.when(F.col("gold_notes") == 0, "not_applicable").when(F.col("missing_notes") > 0, "invalid")
        .when(F.col("mentions_id") | (F.col("unique_anchors") > 0), "pass").otherwise("review")
    )
    return rows.withColumn("status", status)


def query_duplicates(cases: DataFrame) -> DataFrame:
    """Queries equal once case, spaces and punctuation are gone."""
    return duplicates(cases, {"normalized_query": query_fingerprint("query")})
