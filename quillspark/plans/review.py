"""Evaluation, benchmark construction and reviewer agreement over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import contract as C
from quillspark.functions.text import hash_parts, query_fingerprint, stable_index, typo_variant
from quillspark.operators import agreement, benchmark, evaluation, evidence, ordering, search
from quillspark.plans import evidence as ev, retrieval as rt
from quillspark.plans.registry import REGISTRY
from quillspark.session import materialize
from quillspark.sources import model

query, define = REGISTRY.query, REGISTRY.define

# Evaluation --------------------------------------------------------------------------


def evaluated(spark, sf):
    """Case metrics of the lexical search, with the anonymous pass in the same run."""
    pairs = materialize(rt.gold_pairs(spark, sf))
    planned = rt.planned_cases(spark, sf, anonymous=True, gold=pairs)
    session = rt.searched(spark, sf, planned)
    rows = session.lexical_candidates(session.term_statistics())
    found = materialize(search.select_diverse(search.lexical_results(rows), C.THRESHOLDS["lexical"]).select(
        "query_id", "rank", "chunk_key", "note_id", "media_position"))
    cites = evidence.citations(rt.plain(session.chunks_of(found)))
    found = rt.plain(found)
    valid = search.quote_valid(
        F.col("citation_key"), F.col("quote"), F.col("quote_hash"), F.col("document_start_byte"), F.col("document_end_byte"),
        F.col("source_start_byte"), F.col("source_end_byte"))
    cited = found.join(cites.select("chunk_key", "source_type", valid.alias("valid")), "chunk_key").select(
        "query_id", "rank", "source_type", "note_id", F.col("media_position").alias("position"), "valid")
    asked = planned.where(F.col("query_id") < rt.ANONYMOUS).select("query_id", "task_type", "project_id")
    gold = pairs.join(
        model.documents(spark, sf).select(F.col("id").alias("note_id"), "project_id"), "note_id"
    ).join(asked, ["query_id", "project_id"]).select("query_id", F.lit("note").alias("source_type"), "note_id", F.lit(0).alias("position"))
    leaks = found.where(F.col("query_id") >= rt.ANONYMOUS).groupBy((F.col("query_id") - rt.ANONYMOUS).alias("query_id")).agg(
        F.count("*").alias("unauthorized_results")).withColumn("metadata_leak", F.lit(True))
    return evaluation.case_metrics(asked.drop("project_id"), gold, cited.where(F.col("query_id") < rt.ANONYMOUS), leaks)


define("case_gold", "SELECT g.query_id, g.note_id FROM gold_pairs g JOIN eval_cases c ON c.query_id = g.query_id AND c.project_id = g.project_id")
define("case_cites", """
    SELECT f.query_id, f.rank, f.note_id, g.note_id IS NOT NULL AND c.source_type = 'note' AS relevant
    FROM lexical_found f JOIN citation_rows c USING (chunk_key) LEFT JOIN case_gold g ON g.query_id = f.query_id AND g.note_id = f.note_id""")
define("case_scores", """
    SELECT e.query_id, e.task_type, coalesce(g.n, 0) AS gold_count, coalesce(c.results, 0) AS result_count, coalesce(c.n, 0) AS citation_count,
           coalesce(c.n, 0) AS valid_citations, coalesce(c.rel, 0) AS relevant_citations,
           CASE WHEN g.n > 0 THEN coalesce(c.found, 0)::DOUBLE / g.n ELSE 0 END AS recall,
           coalesce(1.0::DOUBLE / c.first_rank, 0) AS reciprocal_rank,
           CASE WHEN g.n > 0 THEN coalesce(c.dcg, 0) / list_sum(list_transform(range(1, least(g.n, 10) + 1), lambda r: 1.0::DOUBLE / log2(r + 1))) ELSE 0 END AS ndcg,
           CASE WHEN c.n > 0 THEN 1.0::DOUBLE WHEN g.n > 0 THEN 0 ELSE 1 END AS citation_precision,
           CASE WHEN c.n > 0 THEN c.rel::DOUBLE / c.n WHEN g.n > 0 THEN 0 ELSE 1 END AS source_precision,
           coalesce(c.results, 0) = 0 AS rejected, false AS authorization_leak
    FROM eval_cases e LEFT JOIN (SELECT query_id, count(*) AS n FROM case_gold GROUP BY 1) g USING (query_id)
    LEFT JOIN (SELECT query_id, count(*) AS n, count(DISTINCT rank) AS results, count(*) FILTER (WHERE relevant) AS rel,
                      count(DISTINCT note_id) FILTER (WHERE relevant) AS found, min(rank) FILTER (WHERE relevant) AS first_rank,
                      (SELECT sum(1.0::DOUBLE / log2(r + 1)) FROM (SELECT DISTINCT rank AS r FROM case_cites y WHERE y.query_id = x.query_id AND y.relevant)) AS dcg
               FROM case_cites x GROUP BY query_id) c USING (query_id)""")
define("case_failures", """
    SELECT *, CASE WHEN task_type = 'no_relevant_document' AND NOT rejected THEN 'false_positive_no_relevant'
         WHEN gold_count > 0 AND recall = 0 THEN 'missed_all_gold' WHEN gold_count > 1 AND recall < 1 THEN 'partial_gold_recall'
         WHEN gold_count > 0 AND reciprocal_rank < 1 THEN 'ranking_error' WHEN citation_count > 0 AND source_precision < 1 THEN 'citation_contamination'
         ELSE '' END AS failure_category FROM case_scores""")
SCORES = ["recall", "reciprocal_rank", "ndcg", "citation_precision", "source_precision"]
METRIC_SQL = """
    SELECT {task} AS task_type, count(*) AS case_count, count(*) FILTER (WHERE gold_count > 0) AS gold_case_count,
           round(coalesce(avg(recall) FILTER (WHERE gold_count > 0), 0), 4) AS recall_at_10,
           round(coalesce(avg(reciprocal_rank) FILTER (WHERE gold_count > 0), 0), 4) AS mrr_at_10,
           round(coalesce(avg(ndcg) FILTER (WHERE gold_count > 0), 0), 4) AS ndcg_at_10,
           round(CASE WHEN sum(citation_count) > 0 THEN sum(valid_citations)::DOUBLE / sum(citation_count) ELSE 1 END, 4) AS citation_precision,
           round(CASE WHEN sum(citation_count) > 0 THEN sum(relevant_citations)::DOUBLE / sum(citation_count) ELSE 1 END, 4) AS source_precision,
           round(coalesce(avg(rejected::INTEGER) FILTER (WHERE task_type = 'no_relevant_document'), 0), 4) AS no_relevant_rejection_accuracy,
           0.0::DOUBLE AS insufficient_evidence_source_recall,
           round(coalesce(avg((NOT authorization_leak)::INTEGER) FILTER (WHERE task_type = 'authorization_boundary'), 0), 4) AS authorization_non_leakage_accuracy
    FROM case_failures {group}"""
define("metric_rows", METRIC_SQL.format(task="task_type", group="GROUP BY task_type") + " UNION ALL " + METRIC_SQL.format(task="'(all)'", group=""))


@query("case_metrics", "E1 E2 E3 E4 E5 F26 F27", f"""
    SELECT query_id, task_type, gold_count, result_count, citation_count, relevant_citations,
           {", ".join(f"round({s}, 6) AS {s}" for s in SCORES)}, rejected, authorization_leak, failure_category FROM case_failures""")
def case_metrics(spark, sf):
    return evaluated(spark, sf).select(
        "query_id", "task_type", "gold_count", "result_count", "citation_count", "relevant_citations",
        *[F.round(s, 6).alias(s) for s in SCORES], "rejected", "authorization_leak", "failure_category")


@query("aggregate_metrics", "E6 A13", "SELECT * FROM metric_rows")
def aggregate_metrics(spark, sf):
    return evaluation.aggregate_metrics(evaluated(spark, sf))


@query("development_gate", "E7 A23", """
    SELECT check_name, value, minimum, value >= minimum AS passed FROM (
      SELECT unnest(['recall_at_10', 'mrr_at_10', 'no_relevant_rejection_accuracy', 'citation_precision', 'dataset_contract_matched']) AS check_name,
             unnest([recall_at_10, mrr_at_10, no_relevant_rejection_accuracy, citation_precision, 1.0::DOUBLE]) AS value,
             unnest([0.85::DOUBLE, 0.70::DOUBLE, 0.85::DOUBLE, 0.90::DOUBLE, 1.0::DOUBLE]) AS minimum FROM metric_rows WHERE task_type = '(all)')""")
def development_gate(spark, sf):
    return evaluation.development_gate(evaluation.aggregate_metrics(evaluated(spark, sf)))


@query("failure_histogram", "A15", """
    SELECT failure_category, count(*) AS case_count FROM case_failures WHERE failure_category <> '' GROUP BY 1""")
def failure_histogram(spark, sf):
    return evaluation.failure_histogram(evaluated(spark, sf))


def priority_metrics(spark, sf, status):
    return model.table(spark, sf, "orders").where(F.col("o_orderstatus") == status).groupBy(F.col("o_orderpriority").alias("task_type")).agg(
        F.count("*").alias("case_count"), F.max("o_custkey").alias("highest"))


@query("run_comparison", "E9", """
    SELECT task_type, metric, l AS left_value, r AS right_value, r - l AS difference FROM (
      SELECT o_orderpriority AS task_type, unnest(['case_count', 'highest']) AS metric,
             unnest([count(*) FILTER (WHERE o_orderstatus = 'O')::DOUBLE, max(o_custkey) FILTER (WHERE o_orderstatus = 'O')::DOUBLE]) AS l,
             unnest([count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE, max(o_custkey) FILTER (WHERE o_orderstatus = 'F')::DOUBLE]) AS r
      FROM orders GROUP BY 1)""")
def run_comparison(spark, sf):
    return evaluation.compare_runs(priority_metrics(spark, sf, "O"), priority_metrics(spark, sf, "F"), ["case_count", "highest"])


@query("nearest_rank_percentiles", "A14", """
    SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.95) AS p95, quantile_disc(o_totalprice, 0.99) AS p99
    FROM orders GROUP BY 1""")
def nearest_rank_percentiles(spark, sf):
    return ordering.nearest_rank(model.table(spark, sf, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice",
                                 {"p50": 0.50, "p95": 0.95, "p99": 0.99})


# Agreement ---------------------------------------------------------------------------

define("ratings", """
    SELECT l_returnflag || l_linestatus AS task_type, CAST(l_quantity AS INTEGER) % 4 AS grade_a,
           CASE WHEN l_tax < 0.055 THEN CAST(l_quantity AS INTEGER) % 4 ELSE CAST((CAST(l_quantity AS BIGINT) + l_suppkey) % 4 AS INTEGER) END AS grade_b,
           l_linenumber % 2 AS answer_a, CASE WHEN l_discount < 0.095 THEN l_linenumber % 2 ELSE (l_linenumber + 1) % 2 END AS answer_b,
           l_orderkey AS case_id, l_partkey AS source_id FROM lineitem""")
KAPPA_SQL = """
    SELECT {stratum} AS task_type, sum(n)::BIGINT AS judgment_count, round(sum(n) FILTER (WHERE a = b) / sum(n), 4) AS exact_agreement,
           CASE WHEN any_value(e) = 1 THEN CASE WHEN sum(n) FILTER (WHERE a <> b) > 0 THEN 0.0::DOUBLE ELSE 1 END
                ELSE round((coalesce(sum(n) FILTER (WHERE a = b), 0) / sum(n) - any_value(e)) / (1 - any_value(e)), 4) END AS kappa,
           CASE WHEN any_value(w) = 0 THEN CASE WHEN sum(n) FILTER (WHERE a <> b) > 0 THEN 0.0::DOUBLE ELSE 1 END
                ELSE round(1 - sum(n * (a - b) * (a - b)) / sum(n) / any_value(w), 4) END AS quadratic_kappa
    FROM (SELECT {stratum_in} AS s, {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {rows} GROUP BY 1, 2, 3) c
    JOIN (SELECT x.s, sum(CASE WHEN x.v = y.v THEN x.p * y.p ELSE 0 END) AS e, sum((x.v - y.v) * (x.v - y.v) * x.p * y.p) AS w
          FROM (SELECT s, v, n / sum(n) OVER (PARTITION BY s) AS p FROM (SELECT {stratum_in} AS s, {a} AS v, count(*)::DOUBLE AS n FROM {rows} GROUP BY 1, 2)) x
          JOIN (SELECT s, v, n / sum(n) OVER (PARTITION BY s) AS p FROM (SELECT {stratum_in} AS s, {b} AS v, count(*)::DOUBLE AS n FROM {rows} GROUP BY 1, 2)) y
          USING (s) GROUP BY 1) m USING (s) GROUP BY 1"""


def kappa_sql(rows, a, b):
    part = KAPPA_SQL.format(stratum="s", stratum_in="task_type", a=a, b=b, rows=rows)
    return part + " UNION ALL " + KAPPA_SQL.format(stratum="s", stratum_in="'(all)'", a=a, b=b, rows=rows)


define("grade_kappa", kappa_sql("ratings", "grade_a", "grade_b"))
define("answer_kappa", kappa_sql("ratings", "answer_a", "answer_b"))


def ratings(spark, sf):
    q = F.col("l_quantity").cast("int")
    number = F.col("l_linenumber")
    return model.table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("task_type"), (q % 4).alias("grade_a"),
        F.when(F.col("l_tax") < 0.055, q % 4).otherwise(((q + F.col("l_suppkey")) % 4).cast("int")).alias("grade_b"),
        (number % 2).alias("answer_a"), F.when(F.col("l_discount") < 0.095, number % 2).otherwise((number + 1) % 2).alias("answer_b"),
        F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("source_id"))


@query("relevance_agreement", "A16 A17 A18", "SELECT * FROM grade_kappa")
def relevance_agreement(spark, sf):
    return agreement.agreement(ratings(spark, sf), "grade_a", "grade_b", 4, "task_type")


@query("label_kappa", "A16 A18", kappa_sql("(SELECT d.lang AS task_type, l.quality, 1 - l.toxic AS clean FROM labels l JOIN documents d USING (doc_id))", "quality", "clean"))
def label_kappa(spark, sf):
    rows = model.table(spark, sf, "labels").join(model.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("task_type")), "doc_id")
    return agreement.agreement(rows.withColumn("clean", 1 - F.col("toxic")), "quality", "clean", 2, "task_type")


@query("agreement_gates", "B13 A23", """
    SELECT task_type, a.kappa AS answerability_kappa, g.quadratic_kappa AS relevance_kappa, a.kappa >= 0.80 AND g.quadratic_kappa >= 0.70 AS passed
    FROM answer_kappa a JOIN grade_kappa g USING (task_type)""")
def agreement_gates(spark, sf):
    rows = ratings(spark, sf)
    return agreement.agreement_gates(
        agreement.agreement(rows, "answer_a", "answer_b", 2, "task_type"), agreement.agreement(rows, "grade_a", "grade_b", 4, "task_type"), "task_type")


def judgments(spark, sf):
    """One judgment per (case, source): repeated lines keep the lowest grades."""
    return ratings(spark, sf).groupBy("case_id", "source_id").agg(
        F.min("grade_a").alias("grade_a"), F.min("grade_b").alias("grade_b"), F.min("answer_a").alias("answer_a"), F.min("answer_b").alias("answer_b"))


define("pair_rows", """
    SELECT case_id, bool_or(answer_a <> answer_b) AS answer_differs, count(*) FILTER (WHERE grade_a <> grade_b) AS grade_differences FROM (
      SELECT case_id, source_id, min(grade_a) AS grade_a, min(grade_b) AS grade_b, min(answer_a) AS answer_a, min(answer_b) AS answer_b
      FROM ratings GROUP BY 1, 2) GROUP BY 1""")


def review_pairs(spark, sf):
    rows = judgments(spark, sf)
    side = lambda s: rows.select("case_id", F.col("source_id").alias("ref"), F.col(f"grade_{s}").alias("grade"), F.col(f"answer_{s}").alias("answerability"))
    return agreement.disagreements(side("a"), side("b"))


@query("review_disagreements", "B12", "SELECT *, answer_differs OR grade_differences > 0 AS disagrees FROM pair_rows")
def review_disagreements(spark, sf):
    return review_pairs(spark, sf)


@query("adjudication_queue", "B12", """
    SELECT case_id, CASE WHEN answer_differs OR grade_differences > 0 THEN 'resolution_required' ELSE 'confirmation_required' END AS status
    FROM pair_rows WHERE case_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def adjudication_queue(spark, sf):
    done = model.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("case_id"))
    return agreement.adjudication_queue(review_pairs(spark, sf), done)


TASK_SQL = "CASE {x} % 4 WHEN 0 THEN 'no_relevant_document' WHEN 1 THEN 'insufficient_evidence' ELSE 'semantic_paraphrase' END"
ANSWER_SQL = "CASE {x} % 5 WHEN 0 THEN 'no_relevant_document' WHEN 1 THEN 'insufficient_evidence' ELSE 'answerable' END"


@query("label_rules", "P11", f"""
    SELECT case_id, task_type, answerability, high AS high_grades FROM (
      SELECT case_id, {TASK_SQL.format(x="case_id")} AS task_type, {ANSWER_SQL.format(x="case_id")} AS answerability,
             count(*) FILTER (WHERE grade_a >= 2) AS high, count(*) FILTER (WHERE grade_a >= 1) AS related FROM ratings GROUP BY 1)
    WHERE NOT CASE WHEN task_type = 'no_relevant_document' THEN answerability = 'no_relevant_document' AND high = 0
                   WHEN task_type = 'insufficient_evidence' THEN answerability = 'insufficient_evidence' AND high = 0 AND related > 0
                   ELSE answerability = 'answerable' AND high > 0 END""")
def label_rules(spark, sf):
    rows = ratings(spark, sf).select(
        "case_id", F.expr(TASK_SQL.format(x="case_id")).alias("task_type"), F.expr(ANSWER_SQL.format(x="case_id")).alias("answerability"),
        F.col("grade_a").alias("grade"))
    return agreement.label_violations(rows)


@query("approved_gold", "B14", f"""
    SELECT DISTINCT case_id, source_id AS note_id FROM (SELECT *, {TASK_SQL.format(x="case_id")} AS task FROM ratings)
    WHERE grade_a >= CASE WHEN task = 'insufficient_evidence' THEN 1 ELSE 2 END AND task <> 'no_relevant_document'""")
def approved_gold(spark, sf):
    rows = ratings(spark, sf).select(
        "case_id", F.expr(TASK_SQL.format(x="case_id")).alias("task_type"), F.lit("note").alias("source_type"),
        F.col("source_id").alias("note_id"), F.lit(0).alias("position"), F.col("grade_a").alias("grade"))
    return agreement.approved_gold(rows).select("case_id", "note_id")


@query("review_validation", "B11", """
    WITH reviews AS (
      SELECT doc_id AS case_id, 1 + doc_id % 6 AS n, CASE WHEN doc_id % 10 = 3 THEN 'bob' ELSE 'ann' END AS reviewer_id FROM documents WHERE doc_id % 9 <> 4)
    SELECT case_id, 'mixed_reviewers' AS violation FROM reviews WHERE reviewer_id = 'bob' UNION ALL
    SELECT case_id, 'incomplete_review' FROM reviews WHERE case_id % 12 = 5 UNION ALL
    SELECT doc_id, 'missing_review' FROM documents WHERE doc_id % 9 = 4 UNION ALL
    SELECT case_id, 'judgment_count' FROM reviews WHERE case_id % 8 = 6 UNION ALL
    SELECT case_id, 'duplicate_judgment' FROM reviews WHERE case_id % 8 = 6 UNION ALL
    SELECT case_id, 'grade_out_of_range' FROM reviews WHERE n >= 5 UNION ALL
    SELECT case_id, 'reviewer_is_author' FROM reviews WHERE case_id % 7 = 2 AND reviewer_id = 'ann'""")
def review_validation(spark, sf):
    """One review sheet per document with planted faults."""
    case = F.col("case_id")
    sheets = model.table(spark, sf, "documents").select(F.col("doc_id").alias("case_id")).withColumn(
        "all", F.transform(F.sequence(F.lit(0).cast("bigint"), case % 6), lambda t: F.struct(F.concat(F.lit("t"), t.cast("string")).alias("ref"), t.cast("int").alias("grade"))))
    expected = sheets.select("case_id", F.when(case % 7 == 2, "ann").otherwise("zed").alias("author_id"), F.col("all.ref").alias("refs"))
    reviews = sheets.where(case % 9 != 4).select(
        "case_id", F.when(case % 10 == 3, "bob").otherwise("ann").alias("reviewer_id"),
        F.when(case % 12 == 5, "").otherwise("answerable").alias("answerability"), F.timestamp_seconds(F.lit(model.EPOCH)).alias("reviewed_at"),
        F.when(case % 8 == 6, F.concat("all", F.slice("all", 1, 1))).otherwise(F.col("all")).alias("judgments"))
    return agreement.review_violations(expected, reviews)


# Benchmark ---------------------------------------------------------------------------

TASK_OF = {n: t for n, t in enumerate(C.TASKS)}


def task_sql(x):
    return "CASE " + x + " % 6 " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in TASK_OF.items()) + " END"


define("authored", f"""
    SELECT conv_id * 1000 + turn AS case_id, {task_sql("(conv_id + turn)")} AS task_type,
           CASE WHEN conv_id % 3 = 0 THEN 'holdout' ELSE 'development' END AS split, text AS query, role AS expected_answer,
           CASE WHEN turn % 2 = 0 THEN 'human_approved' ELSE 'machine_validated' END AS review_status,
           'nonce-' || conv_id || '-' || turn AS commitment_nonce FROM conversations""")


def authored(spark, sf):
    conv, turn = F.col("conv_id"), F.col("turn")
    return model.table(spark, sf, "conversations").select(
        (conv * 1000 + turn).alias("case_id"), F.expr(task_sql("(conv_id + turn)")).alias("task_type"),
        F.when(conv % 3 == 0, "holdout").otherwise("development").alias("split"), F.col("text").alias("query"),
        F.col("role").alias("expected_answer"), F.when(turn % 2 == 0, "human_approved").otherwise("machine_validated").alias("review_status"),
        F.concat_ws("-", F.lit("nonce"), conv.cast("string"), turn.cast("string")).alias("commitment_nonce"))


CONTENT = ["task_type", "query", "expected_answer"]
JSON_SQL = """'{"expected_answer":' || to_json(expected_answer) || ',"query":' || to_json(query) || ',"task_type":' || to_json(task_type) || '}'"""
define("sealed", f"""
    SELECT *, sha256(commitment_nonce || chr(31) || case_checksum) AS commitment_hash FROM (SELECT *, sha256({JSON_SQL}) AS case_checksum FROM authored)""")


@query("manifest_counts", "A19 B18", """
    SELECT 'split' AS kind, split AS label, count(*) AS case_count FROM authored GROUP BY 2 UNION ALL
    SELECT 'task', task_type, count(*) FROM authored GROUP BY 2 UNION ALL SELECT 'review', review_status, count(*) FROM authored GROUP BY 2""")
def manifest_counts(spark, sf):
    return benchmark.manifest_counts(authored(spark, sf))


SUBJECT = r"^\p{L}+"
define("subjects", r"""
    SELECT id AS note_id, 1 + id % 3 AS project_id, regexp_extract(body, '^\p{L}+') AS subject, CASE WHEN id % 7 = 0 THEN '' ELSE category END AS audience,
           CASE WHEN id % 8 = 0 THEN ' ' ELSE n_chars || ' chars' END AS metric, CASE WHEN id % 4 = 0 THEN '' ELSE 'the ' || source END AS context,
           CASE WHEN id % 5 = 0 THEN NULL ELSE 'goal ' || n_chars END AS goal, 'seen in ' || source || '。; ' AS conclusion FROM docs""")


def subjects(spark, sf):
    number = F.col("id")
    return model.documents(spark, sf).select(
        number.alias("note_id"), (F.lit(1) + number % 3).alias("project_id"), F.regexp_extract("body", SUBJECT, 0).alias("subject"),
        F.when(number % 7 == 0, "").otherwise(F.col("category")).alias("audience"),
        F.when(number % 8 == 0, " ").otherwise(F.concat_ws(" ", F.col("n_chars").cast("string"), F.lit("chars"))).alias("metric"),
        F.when(number % 4 == 0, "").otherwise(F.concat_ws(" ", F.lit("the"), "source")).alias("context"),
        F.when(number % 5 != 0, F.concat_ws(" ", F.lit("goal"), F.col("n_chars").cast("string"))).alias("goal"),
        F.concat(F.lit("seen in "), "source", F.lit("。; ")).alias("conclusion"))


TYPO_SQL = ("CASE WHEN length(trim(subject)) < 3 THEN subject || '测式' ELSE substr(trim(subject), 1, length(trim(subject)) // 2) "
            "|| substr(trim(subject), length(trim(subject)) // 2 + 2) END")


def filled_sql(task, pattern):
    text = f"'{pattern}'"
    fallbacks = C.CASE_FALLBACKS | C.CASE_OWN_FALLBACKS.get(task, {})
    values = {"typo": TYPO_SQL, "project": "CAST(project_id AS VARCHAR)"} | {c: f"rtrim({c}, '{C.CASE_ANSWER_ENDS}')" for c in ("conclusion", "peer_conclusion")}
    for slot in ("subject", "metric", "audience", "context", "goal", "peer_subject", "peer_metric", "peer_audience", "typo", "project", "conclusion", "peer_conclusion"):
        if f"{{{slot}}}" in pattern:
            value = values.get(slot, slot)
            value = f"CASE WHEN trim({slot}) <> '' THEN {slot} ELSE '{fallbacks[slot]}' END" if slot in fallbacks else value
            text = f"replace({text}, '{{{slot}}}', {value})"
    return f"WHEN '{task}' THEN {text}"


@query("generated_cases", "B1 F20 U5", f"""
    WITH placed AS (SELECT *, {task_sql("note_id")} AS task_type, row_number() OVER (ORDER BY note_id) - 1 AS place, count(*) OVER () AS total FROM subjects),
    paired AS (
      SELECT s.*, p.note_id AS peer_note_id, p.subject AS peer_subject, p.metric AS peer_metric, p.audience AS peer_audience, p.conclusion AS peer_conclusion
      FROM placed s JOIN placed p ON p.place = (s.place + CASE WHEN 17 % s.total = 0 THEN 18 ELSE 17 END) % s.total)
    SELECT query, min(note_id) AS note_id, arg_min(task_type, note_id) AS task_type, arg_min(answer, note_id) AS expected_answer, arg_min(gold, note_id) AS gold_notes FROM (
      SELECT note_id, task_type, CASE task_type {" ".join(filled_sql(t, p) for t, p in C.CASE_TEMPLATES.items())} END AS query,
             CASE task_type {" ".join(filled_sql(t, p) for t, p in C.CASE_ANSWERS.items())} ELSE conclusion END AS answer,
             CASE task_type WHEN 'cross_note_compare' THEN [note_id, peer_note_id] WHEN 'no_answer' THEN CAST([] AS BIGINT[]) ELSE [note_id] END AS gold
      FROM paired) GROUP BY 1""")
def generated_cases(spark, sf):
    return benchmark.generate_cases(subjects(spark, sf).withColumn("task_type", F.expr(task_sql("note_id"))))


@query("stratified_split", "B2", """
    SELECT case_id, task_type, CASE WHEN row_number() OVER (PARTITION BY task_type ORDER BY sha256('42' || chr(31) || case_id), case_id) <= 20 + length(task_type)
           THEN 'development' ELSE 'holdout' END AS split FROM authored""")
def stratified_split(spark, sf):
    quotas = spark.createDataFrame([(t, 20 + len(t)) for t in C.TASKS], "task_type string, quota bigint")
    return benchmark.stratified_split(authored(spark, sf).select("case_id", "task_type"), quotas, 42)


@query("quota_violations", "B4", """
    SELECT task_type, split, count(*) AS case_count, CAST(50 AS BIGINT) AS quota FROM authored GROUP BY 1, 2 HAVING count(*) <> 50""")
def quota_violations(spark, sf):
    quotas = spark.createDataFrame([(t, s, 50) for t in C.TASKS for s in ("development", "holdout")], "task_type string, split string, quota bigint")
    return benchmark.quota_violations(authored(spark, sf), quotas)


@query("duplicate_queries", "B4 F14", r"""
    SELECT 'normalized_query' AS kind, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS value, count(*) AS copies FROM documents GROUP BY 2 HAVING count(*) > 1""")
def duplicate_queries(spark, sf):
    return benchmark.query_duplicates(model.table(spark, sf, "documents").select(F.col("text").alias("query")))


@query("sealed_cases", "B5 F23 F24", "SELECT case_id, case_checksum, commitment_hash FROM sealed")
def sealed_cases(spark, sf):
    return benchmark.seal(authored(spark, sf), CONTENT).select("case_id", "case_checksum", "commitment_hash")


@query("public_artifacts", "B6", """
    SELECT case_id, 'development' AS artifact, query FROM sealed WHERE split = 'development' UNION ALL
    SELECT case_id, 'holdout', commitment_hash FROM sealed WHERE split = 'holdout'""")
def public_artifacts(spark, sf):
    development, holdout = benchmark.public_artifacts(benchmark.seal(authored(spark, sf), CONTENT))
    return development.select("case_id", F.lit("development").alias("artifact"), "query").unionByName(
        holdout.select("case_id", F.lit("holdout").alias("artifact"), F.col("commitment_hash").alias("query")))


@query("artifact_verification", "B7", """
    SELECT case_id, 'checksum' AS violation FROM authored WHERE case_id % 10 = 3 UNION ALL
    SELECT case_id, 'commitment' FROM authored WHERE case_id % 7 = 2""")
def artifact_verification(spark, sf):
    """Some cases lost a letter of their text, some had their nonce changed."""
    case = F.col("case_id")
    tampered = benchmark.seal(authored(spark, sf), CONTENT).withColumn(
        "query", F.when(case % 10 == 3, F.concat("query", F.lit("!"))).otherwise(F.col("query"))
    ).withColumn("commitment_nonce", F.when(case % 7 == 2, F.lit("forged")).otherwise(F.col("commitment_nonce")))
    return benchmark.verify_cases(tampered, CONTENT)


@query("holdout_match", "U6 B7", """
    SELECT commitment_hash, 'missing' AS problem FROM sealed WHERE split = 'holdout' AND case_id % 5 = 1 UNION ALL
    SELECT 'x' || commitment_hash, 'foreign' FROM sealed WHERE split = 'holdout' AND case_id % 5 = 2 UNION ALL
    SELECT commitment_hash, 'repeated' FROM sealed WHERE split = 'holdout' AND case_id % 5 = 3""")
def holdout_match(spark, sf):
    sealed = benchmark.seal(authored(spark, sf), CONTENT).where("split = 'holdout'")
    case = F.col("case_id")
    copies = F.explode(F.sequence(F.lit(1), F.when(case % 5 == 3, 2).otherwise(1)))
    submitted = sealed.where("case_id % 5 <> 1").select("case_id", "commitment_hash", copies.alias("copy")).select("commitment_hash").unionByName(
        sealed.where("case_id % 5 = 2").select(F.concat(F.lit("x"), "commitment_hash").alias("commitment_hash")))
    return benchmark.holdout_match(sealed, submitted)


@query("task_rules", "P10", """
    SELECT case_id, task_type FROM (
      SELECT case_id, task_type, case_id % 3 AS gold, case_id % 4 <> 0 AS answerable, case_id % 5 AS project FROM authored)
    WHERE NOT CASE WHEN task_type = 'authorization_boundary' THEN gold > 0 AND project > 0 ELSE gold > 0 AND answerable END""")
def task_rules(spark, sf):
    case = F.col("case_id")
    rows = authored(spark, sf).select(
        "case_id", "task_type", (case % 4 != 0).alias("answerable"), F.array_repeat(F.lit("note"), (case % 3).cast("int")).alias("gold_types"),
        (case % 5).alias("required_project_id"), F.lit(1).alias("authorized_expected"), F.lit(0).alias("unauthorized_expected"))
    return benchmark.task_rule_violations(rows)


define("pool_rows", """
    SELECT case_id, source_type, source_id, tier FROM (
      SELECT doc_id AS case_id, 'note' AS source_type, doc_id + 1 AS source_id, 0 AS tier FROM labels
      UNION ALL
      SELECT l.doc_id, 'note', o.note_id, s.step FROM labels l JOIN ring t ON t.note_id = l.doc_id + 1, (VALUES (1), (2)) s(step)
      JOIN ring o ON o.subject = t.subject AND o.no = (t.no - 1 + s.step) % t.size + 1 WHERE o.note_id <> t.note_id
      UNION ALL
      SELECT l.doc_id, 'note_media', m.id, 5 FROM labels l JOIN media m ON m.note_id = l.doc_id + 1
      UNION ALL
      SELECT l.doc_id, 'note', o.note_id, r.o + 10 FROM labels l, range(1, 9) r(o), (SELECT count(*) AS total FROM docs) n
      JOIN (SELECT id AS note_id, row_number() OVER (ORDER BY id) AS no FROM docs) o
        ON o.no = (('0x' || substr(sha256(CAST(l.doc_id AS VARCHAR)), 1, 15))::BIGINT % n.total + r.o * 193) % n.total + 1 WHERE o.note_id <> l.doc_id + 1)""")
define("ring", """
    SELECT id AS note_id, category AS subject, row_number() OVER (PARTITION BY category ORDER BY id) AS no, count(*) OVER (PARTITION BY category) AS size FROM docs""")
define("pool", """
    SELECT case_id, source_type, source_id, CAST(tier AS INTEGER) AS tier FROM (SELECT case_id, source_type, source_id, min(tier) AS tier FROM pool_rows GROUP BY 1, 2, 3)
    QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY tier, source_type, source_id) <= 6""")


def pool(spark, sf):
    targets = model.table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), (F.col("doc_id") + 1).alias("note_id"))
    sources = model.documents(spark, sf).select(F.col("id").alias("note_id"), F.col("category").alias("subject"))
    return benchmark.candidate_pool(targets.join(sources, "note_id"), sources, model.media(spark, sf))


@query("candidate_pool", "B8 F21", "SELECT * FROM pool")
def candidate_pool(spark, sf):
    return pool(spark, sf).select("case_id", "source_type", "source_id", F.col("tier").cast("int").alias("tier"))


@query("draft_report", "B18 B8", """
    SELECT count(*) AS case_count, min(n) AS candidate_minimum, max(n) AS candidate_maximum, CAST(sum(n) AS BIGINT) AS candidate_total,
           (SELECT count(DISTINCT (source_type, source_id)) FROM pool) AS distinct_candidates FROM (SELECT case_id, count(*) AS n FROM pool GROUP BY 1)""")
def draft_report(spark, sf):
    refs = materialize(pool(spark, sf).select("case_id", "source_type", "source_id"))
    return benchmark.draft_report(model.table(spark, sf, "labels").select(F.col("doc_id").alias("case_id")), refs)


@query("blind_assignments", "B10", """
    SELECT l.doc_id AS case_id, r.reviewer_id, (SELECT list(source_id ORDER BY sha256(concat_ws(chr(31), p.case_id, source_type, source_id)))
           FROM pool p WHERE p.case_id = l.doc_id) AS source_ids FROM labels l, (VALUES ('ann'), ('bob')) r(reviewer_id)""")
def blind_assignments(spark, sf):
    cases = model.table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"), F.lit("semantic_paraphrase").alias("task_type"), F.lit("q").alias("query"))
    return benchmark.blind_assignments(cases, pool(spark, sf), ["ann", "bob"]).select("case_id", "reviewer_id", F.col("candidates.source_id").alias("source_ids"))


@query("candidate_resolution", "B9 J9 J4", """
    SELECT r.case_id, 'note' AS source_type, r.source_id, CAST(1 AS BIGINT) AS source_version, d.id IS NOT NULL AS in_snapshot,
           coalesce(d.category = 'en', false) AS cited, coalesce(d.category = 'en', false) AS resolved
    FROM (SELECT doc_id AS case_id, 1 + (doc_id * 37 + unnest(range(1, 2 + doc_id % 6)) * 101) % 1100 AS source_id FROM documents) r
    LEFT JOIN docs d ON d.id = r.source_id AND d.status = 'published'""")
def candidate_resolution(spark, sf):
    """Each document's case lists one to six references as JSON; some do not exist."""
    doc = F.col("doc_id")
    refs = model.table(spark, sf, "documents").select(doc.alias("case_id"), F.to_json(F.transform(
        F.sequence(F.lit(1).cast("bigint"), F.lit(1) + doc % 6),
        lambda i: F.struct(F.lit("note").alias("source_type"), (F.lit(1) + (doc * 37 + i * 101) % 1100).alias("source_id"), F.lit(1).alias("source_version")))).alias("candidate_refs"))
    live = ev.note_rows(spark, sf).where("status <> 'deleted'").select(F.lit("note").alias("source_type"), F.col("id").alias("source_id"), F.lit(1).cast("bigint").alias("source_version"), "category")
    return benchmark.resolve_candidates(refs, live, live.where("category = 'en'"))


@query("draft_corpus", "B16 J4 F25", """
    SELECT source_type, source_id, note_id, length(canonical_text) AS characters FROM sources
    WHERE source_type IN ('note', 'note_media') AND deleted_at IS NULL AND canonical_text <> ''""")
def draft_corpus(spark, sf):
    rows = ev.registry(spark, sf)
    cited = ev.direct_docs(spark, sf).select(F.explode("segments").alias("s")).select("s.source_type", "s.source_id", "s.source_version")
    return benchmark.draft_corpus(rows, cited).select(
        "source_type", "source_id", F.coalesce("payload.note_id", "source_id").alias("note_id"), F.char_length("canonical_text").cast("bigint").alias("characters"))


@query("compare_pairs", "B17 W12", """
    SELECT id, paired_id FROM (SELECT id, lead(id, 10) OVER (ORDER BY id) AS paired_id, row_number() OVER (ORDER BY id) AS rn FROM docs)
    WHERE (rn - 1) % 10 = 0 AND paired_id IS NOT NULL""")
def compare_pairs(spark, sf):
    return benchmark.stride_pairs(model.documents(spark, sf), "id")


@query("adjacent_in_time", "W11", """
    SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_orderkey FROM orders""")
def adjacent_in_time(spark, sf):
    ranked = ordering.running(model.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return ordering.shifted(ranked, ["o_custkey"], "rn", {"next_orderkey": "o_orderkey"}, by=-1).select("o_custkey", "o_orderkey", "next_orderkey")


@query("stable_hash_index", "F21", "SELECT doc_id, ('0x' || substr(sha256(text), 1, 15))::BIGINT % 97 AS position FROM documents")
def stable_hash_index(spark, sf):
    return model.table(spark, sf, "documents").select("doc_id", stable_index("text", 97).alias("position"))


@query("typo_variants", "F20", f"SELECT note_id, {TYPO_SQL} AS typo FROM subjects")
def typo_variants(spark, sf):
    return subjects(spark, sf).select("note_id", typo_variant("subject").alias("typo"))


define("anchor_rows", r"""
    SELECT DISTINCT note_id, anchor FROM (
      SELECT id AS note_id, trim(regexp_replace(unnest(string_split(body, chr(10))), '\s+', ' ', 'g')) AS anchor FROM docs) WHERE length(anchor) >= 4""")


def scenarios(spark, sf):
    return model.documents(spark, sf).select(
        F.col("id").alias("note_id"), F.col("category").alias("subject"), F.to_json(F.struct(F.col("category").alias("subject"), F.split("body", "\n").alias("lines"))).alias("payload"))


@query("payload_anchors", "F18 F15", "SELECT note_id, anchor FROM anchor_rows")
def payload_anchors(spark, sf):
    return benchmark.payload_anchors(scenarios(spark, sf))


@query("distinguishability", "B15 A28 J7", """
    WITH spread AS (SELECT anchor, count(DISTINCT note_id) AS n FROM anchor_rows GROUP BY 1),
    hit AS (SELECT g.query_id, count(DISTINCT a.anchor) AS matched, count(DISTINCT a.anchor) FILTER (WHERE s.n = 1) AS uniq
            FROM gold_pairs g JOIN queries q USING (query_id) JOIN anchor_rows a ON a.note_id = g.note_id AND contains(q.query, a.anchor)
            JOIN spread s USING (anchor) GROUP BY 1)
    SELECT q.query_id AS case_id, count(DISTINCT g.note_id) AS gold_notes, any_value(coalesce(h.matched, 0)) AS matched_anchors,
           any_value(coalesce(h.uniq, 0)) AS unique_anchors,
           CASE WHEN count(g.note_id) = 0 THEN 'not_applicable' WHEN any_value(coalesce(h.uniq, 0)) > 0 OR bool_or(contains(q.query, CAST(g.note_id AS VARCHAR)))
                THEN 'pass' ELSE 'review' END AS status
    FROM queries q LEFT JOIN gold_pairs g USING (query_id) LEFT JOIN hit h USING (query_id) GROUP BY 1""")
def distinguishability(spark, sf):
    asked = model.query_table(spark, sf).select(F.col("query_id").alias("case_id"), "query")
    gold = rt.gold_pairs(spark, sf).join(model.documents(spark, sf).select(F.col("id").alias("note_id"), F.col("category").alias("topic")), "note_id").select(
        F.col("query_id").alias("case_id"), "note_id", "topic")
    rows = scenarios(spark, sf)
    anchors = materialize(benchmark.payload_anchors(rows))
    return benchmark.distinguishability(asked, materialize(gold), rows, anchors).select("case_id", "gold_notes", "matched_anchors", "unique_anchors", "status")
