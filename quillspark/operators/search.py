"""Scope and access resolution, fusion, decision, diversity and citations for query tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import contract as C
from quillspark.functions.text import byte_slice, clamp, hash_parts
from quillspark.operators import index, lexical
from quillspark.operators.ordering import top_per_group


def resolve_scope(queries: DataFrame, runs: DataFrame) -> DataFrame:
    """Latest completed run for each query's optional project, version and run."""
    best = F.struct("completed_at", "run_id")
    completed = runs.where("status = 'completed'")
    per_version = completed.groupBy("project_id", "dataset_version_id").agg(F.max(best).alias("_run"))
    per_project = completed.groupBy("project_id").agg(F.max(F.struct("completed_at", "run_id", "dataset_version_id")).alias("_run"))
    wanted = queries.select("query_id", "project_id", "wanted_version", "wanted_run")
    named = wanted.where("wanted_run IS NOT NULL").join(
        completed.select("project_id", F.col("run_id").alias("wanted_run"), "dataset_version_id"), ["project_id", "wanted_run"]
    ).where("wanted_version IS NULL OR wanted_version = dataset_version_id").select("query_id", F.col("wanted_run").alias("run_id"), "dataset_version_id")
    versioned = wanted.where("wanted_run IS NULL AND wanted_version IS NOT NULL").join(
        per_version.withColumnRenamed("dataset_version_id", "wanted_version"), ["project_id", "wanted_version"]
    ).select("query_id", "_run.run_id", F.col("wanted_version").alias("dataset_version_id"))
    latest = wanted.where("wanted_run IS NULL AND wanted_version IS NULL").join(per_project, "project_id").select(
        "query_id", "_run.run_id", "_run.dataset_version_id"
    )
    return named.unionByName(versioned).unionByName(latest)


def resolve_access(queries: DataFrame, projects: DataFrame, members: DataFrame) -> DataFrame:
    """``access_scope`` per query: member, public or none. Runs before any index is touched."""
    active = projects.where("status = 'active'").select(F.col("id").alias("project_id"), F.col("visibility").alias("_visibility"))
    own = members.where("status = 'active'").select("project_id", "user_id").distinct().withColumn("_member", F.lit(True))
    scope = (
        F.when(F.col("_visibility").isNull(), "none").when(F.col("_member"), "member")
        .when(F.col("_visibility") == "public", "public").otherwise("none")
    )
    return (
        queries.join(active, "project_id", "left").join(own, ["project_id", "user_id"], "left")
        .withColumn("access_scope", scope).drop("_visibility", "_member")
    )


def in_runs(queries: DataFrame, runs: DataFrame) -> DataFrame:
    """Queries with the run they are scoped to; those that no completed run answers have none and find nothing."""
    return queries.join(resolve_scope(queries, runs).select("query_id", "run_id"), "query_id", "left")


class IndexedSearch:
    """Planned queries with a ``run_id`` against a stored index.

    ``hidden`` holds the documents no search may return now (document_key): dead sources, or a
    lifecycle other than ready and superseded. Chunk keys are qualified by their run until
    ``index.plain_key`` is applied to a result.
    """

    def __init__(self, planned: DataFrame, stored: index.LexicalIndex, hidden: DataFrame):
        self.planned = planned.where("access_scope <> 'none' AND valid AND run_id IS NOT NULL")
        self.stored, self.hidden = stored, hidden
        self.run_ids = stored.scoped_to(self.planned)
        #: A public query's project is open, or its scope would be none.
        self.everything = stored.chunks(self.run_ids).withColumn("project_open", F.lit(True))

    def shown(self, rows: DataFrame) -> DataFrame:
        """``rows`` (document_key) without those of hidden documents; give it narrow rows, which are moved."""
        return rows.join(self.hidden, "document_key", "left_anti")

    def chunks_of(self, found: DataFrame) -> DataFrame:
        """The chunks that were found; only their texts are hashed and cut into tokens."""
        return index.described(self.stored.texts(self.run_ids).join(found.select("chunk_key").distinct(), "chunk_key", "left_semi")).withColumn("project_open", F.lit(True))

    def term_statistics(self) -> DataFrame:
        return index.term_statistics(self.planned, self.stored, self.run_ids)

    def lexical_candidates(self, term_stats: DataFrame, hybrid: bool = False) -> DataFrame:
        """Scored candidates; on its own a lexical search needs an indexed term, as half of a hybrid one hints suffice."""
        ranked = self.ranked(lexical.candidate_terms(term_stats), hybrid)
        return lexical.lexical_scores(ranked, lexical.query_profile(self.planned, term_stats), self.everything)

    def ranked(self, terms: DataFrame, hybrid: bool = False) -> DataFrame:
        keyed = terms.withColumn("run_term", index.run_term("run_id", "project_id", "term"))
        matched = lexical.match_candidates(
            self.planned, keyed, self.everything, self.stored.posting_blocks(self.run_ids).withColumn("project_open", F.lit(True)), ["run_term"])
        return lexical.rank_candidates(matched if hybrid else matched.where("term_count > 0"), self.planned, self.everything, hidden=self.hidden)


def fuse(lexical_rows: DataFrame, vector_rows: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists; each list adds 1 / (61 + its 0-based rank).

    A list holds at most 240 rows per query, so the rank windows are small. What only the
    vector list found has no frequency or trigram score.
    """
    by_query = Window.partitionBy("query_id")
    lex_rank = F.row_number().over(by_query.orderBy(F.desc("fts_score"), F.desc("trigram_score"), "chunk_key")) - 1
    vec_rank = F.row_number().over(by_query.orderBy(F.desc("vector_score"), "chunk_key")) - 1
    left = lexical_rows.select("query_id", "chunk_key", "fts_score", "trigram_score", lex_rank.alias("_lexical_rank"))
    right = vector_rows.select("query_id", "chunk_key", "vector_score", vec_rank.alias("_vector_rank"))
    zero = F.lit(0.0)

    def share(rank: str) -> Column:
        return F.coalesce(1.0 / (F.lit(C.RRF_BASE) + F.col(rank)).cast("double"), zero)

    return left.join(right, ["query_id", "chunk_key"], "full_outer").select(
        "query_id", "chunk_key", F.coalesce("fts_score", zero).alias("fts_score"),
        F.coalesce("trigram_score", zero).alias("trigram_score"), F.coalesce("vector_score", zero).alias("vector_score"),
        (share("_lexical_rank") + share("_vector_rank")).alias("rrf"),
    )


def hybrid_confidence(rrf: Column, vector_score: Column, lexical_confidence: Column) -> Column:
    w = C.HYBRID_WEIGHTS
    return (
        clamp(rrf * C.RRF_SCALE) * w["rrf"]
        + clamp(vector_score) * w["vector"]
        + lexical_confidence * w["lexical"]
    )


def decide(queries: DataFrame, ranked: DataFrame, threshold: float) -> DataFrame:
    """One row per query, also for those without candidates: top confidence and decision."""
    top = ranked.groupBy("query_id").agg(F.max("confidence").alias("top_confidence"), F.count("*").alias("candidate_count"))
    passed = F.col("top_confidence") >= threshold
    return queries.select("query_id", "access_scope").join(top, "query_id", "left").select(
        "query_id", "access_scope", F.coalesce("top_confidence", F.lit(0.0)).alias("top_confidence"),
        F.coalesce("candidate_count", F.lit(0)).cast("bigint").alias("candidate_count"),
        F.when(passed, "candidates").otherwise("no_relevant_document").alias("status"),
    )


def select_diverse(ranked: DataFrame, threshold: float, limit: int = C.RESULT_LIMIT) -> DataFrame:
    """Best chunk per document, two per note, above max(threshold, 72 % of the top), first ``limit``.

    ``ranked`` holds at most 480 rows per query with columns confidence, score and tiebreak.
    """
    by_query = Window.partitionBy("query_id")
    best_first = [F.desc("score"), F.desc("tiebreak"), F.asc("chunk_key")]
    top = F.first("confidence").over(
        by_query.orderBy(*best_first).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    kept = ranked.withColumn("_top", top).where(
        (F.col("_top") >= threshold)
        & (F.col("confidence") >= F.greatest(F.lit(threshold), F.col("_top") * C.RELATIVE_CUTOFF))
    )
    per_document = top_per_group(kept, ["query_id", "document_key"], best_first, 1)
    noted = F.coalesce(F.col("note_id").cast("string"), F.concat(F.lit("-"), "document_key"))
    per_note = top_per_group(per_document.withColumn("_note", noted), ["query_id", "_note"], best_first, C.MAX_PER_NOTE)
    return top_per_group(per_note, ["query_id"], best_first, limit, "rank").drop("rn", "_top", "_note")


def lexical_results(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("score", F.col("lexical_score")).withColumn(
        "confidence", F.col("lexical_confidence")).withColumn("tiebreak", F.col("fts_score"))


def vector_results(hits: DataFrame, chunks: DataFrame, planned: DataFrame) -> DataFrame:
    """Vector hits re-authorized against the chunk table; confidence is the clamped score."""
    rows = hits.join(chunks.select(*lexical.CHUNK_COLUMNS), "chunk_key").join(planned.select(*lexical.QUERY_COLUMNS), "query_id")
    allowed = rows.where(lexical.may_see(F.col("access_scope"), F.col("project_open"), F.col("visibility"))).where(
        lexical.type_allowed(F.col("document_type"), F.col("source_type"), F.col("preferred_type"), F.col("document_types"), F.col("source_types"))
    )
    return allowed.withColumn("score", F.col("vector_score")).withColumn(
        "confidence", clamp(F.col("vector_score"))).withColumn("tiebreak", F.lit(0.0))


def hybrid_results(lexical_rows: DataFrame, vector_rows: DataFrame, planned: DataFrame, chunks: DataFrame, term_stats: DataFrame) -> DataFrame:
    """Fused list, lexically rescored as a whole, with hybrid confidence."""
    fused = (
        fuse(lexical_rows, vector_rows)
        .join(chunks.select(*lexical.CHUNK_COLUMNS), "chunk_key")
        .join(planned.select(*lexical.QUERY_COLUMNS), "query_id")
    )
    profile = lexical.query_profile(planned, term_stats)
    scored = lexical.lexical_scores(fused, profile, chunks, trigram=False)
    confidence = hybrid_confidence(F.col("rrf"), F.col("vector_score"), F.col("lexical_confidence"))
    return scored.withColumn("score", confidence).withColumn("confidence", clamp(F.col("score"))).withColumn("tiebreak", F.lit(0.0))


def attach_citations(results: DataFrame, citations: DataFrame) -> DataFrame:
    """Every result with its citations; a result without one keeps null and fails the check below."""
    rows = citations.select(
        "chunk_key", F.struct("document_start_byte", "document_end_byte", "source_type", "source_id", "source_version", "quote", "quote_hash").alias("c")
    )
    cited = rows.join(results.select("chunk_key").distinct(), "chunk_key", "left_semi").groupBy("chunk_key").agg(
        F.sort_array(F.collect_list("c")).alias("citations")
    )
    return results.join(cited, "chunk_key", "left")


def uncited(results_with_citations: DataFrame) -> DataFrame:
    """Results that break the rule that every result has a citation; must be empty."""
    return results_with_citations.where(F.coalesce(F.size("citations"), F.lit(0)) <= 0)


def redacted(queries: DataFrame) -> DataFrame:
    """Answer of a query without access: no results, no statistics, no scope."""
    return queries.where("access_scope = 'none'").select(
        "query_id", F.lit("no_relevant_document").alias("status"), F.lit("no authorized evidence").alias("reason"),
        F.lit(0).cast("bigint").alias("candidate_count"), F.lit(0).cast("bigint").alias("indexed_terms"),
        F.lit("").alias("run_id"),
    )


def quote_valid(citation_key: Column, quote: Column, quote_hash: Column, doc_start: Column, doc_end: Column, src_start: Column, src_end: Column) -> Column:
    """A citation is valid when its hash and length agree with its byte range."""
    return (
        (F.coalesce(citation_key, F.lit("")) != "") & (quote != "") & (doc_end > doc_start) & (src_end > src_start)
        & (hash_parts(quote) == quote_hash) & (F.octet_length(quote) == doc_end - doc_start)
    )


def exact_quote(document_text: Column, start: Column, end: Column) -> Column:
    return byte_slice(document_text, start, end)
