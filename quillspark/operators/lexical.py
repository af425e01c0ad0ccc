"""Term statistics, query planning and lexical ranking for a whole table of queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.functions import contract as C
from quillspark.functions.text import clamp, gram_similarity, is_numeric, meaningful_terms, query_terms, tokenize, trigrams
from quillspark.operators.ordering import top_per_group

# Cover-density and frequency ranks of an unweighted term vector: every occurrence weighs
# 0.1, a cover of two terms d positions apart adds 0.1 / d, the j-th repeat of a term adds
# 0.1 / j^2 (normalized by pi^2 / 6), and a raw rank r is reported as r / (r + 1).
OCCURRENCE_WEIGHT = 0.1
REPEAT_NORM = 1.64493406685


#: What a query may filter by; postings carry it, so that filters apply before anything is grouped.
FILTER_COLUMNS = ["document_type", "source_type", "visibility", "project_open"]


def occurrences(chunks: DataFrame) -> DataFrame:
    """Inverted form: one row per token occurrence, positions counted from 1, with the chunk's filter columns."""
    carried = ["project_id", "chunk_key", *FILTER_COLUMNS]
    return chunks.select(*carried, F.posexplode("lexemes").alias("_at", "term")).select(
        *carried, "term", (F.col("_at") + 1).alias("position"))


#: Bits of a chunk's number that lie inside a block of stored postings, and of a token's position; a hit packs both into an int.
BLOCK_BITS, POSITION_BITS = 16, 15


def opened(blocks: DataFrame) -> DataFrame:
    """Stored posting blocks as one row per token occurrence, with ``chunk_no`` and ``position``."""
    rest = [c for c in blocks.columns if c not in ("block", "hits")]
    return blocks.select(*rest, "block", F.explode("hits").alias("_hit")).select(
        *rest, (F.shiftleft("block", BLOCK_BITS) + F.shiftright("_hit", POSITION_BITS)).alias("chunk_no"),
        (F.col("_hit") % (1 << POSITION_BITS)).alias("position"))


def _counted_tokens(chunks: DataFrame, *columns: str) -> DataFrame:
    """Every token once per occurrence and, flagged ``_chunk``, once per chunk it appears in.

    Both come out of one pass over the chunk, so chunk frequencies need no distinct step.
    """
    both = chunks.select(
        *columns, F.size("lexemes").alias("_n"), F.posexplode(F.concat("lexemes", F.array_distinct("lexemes"))).alias("_at", "term")
    )
    return both.select(*columns, "term", (F.col("_at") >= F.col("_n")).alias("_chunk"))


def inverse_frequency(total: Column, frequency: Column) -> Column:
    return F.log((total.cast("double") + 1.0) / (frequency.cast("double") + 1.0)) + 1.0


def term_statistics(chunks: DataFrame) -> DataFrame:
    """Chunk frequency, occurrence count and idf per project and term.

    One partially aggregated shuffle gives both frequencies.
    """
    totals = chunks.groupBy("project_id").agg(F.count("*").alias("_chunks"))
    counted = (
        _counted_tokens(chunks, "project_id")
        .groupBy("project_id", "term")
        .agg(F.count_if("_chunk").alias("chunk_frequency"), F.count_if(~F.col("_chunk")).alias("occurrence_count"))
    )
    return counted.join(totals, "project_id").select(
        "project_id", "term", "chunk_frequency", "occurrence_count",
        inverse_frequency(F.col("_chunks"), F.col("chunk_frequency")).alias("idf"),
    )


def scoped_statistics(chunks: DataFrame, projects: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Term statistics per access scope: members see all chunks, the public only public ones.

    Both scopes come out of one aggregation; the public totals count public chunks only, so
    private text cannot influence public weights. With ``wanted`` (project_id, term) only those
    terms are counted, not the whole vocabulary.
    """
    open_projects = projects.where("visibility = 'public'").select(F.col("id").alias("project_id"), F.lit(True).alias("_open"))
    marked = chunks.join(open_projects, "project_id", "left").withColumn(
        "_public", F.coalesce("_open", F.lit(False)) & (F.col("visibility") == "public")
    )
    totals = marked.groupBy("project_id").agg(F.count("*").alias("_all"), F.count_if("_public").alias("_open_chunks"))
    tokens = _counted_tokens(marked, "project_id", "_public")
    if wanted is not None:
        tokens = tokens.join(wanted, ["project_id", "term"], "left_semi")
    counted = (
        tokens.groupBy("project_id", "term")
        .agg(
            F.count_if("_chunk").alias("_df"), F.count_if(~F.col("_chunk")).alias("_cf"),
            F.count_if(F.col("_chunk") & F.col("_public")).alias("_pdf"), F.count_if(~F.col("_chunk") & F.col("_public")).alias("_pcf"),
        )
    )
    scope = F.array(
        F.struct(F.lit("member").alias("access_scope"), F.col("_df").alias("chunk_frequency"), F.col("_cf").alias("occurrence_count"), F.col("_all").alias("total")),
        F.struct(F.lit("public").alias("access_scope"), F.col("_pdf").alias("chunk_frequency"), F.col("_pcf").alias("occurrence_count"), F.col("_open_chunks").alias("total")),
    )
    return (
        counted.join(totals, "project_id").select("project_id", "term", F.inline(scope)).where("occurrence_count > 0")
        .select("project_id", "access_scope", "term", "chunk_frequency", "occurrence_count",
                inverse_frequency(F.col("total"), F.col("chunk_frequency")).alias("idf"))
    )


def _numbers(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.filter(F.transform(found, lambda n: n.cast("bigint")), lambda n: n > 0)


def _contains_any(text: Column, phrases: list[str]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(text, F.lit(phrase))
    return hit


def plan_queries(queries: DataFrame) -> DataFrame:
    """Search terms, hinted notes, preferred document type and media position per query.

    Queries must be non-empty and within the length limit; others are marked invalid.
    """
    q = F.trim("query")
    hints = _numbers(q, C.NOTE_ID_PATTERN)
    long_numbers = F.when(F.contains(q, F.lit(C.NOTE_WORD)), _numbers(q, C.LONG_NUMBER_PATTERN)).otherwise(
        F.array().cast("array<bigint>")
    )
    preferred = (
        F.when(F.contains(F.lower(q), F.lit("ocr")) | _contains_any(q, C.MEDIA_PHRASES), "note_media")
        .when(_contains_any(q, C.COMMENT_PHRASES), "note_comment_cluster")
        .when(_contains_any(q, C.FACT_PHRASES), "note_daily_fact")
        .otherwise("note")
    )
    position = F.regexp_extract(q, C.POSITION_PATTERN, 1)
    subject = F.regexp_extract(q, C.SUBJECT_PATTERN, 1)
    return queries.select(
        *[c for c in queries.columns if c != "query"], q.alias("query"),
        ((q != "") & (F.char_length(q) <= C.MAX_QUERY_CHARS)).alias("valid"),
        query_terms(q, C.MAX_QUERY_TERMS).alias("terms"),
        F.array_distinct(F.concat(hints, long_numbers)).alias("hinted_note_ids"),
        preferred.alias("preferred_type"),
        F.when(position != "", position.cast("int")).alias("preferred_position"),
        meaningful_terms(tokenize(subject), C.MAX_QUERY_TERMS).alias("subject_terms"),
    )


def query_term_stats(planned: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per query term with its idf in the query's project and scope (null when unindexed)."""
    terms = planned.select(
        "query_id", "project_id", "access_scope", "subject_terms", F.posexplode("terms").alias("term_no", "term")
    )
    return terms.join(stats.select("project_id", "access_scope", "term", "idf"), ["project_id", "access_scope", "term"], "left")


def candidate_terms(term_stats: DataFrame, limit: int = C.MAX_CANDIDATE_TERMS) -> DataFrame:
    """At most twelve indexed terms per query: subject terms, then numbers, then by idf.

    A query has at most 64 terms, so its windows are small.
    """
    best = [F.desc("idf"), "_subject_no", "term_no"]
    indexed = term_stats.where("idf IS NOT NULL").withColumn("_subject_no", F.array_position("subject_terms", F.col("term")))
    subject_rank = F.row_number().over(Window.partitionBy("query_id", F.col("_subject_no") > 0).orderBy(*best))
    tiered = indexed.withColumn("_subject", (F.col("_subject_no") > 0) & (subject_rank <= 4))
    number = is_numeric(F.col("term")) & ~F.col("_subject")
    number_rank = F.row_number().over(Window.partitionBy("query_id", number).orderBy(F.desc("idf"), "term_no"))
    tier = F.when(F.col("_subject"), 0).when(number & (number_rank <= 4), 1).otherwise(2)
    ordered = tiered.withColumn("_tier", tier).withColumn(
        "term_rank",
        F.row_number().over(
            Window.partitionBy("query_id").orderBy(
                "_tier", F.desc("idf"), F.when(F.col("_tier") == 0, F.col("_subject_no")), "term_no"
            )
        ),
    )
    run = [c for c in ("run_id",) if c in term_stats.columns]
    return ordered.where(F.col("term_rank") <= limit).select("query_id", "project_id", *run, "term", "idf", "term_rank")


def dead_documents(document_sources: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents citing a deleted source for which no newer live version exists."""
    key = ["project_id", "source_type", "source_id"]
    live = (
        sources.where("deleted_at IS NULL AND index_status <> 'deleted'").groupBy(*key)
        .agg(F.max("source_version").alias("_live"))
    )
    gone = sources.where("deleted_at IS NOT NULL OR index_status = 'deleted'").select(*key, "source_version")
    dead = gone.join(live, key, "left").where("_live IS NULL OR _live <= source_version").select(*key, "source_version")
    return document_sources.join(dead, [*key, "source_version"]).select("document_key").distinct()


def searchable(chunks: DataFrame, projects: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """Chunks any query may ever see: live lifecycle, active project, no dead source."""
    active = projects.where("status = 'active'").select(
        F.col("id").alias("project_id"), (F.col("visibility") == "public").alias("project_open")
    )
    rows = chunks.where(F.col("lifecycle_status").isin(*C.SEARCHABLE_STATES)).join(active, "project_id")
    return rows if dead is None else rows.join(dead, "document_key", "left_anti")


def filter_violations(queries: DataFrame) -> DataFrame:
    """Requested document or source types outside the known set, one row each."""
    known = F.array(*[F.lit(t) for t in C.DOCUMENT_TYPES])
    wanted = F.concat(F.coalesce("document_types", F.array().cast("array<string>")), F.coalesce("source_types", F.array().cast("array<string>")))
    return queries.select("query_id", F.explode(F.array_except(wanted, known)).alias("unsupported"))


def may_see(query_scope: Column, project_open: Column, visibility: Column) -> Column:
    return (query_scope == "member") | ((query_scope == "public") & project_open & (visibility == "public"))


def type_allowed(document_type: Column, source_type: Column, preferred: Column, document_types: Column, source_types: Column) -> Column:
    """Explicit filters win; without a document filter the preferred type applies.

    Written so that no equality of the two sides becomes a join key, which would move the postings.
    """
    any_document = F.coalesce(F.size(document_types), F.lit(0)) > 0
    any_source = F.coalesce(F.size(source_types), F.lit(0)) > 0
    by_document = F.when(any_document, F.array_contains(document_types, document_type)).otherwise(F.array_contains(F.array(preferred), document_type))
    return by_document & (~any_source | F.array_contains(source_types, source_type))


def frequency_rank(hits: Column, term_count: Column) -> Column:
    """Pre-rank from term repeats; ``hits`` is an array of (position, term_rank)."""
    terms = F.array_distinct(F.transform(hits, lambda h: h["term_rank"]))

    def repeats(term: Column) -> Column:
        n = F.size(F.filter(hits, lambda h: h["term_rank"] == term))
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, j: acc + 1.0 / (j * j).cast("double"))

    total = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + repeats(t) * OCCURRENCE_WEIGHT / REPEAT_NORM)
    raw = total / F.greatest(term_count, F.lit(1)).cast("double")
    return raw / (raw + 1.0)


def cover_density(hits: Column, term_count: Column) -> Column:
    """Cover-density rank; ``hits`` sorted by position.

    Any two of the query's terms satisfy the match rule, so the minimal covers are exactly
    the neighbouring hits of different terms; for a one-term query, every hit.
    """
    neighbours = F.when(
        F.size(hits) > 1,
        F.transform(
            F.sequence(F.lit(0), F.size(hits) - 2),
            lambda i: F.when(
                F.get(hits, i)["term_rank"] != F.get(hits, i + 1)["term_rank"],
                OCCURRENCE_WEIGHT / (F.get(hits, i + 1)["position"] - F.get(hits, i)["position"]).cast("double"),
            ).otherwise(F.lit(0.0)),
        ),
    ).otherwise(F.array().cast("array<double>"))
    pairs = F.aggregate(neighbours, F.lit(0.0), lambda acc, x: acc + x)
    raw = F.when(term_count == 1, F.size(hits).cast("double") * OCCURRENCE_WEIGHT).otherwise(pairs)
    return raw / (raw + 1.0)


def match_candidates(
    planned: DataFrame, terms: DataFrame, chunks: DataFrame, posted: DataFrame | None = None, on: Sequence[str] = ("project_id", "term")
) -> DataFrame:
    """Eligible (query, chunk) pairs that match the query's leading terms or carry a hinted note.

    One term must match, of two both, of more any two of the first six. Matching
    occurrences and hint markers meet in a single aggregation by (query, chunk); what a query
    may not see or does not ask for is dropped before it. Stored posting blocks come as ``posted``,
    with the columns they are joined ``on``, which ``terms`` must have too; they are opened after
    that join, and chunks go by their number in the run. A query with a ``run_id`` finds chunks
    of that run only.
    """
    run = [c for c in ("run_id",) if c in planned.columns]
    chunk = [*run, "chunk_key"] if posted is None else [*run, "chunk_no"]
    asked = planned.select(*QUERY_COLUMNS, *run)
    eligible = may_see(F.col("access_scope"), F.col("project_open"), F.col("visibility")) & type_allowed(
        F.col("document_type"), F.col("source_type"), F.col("preferred_type"), F.col("document_types"), F.col("source_types"))
    leading = terms.where(F.col("term_rank") <= C.MATCH_TERMS).select("query_id", *on, "term_rank").join(asked, "query_id")
    met = (occurrences(chunks) if posted is None else posted).join(leading, list(on)).where(eligible)
    met = met if posted is None else opened(met.select("query_id", *run, "term_rank", "block", "hits"))
    hits = met.select("query_id", *chunk, F.struct("position", "term_rank").alias("hit"), F.lit(False).alias("hinted"))
    wanted = planned.select(
        *QUERY_COLUMNS, *run, "project_id", "preferred_position", F.explode("hinted_note_ids").alias("note_id")
    )
    pointed = chunks.where("note_id IS NOT NULL").join(wanted, [*run, "project_id", "note_id"]).where(
        eligible & (F.col("document_type") == F.col("preferred_type"))
        & (F.col("preferred_position").isNull() | (F.col("media_position") == F.col("preferred_position")))
    ).select("query_id", *chunk, F.lit(None).cast("struct<position:int,term_rank:int>").alias("hit"), F.lit(True).alias("hinted"))
    counts = terms.groupBy("query_id").agg(F.least(F.count("*"), F.lit(C.MATCH_TERMS)).cast("int").alias("term_count"))
    grouped = hits.unionByName(pointed).groupBy("query_id", *chunk).agg(
        F.sort_array(F.collect_list("hit")).alias("hits"), F.bool_or("hinted").alias("hinted"),
        F.count_distinct("hit.term_rank").alias("matched"),
    )
    with_counts = grouped.join(counts, "query_id", "left").fillna(0, ["term_count"])
    enough = (F.col("term_count") > 0) & (F.col("matched") >= F.least(F.lit(2), F.col("term_count")))
    return with_counts.where(F.col("hinted") | enough)


CHUNK_COLUMNS = [
    "chunk_key", "document_key", "document_type", "source_type", "source_id", "note_id", "media_position",
    "visibility", "project_open",
]
QUERY_COLUMNS = ["query_id", "access_scope", "preferred_type", "document_types", "source_types"]


def rank_candidates(
    candidates: DataFrame, planned: DataFrame, chunks: DataFrame, limit: int = C.CANDIDATE_LIMIT, hidden: DataFrame | None = None
) -> DataFrame:
    """Of the eligible candidates the best ``2 * limit`` by frequency, then the best ``limit`` by cover density.

    Documents in ``hidden`` (document_key) are left out.
    """
    chunk = [c for c in ("run_id", "chunk_no") if c in candidates.columns] if "chunk_no" in candidates.columns else ["chunk_key"]
    described = chunks.select(*dict.fromkeys([*chunk, *CHUNK_COLUMNS]))
    eligible = candidates.join(described, chunk).drop("run_id", "chunk_no").join(planned.select(*QUERY_COLUMNS), "query_id")
    if hidden is not None:  # not an anti-join, which would be pushed down to all chunks
        eligible = eligible.join(hidden.distinct().withColumn("_hidden", F.lit(True)), "document_key", "left").where("_hidden IS NULL").drop("_hidden")
    preferred = (F.col("document_type") == F.col("preferred_type")).cast("int")
    quick = eligible.withColumn("quick_rank", frequency_rank(F.col("hits"), F.col("term_count")))
    first = top_per_group(quick, ["query_id"], [preferred.desc(), F.desc("quick_rank"), "chunk_key"], 2 * limit)
    dense = first.drop("rn").withColumn("fts_score", cover_density(F.col("hits"), F.col("term_count")))
    return top_per_group(dense, ["query_id"], [preferred.desc(), F.desc("fts_score"), "chunk_key"], limit).drop("rn", "hits")


def query_profile(planned: DataFrame, term_stats: DataFrame) -> DataFrame:
    """Per query: idf map of its indexed terms and the total weight with unknown terms at 8."""
    weights = term_stats.groupBy("query_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "idf"))))).alias("idf_map")
    )
    weight_of = F.aggregate(
        "terms", F.lit(0.0), lambda acc, t: acc + F.coalesce(F.element_at("idf_map", t), F.lit(C.UNKNOWN_TERM_WEIGHT))
    )
    empty = F.create_map().cast("map<string,double>")
    return (
        planned.join(weights, "query_id", "left").withColumn("idf_map", F.coalesce("idf_map", empty))
        .select("query_id", "query", "terms", "hinted_note_ids", "preferred_position",
                "idf_map", F.when(weight_of == 0, F.lit(1.0)).otherwise(weight_of).alias("total_weight"))
    )


def lexical_scores(candidates: DataFrame, profile: DataFrame, chunks: DataFrame, trigram: bool = True) -> DataFrame:
    """Weighted coverage, cover density and trigram similarity with hint, type and position bonuses.

    With ``trigram=False`` the candidates bring their own trigram score.
    """
    texts = chunks.select("chunk_key", "content")
    # Tokens are made of the candidates' texts, not of all that meet them in the join.
    rows = candidates.join(profile, "query_id").join(texts, "chunk_key").withColumn("lexemes", tokenize("content"))
    matched = F.aggregate(
        "terms", F.lit(0.0),
        lambda acc, t: acc + F.when(F.array_contains("lexemes", t), F.coalesce(F.element_at("idf_map", t), F.lit(0.0))).otherwise(0.0),
    )
    w, bonus = C.LEXICAL_WEIGHTS, C.LEXICAL_BONUS
    coverage = matched / F.col("total_weight")
    scored = rows.withColumn("coverage", coverage)
    if trigram:
        scored = scored.withColumn("trigram_score", gram_similarity(trigrams("content"), trigrams("query")))
    hinted = F.coalesce(F.array_contains("hinted_note_ids", F.col("note_id")), F.lit(False))
    at_position = F.coalesce(F.col("preferred_position") == F.col("media_position"), F.lit(False))
    score = (
        F.col("coverage") * w["coverage"]
        + F.col("fts_score") / (F.col("fts_score") + 0.25) * w["fts"]
        + clamp(F.col("trigram_score")) * w["trigram"]
        + F.when(hinted, bonus["hint"]).otherwise(0.0)
        + F.when(F.col("document_type") == F.col("preferred_type"), bonus["type"]).otherwise(0.0)
        + F.when(at_position, bonus["position"]).otherwise(0.0)
    )
    return scored.withColumn("lexical_score", score).withColumn("lexical_confidence", clamp(F.col("lexical_score"))).drop(
        "idf_map", "total_weight", "terms", "lexemes", "content", "query", "hinted_note_ids", "preferred_position"
    )
