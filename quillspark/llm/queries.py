"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import hardneg, language, lexsearch, licenses, minhash, mixing, nndescent, packing, pii, tokens, toolcalls, topk, toxicity
from quillspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle:
            ORACLE_SQL[name] = oracle
        return build

    return register


@query("op1_token_counts")
def op1_token_counts(spark, sf):
    return tokens.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_minhash_near_duplicates")
def op2_minhash_near_duplicates(spark, sf):
    return minhash.deduplicate(table(spark, sf, "documents"))


@query("op3_embedding_near_duplicates")
def op3_embedding_near_duplicates(spark, sf):
    return nndescent.near_duplicates(table(spark, sf, "embeddings"))


@query("op4_source_mixing")
def op4_source_mixing(spark, sf):
    return mixing.mix_documents(table(spark, sf, "documents"))


@query("op5_tool_call_linking", toolcalls.ORACLE)
def op5_tool_call_linking(spark, sf):
    conversations = table(spark, sf, "conversations")
    return toolcalls.link(toolcalls.calls_of(conversations), toolcalls.results_of(conversations), toolcalls.SCHEMAS)


@query("op6_toxicity")
def op6_toxicity(spark, sf):
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_exact_top_k", """
    WITH numbers AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM numbers q JOIN numbers c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
""")
def op7_exact_top_k(spark, sf):
    return topk.search(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op8_personal_data")
def op8_personal_data(spark, sf):
    return pii.digest(table(spark, sf, "documents"))


@query("op9_license_sentences")
def op9_license_sentences(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


@query("op10_packing")
def op10_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op11_language")
def op11_language(spark, sf):
    return language.identify(table(spark, sf, "documents"))


@query("op12_lexical_search", lexsearch.ORACLE)
def op12_lexical_search(spark, sf):
    return lexsearch.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_hard_negatives", hardneg.ORACLE)
def op13_hard_negatives(spark, sf):
    rows = table(spark, sf, "embeddings")
    changed = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.mine(changed, F.col("vec_id") % 100 == 0)

