"""From raw documents to packed training sequences.

Toxic documents go, one document of every near-duplicate group stays, personal data is
replaced, sources are mixed to their target weights, and the mix is packed into sequences.
Every stage is a function (spark, docs, sf_dir) -> DataFrame; ``run`` writes each result as
Parquet to the shared folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import minhash, mixing, packing, pii, toxicity
from quillspark.llm.common import WORD, table
from quillspark.session import materialize, outcome

#: Words of a shingle in the near-duplicate stage.
WORDS = 5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` written once with a number per row, by which verdicts find their row again.

    Ids may be null or repeated, so they cannot serve.
    """
    return materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents the classifier rejects go.

    Only the text decides, so rows without id or text are scored like others; an empty table
    stays empty. Without labels of both classes nothing is rejected but by a constant score.
    """
    return toxicity.rejecting(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of every near-duplicate group the smallest doc_id stays; so does every row without id.

    Texts are near duplicates at a similarity of 0.8 or more on shingles of ``WORDS`` words. Rows that share a doc_id are one document; their first text in order stays.
    """
    kept = outcome(spark, lambda: minhash.deduplicate(docs, words=WORDS).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct())
    named = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi")
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text", "lang", "source", "n_chars")).alias("first")).where("n > 1 AND doc_id IS NOT NULL")
    once = named.join(repeated.select("doc_id", "first"), "doc_id", "left").withColumn("own", F.xxhash64("text", "lang", "source", "n_chars"))
    single, several = once.where("first IS NULL"), once.where("first = own").dropDuplicates(["doc_id"])
    return single.select(*COLUMNS).unionByName(several.select(*COLUMNS)).unionByName(docs.select(*COLUMNS).where("doc_id IS NULL"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: personal data in the texts is replaced by its kind; ``n_chars`` follows the text.

    Null texts stay null and keep their ``n_chars``; ids do not matter; an empty table stays empty.
    """
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: each document as often as the mix reads it; the reading a target ends in is cut there.

    A cut reading holds its words joined by single spaces. Documents without words, null texts
    among them, are not taken; a null source is a source of its own; an empty table stays empty.
    """
    numbered = with_rows(docs)
    taken = mixing.mix(numbered.select("doc_id", "source", mixing.words_in("text").alias("size"), "row"))
    parts = taken.select("row", "size", F.explode("parts").alias("part")).select("row", "size", "part.*")
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), (F.col("first") + 1).cast("int"), (F.col("last") - F.col("first")).cast("int"))
    whole = (F.col("first") == 0) & (F.col("last") == F.col("size"))
    text = F.when(whole, F.col("text")).otherwise(F.array_join(words, " "))
    read = numbered.join(parts, "row").withColumn("text", text)
    return read.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: the mix as pieces of sequences of at most 2,048 tokens.

    Sequences follow lengths, not the order of the mix. Null ids stay null; an empty table gives
    an empty result.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained scores, hashed orders and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return materialize(STAGES[-1][1](spark, docs, sf_dir))
