"""Which texts contain which anchor strings, by blocked equi-joins with an exact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillspark.functions.text import col

SHINGLE = 5
GRAM = 4


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def _shingle(words: Column, start: Column) -> Column:
    """Hash of the ``SHINGLE`` words from 0-based ``start``; the words are not joined, which costs more than the hash."""
    return F.xxhash64(*[F.get(words, start + i) for i in range(SHINGLE)])


def _shingles(words: Column) -> Column:
    return F.when(
        F.size(words) >= SHINGLE,
        F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: _shingle(words, i)),
    ).otherwise(F.array().cast("array<bigint>"))


def _char_grams(text: Column, size: int = GRAM) -> Column:
    return F.when(
        F.char_length(text) >= size,
        F.transform(F.sequence(F.lit(1), F.char_length(text) - size + 1), lambda i: F.xxhash64(F.substring(text, i, F.lit(size)))),
    ).otherwise(F.array().cast("array<bigint>"))


def _checked(pairs: DataFrame, texts: DataFrame, anchors: DataFrame) -> DataFrame:
    return (
        pairs.join(texts, "text_id").join(anchors, "anchor_id")
        .where(F.contains("text", "anchor")).select("text_id", "anchor_id")
    )


def _of_short(texts: DataFrame, short_anchors: DataFrame) -> DataFrame:
    """Pairs of anchors that have a four-character gram but too few words."""
    # anchors are few against the texts' grams: keep only grams some anchor has, count those
    anchor_grams = short_anchors.select("anchor_id", F.explode(F.array_distinct(_char_grams(col("anchor")))).alias("key"))
    text_grams = texts.select("text_id", F.explode(F.array_distinct(_char_grams(col("text")))).alias("key")).join(
        anchor_grams.select("key").distinct(), "key", "left_semi"
    )
    common = text_grams.groupBy("key").agg(F.count("*").alias("n"))
    rarest = anchor_grams.join(common, "key", "left").groupBy("anchor_id").agg(
        F.min_by("key", F.struct(F.coalesce("n", F.lit(0)), "key")).alias("key")
    )
    proposed_short = text_grams.join(rarest, "key").select("text_id", "anchor_id")
    return _checked(proposed_short, texts, short_anchors)


def containment(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """All pairs ``(text_id, anchor_id)`` with the anchor inside the text, exactly.

    ``texts``: text_id, text. ``anchors``: anchor_id, anchor. An empty anchor is in no text.

    An anchor of seven or more words keys on words two to six, which any containing text
    must hold as five whole words in a row. A shorter anchor keys on its least common
    four-character gram; one of fewer than four characters is its own gram. Equal keys only
    propose a pair; the text itself is then searched.
    """
    # words become a column of their own: inside a lambda the split would run once per element
    split = anchors.withColumn("words", _words(col("anchor")))
    long_anchors = split.where(F.size("words") >= SHINGLE + 2)
    short_anchors = split.where((F.size("words") < SHINGLE + 2) & (F.char_length("anchor") >= GRAM)).drop("words")
    tiny_anchors = split.where((F.size("words") < SHINGLE + 2) & F.char_length("anchor").between(1, GRAM - 1)).drop("words")

    text_words = texts.select("text_id", _words(col("text")).alias("words"))
    text_keys = text_words.select("text_id", F.explode(_shingles(F.col("words"))).alias("key"))
    long_keys = long_anchors.select(
        "anchor_id", _shingle(F.col("words"), F.lit(1)).alias("key")
    )
    long_anchors = long_anchors.drop("words")
    proposed = text_keys.join(long_keys, "key").select("text_id", "anchor_id").distinct()
    found = _checked(proposed, texts, long_anchors)

    if not short_anchors.isEmpty():  # spares the texts a pass
        found = found.unionByName(_of_short(texts, short_anchors))
    if tiny_anchors.isEmpty():
        return found
    tiny_keys = tiny_anchors.select("anchor_id", F.xxhash64("anchor").alias("key"))
    tiny_grams = F.concat(*[_char_grams(col("text"), size) for size in range(1, GRAM)])
    proposed_tiny = texts.select("text_id", F.explode(F.array_distinct(tiny_grams)).alias("key")).join(tiny_keys, "key").select("text_id", "anchor_id")
    return found.unionByName(_checked(proposed_tiny, texts, tiny_anchors))
