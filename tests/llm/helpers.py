"""Small tables with the awkward cases every operator must handle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for results or inside their plans.
CLASHING = [
    "n_tokens", "n_bytes", "size", "target", "taken", "rank", "row", "salt", "node", "key", "label", "score", "spans", "kept", "component_id", "length", "start", "a", "b", "ids",
]


def documents(spark: SparkSession, texts: list[tuple[int | None, str | None]], sources: list[str | None] | None = None) -> DataFrame:
    """Documents with extra columns whose names clash with the operators' own."""
    sources = sources or ["s"] * len(texts)
    rows = [(i, t, None, s, None if t is None else len(t)) for (i, t), s in zip(texts, sources)]
    return spark.createDataFrame(rows, DOCS).select("*", *[F.lit("extra").alias(c) for c in CLASHING])


AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "two words"), (7, "ab " * 30_000), (8, "x" * 50_000), (9, "Ünï cödé 日本語 😀 é"), (10, "one"),
]


def collected(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]
