from __future__ import annotations

import math

import numpy as np
from llm.helpers import collected
from pyspark.sql import functions as F

from quillspark.llm import topk
from quillspark.llm.common import Leaders

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows: list[tuple], every: int, k: int) -> list[tuple]:
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in good if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def result(df) -> list[tuple]:
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in collected(df))


def test_random_vectors_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 70)
    monkeypatch.setattr(topk, "QUERIES", 6)
    monkeypatch.setattr(topk, "STEP", 8)
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 12)))]
    assert result(topk.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)) == brute(rows, 10, 5)


def best(rows: np.ndarray, query: int, k: int) -> list[tuple[int, int]]:
    scores = [(-sum(int(a) * int(b) for a, b in zip(rows[query], row)), i) for i, row in enumerate(rows) if i != query]
    return [(-s, i) for s, i in sorted(scores)[:k]]


def test_reading_stops_early_and_stays_exact(monkeypatch):
    monkeypatch.setattr(topk, "STEP", 16)
    rng = np.random.default_rng(2)
    rows = rng.integers(-5, 5, (500, 4))
    rows[7] = rows[311] = 60
    rows[0] = [3, 2, 1, 1]
    leaders = Leaders(1, 2)
    depth = topk.SortedLists(np.arange(500), rows).top(rows[:1], np.array([0]), leaders)
    assert leaders.id.tolist() == [7, 311] and leaders.score.tolist() == [420, 420] and depth < 500


def test_scores_carry_from_block_to_block():
    rng = np.random.default_rng(3)
    rows = np.floor(256 * rng.normal(size=(900, 8))).astype(np.int64)
    queries = np.arange(0, 900, 30)
    leaders = Leaders(len(queries), 5)
    for begin in range(0, 900, 300):
        part = slice(begin, begin + 300)
        topk.SortedLists(np.arange(900)[part], rows[part]).top(rows[queries], queries, leaders)
    for n, q in enumerate(queries):
        own = leaders.owner == n
        assert list(zip(leaders.score[own].tolist(), leaders.id[own].tolist())) == best(rows, q, 5)


def test_scores_beyond_doubles_are_exact(monkeypatch):
    monkeypatch.setattr(topk, "STEP", 8)
    rng = np.random.default_rng(4)
    rows = rng.integers(2**29, 2**29 + 4, (200, 5))  # scores of about 2**60 that differ by single units
    leaders = Leaders(20, 5)
    topk.SortedLists(np.arange(200), rows).top(rows[:20], np.arange(20), leaders)
    for q in range(20):
        own = leaders.owner == q
        assert list(zip(leaders.score[own].tolist(), leaders.id[own].tolist())) == best(rows, q, 5)


def test_awkward_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, []), (5, [1.0, None]), (6, [float("inf"), 1.0]), (None, [9.0, 9.0]), (10, [0.0, 0.0]),
        (11, [1.0, 2.0, 3.0]), (12, [-0.001, 0.001]), (20, [float("nan"), 1.0]), (30, [1.0, 2.0, 3.0]), (1, [1.0, 2.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(0).alias(c) for c in ("size", "ids", "numbers", "part", "salt", "rank", "score")])
    assert result(topk.search(df, F.col("vec_id") % 10 == 0)) == brute(rows, 10, 5)
    assert topk.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0


def test_blocks_of_queries_meet_blocks_of_rows_in_a_shuffle(spark, monkeypatch):
    """However small they are before they are copied for every salt; a broadcast of the copies would go through the driver."""
    monkeypatch.setattr(topk, "CANDIDATES", 20)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(100, 6)))]
    found = topk.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert result(found) == brute(rows, 10, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
