"""Hard negatives: cover trees by their invariants, results against a plain version."""

from __future__ import annotations

import math

import numpy as np
from llm.helpers import collected
from pyspark.sql import functions as F

from quillspark.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows: list[tuple], every: int) -> list[tuple]:
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, (label, [math.floor(256 * x) for x in v]))
    out = []
    for a, (label, v) in good.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in good.items() if i != a and len(w) == len(v)]
        for ps, p, _ in sorted(s for s in scored if s[2] == label)[:5]:
            window = sorted(s for s in scored if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:10]
            out += [(a, p, rank, n, -ps, -ns) for rank, (ns, n, _) in enumerate(window, 1)]
    return sorted(out)


def result(df) -> list[tuple]:
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in collected(df))


def clustered(seed: int, n: int, size: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=(n // 2, size)), rng.normal(size=(6, size))[rng.integers(0, 6, n - n // 2)] + 0.1 * rng.normal(size=(n - n // 2, size))])


def test_small_blocks_equal_the_plain_version(spark, monkeypatch):
    for name, value in (("CANDIDATES", 60), ("WINDOWS", 12), ("LEAF", 4)):
        monkeypatch.setattr(hardneg, name, value)
    rows = [(i, v.tolist(), i * i % 5) for i, v in enumerate(clustered(1, 400, 10))]
    assert result(hardneg.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)) == plain(rows, 10)


def test_copies_and_one_large_label(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "CANDIDATES", 50)
    base = clustered(2, 300, 6)
    rows = [(i, (base[0] if i % 3 == 0 else v).tolist(), 0 if i % 4 else i % 7) for i, v in enumerate(base)]
    assert result(hardneg.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0)) == plain(rows, 20)


def test_awkward_rows(spark):
    v = [1.0, 2.0]
    rows = [
        (0, v, 1), (10, [0.0, 0.0], 1), (20, [-1.0, -2.0], 1), (1, v, 1), (2, v, 2), (3, [0.5, 1.0], 2), (4, [0.7, 1.2], 3), (5, None, 1), (6, [], 1), (7, [1.0, None], 2),
        (8, [float("nan"), 1.0], 2), (9, [float("inf"), 1.0], 2), (None, v, 1), (11, v, None), (12, [1.0, 2.0, 3.0], 1), (30, [], 2), (13, [0.3, 0.9], 2), (14, [-0.001, 0.7], 3),
    ]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(0).alias(c) for c in ("size", "ids", "numbers", "part", "salt", "rank", "score", "cell", "open")])
    assert result(hardneg.mine(df, F.col("vec_id") % 10 == 0)) == plain(rows, 10)
    assert result(hardneg.mine(df.unionByName(df), F.col("vec_id") % 10 == 0)) == plain(rows, 10)
    assert hardneg.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0


def test_cover_trees_cover():
    rows = np.floor(256 * clustered(3, 700, 8)).astype(np.int64)
    order, starts, ends, angles, children = hardneg.cover(rows)
    assert sorted(order) == list(range(700)) and (starts[0], ends[0]) == (0, 700)
    length = np.sqrt((rows.astype(float) ** 2).sum(1).max())
    points = np.column_stack([rows, np.sqrt(np.maximum(length**2 - (rows.astype(float) ** 2).sum(1), 0))])[order] / length
    for node in range(len(starts)):
        own = points[starts[node]:ends[node]]
        assert np.arccos(np.clip(own @ own[0], -1, 1)).max() <= angles[node] + 1e-6
        below = range(children[node], children[node + 1])
        if len(below):
            assert [starts[c] for c in below] + [ends[node]] == [starts[node], *[ends[c] for c in below]]
            centres = points[[starts[c] for c in below]]
            chords = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[~np.eye(len(below), dtype=bool)]
            assert chords.min() > 2 * np.sin(angles[node] / 2) / hardneg.BASE - 1e-6


def test_bounds_hold_and_nodes_are_skipped():
    rows = np.floor(256 * clustered(4, 1000, 6)).astype(np.int64)
    order, starts, ends, angles, children = hardneg.cover(rows)
    block = {"ids": order, "labels": order % 2, "numbers": rows[order], "starts": starts, "ends": ends, "radii": angles, "children": children}
    tree = hardneg.Tree({n: c.tobytes() for n, c in block.items()} | {"size": 6, "lowest": 0, "highest": 1})
    n = 50
    asked = hardneg.Asked(rows[:n], np.arange(n), np.zeros(n, int), np.arange(n), np.full(n, hardneg.ANY.min), np.full(n, hardneg.ANY.max), True, 5)
    least, largest = asked.bounds(tree, np.arange(n), np.arange(len(starts)))
    scores = rows[:n] @ rows[order].T
    for node in range(len(starts)):
        part = scores[:, starts[node]:ends[node]]
        assert (least[:, node] <= part.min(1)).all() and (part.max(1) <= largest[:, node]).all()
    asked.descend(tree)
    assert asked.visited < 0.6 * n * 1000


def test_large_integers_stay_exact(spark):
    rows = [(i, [float(2**20 + i * 3), float(2**21 - i), -float(2**20 + i % 7)], i % 3) for i in range(40)]
    assert result(hardneg.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)) == plain(rows, 10)


def test_windows_meet_trees_in_a_shuffle(spark, monkeypatch):
    """Copies of the windows for every salt are not broadcast."""
    monkeypatch.setattr(hardneg, "CANDIDATES", 20)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(clustered(5, 120, 6))]
    numbers = hardneg.numbered(spark.createDataFrame(rows, SCHEMA).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding"))
    windows = numbers.where("vec_id % 10 = 0").select(F.col("vec_id").alias("anchor_id"), "label", "numbers", F.expr(
        f"array(struct(0L AS positive_id, 0L AS positive_score, {hardneg.ANY.min + 1}L AS low, {hardneg.ANY.max}L AS high))").alias("open"))
    found = hardneg.met(hardneg.planted(numbers), windows, True, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.select("anchor_id").distinct().count() == 12
