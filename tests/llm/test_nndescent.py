from __future__ import annotations

import numpy as np
from llm.helpers import collected
from pyspark.sql import functions as F

from quillspark.llm import nndescent

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows: list[tuple]) -> list[tuple]:
    good = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and v and None not in v]
    good = [(i, v / np.abs(v).max(), label) for i, v, label in good if np.isfinite(v).all() and v.any()]
    good = [(i, v / np.linalg.norm(v), label) for i, v, label in good]
    links: dict[int, set[int]] = {i: set() for i, _, _ in rows if i is not None}
    for n, (i, v, label) in enumerate(good):
        for j, w, other in good[:n]:
            if i != j and label == other and len(v) == len(w) and v @ w >= nndescent.THRESHOLD:
                links[i].add(j)
                links[j].add(i)
    root = {}
    for i in sorted(links):
        if i not in root:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in root:
                    root[x] = i
                    stack += links[x]
    return sorted(str((i, len(links.get(i, ())), root.get(i), i is None or root[i] == i)) for i, _, _ in rows)


def result(df) -> list[str]:
    return sorted(str((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in collected(df))


def clustered(seed: int) -> list[tuple]:
    """Random vectors, a large tight cluster, a loose one around the threshold, and copies."""
    rng = np.random.default_rng(seed)
    vectors = list(rng.normal(size=(250, 24)))
    tight, loose = rng.normal(size=24), rng.normal(size=24)
    vectors += [tight + rng.normal(0, 0.05, 24) for _ in range(120)]
    vectors += [loose + rng.normal(0, 0.22, 24) * np.linalg.norm(loose) / 5 for _ in range(60)]
    vectors += [vectors[0]] * 5
    order = rng.permutation(len(vectors))
    return [(int(i), vectors[k].tolist(), 1 if k >= 250 else int(k % 2)) for i, k in enumerate(order)]


def test_links_and_components(spark):
    rows = clustered(1)
    assert result(nndescent.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_fringe_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "MEMBERS", 16)
    rows = [r for r in clustered(2) if r[2] == 1]
    assert result(nndescent.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_awkward_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [float("nan"), 1.0, 1.0], 1),
        (10, [float("inf"), 1.0, 1.0], 1), (None, v, 1), (11, [2.0, 4.0, 6.0], 1), (11, [2.0, 4.0, 6.0], 1), (12, [-1.0, -2.0, -3.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(0).alias(c) for c in ("node", "unit", "q", "code", "kept", "n_links")])
    assert result(nndescent.near_duplicates(df)) == brute(rows)
    assert nndescent.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_audit_finds_true_links_only(spark):
    rows = clustered(3)
    units = nndescent.unit_vectors(spark.createDataFrame(rows, SCHEMA).withColumn("label", F.col("label").cast("string")))
    held = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    label = {i: x for i, _, x in rows}
    found = collected(nndescent.audit(units.withColumnRenamed("vec_id", "node"), nndescent.THRESHOLD))
    assert found and all(label[r["a"]] == label[r["b"]] and held[r["a"]] @ held[r["b"]] >= nndescent.THRESHOLD - 1e-12 for r in found)


def rare_pairs(monkeypatch) -> list[tuple]:
    """A tight cluster and a few isolated pairs that the first orders do not bring together."""
    rng = np.random.default_rng(5)
    centre, single = rng.normal(size=24), rng.normal(size=(30, 24))
    vectors = [centre + rng.normal(0, 0.05, 24) for _ in range(1500)] + list(single) + list(single + rng.normal(0, 0.01, (30, 24)))
    projected = nndescent.projected

    def without_pairs(nodes, orders, keep, block):
        return projected(nodes, orders, keep, block).where("u < 1500 AND v < 1500" if min(orders) < nndescent.ORDERS else "true")

    monkeypatch.setattr(nndescent, "projected", without_pairs)
    monkeypatch.setattr(nndescent, "ROUNDS", 1)
    return [(i, v.tolist(), 1) for i, v in enumerate(vectors)]


def test_isolated_pairs_are_missed_by_no_audit(spark, monkeypatch):
    rows = rare_pairs(monkeypatch)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in collected(nndescent.near_duplicates(spark.createDataFrame(rows, SCHEMA)))}
    assert {i: found[i] for i in range(1500, 1560)} == {i: (1, 1500 + (i - 1500) % 30) for i in range(1500, 1560)}
    assert {c for i, (_, c) in found.items() if i < 1500} == {0}


def test_short_recall_is_finished_block_by_block(spark, monkeypatch):
    rows = rare_pairs(monkeypatch)
    monkeypatch.setattr(nndescent, "MOST_ROUNDS", 1)
    monkeypatch.setattr(nndescent, "MEMBERS", 128)
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in collected(nndescent.near_duplicates(spark.createDataFrame(rows, SCHEMA)))}
    assert {i: found[i] for i in range(1500, 1560)} == {i: (1, 1500 + (i - 1500) % 30) for i in range(1500, 1560)}


def test_links_too_rare_to_audit_are_searched_in_blocks(spark, monkeypatch):
    for name, value in (("AUDITED", 8), ("MOST_AUDITED", 32), ("MEMBERS", 64)):
        monkeypatch.setattr(nndescent, name, value)
    projected = nndescent.projected
    monkeypatch.setattr(nndescent, "projected", lambda *a: projected(*a).where("false"))
    rng = np.random.default_rng(7)
    single = rng.normal(size=(400, 24))
    rows = [(i, v.tolist(), 1) for i, v in enumerate([*single, single[3] + 0.01])]
    assert result(nndescent.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_unequal_lengths_and_extreme_sizes(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).tolist(), i % 2) for i in range(60)]
    rows += [(100 + i, (np.array(v) * f).tolist(), label) for i, (_, v, label) in enumerate(rows) for f in (1.5,)]
    rows += [(300, [1e200, 1e200], 1), (301, [2e200, 2e200], 1), (302, [1e-200, 1e-200], 1), (303, [1.0, 1.0, 0.0], 1), (304, [5e-324, 5e-324], 1)]
    assert result(nndescent.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
