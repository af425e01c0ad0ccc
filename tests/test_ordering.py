from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window, functions as F

from quillspark.operators import manifest, ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows."""
    rng = random.Random(7)
    rows = [(None if i % 97 == 0 else ("hot" if i % 3 else f"k{i % 11}"), rng.randrange(50), i, rng.randrange(9)) for i in range(4000)]
    return spark.createDataFrame(rows, "k string, o int, id int, v bigint").repartition(6).cache()


def test_running_equals_a_plain_window(skewed):
    window = Window.partitionBy("k").orderBy(F.desc("o"), "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = skewed.select("id", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("o"), "id")).alias("rn"), F.sum("v").over(window).alias("total"))
    got = ordering.running(skewed, ["k"], [F.desc("o"), "id"], "rn", {"total": F.col("v")}).select("id", "rn", "total")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_running_without_keys_numbers_everything(skewed):
    got = ordering.running(skewed, [], ["o", "id"]).orderBy("rn").select("rn", "o", "id").collect()
    assert [r["rn"] for r in got] == list(range(1, 4001))
    assert [(r["o"], r["id"]) for r in got] == sorted((r["o"], r["id"]) for r in got)


def test_shifted_is_lag_and_lead(skewed):
    ranked = ordering.running(skewed.where("k IS NOT NULL"), ["k"], ["o", "id"])
    both = ordering.shifted(ordering.shifted(ranked, ["k"], "rn", {"before": "id"}), ["k"], "rn", {"after": "id"}, by=-1)
    window = Window.partitionBy("k").orderBy("o", "id")
    plain = skewed.where("k IS NOT NULL").select("id", F.lag("id").over(window).alias("before"), F.lead("id").over(window).alias("after"))
    assert set(map(tuple, both.select("id", "before", "after").collect())) == set(map(tuple, plain.collect()))


@pytest.mark.parametrize("n", [1, 20, 100])
def test_nearest_rank_edges(spark, n):
    values = spark.range(1, n + 1).select(F.col("id").alias("v"))
    got = ordering.nearest_rank(values, [], "v", {"p50": 0.50, "p95": 0.95, "p99": 0.99}).first()
    assert list(got) == [max(1, math.ceil(round(q * n, 9))) for q in (0.50, 0.95, 0.99)]


def test_top_per_group_limits_before_the_shuffle(spark, skewed):
    top = ordering.top_per_group(skewed, ["k"], [F.desc("o"), "id"], 5)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.groupBy("k").count().agg(F.max("count")).first()[0] == 5


def test_checksum_ignores_partitioning_and_sees_changes(spark):
    rows = spark.range(3000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    parts = ["id", "h"]
    values = {manifest.manifest_checksum(rows.repartition(n), parts, ["v1"]).first()["checksum"] for n in (1, 17)}
    assert len(values) == 1
    assert manifest.manifest_checksum(rows, parts, ["v2"]).first()["checksum"] not in values
    changed = rows.withColumn("h", F.when(F.col("id") == 5, F.lit("x")).otherwise(F.col("h")))
    assert manifest.manifest_checksum(changed, parts, ["v1"]).first()["checksum"] not in values
    assert manifest.manifest_checksum(rows.union(rows.limit(1)), parts, ["v1"]).first()["row_count"] == 3001


def test_repair_batch_cursor(spark):
    from quillspark.operators.counters import repair_batch

    table = spark.range(1, 11)
    ids = lambda last, n: [r["id"] for r in repair_batch(table, last, n).orderBy("id").collect()]
    assert ids(0, 4) == [1, 2, 3, 4]
    assert ids(8, 4) == [9, 10]
    assert ids(10, 4) == [1, 2, 3, 4]


def test_empty_window_is_rejected(spark):
    import datetime as dt

    from quillspark.operators.facts import in_window

    with pytest.raises(ValueError):
        in_window(spark.range(1), "id", dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2))


def test_changes_are_counted_across_pieces(spark):
    rng = random.Random(12)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), n, rng.choice("aab"), rng.choice([None, 1])) for n in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, at int, x string, y int")
    got = {r["at"]: r["n"] for r in ordering.running_changes(df, ["k"], ["at"], ["x", "y"], "n").collect()}
    want, last, count = {}, {}, {}
    for k, at, x, y in sorted(rows, key=lambda r: r[1]):
        count[k] = count.get(k, 0) + (k in last and last[k] != (x, y))
        last[k] = x, y
        want[at] = count[k]
    assert got == want
    one = spark.createDataFrame([(1, n, "a" if n < 90 else "b", None) for n in range(100)], "k int, at int, x string, y int")
    assert {r["at"]: r["n"] for r in ordering.running_changes(one, ["k"], ["at"], ["x", "y"], "n").collect()} == {n: int(n >= 90) for n in range(100)}


def test_trees_differ_in_the_leaves_that_changed(spark):
    rows = spark.createDataFrame([(f"k{i}", f"h{i}") for i in range(300)], "k string, h string")
    tree = manifest.digest_tree(rows, "k", ["k", "h"])
    same = manifest.digest_tree(rows.repartition(7), "k", ["k", "h"])
    assert manifest.differing_leaves(tree, same).count() == 0
    other = rows.where("k <> 'k5'").withColumn("h", F.when(F.col("k") == "k9", "other").otherwise(F.col("h"))).unionByName(spark.createDataFrame([("new", "h")], "k string, h string"))
    assert 1 <= manifest.differing_leaves(tree, manifest.digest_tree(other, "k", ["k", "h"])).count() <= 3
    got = {(r["k"], r["status"]) for r in manifest.compare_by_tree(rows, tree, other, "k", "h").collect()}
    assert got == {("k5", "missing"), ("k9", "mismatched"), ("new", "orphan")}
