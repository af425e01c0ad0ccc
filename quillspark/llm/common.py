"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.session import materialize

#: The separators of the word rules: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_process(name: str, version: str, build: Callable[[], Any]) -> Any:
    """A value built once per Python worker and kept for its later tasks; a new version replaces the old.

    Functions pickled by value get new globals with every task; ``sys.modules`` lives as
    long as the worker.
    """
    kept = sys.modules.setdefault("_quillspark_kept", types.ModuleType("_quillspark_kept")).__dict__
    if name not in kept or kept[name][0] != version:
        kept.pop(name, None)
        kept[name] = version, build()
    return kept[name][1]


def runs(weights: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose weights add up to at most ``most`` (a heavier item stands alone)."""
    begin, total = 0, 0
    for i, w in enumerate(weights):
        if i > begin and total + w > most:
            yield begin, i
            begin, total = i, 0
        total += w
    if begin < len(weights):
        yield begin, len(weights)


def texts_of(batch: Any, column: str = "text") -> list[str]:
    """The strings of an Arrow column; null is the empty string."""
    return [t or "" for t in batch.column(column).to_pylist()]


def batches(source: Iterable[Any], most: int = 1 << 20, column: str = "text") -> Iterator[tuple[Any, list[str]]]:
    """Arrow batches cut so that their texts hold about ``most`` characters; a longer text comes alone."""
    for batch in source:
        texts = texts_of(batch, column)
        for begin, end in runs([len(t) for t in texts], most):
            yield batch.slice(begin, end - begin), texts[begin:end]


def components(links: DataFrame) -> DataFrame:
    """``node, component_id`` of every node of ``links`` (a, b): the smallest node reachable.

    Alternates the large-star and small-star steps (Kiveris et al., "Connected Components in
    MapReduce and Beyond") until the edges stop changing. Each round is written to the shared
    folder, so a lost executor costs one round at most. Minima are combined before they are
    shuffled; the joins are plain equi-joins, which adaptive execution splits for hub nodes.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = materialize(both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                            .where("a <> b").distinct())
        lowest = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = large.join(lowest, F.col("a") == F.col("k"))
        edges = materialize(
            small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct()
        )
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component_id"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id")).unionByName(roots)


def meeting(held: DataFrame, spread: DataFrame) -> DataFrame:
    """Pairs of blocks of rows (``size``, ``salt``) and blocks of queries (``q_size``, ``salt``; a copy for every salt).

    Always a shuffled join that reads ``held`` in order: the copies are many times what they were
    made of, which a broadcast, decided by the size before copying, would bring to the driver.
    As many partitions as asked for are kept, as a pair costs far more than its bytes.
    """
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = held.repartition(parts, "salt", "size"), spread.repartition(parts, "salt", "q_size")
    return left.join(right.hint("merge"), (left["salt"] == right["salt"]) & (left["size"] == right["q_size"]))


def carrying(
    source: Iterable[Any], key: str, block_key: str, start: Callable[[dict], Any], prepare: Callable[[dict], Any],
    visit: Callable[[Any, dict, Any], None], result: Callable[[Any], Any], most: int = 16,
) -> Iterator[Any]:
    """Meets blocks of queries (``key``) with blocks of rows (``block_key``), one pair per row of ``source``.

    What a block of queries has found is carried to its next pair, as a floor for what is still
    worth looking at; ``most`` of them are kept, and one that leaves hands out its result.
    """
    states: OrderedDict[Any, Any] = OrderedDict()
    block: tuple[Any, Any] | None = None
    for batch in source:
        for at in range(len(batch)):
            row = batch.slice(at, 1).to_pylist()[0]
            if block is None or block[0] != row[block_key]:
                block = row[block_key], prepare(row)
            state = states.pop(row[key], None)
            state = start(row) if state is None else state
            visit(state, row, block[1])
            states[row[key]] = state
            if len(states) > most:
                yield result(states.popitem(last=False)[1])
    for state in states.values():
        yield result(state)


class Leaders:
    """The ``k`` best (score, id) of each of ``n`` queries so far; equal scores go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.owner = self.score = self.id = np.empty(0, np.int64)
        #: A query's k-th score; below it nothing can enter.
        self.floor = np.full(n, np.iinfo(np.int64).min)

    def offer(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        able = score >= self.floor[owner]
        owner, score, ids = (np.concatenate(x) for x in ((self.owner, owner[able]), (self.score, score[able]), (self.id, ids[able])))
        order = np.lexsort((ids, ~score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        self.floor[owner[place == self.k - 1]] = score[place == self.k - 1]
        kept = place < self.k
        self.owner, self.score, self.id = owner[kept], score[kept], ids[kept]

    def offer_table(self, owners: np.ndarray, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Offers ``scores`` (``owners`` x ``ids``) where ``fits`` holds."""
        fits = fits & (scores >= self.floor[owners][:, None])
        if scores.shape[1] > 4 * self.k:
            lowest = np.where(fits, scores, np.iinfo(np.int64).min)
            fits &= scores >= np.partition(lowest, -self.k, axis=1)[:, -self.k][:, None]
        row, column = np.nonzero(fits)
        self.offer(owners[row], scores[row, column], ids[column])


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right.T`` of 64-bit integers, by doubles where they hold every sum exactly."""
    largest = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if largest < 2**53:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left @ right.T
