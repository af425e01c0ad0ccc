"""Exact top-k inner products without random access (NRA), for blocks of queries at once.

Candidates are cut into blocks; a block keeps one list per component, sorted by value. For a
query the lists are read from their favourable ends, to a depth that doubles. Every candidate
has a lower bound (what was read, and the worst of the lists it was not yet seen in) and an
upper bound (what was read, and the place reading has reached in those lists). Reading stops
when few candidates can still reach the k-th lower bound; their final scores are then resolved.
At one depth the bounds of all queries of a block are four matrix products, as what a list has
shown depends on the sign of a query's component only.

The query set goes against all rows block by block: query blocks and candidate blocks meet
through an equi-join on their numbers, spread over salts. A block of queries carries its k-th
scores from one block of candidates to the next, where they are a floor from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillspark.llm.common import Leaders, carrying, meeting, products
from quillspark.session import materialize

SCALE = 256
CANDIDATES, QUERIES = 4096, 512
#: Sorted entries read from every list before bounds are compared; the depth doubles from there.
STEP = 256
BLOCK = "part long, size int, ids binary, numbers binary"


class SortedLists:
    """A block of candidates with one sorted list per component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.reals = rows.astype(np.float64)
        order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(self.reals, order, 0)
        self.places = np.empty_like(order)
        np.put_along_axis(self.places, order, np.arange(len(rows))[:, None], 0)

    def top(self, queries: np.ndarray, own: np.ndarray, leaders: Leaders) -> int:
        """Offers the best candidates but ``own`` of every query to ``leaders``; returns the depth read."""
        n, k = len(self.ids), leaders.k
        up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        # Doubles round sums beyond 2**53; bounds are widened by what that can amount to.
        slack = ((up - down) @ np.abs(self.reals).max(0, initial=0)) * (queries.shape[1] + 4) * 2.0**-51
        alive = own[:, None] != self.ids
        depth = 0
        while n and alive.sum() > len(queries) * max(4 * k, n // 32):
            depth = 2 * depth or STEP
            if depth >= n:
                break
            upper = up @ np.maximum(self.reals, self.values[n - depth]).T + down @ np.minimum(self.reals, self.values[depth - 1]).T
            from_top, from_bottom = self.places >= n - depth, self.places < depth
            lower = up @ np.where(from_top, self.reals, self.values[0]).T + down @ np.where(from_bottom, self.reals, self.values[-1]).T
            floor = leaders.floor.astype(np.float64)
            if n > k:
                floor = np.maximum(floor, np.partition(np.where(alive, lower, -np.inf), n - k, axis=1)[:, n - k])
            alive &= upper + 2 * slack[:, None] >= floor[:, None]
        some = alive.any(0)
        leaders.offer_table(np.arange(len(queries)), products(queries, self.rows[some]), alive[:, some], self.ids[some])
        return min(depth, n)


def integers(rows: DataFrame) -> DataFrame:
    """``vec_id, numbers`` (64-bit, as bytes) of the rows that take part."""

    def scale(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            vectors = [np.array([np.nan] if v is None or None in v else v, np.float64) for v in batch.column("embedding").to_pylist()]
            good = [bool(np.isfinite(v).all()) for v in vectors]
            scaled = [np.floor(SCALE * v).astype(np.int64).tobytes() if ok else None for v, ok in zip(vectors, good)]
            full = pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(scaled, pa.binary())], names=["vec_id", "numbers"])
            yield full.filter(pa.array(good, pa.bool_()))

    return rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding").mapInArrow(scale, "vec_id long, numbers binary")


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` packed into blocks of at most ``most`` vectors of one length."""

    def packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[int, bytes]]] = {}

        def block(size: int) -> pa.RecordBatch:
            held = waiting.pop(size)
            ids = np.array([i for i, _ in held], np.int64).tobytes()
            part = held[0][0]
            return pa.RecordBatch.from_pylist(
                [{"part": part, "size": size // 8, "ids": ids, "numbers": b"".join(v for _, v in held)}],
                pa.schema([("part", pa.int64()), ("size", pa.int32()), ("ids", pa.binary()), ("numbers", pa.binary())]),
            )

        for batch in source:
            for i, numbers in zip(batch.column("vec_id").to_pylist(), batch.column("numbers").to_pylist()):
                held = waiting.setdefault(len(numbers), [])
                held.append((i, numbers))
                if len(held) == most:
                    yield block(len(numbers))
        for size in list(waiting):
            yield block(size)

    return rows.mapInArrow(packed, BLOCK)


def search(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each row where ``queries`` holds.

    ``queries`` is a condition on ``vec_id``. Rows without id and vectors that are null or hold
    nulls or non-finite numbers take no part; an empty vector scores 0; only vectors of equal
    length are compared. Scores must fit a 64-bit integer. Repeated rows are candidates each;
    rows that share the query's id are not candidates of it, and a repeated query is asked once.
    An empty table gives an empty result. Other columns are neither read nor returned.
    """
    spark = vectors.sparkSession
    numbers = materialize(integers(vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[vector_column].alias("embedding"))))
    packed = materialize(blocks(numbers, CANDIDATES).select(
        "size", F.col("ids").alias("c_ids"), F.col("numbers").alias("c_numbers"), F.monotonically_increasing_id().alias("held_number")
    ))
    salts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), packed.count()))
    held = packed.withColumn("salt", F.pmod(F.xxhash64("held_number"), F.lit(salts)))
    once = materialize(numbers.where(queries).dropDuplicates(["vec_id"]))
    asked = materialize(blocks(once.repartition(max(1, -(-once.count() // QUERIES)), "vec_id"), QUERIES).withColumn("asked_number", F.monotonically_increasing_id()))
    spread = asked.select(F.col("size").alias("q_size"), "ids", "numbers", "asked_number", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))

    def start(row: dict) -> tuple[np.ndarray, np.ndarray, Leaders]:
        ids = np.frombuffer(row["ids"], np.int64)
        return ids, np.frombuffer(row["numbers"], np.int64).reshape(len(ids), row["size"]), Leaders(len(ids), k)

    def prepare(row: dict) -> SortedLists:
        ids = np.frombuffer(row["c_ids"], np.int64)
        return SortedLists(ids, np.frombuffer(row["c_numbers"], np.int64).reshape(len(ids), row["size"]))

    def visit(state: tuple[np.ndarray, np.ndarray, Leaders], row: dict, lists: SortedLists) -> None:
        lists.top(state[1], state[0], state[2])

    def result(state: tuple[np.ndarray, np.ndarray, Leaders]) -> pa.RecordBatch:
        ids, _, found = state
        return pa.RecordBatch.from_arrays([pa.array(ids[found.owner]), pa.array(found.id), pa.array(found.score)], names=["query_id", "vec_id", "score"])

    def answer(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from carrying(source, "asked_number", "held_number", start, prepare, visit, result)

    pairs = meeting(held, spread).drop("salt", "q_size")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.mapInArrow(answer, "query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
