"""Shortest-pack-first sequence packing over the length histogram.

Documents become token ids closed by one end id and are cut into pieces. Only the small piece
rows are shuffled, never texts or ids. The histogram of piece lengths (at most ``size`` rows,
whatever the corpus) is packed on the driver: lengths longest first, each into the pack with
the most room, for whole groups of equal packs at a time. The resulting patterns are joined
back to the pieces by rank within their length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quillspark.llm.common import batches
from quillspark.llm.tokens import transducer
from quillspark.session import materialize

END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(total: int, size: int) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then the rest."""
    return [size] * (total // size) + [total % size] * (total % size > 0)


def pieces(docs: DataFrame, path: str, size: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` of every piece; one narrow pass over the texts."""

    def tokenize(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = transducer(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch, texts in batches(source):
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), compiled.token_ids(texts)):
                ids = memoryview(ids + end)
                start = 0
                for length in cut(len(ids) // 4, size):
                    values = (doc, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), len(ids) // 4)
                    for column, value in zip(rows, values):
                        column.append(value)
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(tokenize, PIECE)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packs as ``(copies, ((length, how many), ...))``.

    Groups of equal packs wait in a heap by the room they have. A length takes the roomiest
    group; several of one length go into one pack together while they fit and shortest packs
    stay shortest, so the work depends on the distinct lengths only, not on the documents.
    """
    open_packs: list[tuple[int, int, tuple[tuple[int, int], ...], int]] = []  # minus room, number, content, copies
    closed: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    number = 0

    def put(room: int, content: tuple[tuple[int, int], ...], copies: int) -> None:
        nonlocal number
        if room:
            heapq.heappush(open_packs, (-room, number, content, copies))
            number += 1
        else:
            closed.append((copies, content))

    def added(content: tuple[tuple[int, int], ...], length: int) -> tuple[tuple[int, int], ...]:
        if content and content[-1][0] == length:
            return (*content[:-1], (length, content[-1][1] + 1))
        return (*content, (length, 1))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, _, content, copies = heapq.heappop(open_packs)
                used = min(left, copies)
                put(-room - length, added(content, length), used)
                if copies > used:
                    put(-room, content, copies - used)
            else:
                # New packs for all that is left, each with as many as fit.
                each = min(size // length, left)
                used = left // each * each
                put(size - each * length, ((length, each),), used // each)
            left -= used
    return closed + [(copies, content) for _, _, content, copies in open_packs]


def slots(histogram: dict[int, int], size: int) -> dict[str, np.ndarray]:
    """Where the piece of a rank within its length goes.

    One row per pattern and length, ordered by (length, first rank): ranks from ``first`` go
    to the sequences from ``sequence``, ``each`` pieces per sequence from ``offset`` on.
    """
    taken: dict[int, int] = {}
    rows = []
    sequence = 0
    for copies, content in shortest_pack_first(histogram, size):
        offset = 0
        for length, each in content:
            first = taken.get(length, 0)
            rows.append((length, first, sequence, offset, each))
            taken[length] = first + copies * each
            offset += length * each
        sequence += copies
    ordered = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "offset", "each"), ordered.T))


def pack(docs: DataFrame, path: str, size: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``.

    Null and empty texts are one-token documents (the end id). Repeated rows and null ids are
    packed as documents of their own. An empty table gives an empty result. Reruns agree: ranks
    follow the ids, then the piece's content. Other columns are neither read nor returned.

    Hot lengths (copies of one text) are ranked in salted groups whose counts, at most
    ``size`` times the number of shuffle partitions, are added up by a window per length.
    """
    spark = docs.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = materialize(
        pieces(docs, path, size, id_column, text_column)
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(salts)).cast("int"))
    )
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    begin = materialize(counts.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin")))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        salted.withColumn("place", F.row_number().over(within) - 1)
        .join(begin, ["length", "salt"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("begin") + F.col("place")).alias("rank"))
    )
    table = slots(histogram, size)

    def place(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = int(table["first"].max(initial=0)) + 1
        for batch in source:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            # Every rank lies at or after the first rank of its own length's row.
            at = np.searchsorted(table["length"] * many + table["first"], length * many + np.minimum(rank, many - 1), "right") - 1
            past, each = rank - table["first"][at], table["each"][at]
            sequence = table["sequence"][at] + past // each
            offset = table["offset"][at] + past % each * length
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PIECE + ", sequence_id long, offset long")
