"""Cutting one text into overlapping chunks.

Where a chunk ends depends on where the one before it ended, so the cut points of a text
are found in sequence, by an aggregation over its steps. Everything else about chunks (contents,
offsets, hashes, tokens, citations) is computed from those points; all are column expressions.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from quillspark.functions.contract import (
    CHUNK_BOUNDARIES, CHUNK_OVERLAP_BYTES, MAX_CHUNK_BYTES, MIN_CUT_SHARE,
)
from quillspark.functions.text import col

# executors receive the helpers below with the task, so they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BOUNDARY = re.compile("|".join(re.escape(c) for c in CHUNK_BOUNDARIES).encode())


def _lead_byte(data: bytes, at: int, step: int) -> int:
    """Nearest position from ``at`` in direction ``step`` that does not split a character."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += step
    return at


def cut_points(text: str | None, max_bytes: int = MAX_CHUNK_BYTES, overlap: int = CHUNK_OVERLAP_BYTES) -> list[int]:
    """Flat list of (start byte, end byte, start character, end character) per chunk; what ``chunk_points`` is checked against.

    The text's boundary marks are located once; each chunk then takes the last mark that
    lies in the final part of its byte budget, by binary search, and otherwise the budget.
    """
    if not 0 <= overlap < max_bytes:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    data = (text or "").encode()
    marks = [(m.start(), m.end()) for m in _BOUNDARY.finditer(data)]
    ends = [end for _, end in marks]
    shortest = int(max_bytes * MIN_CUT_SHARE)
    points: list[int] = []
    start, start_char = 0, 0
    while start < len(data):
        if len(data) - start <= max_bytes:
            end = len(data)
        else:
            end = _lead_byte(data, start + max_bytes, -1)
            last = bisect_right(ends, end) - 1
            if last >= 0 and marks[last][0] >= _lead_byte(data, start + shortest, 1):
                end = ends[last]
        end_char = start_char + len(data[start:end].decode())
        points += [start, end, start_char, end_char]
        if end == len(data):
            break
        following = _lead_byte(data, end - overlap, 1)
        if following <= start:
            following = end
        start_char = end_char - len(data[following:end].decode())
        start = following
    return points


def in_slices(texts: pa.Array, made: Callable, kind: pa.DataType, rows: int = 64) -> pa.Array:
    """``made`` of every text; of an Arrow batch only ``rows`` texts and their results are Python objects at a time."""
    parts = [pa.array([made(t) for t in texts.slice(at, rows).to_pylist()], kind) for at in range(0, len(texts), rows)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bytes(data: Column, start: Column, end: Column) -> Column:
    return F.substring(data, start + 1, end - start)


def _length(data: Column, start: Column, end: Column) -> Column:
    """Characters of a byte range that begins and ends between characters."""
    return F.char_length(F.decode(_bytes(data, start, end), "UTF-8"))


def _lead(data: Column, at: Column, step: int) -> Column:
    """``_lead_byte`` as a column; a character has at most three bytes after its first."""
    found = at + 3 * step
    for moved in (at + 2 * step, at + step, at):
        byte = _bytes(data, moved, moved + 1)
        found = F.when((byte >= F.lit(b"\x80")) & (byte < F.lit(b"\xc0")), found).otherwise(moved)
    return found


def chunk_points(text: Column | str, max_bytes: int = MAX_CHUNK_BYTES, overlap: int = CHUNK_OVERLAP_BYTES) -> Column:
    """``cut_points`` as a column expression: one chunk per step, so that no text leaves the JVM."""
    if not 0 <= overlap < max_bytes:
        raise ValueError("overlap must be at least 0 and below the chunk size")
    shortest = int(max_bytes * MIN_CUT_SHARE)
    upto_mark = F.lit(f"(?s)^.*[{CHUNK_BOUNDARIES}]")

    def cut(data: Column, start: Column) -> Column:
        def at_mark(low: Column, high: Column) -> Column:
            kept = F.octet_length(F.regexp_substr(F.decode(_bytes(data, low, high), "UTF-8"), upto_mark))
            return F.coalesce(low + kept, high)

        longer = _bound(F.struct(_lead(data, start + shortest, 1).alias("low"), _lead(data, start + max_bytes, -1).alias("high")), lambda b: at_mark(b["low"], b["high"]))
        size = F.octet_length(data)
        return F.when(size - start <= max_bytes, size).otherwise(longer)

    def step(data: Column, state: Column) -> Column:
        def chunk(end: Column) -> Column:
            last = F.octet_length(data) == end
            back = _lead(data, end - overlap, 1)
            following = F.when(last | (back <= state["start"]), end).otherwise(back)
            end_char = state["start_char"] + _length(data, state["start"], end)
            return _bound(F.struct(following.alias("start"), end_char.alias("end_char")), lambda c: F.struct(
                c["start"].alias("start"), (c["end_char"] - _length(data, c["start"], end)).alias("start_char"),
                F.concat(state["points"], F.array(state["start"], end, state["start_char"], c["end_char"])).alias("points")))

        return F.when(state["start"] >= F.octet_length(data), state).otherwise(_bound(cut(data, state["start"]), chunk))

    def points(data: Column) -> Column:
        begin = F.struct(F.lit(0).alias("start"), F.lit(0).alias("start_char"), F.array().cast("array<int>").alias("points"))
        # A step moves on by what two chunks may not share, at least by a byte.
        steps = F.floor(F.octet_length(data) / max(1, min(shortest, max_bytes - 3) - overlap)).cast("int") + 1
        return F.aggregate(F.sequence(F.lit(1), steps), begin, lambda state, _: step(data, state), lambda state: state["points"])

    return _bound(F.encode(F.coalesce(col(text), F.lit("")), "UTF-8"), points)


def chunk_ranges(points):
    """Array of ``(chunk_index, start_byte, end_byte, start_char, end_char)`` from flat points."""
    return F.transform(
        F.sequence(F.lit(0), (F.size(points) / 4).cast("int") - 1),
        lambda i: F.struct(
            i.alias("chunk_index"),
            F.get(points, i * 4).alias("start_byte"),
            F.get(points, i * 4 + 1).alias("end_byte"),
            F.get(points, i * 4 + 2).alias("start_char"),
            F.get(points, i * 4 + 3).alias("end_char"),
        ),
    )
