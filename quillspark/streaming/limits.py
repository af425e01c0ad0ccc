"""Fixed windows that start at a key's first hit, for keys of any size.

Where a window starts depends on the windows before it. Instead of walking a key's hits one by
one, every hit gets a pointer to the hit that would start the next window if it started one
itself; pointers are composed by doubling, so that after r rounds the starts of 2**r windows
are known. All steps are ordered scans and equi-joins by (key, place), so a key with a third of
all hits is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.operators.ordering import running
from quillspark.session import materialize

DECISION = "key bigint, event_id bigint, hits bigint, remaining bigint, reset_ms bigint, allowed boolean"
STATE = "key bigint, start_ms bigint, hits bigint"


def ranked_hits(events: DataFrame, stored: DataFrame, window_ms: int) -> DataFrame:
    """Hits with their place in the key's time order, and the place of the first hit a window started here would not hold.

    Hits and window ends are ordered together; the hits counted up to an end give the pointer.
    An end that falls on a hit's own time comes before it. The open window of ``stored`` is a
    start at place 0.
    """
    hit = events.select("key", "event_id", "occurred_ms", F.col("occurred_ms").alias("at"), F.lit(1).alias("is_hit"))
    ends = hit.select("key", "event_id", "occurred_ms", (F.col("at") + window_ms).alias("at"), F.lit(0).alias("is_hit"))
    asked = events.select("key").distinct()
    opened = stored.join(asked, "key").select(
        "key", F.lit(None).cast("bigint").alias("event_id"), F.col("start_ms").alias("occurred_ms"), (F.col("start_ms") + window_ms).alias("at"), F.lit(0).alias("is_hit"))
    scanned = running(
        hit.unionByName(ends).unionByName(opened), ["key"], ["at", "is_hit", F.asc_nulls_first("event_id")], rank=None, sums={"upto": F.col("is_hit")})
    places = scanned.where("is_hit = 1").select("key", "event_id", "occurred_ms", F.col("upto").alias("place"))
    after = scanned.where("is_hit = 0").select("key", "event_id", "occurred_ms", (F.col("upto") + 1).alias("next"))
    pointers = places.join(after.where("event_id IS NOT NULL").select("key", "event_id", "next"), ["key", "event_id"])
    return pointers.unionByName(after.where("event_id IS NULL").withColumn("place", F.lit(0).cast("bigint")))


def window_starts(pointers: DataFrame) -> DataFrame:
    """``key, place`` of the hits that start a window (place 0: the window that was open already)."""
    pointers = materialize(pointers)
    first = pointers.groupBy("key").agg(F.min("place").alias("place"))
    starts, step, count = materialize(first), pointers.select("key", "place", "next"), 0
    while True:
        reached = materialize(starts.join(step, ["key", "place"]).select("key", F.col("next").alias("place")).join(pointers.select("key", "place"), ["key", "place"], "left_semi"))
        starts = materialize(starts.unionByName(reached).distinct())
        before, count = count, starts.count()
        if count == before:
            return starts
        far = step.select("key", F.col("place").alias("next"), F.col("next").alias("beyond"))
        step = materialize(step.join(far, ["key", "next"]).select("key", "place", F.col("beyond").alias("next")))


def decide(events: DataFrame, stored: DataFrame, limit: int, window_ms: int) -> tuple[DataFrame, DataFrame]:
    """Decision per hit, and the state (``key, start_ms, hits``) of the keys seen.

    ``events``: key, event_id (unique), occurred_ms; ``stored``: the state before. Equal times
    are ordered by event_id. A hit before the open window's end belongs to it.
    """
    pointers = materialize(ranked_hits(events, stored, window_ms))
    starts = window_starts(pointers).withColumn("starts", F.lit(1))
    marked = pointers.join(starts, ["key", "place"], "left").withColumn("starts", F.coalesce("starts", F.lit(0)))
    numbered = materialize(running(marked, ["key"], ["place"], rank=None, sums={"window": F.col("starts")}))
    heads = numbered.where("starts = 1").select("key", "window", F.col("place").alias("_place"), F.col("occurred_ms").alias("_start"))
    open_hits = stored.select("key", F.col("hits").alias("_hits"))
    in_window = numbered.where("place > 0").join(heads, ["key", "window"]).join(open_hits, "key", "left")
    # The hits of a window that was open already go on from the stored number.
    hits = F.when(F.col("_place") == 0, F.col("_hits") + F.col("place")).otherwise(F.col("place") - F.col("_place") + 1)
    decided = in_window.select("key", "event_id", "place", "_start", hits.alias("hits"))
    state = decided.groupBy("key").agg(F.max_by(F.struct("_start", "hits"), "place").alias("s")).select("key", F.col("s._start").alias("start_ms"), "s.hits")
    return decided.select(
        "key", "event_id", "hits", F.greatest(F.lit(limit) - F.col("hits"), F.lit(0)).cast("bigint").alias("remaining"),
        (F.col("_start") + window_ms).alias("reset_ms"), (F.col("hits") <= limit).alias("allowed"),
    ), state


class RateLimit:
    """``foreachBatch`` sink: decisions and, once per batch, the state of all keys under ``root``.

    A batch reads the state the batch before it wrote and nothing older. Keys whose window ended
    more than ``keep_ms`` before the newest hit are forgotten: a later hit starts a window anyway.
    """

    def __init__(self, spark, root: str, limit: int, window_ms: int, keep_ms: int | None = None):
        from quillspark.streaming.pipeline import BatchTable

        self.limit, self.window_ms, self.keep_ms = limit, window_ms, keep_ms
        self.decisions, self.state = BatchTable(spark, f"{root}/decisions", DECISION), BatchTable(spark, f"{root}/state", STATE)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        stored = self.state.of_batch(batch_id - 1).drop("batch_id")
        decided, state = decide(materialize(batch), stored, self.limit, self.window_ms)
        self.decisions.write(decided, batch_id)
        state = materialize(state)
        kept = stored.join(state.select("key"), "key", "left_anti")
        if self.keep_ms is not None:
            newest = state.agg(F.max("start_ms")).first()[0]
            kept = kept if newest is None else kept.where(F.col("start_ms") + self.window_ms + self.keep_ms >= newest)
        self.state.write(state.unionByName(kept), batch_id)
