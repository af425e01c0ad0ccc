"""Event pipeline: envelopes to facts, counters, rankings and dead letters, once per event.

Four streams, each reading what the one before wrote:

1. messages are checked; valid events are accepted, poison is retried and ends as dead letters;
2. accepted events become facts, each id once (ids are forgotten some time after acceptance);
3. facts move the state of holders (who likes, who collects, which comment stands), kept as
   keyed state; a moved state is a change of a counter;
4. changes are summed per note and comment, and rankings follow the notes that changed.

What a micro-batch costs depends on what it brings, not on how many came before. Sinks over
Parquet write a ``batch_id=N`` partition and overwrite just that one when the batch runs again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quillspark.operators.facts import hot_score
from quillspark.operators.ordering import top_per_group
from quillspark.streaming.envelopes import dead_letters, parse, split_attempts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACT_COLUMNS = [
    "source_event_id", "project_id", "user_id", "note_id", "comment_id", "event_type", "event_payload", "occurred_at",
]
FACT = (
    "source_event_id string, project_id bigint, user_id bigint, note_id bigint, comment_id bigint, "
    "event_type string, event_payload string, occurred_at timestamp, event_date date"
)
COUNTERS = ["view_count", "like_count", "collect_count", "comment_count", "share_count"]
COMMENT_COUNTERS = ["like_count", "reply_count"]
#: Shards of a note's or comment's holders, so that a hot one's state is spread out.
SHARDS = 16
#: A note that was deleted has this much of ``live``; others have 0.
GONE = -1
CHANGE = "kind string, id bigint, counter string, change bigint"
UNDATED = "1970-01-01"


class BatchTable:
    """A Parquet directory with one partition per micro-batch, and by one more column if wanted."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, split_by: str | None = None):
        self.spark, self.path, self.schema, self.split_by = spark, path, schema, split_by

    def write(self, rows: DataFrame, batch_id: int) -> None:
        writer = rows.write.mode("overwrite")
        if self.split_by:
            writer = writer.partitionBy(self.split_by)
        writer.parquet(f"{self.path}/batch_id={batch_id}")

    def read(self, before: int | None = None) -> DataFrame:
        """All rows, or those of batches before one (partition-pruned)."""
        try:
            rows = self.spark.read.schema(self._with_batch()).parquet(self.path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            rows = self.spark.createDataFrame([], self._with_batch())
        return rows if before is None else rows.where(F.col("batch_id") < before)

    def of_batch(self, batch_id: int) -> DataFrame:
        """One batch's rows, read without listing the others."""
        try:
            return self.spark.read.schema(self._with_batch()).option("basePath", self.path).parquet(f"{self.path}/batch_id={batch_id}")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], self._with_batch())

    def _with_batch(self) -> StructType:
        base = self.schema if isinstance(self.schema, StructType) else StructType.fromDDL(self.schema)
        return StructType(list(base.fields)).add("batch_id", "long")


class EventPipeline:
    """The streams over the tables under ``root``.

    ``apply`` is the ``foreachBatch`` sink of the messages; ``advance`` runs the streams behind
    it over what is there. ``notes`` holds id, category and status of the notes; views of
    unpublished notes stay facts but do not count. Event ids are remembered for ``remembered``
    after they were accepted.
    """

    def __init__(self, spark: SparkSession, root: str, notes: DataFrame, now: Column, ranking_size: int = 50, remembered: str = "7 days"):
        self.spark, self.root, self.notes, self.now, self.ranking_size, self.remembered = spark, root, notes, now, ranking_size, remembered
        self.accepted = BatchTable(spark, f"{root}/accepted", f"{FACT}, accepted_at timestamp")
        self.counters = BatchTable(spark, f"{root}/counters", "note_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTERS) + ", live bigint, hot_score double")
        self.comment_counters = BatchTable(spark, f"{root}/comment_counters", "comment_id bigint, " + ", ".join(f"{c} bigint" for c in COMMENT_COUNTERS))
        self.candidates = BatchTable(spark, f"{root}/candidates", "category string, note_id bigint, hot_score double")
        self.bounds = BatchTable(spark, f"{root}/bounds", "category string, bound struct<hot_score: double, note_id: bigint>")
        self.rankings = BatchTable(spark, f"{root}/rankings", "category string, ids array<bigint>")
        self.retries = BatchTable(spark, f"{root}/retries", "message_hash string, value string, attempts int")
        self.letters = BatchTable(
            spark, f"{root}/dead_letters",
            "event_id string, event_type string, deliveries bigint, failure string, original_message string, failed_at timestamp",
        )

    def apply(self, messages: DataFrame, batch_id: int) -> None:
        """One micro-batch: retry what failed last time together with the new messages."""
        due = self.retries.of_batch(batch_id - 1)
        parsed = parse(messages.select("value").unionByName(due.select("value"))).persist()
        try:
            valid = parsed.where("failure IS NULL").dropDuplicates(["source_event_id"])
            dated = valid.withColumn("event_date", F.coalesce(F.to_date("occurred_at"), F.lit(UNDATED).cast("date")))
            timed = dated.withColumn("occurred_at", F.coalesce("occurred_at", self.now)).withColumn("accepted_at", self.now.cast("timestamp"))
            self.accepted.write(timed.select(*FACT_COLUMNS, "event_date", "accepted_at"), batch_id)
            retry, dead = split_attempts(
                parsed.where("failure IS NOT NULL").dropDuplicates(["value"]), due.select("message_hash", "attempts")
            )
            self.retries.write(retry.select("message_hash", "value", F.col("attempts").cast("int").alias("attempts")), batch_id)
            self.letters.write(dead_letters(dead, self.now), batch_id)
        finally:
            parsed.unpersist()

    def facts(self) -> DataFrame:
        return self.spark.read.schema(FACT).parquet(f"{self.root}/facts")

    def advance(self) -> None:
        """Facts, changes and totals of all that was accepted and not yet processed."""
        key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, store)
        try:
            accepted = self.spark.readStream.schema(f"{FACT}, accepted_at timestamp, batch_id bigint").parquet(f"{self.root}/accepted")
            once = accepted.withWatermark("accepted_at", self.remembered).dropDuplicatesWithinWatermark(["source_event_id"]).drop("accepted_at", "batch_id")
            self._append(once, "facts", "event_date")
            states = holder_states(self.spark.readStream.schema(FACT).parquet(f"{self.root}/facts"))
            changes = states.groupBy("kind", "id", "shard").transformWithStateInPandas(
                statefulProcessor=HolderStates(), outputStructType=CHANGE, outputMode="Append", timeMode="None")
            self._append(changes, "changes")
            totals = summed(self.spark.readStream.schema(CHANGE).parquet(f"{self.root}/changes"), self.notes)
            run_available(totals, self._derive, f"{self.root}/state/totals", "update")
        finally:
            self.spark.conf.set(key, before)

    def _append(self, rows: DataFrame, name: str, *partitions: str) -> None:
        writer = rows.writeStream.format("parquet").option("path", f"{self.root}/{name}").option("checkpointLocation", f"{self.root}/state/{name}")
        (writer.partitionBy(*partitions) if partitions else writer).trigger(availableNow=True).start().awaitTermination()

    def _derive(self, totals: DataFrame, batch_id: int) -> None:
        """Counters of the notes and comments a batch moved, then the rankings of the notes among them."""
        totals = totals.persist()
        try:
            notes = totals.where("kind = 'note'").select(F.col("id").alias("note_id"), *COUNTERS, "live").withColumn("hot_score", hot_score())
            self.counters.write(notes, batch_id)
            self.comment_counters.write(totals.where("kind = 'comment'").select(F.col("id").alias("comment_id"), *COMMENT_COUNTERS), batch_id)
            self._rank(notes, batch_id)
        finally:
            totals.unpersist()

    def _rank(self, moved: DataFrame, batch_id: int) -> None:
        """Keep each category's best notes, twice as many as a ranking shows, and the best one left out.

        A note that moved leaves the kept ones and comes back with its new score if it still may
        be ranked. Whoever stands above the best note left out is certain; if fewer than a
        ranking's length are, the category is filled up again from all its counters.
        """
        kept, before = 2 * self.ranking_size, batch_id - 1
        touched = self.notes.select(F.col("id").alias("note_id"), "category", "status").join(moved.select("note_id", "hot_score", "live"), "note_id").persist()
        try:
            able = touched.where((F.col("status") == "published") & (F.col("live") > GONE)).select("category", "note_id", "hot_score")
            stood = self.candidates.of_batch(before).drop("batch_id")
            stayed = stood.join(touched.select("note_id"), "note_id", "left_anti")
            bounds = self.bounds.of_batch(before).drop("batch_id")
            pool = stayed.unionByName(able).join(bounds, "category", "left")
            certain = pool.where(F.col("bound").isNull() | (F.struct("hot_score", "note_id") > F.col("bound")))
            counts = certain.groupBy("category").agg(F.count("*").alias("n"))
            short = bounds.where("bound IS NOT NULL").join(counts, "category", "left").where(F.coalesce("n", F.lit(0)) < self.ranking_size).select("category").persist()
            rows = certain.join(short, "category", "left_anti").select("category", "note_id", "hot_score")
            if not short.isEmpty():
                members = self.notes.where("status = 'published'").join(short, "category", "left_semi").select("category", F.col("id").alias("note_id"))
                latest = current(self.counters.read(batch_id + 1).join(members.select("note_id"), "note_id", "left_semi"), "note_id")
                rows = rows.unionByName(members.join(latest.where(F.col("live") > GONE), "note_id").select("category", "note_id", "hot_score"))
            ranked = top_per_group(rows, ["category"], [F.desc("hot_score"), F.desc("note_id")], kept + 1).persist()
            self.candidates.write(ranked.where(F.col("rn") <= kept).select("category", "note_id", "hot_score"), batch_id)
            cut = ranked.where(F.col("rn") == kept + 1).select("category", F.struct("hot_score", "note_id").alias("bound"))
            older = bounds.join(short, "category", "left_anti").select("category", "bound")
            self.bounds.write(cut.unionByName(older).groupBy("category").agg(F.max("bound").alias("bound")), batch_id)
            ids = F.transform(F.sort_array(F.collect_list(F.when(F.col("rn") <= self.ranking_size, F.struct("rn", "note_id")))), lambda r: r["note_id"])
            emptied = stood.select("category").distinct().join(ranked.select("category").distinct(), "category", "left_anti")
            shown = ranked.join(touched.select("category").distinct(), "category", "left_semi").groupBy("category").agg(ids.alias("ids"))
            self.rankings.write(shown.unionByName(emptied.select("category", F.array().cast("array<bigint>").alias("ids"))), batch_id)
            ranked.unpersist()
            short.unpersist()
        finally:
            touched.unpersist()

    def drain(self, batch_id: int, spark: SparkSession) -> int:
        """Run further rounds without new messages until no retry is pending, then ``advance``; returns the next batch id."""
        empty = spark.createDataFrame([], "value string")
        while not self.retries.of_batch(batch_id - 1).isEmpty():
            self.apply(empty, batch_id)
            batch_id += 1
        self.advance()
        return batch_id


def holder_states(facts: DataFrame) -> DataFrame:
    """What each fact says about a holder of a counter: kind, id, shard, counter, holder, at_us, event_id, held.

    Likes and collections are held by a user, comments and replies by themselves; views, shares
    and comments without id are held by nobody and count each time. The deletion of a comment
    without id cannot be placed. A note's own state is ``live``.
    """
    event, parent = F.col("event_type"), F.get_json_object("event_payload", "$.parent_id").cast("bigint")
    user, comment = F.col("user_id").cast("string"), F.col("comment_id").cast("string")
    nobody = F.lit(None).cast("string")
    rules = [
        # kind, id, counter, holder, events that set it, events that clear it
        ("note", F.col("note_id"), "view_count", nobody, ["note_viewed"], []),
        ("note", F.col("note_id"), "share_count", nobody, ["note_shared"], []),
        ("note", F.col("note_id"), "like_count", user, ["note_liked"], ["note_unliked"]),
        ("note", F.col("note_id"), "collect_count", user, ["note_collected"], ["note_uncollected"]),
        ("note", F.col("note_id"), "comment_count", comment, ["comment_created"], ["comment_deleted"]),
        ("note", F.col("note_id"), "live", F.lit("note"), ["note_created", "note_updated"], ["note_deleted"]),
        ("comment", F.col("comment_id"), "like_count", user, ["comment_liked"], ["comment_unliked"]),
        ("comment", parent, "reply_count", comment, ["comment_created"], ["comment_deleted"]),
    ]
    found = F.filter(F.array(*[
        F.when(
            event.isin(up + down) & (F.coalesce(id_, F.lit(0)) > 0) & (holder.isNotNull() | event.isin(up)),
            F.struct(F.lit(kind).alias("kind"), id_.alias("id"), F.lit(counter).alias("counter"), holder.alias("holder"), event.isin(up).alias("held")),
        ) for kind, id_, counter, holder, up, down in rules
    ]), lambda x: x.isNotNull())
    each = facts.select(F.explode(found).alias("s"), F.unix_micros("occurred_at").alias("at_us"), F.col("source_event_id").alias("event_id"))
    shard = F.pmod(F.xxhash64(F.coalesce("s.holder", "event_id")), F.lit(SHARDS)).cast("int")
    return each.select("s.*", shard.alias("shard"), "at_us", "event_id")


class HolderStates(StatefulProcessor):
    """The newest state of every holder of one shard of a note or comment; emits how counters change.

    A state is newer by (time, event id), so repeated, late and reordered events end in the same
    counters: a repeated like counts once, an unlike alone does nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("held", "counter string, holder string", "at_us bigint, event_id string, held boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changes: dict[str, int] = {}
        newest: dict[tuple[str, str], tuple[int, str, bool]] = {}
        for frame in rows:
            for counter, holder, at, event, held in zip(*(frame[c] for c in ("counter", "holder", "at_us", "event_id", "held"))):
                if holder is None:
                    changes[counter] = changes.get(counter, 0) + 1
                elif (counter, holder) not in newest or newest[counter, holder] < (at, event, held):
                    newest[counter, holder] = int(at), event, bool(held)
        for (counter, holder), state in newest.items():
            before = self.states.getValue((counter, holder)) if self.states.containsKey((counter, holder)) else None
            if before is None or state[:2] > (before[0], before[1]):
                self.states.updateValue((counter, holder), state)
                # A note is live until an event says otherwise.
                was = before[2] if before is not None else counter == "live"
                changes[counter] = changes.get(counter, 0) + int(state[2]) - int(was)
        moved = [(key[0], key[1], counter, change) for counter, change in changes.items() if change]
        yield pd.DataFrame(
            moved or [(key[0], key[1], "live", 0)],  # whoever was spoken of has counters, be they 0
            columns=["kind", "id", "counter", "change"],
        )

    def close(self) -> None:
        pass


def summed(changes: DataFrame, notes: DataFrame) -> DataFrame:
    """Running totals per note and comment (update mode); views count for published notes only."""
    status = notes.select(F.col("id"), F.lit("note").alias("kind"), F.col("status").alias("_status"))
    counted = F.when((F.col("counter") == "view_count") & (F.coalesce("_status", F.lit("")) != "published"), 0).otherwise(F.col("change"))
    sums = [F.coalesce(F.sum(F.when(F.col("counter") == c, F.col("counted"))), F.lit(0)).alias(c) for c in dict.fromkeys([*COUNTERS, *COMMENT_COUNTERS, "live"])]
    return changes.join(status, ["kind", "id"], "left").withColumn("counted", counted).groupBy("kind", "id").agg(*sums)


def current(rows: DataFrame, key: str | list[str]) -> DataFrame:
    """Latest row per key over all batches."""
    keys = [key] if isinstance(key, str) else key
    others = [c for c in rows.columns if c not in (*keys, "batch_id")]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("r"))
    return picked.select(*keys, "r.*")


def run_available(rows: DataFrame, sink, checkpoint: str, mode: str = "append") -> int:
    """Process everything now available through a ``foreachBatch`` sink; returns the next batch id."""
    query = rows.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    return (last["batchId"] if last else -1) + 1
