"""Day-grain facts kept by a windowed stream, with late days repaired from the event log.

The windowed aggregation drops what comes behind its watermark. A second sink over the same
source notes the days such rows belong to; a repair recomputes exactly those days from the log
with the batch aggregation and overwrites their partitions, no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.streaming.pipeline import BatchTable
from quillspark.streaming.windows import day_counts

COUNTS = "project_id bigint, note_id bigint, fact_date date, view_count bigint, event_count bigint"
KEYS = ["project_id", "note_id", "fact_date"]


class DailyFacts:
    """Tables of one job under ``root``; ``delay`` is the watermark's (an interval such as '1 day')."""

    def __init__(self, spark: SparkSession, root: str, delay: str):
        self.spark, self.delay, self.path = spark, delay, f"{root}/daily"
        self.counted = BatchTable(spark, f"{root}/counted", COUNTS)
        self.progress = BatchTable(spark, f"{root}/progress", "newest timestamp")
        self.late = BatchTable(spark, f"{root}/late_days", "fact_date date, late_rows bigint")
        self.repaired = BatchTable(spark, f"{root}/repaired", "through bigint")

    def observe(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` sink over the raw events: remember the days of rows behind the watermark.

        A batch's watermark is the newest time of earlier batches less the delay, as the
        aggregation has it. One small row per batch is read back.
        """
        times = batch.where("note_id IS NOT NULL AND occurred_at IS NOT NULL").select("occurred_at").persist()
        try:
            self.progress.write(times.agg(F.max("occurred_at").alias("newest")), batch_id)
            newest = self.progress.read(batch_id).agg(F.max("newest").alias("newest")).first()["newest"]
            behind = F.lit(False) if newest is None else F.col("occurred_at") < F.lit(newest) - F.expr(f"INTERVAL {self.delay}")
            self.late.write(times.where(behind).groupBy(F.to_date("occurred_at").alias("fact_date")).agg(F.count("*").alias("late_rows")), batch_id)
        finally:
            times.unpersist()

    def settle(self) -> None:
        """Bring what the windowed stream has counted into the table, a partition per day."""
        latest = self.counted.read().groupBy(*KEYS).agg(F.max_by(F.struct("view_count", "event_count"), "batch_id").alias("r"))
        self._overwrite(latest.select(*KEYS, "r.*"))

    def dirty_days(self) -> DataFrame:
        """Days with late rows that no repair has covered yet."""
        through = self.repaired.read().agg(F.coalesce(F.max("through"), F.lit(-1))).first()[0]
        return self.late.read().where(F.col("batch_id") > through).select("fact_date").distinct()

    def repair(self, log: DataFrame, attempt: int) -> DataFrame:
        """Recompute the dirty days from the event log; returns them.

        ``log`` needs project_id, note_id, event_type, occurred_at and source_event_id. What is
        noted while the repair runs stays dirty for the next one.
        """
        through = self.late.read().agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]
        days = self.dirty_days()
        rows = log.withColumn("fact_date", F.to_date("occurred_at")).join(days, "fact_date", "left_semi").dropDuplicates(["source_event_id"])
        self._overwrite(day_counts(rows))
        self.repaired.write(self.spark.createDataFrame([(through,)], "through bigint"), attempt)
        return days

    def _overwrite(self, rows: DataFrame) -> None:
        rows.repartition("fact_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fact_date").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(COUNTS).parquet(self.path)
