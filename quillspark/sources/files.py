"""File sources and sinks: typed JSON lines, run-scoped outputs and load-run results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from quillspark.functions.contract import COUNTER_LINE

CORRUPT = "_corrupt_record"


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Typed JSON lines; the first malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def quarantine_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines with their file, line number in the file, and text).

    A task reads a split of a file in one go, so its rows have consecutive row ids. A line's
    number is its distance from the split's first row plus the lines of the file's earlier splits.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"))
    splits = lines.groupBy("file", "block_start").agg(F.min("row_id").alias("first"), F.count("*").alias("lines"))
    before = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block_start", (F.col("first") - F.coalesce(F.sum("lines").over(before), F.lit(0)) - 1).alias("shift"))
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    broken = F.col("row").isNull() | F.col(f"row.{CORRUPT}").isNotNull()
    good = parsed.where(~broken).select("row.*").drop(CORRUPT)
    bad = parsed.where(broken).join(splits, ["file", "block_start"]).select("file", (F.col("row_id") - F.col("shift")).alias("line_number"), F.col("value").alias("line"))
    return good, bad


def write_json_lines(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON lines, published as a whole when the job commits."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_run(tables: dict[str, DataFrame], root: str, run_id: str, replace: bool = False) -> None:
    """The outputs of one run below ``<table>/run_id=<id>``; an existing run is refused unless replaced."""
    if not run_id or not run_id.replace("-", "").replace("_", "").isalnum():
        raise ValueError("run_id may hold letters, digits, '-' and '_' only")
    for name, rows in tables.items():
        rows.write.mode("overwrite" if replace else "errorifexists").json(f"{root}/{name}/run_id={run_id}")


def read_run(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, run_id string").json(f"{root}/{table}")


METRICS = "map<string,map<string,double>>"


def load_run_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    """Metric values of many ``<run>/summary.json`` documents, one row per run, metric and statistic."""
    text = spark.read.option("wholetext", True).text(pattern).select(_run_of(1).alias("run"), F.from_json("value", f"struct<metrics:{METRICS}>").alias("s"))
    return text.select("run", F.explode("s.metrics").alias("metric", "values")).select("run", "metric", F.explode("values").alias("statistic", "value"))


def _run_of(levels_up: int):
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - levels_up)


def cache_counters(spark: SparkSession, pattern: str) -> DataFrame:
    """Cache counters of ``<run>/<before|after>/<file>.prom`` texts."""
    lines = spark.read.text(pattern).select(_run_of(2).alias("run"), _run_of(1).alias("moment"), "value").where(F.col("value").rlike(COUNTER_LINE))
    part = lambda i: F.regexp_extract("value", COUNTER_LINE, i)
    return lines.select("run", "moment", part(1).alias("counter"), part(2).alias("cache"), part(3).cast("double").alias("value"))


def cache_hit_rates(counters: DataFrame) -> DataFrame:
    """Hit share per run from the growth of the counters between the two moments."""
    growth = counters.groupBy("run", "counter", "cache").agg(
        F.sum(F.when(F.col("moment") == "after", F.col("value")).otherwise(-F.col("value"))).alias("delta"),
        F.count_if(F.col("moment") == "after").alias("_after"),
    ).where("_after > 0")
    sums = growth.groupBy("run").agg(
        F.sum(F.when(F.col("counter") == "cache_hit_total", F.col("delta"))).alias("hits"),
        F.sum(F.when(F.col("counter") == "cache_miss_total", F.col("delta"))).alias("misses")).fillna(0.0)
    return sums.withColumn("hit_rate", F.when(F.col("hits") + F.col("misses") > 0, 100 * F.col("hits") / (F.col("hits") + F.col("misses"))))


def resource_peaks(spark: SparkSession, pattern: str) -> DataFrame:
    """Highest CPU share per run and container from tab-separated samples; unreadable lines are skipped."""
    lines = spark.read.text(pattern).select(_run_of(1).alias("run"), F.from_json(F.get(F.split("value", "\t", 2), 1), "Name string, CPUPerc string").alias("s"))
    cpu = F.try_to_number(F.replace("s.CPUPerc", F.lit("%"), F.lit("")), F.lit("999999.99")).cast("double")
    return lines.select("run", F.col("s.Name").alias("container"), cpu.alias("cpu")).where("container IS NOT NULL AND cpu IS NOT NULL").groupBy(
        "run", "container").agg(F.max("cpu").alias("peak_cpu"))
