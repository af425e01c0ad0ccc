"""Session defaults and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(app: str = "quillspark", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and single-machine benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLSPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    A local session without one gets a temporary folder; on a cluster, where executors would
    not see each other's, the missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Tells one state of the files below ``paths`` from another, by their names, sizes and times."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    named = files.select(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    total = named.agg(F.count("*"), F.sum("h")).first()
    return hashlib.sha256(f"{total[0]}:{total[1]}".encode()).hexdigest()[:16]


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this library wrote to the shared folder; call it when no result is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/quillspark")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Whether the shuffle files of a statement go when it ends; else they stay until the driver collects its garbage.
BRIEF_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """For writes whose result is read from its files: what they shuffled is given up as soon as they are done."""
    before = spark.conf.get(BRIEF_SHUFFLES, None)
    spark.conf.set(BRIEF_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BRIEF_SHUFFLES)
        else:
            spark.conf.set(BRIEF_SHUFFLES, before)


#: The folder below the scratch folder that is written to now, by ``outcome``.
_inside: ContextVar[str] = ContextVar("quillspark_inside", default="")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Used where a plan must see one fixed copy of its input (for example partition
    numbers that two branches have to agree on) or where a result feeds many branches.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillspark/{_inside.get()}{uuid.uuid4().hex}"
    with brief_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is materialized inside is removed at the end; results that outlast it are stored by other means."""
    folder = uuid.uuid4().hex
    token = _inside.set(f"{_inside.get()}{folder}/")
    try:
        yield
    finally:
        _inside.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/quillspark/{_inside.get()}{folder}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def outcome(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """``build()`` materialized; what it materialized on the way is removed then."""
    folder = uuid.uuid4().hex
    token = _inside.set(f"{_inside.get()}{folder}/")
    try:
        found = build()
    finally:
        _inside.reset(token)
    kept = materialize(found)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/quillspark/{_inside.get()}{folder}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return kept
