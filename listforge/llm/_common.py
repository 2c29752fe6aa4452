"""Pieces that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Bytes of an Arrow batch on its way to a Python worker; a longer row travels alone.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting, for as long as it takes."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most from now on (a smaller setting stays): results are the same, workers need less memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which its worker, which Spark keeps for later tasks, gives back the memory that it has freed."""

    def lean(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def ready_to_checkpoint(spark: SparkSession) -> None:
    """The folder that the cluster shares. Where none is set, one machine alone (tests) gets an own one; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint; the shuffle files behind it go.

    The checkpoint's rows are wrapped anew, without the size estimates and
    constraints of the plan behind them: in loops of joins those multiply from
    round to round until the driver does little else.
    """
    spark = df.sparkSession
    kept = checkpointed(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint(), whose shuffle files are removed as soon as it stands."""
    ready_to_checkpoint(df.sparkSession)
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return df.select("*").checkpoint()  # a plan made under this setting


def dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """A checkpoint of df dealt by key, whose partitioning later joins on key know: they move the other side alone."""
    # Fewer parts than a join would make are dealt again by it. An adaptive plan does not pass its partitioning on to the checkpoint.
    parts = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    with setting(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return checkpointed(df.repartition(parts, key))


def input_bytes(df: DataFrame) -> int:
    """Bytes that the tables behind df hold by Catalyst's estimate; where it has none, the bytes of text, counted. Joins, whose estimates multiply, do not enter."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if known < 1 << 55:
        return known
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
