"""Landed frames as a stream: edge counts that follow new files.

A file's frames are whole transactions, so attribution needs no state between batches: each batch is analysed like a table, and
its edge counts are written as they are; every COMPACT batches those since are added to the state and go. Days of blocks can be counted
with a watermark instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.landing import remove
from framelark.operators import trace

KEYS = ("target_selector", "destination", "destination_selector", "call_type")
#: Batches after which their counts and the state become a new state.
COMPACT = 8


def edge_counts(spark: SparkSession, source: str, state: str, identity, checkpoint: str, schema: str):
    """A started query that keeps ``state`` at the edge counts of all of ``source``: folders ``v=`` (the state up to a batch) and ``d=`` (one batch's own).

    A batch writes its own counts under its number, so one that runs again writes the same and counts are exact after a failure. What a
    compaction has taken up is deleted when the new state is whole, but for the state before it, which a reader may still read.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = trace.outbound(trace.analysed(batch, identity)).groupBy(F.col("enclosing").alias("target_selector"), F.col("to_addr").alias("destination"), F.col("selector").alias("destination_selector"), "call_type")
        new.agg(F.count("*").alias("calls")).write.mode("overwrite").parquet(f"{state}/d={number:012d}")
        if number % COMPACT == COMPACT - 1:
            latest(spark, state, number).write.mode("overwrite").parquet(f"{state}/v={number:012d}")
            bases, own = versions(spark, state, number)
            for gone in [*bases[:-2], *(d for d in own if len(bases) > 1 and int(d[2:]) <= int(bases[-2][2:]))]:
                remove(spark, f"{state}/{gone}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versions(spark: SparkSession, state: str, upto: int | None = None) -> tuple[list[str], list[str]]:
    """Whole folders ``v=`` and ``d=`` of a state in their order; found by Hadoop's file system, so any store will do."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(state).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path(state)):
        return [], []
    names = sorted(str(s.getPath().getName()) for s in system.listStatus(path(state)))
    whole = [n for n in names if n[:2] in ("v=", "d=") and system.exists(path(f"{state}/{n}/_SUCCESS")) and (upto is None or int(n[2:]) <= upto)]
    return [n for n in whole if n[0] == "v"], [n for n in whole if n[0] == "d"]


def latest(spark: SparkSession, state: str, upto: int | None = None) -> DataFrame | None:
    """The counts of all batches, or of those up to one: the newest state and the batches since."""
    bases, own = versions(spark, state, None if upto is None else upto)
    base = [b for b in bases if upto is None or int(b[2:]) < upto][-1:]
    since = [d for d in own if not base or int(d[2:]) > int(base[0][2:])]
    if not base and not since:
        return None
    return spark.read.parquet(*(f"{state}/{n}" for n in [*base, *since])).groupBy(*KEYS).agg(F.sum("calls").alias("calls"))


def windowed_counts(stream: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Calls by window and kind of a stream with a time ``ts``; rows later than ``late`` are left out, so state stays bounded."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "call_type").agg(F.count("*").alias("calls"))
