"""Shared helpers of the training-data operators: size-checked broadcasts, settings, batches to Python."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.landing import new_path, remove, saved, shared_dir

__all__ = ["bounded", "n_words", "new_path", "remove", "saved", "settings", "shared_dir", "shuffle_partitions", "small_batches"]

#: Rows, and bytes of their text, binary and array columns, up to which a side that was measured may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings, dots as ``__``, for the plans that are made and run within."""
    before = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _bytes(df: DataFrame):
    """Column: about how many bytes a row of df takes."""
    sizes = [F.lit(8 * len(df.columns))]
    for field in df.schema:
        kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif kind == "array":
            each = {"string": 32, "binary": 32, "struct": 64}.get(field.dataType.elementType.typeName(), 16)
            sizes.append(F.greatest(F.size(c), F.lit(0)) * each)
    return sum(sizes[1:], sizes[0])


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if df, which must be cheap to read, is within the bounds; else leave the join to the planner."""
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 512, size: int = 16 << 20) -> None:
    """From now on at most so many rows, or bytes where Spark can tell, go to Python at once: batches of whole, maybe very long, texts must fit a worker's memory.

    Stays set in the session, as plans are made when their results are read: after the operator that needs it has returned.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).lower().rstrip("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:  # one in other units was set by hand, and stays
            spark.conf.set(key, str(most))


def n_words(text):
    """Column: number of ``[^\\x20\\x09-\\x0D]+`` in text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
