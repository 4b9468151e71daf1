"""Line dedup against levelled sorted runs of line hashes.

Documents come in batches of ascending ids. A run holds the 128-bit hashes of the lines that one batch, or several
compacted ones, saw first, each with the smallest id that holds it, hash-bucketed and sorted. A batch's distinct hashes
are dealt and sorted once and merge-joined with every run, which is read as it lies: one pass tells what a run has (its owner)
and what none has, as an anti-join would. The latter becomes a run of level 0. When a level has two runs they are merged,
bucket by bucket, into one of the next level.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, new_path, remove, saved, settings, shuffle_partitions, small_batches

#: Stands for a null id, which is the last.
NO_ID = (1 << 63) - 1


def line_key(line: bytes, least: int = 10) -> bytes | None:
    """A line's hash: its key is the line without ASCII blanks at both ends and A-Z lower-cased; None under ``least`` code points."""
    from xxhash import xxh3_128_digest

    key = line.strip().lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return xxh3_128_digest(key)


def line_hashes(docs: DataFrame, least: int = 10) -> DataFrame:
    """``h binary, id long, t long``: the distinct line hashes of each row; t stands for its text."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                hs, ids, ts = [], [], []
                for doc_id, t, text in zip(*(part.column(c).to_pylist() for c in range(3))):
                    own = {line_key(x, least) for x in (text or "").encode().split(b"\n")} - {None}
                    hs.extend(own)
                    ids.extend([doc_id] * len(own))
                    ts.extend([t] * len(own))
                yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array(ids, pa.int64()), pa.array(ts, pa.int64())], ["h", "id", "t"])

    small_batches(docs.sparkSession)
    return docs.select(number(docs).alias("id"), F.xxhash64("text").alias("t"), F.col("text").alias("text")).mapInArrow(run, "h binary, id long, t long")


def number(docs: DataFrame):
    """Column: the id as a long, null ids after all others; ids that are no integers are refused."""
    kind = docs.schema["doc_id"].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"doc_id is of type {kind}; line dedup goes by the order of integers")
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


class LineRuns:
    """The levelled runs, as bucketed tables ``h, owner, last, found`` of which a run is what was found in no run before.

    ``add`` takes batches with ids above those of earlier batches. Tables and their files go with ``close`` or at the end of a ``with``.
    """

    #: Files of a bucket are read as sorted as they were written.
    READ = {"spark__sql__legacy__bucketedTableScan__outputOrdering": "true"}

    def __init__(self, spark: SparkSession):
        self.spark, self.levels, self.paths = spark, [], {}
        self.buckets = shuffle_partitions(spark)

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _write(self, df: DataFrame) -> str:
        """Each bucket is in one task here, so it becomes one file."""
        name = f"fl_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, "line-run")
        df.write.bucketBy(self.buckets, "h").sortBy("h").option("path", self.paths[name]).saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def run(self, name: str) -> DataFrame:
        return self.spark.table(name).where("found is null").select("h", "owner")

    def joined(self, rows: DataFrame) -> DataFrame:
        """``h, owner, last, found`` of a batch ``rows(h, id)``: its smallest and largest id, and the owner in an earlier run."""
        own = rows.groupBy("h").agg(F.min("id").alias("owner"), F.max("id").alias("last"))
        seen = []
        for n, name in enumerate(self.runs()):  # a hash is in one run at most
            own = own.join(self.run(name).withColumnRenamed("owner", f"_o{n}").hint("merge"), "h", "left")
            seen.append(F.col(f"_o{n}"))
        return own.select("h", "owner", "last", F.coalesce(*seen, F.lit(None).cast("long")).alias("found"))

    def add(self, rows: DataFrame) -> DataFrame:
        """``h, owner`` of those hashes of a batch that some document of it must lose; then the batch's new hashes become a run."""
        with settings(self.spark, **self.READ):
            name = self._write(self.joined(rows))
            # read as files, not as buckets: a line that very many documents hold can then be split by the join to it
            batch = self.spark.read.schema(self.spark.table(name).schema).parquet(self.paths[name])
            twice = saved(batch.where("found is not null or owner <> last").select("h", F.coalesce("found", "owner").alias("owner")), "line-twice")
            if not self.levels:
                self.levels.append([])
            self.levels[0].append(name)
            self.compact()
        return twice

    def merged(self, one: str, other: str) -> DataFrame:
        """Two runs as one; both lie in the same buckets and order, so nothing is dealt or sorted to merge them."""
        b = self.run(other).select(F.col("h").alias("_h"), F.col("owner").alias("_owner"))
        both = self.run(one).hint("merge").join(b, F.col("h") == F.col("_h"), "full_outer")
        nothing = F.lit(None).cast("long")
        return both.select(F.coalesce("h", "_h").alias("h"), F.coalesce("owner", "_owner").alias("owner"), nothing.alias("last"), nothing.alias("found"))

    def compact(self) -> None:
        for n in range(64):
            if n >= len(self.levels) or len(self.levels[n]) < 2:
                return
            written = self._write(self.merged(*self.levels[n]))
            self._drop(self.levels[n])
            self.levels[n] = []
            if n + 1 == len(self.levels):
                self.levels.append([])
            self.levels[n + 1].append(written)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.paths.pop(name))

    def close(self) -> None:
        self._drop(list(self.paths))
        self.levels = []


def lost_lines(docs: DataFrame, batches: int = 4, least: int = 10) -> DataFrame:
    """``id, t, drops array<binary>``: the line hashes that rows of an id and text lose; rows that lose none are absent."""
    spark = docs.sparkSession
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("double").alias("i"))
    cuts = sorted(set(known.approxQuantile("i", [k / batches for k in range(1, batches)], 0.01)))
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("id") > F.lit(cut)).cast("int")
    path = new_path(spark, "line-rows")
    line_hashes(docs, least).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    rows = spark.read.schema("h binary, id long, t long, batch int").parquet(path)
    lost = None
    with LineRuns(spark) as runs:
        for n in range(len(cuts) + 1):
            own = rows.where(F.col("batch") == n)
            found = own.join(bounded(runs.add(own)), "h").where("owner <> id").select("id", "t", "h")
            lost = found if lost is None else lost.unionByName(found)
    return saved(lost.groupBy("id", "t").agg(F.collect_set("h").alias("drops")), "line-lost")


def dedup_lines(docs: DataFrame, batches: int = 4, least: int = 10) -> DataFrame:
    """docs with ``text`` rewritten, and ``n_lines, n_dropped`` (long): lines before, and lines lost.

    Text is split at newlines; null or empty text is one empty line and becomes the empty text. A line whose key has at
    least ``least`` code points and is found in two documents or more stays only in the one with the smallest doc_id, as
    often as it stands there. Rows with one id count as one document; null ids are one document, the last. Ids are
    integers; others are refused (TypeError). An empty table gives no rows. Other columns stay.
    """
    @F.pandas_udf("text string, n_dropped long")
    def rebuilt(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for text, lost in zip(texts, drops):
            if lost is None:
                out.append((None, 0))
                continue
            lost = set(map(bytes, lost))
            lines = text.encode().split(b"\n")
            kept = [x for x in lines if line_key(x, least) not in lost]
            out.append((b"\n".join(kept).decode(), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_dropped"])

    ids = number(docs)
    small_batches(docs.sparkSession)
    lost = bounded(lost_lines(docs, batches, least).select(F.col("id").alias("_fl_id"), F.col("t").alias("_fl_t"), F.col("drops").alias("_fl_drops")))
    joined = docs.withColumns({"_fl_key": ids, "_fl_text": F.xxhash64("text")})
    joined = joined.join(lost, (F.col("_fl_key") == F.col("_fl_id")) & (F.col("_fl_text") == F.col("_fl_t")), "left")
    loses = F.col("_fl_drops").isNotNull()
    joined = joined.withColumn("_fl_new", rebuilt(F.when(loses, F.col("text")), F.col("_fl_drops")))  # other texts need not go to Python
    text = F.when(loses, F.col("_fl_new.text")).otherwise(F.coalesce("text", F.lit("")))
    n_lines = F.octet_length(F.coalesce("text", F.lit(""))) - F.octet_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"))) + 1
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*columns, n_lines.cast("long").alias("n_lines"), F.when(loses, F.col("_fl_new.n_dropped")).otherwise(F.lit(0).cast("long")).alias("n_dropped"))
