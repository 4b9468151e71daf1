"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces go, longest first, into the open bin that they leave least room in. If none has room, a bin opens at the permitted
length of least cost for what can still come, and in the end each bin shrinks to the shortest permitted length that
holds its contents. Groups of about GROUP pieces are packed apart, by a hash of their document.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, n_words, saved

#: Permitted lengths in tokens.
LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Pieces of a group, or about so many.
GROUP = 4096
#: A sequence of c tokens costs c + c*c/ATTENTION + OVERHEAD.
ATTENTION, OVERHEAD = 65536, 16


def cost(length: int) -> float:
    return length + length * length / ATTENTION + OVERHEAD


def pack(pieces: list[int], lengths: tuple[int, ...] = LENGTHS) -> list[tuple[int, int, int]]:
    """``bin, offset, length of the bin`` of each piece, none longer than the longest permitted length."""
    lengths = tuple(sorted(set(lengths)))
    order = sorted(range(len(pieces)), key=lambda i: (-pieces[i], i))
    left = sum(pieces)
    room: list[tuple[int, int]] = []  # of open bins, ascending
    used: list[int] = []
    placed: list[tuple[int, int]] = [(0, 0)] * len(pieces)
    for i in order:
        size = pieces[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            # what a bin can get is bounded by its length and by all that is left; the least cost for a token of it opens
            free = min((c for c in lengths if c >= size), key=lambda c: (cost(c) / max(min(c, left), 1), c))
            b = len(used)
            used.append(0)
        placed[i] = (b, used[b])
        used[b] += size
        left -= size
        if free > size:
            insort(room, (free - size, b))
    final = [next(c for c in lengths if c >= u) for u in used]
    return [(b, offset, final[b]) for b, offset in placed]


def packed(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, group: int = GROUP) -> DataFrame:
    """A row for each piece: ``doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_length``.

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` of the whole text. A document longer than the longest permitted length is cut into
    pieces of that length and a rest. A document without tokens (null, empty or blank) has one row of 0 tokens
    and no bin. Repeated rows are packed each. An empty table gives no rows; extra columns are ignored. What stands in which bin
    depends on ids, texts and sizes alone, not on how the table is stored, but for rows that are repeated more than ``group`` times.
    """
    longest = max(lengths)
    sizes = docs.select("doc_id", F.xxhash64("text").alias("t"), n_words(F.col("text")).alias("size")).withColumn("copy", F.monotonically_increasing_id())
    sizes = saved(sizes, "pack-sizes")
    last = F.greatest(F.ceil(F.col("size") / longest), F.lit(1)).cast("int")
    groups = max(1, -(-int(sizes.agg(F.sum(last)).first()[0] or 0) // group))
    pieces = sizes.select("doc_id", "t", "size", "copy", F.explode(F.sequence(F.lit(0), last - 1)).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * longest).withColumn("n_tokens", F.least(F.col("size") - F.col("start"), F.lit(longest)))
    # a very long document's pieces go to different groups, and so do the copies of a row that alone would crowd one
    crowded = saved(sizes.groupBy("doc_id", "t").count().where(F.col("count") > group).select(F.col("doc_id").alias("_fl_id"), F.col("t").alias("_fl_t"), F.lit(True).alias("_fl_many")), "pack-crowded")
    pieces = pieces.join(bounded(crowded), F.col("doc_id").eqNullSafe(F.col("_fl_id")) & (F.col("t") == F.col("_fl_t")), "left")
    pieces = pieces.withColumn("h", F.xxhash64("doc_id", "t", "piece", F.when(F.col("_fl_many"), F.col("copy"))))
    pieces = pieces.select(F.pmod("h", F.lit(groups)).alias("group"), "h", "doc_id", "piece", "start", "n_tokens")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(table):
        import pyarrow as pa

        table = table.sort_by([("h", "ascending"), ("piece", "ascending")])
        n = table.column("n_tokens").to_pylist()
        number = table.column("group")[0].as_py()
        full = [i for i, x in enumerate(n) if x > 0]
        bins: list = [(None, None, None)] * len(n)
        for i, (b, offset, length) in zip(full, pack([n[i] for i in full], lengths)):
            bins[i] = (number << 32 | b, offset, length)
        out = [table.column(c) for c in ("doc_id", "piece", "start", "n_tokens")] + [pa.array(c, pa.int64()) for c in zip(*bins)]
        return pa.table(out, ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_length"])

    return pieces.groupBy("group").applyInArrow(run, f"doc_id {kind}, piece int, start long, n_tokens long, bin_id long, bin_offset long, bin_length long")
