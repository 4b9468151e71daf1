"""Mixing sources to target weights with hash-threshold histograms.

A document's hash orders the documents of its source. Tokens are summed by source and hash bucket; the bucket
in which the running sum reaches the source's budget is the boundary bucket, and only its documents are summed again
by the next bits of the hash. After that a document is taken by comparing its hash with one number: nothing is sorted.
Whole repeats come first, so budgets nest: a larger target of a source takes all that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, n_words, saved

#: Bits of the hash (15 hexadecimal digits of an MD5) and bits by which each level refines.
HASH_BITS, LEVEL_BITS = 60, 12


def order_hash(doc_id: Column, text: Column) -> Column:
    """Column: the 60-bit hash that orders documents; a null id is replaced by a digest of the text."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """Water-filling over ``sizes(source, size)``: ``source, source_size, target, copies, rest``.

    Sources in code-point order, null last, weigh as ``weights`` repeats. All tokens are shared by weight, no source
    gets more than ``max_repeat`` times its size, and what is above goes to the others by weight. ``copies`` whole
    repeats and ``rest`` tokens of one more make up the target. The windows see one row a source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1)
    ranked = by_source.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_repeat)
    by_cap = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source")
    flows = ranked.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
        (F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).alias("capped_before"),
        F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)).alias("w_from"),
        F.row_number().over(by_cap).alias("pos"),
    ).withColumn("is_capped", (F.col("total") - F.col("capped_before")) * F.col("w") >= F.col("cap") * F.col("w_from"))
    first = F.min(F.when(~F.col("is_capped"), F.struct("pos", "capped_before", "w_from"))).over(Window.partitionBy())
    flows = flows.withColumn("first", first)
    shared = (F.col("total") - F.col("first.capped_before")) * F.col("w") / F.col("first.w_from")
    free = F.col("first").isNotNull() & (F.col("pos") >= F.col("first.pos"))
    flows = flows.withColumn("target", F.when(free, shared).otherwise(F.col("cap").cast("double")))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return flows.withColumn("copies", copies).select(
        "source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest")
    )


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budgets`` and ``threshold`` for ``sizes(source, size, h)``: documents with h <= threshold hold near ``rest`` tokens.

    Of the sets that the order of h allows, the one nearest to the budget is taken; of two equally near, the larger.
    Documents of one source with equal h go together.
    """
    state = saved(
        budgets.withColumns({"below": F.lit(0).cast("long"), "prefix": F.lit(0).cast("long"), "threshold": F.when(F.col("rest") <= 0, F.lit(-1).cast("long"))}),
        "mix-state",
    )
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        wanted = state.where("threshold is null").select(F.col("source").alias("s"), "rest", "below", "prefix")
        if not wanted.limit(1).count():
            break
        inside = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        found = sizes.join(bounded(wanted), inside).groupBy("s", F.shiftright("h", shift).alias("bucket"))
        found = found.agg(F.sum("size").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("rest").alias("rest"), F.first("below").alias("below"))
        running = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        crossing = found.withColumn("upto", F.col("below") + F.sum("size").over(running)).where("upto >= rest")
        crossing = crossing.groupBy("s").agg(F.min(F.struct("bucket", "size", "upto", "lo", "hi")).alias("b"))
        nearest = F.when(F.col("b.upto") - F.col("rest") <= F.col("rest") - (F.col("b.upto") - F.col("b.size")), F.col("b.hi")).otherwise(F.col("b.lo") - 1)
        done = F.when(F.col("b.lo") == F.col("b.hi"), nearest)
        # rest is below the source's size, so a bucket is found unless rounding says otherwise; then all are taken
        whole = F.when(F.col("b").isNull(), F.lit(2**HASH_BITS).cast("long"))
        joined = state.join(bounded(crossing), F.col("source").eqNullSafe(F.col("s")), "left").withColumns({
            "threshold": F.coalesce("threshold", done, whole),
            "below": F.coalesce(F.col("b.upto") - F.col("b.size"), "below"),
            "prefix": F.coalesce("b.bucket", "prefix"),
        })
        state = saved(joined.select(*state.columns), "mix-state")
    return state.drop("below", "prefix")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, h`` of every document, from its whole text."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), order_hash(F.col("doc_id"), F.col("text")).alias("h"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """One row a document: ``doc_id, source, size, source_size, target, copies, taken``; taken = size x copies.

    Null text: size 0. Empty text: size 0. A source without tokens has target 0. Equal ids go together; a null id is
    ordered by its text. Null sources are one source, the last. An empty table gives no rows. Other columns are ignored.
    """
    sizes = saved(sized(docs), "mix-sizes")
    plan = bounded(thresholds(sizes, targets(sizes, weights, max_repeat)).withColumnRenamed("source", "s"))
    copies = F.col("copies") + F.when(F.col("h") <= F.col("threshold"), 1).otherwise(0)
    out = sizes.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """The documents of the mix themselves, each as often as it is taken, with all their columns; no shuffle of texts.

    Which copies a row gets depends on its source and hash alone, so the plan is joined to the documents by source.
    Documents without words (null or empty texts too) are in no mix.
    """
    sizes = saved(sized(docs), "mix-sizes")
    plan = thresholds(sizes, targets(sizes, weights, max_repeat))
    plan = bounded(plan.select(F.col("source").alias("_fl_s"), F.col("copies").alias("_fl_copies"), F.col("threshold").alias("_fl_threshold")))
    copies = F.col("_fl_copies") + F.when(order_hash(F.col("doc_id"), F.col("text")) <= F.col("_fl_threshold"), 1).otherwise(0)
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    out = docs.where(has_words).join(plan, F.col("source").eqNullSafe(F.col("_fl_s"))).withColumn("_fl_copies", copies.cast("int"))
    return out.where("_fl_copies > 0").withColumn("_fl_n", F.explode(F.sequence(F.lit(1), "_fl_copies"))).select(*docs.columns)
