"""Discovery: a span of blocks to segments, capped scans, candidates, and the sample that covers most."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def width(most: int) -> Column:
    """Blocks of each of up to ``most`` segments of ``low`` to ``head``."""
    total = F.col("head") - F.col("low") + 1
    return F.ceil(total / F.greatest(F.lit(1), F.least(F.lit(most).cast("long"), total)))


def segments(span: DataFrame, most: int) -> DataFrame:
    """``slice_index, from_block, to_block`` of ``span(low, head)``: up to ``most`` touching segments of equal width, newest first."""
    cut = span.withColumn("w", width(most)).withColumn("slice_index", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("head") - F.col("low") + 1) / F.col("w")) - 1)))
    top = F.col("head") - F.col("slice_index") * F.col("w")
    return cut.select("slice_index", F.greatest(F.col("low"), top - F.col("w") + 1).alias("from_block"), top.alias("to_block"))


def in_segments(frames: DataFrame, span: DataFrame, most: int) -> DataFrame:
    """frames within ``span(low, head)``, one row, with the ``slice_index`` of the segment that holds their block: of equal widths, it is a quotient."""
    low, head = span.select("low").scalar(), span.select("head").scalar()
    inside = frames.where(F.col("block").between(low, head))
    return inside.withColumn("slice_index", F.floor((head - F.col("block")) / span.select(width(most)).scalar()))


def capped(frames: DataFrame, cap: int, *order: Column | str) -> DataFrame:
    """At most ``cap`` frames of each segment; the rank limit is applied before the shuffle too."""
    ranked = frames.withColumn("_n", F.row_number().over(Window.partitionBy("slice_index").orderBy(*order)))
    return ranked.where(F.col("_n") <= cap).drop("_n")


def islands(slices: DataFrame) -> DataFrame:
    """Touching or overlapping ``from_block, to_block`` ranges as one, with ``slices``, how many."""
    newest = Window.orderBy(F.col("to_block").desc(), "from_block")
    reached = F.min("from_block").over(newest.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reached.isNull() | (F.col("to_block") + 1 < reached), 1).otherwise(0)
    numbered = slices.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("_island").agg(F.min("from_block").alias("from_block"), F.max("to_block").alias("to_block"), F.count("*").alias("slices")).drop("_island")


def greedy(candidates: DataFrame, cap: int) -> DataFrame:
    """``slice_index, tx, place``: each pick adds most selectors and counterparties not yet seen, then is the newest.

    The pool is the newest ``max(10 * cap, 500)`` of a segment, which bounds what one task gathers; what is picked depends on the picks
    before, so a segment is ranked in one task.
    """
    pool = max(10 * cap, 500)
    newest = candidates.withColumn("_n", F.row_number().over(Window.partitionBy("slice_index").orderBy(F.col("block").desc(), "tx"))).where(F.col("_n") <= pool)

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "tx"], ascending=[False, True])
        left = [(b, t, {("s", x) for x in s} | {("a", x) for x in a}) for b, t, s, a in zip(rows["block"], rows["tx"], rows["selectors"], rows["counterparties"])]
        seen, picked = set(), []
        while left and len(picked) < cap:
            best = max(range(len(left)), key=lambda i: (len(left[i][2] - seen), left[i][0], -i))
            _, tx, adds = left.pop(best)
            seen |= adds
            picked.append(tx)
        return pd.DataFrame({"slice_index": rows["slice_index"].iloc[0], "tx": picked, "place": range(1, len(picked) + 1)})

    return newest.drop("_n").groupBy("slice_index").applyInPandas(pick, "slice_index long, tx string, place long")


def escaped(found: DataFrame, explorer: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """``tx, slice_index, path``: candidates of ranges where a segment of ``parts`` has at least so many, else those of an explorer.

    Few candidates past the time for a segment say that its range is slow or lies about what it holds; what it gave is dropped then.
    """
    n = found.groupBy("slice_index").agg(F.count("*").alias("_n"))
    few = parts.select("slice_index").join(n, "slice_index", "left").where(F.coalesce("_n", F.lit(0)) < least).select("slice_index")
    ranged = found.join(few, "slice_index", "left_anti").select("tx", "slice_index", F.lit("range").alias("path"))
    return ranged.unionByName(explorer.join(few, "slice_index", "left_semi").select("tx", "slice_index", F.lit("explorer").alias("path")))


def interleaved(ranked: DataFrame, cap: int) -> DataFrame:
    """Round robin over segments, newest first: all first places, then all second ones, up to ``cap``."""
    return ranked.orderBy("place", "slice_index").limit(cap)
