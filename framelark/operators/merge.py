"""Possible and observed calls side by side: call sites in code against edges in traces.

The two never derive from each other: ``possible`` comes of a site, ``observed`` of an edge, and what only one side knows stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_sites(functions: DataFrame, signatures: DataFrame) -> DataFrame:
    """``fn, site_ord, selector, name, address`` of the external calls of analysed ``functions``, by the selectors of ``signatures(selector, signature)``.

    ``fn`` is the function's own selector; functions whose signature nothing knows are left out. A call's selector is null if its signature is unknown.
    """
    own = signatures.select(F.col("signature").alias("_own"), F.col("selector").alias("fn"))
    called = signatures.select(F.col("signature").alias("_called"), "selector")
    sites = functions.join(own, F.col("signature") == F.col("_own")).select("fn", F.posexplode("external_calls").alias("site_ord", "c"))
    sites = sites.join(called, F.col("c.signature") == F.col("_called"), "left")
    return sites.select("fn", F.col("site_ord").cast("long"), "selector", F.col("c.function_name").alias("name"), F.col("c.address").alias("address"))


def resolved(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with ``site_ord`` of the first site of their function that fits, null without one.

    sites: ``fn, site_ord, selector, name, address``; edges: ``fn, edge_id, selector, name, destination, calls, txs``. Selectors decide
    where both have one, else names; a literal address must be the destination. Both sides name their keys, so it is one equi-join
    and one aggregate by edge, which keeps edges that nothing fits.
    """
    keys = lambda: F.array_compact(F.array(F.concat(F.lit("s:"), "selector"), F.concat(F.lit("n:"), "name")))
    s = sites.select(F.col("fn").alias("_fn"), F.explode(keys()).alias("_key"), "site_ord", F.col("selector").alias("_selector"), F.lower("address").alias("_address"))
    e = edges.select(*edges.columns, F.explode_outer(keys()).alias("key"))
    by_name_only = F.col("_selector").isNull() | F.col("selector").isNull() | F.startswith("key", F.lit("s:"))
    fits = (F.col("fn") == F.col("_fn")) & (F.col("key") == F.col("_key")) & by_name_only & (F.col("_address").isNull() | (F.col("_address") == F.col("destination")))
    rest = [c for c in edges.columns if c != "edge_id"]
    found = e.join(s, fits, "left").groupBy("edge_id").agg(*(F.first(c).alias(c) for c in rest), F.min("site_ord").alias("site_ord"))
    return found.select(*edges.columns, "site_ord")


def merged(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """``fn, site_ord, edge_id, destination, selector, name, possible, observed, calls, txs``: every site, and every edge without one."""
    found = resolved(sites, edges)
    totals = found.where("site_ord is not null").groupBy("fn", "site_ord").agg(F.sum("calls").alias("calls"), F.max("txs").alias("txs"))
    zero = F.lit(0).cast("long")
    of_sites = sites.join(totals, ["fn", "site_ord"], "left").select(
        "fn", "site_ord", F.lit(None).cast("string").alias("edge_id"), F.col("address").alias("destination"), "selector", "name",
        F.lit(True).alias("possible"), F.col("calls").isNotNull().alias("observed"), F.coalesce("calls", zero).alias("calls"), F.coalesce("txs", zero).alias("txs"),
    )
    rest = found.where("site_ord is null").select(
        "fn", "site_ord", "edge_id", "destination", "selector", "name", F.lit(False).alias("possible"), F.lit(True).alias("observed"), "calls", "txs"
    )
    return of_sites.unionByName(rest)


def marked(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """edges with ``possible_from_code``: whether some site of the function fits."""
    return resolved(sites, edges).withColumn("possible_from_code", F.col("site_ord").isNotNull()).drop("site_ord")


def function_map(functions: DataFrame, entries: DataFrame, out_edges: DataFrame, in_edges: DataFrame) -> DataFrame:
    """``selector, calls, txs, outbound, inbound`` of ``functions(selector)``; txs is an upper bound: the most of an outbound edge, or the sum over inbound ones."""
    out = out_edges.where("target_selector is not null").groupBy(F.col("target_selector").alias("selector")).agg(F.max("txs").alias("_out_txs"), F.count("*").alias("outbound"))
    into = in_edges.where("target_selector is not null").groupBy(F.col("target_selector").alias("selector")).agg(F.sum("txs").alias("_in_txs"), F.count("*").alias("inbound"))
    zero = F.lit(0).cast("long")
    joined = functions.join(entries, "selector", "left").join(out, "selector", "left").join(into, "selector", "left")
    return joined.select(
        "selector", F.coalesce("calls", zero).alias("calls"), F.greatest(F.coalesce("_out_txs", zero), F.coalesce("_in_txs", zero)).alias("txs"),
        F.coalesce("outbound", zero).alias("outbound"), F.coalesce("inbound", zero).alias("inbound"),
    )
