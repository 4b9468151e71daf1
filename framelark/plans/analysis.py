"""The whole analysis of one target as a set of lazy tables: the only place where static and observed facts meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.functions.scalars import name_of_signature
from framelark.landing import saved
from framelark.operators import merge, trace


def analyse(frames: DataFrame, identity: Sequence[str], signatures: DataFrame, labels: DataFrame, functions: DataFrame | None = None, progress=None) -> dict[str, DataFrame]:
    """``outbound, delegatecalls, inbound, entries, contracts, unresolved`` from frames; with ``functions`` of source analysis also ``calls``.

    ``functions`` have ``signature`` and ``external_calls``, and are joined by the signatures' selectors. The frames that touch the target are
    attributed once and written, and so are the edges; the tables read those. ``progress(stage, detail, share)`` is told as each is done.
    """
    tell = progress or (lambda *_: None)
    tell("traces", "attributing the frames that touch the target", 0.1)
    rows = saved(trace.touching(frames, identity), "touching")
    out, into = trace.outbound(rows), trace.inbound(rows)
    outbound = saved(trace.signed(trace.outbound_edges(out), signatures, target_selector="target_signature", destination_selector="destination_signature"), "outbound")
    tell("edges", "outbound edges are done", 0.6)
    inbound = saved(trace.inbound_edges(into, labels), "inbound")
    tell("edges", "inbound edges are done", 0.9)
    sides = [trace.rollup(out, "to_addr").withColumn("side", F.lit("outbound")), trace.rollup(into, "from_addr").withColumn("side", F.lit("inbound"))]
    contracts = trace.kinds(sides[0].unionByName(sides[1]), frames, labels)
    result = {
        "outbound": outbound,
        "delegatecalls": trace.outbound_edges(trace.delegatecalls(rows)),
        "inbound": inbound,
        "entries": trace.function_counts(into, None, "selector"),
        "contracts": contracts,
        "unresolved": trace.selectors(outbound, inbound).join(signatures, "selector", "left_anti"),
    }
    if functions is not None:
        sites = merge.call_sites(functions, signatures)
        edge_id = F.md5(F.concat_ws("|", "target_selector", "destination", F.coalesce("destination_selector", F.lit("")), "call_type"))
        edges = outbound.where("target_selector is not null").select(
            F.col("target_selector").alias("fn"), edge_id.alias("edge_id"), F.col("destination_selector").alias("selector"), name_of_signature(F.col("destination_signature")).alias("name"), "destination", "calls", "txs"
        )
        result["calls"] = merge.merged(sites, edges)
    tell("result", "every table is ready to be read", 1.0)
    return result
