"""Queries of the trace core over the adapter's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelark.operators import trace
from framelark.plans.registry import query
from framelark.sources.testtables import IDENTITY, PRELUDE, frames, labels, signatures

ID = "('s0', 's1')"


def walked(spark, sf_dir):
    return trace.analysed(frames(spark, sf_dir), IDENTITY)


def shown(df):
    """Paths as text."""
    return df.withColumn("path", trace.path_text(F.col("path")))


def flagged(spark, sf_dir):
    return trace.flagged(frames(spark, sf_dir), IDENTITY)


def left(spark, sf_dir):
    """Outbound frames with the function they ran in."""
    found = flagged(spark, sf_dir)
    return trace.with_enclosing(trace.outbound(found), found)


def entered(spark, sf_dir):
    """Inbound frames with the function that called."""
    found = flagged(spark, sf_dir)
    return trace.with_caller(trace.inbound(found), found)


def out_edges(spark, sf_dir):
    return trace.outbound_edges(left(spark, sf_dir))


def delegated_edges(spark, sf_dir):
    found = flagged(spark, sf_dir)
    return trace.outbound_edges(trace.with_enclosing(trace.delegatecalls(found), found))


def in_edges(spark, sf_dir):
    return trace.inbound_edges(entered(spark, sf_dir), labels(spark, sf_dir))


# --- scans ---------------------------------------------------------------------------------------------------------

FRAME_COLUMNS = ("tx", "block", "path", "call_type", "from_addr", "to_addr", "selector", "error")
FRAME_SQL = "tx, block, p AS path, call_type, from_addr, to_addr, selector, error"


@query(PRELUDE + "SELECT max(block) AS head FROM frames")
def src_head_block(spark, sf_dir):
    return frames(spark, sf_dir).agg(F.max("block").alias("head"))


@query(PRELUDE + f"SELECT {FRAME_SQL} FROM frames WHERE block BETWEEN 1000 AND 1400 AND to_addr IN {ID}")
def scan_trace_filter(spark, sf_dir):
    return shown(frames(spark, sf_dir).where(F.col("block").between(1000, 1400) & F.col("to_addr").isin(*IDENTITY))).select(*FRAME_COLUMNS)


@query(PRELUDE + f"SELECT {FRAME_SQL} FROM frames WHERE tx IN ('0x00000001', '0x0000000b', '0x00000064')")
def scan_tx_flat(spark, sf_dir):
    return shown(frames(spark, sf_dir).where(F.col("tx").isin("0x00000001", "0x0000000b", "0x00000064"))).select(*FRAME_COLUMNS)


@query(PRELUDE + f"""SELECT {FRAME_SQL} FROM (SELECT *, row_number() OVER (ORDER BY block, tx, path) AS n FROM frames WHERE to_addr IN {ID} AND block BETWEEN 1000 AND 1400)
WHERE n > 500 AND n <= 1000""")
def scan_paged(spark, sf_dir):
    """The second page of 500 frames: offset and limit over a total order."""
    found = frames(spark, sf_dir).where(F.col("block").between(1000, 1400) & F.col("to_addr").isin(*IDENTITY))
    return shown(found.orderBy("block", "tx", "path").offset(500).limit(500)).select(*FRAME_COLUMNS)


BOTH_SQL = f"""both_ways AS (
  SELECT 'to' AS direction, {FRAME_SQL} FROM frames WHERE to_addr IN {ID} AND block BETWEEN 1000 AND 1400
  UNION ALL SELECT 'from', {FRAME_SQL} FROM frames WHERE from_addr IN {ID} AND block BETWEEN 1000 AND 1400)"""


def both_directions(spark, sf_dir):
    found = shown(frames(spark, sf_dir).where(F.col("block").between(1000, 1400)))
    to = found.where(F.col("to_addr").isin(*IDENTITY)).select(F.lit("to").alias("direction"), *FRAME_COLUMNS)
    return to.unionByName(found.where(F.col("from_addr").isin(*IDENTITY)).select(F.lit("from").alias("direction"), *FRAME_COLUMNS))


@query(PRELUDE + f", {BOTH_SQL} SELECT * FROM both_ways")
def scan_both_directions(spark, sf_dir):
    """A frame within the target appears twice, once in each direction."""
    return both_directions(spark, sf_dir)


@query(PRELUDE + f", {BOTH_SQL} SELECT count(*) AS frames, count(DISTINCT tx) AS txs FROM both_ways")
def set_union_all(spark, sf_dir):
    return both_directions(spark, sf_dir).agg(F.count("*").alias("frames"), F.countDistinct("tx").alias("txs"))


@query(PRELUDE + f"""SELECT tx, block, p AS path FROM (SELECT *, row_number() OVER (ORDER BY block DESC, tx, path) AS n FROM frames WHERE to_addr IN {ID}) WHERE n <= 700""")
def scan_backward_capped(spark, sf_dir):
    """Newest frames up to a cap: a top-k, which each task cuts before anything moves."""
    found = frames(spark, sf_dir).where(F.col("to_addr").isin(*IDENTITY))
    return shown(found.orderBy(F.col("block").desc(), "tx", "path").limit(700)).select("tx", "block", "path")


# --- normalisation -------------------------------------------------------------------------------------------------


@query(PRELUDE + """SELECT tx, p AS path, row_number() OVER (PARTITION BY tx, path[:depth - 1] ORDER BY path) - 1 AS ordinal FROM frames WHERE depth > 0""")
def norm_child_ordinal(spark, sf_dir):
    return shown(trace.child_ordinals(frames(spark, sf_dir))).select("tx", "path", F.col("ordinal").cast("long"))


@query(PRELUDE + """SELECT tx, p AS path, row_number() OVER (PARTITION BY tx ORDER BY path) AS walked FROM frames""")
def norm_preorder(spark, sf_dir):
    """Arrays order element by element with a prefix first: the order of a depth-first walk."""
    found = frames(spark, sf_dir).withColumn("walked", F.row_number().over(Window.partitionBy("tx").orderBy("path")).cast("long"))
    return shown(found).select("tx", "path", "walked")


@query(PRELUDE + """, kept AS (SELECT tx, path, p, depth FROM frames WHERE error IS NULL OR depth = 0)
SELECT k.tx, k.p AS path FROM kept k
WHERE (SELECT count(*) FROM kept q WHERE q.tx = k.tx AND q.depth < k.depth AND q.path = k.path[:q.depth]) = k.depth""")
def norm_flat_tree(spark, sf_dir):
    """Frames that a tree built from those without an error reaches from its root."""
    kept = frames(spark, sf_dir).where(F.col("error").isNull() | (F.size("path") == 0))
    return shown(trace.reachable(kept)).select("tx", "path")


@query(PRELUDE + "SELECT tx, p AS path, CASE WHEN length(input) >= 10 AND starts_with(input, '0x') THEN lower(substr(input, 1, 10)) END AS found FROM frames")
def scalar_selector(spark, sf_dir):
    from framelark.functions.scalars import selector_of_input

    return shown(frames(spark, sf_dir)).select("tx", "path", selector_of_input(F.col("input")).alias("found"))


# --- joins ---------------------------------------------------------------------------------------------------------


@query(PRELUDE + "SELECT tx, p AS path, caller_selector, has_parent FROM walked")
def join_parent_caller(spark, sf_dir):
    return shown(trace.with_caller(frames(spark, sf_dir))).select("tx", "path", "caller_selector", "has_parent")


@query(PRELUDE + "SELECT tx, p AS path, enclosing FROM walked WHERE from_in")
def join_enclosing(spark, sf_dir):
    found = flagged(spark, sf_dir)
    return shown(trace.with_enclosing(found.where("from_in"), found)).select("tx", "path", "enclosing")


@query(PRELUDE + "SELECT tx, p AS path, enclosing, to_addr, selector, call_type FROM outbound")
def edge_outbound(spark, sf_dir):
    return shown(left(spark, sf_dir)).select("tx", "path", "enclosing", "to_addr", "selector", "call_type")


@query(PRELUDE + "SELECT tx, p AS path, from_addr, caller_selector, selector, call_type FROM inbound")
def edge_inbound(spark, sf_dir):
    return shown(entered(spark, sf_dir)).select("tx", "path", "from_addr", "caller_selector", "selector", "call_type")


@query(PRELUDE + """SELECT e.target_selector, t.signature AS target_signature, e.destination, e.destination_selector, d.signature AS destination_signature, e.call_type, e.calls
FROM edges_out e LEFT JOIN signatures t ON t.selector = e.target_selector LEFT JOIN signatures d ON d.selector = e.destination_selector""")
def join_signatures(spark, sf_dir):
    edges = trace.signed(out_edges(spark, sf_dir), signatures(spark, sf_dir), target_selector="target_signature", destination_selector="destination_signature")
    return edges.select("target_selector", "target_signature", "destination", "destination_selector", "destination_signature", "call_type", "calls")


LABELLED = """CASE WHEN length(a) > 12 THEN substr(a, 1, 6) || '…' || substr(a, -4) ELSE a END"""


@query(PRELUDE + f"""SELECT a AS address, calls, coalesce(label, {LABELLED}) AS label, coalesce(is_contract, false) AS is_contract
FROM (SELECT from_addr AS a, count(*) AS calls FROM inbound GROUP BY 1) LEFT JOIN labels ON addr = a""")
def join_labels(spark, sf_dir):
    from framelark.functions.scalars import short_address

    found = trace.rollup(trace.inbound(trace.flagged(frames(spark, sf_dir), IDENTITY)), "from_addr").join(labels(spark, sf_dir), F.col("address") == F.col("addr"), "left")
    return found.select("address", "calls", F.coalesce("label", short_address(F.col("address"))).alias("label"), F.coalesce("is_contract", F.lit(False)).alias("is_contract"))


@query(PRELUDE + """SELECT a AS address, CASE WHEN c.addr IS NOT NULL OR coalesce(l.is_contract, false) THEN 'contract' WHEN l.addr IS NOT NULL THEN 'eoa' ELSE 'unknown' END AS kind
FROM (SELECT from_addr AS a FROM inbound UNION SELECT to_addr FROM outbound) LEFT JOIN code_bearing c ON c.addr = a LEFT JOIN labels l ON l.addr = a""")
def join_kind(spark, sf_dir):
    all_frames = frames(spark, sf_dir)
    found = trace.flagged(all_frames, IDENTITY)
    ends = trace.inbound(found).select(F.col("from_addr").alias("address")).union(trace.outbound(found).select("to_addr")).distinct()
    return trace.kinds(ends, all_frames, labels(spark, sf_dir))


@query(PRELUDE + """SELECT DISTINCT s AS selector FROM (SELECT target_selector AS s FROM edges_out UNION SELECT destination_selector FROM edges_out)
WHERE s IS NOT NULL AND s NOT IN (SELECT selector FROM signatures)""")
def join_unresolved(spark, sf_dir):
    return trace.selectors(out_edges(spark, sf_dir)).join(signatures(spark, sf_dir), "selector", "left_anti")


@query(PRELUDE + """SELECT s AS selector, signature FROM (SELECT DISTINCT lower(selector) AS s FROM frames WHERE selector IS NOT NULL) LEFT JOIN signatures ON signatures.selector = s""")
def sig_resolve(spark, sf_dir):
    wanted = frames(spark, sf_dir).where("selector is not null").select(F.lower("selector").alias("selector")).distinct()
    return wanted.join(signatures(spark, sf_dir), "selector", "left")


PROVENANCE = """scanned AS (SELECT DISTINCT selector FROM signatures), observed AS (SELECT DISTINCT selector FROM inbound WHERE selector IS NOT NULL)"""


@query(PRELUDE + f""", {PROVENANCE}
SELECT coalesce(s.selector, o.selector) AS selector, CASE WHEN s.selector IS NULL THEN 'trace' WHEN o.selector IS NULL THEN 'dispatcher' ELSE 'both' END AS provenance
FROM scanned s FULL JOIN observed o ON s.selector = o.selector""")
def join_provenance(spark, sf_dir):
    scanned, observed = both_selectors(spark, sf_dir)
    joined = scanned.withColumn("s", F.lit(True)).join(observed.withColumn("o", F.lit(True)), "selector", "full_outer")
    return joined.select("selector", F.when(F.col("s").isNull(), "trace").when(F.col("o").isNull(), "dispatcher").otherwise("both").alias("provenance"))


def both_selectors(spark, sf_dir):
    scanned = signatures(spark, sf_dir).select("selector").distinct()
    return scanned, trace.inbound(trace.flagged(frames(spark, sf_dir), IDENTITY)).where("selector is not null").select("selector").distinct()


@query(PRELUDE + f", {PROVENANCE} SELECT selector FROM scanned UNION SELECT selector FROM observed")
def set_union(spark, sf_dir):
    scanned, observed = both_selectors(spark, sf_dir)
    return scanned.union(observed).distinct()


@query(PRELUDE + f", {PROVENANCE} SELECT selector FROM scanned INTERSECT SELECT selector FROM observed")
def set_intersect(spark, sf_dir):
    scanned, observed = both_selectors(spark, sf_dir)
    return scanned.intersect(observed)


@query(PRELUDE + f", {PROVENANCE} SELECT selector FROM observed EXCEPT SELECT selector FROM scanned")
def set_except(spark, sf_dir):
    scanned, observed = both_selectors(spark, sf_dir)
    return observed.exceptAll(scanned)


@query(PRELUDE + "SELECT tx, array_to_string(list(a ORDER BY f), ',') AS callers FROM (SELECT tx, from_addr AS a, min(path) AS f FROM frames GROUP BY ALL) GROUP BY tx")
def set_distinct(spark, sf_dir):
    """Distinct callers of a transaction, in the order of first sight."""
    seen = frames(spark, sf_dir).groupBy("tx").agg(F.array_sort(F.collect_list(F.struct("path", "from_addr"))).alias("s"))
    return seen.select("tx", F.array_join(F.array_distinct(F.col("s.from_addr")), ",").alias("callers"))


# --- aggregations --------------------------------------------------------------------------------------------------


@query(PRELUDE + "SELECT * FROM edges_out")
def agg_outbound_edges(spark, sf_dir):
    return out_edges(spark, sf_dir)


@query(PRELUDE + "SELECT * FROM edges_in")
def agg_inbound_edges(spark, sf_dir):
    return in_edges(spark, sf_dir)


@query(PRELUDE + "SELECT * FROM edges_delegated")
def agg_delegatecalls(spark, sf_dir):
    return delegated_edges(spark, sf_dir)


@query(PRELUDE + """SELECT 'outbound' AS direction, to_addr AS address, count(*) AS calls, count(DISTINCT tx) AS txs FROM outbound GROUP BY to_addr
UNION ALL SELECT 'inbound', from_addr, count(*), count(DISTINCT tx) FROM inbound GROUP BY from_addr""")
def agg_contract_rollup(spark, sf_dir):
    found = trace.flagged(frames(spark, sf_dir), IDENTITY)
    out = trace.rollup(trace.outbound(found), "to_addr").withColumn("direction", F.lit("outbound"))
    return out.unionByName(trace.rollup(trace.inbound(found), "from_addr").withColumn("direction", F.lit("inbound")))


@query(PRELUDE + "SELECT to_addr AS address, selector, count(*) AS calls FROM outbound GROUP BY ALL")
def agg_function_counts(spark, sf_dir):
    return trace.function_counts(trace.outbound(trace.flagged(frames(spark, sf_dir), IDENTITY)), "to_addr", "selector")


@query(PRELUDE + "SELECT selector, count(*) AS calls FROM inbound GROUP BY ALL")
def agg_target_calls(spark, sf_dir):
    return trace.function_counts(trace.inbound(trace.flagged(frames(spark, sf_dir), IDENTITY)), None, "selector")


@query(PRELUDE + """SELECT 'outbound' AS direction, sum(calls)::BIGINT AS calls FROM edges_out UNION ALL SELECT 'inbound', sum(calls)::BIGINT FROM edges_in
UNION ALL SELECT 'delegatecall', sum(calls)::BIGINT FROM edges_delegated""")
def agg_totals(spark, sf_dir):
    found = trace.flagged(frames(spark, sf_dir), IDENTITY)
    direction = F.when(F.col("to_in") & ~F.col("from_in"), "inbound").when(
        F.col("from_in") & ~F.col("to_in") & F.col("to_addr").isNotNull(), F.when(F.col("call_type") == "delegatecall", "delegatecall").otherwise("outbound")
    )
    return found.withColumn("direction", direction).where("direction is not null").groupBy("direction").agg(F.count("*").alias("calls"))


CANDIDATES = f"""candidates AS (
  SELECT tx, min(block) AS block, list_sort(list_distinct(list(selector) FILTER (to_in AND selector IS NOT NULL))) AS sels,
         list_sort(list_distinct(list(CASE WHEN to_in THEN from_addr ELSE to_addr END) FILTER (from_in <> to_in AND CASE WHEN to_in THEN from_addr ELSE to_addr END IS NOT NULL))) AS others
  FROM frames WHERE from_in OR to_in GROUP BY tx)"""


def candidates(found):
    """``tx, block, selectors, counterparties`` of the transactions that flagged frames touch the target in."""
    other = F.when(F.col("from_in") != F.col("to_in"), F.when(F.col("to_in"), F.col("from_addr")).otherwise(F.col("to_addr")))
    return found.where("from_in or to_in").groupBy("tx").agg(
        F.min("block").alias("block"), F.array_sort(F.collect_set(F.when(F.col("to_in"), F.col("selector")))).alias("selectors"), F.array_sort(F.collect_set(other)).alias("counterparties")
    )


@query(PRELUDE + f", {CANDIDATES} SELECT tx, block, array_to_string(coalesce(sels, []), ',') AS selectors, array_to_string(coalesce(others, []), ',') AS counterparties FROM candidates")
def agg_candidates(spark, sf_dir):
    found = candidates(trace.flagged(frames(spark, sf_dir), IDENTITY))
    return found.select("tx", "block", F.array_join("selectors", ",").alias("selectors"), F.array_join("counterparties", ",").alias("counterparties"))


@query(PRELUDE + "SELECT count(DISTINCT tx) AS txs FROM frames WHERE from_in OR to_in")
def agg_distinct_tx(spark, sf_dir):
    return trace.flagged(frames(spark, sf_dir), IDENTITY).where("from_in or to_in").agg(F.countDistinct("tx").alias("txs"))


ACTIVITY = "activity AS (SELECT destination AS address, calls FROM edges_out UNION ALL SELECT destination, calls FROM edges_delegated UNION ALL SELECT caller, calls FROM edges_in)"


def activity(spark, sf_dir):
    """Calls by counterparty over all three kinds of edges, from flags alone: no ancestor is needed for it."""
    found = trace.flagged(frames(spark, sf_dir), IDENTITY)
    other = F.when(F.col("to_in") & ~F.col("from_in"), F.col("from_addr")).when(F.col("from_in") & ~F.col("to_in"), F.col("to_addr"))
    return found.select(other.alias("address")).where("address is not null").groupBy("address").agg(F.count("*").alias("calls"))


@query(PRELUDE + f", {ACTIVITY} SELECT address, sum(calls)::BIGINT AS calls FROM activity GROUP BY address")
def agg_activity(spark, sf_dir):
    return activity(spark, sf_dir)


@query(PRELUDE + f""", {ACTIVITY} SELECT address, calls, n AS place FROM (
  SELECT address, sum(calls)::BIGINT AS calls, row_number() OVER (ORDER BY sum(calls) DESC, address) AS n FROM activity GROUP BY address) WHERE n <= 60""")
def topk_label_budget(spark, sf_dir):
    """The sixty most active addresses, which one load of labels covers."""
    top = activity(spark, sf_dir).orderBy(F.col("calls").desc(), "address").limit(60)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("calls").desc(), "address")).cast("long"))


@query(PRELUDE + """SELECT DISTINCT s AS selector FROM (SELECT target_selector AS s FROM edges_out UNION ALL SELECT destination_selector FROM edges_out
UNION ALL SELECT target_selector FROM edges_delegated UNION ALL SELECT destination_selector FROM edges_delegated UNION ALL SELECT target_selector FROM edges_in UNION ALL SELECT caller_selector FROM edges_in) WHERE s IS NOT NULL""")
def agg_selectors(spark, sf_dir):
    found = walked(spark, sf_dir)
    out = found.where("from_in and not to_in and to_addr is not null").select(F.explode(F.array("enclosing", "selector")).alias("selector"))
    entered = trace.inbound(found).select(F.explode(F.array("caller_selector", "selector")).alias("selector"))
    return out.unionByName(entered).where("selector is not null").distinct()


@query(PRELUDE + """SELECT label, count(DISTINCT a) AS addresses FROM (SELECT from_addr AS a FROM inbound UNION SELECT to_addr FROM outbound) JOIN labels ON addr = a GROUP BY label HAVING count(DISTINCT a) > 1""")
def agg_ambiguous_labels(spark, sf_dir):
    return counterparts(spark, sf_dir).groupBy("label").agg(F.countDistinct("address").alias("addresses")).where("addresses > 1")


def counterparts(spark, sf_dir):
    found = trace.flagged(frames(spark, sf_dir), IDENTITY)
    ends = trace.inbound(found).select(F.col("from_addr").alias("address")).union(trace.outbound(found).select("to_addr")).distinct()
    return ends.join(labels(spark, sf_dir), F.col("address") == F.col("addr"))


@query(PRELUDE + """, ends AS (SELECT a, label FROM (SELECT from_addr AS a FROM inbound UNION SELECT to_addr FROM outbound) JOIN labels ON addr = a)
SELECT a AS address, CASE WHEN count(*) OVER (PARTITION BY label) > 1 THEN label || ' (' || a || ')' ELSE label END AS label FROM ends""")
def agg_disambiguate(spark, sf_dir):
    """Labels that several addresses bear get the short address; the count is aggregated first, so a common label is no hot window."""
    from framelark.functions.scalars import short_address

    found = counterparts(spark, sf_dir)
    shared = found.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select(F.col("label").alias("_label"))
    joined = found.join(shared, F.col("label") == F.col("_label"), "left")
    own = F.concat("label", F.lit(" ("), short_address(F.col("address")), F.lit(")"))
    return joined.select("address", F.when(F.col("_label").isNotNull(), own).otherwise(F.col("label")).alias("label"))


@query(PRELUDE + """SELECT count(*) FILTER (label IS NULL) AS skipped, count(*) FILTER (label IS NOT NULL) AS named
FROM (SELECT from_addr AS a FROM inbound UNION SELECT to_addr FROM outbound) LEFT JOIN labels ON addr = a""")
def agg_label_coverage(spark, sf_dir):
    found = trace.flagged(frames(spark, sf_dir), IDENTITY)
    ends = trace.inbound(found).select(F.col("from_addr").alias("address")).union(trace.outbound(found).select("to_addr")).distinct()
    joined = ends.join(labels(spark, sf_dir), F.col("address") == F.col("addr"), "left")
    return joined.agg(F.count_if(F.col("label").isNull()).alias("skipped"), F.count_if(F.col("label").isNotNull()).alias("named"))


@query(PRELUDE + """SELECT count(DISTINCT signature) AS resolved FROM (SELECT destination_selector AS s FROM edges_out UNION SELECT caller_selector FROM edges_in UNION SELECT target_selector FROM edges_in)
JOIN signatures ON selector = s""")
def agg_resolved(spark, sf_dir):
    found = trace.with_caller(trace.flagged(frames(spark, sf_dir), IDENTITY))
    used = trace.outbound(found).select("selector").unionByName(trace.inbound(found).select(F.explode(F.array("caller_selector", "selector")).alias("selector"))).distinct()
    return used.join(signatures(spark, sf_dir), "selector").agg(F.countDistinct("signature").alias("resolved"))


@query(PRELUDE + """SELECT (SELECT count(*) FROM edges_out) AS outbound_edges, (SELECT count(*) FROM edges_in) AS inbound_edges, (SELECT count(*) FROM edges_delegated) AS delegatecall_edges,
(SELECT count(DISTINCT to_addr) FROM outbound) AS outbound_contracts, (SELECT count(DISTINCT from_addr) FROM inbound) AS inbound_contracts""")
def agg_stats(spark, sf_dir):
    found = walked(spark, sf_dir)
    key_out = F.struct(F.coalesce("enclosing", F.lit("")), "to_addr", F.coalesce("selector", F.lit("")), "call_type")
    key_in = F.struct("from_addr", F.coalesce("caller_selector", F.lit("")), F.coalesce("selector", F.lit("")), "call_type")
    is_out = F.col("from_in") & ~F.col("to_in") & F.col("to_addr").isNotNull()
    deleg, is_in = F.col("call_type") == "delegatecall", F.col("to_in") & ~F.col("from_in")
    parts = found.select(F.when(is_out & ~deleg, key_out).alias("o"), F.when(is_in, key_in).alias("i"), F.when(is_out & deleg, key_out).alias("d"), F.when(is_out & ~deleg, F.col("to_addr")).alias("oc"), F.when(is_in, F.col("from_addr")).alias("ic"))
    names = {"o": "outbound_edges", "i": "inbound_edges", "d": "delegatecall_edges", "oc": "outbound_contracts", "ic": "inbound_contracts"}
    return parts.agg(*(F.countDistinct(c).alias(n) for c, n in names.items()))


@query(PRELUDE + """SELECT node, side, sum(calls)::BIGINT AS calls FROM (
SELECT destination AS node, 'right' AS side, calls FROM edges_out UNION ALL SELECT caller, 'left', calls FROM edges_in) GROUP BY ALL""")
def agg_graph_model(spark, sf_dir):
    found = trace.flagged(frames(spark, sf_dir), IDENTITY)
    right = trace.outbound(found).select(F.col("to_addr").alias("node"), F.lit("right").alias("side"))
    return right.unionByName(trace.inbound(found).select(F.col("from_addr").alias("node"), F.lit("left").alias("side"))).groupBy("node", "side").agg(F.count("*").alias("calls"))


MAP_SIDE = """kinds AS (SELECT a, calls, CASE WHEN c.addr IS NOT NULL OR coalesce(l.is_contract, false) THEN 'contract' WHEN l.addr IS NOT NULL THEN 'eoa' ELSE 'unknown' END AS kind
FROM (SELECT from_addr AS a, count(*) AS calls FROM inbound GROUP BY 1) LEFT JOIN code_bearing c ON c.addr = a LEFT JOIN labels l ON l.addr = a)"""


@query(PRELUDE + f""", {MAP_SIDE} SELECT a AS address, calls, n AS place FROM (SELECT *, row_number() OVER (ORDER BY calls DESC, a) AS n FROM kinds WHERE kind <> 'eoa') WHERE n <= 10""")
def agg_map_side(spark, sf_dir):
    all_frames = frames(spark, sf_dir)
    callers = trace.rollup(trace.inbound(trace.flagged(all_frames, IDENTITY)), "from_addr").select("address", "calls")
    top = trace.kinds(callers, all_frames, labels(spark, sf_dir)).where("kind <> 'eoa'").orderBy(F.col("calls").desc(), "address").limit(10)
    return top.select("address", "calls", F.row_number().over(Window.orderBy(F.col("calls").desc(), "address")).cast("long").alias("place"))


@query(PRELUDE + """SELECT to_addr AS destination, selector, call_type, count(*) AS frames FROM walked WHERE from_in AND NOT to_in AND to_addr IS NOT NULL AND tx = '0x0000000b' GROUP BY ALL""")
def agg_explain_tx(spark, sf_dir):
    """One transaction's outbound edges, delegatecalls among them."""
    found = trace.flagged(frames(spark, sf_dir).where("tx = '0x0000000b'"), IDENTITY).where("from_in and not to_in and to_addr is not null")
    return found.groupBy(F.col("to_addr").alias("destination"), "selector", "call_type").agg(F.count("*").alias("frames"))


# --- windows and order ---------------------------------------------------------------------------------------------

OUT_KEYS = ("enclosing", "to_addr", "selector", "call_type")
FIRST_SQL = "firsts AS (SELECT enclosing, to_addr, selector, call_type, tx, min(block) AS block, min(tx_ord) AS tx_ord, min(path) AS path FROM outbound GROUP BY enclosing, to_addr, selector, call_type, tx)"
PATH_SQL = "CASE WHEN len(path) = 0 THEN 'root' ELSE array_to_string(path, ',') END AS path"


@query(PRELUDE + f", {FIRST_SQL} SELECT enclosing, to_addr, selector, call_type, tx, {PATH_SQL} FROM firsts")
def win_first_proof(spark, sf_dir):
    first = left(spark, sf_dir).groupBy(*OUT_KEYS, "tx").agg(F.min("path").alias("path"))
    return shown(first)


@query(PRELUDE + f""", {FIRST_SQL} SELECT enclosing, to_addr, selector, call_type, n AS proof_no, tx, block, {PATH_SQL}
FROM (SELECT *, row_number() OVER (PARTITION BY enclosing, to_addr, selector, call_type ORDER BY block DESC, path, tx_ord) AS n FROM firsts) WHERE n <= 3""")
def win_top3_proofs(spark, sf_dir):
    found = trace.proofs(left(spark, sf_dir), OUT_KEYS)
    return shown(found).withColumn("proof_no", F.col("proof_no").cast("long"))


@query(PRELUDE + """, firsts AS (SELECT to_addr, tx, max(block) AS block, min(p) AS path FROM outbound GROUP BY to_addr, tx)
SELECT to_addr AS address, n AS proof_no, tx, block, path FROM (SELECT *, row_number() OVER (PARTITION BY to_addr ORDER BY block DESC, path, tx) AS n FROM firsts) WHERE n <= 3""")
def win_pick_proofs(spark, sf_dir):
    """Proofs of several rows together: one a transaction, newest first, then by the path's text."""
    rows = shown(trace.outbound(trace.flagged(frames(spark, sf_dir), IDENTITY)))
    first = rows.groupBy(F.col("to_addr").alias("address"), "tx").agg(F.max("block").alias("block"), F.min("path").alias("path"))
    order = Window.partitionBy("address").orderBy(F.col("block").desc(), "path", "tx")
    return first.withColumn("proof_no", F.row_number().over(order).cast("long")).where("proof_no <= 3")


@query(PRELUDE + "SELECT to_addr AS address, arg_max(tx, {'o': tx_ord, 'p': path}) AS tx, arg_max(block, {'o': tx_ord, 'p': path}) AS block FROM outbound GROUP BY to_addr")
def win_last_walked(spark, sf_dir):
    rows = trace.outbound(trace.flagged(frames(spark, sf_dir), IDENTITY))
    return rows.groupBy(F.col("to_addr").alias("address")).agg(F.max_by("tx", trace.walk_order()).alias("tx"), F.max_by("block", trace.walk_order()).alias("block"))


@query(PRELUDE + """SELECT to_addr AS address, calls, n AS place, greatest(count(*) OVER () - 18, 0) AS hidden FROM (
  SELECT to_addr, count(*) AS calls, row_number() OVER (ORDER BY count(*) DESC, to_addr) AS n FROM outbound GROUP BY to_addr) QUALIFY n <= 18""")
def win_layout_cap(spark, sf_dir):
    """At most 18 nodes of a column, and how many are hidden."""
    nodes = trace.rollup(trace.outbound(trace.flagged(frames(spark, sf_dir), IDENTITY)), "to_addr")
    order = Window.orderBy(F.col("calls").desc(), "address")
    ranked = nodes.select("address", "calls", F.row_number().over(order).cast("long").alias("place"), F.greatest(F.count("*").over(Window.partitionBy()) - 18, F.lit(0)).alias("hidden"))
    return ranked.where("place <= 18")


@query(PRELUDE + """SELECT target_selector, destination, destination_selector, call_type, calls, row_number() OVER (ORDER BY calls DESC, o, target_selector NULLS FIRST, destination, destination_selector NULLS FIRST, call_type) AS place FROM (
  SELECT enclosing AS target_selector, to_addr AS destination, selector AS destination_selector, call_type, count(*) AS calls, min({'o': tx_ord, 'p': path}) AS o FROM outbound GROUP BY enclosing, to_addr, selector, call_type)""")
def sort_edges(spark, sf_dir):
    """Edges by calls; ties as the walk first met them."""
    edges = left(spark, sf_dir).groupBy(*OUT_KEYS).agg(F.count("*").alias("calls"), F.min(trace.walk_order()).alias("o"))
    order = Window.orderBy(F.col("calls").desc(), "o", "enclosing", "to_addr", "selector", "call_type")
    return edges.select(F.col("enclosing").alias("target_selector"), F.col("to_addr").alias("destination"), F.col("selector").alias("destination_selector"), "call_type", "calls", F.row_number().over(order).cast("long").alias("place"))


@query(PRELUDE + """SELECT address, side, calls, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY calls DESC, address) AS n FROM (
  SELECT 'outbound' AS side, to_addr AS address, count(*) AS calls FROM outbound GROUP BY to_addr UNION ALL SELECT 'inbound', from_addr, count(*) FROM inbound GROUP BY from_addr)) WHERE n <= 3""")
def topk_summary(spark, sf_dir):
    found = trace.flagged(frames(spark, sf_dir), IDENTITY)
    out = trace.rollup(trace.outbound(found), "to_addr").withColumn("side", F.lit("outbound"))
    both = out.unionByName(trace.rollup(trace.inbound(found), "from_addr").withColumn("side", F.lit("inbound")))
    order = Window.partitionBy("side").orderBy(F.col("calls").desc(), "address")
    return both.select("address", "side", "calls", F.row_number().over(order).cast("long").alias("place")).where("place <= 3")


@query(PRELUDE + """SELECT signature, calls, n AS place FROM (SELECT signature, sum(calls)::BIGINT AS calls, row_number() OVER (ORDER BY sum(calls) DESC, signature) AS n
FROM edges_in JOIN signatures ON selector = target_selector GROUP BY signature) WHERE n <= 5""")
def topk_map_functions(spark, sf_dir):
    calls = trace.function_counts(trace.inbound(trace.flagged(frames(spark, sf_dir), IDENTITY)), None, "selector")
    named = calls.join(signatures(spark, sf_dir), "selector").groupBy("signature").agg(F.sum("calls").alias("calls"))
    top = named.orderBy(F.col("calls").desc(), "signature").limit(5)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.col("calls").desc(), "signature")).cast("long"))


# --- filters and evidence ------------------------------------------------------------------------------------------


@query(PRELUDE + "SELECT caller, target_selector, call_type, calls FROM edges_in WHERE NOT caller_is_eoa AND caller_selector IS NULL")
def flt_unknown_caller(spark, sf_dir):
    return in_edges(spark, sf_dir).where("not caller_is_eoa and caller_selector is null").select("caller", "target_selector", "call_type", "calls")


@query(PRELUDE + "SELECT tx, p AS path FROM frames WHERE regexp_matches('0x' || repeat(substr(md5(from_addr), 1, 8), 5), '^0x[0-9a-fA-F]{40}$') AND NOT regexp_matches(from_addr, '^0x[0-9a-fA-F]{40}$') AND error IS NOT NULL")
def flt_address(spark, sf_dir):
    from framelark.functions.scalars import is_address

    made = F.concat(F.lit("0x"), F.repeat(F.substring(F.md5("from_addr"), 1, 8), 5))
    return shown(frames(spark, sf_dir).where(is_address(made) & ~is_address(F.col("from_addr")) & F.col("error").isNotNull())).select("tx", "path")
