"""Queries of discovery, of the merge of possible and observed, and of views on both."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelark.landing import saved
from framelark.operators import discovery, merge, sourcecode, trace
from framelark.plans.registry import query
from framelark.plans.tracequeries import CANDIDATES, candidates, out_edges, shown
from framelark.sources.testtables import IDENTITY, PRELUDE, SOURCE_SQL, frames, labels, landed_frames, signatures, table, target_source

SPAN, SLICES, CAP = 400, 10, 12000
SEGMENTS = f"""span AS (SELECT greatest(0, max(block) - {SPAN} + 1) AS low, max(block) AS head FROM frames),
cuts AS (SELECT low, head, ceil((head - low + 1) / greatest(1, least({SLICES}, head - low + 1))::DOUBLE)::BIGINT AS w FROM span),
segments AS (SELECT n AS slice_index, greatest(low, head - n * w - w + 1) AS from_block, head - n * w AS to_block
  FROM (SELECT *, unnest(range(ceil((head - low + 1) / w::DOUBLE)::BIGINT)) AS n FROM cuts))"""
TOUCHED = """touched AS (SELECT f.*, s.slice_index FROM frames f JOIN segments s ON f.block BETWEEN s.from_block AND s.to_block WHERE f.from_in OR f.to_in)"""


def span_of(spark, sf_dir):
    """``low, head`` of the blocks that are looked at; of the orders themselves, as a node tells its head without its traces."""
    head = table(spark, sf_dir, "orders").agg(F.max(F.datediff("o_orderdate", F.lit("1992-01-01").cast("date"))).cast("long").alias("head"))
    return head.select(F.greatest(F.lit(0).cast("long"), F.col("head") - SPAN + 1).alias("low"), "head")


def planned(spark, sf_dir):
    return discovery.segments(span_of(spark, sf_dir), SLICES)


def touched(spark, sf_dir):
    flagged = trace.flagged(frames(spark, sf_dir), IDENTITY).where("from_in or to_in")
    return discovery.in_segments(flagged, span_of(spark, sf_dir), SLICES)


@query(PRELUDE + f", {SEGMENTS} SELECT * FROM segments")
def math_segments(spark, sf_dir):
    return planned(spark, sf_dir)


@query(PRELUDE + f", {SEGMENTS}, {TOUCHED} SELECT tx, p AS path, slice_index FROM touched")
def join_range_segment(spark, sf_dir):
    return shown(touched(spark, sf_dir)).select("tx", "path", "slice_index")


@query(PRELUDE + f", {SEGMENTS}, {TOUCHED} SELECT slice_index, tx, path FROM (SELECT slice_index, tx, p AS path, row_number() OVER (PARTITION BY slice_index ORDER BY block DESC, tx, touched.path) AS n FROM touched) WHERE n <= 40")
def topk_frame_cap(spark, sf_dir):
    return shown(discovery.capped(touched(spark, sf_dir), 40, F.col("block").desc(), "tx", "path")).select("slice_index", "tx", "path")


DISCOVERED = """discovered AS (
  SELECT tx, min(block) AS block, min(slice_index) AS slice_index, list_sort(list_distinct(list(selector) FILTER (to_in AND selector IS NOT NULL))) AS sels,
         list_sort(list_distinct(list(CASE WHEN to_in THEN from_addr ELSE to_addr END) FILTER (from_in <> to_in AND CASE WHEN to_in THEN from_addr ELSE to_addr END IS NOT NULL))) AS others
  FROM (SELECT *, row_number() OVER (PARTITION BY slice_index ORDER BY block DESC, tx, path) AS n FROM touched) WHERE n <= 1200 GROUP BY tx)"""


def discovered(spark, sf_dir):
    """Candidates of the capped scan of every segment; a transaction has one block, so one segment."""
    found = discovery.capped(touched(spark, sf_dir), CAP // SLICES, F.col("block").desc(), "tx", "path")
    return candidates(found).join(found.groupBy("tx").agg(F.min("slice_index").alias("slice_index")), "tx")


@query(PRELUDE + f", {SEGMENTS}, {TOUCHED}, {DISCOVERED} SELECT tx, block, slice_index, coalesce(len(sels), 0) AS selectors, coalesce(len(others), 0) AS counterparties FROM discovered")
def discover_range(spark, sf_dir):
    return discovered(spark, sf_dir).select("tx", "block", "slice_index", F.size("selectors").cast("long").alias("selectors"), F.size("counterparties").cast("long").alias("counterparties"))


@query(PRELUDE + f""", {SEGMENTS}, {TOUCHED}, {DISCOVERED}, counted AS (SELECT slice_index, count(*) AS n FROM discovered GROUP BY slice_index),
few AS (SELECT s.slice_index FROM segments s LEFT JOIN counted c ON c.slice_index = s.slice_index WHERE coalesce(c.n, 0) < (SELECT max(n) FROM counted))
SELECT tx, slice_index, 'range' AS path FROM discovered WHERE slice_index NOT IN (SELECT slice_index FROM few)
UNION ALL SELECT DISTINCT tx, slice_index, 'explorer' FROM touched WHERE to_in AND slice_index IN (SELECT slice_index FROM few)""")
def discover_escape(spark, sf_dir):
    """Segments with fewer candidates than the best one turn to the explorer, which knows transactions into the target."""
    found = saved(discovered(spark, sf_dir).select("tx", "slice_index"), "discovered")
    least = found.groupBy("slice_index").count().agg(F.max("count")).first()[0] or 0
    explorer = touched(spark, sf_dir).where("to_in").select("tx", "slice_index").distinct()
    return discovery.escaped(found, explorer, planned(spark, sf_dir), least)


PICKS = 8


@query(PRELUDE + f""", {SEGMENTS}, {TOUCHED}, {DISCOVERED},
pool AS (SELECT slice_index, tx, block, list_concat(list_transform(coalesce(sels, []), lambda s: 's' || s), list_transform(coalesce(others, []), lambda a: 'a' || a)) AS adds
  FROM (SELECT *, row_number() OVER (PARTITION BY slice_index ORDER BY block DESC, tx) AS n FROM discovered) WHERE n <= 500),
picks(slice_index, place, tx, seen, picked) AS (
  SELECT DISTINCT slice_index, 0, NULL::VARCHAR, []::VARCHAR[], []::VARCHAR[] FROM pool
  UNION ALL
  SELECT slice_index, place, tx, list_concat(seen, adds), list_append(picked, tx) FROM (
    SELECT p.slice_index, p.place + 1 AS place, c.tx, p.seen, c.adds, p.picked,
           row_number() OVER (PARTITION BY p.slice_index ORDER BY len(list_filter(c.adds, lambda x: NOT list_contains(p.seen, x))) DESC, c.block DESC, c.tx) AS n
    FROM picks p JOIN pool c ON c.slice_index = p.slice_index AND NOT list_contains(p.picked, c.tx) WHERE p.place < {PICKS}) WHERE n = 1)
SELECT slice_index, tx, place::BIGINT AS place FROM picks WHERE place > 0""")
def rank_greedy(spark, sf_dir):
    """The greedy sample of each segment: each pick by what the picks before it have not covered."""
    return discovery.greedy(discovered(spark, sf_dir), PICKS)


@query(PRELUDE + f""", {SEGMENTS}, {TOUCHED}, {DISCOVERED},
ranked AS (SELECT tx, slice_index, row_number() OVER (PARTITION BY slice_index ORDER BY coalesce(len(sels), 0) + coalesce(len(others), 0) DESC, block DESC, tx) AS place FROM discovered)
SELECT tx, slice_index, place FROM (SELECT *, row_number() OVER (ORDER BY place, slice_index) AS n FROM ranked) WHERE n <= 80""")
def rank_interleave(spark, sf_dir):
    order = Window.partitionBy("slice_index").orderBy((F.size("selectors") + F.size("counterparties")).desc(), F.col("block").desc(), "tx")
    ranked = discovered(spark, sf_dir).select("tx", "slice_index", F.row_number().over(order).cast("long").alias("place"))
    return discovery.interleaved(ranked, 80)


@query(PRELUDE + f", {CANDIDATES} SELECT tx, block, 0 AS slice_index FROM (SELECT *, row_number() OVER (ORDER BY block DESC, tx) AS n FROM candidates) WHERE n <= 240")
def discover_explorer(spark, sf_dir):
    """An explorer's candidates: newest first up to three times the traced ones, one segment, no hints."""
    found = candidates(trace.flagged(frames(spark, sf_dir), IDENTITY)).select("tx", "block")
    return found.orderBy(F.col("block").desc(), "tx").limit(240).withColumn("slice_index", F.lit(0))


@query(PRELUDE + f""", {CANDIDATES} SELECT tx, block FROM candidates WHERE block >= (SELECT max(block) - {SPAN} + 1 FROM frames)""")
def discover_router(spark, sf_dir, trace_filter: bool = True):
    """Which path finds candidates is settled when the plan is built, by the chain's flag."""
    if not trace_filter:
        return discover_explorer(spark, sf_dir).select("tx", "block")
    low = span_of(spark, sf_dir).select("low").scalar()
    return candidates(trace.flagged(frames(spark, sf_dir), IDENTITY)).where(F.col("block") >= low).select("tx", "block")


@query(PRELUDE + """, tos AS (SELECT tx, min(block) AS block, 1 AS prio FROM frames WHERE to_in AND depth > 0 GROUP BY tx UNION ALL SELECT tx, min(block), 2 FROM frames WHERE from_in GROUP BY tx
UNION ALL SELECT tx, block, 3 FROM frames WHERE to_in AND depth = 0), firsts AS (SELECT tx, min(block) AS block, min(prio) AS prio FROM tos GROUP BY tx)
SELECT tx, block, prio FROM (SELECT *, row_number() OVER (ORDER BY prio, block DESC, tx) AS n FROM firsts) WHERE n <= 300""")
def scan_candidate_union(spark, sf_dir):
    """Internal calls in, internal calls out, transactions: each only for the room that those before leave."""
    found = trace.flagged(frames(spark, sf_dir), IDENTITY)
    depth = F.size("path")
    prio = F.when(F.col("to_in") & (depth > 0), 1).when(F.col("from_in"), 2).when(F.col("to_in"), 3)
    firsts = found.withColumn("prio", prio).where("prio is not null").groupBy("tx").agg(F.min("block").alias("block"), F.min("prio").alias("prio"))
    return firsts.orderBy("prio", F.col("block").desc(), "tx").limit(300)


@query(PRELUDE + """SELECT tx, block, page FROM (SELECT *, (n - 1) // 50 AS page FROM (SELECT tx, max(block) AS block, row_number() OVER (ORDER BY max(block) DESC, tx) AS n FROM frames WHERE to_in AND block > 0 GROUP BY tx)) WHERE page < 10""")
def scan_candidate_pages(spark, sf_dir):
    """Ten pages of fifty distinct transactions with a positive block."""
    found = trace.flagged(frames(spark, sf_dir), IDENTITY).where("to_in and block > 0").groupBy("tx").agg(F.max("block").alias("block"))
    top = found.orderBy(F.col("block").desc(), "tx").limit(500)
    return top.withColumn("page", F.floor((F.row_number().over(Window.orderBy(F.col("block").desc(), "tx")) - 1) / 50).cast("long"))


READ = """reads AS (SELECT DISTINCT block // 7 * 7 AS from_block, block // 7 * 7 + (block % 5) AS to_block FROM frames WHERE from_in OR to_in)"""
ISLANDS = """marks AS (SELECT *, CASE WHEN min(from_block) OVER w IS NULL OR to_block + 1 < min(from_block) OVER w THEN 1 ELSE 0 END AS opens
  FROM reads WINDOW w AS (ORDER BY to_block DESC, from_block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
numbered AS (SELECT *, sum(opens) OVER (ORDER BY to_block DESC, from_block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM marks),
islands AS (SELECT min(from_block) AS from_block, max(to_block) AS to_block, count(*) AS slices FROM numbered GROUP BY island)"""


def read_slices(spark, sf_dir):
    found = trace.flagged(frames(spark, sf_dir), IDENTITY).where("from_in or to_in")
    start = F.floor(F.col("block") / 7) * 7
    return found.select(start.alias("from_block"), (start + F.col("block") % 5).alias("to_block")).distinct()


@query(PRELUDE + f", {READ}, {ISLANDS} SELECT * FROM islands")
def win_merge_slices(spark, sf_dir):
    return discovery.islands(read_slices(spark, sf_dir))


@query(PRELUDE + f""", {READ}, {ISLANDS} SELECT (SELECT max(to_block) FROM islands) - (SELECT min(from_block) FROM islands) + 1 AS blocks, sum(to_block - from_block + 1)::BIGINT AS covered_blocks,
count(*) AS slices, sum(to_block - from_block + 1) * 12 / 86400 AS covered_days FROM islands""")
def agg_window(spark, sf_dir):
    merged = discovery.islands(read_slices(spark, sf_dir))
    width = F.sum(F.col("to_block") - F.col("from_block") + 1)
    return merged.agg((F.max("to_block") - F.min("from_block") + 1).alias("blocks"), width.alias("covered_blocks"), F.count("*").alias("slices"), (width * 12 / 86400).alias("covered_days"))


@query(PRELUDE + f""", {READ}, {ISLANDS} SELECT 'Read ' || count(*) || CASE WHEN count(*) = 1 THEN ' slice' ELSE ' slices' END || ' of about ' || floor(sum(to_block - from_block + 1) / count(*) + 0.5)::BIGINT || ' blocks. They cover '
|| sum(to_block - from_block + 1)::BIGINT || ' of {SPAN} blocks.' AS note FROM islands""")
def report_window_note(spark, sf_dir):
    width = F.sum(F.col("to_block") - F.col("from_block") + 1)
    n = F.count("*")
    return discovery.islands(read_slices(spark, sf_dir)).agg(
        F.concat(F.lit("Read "), n.cast("string"), F.when(n == 1, " slice").otherwise(" slices"), F.lit(" of about "), F.floor(width / n + 0.5).cast("string"), F.lit(" blocks. They cover "), width.cast("string"), F.lit(f" of {SPAN} blocks.")).alias("note")
    )


@query(PRELUDE + f", {SEGMENTS} SELECT slice_index, (from_block - low) * 100.0::DOUBLE / (head - low + 1) AS left_pct, (to_block - from_block + 1) * 100.0::DOUBLE / (head - low + 1) AS width_pct FROM segments, span")
def math_slice_strip(spark, sf_dir):
    parts = planned(spark, sf_dir)
    ends = parts.agg(F.min("from_block").alias("low"), F.max("to_block").alias("head"))
    total = F.col("head") - F.col("low") + 1
    return parts.crossJoin(F.broadcast(ends)).select("slice_index", ((F.col("from_block") - F.col("low")) * F.lit(100.0) / total).alias("left_pct"), ((F.col("to_block") - F.col("from_block") + 1) * F.lit(100.0) / total).alias("width_pct"))


# --- possible and observed -----------------------------------------------------------------------------------------

SITES = """edges AS (SELECT target_selector AS fn, md5(target_selector || destination || coalesce(destination_selector, '') || call_type) AS edge_id, destination, destination_selector AS selector,
  CASE WHEN strpos(signature, '(') > 1 THEN split_part(signature, '(', 1) END AS name, calls, txs
  FROM edges_out LEFT JOIN signatures s ON s.selector = destination_selector WHERE target_selector IS NOT NULL),
""" + SOURCE_SQL + """,
pairs AS (SELECT s.fn, s.site_ord, e.edge_id, e.calls, e.txs, row_number() OVER (PARTITION BY e.edge_id ORDER BY s.site_ord) AS n FROM sites s JOIN edges e ON s.fn = e.fn
  AND CASE WHEN s.selector IS NOT NULL AND e.selector IS NOT NULL THEN s.selector = e.selector ELSE s.name = e.name END AND (s.address IS NULL OR s.address = e.destination)),
matched AS (SELECT * FROM pairs WHERE n = 1),
merged AS (
  SELECT s.fn, s.site_ord, NULL::VARCHAR AS edge_id, s.address AS destination, s.selector, s.name, true AS possible, t.calls IS NOT NULL AS observed, coalesce(t.calls, 0)::BIGINT AS calls, coalesce(t.txs, 0)::BIGINT AS txs
  FROM sites s LEFT JOIN (SELECT fn, site_ord, sum(calls) AS calls, max(txs) AS txs FROM matched GROUP BY ALL) t ON t.fn = s.fn AND t.site_ord = s.site_ord
  UNION ALL SELECT fn, NULL::BIGINT, edge_id, destination, selector, name, false, true, calls, txs FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM matched))"""


def site_tables(spark, sf_dir):
    """What the target's parsed source makes possible, and the edges that were observed; each is made once and written, as all that follows reads both."""
    from framelark.functions.scalars import name_of_signature

    book = signatures(spark, sf_dir)
    edges = trace.signed(out_edges(spark, sf_dir), book, destination_selector="signature").where("target_selector is not null")
    ident = F.md5(F.concat("target_selector", "destination", F.coalesce("destination_selector", F.lit("")), "call_type"))
    edges = edges.select(F.col("target_selector").alias("fn"), ident.alias("edge_id"), "destination", F.col("destination_selector").alias("selector"), name_of_signature(F.col("signature")).alias("name"), "calls", "txs")
    source = target_source(spark, sf_dir)
    functions = sourcecode.functions(source, source.select("addr", F.lit("Target").alias("contract"), F.lit(None).cast("array<string>").alias("abi")))
    return saved(merge.call_sites(functions, book), "sites"), saved(edges, "edges")


def possible_observed(spark, sf_dir):
    return merge.merged(*site_tables(spark, sf_dir))


@query(PRELUDE + f", {SITES} SELECT * REPLACE (coalesce(site_ord, -1) AS site_ord) FROM merged")
def merge_possible_observed(spark, sf_dir):
    """Calls without a site have site -1 here."""
    return possible_observed(spark, sf_dir).withColumn("site_ord", F.coalesce("site_ord", F.lit(-1).cast("long")))


@query(PRELUDE + f", {SITES} SELECT e.fn, e.edge_id, e.destination, m.edge_id IS NOT NULL AS possible_from_code FROM edges e LEFT JOIN matched m ON m.edge_id = e.edge_id")
def merge_mark_edges(spark, sf_dir):
    sites, edges = site_tables(spark, sf_dir)
    return merge.marked(edges, sites).select("fn", "edge_id", "destination", "possible_from_code")


@query(PRELUDE + f", {SITES} SELECT fn, sum(calls)::BIGINT AS calls, max(txs) AS txs FROM merged WHERE observed GROUP BY fn")
def agg_merged_calls(spark, sf_dir):
    return possible_observed(spark, sf_dir).where("observed").groupBy("fn").agg(F.sum("calls").alias("calls"), F.max("txs").alias("txs"))


@query(PRELUDE + f", {SITES} SELECT CASE WHEN possible AND observed THEN 'both' WHEN possible THEN 'possible only' ELSE 'observed only' END AS evidence, count(*) AS n FROM merged GROUP BY 1")
def flt_evidence(spark, sf_dir):
    kind = F.when(F.col("possible") & F.col("observed"), "both").when(F.col("possible"), "possible only").otherwise("observed only")
    return possible_observed(spark, sf_dir).groupBy(kind.alias("evidence")).agg(F.count("*").alias("n"))


@query(PRELUDE + f", {SITES} SELECT fn, coalesce(name, selector, 'unknown function') AS label, calls, row_number() OVER (ORDER BY calls DESC, coalesce(name, selector, 'unknown function'), fn, site_ord, edge_id) AS place FROM merged")
def sort_merged(spark, sf_dir):
    label = F.coalesce("name", "selector", F.lit("unknown function"))
    order = Window.orderBy(F.col("calls").desc(), "label", "fn", F.col("site_ord").asc_nulls_last(), F.col("edge_id").asc_nulls_last())
    return possible_observed(spark, sf_dir).withColumn("label", label).select("fn", "label", "calls", F.row_number().over(order).cast("long").alias("place"))


@query(PRELUDE + """SELECT f.selector, coalesce(c.calls, 0) AS calls, greatest(coalesce(o.txs, 0), coalesce(i.txs, 0))::BIGINT AS txs, coalesce(o.n, 0) AS outbound, coalesce(i.n, 0) AS inbound
FROM (SELECT DISTINCT selector FROM signatures) f LEFT JOIN (SELECT selector, count(*) AS calls FROM inbound GROUP BY selector) c ON c.selector = f.selector
LEFT JOIN (SELECT target_selector, max(txs) AS txs, count(*) AS n FROM edges_out GROUP BY 1) o ON o.target_selector = f.selector
LEFT JOIN (SELECT target_selector, sum(txs) AS txs, count(*) AS n FROM edges_in GROUP BY 1) i ON i.target_selector = f.selector""")
def map_function(spark, sf_dir):
    """Entries, and edges out and in, of one pass over the frames that touch the target."""
    functions = signatures(spark, sf_dir).select("selector").distinct()
    rows = trace.touching(landed_frames(spark, sf_dir), IDENTITY)
    entries = trace.function_counts(trace.inbound(rows), None, "selector").where("selector is not null")
    out, into = trace.edge_keys(trace.outbound(rows), "out"), trace.edge_keys(trace.inbound(rows), "in")
    return merge.function_map(functions, entries, out, into)


@query(PRELUDE + """SELECT s.selector, s.signature, CASE WHEN o.selector IS NULL THEN false ELSE true END AS observed, count(*) OVER (PARTITION BY split_part(s.signature, '(', 1)) > 1 AS overloaded
FROM signatures s LEFT JOIN (SELECT DISTINCT selector FROM inbound) o ON o.selector = s.selector""")
def agg_overloaded(spark, sf_dir):
    from framelark.functions.scalars import name_of_signature

    book = signatures(spark, sf_dir).withColumn("name", name_of_signature(F.col("signature")))
    seen = trace.inbound(trace.flagged(frames(spark, sf_dir), IDENTITY)).select(F.col("selector").alias("_s")).distinct()
    shared = F.count("*").over(Window.partitionBy("name")) > 1
    return book.join(seen, F.col("selector") == F.col("_s"), "left").select("selector", "signature", F.col("_s").isNotNull().alias("observed"), shared.alias("overloaded"))


@query(PRELUDE + """SELECT coalesce(s.selector, a.selector) AS selector, s.selector IS NOT NULL AS in_source FROM (SELECT selector FROM signatures WHERE signature LIKE 's%' OR signature LIKE 'order%') s
RIGHT JOIN (SELECT selector FROM signatures UNION SELECT '0xdeadbeef') a ON a.selector = s.selector""")
def join_reconcile(spark, sf_dir):
    """Functions of the source against those of the interface: the interface decides, and adds what the source lacks."""
    book = signatures(spark, sf_dir)
    source = book.where("signature like 's%' or signature like 'order%'").select("selector", F.lit(True).alias("s"))
    abi = book.select("selector").union(spark.range(1).select(F.lit("0xdeadbeef"))).distinct()
    return abi.join(source, "selector", "left").select("selector", F.coalesce("s", F.lit(False)).alias("in_source"))


@query("""WITH needed AS (SELECT DISTINCT p_brand AS standard, p_name AS member FROM part),
held AS (SELECT DISTINCT l_suppkey AS holder, p_name AS member FROM lineitem JOIN part ON p_partkey = l_partkey),
size AS (SELECT standard, count(*) AS n FROM needed GROUP BY standard)
SELECT holder, standard FROM held JOIN needed USING (member) JOIN size USING (standard) GROUP BY holder, standard, n HAVING count(*) = n""")
def agg_division(spark, sf_dir):
    """Relational division: suppliers that supply every kind of part, by name, that a brand has."""
    from framelark.functions.abi import division
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("standard"), F.col("p_name").alias("member"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("holder"), "l_partkey")
    return division(lines.join(parts, F.col("p_partkey") == F.col("l_partkey")).select("holder", "member"), parts.select("standard", "member"))


@query("""SELECT CAST(addr AS BIGINT) AS addr, count(k.selector) / count(*)::DOUBLE AS ratio FROM (SELECT DISTINCT l_suppkey % 20 AS addr, l_partkey % 97 AS selector FROM lineitem) d
LEFT JOIN (SELECT DISTINCT l_suppkey % 20 AS addr, l_partkey % 97 AS selector FROM lineitem WHERE l_quantity > 40) k USING (addr, selector) GROUP BY addr""")
def agg_match_ratio(spark, sf_dir):
    from framelark.functions.abi import match_ratio
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("addr"), (F.col("l_partkey") % 97).alias("selector"), "l_quantity")
    return match_ratio(rows.select("addr", "selector"), rows.where("l_quantity > 40"))


@query(PRELUDE + """SELECT a AS address, CASE WHEN kind = 'eoa' THEN 'An externally owned account.' WHEN kind = 'unknown' THEN 'Nothing is known about this address.' ELSE 'A contract named ' || coalesce(label, a) || '.' END AS phrase
FROM (SELECT a, l.label, CASE WHEN c.addr IS NOT NULL OR coalesce(l.is_contract, false) THEN 'contract' WHEN l.addr IS NOT NULL THEN 'eoa' ELSE 'unknown' END AS kind
FROM (SELECT DISTINCT from_addr AS a FROM inbound) LEFT JOIN code_bearing c ON c.addr = a LEFT JOIN labels l ON l.addr = a)""")
def text_identity(spark, sf_dir):
    all_frames = frames(spark, sf_dir)
    callers = trace.inbound(trace.flagged(all_frames, IDENTITY)).select(F.col("from_addr").alias("address")).distinct()
    book = labels(spark, sf_dir)
    named = trace.kinds(callers, all_frames, book).join(book.select(F.col("addr").alias("_a"), "label"), F.col("address") == F.col("_a"), "left")
    phrase = F.when(F.col("kind") == "eoa", "An externally owned account.").when(F.col("kind") == "unknown", "Nothing is known about this address.")
    return named.select("address", phrase.otherwise(F.concat(F.lit("A contract named "), F.coalesce("label", "address"), F.lit("."))).alias("phrase"))


@query(PRELUDE + f""", {SITES},
checks AS (SELECT (SELECT count(*) FROM merged WHERE possible AND NOT observed) AS possible_only, (SELECT count(*) FROM merged WHERE observed AND NOT possible) AS observed_only,
  (SELECT count(*) FROM edges_delegated) AS delegated, (SELECT count(*) FROM edges_in WHERE NOT caller_is_eoa AND caller_selector IS NULL) AS unattributed)
SELECT 'static-vs-observed' AS id, possible_only + observed_only AS n FROM checks WHERE possible_only + observed_only > 0
UNION ALL SELECT 'delegatecall', delegated FROM checks WHERE delegated > 0
UNION ALL SELECT 'inbound-attribution', unattributed FROM checks WHERE unattributed > 0""")
def review_checks(spark, sf_dir):
    """One row for each evidence check that has something to report."""
    rows = saved(trace.touching(landed_frames(spark, sf_dir), IDENTITY), "touching")
    one_sided = possible_observed(spark, sf_dir).where("possible <> observed").agg(F.count("*").alias("n")).select(F.lit("static-vs-observed").alias("id"), "n")
    delegated = trace.outbound_edges(trace.delegatecalls(rows)).agg(F.count("*").alias("n")).select(F.lit("delegatecall").alias("id"), "n")
    unknown = trace.inbound_edges(trace.inbound(rows), labels(spark, sf_dir)).where("not caller_is_eoa and caller_selector is null").agg(F.count("*").alias("n")).select(F.lit("inbound-attribution").alias("id"), "n")
    return one_sided.unionByName(delegated).unionByName(unknown).where("n > 0")
