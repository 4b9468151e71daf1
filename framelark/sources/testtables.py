"""Adapter: call frames, labels and signatures out of the order tables, so that trace queries run on any TPC-H-like folder.

An order is a transaction, its lines are calls below the root call. ``PRELUDE`` states the same tables as CTEs for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelark.landing import saved

#: The proxy and its implementation, one target seen under two addresses.
IDENTITY = ("s0", "s1")
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def selector_of(text):
    """Column: a made-up selector, 8 hexadecimal digits of an MD5."""
    return F.concat(F.lit("0x"), F.substring(F.md5(text), 1, 8))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tx, block, tx_ord, path, frame_type, call_type, from_addr, to_addr, input, selector, value, error``: one row a frame.

    Line i of an order is the call [i/3], its callee's call or that one's, by i modulo 3. A frame of a delegatecall speaks for the
    frame above it. One shuffle by order key serves the line numbers and the join.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("long").alias("block"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cust"),
        F.concat(F.lit("s"), (F.col("o_custkey") % 10).cast("string")).alias("root_to"),
        selector_of(F.col("o_orderpriority")).alias("root_selector"),
    )
    by_order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    kind = F.when(F.col("l_returnflag") == "R", "staticcall").when(F.col("l_linestatus") == "F", "delegatecall").otherwise("call")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        (F.row_number().over(by_order) - 1).alias("i"),
        kind.alias("call_type"),
        F.when(F.col("l_suppkey") % 10 != 9, F.concat(F.lit("s"), (F.col("l_suppkey") % 10).cast("string"))).alias("to_addr"),
        F.when(F.col("l_partkey") % 7 != 6, selector_of(F.concat(F.lit("f"), (F.col("l_partkey") % 7).cast("string")))).alias("selector"),
        F.when(F.col("l_quantity") >= 49, F.lit("reverted")).alias("error"),
        *LINE_ORDER,
    )
    lines = lines.select(
        "l_orderkey", "i", "call_type", "to_addr", "selector", "error",
        *(F.lag(c, n).over(by_order).alias(f"{c}_{n}") for n in (1, 2) for c in ("call_type", "to_addr")),
    )
    speaks = lambda kind, to, sender: F.when((kind == "delegatecall") | to.isNull(), sender).otherwise(to)
    level, at = F.col("i") % 3, F.floor(F.col("i") / 3).cast("int")
    first = F.col("root_to")
    second = speaks(F.col("call_type_1"), F.col("to_addr_1"), first)
    third = speaks(F.col("call_type_1"), F.col("to_addr_1"), speaks(F.col("call_type_2"), F.col("to_addr_2"), first))
    zero = F.lit(0)
    calls = lines.join(orders, F.col("l_orderkey") == F.col("k")).select(
        "k", "block",
        F.when(level == 0, F.array(at)).when(level == 1, F.array(at, zero)).otherwise(F.array(at, zero, zero)).alias("path"),
        "call_type",
        F.when(level == 0, first).when(level == 1, second).otherwise(third).alias("from_addr"),
        "to_addr", "selector", "error",
    )
    roots = orders.select(
        "k", "block", F.array().cast("array<int>").alias("path"), F.lit("call").alias("call_type"),
        F.when(F.col("k") % 11 == 0, "s0").otherwise(F.col("cust")).alias("from_addr"),
        F.col("root_to").alias("to_addr"), F.col("root_selector").alias("selector"), F.lit(None).cast("string").alias("error"),
    )
    return roots.unionByName(calls).select(
        F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("k")), 8, "0")).alias("tx"),
        "block",
        ((100000 - F.col("block")) * 10**12 + F.col("k")).alias("tx_ord"),
        "path",
        F.lit("call").alias("frame_type"),
        "call_type", "from_addr", "to_addr",
        F.coalesce(F.concat("selector", F.lit("00ff")), F.lit("0x")).alias("input"),
        "selector", F.lit("0x0").alias("value"), "error",
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``addr, label, is_contract, known``: suppliers' nations (shared, so ambiguous), customers' names; every third customer is unknown."""
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier").where("s_suppkey < 10 and s_suppkey <> 8").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    suppliers = supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("addr"), F.concat(F.lit("Token "), (F.col("n_nationkey") % 4).cast("string")).alias("label"), F.lit(True).alias("is_contract"))
    customer = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0")
    customers = customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("addr"), F.col("c_name").alias("label"), (F.col("c_custkey") % 5 == 0).alias("is_contract"))
    return suppliers.unionByName(customers).withColumn("known", F.lit(True))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``selector, signature``: part names as functions for five of the six line selectors and the priorities' own."""
    parts = table(spark, sf_dir, "part").where("p_partkey < 5")
    named = parts.select(selector_of(F.concat(F.lit("f"), F.col("p_partkey").cast("string"))).alias("selector"), F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("(uint256)")).alias("signature"))
    priorities = table(spark, sf_dir, "orders").select("o_orderpriority").distinct().where("o_orderpriority <> '5-LOW'")
    own = priorities.select(selector_of(F.col("o_orderpriority")).alias("selector"), F.concat(F.lit("order_"), F.substring("o_orderpriority", 1, 1), F.lit("()")).alias("signature"))
    return named.unionByName(own)


def landed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames as a table that lies there, as a query that reads them more than once finds them."""
    return saved(frames(spark, sf_dir), "frames")


def target_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``addr, path, content``: source of the target, one file. Function k calls the dependencies whose number has its parity, then one that nobody
    signs, then the first dependency at a fixed address. The third dependency is declared with another type than the one that is observed.
    """
    parts = table(spark, sf_dir, "part").where("p_partkey < 5").select(F.col("p_partkey").alias("p"), F.regexp_replace("p_name", " ", "_").alias("name"))
    kind = F.when(F.col("p") == 2, "address").otherwise("uint256")
    declared = F.concat(F.lit("function "), "name", F.lit("("), kind, F.lit(" x) external; "))
    of = lambda text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", text.alias("t")))), lambda x: x["t"]), "")
    first = F.max(F.when(F.col("p") == 0, F.col("name")))
    interface = parts.agg(F.concat(F.lit("interface Dep { "), of(declared), F.lit("function ghost(uint256 x) external; } contract Target { Dep dep; ")).alias("head"), first.alias("first"))
    numbers = table(spark, sf_dir, "orders").select("o_orderpriority").distinct().where("o_orderpriority <> '5-LOW'").select(F.substring("o_orderpriority", 1, 1).cast("int").alias("k"))
    calls = numbers.join(parts, (F.col("k") + F.col("p")) % 2 == 0).groupBy("k").agg(of(F.concat(F.lit("dep."), "name", F.lit("(1); "))).alias("calls"))  # four functions, five parts
    body = F.concat(F.lit("function order_"), F.col("k").cast("string"), F.lit("() external { "), "calls", F.lit(f"dep.ghost(1); Dep({FIXED}).FIRST(1); }} "))
    bodies = calls.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", body.alias("t")))), lambda x: x["t"]), "").alias("bodies"))
    whole = interface.crossJoin(bodies).select(F.replace(F.concat("head", "bodies", F.lit("}")), F.lit("FIRST"), F.col("first")).alias("content"))  # one row each
    return whole.select(F.lit("s0").alias("addr"), F.lit("Target.sol").alias("path"), "content")


#: An address that no frame has.
FIXED = "0x" + "00" * 19 + "aa"

#: What the code of the target makes possible, for DuckDB, after ``PRELUDE``.
SITES_SQL = f"""sites AS (
  SELECT fn, (row_number() OVER (PARTITION BY fn ORDER BY o, p) - 1)::BIGINT AS site_ord, selector, name, address FROM (
    SELECT fn, 0 AS o, p, selector, name, NULL::VARCHAR AS address FROM target_functions JOIN deps ON (p + k) % 2 = 0
    UNION ALL SELECT fn, 1, 0, NULL, 'ghost', NULL FROM target_functions
    UNION ALL SELECT fn, 2, 0, selector, name, '{FIXED}' FROM target_functions JOIN deps ON p = 0))"""
SOURCE_SQL = """target_functions AS (SELECT '0x' || substr(md5(o_orderpriority), 1, 8) AS fn, substr(o_orderpriority, 1, 1)::INT AS k FROM (SELECT DISTINCT o_orderpriority FROM orders) WHERE o_orderpriority <> '5-LOW'),
deps AS (SELECT p_partkey AS p, replace(p_name, ' ', '_') AS name, CASE WHEN p_partkey <> 2 THEN '0x' || substr(md5('f' || p_partkey), 1, 8) END AS selector FROM part WHERE p_partkey < 5),
""" + SITES_SQL  # noqa: E501

#: The same tables for DuckDB. ``p`` is the path as text, ``root`` for the root, ``depth`` its length, ``pk`` it with a point after each step.
PRELUDE = """
WITH RECURSIVE ord AS (
  SELECT o_orderkey AS k, datediff('day', DATE '1992-01-01', o_orderdate::DATE)::BIGINT AS block,
         'c' || o_custkey AS cust, 's' || (o_custkey % 10) AS root_to, '0x' || substr(md5(o_orderpriority), 1, 8) AS root_selector
  FROM orders),
lin AS (
  SELECT l_orderkey, (row_number() OVER w - 1)::INT AS i,
         CASE WHEN l_returnflag = 'R' THEN 'staticcall' WHEN l_linestatus = 'F' THEN 'delegatecall' ELSE 'call' END AS call_type,
         CASE WHEN l_suppkey % 10 <> 9 THEN 's' || (l_suppkey % 10) END AS to_addr,
         CASE WHEN l_partkey % 7 <> 6 THEN '0x' || substr(md5('f' || (l_partkey % 7)), 1, 8) END AS selector,
         CASE WHEN l_quantity >= 49 THEN 'reverted' END AS error, *
  FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)),
lag1 AS (
  SELECT l_orderkey, i, call_type, to_addr, selector, error,
         lag(call_type) OVER v AS type_1, lag(to_addr) OVER v AS to_1, lag(call_type, 2) OVER v AS type_2, lag(to_addr, 2) OVER v AS to_2
  FROM lin WINDOW v AS (PARTITION BY l_orderkey ORDER BY i)),
calls AS (
  SELECT k, block, CASE i % 3 WHEN 0 THEN [i // 3] WHEN 1 THEN [i // 3, 0] ELSE [i // 3, 0, 0] END AS path, call_type,
         CASE i % 3 WHEN 0 THEN root_to
           WHEN 1 THEN CASE WHEN type_1 = 'delegatecall' OR to_1 IS NULL THEN root_to ELSE to_1 END
           ELSE CASE WHEN type_1 = 'delegatecall' OR to_1 IS NULL THEN CASE WHEN type_2 = 'delegatecall' OR to_2 IS NULL THEN root_to ELSE to_2 END ELSE to_1 END
         END AS from_addr, to_addr, selector, error
  FROM lag1 JOIN ord ON l_orderkey = k),
frames AS (
  SELECT '0x' || lpad(lower(printf('%x', k)), 8, '0') AS tx, block, (100000 - block) * 1000000000000 + k AS tx_ord, path,
         CASE WHEN len(path) = 0 THEN 'root' ELSE array_to_string(path, ',') END AS p, len(path)::INT AS depth,
         'call' AS frame_type, call_type, from_addr, to_addr, coalesce(selector || '00ff', '0x') AS input, selector, '0x0' AS value, error,
         coalesce(from_addr IN ('s0', 's1'), false) AS from_in, coalesce(to_addr IN ('s0', 's1'), false) AS to_in
  FROM (SELECT k, block, []::INT[] AS path, 'call' AS call_type, CASE WHEN k % 11 = 0 THEN 's0' ELSE cust END AS from_addr,
               root_to AS to_addr, root_selector AS selector, NULL AS error FROM ord
        UNION ALL SELECT * FROM calls)),
labels AS (
  SELECT 's' || s_suppkey AS addr, 'Token ' || (s_nationkey % 4) AS label, true AS is_contract FROM supplier WHERE s_suppkey < 10 AND s_suppkey <> 8
  UNION ALL SELECT 'c' || c_custkey, c_name, c_custkey % 5 = 0 FROM customer WHERE c_custkey % 3 <> 0),
signatures AS (
  SELECT '0x' || substr(md5('f' || p_partkey), 1, 8) AS selector, replace(p_name, ' ', '_') || '(uint256)' AS signature FROM part WHERE p_partkey < 5
  UNION ALL SELECT DISTINCT '0x' || substr(md5(o_orderpriority), 1, 8), 'order_' || substr(o_orderpriority, 1, 1) || '()' FROM orders WHERE o_orderpriority <> '5-LOW'),
setters AS (SELECT * FROM frames WHERE to_in AND NOT (from_in AND call_type = 'delegatecall')),
walked AS (
  SELECT f.*, q.selector AS caller_selector, q.tx IS NOT NULL AS has_parent, e.enclosing
  FROM frames f
  LEFT JOIN frames q ON q.tx = f.tx AND f.depth > 0 AND q.path = f.path[:f.depth - 1]
  LEFT JOIN (
    SELECT c.tx, c.path, arg_max_null(s.selector, s.depth) AS enclosing
    FROM frames c JOIN setters s ON s.tx = c.tx AND s.depth < c.depth AND s.path = c.path[:s.depth]
    GROUP BY c.tx, c.path) e ON e.tx = f.tx AND e.path = f.path),
outbound AS (SELECT * FROM walked WHERE from_in AND NOT to_in AND to_addr IS NOT NULL AND call_type <> 'delegatecall'),
delegated AS (SELECT * FROM walked WHERE from_in AND NOT to_in AND to_addr IS NOT NULL AND call_type = 'delegatecall'),
inbound AS (SELECT * FROM walked WHERE NOT from_in AND to_in),
code_bearing AS (SELECT DISTINCT from_addr AS addr FROM frames WHERE depth > 0),
edges_out AS (
  SELECT enclosing AS target_selector, to_addr AS destination, selector AS destination_selector, call_type, count(*) AS calls, count(DISTINCT tx) AS txs,
         arg_max(block, {'o': tx_ord, 'p': path}) AS last_block, arg_max(tx, {'o': tx_ord, 'p': path}) AS last_tx
  FROM outbound GROUP BY ALL),
edges_delegated AS (
  SELECT enclosing AS target_selector, to_addr AS destination, selector AS destination_selector, call_type, count(*) AS calls, count(DISTINCT tx) AS txs,
         arg_max(block, {'o': tx_ord, 'p': path}) AS last_block, arg_max(tx, {'o': tx_ord, 'p': path}) AS last_tx
  FROM delegated GROUP BY ALL),
edges_in AS (
  SELECT from_addr AS caller, caller_selector, selector AS target_selector, call_type, count(*) AS calls, count(DISTINCT tx) AS txs,
         arg_max(block, {'o': tx_ord, 'p': path}) AS last_block, arg_max(tx, {'o': tx_ord, 'p': path}) AS last_tx,
         arg_min(NOT has_parent AND NOT coalesce(is_contract, false), {'o': tx_ord, 'p': path}) AS caller_is_eoa
  FROM inbound LEFT JOIN labels ON addr = from_addr GROUP BY from_addr, caller_selector, selector, call_type)
"""
