"""Queries of requests, registries, probe tables and drawings."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelark.operators import service, trace
from framelark.plans.registry import query
from framelark.plans.tracequeries import out_edges
from framelark.sources.testcontracts import expected, instances
from framelark.sources.testtables import IDENTITY, PRELUDE, frames, landed_frames, table


@query("""SELECT o_orderkey, '0x' || lower(printf('%x', o_custkey)) AS address, CASE WHEN o_orderkey % 3 = 0 THEN 'ethereum' ELSE lower(o_orderstatus) END AS chain,
CASE o_orderkey % 4 WHEN 0 THEN 'quick' WHEN 1 THEN 'deep' ELSE 'standard' END AS depth FROM orders""")
def req_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    address = F.concat(F.lit("  0x"), F.lower(F.hex("o_custkey")), F.lit(" "))
    depth = F.when(k % 4 == 0, " quick ").when(k % 4 == 1, "deep").when(k % 4 == 2, "abysmal")
    chain = F.when(k % 3 != 0, F.concat(F.lower("o_orderstatus"), F.lit(" ")))
    params = F.map_filter(F.create_map(F.lit("address"), address, F.lit("depth"), depth, F.lit("chain"), chain), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "orders").select("o_orderkey", service.parsed_request(params).alias("r")).select("o_orderkey", "r.*")


@query("""SELECT o_orderkey, o_orderkey % 5 IN (0, 1, 3) OR o_orderkey % 7 = 0 AS may, o_orderkey % 2 = 0 OR o_orderkey % 7 > 0 AS starts FROM orders""")
def req_auth(spark, sf_dir):
    """Callers with the token in a header or a query, with another one or none; every seventh server has none set."""
    k = F.col("o_orderkey")
    own = F.concat(F.lit("token-"), F.col("o_custkey").cast("string"))
    token = F.when(k % 7 == 0, "  ").otherwise(own)
    header = F.when(k % 5 == 0, own).when(k % 5 == 3, F.concat(F.lit(" "), own)).when(k % 5 == 2, F.concat(own, F.lit("x")))
    asked = F.when(k % 5 == 1, own).when(k % 5 == 4, "")
    host = F.when(k % 2 == 0, "localhost").otherwise("0.0.0.0")
    return table(spark, sf_dir, "orders").select("o_orderkey", service.authorised(header, asked, token).alias("may"), service.may_start(host, token).alias("starts"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 400 ELSE 200 END AS status, CASE page_id % 4 WHEN 1 THEN '/index.html' WHEN 2 THEN '/p' || page_id || '.js' WHEN 3 THEN '/p' || page_id || '.bin' END AS file,
CASE page_id % 4 WHEN 1 THEN 'text/html; charset=utf-8' WHEN 2 THEN 'text/javascript; charset=utf-8' WHEN 3 THEN 'application/octet-stream' END AS kind FROM pages""")
def req_static(spark, sf_dir):
    k, name = F.col("page_id") % 4, F.col("page_id").cast("string")
    path = F.when(k == 0, F.concat(F.lit("/../p"), name)).when(k == 1, "/").when(k == 2, F.concat(F.lit("/p"), name, F.lit(".js"))).otherwise(F.concat(F.lit("/p"), name, F.lit(".bin")))
    return table(spark, sf_dir, "pages").select("page_id", service.static_file(path).alias("f")).select("page_id", "f.*")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '&name=' || replace(url_encode(c_name || ' & co'), '%20', '+') || CASE WHEN c_custkey % 2 = 0 THEN '&key=' || c_custkey ELSE '' END END AS text FROM customer""")
def fn_query_string(spark, sf_dir):
    """The cursor of a next page as the end of an address."""
    k = F.col("c_custkey")
    entry = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    params = F.array(entry("name", F.when(k % 5 != 0, F.concat("c_name", F.lit(" & co")))), entry("key", F.when((k % 2 == 0) & (k % 5 != 0), k.cast("string"))), entry("none", F.lit(None).cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", service.query_string(params).alias("text"))


REGISTRY_KINDS = ("two", "one", "none", "broken")
REGISTRY = (
    ("two", '{"1¤":{"explorers":[{"url":"https://other.example.com/","hostedBy":"team"},{"url":"https://own¤.example.com//","hostedBy":"host"}]},"x":{"explorers":[{"url":"u","hostedBy":"host"}]}}'),
    ("one", '{"2¤":{"explorers":[{"url":"https://only.example.com","hostedBy":"team"}]},"3¤":{"name":"no explorers"}}'), ("none", '{"4":{"explorers":[]}}'), ("broken", "<html>"),
)


@query("SELECT chain_id::BIGINT AS chain_id, urls FROM (" + expected(REGISTRY_KINDS, [("two", "1¤", "https://own¤.example.com https://other.example.com"), ("one", "2¤", "https://only.example.com")], ("chain_id", "urls"), addr=False) + ")")
def scan_explorer_registry(spark, sf_dir):
    found = service.explorers(instances(spark, sf_dir, REGISTRY_KINDS, REGISTRY, "json string"), "host")
    return found.select("chain_id", F.array_join("urls", " ").alias("urls"))


SUPPORTED = (("two", '[{"chainId":1¤,"supported":true},{"chainId":2¤,"supported":false},{"chainId":3¤,"supported":true}]'), ("one", '[{"chainId":4¤,"supported":true}]'), ("none", "[]"), ("broken", "<html>"))


@query("SELECT DISTINCT chain_id::BIGINT AS chain_id FROM (" + expected(REGISTRY_KINDS, [("two", "1¤"), ("two", "3¤"), ("one", "4¤")], ("chain_id",), addr=False) + ")")
def scan_supported_chains(spark, sf_dir):
    return service.supported_chains(instances(spark, sf_dir, REGISTRY_KINDS, SUPPORTED, "json string"))


@query("""SELECT n_nationkey, rpad(n_name, 10, ' ') || ' | ' || rpad(CASE WHEN n_nationkey % 4 = 0 THEN 'n/a' ELSE n_nationkey::VARCHAR END, 6, ' ') || ' | ' || CASE WHEN n_regionkey % 2 = 0 THEN 'yes' ELSE 'no ' END AS line FROM nation""")
def report_probe_table(spark, sf_dir):
    """What chains answered, in columns of fixed width."""
    time = F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey"))
    line = service.fixed_width([(F.col("n_name"), 10), (time, 6), (F.when(F.col("n_regionkey") % 2 == 0, "yes").otherwise("no"), 3)])
    return table(spark, sf_dir, "nation").select("n_nationkey", line.alias("line"))


@query(PRELUDE + """, nodes AS (SELECT 'caller' AS side, from_addr AS name, count(*) AS calls FROM inbound GROUP BY from_addr
UNION ALL SELECT 'function', coalesce(selector, 'none'), count(*) FROM inbound GROUP BY selector UNION ALL SELECT 'destination', to_addr, count(*) FROM outbound GROUP BY to_addr)
SELECT side, name, calls, CASE side WHEN 'caller' THEN 0 WHEN 'function' THEN 1 ELSE 2 END AS x, (row_number() OVER (PARTITION BY side ORDER BY calls DESC, name) - 1) * 40 AS y FROM nodes""")
def view_function_graph(spark, sf_dir):
    """Where the nodes of a function graph stand."""
    found = trace.flagged(landed_frames(spark, sf_dir), IDENTITY)
    count = lambda rows, side, name: rows.groupBy(name.alias("name")).agg(F.count("*").alias("calls")).select(F.lit(side).alias("side"), "name", "calls")
    callers, functions = count(trace.inbound(found), "caller", F.col("from_addr")), count(trace.inbound(found), "function", F.coalesce("selector", F.lit("none")))
    return service.columns_layout(callers.unionByName(functions).unionByName(count(trace.outbound(found), "destination", F.col("to_addr"))))


@query(PRELUDE + """SELECT name, calls, round(100.0::DOUBLE * sin(2 * pi() * (n - 1) / m), 3) + 0.0 AS x, round(-100.0::DOUBLE * cos(2 * pi() * (n - 1) / m), 3) + 0.0 AS y FROM (
  SELECT to_addr AS name, count(*) AS calls, row_number() OVER (ORDER BY count(*) DESC, to_addr) AS n, count(*) OVER () AS m FROM outbound GROUP BY to_addr)""")
def view_contract_map(spark, sf_dir):
    """Where the contracts that the target calls stand round it."""
    return service.hub_layout(trace.rollup(trace.outbound(trace.flagged(frames(spark, sf_dir), IDENTITY)), "to_addr").select(F.col("address").alias("name"), "calls"))


@query(PRELUDE + """, pairs AS (SELECT DISTINCT destination_selector AS selector FROM edges_out WHERE destination_selector IS NOT NULL)
SELECT p.selector, coalesce(s.signature, o.signature) AS signature, CASE WHEN s.selector IS NOT NULL THEN 'registry' WHEN o.selector IS NOT NULL THEN 'database' ELSE 'unknown' END AS source
FROM pairs p LEFT JOIN signatures s ON s.selector = p.selector LEFT JOIN (SELECT '0x' || substr(md5('f5'), 1, 8) AS selector, 'late(uint256)' AS signature) o ON o.selector = p.selector""")
def sig_resolver(spark, sf_dir):
    """A resolver is any tables ``selector, signature`` in the order in which they are asked: what one knows, the next is not asked."""
    from framelark.sources.testtables import selector_of, signatures

    wanted = out_edges(spark, sf_dir).where("destination_selector is not null").select(F.col("destination_selector").alias("selector")).distinct()
    database = spark.range(1).select(selector_of(F.lit("f5")).alias("selector"), F.lit("late(uint256)").alias("signature"))
    return trace.first_known(wanted, "selector", "signature", {"registry": signatures(spark, sf_dir), "database": database})


@query(PRELUDE + """SELECT a AS addr, coalesce(o.label, l.label) AS label, CASE WHEN o.addr IS NOT NULL THEN 'own' WHEN l.addr IS NOT NULL THEN 'explorer' ELSE 'unknown' END AS source
FROM (SELECT DISTINCT from_addr AS a FROM frames) LEFT JOIN (SELECT 's' || s_suppkey AS addr, s_name AS label FROM supplier WHERE s_suppkey < 3) o ON o.addr = a LEFT JOIN labels l ON l.addr = a""")
def label_source(spark, sf_dir):
    """A label source is any tables ``addr, label`` in the order in which they are asked."""
    from framelark.sources.testtables import labels

    wanted = frames(spark, sf_dir).select(F.col("from_addr").alias("addr")).distinct()
    own = table(spark, sf_dir, "supplier").where("s_suppkey < 3").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("addr"), F.col("s_name").alias("label"))
    return trace.first_known(wanted, "addr", "label", {"own": own, "explorer": labels(spark, sf_dir).select("addr", "label")})


ENV_KINDS = ("plain", "quoted", "empty")
ENV = (("plain", "# a note\nRPC_URL=https://rpc¤.example.com/a?b=c\n  KEY = v¤ \n=none\nEMPTY=\nno line"), ("quoted", "A='x¤'\nB=\"y\"\n#C=z\nD=changeme\nE=your_key_here"), ("empty", ""))


@query(expected(ENV_KINDS, [("plain", "RPC_URL", "https://rpc¤.example.com/a?b=c"), ("plain", "KEY", "v¤"), ("quoted", "A", "x¤"), ("quoted", "B", "y"), ("quoted", "D", "changeme"), ("quoted", "E", "your_key_here")], ("name", "value")))
def scan_env_file(spark, sf_dir):
    return service.env_rows(instances(spark, sf_dir, ENV_KINDS, ENV, "text string"))


@query(expected(ENV_KINDS, [("plain", "RPC_URL", True), ("plain", "KEY", True), ("quoted", "A", True), ("quoted", "B", True), ("quoted", "D", False), ("quoted", "E", False)], ("name", "usable")))
def flt_placeholder(spark, sf_dir):
    """Which settings hold a value and not what documentation puts in its place."""
    from framelark.sources.settings import PLACEHOLDERS

    rows = service.env_rows(instances(spark, sf_dir, ENV_KINDS, ENV, "text string"))
    return rows.select("addr", "name", service.usable(F.col("value"), PLACEHOLDERS).isNotNull().alias("usable"))


SECRETS = (("plain", "RPC_URL=https://user:pass-word-¤@rpc.example.com/v1/team-token-¤?apikey=super-secret-¤"), ("quoted", "RPC_TEMPLATE='https://{chain}.example.com/{key}'\nRPC_KEY=key-of-¤"), ("empty", "RPC_URL=<url>"))


@query(expected(ENV_KINDS, [("plain", "https://user:pass-word-¤@rpc.example.com/v1/team-token-¤?apikey=super-secret-¤ super-secret-¤ team-token-¤ pass-word-¤"), ("quoted", "key-of-¤"), ("empty", "")], ("secrets",)))
def sort_secrets(spark, sf_dir):
    """What of the settings must not be shown, the longest first, so that no part of one survives when they are cut out in order."""
    from framelark.functions.udfs import vectorised
    from framelark.sources import settings

    found = vectorised("string")(lambda texts: texts.map(lambda t: " ".join(settings.secrets(settings.Settings(settings.env_lines(t))))))
    return instances(spark, sf_dir, ENV_KINDS, SECRETS, "text string").select("addr", found("text").alias("secrets"))
