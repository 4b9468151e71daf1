"""Queries of scalar functions, dimensions, landed documents, hashing, interfaces and bytecode, over tables of many contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelark.functions import abi, hashing, scalars
from framelark.operators import bytecode
from framelark.plans.keccaksql import keccak
from framelark.plans.registry import query
from framelark.sources import dimensions, wire
from framelark.sources.testcontracts import expected, instances, literal_sql
from framelark.sources.testtables import PRELUDE, frames, table


def values(rows, names):
    """SQL of literal rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal_sql, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def literal(spark, rows, schema):
    return spark.createDataFrame([tuple(r) for r in rows], schema)


# --- over tables ---------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN length(a) > 12 THEN substr(a, 1, 6) || '…' || substr(a, -4) ELSE a END AS short FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey ELSE '0x' || md5(c_name) END AS a FROM customer)""")
def fn_short_address(spark, sf_dir):
    a = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("0x"), F.md5("c_name")))
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.short_address(a).alias("short"))


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN 'SYM' END, ''), nullif(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END, ''), substr('0x' || md5(c_name), 1, 6) || '…' || substr(md5(c_name), -4)) AS label FROM customer""")
def fn_pick_label(spark, sf_dir):
    symbol = F.when(F.col("c_custkey") % 4 == 0, "").when(F.col("c_custkey") % 4 == 1, "SYM")
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.pick_label(F.concat(F.lit("0x"), F.md5("c_name")), symbol, name).alias("label"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 AND length(w) >= 42 THEN '0x' || lower(substr(w, -40)) END AS address FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '0x' || repeat('0', 64) WHEN o_orderkey % 5 = 1 THEN '0x12' ELSE '0x' || repeat('0', 24) || upper(md5(o_orderkey::VARCHAR)) || 'ABCDEF01' END AS w FROM orders)""")
def fn_word_address(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    word = F.when(k == 0, F.concat(F.lit("0x"), F.repeat(F.lit("0"), 64))).when(k == 1, "0x12").otherwise(F.concat(F.lit("0x"), F.repeat(F.lit("0"), 24), F.upper(F.md5(F.col("o_orderkey").cast("string"))), F.lit("ABCDEF01")))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.address_from_word(word).alias("address"))


@query("SELECT o_orderkey, (o_orderkey * 977)::BIGINT AS n FROM orders")
def fn_hex_int(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.hex_number(F.concat(F.lit("0x"), F.hex(F.col("o_orderkey") * 977))).alias("n"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS seconds FROM events")
def fn_unix_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.unix_seconds(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("seconds"))


@query("SELECT event_id, coalesce(CASE WHEN value > 50 THEN trunc(value)::BIGINT END, CASE WHEN user_id > 0 THEN user_id END)::BIGINT AS n FROM events WHERE value > 50 OR user_id > 0")
def fn_block_number(spark, sf_dir):
    found = table(spark, sf_dir, "events").where("value > 50 or user_id > 0")
    return found.select("event_id", scalars.first_positive(F.when(F.col("value") > 50, F.col("value").cast("string")), F.lit("none"), F.col("user_id").cast("string")).alias("n"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def fn_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query("SELECT doc_id, md5(CASE WHEN regexp_extract(text, '^([^.]*\\.)', 1) = '' THEN text ELSE regexp_extract(text, '^([^.]*\\.)', 1) END) AS first FROM documents")
def fn_first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(scalars.first_sentence(F.col("text"))).alias("first"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM pages""")
def fn_html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(scalars.html_escape(F.col("html"))).alias("escaped"))


@query("""SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) || CASE WHEN regexp_matches(p_name, '[.!?]$') THEN '' ELSE '.' END AS said FROM part""")
def fn_sentence(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.sentence(F.col("p_name")).alias("said"))


@query("""SELECT brand, CASE WHEN n = 1 THEN a[1] WHEN n > 3 THEN array_to_string(a[1:3], ', ') || ', and ' || (n - 3) || ' more' ELSE array_to_string(a[1:n - 1], ', ') || ' and ' || a[n] END AS listed
FROM (SELECT p_brand AS brand, list(DISTINCT p_type ORDER BY p_type) AS a, len(list(DISTINCT p_type)) AS n FROM part GROUP BY p_brand)""")
def fn_listed(spark, sf_dir):
    kinds = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_set("p_type")).alias("a"))
    return kinds.select("brand", scalars.listed(F.col("a"), 3).alias("listed"))


@query("""SELECT o_orderkey, CASE WHEN d >= 1 THEN printf('%.1f days', d) WHEN d * 24 >= 1 THEN printf('%.1f hours', d * 24) ELSE floor(d * 24 * 60 + 0.5)::BIGINT || ' minutes' END AS span FROM (SELECT o_orderkey, (o_orderkey % 1000) / 257.0::DOUBLE AS d FROM orders)""")
def fn_duration(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.duration((F.col("o_orderkey") % 1000) / F.lit(257.0)).alias("span"))


@query("""SELECT p_partkey, 'RPC_URL_' || regexp_replace(upper(p_type || ' ' || p_name), '[^A-Z0-9]', '_', 'g') AS var FROM part""")
def fn_env_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.env_name(F.concat_ws(" ", "p_type", "p_name")).alias("var"))


@query("SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 50 AS batch FROM part")
def fn_chunk(spark, sf_dir):
    """Batches of fifty over dense keys: the key is its own position, so nothing is sorted."""
    return table(spark, sf_dir, "part").select("p_partkey", scalars.chunk(F.col("p_partkey"), 50).alias("batch"))


@query(PRELUDE + "SELECT tx, list_reduce(list_prepend('', list(p ORDER BY path)), lambda a, b: a || ' ' || b) AS paths FROM frames GROUP BY tx")
def fn_path_order(spark, sf_dir):
    from framelark.operators.trace import path_text

    ordered = frames(spark, sf_dir).groupBy("tx").agg(F.array_sort(F.collect_list("path")).alias("a"))
    return ordered.select("tx", F.concat(F.lit(" "), F.array_join(F.transform("a", path_text), " ")).alias("paths"))


@query("""SELECT p_partkey, replace(replace(p_name, 'small', '***'), 'ring', '***') AS name FROM part""")
def str_scrub(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.scrub(F.col("p_name"), ["ring", "small", ""]).alias("name"))


TRANSIENT = "timeout|capacity|rate limit|try again"
UNSUPPORTED = "method not found|not supported|unsupported|does not exist|not available|not enabled|upgrade|disabled|unknown method|not whitelisted"
REFUSED = "http [45][0-9][0-9]|timed out|timeout|not json"


def said(text):
    """Messages made of conversations' turns, so that each kind occurs."""
    kinds = F.array(*map(F.lit, ("Request TIMEOUT, try again", "Method not found", "HTTP 503 answer", "answer is not JSON", "fine")))
    return F.concat(F.element_at(kinds, (F.col("turn") % 5 + 1).cast("int")), F.lit(" "), text)


SAID = "(SELECT conv_id, turn, lower(['Request TIMEOUT, try again', 'Method not found', 'HTTP 503 answer', 'answer is not JSON', 'fine'][turn % 5 + 1] || ' ' || text) AS m FROM conversations)"


@query(f"SELECT conv_id, turn FROM {SAID} WHERE regexp_matches(m, '{TRANSIENT}')")
def flt_transient(spark, sf_dir):
    """Messages of errors that a later attempt may not meet."""
    return table(spark, sf_dir, "conversations").where(F.lower(said(F.col("text"))).rlike(TRANSIENT)).select("conv_id", "turn")


@query(f"SELECT conv_id, turn FROM {SAID} WHERE regexp_matches(m, '{UNSUPPORTED}')")
def flt_unsupported(spark, sf_dir):
    """Messages of a provider that will never answer the method."""
    return table(spark, sf_dir, "conversations").where(F.lower(said(F.col("text"))).rlike(UNSUPPORTED)).select("conv_id", "turn")


@query(f"SELECT conv_id, turn FROM {SAID} WHERE regexp_matches(m, '{REFUSED}')")
def flt_refusals(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.lower(said(F.col("text"))).rlike(REFUSED)).select("conv_id", "turn")


@query("SELECT p_partkey FROM part WHERE length('0x' || repeat('6', p_partkey % 5)) > 4")
def flt_has_code(spark, sf_dir):
    code = F.concat(F.lit("0x"), F.expr("repeat('6', cast(p_partkey % 5 as int))"))
    return table(spark, sf_dir, "part").where(scalars.has_code(code)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')) AND p_size > 10")
def flt_ui(spark, sf_dir):
    text = F.contains(F.lower("p_name"), F.lit("ring")) | F.contains(F.lower("p_type"), F.lit("ring"))
    return table(spark, sf_dir, "part").where(text & (F.col("p_size") > 10)).select("p_partkey")


@query("SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_size % 2, p_name, p_partkey) AS place FROM part")
def sort_functions(spark, sf_dir):
    """State-changing first, then by name."""
    from pyspark.sql import Window

    order = Window.orderBy(F.col("p_size") % 2, "p_name", "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", F.row_number().over(order).cast("long").alias("place"))


ROLES = (("^(deposit|mint|supply|allocate|enter)", "deposit / asset movement"), ("^(withdraw|redeem|deallocate|exit)", "withdrawal"), ("^(set|update|configure|change|add|remove|revoke|grant)", "admin configuration"),
         ("^(pause|unpause|freeze|emergency)", "emergency"), ("^(upgrade|migrate)", "upgrade"), ("(role|permission|access|owner|guardian)", "access control"))
VERBS = ("deposit", "redeem", "setFee", "grant", "pause", "upgradeTo", "ownerOf", "poke")


@query("SELECT p_partkey, name, CASE WHEN p_size % 4 = 0 THEN 'view / accounting' " + " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{r}'" for p, r in ROLES)
       + " WHEN p_size % 4 = 1 THEN 'state mutation' WHEN p_size % 4 = 2 THEN 'external interaction' ELSE 'other' END AS role FROM (SELECT p_partkey, p_size, "
       + "[" + ", ".join(f"'{v}'" for v in VERBS) + "][p_partkey % 8 + 1] AS name FROM part)")
def sol_describe(spark, sf_dir):
    """Role of a function: a view is one, then its name says, then what it writes or calls."""
    name = F.element_at(F.array(*map(F.lit, VERBS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    role = F.when(F.col("p_size") % 4 == 0, "view / accounting")
    for pattern, text in ROLES:
        role = role.when(F.col("name").rlike(pattern), text)
    role = role.when(F.col("p_size") % 4 == 1, "state mutation").when(F.col("p_size") % 4 == 2, "external interaction").otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", name.alias("name")).select("p_partkey", "name", role.alias("role"))


# --- dimensions ----------------------------------------------------------------------------------------------------


@query(values(dimensions.CHAINS, ("id", "key", "label", "trace_filter", "block_time", "symbol")).replace("SELECT *", "SELECT id::BIGINT AS id, key, label, trace_filter, block_time::DOUBLE AS block_time, symbol"))
def dim_chains(spark, sf_dir):
    return dimensions.chains(spark)


@query(values(dimensions.DEPTHS, ("depth", "days", "slices", "txs", "frames", "stage_s", "runtime_s")))
def dim_depths(spark, sf_dir):
    return dimensions.depths(spark)


@query(f"SELECT n_name AS key, depth, greatest(1, floor(days * 86400 / bt + 0.5))::BIGINT AS span FROM (SELECT n_name, (n_nationkey + 1) / 4.0::DOUBLE AS bt FROM nation), ({values(dimensions.DEPTHS, ('depth', 'days', 'slices', 'txs', 'frames', 'stage_s', 'runtime_s'))})")
def math_span_blocks(spark, sf_dir):
    """Blocks of each depth's days on chains of many block times."""
    chains = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), ((F.col("n_nationkey") + 1) / F.lit(4.0)).alias("block_time"))
    pairs = chains.crossJoin(F.broadcast(dimensions.depths(spark)))  # three depths
    return pairs.select("key", "depth", scalars.span_blocks(F.col("days"), F.col("block_time")).alias("span"))


@query("SELECT n_name AS label, row_number() OVER (ORDER BY n_regionkey % 2 DESC, n_name) AS place FROM nation")
def sort_chains(spark, sf_dir):
    """Chains that can filter traces first, then by label."""
    from pyspark.sql import Window

    order = Window.orderBy((F.col("n_regionkey") % 2).desc(), "n_name")
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("label"), F.row_number().over(order).cast("long").alias("place"))


# --- hashing and interfaces ----------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {keccak('SELECT p_name || p_partkey AS k FROM part')} SELECT p_partkey, digest FROM part JOIN keccak ON k = p_name || p_partkey")
def fn_keccak(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.keccak256(F.concat("p_name", F.col("p_partkey").cast("string"))).alias("digest"))


MADE = "replace(p_name, ' ', '_') || p_partkey % 400 || '(uint256,' || lower(p_type) || '[' || p_size || '])'"


def made_signature():
    """A signature out of a part: a column, and ``MADE`` in SQL."""
    return F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), (F.col("p_partkey") % 400).cast("string"), F.lit("(uint256,"), F.lower("p_type"), F.lit("["), F.col("p_size").cast("string"), F.lit("])"))


@query(f"WITH RECURSIVE {keccak(f'SELECT {MADE} AS k FROM part')} SELECT p_partkey, substr(digest, 1, 10) AS selector FROM part JOIN keccak ON k = {MADE}")
def fn_selector(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.selector(made_signature()).alias("selector"))


@query(f"WITH RECURSIVE {keccak(f'SELECT {MADE} AS k FROM part')} SELECT p_partkey, digest AS topic FROM part JOIN keccak ON k = {MADE}")
def fn_topic0(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.topic0(made_signature()).alias("topic"))


ACCOUNTS = "SELECT c_custkey, md5(c_name) || substr(md5(c_custkey::VARCHAR), 1, 8) AS k FROM customer"


@query(f"""WITH RECURSIVE {keccak(f'SELECT k FROM ({ACCOUNTS})')}
SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'no address' ELSE '0x' || list_aggregate(list_transform(range(1, 41), lambda i: CASE WHEN substr(digest, i + 2, 1) >= '8' THEN upper(substr(k, i, 1)) ELSE substr(k, i, 1) END), 'string_agg', '') END AS checksum
FROM ({ACCOUNTS}) JOIN keccak USING (k)""")
def fn_checksum(spark, sf_dir):
    """Addresses in the mixed case that their digest asks for; what is no address stays."""
    account = F.concat(F.lit("0x"), F.md5("c_name"), F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 8))
    account = F.when(F.col("c_custkey") % 9 == 0, "no address").otherwise(account)
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.to_checksum(account).alias("checksum"))


TYPE_KINDS = ("nested", "plain", "list", "empty")
TYPES = (("nested", '{"type":"tuple[¤][]","components":[{"type":"address"},{"type":"tuple","components":[{"type":"uint256"},{"type":"bytes¤"}]}]}', "(address,(uint256,bytes¤))[¤][]"), ("plain", '{"type":"uint¤"}', "uint¤"),
         ("list", '{"type":"tuple[]","components":[]}', "()[]"), ("empty", "{}", ""))


@query(expected(TYPE_KINDS, [(k, t) for k, _, t in TYPES], ("kind",)))
def fn_canonical_type(spark, sf_dir):
    params = instances(spark, sf_dir, TYPE_KINDS, [t[:2] for t in TYPES], "param string")
    return params.select("addr", abi.canonical_type_of("param").alias("kind"))


SUPPLY = '{"type":"function","name":"supply¤","inputs":[{"type":"tuple","components":[{"type":"address"},{"type":"address"},{"type":"uint256"}]},{"type":"uint256[]"}]}'
ABI_KINDS = ("two", "one", "broken")
ABIS = (("two", 0, f'[{SUPPLY},{{"name":"no type"}},7]'), ("two", 1, f'[{{"type":"event","name":"Moved","inputs":[]}},{SUPPLY}]'), ("one", 3, '[{"type":"function","name":"f","inputs":[{"type":"int¤"}]}]'), ("broken", 0, "not json"))


@query(expected(ABI_KINDS, [("two", "function", "supply¤((address,address,uint256),uint256[])", 0), ("two", "event", "Moved()", 1), ("one", "function", "f(int¤)", 3)], ("type", "signature", "source")))
def set_merge_abi(spark, sf_dir):
    """Entries of two interfaces of one contract; the first source that has one counts."""
    return abi.merged(abi.parsed(instances(spark, sf_dir, ABI_KINDS, ABIS, "source int, abi string"))).select("addr", "type", "signature", "source")


@query(expected(ABI_KINDS, [("two", "function", "supply¤((address,address,uint256),uint256[])"), ("two", "event", "Moved()"), ("one", "function", "f(int¤)")], ("type", "signature")))
def fn_signature(spark, sf_dir):
    return abi.parsed(instances(spark, sf_dir, ABI_KINDS, ABIS, "source int, abi string")).select("addr", "type", "signature").distinct()


@query("SELECT p_partkey, CASE WHEN strpos(s, '(') > 1 THEN split_part(s, '(', 1) END AS name FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || '(x(y))' WHEN p_partkey % 3 = 1 THEN '(' || p_name ELSE p_name END AS s FROM part)")
def fn_sig_name(spark, sf_dir):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat("p_name", F.lit("(x(y))"))).when(k == 1, F.concat(F.lit("("), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.name_of_signature(text).alias("name"))


#: Two signatures of one published selector, and one of another.
COLLISIONS = (("0xa9059cbb", "workMyDirefulOwner(uint256,uint256)"), ("0xa9059cbb", "transfer(address,uint256)"), ("0xa9059cbb", "totallyUnrelated(uint256)"))
COLLIDING = values(COLLISIONS, ("selector", "signature"))


@query(f"""WITH RECURSIVE {keccak(f"SELECT {MADE} AS k FROM part UNION ALL SELECT 'x' || {MADE} FROM part UNION ALL SELECT signature FROM ({COLLIDING})")},
own AS (SELECT p_partkey, {MADE} AS s, substr(digest, 1, 10) AS selector FROM part JOIN keccak ON k = {MADE}),
candidates AS (
  SELECT CASE WHEN p_partkey % 5 = 0 THEN '0x' || substr(md5(s), 1, 8) ELSE selector END AS selector, s AS signature FROM own
  UNION ALL SELECT CASE WHEN p_partkey % 5 = 0 THEN '0x' || substr(md5(s), 1, 8) ELSE selector END, 'x' || s FROM own UNION ALL SELECT * FROM ({COLLIDING})),
good AS (SELECT DISTINCT selector, signature FROM candidates JOIN keccak ON k = signature WHERE substr(digest, 1, 10) = selector),
chosen AS (SELECT selector, list(signature ORDER BY length(signature), signature) AS a FROM good GROUP BY selector)
SELECT c.selector, a[1] AS chosen, coalesce(array_to_string(a[2:], ';'), '') AS alternatives FROM (SELECT DISTINCT selector FROM candidates) c LEFT JOIN chosen USING (selector)""")
def topk_signature(spark, sf_dir):
    """Signatures that a database claims for a selector, checked: some are of other functions, some selectors have none."""
    own = table(spark, sf_dir, "part").select("p_partkey", made_signature().alias("signature"))
    claimed = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("0x"), F.substring(F.md5("signature"), 1, 8))).otherwise(hashing.selector(F.col("signature")))
    own = own.select(claimed.alias("selector"), "signature")
    every = own.unionByName(own.select("selector", F.concat(F.lit("x"), "signature").alias("signature"))).unionByName(literal(spark, COLLISIONS, "selector string, signature string"))
    found = abi.verified(every)
    return found.select("selector", "chosen", F.array_join("alternatives", ";").alias("alternatives"))


HOLDER_KINDS = ("token", "vault", "owned", "almost")
HOLDERS = [("token", s) for s in abi.STANDARDS["ERC20"]] + [("vault", s) for s in (*abi.STANDARDS["ERC20"], *abi.STANDARDS["ERC4626"], "owner()")] + [("owned", s) for s in (*abi.STANDARDS["Ownable"], "f¤()")] + [("almost", s) for s in abi.STANDARDS["ERC20"][1:]]


@query(expected(HOLDER_KINDS, [("token", "ERC20"), ("vault", "ERC20"), ("vault", "ERC4626"), ("owned", "Ownable")], ("standard",)))
def standards_held(spark, sf_dir):
    """Standards all of whose functions a contract has, by selector."""
    holders = instances(spark, sf_dir, HOLDER_KINDS, HOLDERS, "signature string").select(F.col("addr").alias("holder"), hashing.selector(F.col("signature")).alias("member"))
    return abi.division(holders, abi.standards_table(spark)).withColumnRenamed("holder", "addr")


# --- bytecode ------------------------------------------------------------------------------------------------------

#: Code by kind: a scan's push is compared straight, after a shuffle, or by GT; as an error's or another push's operand it is no selector.
CODES = {
    "linear": "0x63a9059c¶14", "shuffled": "0x63a9059c¶8014", "search for": "0x6370a082¶11", "error": "0x639fabe1¶5260fd", "operand": "0x6163¶14",
    # stores 1 to slot 0, reads it back and jumps to a place that is no jump target
    "program": "0x6001600055600054600a576000600bfd5b00",
    # dispatch of one function at 0x11 that stores 5 to a slot and logs a topic
    "dispatch": "0x" + "60003560e01c" + "63a9059cbb" + "14" + "6011" + "57" + "0000" + "5b" + "600560¶55" + "7f" + "ab" * 31 + "¶" + "60006000a1" + "00",
    # two selectors: a search by GT at the start, XOR for 0x999999¶ (falls into 26 on a match), EQ for 0x111111¶ at 28 (jumps to 42)
    "search": "0x60003560e01c" + "8063500000¶11601c57" + "8063999999¶18602857" + "5b00" + "5b8063111111¶14602a57" + "fd" + "5bfd" + "5b00",
    "trailer": "0x60015ba1656970667358221220aa¶000c", "short": "0x00ff", "none": "0x", "odd": "0x6", "null": None,
}
DISPATCH_KINDS = ("dispatch", "program", "none", "null")
SCAN_KINDS = ("linear", "shuffled", "search for", "error", "operand", "none")
PROGRAM_KINDS = ("program", "none", "odd", "null")


def codes(spark, sf_dir, *kinds):
    """Landed code ``addr, code`` of contracts of some kinds."""
    return instances(spark, sf_dir, kinds, [(k, CODES[k]) for k in kinds], "code string")


program = lambda rows, names, **more: expected(PROGRAM_KINDS, [("program", *r) for r in rows], names, **more)


@query(expected(SCAN_KINDS, [("linear", "0xa9059c¶"), ("shuffled", "0xa9059c¶"), ("search for", "0x70a082¶")], ("selector",)))
def win_selector_scan(spark, sf_dir):
    return bytecode.dispatcher_selectors(bytecode.decoded(codes(spark, sf_dir, *SCAN_KINDS)))


@query(program([(0, "PUSH1", "01"), (2, "PUSH1", "00"), (4, "SSTORE", None), (5, "PUSH1", "00"), (7, "SLOAD", None), (8, "PUSH1", "0a"), (10, "JUMPI", None), (11, "PUSH1", "00"), (13, "PUSH1", "0b"), (15, "REVERT", None), (16, "JUMPDEST", None), (17, "STOP", None)], ("pc", "mnemonic", "operand")))
def bc_decode(spark, sf_dir):
    return bytecode.decoded(codes(spark, sf_dir, *PROGRAM_KINDS)).select("addr", "pc", "mnemonic", "operand")


@query(program([(0, 0, 10, 7, "JUMPI"), (1, 11, 15, 3, "REVERT"), (2, 16, 17, 2, "STOP")], ("block", "start", "end", "n", "last_op"), longs=("block", "n")))
def bc_blocks(spark, sf_dir):
    return bytecode.blocks(bytecode.decoded(codes(spark, sf_dir, *PROGRAM_KINDS))).select("addr", "block", "start", "end", "n", "last_op")


@query(expected(("program", "dispatch"), [("program", 4, "write", "0x0"), ("program", 7, "read", "0x0"), ("dispatch", 22, "write", "0x§")], ("pc", "access", "slot")))
def win_slot_before(spark, sf_dir):
    return bytecode.slots_before(bytecode.decoded(codes(spark, sf_dir, "program", "dispatch"))).select("addr", "pc", "access", "slot")


@query(expected(DISPATCH_KINDS, [("dispatch", False, True, False, False), ("program", True, True, False, False)], ("reads_storage", "writes_storage", "calls", "delegatecalls")))
def agg_code_facts(spark, sf_dir):
    return bytecode.code_facts(bytecode.decoded(codes(spark, sf_dir, *DISPATCH_KINDS))).select("addr", "reads_storage", "writes_storage", "calls", "delegatecalls")


@query(values(sorted(bytecode.NAMES.items()), ("op", "mnemonic")))
def bc_opcodes(spark, sf_dir):
    return dimensions.opcodes(spark)


TOPIC = "0x" + "ab" * 31 + "¶"


@query(expected(DISPATCH_KINDS, [("dispatch", "", "", "0x§", TOPIC, False), ("dispatch", "0xa9059cbb", "", "0x§", TOPIC, False), ("program", "", "0x0", "0x0", "", False), ("none", "", "", "", "", False), ("null", "", "", "", "", False)], ("selector", "reads", "writes", "topics", "truncated")))
def bc_facts(spark, sf_dir):
    found = bytecode.facts(codes(spark, sf_dir, *DISPATCH_KINDS))
    return found.select("addr", "selector", *(F.array_join(c, ",").alias(c) for c in ("reads", "writes", "topics")), "truncated")


# --- landed documents ----------------------------------------------------------------------------------------------

FLAT_KINDS = ("flat", "nested", "broken")
FLAT = (
    ("flat", '{"type":"call","action":{"from":"0xAA","to":"0xB·","callType":"delegatecall","input":"0xA9059CBB00"},"blockNumber":¤,"transactionHash":"0x°","traceAddress":[]}'),
    ("flat", '{"type":"create","action":{"from":"0xAA","init":"0x60"},"result":{"address":"0xCC"},"blockNumber":7,"transactionHash":"0x°","traceAddress":[0]}'),
    ("flat", '{"type":"suicide","action":{"address":"0xDD","refundAddress":"0xEE","balance":"0x1"},"error":"bad","blockNumber":7,"transactionHash":"0x°","traceAddress":[0,1]}'),
    ("nested", '{"type":"call","action":{"from":"0xAA","to":"0xBB","callType":"odd","input":"0x12"},"blockNumber":8,"transactionHash":"0x°","traceAddress":[]}'),
    ("broken", "<html>"),
)
FRAME = ("tx", "path", "call_type", "from_addr", "to_addr", "selector", "error")


@query(expected(FLAT_KINDS, [("flat", "0x°", "root", "delegatecall", "0xaa", "0xb·", "0xa9059cbb", None), ("flat", "0x°", "0", "create", "0xaa", "0xcc", None, None), ("flat", "0x°", "0,1", "selfdestruct", "0xdd", "0xee", None, "bad"),
                              ("nested", "0x°", "root", "call", "0xaa", "0xbb", None, None), ("broken", None, None, "call", "", None, None, None)], FRAME, addr=False))
def norm_flat_frame(spark, sf_dir):
    from framelark.operators.trace import path_text

    found = wire.flat_frames(instances(spark, sf_dir, FLAT_KINDS, FLAT, "json string").select("json"))
    return found.withColumn("path", path_text(F.col("path"))).select(*FRAME)


NESTED = (("nested", '{"type":"CALL","from":"0xAA","to":"0xB·","input":"0xa9059cbb","calls":[{"type":"STATICCALL","from":"0xbb","to":"0xcc"},{"type":"CREATE2","from":"0xbb","revertReason":"no","calls":[{"from":"0xdd","to":"0xEE","input":"0x70a08231ff"}]}]}'), ("broken", "<html>"))


@query(expected(FLAT_KINDS, [("nested", "0x°", "root", "call", "0xaa", "0xb·", "0xa9059cbb", None), ("nested", "0x°", "0", "staticcall", "0xbb", "0xcc", None, None), ("nested", "0x°", "1", "create", "0xbb", None, None, "no"), ("nested", "0x°", "1,0", "call", "0xdd", "0xee", "0x70a08231", None),
                              ("broken", "0x°", "root", "call", "", None, None, None)], FRAME, addr=False))
def norm_nested_frame(spark, sf_dir):
    from framelark.operators.trace import path_text

    found = wire.nested_frames(instances(spark, sf_dir, FLAT_KINDS, NESTED, "json string").withColumnRenamed("addr", "tx"))
    return found.withColumn("path", path_text(F.col("path"))).select(*FRAME)


#: Names of calls as providers write them, and what they are.
CALL_TYPES = (("CREATE2", "create"), ("suicide", "selfdestruct"), ("DelegateCall", "delegatecall"), ("odd", "call"), ("STATICCALL", "staticcall"), ("callcode", "callcode"), (None, "call"))


@query("SELECT o_orderkey, [" + ", ".join(f"'{t}'" for _, t in CALL_TYPES) + "][o_orderkey % 7 + 1] AS call_type FROM orders")
def norm_call_type(spark, sf_dir):
    raw = F.element_at(F.array(*(F.lit(r) for r, _ in CALL_TYPES)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.call_type(raw).alias("call_type"))


META_KINDS = ("proxy", "plain", "account", "broken")
CONTRACTS = (
    ("proxy", '{"is_verified":true,"name":"Proxy","proxy_type":"eip1967","file_path":"Proxy.sol","source_code":"contract Proxy¤ {}","additional_sources":[{"file_path":"Base.sol","source_code":"contract Base {}"},{"file_path":"x"}],"implementations":[{"address_hash":"0xb·","name":"V¤"},{"name":"lost"}]}'),
    ("plain", '{"is_verified":true,"name":"Plain¤","source_code":"contract Plain {}"}'), ("broken", "<html>"),
)
ADDRESSES = (("proxy", '{"is_contract":true,"token":{"name":"Token ¤","symbol":"T¤","decimals":"6"}}'), ("account", '{"is_contract":false,"name":"","ens_domain_name":"name¤.eth"}'), ("broken", "<html>"))


def metadata(spark, sf_dir):
    return wire.contract_metadata(instances(spark, sf_dir, META_KINDS, CONTRACTS, "json string"), instances(spark, sf_dir, META_KINDS, ADDRESSES, "json string"))


META_ROWS = [("proxy", True, "Proxy", "0xb·", "Proxy.sol,Base.sol", "T¤", 6, True), ("plain", True, "Plain¤", "", "Plain¤.sol", None, -1, True), ("account", False, None, "", "", None, -1, False), ("broken", False, None, "", "", None, -1, True)]


@query(expected(META_KINDS, META_ROWS, ("verified", "name", "implementations", "sources", "token", "decimals", "is_contract")))
def src_contract_metadata(spark, sf_dir):
    return metadata(spark, sf_dir).select("addr", "verified", "name", F.array_join("implementations.address", ",").alias("implementations"), F.array_join("sources.path", ",").alias("sources"), F.col("token_symbol").alias("token"), F.coalesce("token_decimals", F.lit(-1)).alias("decimals"), "is_contract")


WORD = "0x" + "0" * 24
PROXY_KINDS = ("slot", "beacon", "getter", "zero", "none")


@query(expected(PROXY_KINDS, [("slot", "0xb·", "eip1967-slot"), ("beacon", "0xd·", "beacon"), ("getter", "0xd·", "blockscout"), ("zero", None, "none"), ("none", None, "none")], ("implementation", "detected_by")))
def proxy_resolve(spark, sf_dir):
    """The first of five ways to an implementation that holds code: an explorer's word, three slots and a getter."""
    at = lambda rows, schema: instances(spark, sf_dir, PROXY_KINDS, rows, schema)
    who = lambda rows, column: at(rows, f"who string, {column} string").select(F.col("who").alias("addr"), column)
    slots = at([("slot", wire.SLOTS["eip1967-slot"], WORD + "b·"), ("slot", wire.SLOTS["eip1822-slot"], WORD + "d·"), ("beacon", wire.SLOTS["beacon"], WORD + "b·"), ("zero", wire.SLOTS["eip1967-slot"], WORD + "0" * 40)], "slot string, word string")
    answers = who([("beacon", "0xb·", WORD + "d·"), ("getter", "0x°", WORD + "d·"), ("zero", "0x°", "0x")], "word")
    code = who([("slot", "0xb·", "0x6001"), ("slot", "0xd·", "0x6002"), ("slot", "0xc·", "0x"), ("beacon", "0xd·", "0x6002"), ("getter", "0xd·", "0x6002")], "code")
    explorer = at([("slot", "0xC·")], "implementation string")
    targets = at([(k, 1) for k in PROXY_KINDS], "one int").select("addr")
    return wire.resolve_proxies(targets, explorer, slots, answers, code)


CASCADE_KINDS = ("second", "none", "first")


@query(expected(CASCADE_KINDS, [("second", "search"), ("first", "twin")], ("provenance",)))
def recover_cascade(spark, sf_dir):
    """The first candidate by rank that explains two thirds of the dispatcher."""
    tries = [("second", 0, "twin", 0.5), ("second", 1, "search", 0.7), ("second", 2, "sourcify", 1.0), ("none", 0, "twin", 0.6), ("first", 0, "twin", 1.0), ("first", 1, "search", 1.0)]
    rows = instances(spark, sf_dir, CASCADE_KINDS, tries, "rank int, provenance string, ratio double")
    return wire.recovered(rows.select("addr", "rank", "provenance"), rows.select("addr", "rank", "ratio"))


@query("SELECT 'p' || p_partkey AS addr, '0x' || md5(p_name) AS code FROM part WHERE p_partkey = 7")
def src_code_lookup(spark, sf_dir):
    """Point lookup by key: the filter reaches the scan."""
    return table(spark, sf_dir, "part").where("p_partkey = 7").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("addr"), F.concat(F.lit("0x"), F.md5("p_name")).alias("code"))


@query("SELECT s_suppkey AS addr, n_nationkey AS slot, n_name AS word FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 3")
def src_storage_lookup(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").where("s_suppkey = 3")
    return supplier.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("addr"), F.col("n_nationkey").alias("slot"), F.col("n_name").alias("word"))


@query("SELECT p_partkey, max(l_orderkey) AS answer FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49 GROUP BY p_partkey HAVING max(l_orderkey) IS NOT NULL")
def src_eth_call(spark, sf_dir):
    """Answers of read-only calls; a call without one is left out here."""
    answers = table(spark, sf_dir, "lineitem").where("l_quantity > 49").groupBy("l_partkey").agg(F.max("l_orderkey").alias("answer"))
    return table(spark, sf_dir, "part").select("p_partkey").join(answers, F.col("p_partkey") == F.col("l_partkey"), "left").where("answer is not null").select("p_partkey", "answer")


@query(PRELUDE + "SELECT to_json({'target_selector': target_selector, 'destination': destination, 'destination_selector': destination_selector, 'call_type': call_type, 'calls': calls, 'txs': txs, 'last_block': last_block, 'last_tx': last_tx})::VARCHAR AS json FROM edges_out")
def sink_result_json(spark, sf_dir):
    """Edges as JSON documents, as a sink takes them; what is missing is null."""
    from framelark.plans.tracequeries import out_edges

    return out_edges(spark, sf_dir).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
