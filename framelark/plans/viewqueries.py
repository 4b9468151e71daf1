"""Queries of views, reports, landed documents and single steps of bytecode analysis and of name resolution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelark.functions import abi, scalars
from framelark.functions.udfs import vectorised
from framelark.landing import saved
from framelark.operators import bytecode, trace
from framelark.plans.discoveryqueries import SEGMENTS, SITES, planned, possible_observed
from framelark.plans.registry import query
from framelark.plans.scalarqueries import DISPATCH_KINDS, FLAT, FLAT_KINDS, META_KINDS, NESTED, codes, metadata
from framelark.plans.tracequeries import out_edges, shown
from framelark.source_code import vyper
from framelark.sources import wire
from framelark.sources.testcontracts import ADDRESS_SQL, expected, instances
from framelark.sources.testtables import IDENTITY, PRELUDE, frames, labels, landed_frames, signatures, table


def place(*order):
    return F.row_number().over(Window.orderBy(*order)).cast("long").alias("place")


# --- bytecode steps ------------------------------------------------------------------------------------------------

STEP_KINDS = ("search", "program", "none")


def step(spark, sf_dir, function, kinds=STEP_KINDS):
    """``addr, found``: a Python step over code, once for each distinct code."""
    column = vectorised("array<struct<found:string>>")(lambda c: c.map(lambda x: [{"found": function(x)}]))
    return bytecode.by_code(codes(spark, sf_dir, *kinds), column)


def blocks_of(code):
    return bytecode.basic_blocks(bytecode.decode(code))


@query(expected(STEP_KINDS, [("search", "0x500000¶ 11 False;0x999999¶ 18 True;0x111111¶ 14 False"), ("program", ""), ("none", "")], ("found",)))
def bc_comparison(spark, sf_dir):
    return step(spark, sf_dir, lambda code: ";".join(f"0x{c.selector:08x} {c.op:x} {c.inverted}" for b in blocks_of(code).values() if (c := bytecode.comparison(b))))


@query(expected(STEP_KINDS, [("search", "0x111111¶,0x999999¶"), ("program", ""), ("none", "")], ("found",)))
def bc_all_selectors(spark, sf_dir):
    return step(spark, sf_dir, lambda code: ",".join(bytecode.all_selectors(blocks_of(code))))


@query(expected(STEP_KINDS, [("search", "0"), ("program", "None"), ("none", "None")], ("found",)))
def bc_root(spark, sf_dir):
    return step(spark, sf_dir, lambda code: str(bytecode.dispatcher_root(blocks_of(code))))


@query(expected(STEP_KINDS, [("search", "0,28,42,39,16,40,26 False"), ("program", "0,11 False"), ("none", " False")], ("found",)))
def bc_traverse(spark, sf_dir):
    """Blocks from the start, and whether a cap cut the walk; a jump to a place that is no jump target leads nowhere."""

    def run(code):
        order, truncated = bytecode.traverse(blocks_of(code))
        return f"{','.join(map(str, order))} {truncated}"

    return step(spark, sf_dir, run)


@query(expected(STEP_KINDS, [("search", "(42, None) (26, None)"), ("program", ""), ("none", "")], ("found",)))
def bc_dispatch(spark, sf_dir):
    def run(code):
        return " ".join(str(bytecode.enter(bytecode.decode(code), int(s, 16))) for s in bytecode.all_selectors(blocks_of(code)))

    return step(spark, sf_dir, run)


TRAILERS = ("none", "trailer", "short", "null")


@query(expected(TRAILERS, [("none", 0), ("trailer", 14), ("short", 0), ("null", 0)], ("trailer",)))
def bc_trailer(spark, sf_dir):
    """Bytes of the compiler's metadata at the end of code: its length stands in the last two bytes, a small map begins it."""
    size, last = (F.length("code") - 2) / 2, F.conv(F.right("code", F.lit(4)), 16, 10).cast("int") + 2
    head = F.substr("code", (F.length("code") - last * 2 + 1).cast("int"), F.lit(2))
    found = (last > 2) & (last <= size) & head.isin("a1", "a2", "a3")
    return codes(spark, sf_dir, *TRAILERS).select("addr", F.when(F.coalesce(found, F.lit(False)), last).otherwise(0).alias("trailer"))


@query(expected(DISPATCH_KINDS, [("dispatch", 2, False), ("program", 1, False), ("none", 1, False), ("null", 1, False)], ("functions", "truncated"), longs=("functions",)))
def bc_analyze(spark, sf_dir):
    """How many parts of each contract have facts: the whole and each function."""
    found = bytecode.facts(codes(spark, sf_dir, *DISPATCH_KINDS))
    return found.groupBy("addr").agg(F.count("*").alias("functions"), F.bool_or("truncated").alias("truncated"))


@query(expected(DISPATCH_KINDS, [(k, f, "0x§" if (k, f) == ("dispatch", "put(uint256)") else "") for k in DISPATCH_KINDS for f in ("put(uint256)", "ghost()")], ("signature", "writes")))
def join_bytecode_facts(spark, sf_dir):
    """Facts of a function by its selector; one that the code does not name has the contract's, here of nothing."""
    rows = [(k, *f) for k in DISPATCH_KINDS for f in (("put(uint256)", "0xa9059cbb"), ("ghost()", "0x00000001"))]
    functions = instances(spark, sf_dir, DISPATCH_KINDS, rows, "signature string, selector string")
    facts = bytecode.facts(codes(spark, sf_dir, *DISPATCH_KINDS)).where("selector <> ''")
    return functions.join(facts, ["addr", "selector"], "left").select("addr", "signature", F.coalesce(F.array_join("writes", ","), F.lit("")).alias("writes"))


@query(expected(DISPATCH_KINDS, [("dispatch", "0x" + "ab" * 31 + "¶"), *((k, "") for k in DISPATCH_KINDS[1:])], ("found",)))
def win_log_topics(spark, sf_dir):
    return step(spark, sf_dir, lambda code: ",".join(bytecode.trailing_topics(bytecode.decode(code))), DISPATCH_KINDS)


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '0x' || lower(printf('%x', o_custkey)) WHEN 1 THEN '0x' || printf('%x', o_custkey * o_orderkey) ELSE '0x0' END AS word FROM orders""")
def fn_u256(spark, sf_dir):
    """256-bit words are text outside Python: sums and products are taken modulo 2^256."""

    @vectorised("string")
    def word(texts):
        def run(text):
            a, op, b = text.split()
            x, y = int(a, 16), int(b, 16)
            return hex((x + y if op == "+" else x * y) & bytecode.WORD)

        return texts.map(run)

    k = F.col("o_orderkey") % 3
    a = F.when(k == 0, F.repeat(F.lit("f"), 64)).when(k == 1, F.hex("o_custkey")).otherwise(F.concat(F.lit("8"), F.repeat(F.lit("0"), 63)))
    b = F.when(k == 0, F.hex(F.col("o_custkey") + 1)).when(k == 1, F.hex("o_orderkey")).otherwise(F.hex(F.col("o_custkey") * 2))
    text = F.concat_ws(" ", a, F.when(k == 0, "+").otherwise("*"), b)
    return table(spark, sf_dir, "orders").select("o_orderkey", word(text).alias("word"))


# --- text functions ------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN -1 ELSE length(t) - 1 END::INT AS "close" FROM (SELECT p_partkey, 'f(' || p_name || ',g(' || p_type || ',[c]))' AS t FROM part)""")
def fn_bracket(spark, sf_dir):
    text = F.concat(F.lit("f("), "p_name", F.lit(",g("), "p_type", F.lit(",[c]))"))
    text = F.when(F.col("p_partkey") % 3 == 1, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    close = vectorised("int")(lambda t: t.map(lambda x: vyper.matching(x, 1)))
    return table(spark, sf_dir, "part").select("p_partkey", close(text).alias("close"))


@query("""SELECT p_partkey, replace(p_name, ' ', '_') || ';g(' || p_type || ',c);''x,y'';[' || p_size || ',2]' AS parts FROM part""")
def fn_split_top(spark, sf_dir):
    text = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(",g("), "p_type", F.lit(",c),'x,y',["), F.col("p_size").cast("string"), F.lit(",2]"))
    return table(spark, sf_dir, "part").select("p_partkey", vectorised("string")(lambda t: t.map(lambda x: ";".join(vyper.arguments(x))))(text).alias("parts"))


@query("SELECT doc_id, len(string_split(substr(text, 1, greatest(length(text) // 2, 0)), chr(10)))::BIGINT AS line FROM documents")
def fn_line_of_offset(spark, sf_dir):
    """Line of the middle of each document: newlines before an offset, counted by Spark."""
    before = F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(before, "\n", -1)).cast("long").alias("line"))


@query("""WITH RECURSIVE words AS (SELECT o_orderkey, string_split(o_orderpriority || ' ' || o_orderstatus || ' ' || o_custkey || ' order of customer number ' || o_custkey || ' on ' || strftime(o_orderdate, '%Y-%m-%d'), ' ') AS ws FROM orders),
fill(o_orderkey, ws, i, line, done) AS (
  SELECT o_orderkey, ws, 1, '', []::VARCHAR[] FROM words
  UNION ALL
  SELECT o_orderkey, ws, i + 1, CASE WHEN line = '' THEN ws[i] WHEN length(line) + 1 + length(ws[i]) <= 24 THEN line || ' ' || ws[i] ELSE ws[i] END,
         CASE WHEN line = '' OR length(line) + 1 + length(ws[i]) <= 24 THEN done ELSE list_append(done, line) END
  FROM fill WHERE i <= len(ws))
SELECT o_orderkey, array_to_string(list_append(done, line), '|') AS lines FROM fill WHERE i = len(ws) + 1""")
def fn_wrap(spark, sf_dir):
    """Greedy word wrap to 24 columns."""

    @vectorised("string")
    def wrapped(texts):
        import textwrap

        return texts.map(lambda t: "|".join(textwrap.wrap(t, 24, break_long_words=False, break_on_hyphens=False)) if t else "")

    text = F.concat_ws(" ", "o_orderpriority", "o_orderstatus", "o_custkey", F.lit("order of customer number"), "o_custkey", F.lit("on"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").select("o_orderkey", wrapped(text).alias("lines"))


#: What providers call a match.
LEVELS = ("FULL", "partial", "exact_match", "odd", "PERFECT", "match", "full")


@query(f"""SELECT o_orderkey, CASE WHEN raw IN ('partial', 'match', 'PARTIAL') THEN 'match' WHEN raw IN ('FULL', 'PERFECT', 'full', 'exact_match') THEN 'exact_match' END AS level
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE [{', '.join(f"'{x}'" for x in LEVELS)}][o_orderkey % 7 + 1] END AS raw FROM orders)""")
def fn_match_level(spark, sf_dir):
    """The level by any of three fields, the first that is there."""
    k = F.col("o_orderkey")
    said = F.when(k % 11 != 0, F.element_at(F.array(*map(F.lit, LEVELS)), (k % 7 + 1).cast("int")))
    raw = F.coalesce(F.when(k % 3 == 0, said), F.when(k % 3 == 1, said), F.when(k % 3 == 2, said))
    level = F.when(raw.isin("PARTIAL", "partial", "match"), "match").when(raw.isin("FULL", "PERFECT", "full", "exact_match"), "exact_match")
    return table(spark, sf_dir, "orders").select("o_orderkey", level.alias("level"))


@query("SELECT n_nationkey, least(2000, greatest(25, floor(2000 * bt / 12 + 0.5)))::BIGINT AS slice FROM (SELECT n_nationkey, (n_nationkey + 1) / 4.0::DOUBLE AS bt FROM nation)")
def math_slice_size(spark, sf_dir):
    """First slices of chains of many block times."""
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.slice_size((F.col("n_nationkey") + 1) / F.lit(4.0)).alias("slice"))


@query("SELECT round((epoch(max(ts)) - epoch(min(ts))) / count(*), 2) AS block_time FROM events")
def math_block_time(spark, sf_dir):
    """Seconds a block: the span of the blocks' times over their number."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").agg(F.round((F.max(seconds) - F.min(seconds)) / F.count("*"), 2).alias("block_time"))


# --- landed documents ----------------------------------------------------------------------------------------------


@query(expected(META_KINDS, [("proxy", "Proxy.sol", "contract Proxy¤ {}"), ("proxy", "Base.sol", "contract Base {}"), ("plain", "Plain¤.sol", "contract Plain {}")], ("path", "content")))
def meta_source_files(spark, sf_dir):
    return metadata(spark, sf_dir).select("addr", F.explode("sources").alias("s")).select("addr", "s.path", "s.content")


@query(expected(META_KINDS, [("proxy", "0xb·", "V¤")], ("address", "name")))
def meta_implementations(spark, sf_dir):
    return metadata(spark, sf_dir).select("addr", F.explode("implementations").alias("i")).select("addr", "i.address", "i.name")


@query(expected(META_KINDS, [("proxy", "Token ¤", "T¤", 6)], ("name", "symbol", "decimals")))
def meta_token(spark, sf_dir):
    return metadata(spark, sf_dir).where("token_name is not null or token_symbol is not null").select("addr", F.col("token_name").alias("name"), F.col("token_symbol").alias("symbol"), F.col("token_decimals").alias("decimals"))


TWIN_KINDS = ("twin", "itself", "short", "none")


@query(expected(TWIN_KINDS, [("twin", "0xb·")], ("twin",)))
def meta_twin(spark, sf_dir):
    """A twin is another contract's whole address."""
    named = lambda a: '{"verified_twin_address_hash":"' + a + '"}'
    docs = instances(spark, sf_dir, TWIN_KINDS, [("twin", named("0xB·")), ("itself", named("0x°")), ("short", named("0x12")), ("none", "{}")], "json string")
    none = docs.limit(0)
    return wire.contract_metadata(docs, none).where("twin is not null").select("addr", "twin")


@query(expected(TWIN_KINDS, [("twin", "0xa"), ("twin", "0xb·"), ("twin", "0xc"), ("itself", "0x°")], ("address",)))
def meta_conflicting(spark, sf_dir):
    """A list that holds texts or records."""
    rows = [("twin", '{"conflicting_implementations":["0xa",{"address_hash":"0xb·"},{"address":"0xc"},7,null]}'), ("itself", '{"conflicting_implementations":["0x°"]}'), ("short", '{"conflicting_implementations":null}'), ("none", "no json")]
    docs = instances(spark, sf_dir, TWIN_KINDS, rows, "json string")
    listed = docs.select("addr", F.explode(F.try_variant_get(F.try_parse_json("json"), "$.conflicting_implementations", "array<variant>")).alias("v"))
    text = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
    return listed.select("addr", F.coalesce(text, F.try_variant_get("v", "$.address_hash", "string"), F.try_variant_get("v", "$.address", "string")).alias("address")).where("address is not null")


@query(expected(META_KINDS, [("proxy", True, "", "T¤"), ("account", False, "name¤.eth", None), ("broken", False, "", None)], ("is_contract", "ens", "symbol")))
def meta_address_summary(spark, sf_dir):
    from framelark.plans.scalarqueries import ADDRESSES

    a = instances(spark, sf_dir, META_KINDS, ADDRESSES, "json string").select("addr", F.from_json("json", wire.ADDRESS).alias("a"))
    return a.select("addr", F.coalesce("a.is_contract", F.lit(False)).alias("is_contract"), F.coalesce("a.ens_domain_name", F.lit("")).alias("ens"), F.nullif("a.token.symbol", F.lit("")).alias("symbol"))


FOUND_KINDS = ("whole", "part", "none", "broken")
SOURCIFY = (("whole", '{"runtimeMatch":"exact_match","sources":{"A.sol":{"content":"contract A¤ {}"},"B.sol":{"content":"contract B {}"}}}'), ("part", '{"runtimeMatch":"match","sources":{"C¤.sol":{"content":"x"}}}'),
            ("none", '{"runtimeMatch":null,"sources":{"C.sol":{"content":"x"}}}'), ("broken", "<html>"))


@query(expected(FOUND_KINDS, [("whole", "exact_match", "A.sol", "contract A¤ {}"), ("whole", "exact_match", "B.sol", "contract B {}"), ("part", "match", "C¤.sol", "x")], ("level", "path", "content")))
def recover_sourcify(spark, sf_dir):
    """Files of a matched contract; one without a runtime match gives none."""
    docs = instances(spark, sf_dir, FOUND_KINDS, SOURCIFY, "json string").select("addr", F.from_json("json", "runtimeMatch string, sources map<string,struct<content:string>>").alias("d"))
    return docs.where("d.runtimeMatch is not null").select("addr", F.col("d.runtimeMatch").alias("level"), F.explode("d.sources").alias("path", "s")).select("addr", "level", "path", "s.content")


SEARCHES = (("whole", '{"results":[{"match_type":"full","source_files":{"B¤.sol":"contract B {}"}}]}'), ("part", '{"sources":[{"matchType":"PARTIAL","sourceFiles":{"A¤.sol":"contract A {}"}},{"matchType":"FULL","sourceFiles":{"Z.sol":""}}]}'), ("none", "{}"), ("broken", "<html>"))


@query(expected(FOUND_KINDS, [("whole", "exact_match", "B¤.sol"), ("part", "match", "A¤.sol")], ("level", "path")))
def recover_bytecode_search(spark, sf_dir):
    """The first match of a search, by any of the names that its fields go by."""
    match = "array<struct<matchType:string,match_type:string,sourceFiles:map<string,string>,source_files:map<string,string>>>"
    d = instances(spark, sf_dir, FOUND_KINDS, SEARCHES, "json string").select("addr", F.from_json("json", f"sources {match}, results {match}").alias("d"))
    first = d.select("addr", F.try_element_at(F.coalesce("d.sources", "d.results"), F.lit(1)).alias("m")).where("m is not null")
    raw = F.lower(F.coalesce("m.matchType", "m.match_type"))
    level = F.when(raw.isin("partial", "match"), "match").when(raw.isin("full", "perfect", "exact_match"), "exact_match")
    return first.select("addr", level.alias("level"), F.explode(F.map_keys(F.coalesce("m.sourceFiles", "m.source_files"))).alias("path"))


@query(f"""SELECT {ADDRESS_SQL} AS addr, '0x' || lpad(printf('%x', p_partkey // {len(META_KINDS)} * {len(META_KINDS)}), 40, '0') AS twin, 'Proxy' AS name FROM part WHERE p_partkey % {len(META_KINDS)} = 2""")
def recover_twin(spark, sf_dir):
    """Metadata of a verified twin that has sources: accounts here name the proxy three keys before, others an account."""
    n, key = len(META_KINDS), F.col("p_partkey")
    at = lambda k: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(k)), 40, "0"))
    twin = F.when(key % n == 2, at((F.floor(key / n) * n).cast("long"))).otherwise(at((F.floor(key / n) * n).cast("long") + 2))
    wanted = table(spark, sf_dir, "part").select(at(key).alias("addr"), twin.alias("twin"))
    twins = metadata(spark, sf_dir).where(F.col("verified") & (F.size("sources") > 0)).select(F.col("addr").alias("t"), "name")
    return wanted.join(twins, F.col("twin") == F.col("t")).select("addr", "twin", "name")


REGISTRY_KINDS = ("three", "two", "one")
REGISTRY = (("three", "a¤()", "abi", 0), ("three", "b()", "abi", 1), ("three", "c()", "database", 0), ("two", "d()", "database", 0), ("two", "e¤()", "known", 0), ("one", "f¤()", "database", 0))


@query(expected(REGISTRY_KINDS, [("three", "a¤()", "abi", "b();c()"), ("two", "e¤()", "known", "d()"), ("one", "f¤()", "database", "")], ("signature", "source", "others")))
def sig_registry(spark, sf_dir):
    """One signature a selector: interfaces before known ones before a database's; the losers are listed."""
    rank = F.when(F.col("source") == "abi", 0).when(F.col("source") == "known", 1).otherwise(2)
    rows = instances(spark, sf_dir, REGISTRY_KINDS, REGISTRY, "signature string, source string, ord int").groupBy("addr").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "ord", "signature", "source"))).alias("a"))
    return rows.select("addr", F.col("a")[0]["signature"].alias("signature"), F.col("a")[0]["source"].alias("source"), F.array_join(F.slice(F.col("a.signature"), 2, 100), ";").alias("others"))


EVENTS = (("three", "Moved", "Moved(address)", "source"), ("three", "Moved", "Moved(uint256)", "abi"), ("three", "Only¤", "Only¤()", "abi"), ("two", "Moved", "Moved(uint256)", "abi"))


@query(expected(REGISTRY_KINDS, [("three", "Moved", "Moved(address)"), ("three", "Only¤", "Only¤()"), ("two", "Moved", "Moved(uint256)")], ("name", "signature")))
def set_merge_events(spark, sf_dir):
    """Source first, an interface fills gaps."""
    rows = instances(spark, sf_dir, REGISTRY_KINDS, EVENTS, "name string, signature string, source string")
    return rows.groupBy("addr", "name").agg(F.max_by("signature", "source").alias("signature"))


MODULES = (("three", "a.vy", 0, "x", "uint¤"), ("three", "b.vy", 1, "x", "address"), ("three", "b.vy", 1, "y¤", "bool"), ("one", "c¤.vy", 0, "z", "int128"))


@query(expected(REGISTRY_KINDS, [("three", "x", "uint¤", "a.vy"), ("three", "y¤", "bool", "b.vy"), ("one", "z", "int128", "c¤.vy")], ("name", "type", "file")))
def set_merge_modules(spark, sf_dir):
    rows = instances(spark, sf_dir, REGISTRY_KINDS, MODULES, "file string, ord int, name string, type string")
    return rows.groupBy("addr", "name").agg(F.min_by("type", "ord").alias("type"), F.min_by("file", "ord").alias("file"))


@query(expected(FOUND_KINDS, [("whole", 0, "function", "a¤()"), ("part", 1, "event", "Put(uint256)")], ("ord", "type", "signature")))
def flt_abi(spark, sf_dir):
    """Only objects with a type that is text are entries."""
    rows = [("whole", 0, '[{"type":"function","name":"a¤"},{"type":7},{"name":"b"},"x",null]'), ("part", 0, '[4,{"type":"event","name":"Put","inputs":[{"type":"uint256"}]}]'), ("none", 0, None), ("broken", 0, "{not json")]
    return abi.parsed(instances(spark, sf_dir, FOUND_KINDS, rows, "source int, abi string")).select("addr", "ord", "type", "signature")


NESTED_ROWS = [("nested", "root", "0xb·"), ("nested", "0", "0xcc"), ("nested", "1", None), ("nested", "1,0", "0xee"), ("broken", "root", None)]


@query(expected(FLAT_KINDS, NESTED_ROWS, ("path", "to_addr")))
def scan_tx_nested(spark, sf_dir):
    """Frames of nested traces, a tree for each transaction."""
    return shown(wire.nested_frames(instances(spark, sf_dir, FLAT_KINDS, NESTED, "json string").withColumnRenamed("addr", "tx"))).select(F.col("tx").alias("addr"), "path", "to_addr")


@query(expected(FLAT_KINDS, [("flat", "flat", 3), ("nested", "nested", 4), ("broken", "nested", 1)], ("method", "frames"), longs=("frames",)))
def norm_method_fallback(spark, sf_dir):
    """Flat traces where a provider gave them, nested ones for the transactions that lack them."""
    flat = wire.flat_frames(instances(spark, sf_dir, FLAT_KINDS, [r for r in FLAT if r[0] == "flat"], "json string").select("json")).select("tx", "path")
    both = [*NESTED, ("flat", NESTED[0][1])]
    nested = wire.nested_frames(instances(spark, sf_dir, FLAT_KINDS, both, "json string").withColumnRenamed("addr", "tx")).select("tx", "path")
    lacking = nested.join(flat.select("tx").distinct(), "tx", "left_anti").withColumn("method", F.lit("nested"))
    return flat.withColumn("method", F.lit("flat")).unionByName(lacking).groupBy(F.col("tx").alias("addr"), "method").agg(F.count("*").alias("frames"))


RESULTS = (("whole", '{"address":"0x°","statics":{"verified":true,"name":"Vault¤","functions":[{"signature":"a()"},{"signature":"b()"}]}}'), ("part", '{"address":"0x°","statics":{"verified":false,"functions":[]}}'), ("broken", "<html>"))


@query(expected(FOUND_KINDS, [("whole", "0x°", True, "Vault¤", 2), ("part", "0x°", False, None, 0)], ("address", "verified", "name", "functions")))
def src_result_json(spark, sf_dir):
    schema = "address string, statics struct<verified:boolean,name:string,functions:array<struct<signature:string>>>"
    docs = instances(spark, sf_dir, FOUND_KINDS, RESULTS, "json string").select("addr", F.from_json("json", schema).alias("r")).where("r.address is not null")
    return docs.select("addr", "r.address", "r.statics.verified", "r.statics.name", F.size("r.statics.functions").alias("functions"))


@query("SELECT o_orderkey AS tx, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey = 11")
def src_tx_header(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey = 11").select(F.col("o_orderkey").alias("tx"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query(PRELUDE + """SELECT to_json({'tx': tx, 'block': block, 'path': path, 'call_type': call_type, 'from_addr': from_addr, 'to_addr': to_addr, 'selector': selector, 'error': error})::VARCHAR AS json FROM frames WHERE block BETWEEN 1000 AND 1100""")
def sink_trace_json(spark, sf_dir):
    """Frames of a range of blocks as JSON lines, as a file sink takes them; what is missing is null."""
    found = frames(spark, sf_dir).where("block between 1000 and 1100").select("tx", "block", "path", "call_type", "from_addr", "to_addr", "selector", "error")
    return found.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


@query(PRELUDE + f""", {SEGMENTS} SELECT from_block, to_block, 0 AS traced, CASE slice_index % 3 WHEN 1 THEN 'no traces: the provider refused the method' ELSE 'no traces: the time for them was over' END AS note FROM segments WHERE slice_index % 3 > 0""")
def report_unavailable(spark, sf_dir):
    """Windows that were not read: typed, with their reason and no counts. Of three segments one is read, one refused and one too late here."""
    why = F.when(F.col("slice_index") % 3 == 1, "no traces: the provider refused the method").otherwise("no traces: the time for them was over")
    return planned(spark, sf_dir).where("slice_index % 3 > 0").select("from_block", "to_block", F.lit(0).alias("traced"), why.alias("note"))


# --- name resolution -----------------------------------------------------------------------------------------------

CHAIN_KINDS = ("three", "two")
CHAIN = (("three", "D¤", 0), ("three", "B", 1), ("three", "A", 2), ("two", "X", 0), ("two", "Y¤", 1))
MEMBERS = (("three", "A", "f"), ("three", "B", "f"), ("three", "A", "g"), ("three", "D¤", "h"), ("three", "B", "h"), ("two", "Y¤", "f"), ("two", "X", "g¤"))


def chain_members(spark, sf_dir):
    chain = instances(spark, sf_dir, CHAIN_KINDS, CHAIN, "unit string, chain_ord int")
    return chain.join(instances(spark, sf_dir, CHAIN_KINDS, MEMBERS, "unit string, name string"), ["addr", "unit"])


@query(expected(CHAIN_KINDS, [("three", "f", "B"), ("three", "g", "A"), ("three", "h", "D¤"), ("two", "f", "Y¤"), ("two", "g¤", "X")], ("name", "unit")))
def join_member_lookup(spark, sf_dir):
    """The first unit of the chain that declares a name."""
    return chain_members(spark, sf_dir).groupBy("addr", "name").agg(F.min_by("unit", "chain_ord").alias("unit"))


@query(expected(CHAIN_KINDS, [("three", "D¤", "f", "B"), ("three", "B", "f", "A"), ("three", "D¤", "h", "B"), ("three", "B", "g", "A"), ("three", "D¤", "g", "A"), ("two", "X", "f", "Y¤")], ("unit", "name", "super")))
def join_super(spark, sf_dir):
    """For each unit and name the next unit of the chain that declares it: an as-of join on the place in the chain."""
    m = chain_members(spark, sf_dir).select("addr", F.col("unit").alias("super"), "name", F.col("chain_ord").alias("o"))
    here = instances(spark, sf_dir, CHAIN_KINDS, CHAIN, "unit string, chain_ord int")
    return here.join(m, "addr").where("o > chain_ord").groupBy("addr", "unit", "name").agg(F.min_by("super", "o").alias("super"))


@query(expected(CHAIN_KINDS, [("three", "f", 2, "B"), ("three", "g", 1, "A"), ("three", "h", 2, "D¤"), ("two", "f", 1, "Y¤"), ("two", "g¤", 1, "X")], ("name", "declared", "declared_in"), longs=("declared",)))
def sol_members(spark, sf_dir):
    """A member table: base to derived, the derived declaration last, with how many there are."""
    return chain_members(spark, sf_dir).groupBy("addr", "name").agg(F.count("*").alias("declared"), F.max_by("unit", -F.col("chain_ord")).alias("declared_in"))


CANDIDATES = (("three", "Utils", "a.sol", 0), ("three", "Utils", "b.sol", 1), ("three", "Lone¤", "c.sol", 0), ("three", "Far", "d.sol", 0), ("three", "Far", "e¤.sol", 1), ("two", "Utils", "b.sol", 0), ("two", "Utils", "x.sol", 1))


@query(expected(CHAIN_KINDS, [("three", "Utils", "a.sol"), ("three", "Lone¤", "c.sol"), ("three", "Far", "e¤.sol"), ("two", "Utils", "x.sol")], ("name", "file")))
def join_name_resolution(spark, sf_dir):
    """Of units of one name the last that the calling file reaches, else the last declared."""
    reach = instances(spark, sf_dir, CHAIN_KINDS, [(k, f) for k in CHAIN_KINDS for f in ("a.sol", "x.sol")], "f string")
    rows = instances(spark, sf_dir, CHAIN_KINDS, CANDIDATES, "name string, file string, ord int")
    rows = rows.join(reach.select(F.col("addr").alias("_a"), "f"), (F.col("addr") == F.col("_a")) & (F.col("file") == F.col("f")), "left")
    return rows.groupBy("addr", "name").agg(F.max_by("file", F.struct(F.col("f").isNotNull(), "ord")).alias("file"))


USING = (("three", "Exact¤", "IERC20", 0), ("three", "Any", "*", 1), ("three", "Other", "uint256", 2), ("two", "Only", "uint256", 0))


@query(expected(CHAIN_KINDS, [("three", "IERC20", "Exact¤"), ("three", "bytes32", "Any"), ("three", "uint256", "Other"), ("two", "uint256", "Only")], ("type", "library")))
def join_using(spark, sf_dir):
    """The library of a type: named for it, else for all."""
    types = instances(spark, sf_dir, CHAIN_KINDS, [(k, t) for k in CHAIN_KINDS for t in ("IERC20", "bytes32", "uint256")], "type string")
    fits = types.join(instances(spark, sf_dir, CHAIN_KINDS, USING, "library string, for_type string, ord int"), "addr").where("for_type = type or for_type = '*'")
    return fits.groupBy("addr", "type").agg(F.min_by("library", F.struct(F.col("for_type") == "*", "ord")).alias("library"))


DECLARED = (("three", "f", 1, "f(Odd)"), ("three", "g", 1, "g(uint8)"), ("three", "h¤", 1, "h¤(address)"), ("two", "f", 2, "f(a,b)"))
OFFERED = (("three", "f", 1, "f(uint256)"), ("three", "h¤", 1, "h¤(address)"), ("three", "h¤", 1, "h¤(bytes32)"), ("three", "g", 2, "g(uint8,uint8)"), ("two", "f", 2, "f(int¤,int8)"))


@query(expected(CHAIN_KINDS, [("three", "f", "f(uint256)"), ("three", "g", None), ("three", "h¤", "h¤(address)"), ("two", "f", "f(int¤,int8)")], ("name", "matched")))
def join_abi_match(spark, sf_dir):
    """A source function with one interface function of its name and arity takes it; with several, the one of its own signature; else none."""
    source = instances(spark, sf_dir, CHAIN_KINDS, DECLARED, "name string, arity int, own string")
    entries = instances(spark, sf_dir, CHAIN_KINDS, OFFERED, "name string, arity int, signature string")
    found = source.join(entries, ["addr", "name", "arity"], "left").groupBy("addr", "name", "own").agg(F.collect_list("signature").alias("s"))
    return found.select("addr", "name", F.when(F.size("s") == 1, F.col("s")[0]).when(F.array_contains("s", F.col("own")), F.col("own")).alias("matched"))


ACCESSES = (("three", "x", 0, ["a", "b"]), ("three", "x", 1, ["c¤"]), ("three", "x", 2, ["d"]), ("three", "y", 3, []), ("two", "x", 0, ["a¤", "b"]))


@query(expected(CHAIN_KINDS, [("three", "x", "c¤"), ("three", "y", ""), ("two", "x", "a¤,b")], ("name", "via")))
def agg_collapse_access(spark, sf_dir):
    """The shortest way to a variable, the first of equally short ones."""
    rows = instances(spark, sf_dir, CHAIN_KINDS, ACCESSES, "name string, ord int, via array<string>")
    return rows.groupBy("addr", "name").agg(F.array_join(F.min_by("via", F.struct(F.size("via"), "ord")), ",").alias("via"))


UNITS = (("three", "A", 0, "f"), ("three", "B¤", 1, "f"), ("three", "B¤", 1, "g"), ("three", "C", 2, "f"), ("three", "C", 2, "g"), ("two", "A¤", 0, "h"), ("two", "B", 1, "f"))


@query(expected(CHAIN_KINDS, [("three", "B¤"), ("two", "B")], ("unit",)))
def agg_pick_unit(spark, sf_dir):
    """The unit with most functions of the interface, the first of equals; at least one."""
    units = instances(spark, sf_dir, CHAIN_KINDS, UNITS, "unit string, ord int, name string")
    interface = instances(spark, sf_dir, CHAIN_KINDS, [(k, n) for k in CHAIN_KINDS for n in ("f", "g")], "name string")
    scored = units.join(interface, ["addr", "name"]).groupBy("addr", "unit", "ord").agg(F.count("*").alias("n"))
    return scored.groupBy("addr").agg(F.max_by("unit", F.struct("n", -F.col("ord"))).alias("unit"))


DOC = [("three", n, t) for n, t in enumerate(["/// one ¤", "/// two", "", "function a()", "code", "/// three", "function b¤()"])] + [("two", 0, "/// four"), ("two", 1, "contract C¤")]


@query(expected(CHAIN_KINDS, [("three", "function a()", "/// one ¤ /// two"), ("three", "function b¤()", "/// three"), ("two", "contract C¤", "/// four")], ("target", "doc")))
def win_natspec_islands(spark, sf_dir):
    """Adjacent doc lines are one group, which belongs to the next line that is not blank: gaps and islands."""
    rows = instances(spark, sf_dir, CHAIN_KINDS, DOC, "line int, text string").where("text <> ''")
    order = Window.partitionBy("addr").orderBy("line")
    is_doc = F.startswith("text", F.lit("///"))
    rows = rows.withColumn("group", F.sum(F.when(~is_doc, 1).otherwise(0)).over(order) - F.when(~is_doc, 1).otherwise(0))
    lines = F.transform(F.array_sort(F.collect_list(F.when(is_doc, F.struct("line", "text")))), lambda s: s["text"])
    found = rows.groupBy("addr", "group").agg(F.max_by("text", "line").alias("target"), F.array_join(lines, " ").alias("doc"))
    return found.where("doc <> ''").select("addr", "target", "doc")


# --- views and reports ---------------------------------------------------------------------------------------------


@query(PRELUDE + """SELECT a AS address, coalesce(CASE WHEN a IN ('s0', 's1') THEN 'target' END, max(label)) AS label FROM (SELECT DISTINCT to_addr AS a FROM frames WHERE to_addr IS NOT NULL) LEFT JOIN labels ON addr = a GROUP BY a""")
def join_addr_constants(spark, sf_dir):
    """What an address constant is called: the target's own names come last and win."""
    known = frames(spark, sf_dir).where("to_addr is not null").select(F.col("to_addr").alias("address")).distinct()
    named = known.join(labels(spark, sf_dir), F.col("address") == F.col("addr"), "left").groupBy("address").agg(F.max("label").alias("label"))
    return named.select("address", F.when(F.col("address").isin(*IDENTITY), "target").otherwise(F.col("label")).alias("label"))


@query(PRELUDE + """SELECT line, n AS place FROM (
  SELECT 'in ' || from_addr || ' ' || coalesce(selector, 'none') || ' x' || frames AS line, row_number() OVER (ORDER BY s, frames DESC, from_addr, selector) AS n FROM (
    SELECT 0 AS s, from_addr, selector, count(*) AS frames FROM inbound WHERE tx IN ('0x0000000b', '0x00000016', '0x00000021') GROUP BY ALL
    UNION ALL SELECT 1, to_addr, selector, count(*) FROM walked WHERE from_in AND NOT to_in AND to_addr IS NOT NULL AND tx IN ('0x0000000b', '0x00000016', '0x00000021') GROUP BY ALL))""")
def report_explain_tx(spark, sf_dir):
    """What some transactions did at the target, callers first, each with its frames."""
    found = trace.flagged(frames(spark, sf_dir).where(F.col("tx").isin("0x0000000b", "0x00000016", "0x00000021")), IDENTITY)
    entered = trace.inbound(found).groupBy("from_addr", "selector").agg(F.count("*").alias("frames")).select(F.lit(0).alias("s"), F.col("from_addr").alias("a"), "selector", "frames")
    left = found.where("from_in and not to_in and to_addr is not null").groupBy("to_addr", "selector").agg(F.count("*").alias("frames")).select(F.lit(1).alias("s"), F.col("to_addr").alias("a"), "selector", "frames")
    line = F.concat(F.lit("in "), "a", F.lit(" "), F.coalesce("selector", F.lit("none")), F.lit(" x"), F.col("frames").cast("string"))
    return entered.unionByName(left).select(line.alias("line"), place("s", F.col("frames").desc(), "a", F.col("selector").asc_nulls_last()))


@query(PRELUDE + """SELECT section, line FROM (
  SELECT 'edges' AS section, destination || ' ' || calls AS line, row_number() OVER (ORDER BY calls DESC, destination, destination_selector NULLS LAST, target_selector NULLS LAST, call_type) AS n FROM edges_out) WHERE n <= 15
UNION ALL SELECT section, line FROM (SELECT 'contracts' AS section, to_addr || ' ' || count(*) AS line, row_number() OVER (ORDER BY count(*) DESC, to_addr) AS n FROM outbound GROUP BY to_addr) WHERE n <= 8""")
def report_smoke(spark, sf_dir):
    edges = out_edges(spark, sf_dir).orderBy(F.col("calls").desc(), "destination", F.col("destination_selector").asc_nulls_last(), F.col("target_selector").asc_nulls_last(), "call_type").limit(15)
    contracts = trace.rollup(trace.outbound(trace.flagged(frames(spark, sf_dir), IDENTITY)), "to_addr").orderBy(F.col("calls").desc(), "address").limit(8)
    line = lambda a: F.concat(a, F.lit(" "), F.col("calls").cast("string")).alias("line")
    return edges.select(F.lit("edges").alias("section"), line("destination")).unionByName(contracts.select(F.lit("contracts").alias("section"), line("address")))


@query(PRELUDE + "SELECT selector, signature, row_number() OVER (ORDER BY signature, selector) AS place FROM signatures")
def sort_derived(spark, sf_dir):
    return signatures(spark, sf_dir).select("selector", "signature", place("signature", "selector"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_name, p_partkey) AS place FROM part")
def sort_ui_table(spark, sf_dir, key: str = "p_size", descending: bool = True):
    """A table by one of its columns, either way; ties by name."""
    order = F.col(key).desc() if descending else F.col(key).asc()
    return table(spark, sf_dir, "part").select("p_partkey", place(order, "p_name", "p_partkey"))


@query(PRELUDE + """SELECT a AS address, tx FROM (SELECT a, tx, row_number() OVER (PARTITION BY a ORDER BY block DESC, tx) AS n FROM (SELECT DISTINCT to_addr AS a, tx, block FROM frames WHERE to_in)) WHERE n <= 75""")
def topk_explorer_cap(spark, sf_dir):
    """Three times the traced transactions, for each address of the target."""
    seen = trace.flagged(frames(spark, sf_dir), IDENTITY).where("to_in").select(F.col("to_addr").alias("address"), "tx", "block").distinct()
    return seen.withColumn("n", F.row_number().over(Window.partitionBy("address").orderBy(F.col("block").desc(), "tx"))).where("n <= 75").select("address", "tx")


@query("SELECT p_brand AS brand, array_to_string((list(p_name ORDER BY p_partkey))[1:6], ', ') AS names FROM part GROUP BY p_brand")
def topk_narrative(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("a"))
    return rows.select("brand", F.array_join(F.slice(F.col("a.p_name"), 1, 6), ", ").alias("names"))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) WHERE n <= 6")
def topk_warnings(spark, sf_dir):
    """The first six of each group."""
    order = Window.partitionBy("conv_id").orderBy("turn", "text")
    return table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(order)).where("n <= 6").select("conv_id", "turn")


@query(PRELUDE + f", {SITES} SELECT fn, coalesce(destination, 'unresolved destination') AS label, count(*) AS n FROM merged GROUP BY ALL")
def text_dest_label(spark, sf_dir):
    label = F.coalesce("destination", F.lit("unresolved destination"))
    return possible_observed(spark, sf_dir).groupBy("fn", label.alias("label")).agg(F.count("*").alias("n"))


@query(expected(DISPATCH_KINDS, [("dispatch", "The code writes storage."), ("program", "The code reads storage, writes storage.")], ("said",)))
def text_facts(spark, sf_dir):
    """Which effects the opcodes show; nothing is said of those that are not there."""
    found = bytecode.code_facts(bytecode.decoded(codes(spark, sf_dir, *DISPATCH_KINDS)))
    texts = {"reads_storage": "reads storage", "writes_storage": "writes storage", "calls": "calls", "staticcalls": "calls without change", "delegatecalls": "runs others' code", "creates": "creates contracts", "selfdestructs": "can destroy itself"}
    seen = F.array_compact(F.array(*(F.when(F.col(c), t) for c, t in texts.items())))
    return found.select("addr", F.concat(F.lit("The code "), F.array_join(seen, ", "), F.lit(".")).alias("said"))


@query("""SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || '(' || p_type || ')' ELSE p_name || '()' END AS label FROM part""")
def text_graph_label(spark, sf_dir):
    """A signature where a name is overloaded, else the name."""
    parts = table(spark, sf_dir, "part")
    shared = parts.groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1").select(F.col("p_name").alias("_n"))
    joined_parts = parts.join(shared, F.col("p_name") == F.col("_n"), "left")
    return joined_parts.select("p_partkey", F.when(F.col("_n").isNotNull(), F.concat("p_name", F.lit("("), "p_type", F.lit(")"))).otherwise(F.concat("p_name", F.lit("()"))).alias("label"))


@query(PRELUDE + """, top AS (SELECT to_addr AS a, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, to_addr) AS r FROM outbound GROUP BY to_addr)
SELECT 'In the traced window it calls ' || array_to_string((list(a || ' (' || n || ' calls)' ORDER BY r))[1:2], ', ') || ' and ' || (list(a || ' (' || n || ' calls)' ORDER BY r))[3] || '.' AS summary FROM top WHERE r <= 3""")
def text_summary(spark, sf_dir):
    top = trace.rollup(trace.outbound(trace.flagged(frames(spark, sf_dir), IDENTITY)), "to_addr").orderBy(F.col("calls").desc(), "address").limit(3)
    said = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("calls")).alias("o"), "address", "calls"))), lambda c: F.concat(c["address"], F.lit(" ("), c["calls"].cast("string"), F.lit(" calls)")))
    return top.agg(F.concat(F.lit("In the traced window it calls "), scalars.listed(said), F.lit(".")).alias("summary"))


@query(PRELUDE + """SELECT 'outbound' AS "table", count(*) AS rows, sum(calls)::BIGINT AS calls FROM edges_out
UNION ALL SELECT 'delegatecalls', count(*), sum(calls)::BIGINT FROM edges_delegated
UNION ALL SELECT 'inbound', count(*), sum(calls)::BIGINT FROM edges_in
UNION ALL SELECT 'entries', count(*), sum(n)::BIGINT FROM (SELECT selector, count(*) AS n FROM inbound GROUP BY selector)
UNION ALL SELECT 'contracts', count(*), sum(n)::BIGINT FROM (SELECT to_addr, count(*) AS n FROM outbound GROUP BY to_addr UNION ALL SELECT from_addr, count(*) FROM inbound GROUP BY from_addr)
UNION ALL SELECT 'unresolved', count(*), NULL FROM (SELECT target_selector AS s FROM edges_out UNION SELECT destination_selector FROM edges_out UNION SELECT target_selector FROM edges_in UNION SELECT caller_selector FROM edges_in) WHERE s IS NOT NULL AND s NOT IN (SELECT selector FROM signatures)""")
def flagship(spark, sf_dir):
    """The whole analysis of the target; here how many rows each of its tables has, and the calls that they count."""
    from framelark.plans.analysis import analyse

    tables = analyse(landed_frames(spark, sf_dir), IDENTITY, saved(signatures(spark, sf_dir), "signatures"), saved(labels(spark, sf_dir), "labels"))
    found = None
    for name, one in tables.items():
        calls = F.sum("calls") if "calls" in one.columns else F.lit(None).cast("long")
        count = one.agg(F.count("*").alias("rows"), calls.alias("calls")).select(F.lit(name).alias("table"), "rows", "calls")
        found = count if found is None else found.unionByName(count)
    return found
