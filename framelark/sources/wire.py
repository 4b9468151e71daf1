"""Landed provider answers: flat traces and nested call trees as JSON, to the frames table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.functions.scalars import call_type, selector_of_input

#: Schema of a flat trace; absent fields are null.
FLAT = (
    "type string, error string, blockNumber long, transactionHash string, transactionPosition int, subtraces int, traceAddress array<int>, "
    "action struct<from:string,to:string,callType:string,input:string,value:string,init:string,address:string,refundAddress:string,balance:string>, "
    "result struct<address:string,gasUsed:string,output:string>"
)


def flat_frames(texts: DataFrame) -> DataFrame:
    """Frames of ``texts(json)``, one flat trace each; a text that is no JSON gives a frame without ends."""
    t = texts.select(F.from_json("json", FLAT).alias("t")).select("t.*")
    kind = F.when(F.col("type") == "call", call_type(F.col("action.callType"))).otherwise(call_type(F.col("type")))
    data = F.coalesce("action.input", "action.init", F.lit("0x"))
    return t.select(
        F.col("transactionHash").alias("tx"), F.col("blockNumber").alias("block"), F.col("traceAddress").alias("path"), kind.alias("call_type"),
        F.lower(F.coalesce("action.from", "action.address", F.lit(""))).alias("from_addr"),
        F.lower(F.coalesce("action.to", "result.address", "action.refundAddress")).alias("to_addr"),
        data.alias("input"), selector_of_input(data).alias("selector"), F.coalesce("action.value", F.lit("0x0")).alias("value"), "error",
    )


def nested_frames(texts: DataFrame, levels: int = 1024) -> DataFrame:
    """Frames of ``texts(tx, json)``, one nested call tree each: a recursive query takes the calls of each level off the tree.

    ``levels`` bounds the depth, which the machine itself bounds at 1024; LIMIT ALL lifts the bound that Spark else sets on the rows of
    a recursion, 1,000,000 over all texts. A text that is no JSON gives a root without ends, and so does one that nests deeper than the
    1000 that Spark parses: a tree of more than 500 frames one below another.
    """
    spark = texts.sparkSession
    name = f"nested_{abs(hash(texts.semanticHash()))}"
    texts.createOrReplaceTempView(name)
    tree = spark.sql(f"""
        WITH RECURSIVE tree(tx, path, node) MAX RECURSION LEVEL {levels} AS (
          SELECT tx, CAST(array() AS array<int>), try_parse_json(json) FROM {name}
          UNION ALL
          SELECT tree.tx, concat(tree.path, array(e.pos)), e.value FROM tree, LATERAL variant_explode(variant_get(tree.node, '$.calls', 'variant')) AS e
        )
        SELECT tx, path, try_variant_get(node, '$.from', 'string') AS f, try_variant_get(node, '$.to', 'string') AS t, try_variant_get(node, '$.input', 'string') AS i,
               try_variant_get(node, '$.type', 'string') AS k, try_variant_get(node, '$.value', 'string') AS v,
               coalesce(try_variant_get(node, '$.error', 'string'), try_variant_get(node, '$.revertReason', 'string')) AS error
        FROM tree LIMIT ALL""")
    spark.catalog.dropTempView(name)
    data = F.coalesce("i", F.lit("0x"))
    return tree.select(
        "tx", "path", call_type(F.col("k")).alias("call_type"), F.lower(F.coalesce("f", F.lit(""))).alias("from_addr"), F.lower("t").alias("to_addr"),
        data.alias("input"), selector_of_input(data).alias("selector"), F.coalesce("v", F.lit("0x0")).alias("value"), "error",
    )


#: Schema of an explorer's contract document, and of its address document.
CONTRACT = (
    "is_verified boolean, name string, proxy_type string, compiler_version string, language string, file_path string, source_code string, "
    "additional_sources array<struct<file_path:string,source_code:string>>, implementations array<struct<address_hash:string,address:string,name:string>>, "
    "verified_twin_address_hash string"
)
ADDRESS = "is_contract boolean, is_verified boolean, is_scam boolean, name string, ens_domain_name string, proxy_type string, token struct<name:string,symbol:string,decimals:string>"


def contract_metadata(contracts: DataFrame, addresses: DataFrame) -> DataFrame:
    """``addr, verified, name, proxy_type, implementations, sources, token_*`` of landed ``(addr, json)`` documents; either may be missing."""
    c = contracts.select(F.col("addr").alias("_c"), F.from_json("json", CONTRACT).alias("c"))
    a = addresses.select(F.col("addr").alias("_a"), F.from_json("json", ADDRESS).alias("a"))
    both = c.join(a, F.col("_c") == F.col("_a"), "full_outer")
    none = F.array().cast("array<struct<path:string,content:string>>")
    main = F.when(F.nullif("c.source_code", F.lit("")).isNotNull(), F.array(F.struct(F.coalesce("c.file_path", F.concat(F.coalesce("c.name", F.lit("Contract")), F.lit(".sol"))).alias("path"), F.col("c.source_code").alias("content"))))
    more = F.transform(F.filter("c.additional_sources", lambda s: s["file_path"].isNotNull() & s["source_code"].isNotNull()), lambda s: F.struct(s["file_path"].alias("path"), s["source_code"].alias("content")))
    implementations = F.filter(F.transform("c.implementations", lambda i: F.struct(F.coalesce(i["address_hash"], i["address"]).alias("address"), i["name"].alias("name"))), lambda i: i["address"].isNotNull())
    twin = F.lower("c.verified_twin_address_hash")
    return both.select(
        F.coalesce("_c", "_a").alias("addr"), F.coalesce("c.is_verified", F.lit(False)).alias("verified"), F.nullif("c.name", F.lit("")).alias("name"), F.col("c.proxy_type").alias("proxy_type"),
        F.coalesce(implementations, F.array().cast("array<struct<address:string,name:string>>")).alias("implementations"),
        F.concat(F.coalesce(main, none), F.coalesce(more, none)).alias("sources"),
        F.nullif("a.token.name", F.lit("")).alias("token_name"), F.nullif("a.token.symbol", F.lit("")).alias("token_symbol"),
        F.when(F.nullif("a.token.name", F.lit("")).isNotNull() | F.nullif("a.token.symbol", F.lit("")).isNotNull(), F.col("a.token.decimals").try_cast("int")).alias("token_decimals"),
        F.coalesce("a.is_contract", F.col("_c").isNotNull()).alias("is_contract"),
        F.when(twin.rlike("^0x[0-9a-f]{40}$") & (twin != F.lower(F.coalesce("_c", "_a"))), twin).alias("twin"),
    )


#: Storage slots of proxies, by how they are named.
SLOTS = {
    "eip1967-slot": "0x360894a13ba1a3210667c828492db98dca3e2076cc3735a920a3ca505d382bbc",
    "eip1822-slot": "0xc5f16f0fcc639fa48a6947836d9850f504798523bf8c9a3a87d5876cf622bcf7",
    "beacon": "0xa3f0ad74e5423aebfd80d3ef4346578335a9a72aeaee59ff6cb3582b35133d50",
}


def resolve_proxies(targets: DataFrame, implementations: DataFrame, slots: DataFrame, answers: DataFrame, codes: DataFrame) -> DataFrame:
    """``addr, implementation, detected_by`` of ``targets(addr)``: the first of all candidates, by rank, that holds code.

    implementations ``(addr, implementation)`` of an explorer, slots ``(addr, slot, word)``, answers ``(addr, word)`` to
    implementation(), codes ``(addr, code)``. Five ways are one union, so each table is read once.
    """
    from framelark.functions.scalars import address_from_word, has_code

    word = address_from_word(F.col("word"))
    slot = lambda name: slots.where(F.col("slot") == SLOTS[name])
    explorer = implementations.select("addr", F.lower("implementation").alias("c"), F.lit(0).alias("rank"), F.lit("blockscout").alias("by"))
    stored = slot("eip1967-slot").select("addr", word.alias("c"), F.lit(1).alias("rank"), F.lit("eip1967-slot").alias("by"))
    proxiable = slot("eip1822-slot").select("addr", word.alias("c"), F.lit(2).alias("rank"), F.lit("eip1822-slot").alias("by"))
    beacons = slot("beacon").select(F.col("addr").alias("target"), word.alias("beacon")).join(answers, F.col("beacon") == F.col("addr"))
    beacon = beacons.select(F.col("target").alias("addr"), word.alias("c"), F.lit(3).alias("rank"), F.lit("beacon").alias("by"))
    getter = answers.select("addr", word.alias("c"), F.lit(4).alias("rank"), F.lit("blockscout").alias("by")).where("c <> addr")
    every = explorer.unionByName(stored).unionByName(proxiable).unionByName(beacon).unionByName(getter)
    live = every.join(codes.where(has_code(F.col("code"))).select(F.col("addr").alias("_x")), F.col("c") == F.col("_x"), "left_semi")
    best = live.groupBy("addr").agg(F.min(F.struct("rank", "c", "by")).alias("b"))
    return targets.join(best, "addr", "left").select("addr", F.col("b.c").alias("implementation"), F.coalesce("b.by", F.lit("none")).alias("detected_by"))


def recovered(candidates: DataFrame, ratios: DataFrame, least: float = 2 / 3) -> DataFrame:
    """``addr, provenance`` of the first candidate ``(addr, rank, provenance)`` whose interface explains enough of the dispatcher: ``ratios(addr, rank, ratio)``."""
    good = candidates.join(ratios.where(F.col("ratio") >= least), ["addr", "rank"])
    return good.groupBy("addr").agg(F.min(F.struct("rank", "provenance")).alias("b")).select("addr", F.col("b.provenance").alias("provenance"))
