"""Source analysis as tables: files of contracts in, functions with their accesses and calls out.

A contract's files are one group (compilers bound their size), parsed by Python once for all contracts of equal files; what follows are
joins and explodes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL = "function_name:string,signature:string,call_type:string,destination_kind:string,destination:string,address:string,contract_type:string,arguments:int,via:array<string>"
INNER = "name:string,kind:string,declared_in:string,depth:int,via:array<string>"
FUNCTIONS = (
    "addr string, ord int, name string, signature string, declared_in string, visibility string, mutability string, has_source boolean, access string, gates array<string>, reads array<string>, "
    f"writes array<string>, events array<string>, internal_calls array<struct<{INNER}>>, external_calls array<struct<{CALL}>>, notes array<string>, natspec string, line int, chain array<string>"
)


def functions(files: DataFrame, targets: DataFrame, language: str = "solidity") -> DataFrame:
    """The exposed functions of each contract: ``files(addr, path, content)`` and ``targets(addr, contract, abi array<string>)``.

    A contract without files gives its interface's functions, without source; one without either gives no rows. Contracts that are
    equal in files, name and interface are analysed once: only digests are dealt out to find them.
    """
    names = [c.split()[0] for c in FUNCTIONS.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        from framelark.source_code import solidity, vyper

        analyse = {"solidity": solidity, "vyper": vyper}[language].analyse
        first = rows.iloc[0]
        own = [(p, c) for p, c in sorted(zip(rows["path"], rows["content"]), key=lambda x: x[0] or "") if p is not None and c is not None]
        abi = [] if first["abi"] is None else list(first["abi"])
        found = analyse(own, first["contract"], abi) if own or abi else []
        return pd.DataFrame([r | {"addr": first["addr"], "ord": i} for i, r in enumerate(found)], columns=names)

    digests = files.groupBy("addr").agg(F.array_sort(F.collect_list(F.concat_ws(":", F.coalesce("path", F.lit("")), F.md5(F.coalesce("content", F.lit("")))))).alias("files"))
    keyed = targets.join(digests, "addr", "left").select("addr", F.md5(F.to_json(F.struct("contract", "abi", "files"))).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min("addr").alias("_first"))
    chosen = first.select(F.col("_first").alias("addr"))
    found = targets.join(chosen, "addr", "left_semi").join(files, "addr", "left").groupBy("addr").applyInPandas(run, FUNCTIONS)
    return keyed.join(first, "_key").join(found.withColumnRenamed("addr", "_first"), "_first").select(*names)


def accesses(found: DataFrame) -> DataFrame:
    """``addr, signature, variable, access``: one row for each variable that a function reads or writes."""
    reads = found.select("addr", "signature", F.explode("reads").alias("variable"), F.lit("read").alias("access"))
    return reads.unionByName(found.select("addr", "signature", F.explode("writes").alias("variable"), F.lit("write").alias("access")))


def external_calls(found: DataFrame) -> DataFrame:
    return found.select("addr", F.col("signature").alias("fn"), F.posexplode("external_calls").alias("site_ord", "c")).select("addr", "fn", "site_ord", "c.*")


def internal_calls(found: DataFrame) -> DataFrame:
    return found.select("addr", F.col("signature").alias("fn"), F.posexplode("internal_calls").alias("call_ord", "c")).select("addr", "fn", "call_ord", "c.*")


def reach(edges: DataFrame) -> DataFrame:
    """``addr, path, reaches``: transitive closure of ``edges(addr, path, target)``, each path itself included. One contract's imports are one group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        targets: dict[str, set] = {}
        for path, target in zip(rows["path"], rows["target"]):
            targets.setdefault(path, set()).add(target)
            targets.setdefault(target, set())
        out = []
        for start in targets:
            seen, left = {start}, [start]
            while left:
                new = targets[left.pop()] - seen
                seen |= new
                left.extend(new)
            out += [(rows["addr"].iloc[0], start, x) for x in seen]
        return pd.DataFrame(out, columns=["addr", "path", "reaches"])

    return edges.select("addr", "path", "target").groupBy("addr").applyInPandas(run, "addr string, path string, reaches string")


def linearised(bases: DataFrame) -> DataFrame:
    """``addr, unit, base, place``: bases depth first from left to right, each at its first visit; ``bases(addr, unit, ord, base)``, base null for a unit without any."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        below: dict[str, list] = {}
        for unit, _, base in sorted(zip(rows["unit"], rows["ord"], rows["base"]), key=lambda r: r[:2]):
            below.setdefault(unit, []).extend([base] if base is not None else [])
        out = []
        for unit in below:
            order, left = [], [unit]
            while left:
                one = left.pop()
                if one not in order:
                    order.append(one)
                    left.extend(reversed(below.get(one, [])))
            out += [(rows["addr"].iloc[0], unit, base, place) for place, base in enumerate(order)]
        return pd.DataFrame(out, columns=["addr", "unit", "base", "place"])

    return bases.select("addr", "unit", "ord", "base").groupBy("addr").applyInPandas(run, "addr string, unit string, base string, place int")


def execution_tree(found: DataFrame) -> DataFrame:
    """``addr, fn, path array<string>, kind, label``: the internal steps of a function by their chain, and its external calls as leaves.

    A step is known by its bare name; where one mention of it is qualified by a library, that is its label. No nested value
    is built: the path is the tree.
    """
    bare = lambda steps: F.transform(steps, lambda s: F.element_at(F.split(s, r"\."), -1))
    inner = internal_calls(found).select("addr", "fn", F.concat("via", F.array("name")).alias("steps"))
    via = external_calls(found).where(F.size("via") > 0).select("addr", "fn", F.col("via").alias("steps"))
    steps = inner.unionByName(via).select("addr", "fn", "steps", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("n"))
    steps = steps.select("addr", "fn", bare(F.slice("steps", 1, F.col("n"))).alias("path"), F.element_at("steps", F.col("n")).alias("step"))
    nodes = steps.groupBy("addr", "fn", "path").agg(F.max_by("step", F.struct(F.contains("step", F.lit(".")), "step")).alias("step"))
    nodes = nodes.select("addr", "fn", "path", F.lit("internal").alias("kind"), F.concat("step", F.lit("()")).alias("label"))
    label = F.concat(F.coalesce("contract_type", "destination", F.lit("unresolved destination")), F.lit("."), "function_name", F.lit("()"))
    kind = F.when(F.col("call_type") == "dynamic", "dynamic").otherwise("external")
    leaves = external_calls(found).select("addr", "fn", F.concat(bare(F.col("via")), F.array(F.concat(F.lit("#"), F.col("site_ord").cast("string")))).alias("path"), kind.alias("kind"), label.alias("label"))
    return nodes.unionByName(leaves)


#: What a contract is called by the first standard that it holds.
CLASSES = (
    ("ERC4626", "ERC4626 tokenised vault"), ("ERC7540 async", "asynchronous vault"), ("Uniswap V3 pool", "Uniswap V3 pool"), ("Uniswap V2 pair", "Uniswap V2 pair"), ("Aave V3 pool", "Aave V3 style lending pool"),
    ("Morpho Blue", "Morpho Blue market contract"), ("Gnosis Safe", "Gnosis Safe multisig"), ("Timelock", "timelock controller"), ("ERC721", "ERC721 collection"), ("ERC1155", "ERC1155 multi token"),
    ("ERC20", "ERC20 token"), ("Chainlink aggregator", "price feed"),
)


#: What is said of a contract beside its class.
OTHER, READ_ONLY = "contract with no matched standard", "read-only contract"
CLAUSES = {"admin": "with an admin role", "proxy": "behind a proxy", "unverified": "source not verified"}


def classified(contracts: DataFrame) -> DataFrame:
    """``addr, class`` of ``contracts(addr, standards array<string>, symbol, state_changing, is_proxy, verified)``."""
    holds = lambda s: F.array_contains("standards", s)
    kind = F.when(F.lit(False), "")
    for standard, text in CLASSES:
        kind = kind.when(holds(standard), text)
    kind = kind.otherwise(F.when(F.col("state_changing") == 0, READ_ONLY).otherwise(OTHER))
    symbol = F.nullif("symbol", F.lit(""))
    kind = F.when(symbol.isNotNull() & ~F.contains(kind, symbol), F.concat(kind, F.lit(" ("), symbol, F.lit(")"))).otherwise(kind)
    when = {"admin": holds("Ownable") | holds("AccessControl"), "proxy": F.col("is_proxy"), "unverified": ~F.col("verified")}
    parts = F.array(kind, *(F.when(when[k], text) for k, text in CLAUSES.items()))
    return contracts.select("addr", F.array_join(F.array_compact(parts), ", ").alias("class"))


def narrated(found: DataFrame) -> DataFrame:
    """``addr, signature, narrative``: what a function does, a sentence for each kind of evidence that there is."""
    from framelark.functions.scalars import listed

    names = lambda c, n: listed(F.slice(F.array_distinct(c), 1, n), 99)
    some = lambda c, *text: F.when(F.size(c) > 0, F.concat(*text))
    direct = F.transform(F.filter("internal_calls", lambda c: c["depth"] == 1), lambda c: F.concat(c["name"], F.lit("()")))
    calls = F.transform(F.slice("external_calls", 1, 6), lambda c: F.concat(F.lit("It can call "), F.coalesce(c["contract_type"], c["destination"], F.lit("unresolved destination")), F.lit("."), c["function_name"], F.lit("().")))
    events = F.transform("events", lambda e: F.substring_index(e, "(", 1))
    lines = F.concat(
        F.array(
            some(F.col("reads"), F.lit("The function reads "), names(F.col("reads"), 6), F.lit(" from storage.")),
            some(direct, F.lit("It runs the internal "), F.when(F.size(F.array_distinct(direct)) == 1, "function ").otherwise("functions "), names(direct, 6), F.lit(".")),
        ),
        calls,
        F.array(some(F.col("writes"), F.lit("It writes "), names(F.col("writes"), 6), F.lit(".")), some(events, F.lit("It emits "), names(events, 4), F.lit("."))),
    )
    return found.select("addr", "signature", F.array_join(F.array_compact(lines), " ").alias("narrative"))
