"""Interface descriptions (ABI): canonical types and signatures, verified signatures, merging, standards."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .udfs import vectorised

#: Standards and the functions all of which a contract of the standard has.
STANDARDS = {
    "ERC20": ("totalSupply()", "balanceOf(address)", "transfer(address,uint256)", "transferFrom(address,address,uint256)", "approve(address,uint256)", "allowance(address,address)"),
    "ERC20Permit": ("permit(address,address,uint256,uint256,uint8,bytes32,bytes32)", "nonces(address)"),
    "ERC4626": ("asset()", "totalAssets()", "convertToShares(uint256)", "convertToAssets(uint256)", "deposit(uint256,address)", "mint(uint256,address)", "withdraw(uint256,address,address)", "redeem(uint256,address,address)"),
    "ERC7540 async": ("requestDeposit(uint256,address,address)",),
    "ERC721": ("ownerOf(uint256)", "safeTransferFrom(address,address,uint256)", "setApprovalForAll(address,bool)", "getApproved(uint256)"),
    "ERC1155": ("balanceOfBatch(address[],uint256[])", "safeBatchTransferFrom(address,address,uint256[],uint256[],bytes)"),
    "Ownable": ("owner()", "transferOwnership(address)"),
    "Ownable2Step": ("pendingOwner()", "acceptOwnership()"),
    "AccessControl": ("hasRole(bytes32,address)", "grantRole(bytes32,address)", "revokeRole(bytes32,address)"),
    "UUPS upgradeable": ("upgradeToAndCall(address,bytes)", "proxiableUUID()"),
    "EIP-1967 admin": ("admin()", "implementation()", "upgradeTo(address)"),
    "Pausable": ("paused()",),
    "Multicall": ("multicall(bytes[])",),
    "ERC165": ("supportsInterface(bytes4)",),
    "Timelock": ("getMinDelay()", "schedule(address,uint256,bytes,bytes32,bytes32,uint256)"),
    "Gnosis Safe": ("getThreshold()", "getOwners()"),
    "Uniswap V3 pool": ("slot0()", "swap(address,bool,int256,uint160,bytes)"),
    "Uniswap V2 pair": ("getReserves()", "swap(uint256,uint256,address,bytes)"),
    "Aave V3 pool": ("supply(address,uint256,address,uint16)", "borrow(address,uint256,uint256,uint16,address)"),
    "Morpho Blue": ("supply((address,address,address,address,uint256),uint256,uint256,address,bytes)",),
    "Chainlink aggregator": ("latestRoundData()", "decimals()"),
}


def canonical_type(param: dict) -> str:
    """The type of a parameter; a tuple's are spelled out, its array suffix stays."""
    kind = param.get("type") or ""
    if not kind.startswith("tuple"):
        return kind
    return "(" + ",".join(map(canonical_type, param.get("components") or ())) + ")" + kind[len("tuple") :]


def signature(entry: dict) -> str:
    return f"{entry.get('name') or ''}({','.join(map(canonical_type, entry.get('inputs') or ()))})"


@vectorised("string")
def canonical_type_of(params: pd.Series) -> pd.Series:
    """Of a parameter as JSON: nesting has no bound, so its schema is no Spark type."""
    return params.map(lambda p: canonical_type(json.loads(p)), na_action="ignore")


@vectorised("array<struct<ord:int,type:string,name:string,signature:string,state_mutability:string>>")
def abi_entries(documents: pd.Series) -> pd.Series:
    """The usable entries of ABI documents: objects with a type that is text."""

    def parse(text):
        try:
            entries = json.loads(text) if text else []
        except ValueError:
            entries = []
        entries = entries if isinstance(entries, list) else []
        return [
            {"ord": i, "type": e["type"], "name": e.get("name"), "signature": signature(e), "state_mutability": e.get("stateMutability")}
            for i, e in enumerate(entries)
            if isinstance(e, dict) and isinstance(e.get("type"), str)
        ]

    return documents.map(parse)


def parsed(abis: DataFrame) -> DataFrame:
    """``addr, source, ord, type, name, signature, state_mutability`` from ``abis(addr, source, abi)``."""
    return abis.select("addr", "source", F.explode(abi_entries("abi")).alias("e")).select("addr", "source", "e.*")


def merged(entries: DataFrame) -> DataFrame:
    """One entry for each ``type:signature`` of an address, of the first source and place that has it."""
    order = Window.partitionBy("addr", "type", "signature").orderBy("source", "ord")
    return entries.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def verified(candidates: DataFrame) -> DataFrame:
    """``selector, chosen, alternatives`` from ``candidates(selector, signature)``: those that hash to it; the shortest, then the first by text."""
    good = candidates.distinct().where(hashing.selector(F.col("signature")) == F.col("selector"))
    ordered = F.array_sort(F.collect_list(F.struct(F.length("signature").alias("n"), F.col("signature").alias("s"))))
    found = good.groupBy("selector").agg(ordered.alias("all"))
    found = candidates.select("selector").distinct().join(found, "selector", "left")
    return found.select("selector", F.try_element_at(F.col("all.s"), F.lit(1)).alias("chosen"), F.coalesce(F.slice(F.col("all.s"), 2, 1 << 30), F.array().cast("array<string>")).alias("alternatives"))


def division(holders: DataFrame, standards: DataFrame) -> DataFrame:
    """``holder, standard``: standards whose ``(standard, member)`` rows are all among a holder's ``(holder, member)`` rows."""
    needed = standards.distinct()
    size = needed.groupBy("standard").agg(F.count("*").alias("_size"))
    got = holders.distinct().join(needed, "member").groupBy("holder", "standard").agg(F.count("*").alias("_got"))
    return got.join(size, "standard").where("_got = _size").select("holder", "standard")


def standards_table(spark) -> DataFrame:
    rows = [(name, s) for name, signatures in STANDARDS.items() for s in signatures]
    return spark.createDataFrame(rows, "standard string, signature string").withColumn("member", hashing.selector(F.col("signature"))).select("standard", "member")


def match_ratio(dispatcher: DataFrame, abi: DataFrame) -> DataFrame:
    """``addr, ratio``: share of a dispatcher's selectors ``(addr, selector)`` that the ABI has; addresses without any are absent."""
    known = abi.select("addr", "selector").distinct().withColumn("_k", F.lit(1))
    joined = dispatcher.distinct().join(known, ["addr", "selector"], "left")
    return joined.groupBy("addr").agg((F.count("_k") / F.count("*")).alias("ratio"))
