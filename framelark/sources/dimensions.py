"""Static dimensions: chains, depth budgets, opcodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelark.operators.bytecode import NAMES

#: Id, key, label, trace_filter, block time in seconds, native symbol.
CHAINS = (
    (1, "ethereum", "Ethereum", True, 12.0, "ETH"),
    (8453, "base", "Base", True, 2.0, "ETH"),
    (56, "bnb", "BNB Smart Chain", True, 0.45, "BNB"),
    (42161, "arbitrum", "Arbitrum One", False, 0.25, "ETH"),
    (137, "polygon", "Polygon", False, 1.5, "POL"),
    (10, "optimism", "Optimism", True, 2.0, "ETH"),
    (57073, "ink", "Ink", True, 1.0, "ETH"),
    (100, "gnosis", "Gnosis", True, 5.12, "xDAI"),
    (80094, "berachain", "Berachain", True, 2.0, "BERA"),
    (480, "worldchain", "World Chain", True, 2.0, "ETH"),
    (130, "unichain", "Unichain", True, 1.0, "ETH"),
    (59144, "linea", "Linea", True, 6.78, "ETH"),
    (42220, "celo", "Celo", True, 1.0, "CELO"),
    (146, "sonic", "Sonic", True, 1.56, "S"),
    (324, "zksync", "ZKsync Era", False, 6.52, "ETH"),
    (2020, "ronin", "Ronin", True, 2.0, "RON"),
    (534352, "scroll", "Scroll", False, 4.95, "ETH"),
    (1868, "soneium", "Soneium", True, 2.0, "ETH"),
    (7777777, "zora", "Zora", True, 2.0, "ETH"),
)
#: Depth, days, slices, traced transactions, frames, seconds of the trace stage, seconds of discovery and tracing.
DEPTHS = (("quick", 1, 4, 25, 4000, 60, 45), ("standard", 7, 10, 80, 12000, 120, 90), ("deep", 45, 24, 220, 30000, 240, 180))


def chains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHAINS), "id long, key string, label string, trace_filter boolean, block_time double, symbol string")


def depths(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEPTHS), "depth string, days int, slices int, txs int, frames int, stage_s int, runtime_s int")


def opcodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(NAMES.items()), "op int, mnemonic string")
