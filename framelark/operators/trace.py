"""Trace core: call frames to attributed edges, roll-ups and proofs.

Frames are rows ``(tx, tx_ord, path)``; a call tree is never built. What the walk of a tree would carry down is found by
equi-joins on path prefixes, and what depends on the order of the walk by the order of ``(tx_ord, path)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Proofs that an edge keeps.
PROOFS = 3


def walk_order(tx_ord: str = "tx_ord", path: str = "path") -> Column:
    return F.struct(F.col(tx_ord), F.col(path))


def path_key(path: Column) -> Column:
    return F.array_join(path.cast("array<string>"), ",")


def path_text(path: Column) -> Column:
    return F.when(F.size(path) == 0, "root").otherwise(path_key(path))


def flagged(frames: DataFrame, identity: Sequence[str]) -> DataFrame:
    """frames with ``from_in`` and ``to_in``: whether an end is one of the target's addresses; false for a missing end."""
    known = lambda c: F.coalesce(F.lower(c).isin(*identity), F.lit(False))
    return frames.withColumns({"from_in": known(F.col("from_addr")), "to_in": known(F.col("to_addr"))})


def with_caller(rows: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """rows with ``caller_selector`` of the frame above and ``has_parent``; ``frames`` hold those, by default rows themselves."""
    parents = (rows if frames is None else frames).select(F.col("tx").alias("_tx"), path_key(F.col("path")).alias("_key"), F.col("selector").alias("caller_selector"), F.lit(True).alias("_is"))
    above = F.when(F.size("path") > 0, path_key(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))))
    joined = rows.join(parents, (F.col("tx") == F.col("_tx")) & (above == F.col("_key")), "left")
    return joined.withColumn("has_parent", F.coalesce("_is", F.lit(False))).drop("_tx", "_key", "_is")


def with_enclosing(rows: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Flagged rows with ``enclosing``: the selector by which the target was entered, of the deepest such frame strictly above.

    A delegatecall within the target does not enter it anew; an entry with short calldata resets to null. ``frames`` hold the
    entries, by default rows themselves: rows that were filtered before, as outbound ones, are all that is exploded and shuffled.
    """
    frames = rows if frames is None else frames
    entries = frames.where(F.col("to_in") & ~(F.col("from_in") & (F.col("call_type") == "delegatecall")))
    entries = entries.select(F.col("tx").alias("_tx"), path_key(F.col("path")).alias("_key"), F.size("path").alias("_depth"), F.col("selector").alias("_selector"))
    lengths = F.sequence(F.lit(0), F.size("path") - 1)
    prefixes = F.transform(lengths, lambda n: path_key(F.slice("path", 1, n)))
    below = rows.where((F.size("path") > 0) & F.col("from_in")).select("tx", path_key(F.col("path")).alias("key"), F.explode(prefixes).alias("_prefix"))
    found = below.join(entries, (F.col("tx") == F.col("_tx")) & (F.col("_prefix") == F.col("_key")))
    found = found.groupBy("tx", "key").agg(F.max_by("_selector", "_depth").alias("enclosing")).withColumnsRenamed({"tx": "_tx", "key": "_key"})
    joined = rows.join(found, (F.col("tx") == F.col("_tx")) & (path_key(F.col("path")) == F.col("_key")), "left")
    return joined.drop("_tx", "_key")


def outbound(frames: DataFrame) -> DataFrame:
    return frames.where("from_in and not to_in and to_addr is not null and call_type <> 'delegatecall'")


def delegatecalls(frames: DataFrame) -> DataFrame:
    return frames.where("from_in and not to_in and to_addr is not null and call_type = 'delegatecall'")


def inbound(frames: DataFrame) -> DataFrame:
    return frames.where("to_in and not from_in")


def outbound_edges(rows: DataFrame) -> DataFrame:
    """Edges of outbound or delegatecall frames with ``enclosing``; calls and transactions, and where the walk saw the last."""
    last = walk_order()
    return rows.groupBy(F.col("enclosing").alias("target_selector"), F.col("to_addr").alias("destination"), F.col("selector").alias("destination_selector"), "call_type").agg(
        F.count("*").alias("calls"), F.countDistinct("tx").alias("txs"), F.max_by("block", last).alias("last_block"), F.max_by("tx", last).alias("last_tx")
    )


def inbound_edges(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges of inbound frames with ``caller_selector``; ``caller_is_eoa`` as the first frame of the edge says."""
    book = labels.select(F.col("addr").alias("_addr"), F.col("is_contract").alias("_contract"))
    rows = rows.join(book, F.col("from_addr") == F.col("_addr"), "left")
    eoa = ~F.col("has_parent") & ~F.coalesce("_contract", F.lit(False))
    last = walk_order()
    return rows.groupBy(F.col("from_addr").alias("caller"), "caller_selector", F.col("selector").alias("target_selector"), "call_type").agg(
        F.count("*").alias("calls"), F.countDistinct("tx").alias("txs"), F.max_by("block", last).alias("last_block"), F.max_by("tx", last).alias("last_tx"),
        F.min_by(eoa, last).alias("caller_is_eoa"),
    )


def proofs(rows: DataFrame, keys: Sequence[str], n: int = PROOFS) -> DataFrame:
    """``keys, proof_no, tx, block, path``: the first frame of each transaction, newest blocks first, then by path.

    The inner aggregate has a map-side part, and the rank limit is applied before its shuffle, so a hot key sends n rows a task.
    """
    first = rows.groupBy(*keys, "tx").agg(F.min("path").alias("path"), F.min("block").alias("block"), F.min("tx_ord").alias("tx_ord"))
    order = Window.partitionBy(*keys).orderBy(F.col("block").desc(), "path", "tx_ord")
    return first.withColumn("proof_no", F.row_number().over(order)).where(F.col("proof_no") <= n).drop("tx_ord")


def rollup(rows: DataFrame, address: str) -> DataFrame:
    """``address, calls, txs`` of the counterparties of rows."""
    return rows.groupBy(F.col(address).alias("address")).agg(F.count("*").alias("calls"), F.countDistinct("tx").alias("txs"))


def function_counts(rows: DataFrame, address: str | None, selector: str) -> DataFrame:
    """Calls by function, null selector being a function of its own; by address too if one is named."""
    keys = ([F.col(address).alias("address")] if address else []) + [F.col(selector).alias("selector")]
    return rows.groupBy(*keys).agg(F.count("*").alias("calls"))


def code_bearing(frames: DataFrame) -> DataFrame:
    """Addresses that spoke in a frame below a root, and so ran code."""
    return frames.where(F.size("path") > 0).select(F.col("from_addr").alias("addr")).distinct()


def kinds(addresses: DataFrame, frames: DataFrame, labels: DataFrame) -> DataFrame:
    """``address`` rows with ``kind``: contract on trace evidence, else as the label book says, else unknown."""
    ran = code_bearing(frames).select(F.col("addr").alias("_ran"))
    book = labels.select(F.col("addr").alias("_addr"), F.col("is_contract").alias("_contract"))
    joined = addresses.join(ran, F.col("address") == F.col("_ran"), "left").join(book, F.col("address") == F.col("_addr"), "left")
    kind = F.when(F.col("_ran").isNotNull() | F.col("_contract"), "contract").when(F.col("_addr").isNotNull(), "eoa").otherwise("unknown")
    return joined.withColumn("kind", kind).drop("_ran", "_addr", "_contract")


def selectors(*edges: DataFrame, columns=("target_selector", "destination_selector", "caller_selector")) -> DataFrame:
    """Distinct selectors that edges name, null dropped."""
    found = None
    for e in edges:
        for c in columns:
            if c in e.columns:
                one = e.select(F.col(c).alias("selector"))
                found = one if found is None else found.unionByName(one)
    return found.where("selector is not null").distinct()


def signed(rows: DataFrame, signatures: DataFrame, **columns: str) -> DataFrame:
    """rows with a signature column for each selector column named: ``signed(edges, s, target_selector="target_signature")``."""
    for selector, name in columns.items():
        book = signatures.select(F.col("selector").alias(f"_{selector}"), F.col("signature").alias(name))
        rows = rows.join(book, F.col(selector) == F.col(f"_{selector}"), "left").drop(f"_{selector}")
    return rows


def first_known(wanted: DataFrame, key: str, value: str, books: dict[str, DataFrame]) -> DataFrame:
    """``<key>, <value>, source`` of wanted keys: of the books ``(<key>, <value>)``, by name, the first that knows a key, and only that is asked; unknown without one."""
    found, left = None, wanted
    for name, book in books.items():
        known = left.join(book, key).select(key, value, F.lit(name).alias("source"))
        found = known if found is None else found.unionByName(known)
        left = left.join(book, key, "left_anti")
    rest = left.select(key, F.lit(None).cast("string").alias(value), F.lit("unknown").alias("source"))
    return rest if found is None else found.unionByName(rest)


def analysed(frames: DataFrame, identity: Sequence[str]) -> DataFrame:
    return with_enclosing(with_caller(flagged(frames, identity)))


def touching(frames: DataFrame, identity: Sequence[str]) -> DataFrame:
    """The flagged frames with one end at the target, with ``enclosing``, ``caller_selector`` and ``has_parent``: all that edges of any direction need."""
    found = flagged(frames, identity)
    return with_caller(with_enclosing(found.where("from_in <> to_in"), found), found)


def edge_keys(rows: DataFrame, direction: str) -> DataFrame:
    """``target_selector, txs`` of each edge of outbound ("out") or inbound ("in") frames, without what else an edge tells."""
    keys = {"out": [F.col("enclosing").alias("target_selector"), "to_addr", "selector", "call_type"], "in": ["from_addr", "caller_selector", F.col("selector").alias("target_selector"), "call_type"]}[direction]
    return rows.groupBy(*keys).agg(F.countDistinct("tx").alias("txs")).select("target_selector", "txs")


def reachable(frames: DataFrame) -> DataFrame:
    """Frames all of whose strict prefixes exist: what a tree that is built from its root can hold."""
    keys = frames.select(F.col("tx").alias("_tx"), path_key(F.col("path")).alias("_key")).distinct()
    prefixes = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: path_key(F.slice("path", 1, n)))
    below = frames.where(F.size("path") > 0).select("tx", path_key(F.col("path")).alias("key"), F.size("path").alias("depth"), F.explode(prefixes).alias("prefix"))
    whole = below.join(keys, (F.col("tx") == F.col("_tx")) & (F.col("prefix") == F.col("_key"))).groupBy("tx", "key").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))
    whole = whole.where("n = depth").select(F.col("tx").alias("_tx"), F.col("key").alias("_key"))
    roots = frames.where(F.size("path") == 0)
    return roots.unionByName(frames.where(F.size("path") > 0).join(whole, (F.col("tx") == F.col("_tx")) & (path_key(F.col("path")) == F.col("_key")), "left_semi"))


def child_ordinals(frames: DataFrame) -> DataFrame:
    """frames with ``ordinal``: the position among the frames below the same one, by the order of their last step."""
    above = path_key(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))))
    order = Window.partitionBy("tx", above).orderBy("path")
    return frames.where(F.size("path") > 0).withColumn("ordinal", F.row_number().over(order) - 1)
