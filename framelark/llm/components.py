"""Connected components of a large sparse graph, by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Keys over which the edges of one node are dealt where its smallest neighbour is sent along them.
SALTS = 16
#: Nodes up to which a task gathers its edges in a forest before it sends the stars on.
FOREST = 500_000


def forest(pairs, limit: int = FOREST):
    """Spanning stars ``(node, root)`` of an iterable of pairs, by union-find; root is the smallest node.

    From ``limit`` nodes on the stars so far are sent on and forgotten, which bounds the memory: all stars together connect what the pairs connect.
    """
    parent: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars():
        for x in parent:
            if (root := find(x)) != x:
                yield x, root

    for a, b in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = find(a), find(b)
        if a != b:
            if b < a:
                a, b = b, a
            parent[b] = a
        if len(parent) >= limit:
            yield from stars()
            parent.clear()
    yield from stars()


def star_batches(pairs):
    """The stars of ``forest`` as Arrow batches ``u, v``, for the end of a task: what a map-side combine is to a sum."""
    import pyarrow as pa

    stars = forest(pairs)
    while some := list(islice(stars, 65536)):
        u, v = zip(*some)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _contract(batches):
    """Within a partition, replace edges by stars."""
    yield from star_batches(pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # a hub may have a third of all edges: its edges are dealt over SALTS keys
    least = least.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge has u > v here."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60, contract: bool = True) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u long, v long)`` but the roots; root is the smallest node reachable.

    Each task replaces its edges by stars first, unless (``contract``) they come of tasks that have done so.

    Self loops, repeated edges and edges with a null end are ignored; no edges give no rows.
    Each round writes its edges to the shared folder, so a lost executor costs one round's tasks at most.
    """
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    stars = saved(edges.mapInArrow(_contract, "u long, v long") if contract else edges, "stars")
    before = None
    for _ in range(max_rounds):
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        stars = saved(_small_star(_large_star(stars)), "stars")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
