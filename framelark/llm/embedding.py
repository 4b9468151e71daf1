"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one representative of each group.

Two vectors of cosine t or more are at most a chord sqrt(2-2t) apart. If their cells differ, the plane between the two
centroids lies between them, so one of them is within half that chord of it. Vectors that near to the plane of another cell
visit that cell, and there meet its own: no link is lost for any number or quality of cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, saved
from .components import components

#: Vectors, and bytes of them, that the centroids are fitted on at most, vectors of a cell that are aimed at, and cells that a vector may visit on average.
SAMPLE, SAMPLE_BYTES, CELL, VISITS = 20_000, 128 << 20, 2000, 4
#: Cells at most: they are fitted on the driver. Of more than CELL times as many vectors the cells grow, and are dealt into more blocks.
CELLS = 4096
#: Bytes of a block of vectors, and vectors of it that are multiplied at a time.
BLOCK_BYTES, ROWS = 8 << 20, 1024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of unit vectors; starts from k evenly taken rows, keeps the centroid of an empty cell."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        sums = np.zeros_like(centroids)
        for i in range(0, len(x), ROWS):  # bounds the memory of many cells
            np.add.at(sums, np.argmax(x[i : i + ROWS] @ centroids.T, axis=1), x[i : i + ROWS])
        norms = np.linalg.norm(sums, axis=1)
        centroids[norms > 1e-9] = sums[norms > 1e-9] / norms[norms > 1e-9, None]
    return centroids


def visits(x: np.ndarray, centroids: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Own cell of each unit vector, and a matrix of the cells (its own too) to whose plane it is within margin."""
    s = x @ centroids.T
    own = np.argmax(s, axis=1)
    cells, place = np.unique(own, return_inverse=True)
    apart = np.sqrt(np.maximum(2 - 2 * centroids[cells] @ centroids.T, 0))
    return own, s[np.arange(len(x)), own][:, None] - s <= margin * apart[place] + 1e-9


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``node, copies, embedding`` of each distinct vector that can link: node is the smallest id of its copies."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    finite = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(finite)
    return rows.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))


def unit(column) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors in double precision, without overflow or underflow of their squares."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    x = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(flat), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(sample: np.ndarray, n: int, margin: float) -> np.ndarray:
    """Centroids of as many cells, in powers of two, as n vectors fill and as keep the visits of a vector to VISITS.

    Where vectors have clusters that is many; where they are spread evenly over many dimensions, planes are near to all
    and few cells cost least. The number changes the work, not the links.
    """
    centroids, k = spherical_kmeans(sample, 1), 2
    while k <= min(n // CELL, len(sample), CELLS):
        more = spherical_kmeans(sample, k, 12 if k <= 256 else 4)
        if visits(sample[: 4 * ROWS], more, margin)[1].sum(axis=1).mean() > VISITS:
            break
        centroids, k = more, 2 * k
    return centroids


def linked_rows(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which unit vectors have a cosine of at least threshold, in double precision; single precision sorts out those that are clear."""
    slack = 1e-5 + 2.4e-7 * left.shape[1]
    near = left.astype(np.float32) @ right.astype(np.float32).T >= threshold - slack
    hits = np.count_nonzero(near)
    if hits * 20 > near.size:
        return left @ right.T >= threshold
    if hits:
        a, b = np.nonzero(near)
        near[a, b] = np.einsum("ij,ij->i", left[a], right[b]) >= threshold
    return near


def stars(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``node, root`` of the nodes that links join, root the smallest of theirs here; at most one for each row and column."""
    rows, columns = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    if not len(rows):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    linked, u, v = linked[np.ix_(rows, columns)], left[rows], right[columns]
    far = np.iinfo(np.int64).max
    of_u, of_v = u.copy(), v.copy()
    while True:
        now = np.minimum(of_u, np.where(linked, of_v[None, :], far).min(axis=1))
        then = np.minimum(of_v, np.where(linked, now[:, None], far).min(axis=0))
        if np.array_equal(now, of_u) and np.array_equal(then, of_v):
            break
        of_u, of_v = now, then
    nodes, roots = np.concatenate([u, v]), np.concatenate([of_u, of_v])
    return nodes[nodes != roots], roots[nodes != roots]


def link_counts(classes: DataFrame, threshold: float = 0.9, cells: int | None = None, reach: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """``node, n`` (vectors of other classes linked to each, in parts to be summed) and ``u, v`` (links that connect all linked) of classes of one width.

    A cell's own vectors and its guests are dealt into blocks, and each pair of blocks is a task of its own, so no task
    gathers a crowded cell. Vectors travel as bytes.
    """
    spark = classes.sparkSession
    sample = unit_sample(classes)
    if not len(sample):
        return spark.createDataFrame([], "node long, n long"), spark.createDataFrame([], "u long, v long")
    margin = reach * np.sqrt(max(2 - 2 * threshold, 0)) / 2
    model = spark.sparkContext.broadcast(spherical_kmeans(sample, min(cells, len(sample))) if cells else fitted(sample, classes.count(), margin))
    block = max(1, BLOCK_BYTES // (8 * sample.shape[1]))

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                x = unit(part.column("embedding"))
                own, near = visits(x, model.value, margin)
                row, cell = np.nonzero(near)
                home = cell == own[row]
                data = np.frombuffer(x.tobytes(), dtype=f"V{8 * x.shape[1]}")
                bits = [b.tobytes() for b in np.packbits(near, axis=1)]
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([
                    pa.array(cell, pa.int32()), pa.array(home), pa.array(own[row], pa.int32()), taken.column("node"), taken.column("copies"),
                    pa.array([d.tobytes() for d in data[row]], pa.binary()), pa.array([bits[r] if h else None for r, h in zip(row, home)], pa.binary()),
                ], ["cell", "home", "own", "node", "copies", "x", "near"])

    kind = "cell int, home boolean, own int, node long, copies long, x binary, near binary"
    placed = saved(classes.select("node", "copies", "embedding").mapInArrow(assign, kind), "embedding-cells")
    counts = placed.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests"))
    blocks = counts.select("cell", F.ceil(F.col("homes") / block).cast("int").alias("hb"), F.ceil(F.col("guests") / block).cast("int").alias("gb"))
    placed = placed.join(bounded(blocks), "cell")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    h, g = F.pmod(F.xxhash64("node"), F.col("hb")).cast("int"), F.pmod(F.xxhash64("node"), F.col("gb")).cast("int")
    of_home = F.concat(
        F.transform(upto(F.col("hb")), lambda o: F.struct(F.least(o, h).alias("i"), F.greatest(o, h).alias("j"))),
        F.transform(upto(F.col("gb")), lambda o: F.struct(h.alias("i"), (-1 - o).alias("j"))),
    )
    of_guest = F.transform(upto(F.col("hb")), lambda o: F.struct(o.alias("i"), (-1 - g).alias("j")))
    tasks = placed.withColumn("hblock", h).withColumn("t", F.explode(F.when(F.col("home"), of_home).otherwise(of_guest)))
    tasks = tasks.select("cell", "t.i", "t.j", "home", "own", "hblock", "node", "copies", "x", F.when(F.col("j") < 0, F.col("near")).alias("near"))

    def compare(key, table):
        import pyarrow as pa

        cell, i, j = (k.as_py() for k in key)
        x = np.frombuffer(b"".join(table.column("x").to_pylist()), dtype=np.float64).reshape(table.num_rows, -1)
        node, copies, home, own, blocks_of = (table.column(c).to_numpy() for c in ("node", "copies", "home", "own", "hblock"))
        left = np.flatnonzero(home & (blocks_of == i))
        right = left if i == j else np.flatnonzero(home & (blocks_of == j)) if j >= 0 else np.flatnonzero(~home)
        sums, found = np.zeros(table.num_rows, dtype=np.int64), []

        def count(some, others, same=0):
            """Links of rows with others, of which the first ``same`` are the rows themselves."""
            linked = linked_rows(x[some], x[others], threshold)
            if same:
                linked[np.arange(same), np.arange(same)] = False
            if linked.any():
                sums[some] += linked @ copies[others]
                sums[others[same:]] += copies[some] @ linked[:, same:]
                found.append(np.stack(stars(linked, node[some], node[others])))

        for n in range(0, len(left), ROWS):
            some = left[n : n + ROWS]
            if j >= 0:
                count(some, left[n:], len(some)) if i == j else count(some, right)
                continue
            # a pair of two cells may meet in both; it is compared in the smaller one then
            flags = np.frombuffer(b"".join(table.column("near").take(pa.array(some)).to_pylist()), dtype=np.uint8).reshape(len(some), -1)
            near = np.unpackbits(flags, axis=1, count=model.value.shape[0]).astype(bool)
            later = right[own[right] > cell]
            if len(later):
                count(some, later)
            for other in np.unique(own[right][own[right] < cell]):
                rows = some[~near[:, other]]
                if len(rows):
                    count(rows, right[own[right] == other])
        some = np.flatnonzero(sums)
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), dtype=np.int64)
        lacking = pa.nulls(len(some), pa.int64()), pa.nulls(pairs.shape[1], pa.int64())
        return pa.table({
            "u": pa.concat_arrays([pa.array(node[some], pa.int64()), pa.array(pairs[0], pa.int64())]),
            "v": pa.concat_arrays([lacking[0], pa.array(pairs[1], pa.int64())]),
            "n": pa.concat_arrays([pa.array(sums[some], pa.int64()), lacking[1]]),
        })

    found = saved(tasks.groupBy("cell", "i", "j").applyInArrow(compare, "u long, v long, n long"), "embedding-links")
    return found.where("v is null").select(F.col("u").alias("node"), "n"), found.where("v is not null").select("u", "v")


def unit_sample(classes: DataFrame) -> np.ndarray:
    """Unit vectors of at most SAMPLE distinct vectors, and SAMPLE_BYTES of them, those of the least hashes."""
    first = classes.select(F.size("embedding")).first()
    most = min(SAMPLE, SAMPLE_BYTES // (8 * max(1, first[0]))) if first else 1
    rows = classes.select("embedding", F.xxhash64("node").alias("h")).orderBy("h").limit(max(1, most)).select("embedding").toArrow()
    return unit(rows.column("embedding")) if rows.num_rows else np.zeros((0, 1))


def near_dups(vectors: DataFrame, threshold: float = 0.9, cells: int | None = None, reach: float = 1.0) -> DataFrame:
    """One row a vector: ``vec_id, n_links, component_id, kept``.

    ``reach`` is the part of the sure distance to a plane within which vectors visit the cell behind it. At 1 no link is lost. Below, a
    pair is lost if its difference lies mostly across a plane, which in many dimensions is rare, and far fewer visits are made: for
    vectors without clusters the work then no longer grows with the square of their number.

    Equal vectors are one class that is compared once. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing, nor do rows without a vec_id (component null, kept). Vectors of different
    widths never link. Repeated rows are vectors of their own that link. Empty tables give no rows; extra columns are ignored.
    """
    classes = saved(valid_vectors(vectors), "embedding-classes")
    widths = [r[0] for r in classes.select(F.size("embedding").alias("n")).distinct().orderBy("n").collect()]
    counts = links = None
    for width in widths:
        n, pairs = link_counts(classes.where(F.size("embedding") == width), threshold, cells, reach)
        counts, links = (n, pairs) if counts is None else (counts.unionByName(n), links.unionByName(pairs))
    out = vectors.select("vec_id", "embedding")
    if not widths:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    roots = components(links)
    by_class = classes.join(counts.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(roots, "node", "left")
    by_class = saved(by_class.select(
        F.xxhash64("embedding").alias("h"), F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")
    ), "embedding-found")
    joined = out.withColumn("h0", F.xxhash64("embedding")).join(by_class, (F.col("h0") == F.col("h")) & (F.col("embedding") == F.col("e")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("root", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
