"""SimHash near-dedup with pigeonring filtering.

A fingerprint's 64 bits stand in a ring of m = 2k + 1 segments, k being the bits that may differ. If two fingerprints differ in
at most k bits, then some segment starts a chain in which the differences of the first l segments sum to at most l*k/m, for
every l. Candidates are the pairs that satisfy this for all prefixes of a chain of ``chain`` segments: the segments that may
differ within those budgets are left out of the key (a wildcard pattern), the others must be equal, and in larger buckets the rest of
the prefix budgets are tested before the full Hamming distance. Longer chains give longer keys, so fewer chance candidates,
and more keys; all of them find every pair.

A second fingerprint, of mixed hashes, can widen the full Hamming check to 128 bits: with a larger k, chance alone would bring some
of very many documents within k bits of 64.

``alike_dups`` links by the exact Jaccard similarity of shingle sets. SimHash groups are candidates there, and as distances of
fingerprints scatter, so are the sets that share all minima of one of BANDS bands of ROWS minima: of pairs alike by 0.8 all but
3 in 100,000. Every candidate pair is compared as sets of 64-bit hashes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, saved, small_batches
from .components import components, star_batches

#: Fingerprints, and hashes of shingle sets, that a block has at most or so; larger buckets are compared block against block, in more tasks.
BLOCK, BLOCK_HASHES = 4096, 4 << 20
#: Fingerprints of a bucket that are compared as one matrix, and links of each up to which its links are walked singly.
MATRIX, LINKS = 1024, 4
#: Seed of the hashes; nanoseconds that a key's row and a compared pair take.
SEED, ROW_NS, PAIR_NS = 42, 3000, 5
#: Bands, and minima of a band; their sets' hashes are odd multiples of the shingles'.
BANDS, ROWS = 20, 4
ODD = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bounds(bits: int) -> list[tuple[int, int]]:
    """First bit and width of each segment of the ring."""
    m = 2 * bits + 1
    return [(64 * i // m, 64 * (i + 1) // m - 64 * i // m) for i in range(m)]


def shingles(text: str | None, words: int) -> list[bytes]:
    """The word shingles of the whole text, A-Z lower-cased, repeats included; with fewer words the one of all of them, without words none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and ASCII blanks alone
    if len(tokens) <= words:
        return [b" ".join(tokens)] if tokens else []
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1].tolist()
    return [joined[a:b] for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each word shingle of the whole text."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(s, SEED) for s in shingles(text, words)], dtype=np.uint64)


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, a bijection whose bits do not follow those of the first."""
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        hashes = (hashes ^ (hashes >> np.uint64(shift))) * np.uint64(odd)
    return hashes ^ (hashes >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    """The bits that are 1 in over half the hashes; 0 of none."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounds the memory of very long texts
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(text: str | None, words: int = 4, n: int = 1) -> list[int]:
    """The SimHash of the word shingles of the whole text, A-Z lower-cased, and (n = 2) the one of their mixed hashes; 0 without words."""
    hashes = shingle_hashes(text, words)
    return [majority(hashes), majority(mixed(hashes))][:n] if n > 1 else [majority(hashes)]


def fingerprint(text: str | None, words: int = 4) -> int:
    return fingerprints(text, words)[0]


def with_fingerprints(docs: DataFrame, words: int = 4, names: tuple[str, ...] = ("fp",)) -> DataFrame:
    """docs and a column for each of one or two names: the fingerprints, as signed longs with the same 64 bits."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def columns(texts: pd.Series) -> pd.DataFrame:
        rows = np.array([fingerprints(t, words, len(names)) for t in texts], dtype=np.uint64).reshape(-1, len(names)).view(np.int64)
        return pd.DataFrame(rows, columns=list(names))

    return docs.withColumn("_fl_prints", columns(F.col("text"))).select(*(F.col(f"`{c}`") for c in docs.columns if c not in names), "_fl_prints.*")


def patterns(chain: int, bits: int) -> list[tuple[int, ...]]:
    """Positions of a chain that its key leaves out: maximal sets that the prefix budgets allow to differ."""
    budget = [l * bits // (2 * bits + 1) for l in range(chain + 1)]
    ok = lambda out: all(sum(p < l for p in out) <= budget[l] for l in range(1, chain + 1))
    allowed = [set(c) for r in range(budget[chain] + 1) for c in combinations(range(chain), r) if ok(c)]
    return sorted(tuple(sorted(c)) for c in allowed if not any(c < d for d in allowed))


def masks(chain: int, bits: int) -> list[int]:
    """For each start of a chain and wildcard pattern the bits that must be equal."""
    ring = bounds(bits)
    out = []
    for start in range(len(ring)):
        for wild in patterns(chain, bits):
            kept = [ring[(start + p) % len(ring)] for p in range(chain) if p not in wild]
            out.append(sum(((1 << width) - 1) << first for first, width in kept))
    return out


def chain_for(n: int, bits: int) -> int:
    """The chain by which n fingerprints cost least: its keys for each, and their chance candidates if bits are even."""
    price = lambda keys: sum(ROW_NS + PAIR_NS * n * 2.0 ** -m.bit_count() for m in keys)
    return min(range(2, min(2 * bits + 1, 9), 2), key=lambda chain: price(masks(chain, bits)))


def _signed64(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def keyed(fps: DataFrame, chain: int, bits: int) -> DataFrame:
    """fps with ``key_no, key``: a row for each mask; key: the bits that must be equal."""
    keys = F.array(*(F.struct(F.lit(i).cast("short").alias("key_no"), F.col("fp").bitwiseAND(F.lit(_signed64(m))).alias("key")) for i, m in enumerate(masks(chain, bits))))
    return fps.withColumn("k", F.explode(keys)).select(*fps.columns, "k.key_no", "k.key")


def _chain_passes(diff: np.ndarray, bits: int) -> np.ndarray:
    """Whether some segment starts a chain within its budgets at every length up to the whole ring; diff: XORs."""
    ring = bounds(bits)
    parts = [np.bitwise_count((diff >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int16) for first, width in ring]
    found = np.zeros(diff.shape, dtype=bool)
    for start in range(len(ring)):
        going, total = ~found, np.zeros(diff.shape, dtype=np.int16)
        for l in range(1, len(ring) + 1):
            total = total + parts[(start + l - 1) % len(ring)]
            going &= total <= l * bits // len(ring)
            if not going.any():
                break
        found |= going
    return found


def near(one: int, others: np.ndarray, fps: np.ndarray, second: np.ndarray | None, bits: int, wide: int) -> np.ndarray:
    """Which of the indices ``others`` are near to ``one``: chains first, then the full distance of 64 and of 128 bits."""
    diff = fps[others] ^ fps[one]
    hit = np.flatnonzero(_chain_passes(diff, bits)) if len(diff) > 8 else np.arange(len(diff))
    apart = np.bitwise_count(diff[hit])
    good = apart <= bits
    if second is not None:
        good &= apart.astype(np.int16) + np.bitwise_count(second[others[hit]] ^ second[one]) <= wide
    return hit[good]


def bucket_links(fps: np.ndarray, bits: int, second: np.ndarray | None = None, wide: int = 128, ids: np.ndarray | None = None):
    """Links that join all of a bucket that is joined by links within it.

    Few links are found as one matrix. Where there are many it goes breadth first, each reached one against those not yet reached:
    copies of one text reach each other in one step, so a crowded bucket costs little more than its size. Links are of ``ids``,
    without them of the fingerprints themselves.
    """
    ids = fps if ids is None else ids
    if len(fps) <= MATRIX:
        apart = np.bitwise_count(fps[:, None] ^ fps[None, :])
        linked = np.triu(apart <= bits, 1)
        if second is not None and linked.any():
            a, b = np.nonzero(linked)
            linked[a, b] = apart[a, b].astype(np.int16) + np.bitwise_count(second[a] ^ second[b]) <= wide
        if np.count_nonzero(linked) <= LINKS * len(fps):
            yield from zip(*(ids[x].tolist() for x in np.nonzero(linked)))
            return
    left = np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            hit = near(one, left, fps, second, bits, wide)
            if len(hit):
                for other in left[hit]:
                    yield int(ids[one]), int(ids[other])
                queue.extend(left[hit])
                left = np.delete(left, hit)


def _links(bits: int, wide: int | None):
    def found(batches):
        for batch in batches:
            for members in batch.column(0):
                own = [np.array(members.values.field(i).to_numpy(), dtype=np.int64).view(np.uint64) for i in range(3 if wide else 1)]
                links = bucket_links(own[0], bits, own[1], wide, own[2]) if wide else bucket_links(np.unique(own[0]), bits)
                yield from ((_signed64(a), _signed64(b)) for a, b in links)

    def run(batches):
        yield from star_batches(found(batches))

    return run


def in_blocks(keys: DataFrame, crowded: DataFrame, member: str) -> DataFrame:
    """keys in buckets ``crowded(key_no, key, blocks)``, with ``b``: a bucket of more than one block is one for each pair of its blocks."""
    keys = keys.join(crowded.select("key_no", "key", F.col("blocks").cast("int").alias("blocks")), ["key_no", "key"])
    mine = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j")))
    return keys.withColumn("b", F.explode(pairs))


def fingerprint_links(fps: DataFrame, bits: int = 4, wide: int | None = None, chain: int | None = None) -> DataFrame:
    """``u, v``: links between distinct fingerprints ``fps(fp)`` that connect all that differ in at most ``bits`` bits.

    With ``fps(fp, fp2, node)`` and ``wide``, links between nodes, also at most ``wide`` bits of both together. Not all such pairs: within a bucket only
    as many as connect it. A bucket of more than BLOCK fingerprints becomes one bucket for each pair of its blocks, so no
    task gathers more than two blocks of a key.
    """
    small_batches(fps.sparkSession)
    if chain is None:
        chain = chain_for(fps.count(), bits)
    keys = keyed(fps, chain, bits)
    crowded = keys.groupBy("key_no", "key").count().where(F.col("count") > 1)
    crowded = saved(crowded.select("key_no", "key", F.ceil(F.col("count") / BLOCK).alias("blocks")), "simhash-buckets")
    keys = in_blocks(keys, crowded, fps.columns[-1])
    buckets = keys.groupBy("key_no", "key", "b").agg(F.collect_list(F.struct(*fps.columns)).alias("fps")).select("fps")
    return buckets.mapInArrow(_links(bits, wide), "u long, v long")


def rooted_prints(prints: DataFrame, bits: int, wide: int | None) -> DataFrame:
    """``fp, least_id, root`` of ``prints(doc_id, fp)``, with ``wide`` also ``fp2``: the component of each class, and its smallest doc_id.

    Classes are of equal fingerprints, of both with ``wide``; those of equal ``fp`` are linked too.
    """
    both = ("fp", "fp2") if wide else ("fp",)
    node = F.xxhash64(*both) if wide else F.col("fp")
    classes = saved(prints.groupBy(*both).agg(F.min("doc_id").alias("least_id")).withColumn("_fl_node", node), "simhash-classes")
    if wide:
        links = fingerprint_links(classes.select(*both, F.col("_fl_node").alias("node")), bits, wide)
        least = classes.groupBy("fp").agg(F.min("_fl_node").alias("v"), F.count("*").alias("n")).where("n > 1")
        links = links.unionByName(classes.join(least, "fp").select(F.col("_fl_node").alias("u"), "v"))
    else:
        links = fingerprint_links(classes.select("fp"), bits)
    rooted = classes.join(components(links, contract=False), F.col("_fl_node") == F.col("node"), "left")
    return saved(rooted.select(*both, "least_id", F.coalesce("root", "_fl_node").alias("root")), "simhash-rooted")


def near_dups(docs: DataFrame, bits: int = 4, words: int = 4, wide: int | None = None) -> DataFrame:
    """One row a document: ``doc_id, fp, component_id``: the smallest doc_id that links reach, itself included.

    With ``wide``, links must also be within that many bits of 128; each pair of fingerprints that occurs is compared.
    Documents with equal fingerprints are linked; null, empty and blank texts have fingerprint 0 and are linked like
    any other. Fewer words than a shingle: the whole sequence is the one shingle. A null doc_id counts for no
    component's id (null if a component has no other). Repeated rows stay. An empty table gives no rows. Other
    columns are ignored.
    """
    both = ("fp", "fp2") if wide else ("fp",)
    prints = saved(with_fingerprints(docs.select("doc_id", "text"), words, both).drop("text"), "simhash-prints")
    rooted = rooted_prints(prints, bits, wide)
    # written, so that the join to a component of very many fingerprints can be split
    groups = saved(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-groups")
    ids = saved(rooted.join(groups, "root").select(*both, "component_id"), "simhash-components")
    return prints.join(ids, list(both)).select("doc_id", "fp", "component_id")


def set_id(hashes: np.ndarray) -> int:
    """64 bits that stand for a shingle set, its distinct hashes in order; 0 for the empty one."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes()) if len(hashes) else 0


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band; none for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    least = np.full(len(ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1 << 12):  # bounds the memory of very long texts
        least = np.minimum(least, (hashes[i : i + (1 << 12), None] * ODD).min(axis=0))
    return [xxh64_intdigest(b.tobytes()) for b in least.reshape(BANDS, ROWS)]


def _long(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def with_keys(docs: DataFrame, words: int) -> DataFrame:
    """docs with both fingerprints ``fp, fp2``, ``set_id``, the set's size ``n`` and its ``bands``: the shingles are hashed once for all of them."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("fp long, fp2 long, set_id long, n long, bands array<long>")
    def columns(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            hashes = shingle_hashes(t, words)
            own = np.unique(hashes)
            rows.append((majority(hashes), majority(mixed(hashes)), set_id(own), len(own), _long(bands(own))))
        fp, fp2, ids, n, keys = zip(*rows) if rows else ((), (), (), (), ())
        return pd.DataFrame({"fp": _long(fp), "fp2": _long(fp2), "set_id": _long(ids), "n": np.array(n, dtype=np.int64), "bands": list(keys)})

    return docs.withColumn("_fl_keys", columns(F.col("text"))).select(*(F.col(f"`{c}`") for c in docs.columns), "_fl_keys.*")


def with_sets(docs: DataFrame, words: int) -> DataFrame:
    """docs and ``set_id, hashes``: the set of shingle hashes, in order."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("set_id long, hashes array<long>")
    def columns(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(shingle_hashes(t, words)) for t in texts]
        return pd.DataFrame({"set_id": _long([set_id(x) for x in sets]), "hashes": [x.view(np.int64) for x in sets]})

    return docs.withColumn("_fl_set", columns(F.col("text"))).select(*(F.col(f"`{c}`") for c in docs.columns), "_fl_set.*")


def alike_links(sets: list[np.ndarray], alike: float):
    """Index pairs that join all of ``sets`` that are joined by pairs of a Jaccard similarity of at least ``alike``.

    Breadth first, each reached one against those not yet reached.
    """
    sizes = np.array([len(x) for x in sets])
    left = np.arange(len(sets))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            fits = np.flatnonzero(np.minimum(sizes[left], sizes[one]) >= alike * np.maximum(sizes[left], sizes[one]) * (1 - 1e-9))
            if not len(fits):
                continue
            others = left[fits]
            joined = np.concatenate([sets[o] for o in others])
            at = np.minimum(np.searchsorted(sets[one], joined), sizes[one] - 1)
            common = np.add.reduceat((sets[one][at] == joined).astype(np.int64), np.concatenate(([0], np.cumsum(sizes[others])[:-1])))
            hit = common / (sizes[others] + sizes[one] - common) >= alike
            for other in others[hit]:
                yield int(one), int(other)
            queue.extend(others[hit])
            left = np.delete(left, fits[hit])


def _alike(alike: float):
    def found(batches):
        for batch in batches:
            for members in batch.column(0):
                ids = members.values.field(0).to_numpy()
                hashes = members.values.field(1)
                sets = [hashes[i].values.to_numpy().view(np.uint64) for i in range(len(ids))]
                yield from ((int(ids[a]), int(ids[b])) for a, b in alike_links(sets, alike))

    def run(batches):
        yield from star_batches(found(batches))

    return run


def alike_prints(docs: DataFrame, bits: int, words: int, wide: int, alike: float) -> tuple[DataFrame, DataFrame]:
    """``doc_id, digest, set_id`` of each row, and ``set_id, root``: the groups that links of a Jaccard similarity of at least ``alike`` make of shingle sets.

    Candidates are the groups of ``near_dups`` and the bands' buckets.
    """
    text = docs.select("doc_id", "text", digest(F.col("text")).alias("digest"))
    prints = saved(with_keys(text, words).drop("text"), "alike-prints")
    rooted = rooted_prints(prints, bits, wide).select("fp", "fp2", "root")
    # a set comes from the text of one row that has it
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    classes = saved(prints.groupBy("set_id").agg(F.min(row).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands")), "alike-classes")
    some = F.col("set_id") != 0
    by_band = classes.where(some).select("set_id", "n", F.posexplode("bands").alias("key_no", "key"))
    grouped = prints.where(some).select("set_id", "n", "fp", "fp2").distinct().join(rooted, ["fp", "fp2"]).select("set_id", "n", F.lit(-1).alias("key_no"), F.col("root").alias("key")).distinct()
    keys = saved(by_band.unionByName(grouped), "alike-keys")
    # near copies share most bands: of buckets with the same members one is compared
    members = [F.bit_xor(F.xxhash64("set_id")).alias("m1"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("m2")]
    crowded = keys.groupBy("key_no", "key").agg(F.count("*").alias("count"), F.sum("n").alias("n"), *members).where("count > 1")
    crowded = crowded.groupBy("count", "n", "m1", "m2").agg(F.min(F.struct("key_no", "key")).alias("k"))
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(F.col("n") / BLOCK_HASHES))
    crowded = saved(crowded.select("k.key_no", "k.key", blocks.alias("blocks")), "alike-buckets")
    keys = saved(in_blocks(keys, crowded, "set_id"), "alike-members")
    wanted = keys.select("set_id").distinct().join(classes.select("set_id", "row"), "set_id").select(F.col("row.doc_id").alias("_fl_id"), F.col("row.digest").alias("_fl_of"))
    wanted = bounded(saved(wanted, "alike-wanted"))
    held = docs.select("doc_id", "text", digest(F.col("text")).alias("digest"))
    held = held.join(wanted, F.col("doc_id").eqNullSafe(F.col("_fl_id")) & (F.col("digest") == F.col("_fl_of")), "left_semi")
    sets = with_sets(held.select("text"), words).select("set_id", "hashes").dropDuplicates(["set_id"])
    buckets = keys.join(sets, "set_id").groupBy("key_no", "key", "b").agg(F.collect_list(F.struct("set_id", "hashes")).alias("sets")).select("sets")
    roots = components(buckets.mapInArrow(_alike(alike), "u long, v long"), contract=False)
    found = classes.join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", F.coalesce("root", "set_id").alias("root"))
    return prints.select("doc_id", "digest", "set_id"), found


def alike_dups(docs: DataFrame, bits: int, words: int, wide: int, alike: float) -> DataFrame:
    """One row a document: ``doc_id, component_id``: the smallest doc_id that links of a Jaccard similarity of at least ``alike`` reach.

    Equal shingle sets are linked, empty ones too; else as ``near_dups``.
    """
    prints, roots = alike_prints(docs, bits, words, wide, alike)
    return with_first(prints, roots, "set_id").select("doc_id", F.col("first.doc_id").alias("component_id"))


def digest(text: Column) -> Column:
    """Column: 128 bits that stand for a text; null as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def with_first(prints: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``prints(doc_id, digest, <node>)`` with ``first(nameless, doc_id, digest)`` of the group that ``roots(<node>, root)`` puts a row in.

    The first row has the smallest doc_id (null is the last), of rows with that id the one of least digest. Groups are
    aggregated over nodes, before the join to rows, so that a group of very many rows is split by the join.
    """
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col("digest"))
    nodes = prints.groupBy(node).agg(F.min(row).alias("first"))
    rooted = saved(nodes.join(roots, node), "dup-rooted")
    groups = saved(rooted.groupBy("root").agg(F.min("first").alias("first")), "dup-groups")
    firsts = saved(rooted.select(node, "root").join(groups, "root").select(node, "first"), "dup-firsts")
    return prints.join(firsts, node)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, bits: int = 4, words: int = 4, wide: int | None = None, alike: float | None = None) -> DataFrame:
    """docs without near copies: of each group one row stays, that of the smallest doc_id; of several with that id the one whose text has the least digest.

    With ``alike``, which needs ``wide``, groups are those of ``alike_dups``, else of ``near_dups``. What goes is settled for each
    pair of id and text, so unlike texts of one id each stay or go by their own group. Rows equal in id and text are one document, which
    stays once (with the other columns of any of them). A null doc_id is after all others. An empty table gives no rows.
    """
    if alike is None:
        both = ("fp", "fp2") if wide else ("fp",)
        prints = with_fingerprints(docs.select("doc_id", "text", digest(F.col("text")).alias("digest")), words, both).drop("text")
        node = F.xxhash64(*both) if wide else F.col("fp")
        prints = saved(prints.withColumn("_fl_node", node), "simhash-prints")
        roots = rooted_prints(prints, bits, wide).select(node.alias("_fl_node"), "root")
        found = with_first(prints.select("doc_id", "digest", "_fl_node"), roots, "_fl_node")
    else:
        prints, roots = alike_prints(docs, bits, words, wide, alike)
        found = with_first(prints, roots, "set_id")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    lost = saved(found.where(~same).select(F.col("doc_id").alias("_fl_id"), F.col("digest").alias("_fl_of")).distinct(), "dup-lost")
    twice = saved(prints.groupBy(F.col("doc_id").alias("_fl_id"), F.col("digest").alias("_fl_of")).count().where("count > 1").drop("count"), "dup-twice")
    rows = docs.withColumn("_fl_digest", digest(F.col("text")))
    here = F.col("doc_id").eqNullSafe(F.col("_fl_id")) & (F.col("_fl_digest") == F.col("_fl_of"))
    kept = rows.join(bounded(lost), here, "left_anti")
    if twice.limit(1).count():
        twice = bounded(twice)
        once = kept.join(twice, here, "left_semi").dropDuplicates(["doc_id", "_fl_digest"])
        kept = kept.join(twice, here, "left_anti").unionByName(once)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
