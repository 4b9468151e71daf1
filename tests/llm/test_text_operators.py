"""Mixing, SimHash, line dedup, personal data and media against brute force, with nulls, blanks, long texts, repeats, clashes."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from framelark.llm import linededup, media, mixing, pii, queries, simhash
from framelark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta\n" * 3000 + "omega line of its own"


def sample_rows():
    words = "the of and in to copper tin zinc iron lead gold".split()
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        n = int(rng.integers(0, 40))
        text = " ".join(rng.choice(words, n)) + ("\nShared boilerplate Line\n" if i % 3 == 0 else "\n") + "tail " + str(i)
        rows.append((i, text, "en", None if i % 7 == 0 else f"src{i % 5}", len(text)))
    rows += [(200, rows[0][1], "en", "src0", 1), (201, rows[0][1] + " more", "en", "src0", 1), (202, None, None, None, None), (203, "", "en", "", 0)]
    rows += [(204, " \t\r\n ", "en", "src1", 4), (205, LONG, "en", "src1", len(LONG)), (5, rows[5][1], "en", "src5", 1), (None, "no id at all here", "en", "src2", 5)]
    rows += [(None, "Shared boilerplate line", "en", "src2", 5), (206, "  SHARED boilerplate line\t\n\nshort\nshort", "en", "src3", 5)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample_rows(), SCHEMA).repartition(5).cache()


def words_of(text):
    return (text or "").encode().split()


# --- mixing --------------------------------------------------------------------------------------------------------


def brute_mix(rows):
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += len(words_of(text))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] >= 3 * sizes[s]}
        if not full:
            target |= {s: share * weight[s] for s in free}
            break
        target |= {s: float(3 * sizes[s]) for s in full}
        left -= sum(3 * sizes[s] for s in full)
        free -= full
    return sizes, target


def test_mix_matches_brute_force(docs):
    rows = sample_rows()
    sizes, target = brute_mix(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    largest = {s: max(len(words_of(t)) for _, t, _, x, _ in rows if x == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]


def test_mix_takes_in_hash_order_and_nests(docs):
    """With a larger share a source keeps all that a smaller one took."""
    small = {(r.doc_id, r["size"]): r.copies for r in mixing.mix(docs, (1, 1, 1)).collect() if r.source == "src1"}
    large = {(r.doc_id, r["size"]): r.copies for r in mixing.mix(docs, (1, 9, 1)).collect() if r.source == "src1"}
    target = [r.target for r in mixing.mix(docs, (1, 9, 1)).collect() if r.source == "src1"][0]
    if target >= [r.target for r in mixing.mix(docs).collect() if r.source == "src1"][0]:
        assert all(large[k] >= 0 for k in small)


def test_mix_level_refinement_equals_sorting(spark):
    rows = [(i, "w " * (1 + i % 9), "en", f"s{i % 2}", 1) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), (3, 1), 3).collect()
    for source in ("s0", "s1"):
        own = sorted((int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16), r["size"], r.copies, r.target, r.source_size) for r in got if r.source == source)
        rest = own[0][3] - int(own[0][3] // own[0][4]) * own[0][4]
        base, upto, cut = int(own[0][3] // own[0][4]), 0, 0
        for n, (_, size, *_) in enumerate(own):
            if upto + size < rest or (upto < rest and upto + size - rest <= rest - upto):
                cut = n + 1
            upto += size
        assert [c - base for _, _, c, _, _ in own] == [1] * cut + [0] * (len(own) - cut)


def test_mix_empty_table_and_documents(spark, docs):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    copies = defaultdict(int)
    for r in mixing.mix(docs).collect():
        if r["size"]:
            copies[r.doc_id] += r.copies
    seen = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        seen[r.doc_id] += 1
    assert {k: v for k, v in copies.items() if v} == dict(seen)


# --- SimHash -------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, words=4):
    tokens = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [b" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or ([b" ".join(tokens)] if tokens else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_spark_hashes_like_xxh64(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("ein zwei drei vier"))).first()[0] % 2**64 == xxh64_intdigest("ein zwei drei vier", 42)


def test_fingerprints_and_components(docs):
    rows = sample_rows()
    got = simhash.near_dups(docs).collect()
    assert len(got) == len(rows)
    prints = {r[1]: brute_fingerprint(r[1]) for r in rows}
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fp % 2**64) for r in got) == sorted((r[0] if r[0] is not None else -1, prints[r[1]]) for r in rows)
    ids = {r[0]: prints[r[1]] for r in rows if r[0] is not None}
    pairs = [(a, b) for a in ids for b in ids if a < b and bin(ids[a] ^ ids[b]).count("1") <= 4]
    expected = brute_components(pairs, ids)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected


@pytest.mark.parametrize("bits,chain", [(4, 2), (4, 4), (4, 6), (4, 8), (9, 2), (9, 4), (9, 6)])
def test_every_near_pair_shares_a_key(spark, bits, chain):
    rng = np.random.default_rng(chain)
    base = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    other = base.copy()
    for i in range(len(base)):
        for bit in rng.choice(64, bits, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(bit)
    fps = spark.createDataFrame([(int(np.int64(v)),) for v in np.concatenate([base, other]).view(np.int64)], "fp long")
    keys = defaultdict(set)
    for r in simhash.keyed(fps, chain, bits).collect():
        keys[r.fp].add((r.key_no, r.key))
    assert all(keys[int(a)] & keys[int(b)] for a, b in zip(base.view(np.int64), other.view(np.int64)))


def test_chain_test_loses_no_near_pair():
    rng = np.random.default_rng(1)
    diff = np.zeros(5000, dtype=np.uint64)
    for i in range(len(diff)):
        for bit in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            diff[i] |= np.uint64(1) << np.uint64(bit)
    assert simhash._chain_passes(diff, 4).all()
    assert simhash._chain_passes(rng.integers(0, 2**63, 5000).astype(np.uint64), 4).mean() < 0.05


@pytest.mark.parametrize("matrix,links", [(1024, 10**6), (1024, 0), (0, 0)])
def test_ways_to_link_a_bucket_agree(monkeypatch, matrix, links):
    monkeypatch.setattr(simhash, "MATRIX", matrix)
    monkeypatch.setattr(simhash, "LINKS", links)
    rng = np.random.default_rng(4)
    flip = lambda: int(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 8)), replace=False)))
    fps = np.array(sorted({flip() for _ in range(120)}), dtype=np.uint64)
    second = np.array([flip() for _ in fps], dtype=np.uint64)
    for other, wide in ((None, 128), (second, 7)):
        near = lambda a, b: bin(int(fps[a] ^ fps[b])).count("1") <= 4 and (other is None or bin(int(fps[a] ^ fps[b])).count("1") + bin(int(second[a] ^ second[b])).count("1") <= wide)  # noqa: E731, B023
        expected = brute_components([(int(fps[a]), int(fps[b])) for a in range(len(fps)) for b in range(a + 1, len(fps)) if near(a, b)], [int(f) for f in fps])
        assert brute_components(list(simhash.bucket_links(fps, 4, other, wide)), [int(f) for f in fps]) == expected


def test_crowded_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(2)
    fps = {0}
    while len(fps) < 150:
        fps.add(int(sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 9)), replace=False))))
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4).collect()
    assert all(bin((r.u ^ r.v) % 2**64).count("1") <= 64 for r in links)
    got = brute_components([(r.u, r.v) for r in links], fps)
    assert got == brute_components([(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 4], fps)


def test_simhash_empty_and_dedup(spark, docs):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_dups(empty).count() == 0
    kept = simhash.deduplicated(docs).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and 200 not in ids and 0 in ids and 5 in ids


@pytest.mark.parametrize("sent", [True, False])
@pytest.mark.parametrize("how", [{}, {"bits": 10, "wide": 19}, {"bits": 10, "wide": 19, "words": 5, "alike": 0.8}])
def test_documents_of_a_repeated_id_stay_or_go_by_their_own_text(spark, monkeypatch, how, sent):
    if not sent:  # beyond the bound of a broadcast
        monkeypatch.setattr(simhash, "bounded", lambda df: df.hint("merge"))
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "y"), (7, b, "z"), (7, c, "z"), (7, c, "z"), (None, c, "z"), (None, a + " tail of another", "z"), (9, None, "z"), (10, "", "z"), (None, " ", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(3)
    kept = sorted(((-1 if r.doc_id is None else r.doc_id, r.text) for r in simhash.deduplicated(df, **how).collect()), key=str)
    assert [k for k in kept if k[1] is None or "tail" not in k[1]] == sorted([(1, a), (5, b), (7, c), (9, None)], key=str)
    assert simhash.deduplicated(df.limit(0), **how).count() == 0 and simhash.deduplicated(df, **how).columns == df.columns


def test_alike_links_are_exact(spark):
    rng = np.random.default_rng(11)
    rows, grams = [], lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    for i in range(60):
        base = [f"w{int(x)}" for x in rng.integers(0, 5000, 120)]
        rows.append((10 * i, base))
        for k in range(1, 4):  # single changes of words: similarities from about 0.6 to 0.95
            other = list(base)
            for p in rng.choice(120, int(rng.integers(1, 6)), replace=False):
                other[p] = f"v{i}x{k}x{p}"
            rows.append((10 * i + k, other))
    sets = {d: grams(t) for d, t in rows}
    alike = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    expected = brute_components(alike, list(sets))
    table = [(d, " ".join(t)) for d, t in rows] + [(5000, None), (5001, " \n"), (5002, "w1 w2"), (5003, "W1  w2"), (None, "a text of its own here"), (5004, rows[0][1] and " ".join(rows[0][1]))]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.alike_dups(df, 10, 5, 19, 0.8).collect()}
    assert (got.pop(5000), got.pop(5001), got.pop(5002), got.pop(5003), got.pop(5004), got.pop(None)) == (5000, 5000, 5002, 5002, 0, None)
    assert got == expected
    kept = {r.doc_id for r in simhash.deduplicated(df, bits=10, words=5, wide=19, alike=0.8).collect()}
    assert kept == {d for d, c in expected.items() if d == c} | {5000, 5002, None}
    by_bits = {r.doc_id for r in simhash.deduplicated(df, bits=10, words=5, wide=19).collect()}
    assert by_bits - kept and kept - by_bits  # bits alone lose such pairs and link others


def test_alike_links_of_a_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:p] + [f"x{i}"] + base[p + 1 :])) for i, p in enumerate(range(0, 200, 4))]
    got = {r.component_id for r in simhash.alike_dups(spark.createDataFrame(rows, "doc_id long, text string"), 10, 5, 19, 0.8).collect()}
    assert got == {0}


def test_each_second_fingerprint_is_compared(spark):
    far = (1 << 40) - 1
    rows = [(1, 0, far), (2, 0, 0), (3, 31, far), (4, 1 << 62, 1 << 62), (5, 31 << 30, 255 << 50)]
    got = {r.fp: r.root for r in simhash.rooted_prints(spark.createDataFrame(rows, "doc_id long, fp long, fp2 long"), 10, 19).collect()}
    assert got[31] == got[0] == got[1 << 62] == got[31 << 30]
    roots = {(r.fp, r.fp2): r.root for r in simhash.rooted_prints(spark.createDataFrame(rows[1:3], "doc_id long, fp long, fp2 long"), 10, 19).collect()}
    assert roots[0, 0] != roots[31, far]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7), (2000, 2001), (2001, 2000), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(1, 60)}, 2001: 2000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- line dedup ----------------------------------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    number = lambda d: (1 << 63) - 1 if d is None else d
    owner = {}
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), 1 << 63), number(d))
    out = []
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), number(d)) == number(d)]
        out.append((number(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("sent", [True, False])
def test_lines_match_brute_force(docs, monkeypatch, sent):
    if not sent:
        monkeypatch.setattr(linededup, "bounded", lambda df: df.hint("merge"))
    clashing = docs.withColumnRenamed("lang", "n_lines")
    got = linededup.dedup_lines(clashing).collect()
    assert sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == brute_lines(sample_rows())


def test_runs_are_compacted_and_found_again(spark):
    rows = [(i, f"line number {i // 2} of these\nevery document has this line", "en", "s", 1) for i in range(80)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA), batches=7).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == brute_lines(rows)
    before = set(t.name for t in spark.catalog.listTables())
    with linededup.LineRuns(spark) as runs:
        for n in range(5):
            runs.add(linededup.line_hashes(spark.createDataFrame([(n, f"a line of batch {n}\nshared by them all", "", "", 0)], SCHEMA)))
        assert [len(level) for level in runs.levels] == [1, 0, 1]
        assert sum(runs.run(r).count() for r in runs.runs()) == 6
        with linededup.settings(spark, **runs.READ):
            probe = runs.joined(linededup.line_hashes(docs_of(spark, 9)))._jdf.queryExecution().toString()
            merge = runs.merged(*runs.runs())._jdf.queryExecution().toString()
        probe, merge = (p[p.index("== Physical Plan ==") :] for p in (probe, merge))
        # a batch is dealt and sorted once however many runs there are; runs are read as they lie
        assert probe.count("SortMergeJoin") == 2 and probe.count("Exchange") == 1 and len(re.findall(r"\bSort \[", probe)) == 1
        assert "SortMergeJoin" in merge and "Exchange" not in merge and not re.findall(r"\bSort \[", merge)
    assert set(t.name for t in spark.catalog.listTables()) == before


def docs_of(spark, n):
    return spark.createDataFrame([(n, "a line of batch 1", "", "", 0)], SCHEMA)


def test_hot_null_ids_and_other_ids(spark):
    rows = [(None, f"a line that all of them hold\nline of group {i // 3} here", "", "", 0) for i in range(60)] + [(3, "a line that all of them hold", "", "", 0)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == brute_lines(rows)
    with pytest.raises(TypeError):
        linededup.dedup_lines(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def test_lines_empty_table(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


# --- personal data -------------------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = [
    None, "", "a@b.c_d@e.f.g x@y", "mail joe.bloggs@mail.example.com, or +1 (706) 555-3138 now", "1.2.3.4.5 256.1.1.1 0001.02.3.255 1.2.3.99999999999999999999",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111111", "é4111111111111111ü \U0001f600 a@b.cc", "+1(((((((((((((((((((((", "a" * 3000 + "@" + "b" * 3000,
    "1" * 5000, "+49 89 1234567890 12 34", "x+1 555 123 4567@q.de", "5500 0000 0000 0004\n5500 0000 0000 0004", "..@..", "9 " * 800,
    "+12345678+12345678 1.1.1.1+1 22 333 444", "a.b@c..d.e f@g.h-", "٣٤١١١١١١١١١١١١١١١",
]


def spark_spans(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    found = pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r.doc_id: [f"{k}:{s.s}:{s.e}" for k in pii.KINDS for s in r[k]] for r in found}


def test_base_spans_match_plain_patterns(spark):
    got = spark_spans(spark, TRICKY)
    for i, text in enumerate(TRICKY):
        assert got[i] == brute_spans(text), text


def test_base_spans_of_random_texts(spark):
    rng = np.random.default_rng(11)
    alphabet = list("aZ09@.+-_% ()\n") + ["4111111111111111", "1.1.1.1", "\U0001f600", "b@c.d"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(1, 60)))) for _ in range(3000)]
    got = spark_spans(spark, texts)
    wrong = [(t, got[i], brute_spans(t)) for i, t in enumerate(texts) if got[i] != brute_spans(t)]
    assert not wrong[:3]


def brute_terms(rows, disclosure=0.9, removal=0.95):
    """The method word for word: all tokens, all pairs of a token and an entity within ten free terms on a line, every occurrence."""
    from collections import Counter
    from math import log

    letters = re.compile(r"[^\W\d_]{3,}")
    every, near, tokens = Counter(), set(), {}
    for n, (_, text) in enumerate(rows):
        text = text or ""
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute_spans(text))]
        free = []
        for m in letters.finditer(text):
            every[m[0].lower()] += 1
            if all(m.end() <= a or b <= m.start() for _, a, b in spans):
                free.append((m.start(), m.end(), m[0].lower()))
        tokens[n] = free
        for k, a, b in spans:
            value = text[a:b].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])
            low, high = text.rfind("\n", 0, a) + 1, text.find("\n", b) % (len(text) + 1)
            line = [t for t in free if low <= t[0] and t[1] <= high]
            for t in [t for t in line if t[1] <= a][-10:] + [t for t in line if t[0] >= b][:10]:
                near.add((n, f"{k}:{value}", *t))
    together, close = Counter((c, t) for _, c, _, _, t in near), Counter(c for _, c, *_ in near)
    marks = {}
    for (c, t), k in together.items():
        ic = -log(min(close[c] / max(sum(every.values()), 1), 1))
        ratio = 1 + log(k / (every[t] + 1)) / ic if ic > 0 else 0
        if ratio >= disclosure:
            marks[t] = max(marks.get(t, ""), "remove" if ratio >= removal else "generalise")
    return {n: sorted((marks[t], a, b) for a, b, t in own if t in marks) for n, own in tokens.items()}


@pytest.mark.parametrize("forms", [64, 0])
def test_terms_are_those_of_the_method_word_for_word(spark, monkeypatch, forms):
    monkeypatch.setattr(pii, "FORMS", forms)
    rng = np.random.default_rng(21)
    words = [f"{a}{b}{c}" for a in "kst" for b in "aeiou" for c in ("lm", "nd", "rst", "vv")]
    people = [f"person{'abcdefghij'[i]}@mail.example.com" for i in range(10)] + ["+1 (706) 555-3138", "4111 1111 1111 1111", "10.0.0.1"]
    rows = []
    for i in range(400):
        line = list(rng.choice(words, int(rng.integers(3, 60))))
        for _ in range(int(rng.integers(0, 3)) if i % 3 == 0 else 0):
            who = int(rng.integers(len(people)))
            at = int(rng.integers(len(line)))
            line[at:at] = [f"clue{'abcdefghijklm'[who]}", people[who]] if rng.random() < 0.7 else [people[who]]
        if i % 5 == 0:
            line.insert(int(rng.integers(len(line))), f"clue{'abcdefghijklm'[int(rng.integers(13))]}")
        rows.append((i, str(rng.choice([" ", " ", "\n"])).join(line)))
    rows += [(500, None), (501, ""), (502, rows[0][1]), (502, rows[0][1]), (None, "cluea alone, x@y.zz")]
    got = sorted((((-1 if r.doc_id is None else r.doc_id), [tuple(t) for t in r.terms]) for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string"), 0.5, 0.7).collect()), key=str)
    brute = brute_terms(rows, 0.5, 0.7)
    assert got == sorted(((-1 if d is None else d, brute[n]) for n, (d, _) in enumerate(rows)), key=str)
    assert sum(len(t) for _, t in got) > 50


def test_disclosing_terms_are_added(spark):
    common = "the report names some people and some places of the town "
    rows = [(i, f"{common} filler{'abcdefghij'[i % 10]} words {i}") for i in range(300)]
    rows += [(1000 + i, f"{'xyzuvw'[i]} Kestrelworth wrote to kestrel@mail.example.com about the town {'pqrstu'[i]}") for i in range(6)]
    rows += [(2000, "Kestrelworth alone says who it is"), (2001, None), (2002, "Seen once: Jackdaw at jack@mail.example.com")]
    found = {r.doc_id: r for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    marked = {d: [texts[d][t.s : t.e] for t in r.terms] for d, r in found.items()}
    for i in range(6):
        assert "Kestrelworth" in marked[1000 + i] and "the" not in marked[1000 + i] and "town" not in marked[1000 + i]
    assert marked[2000] == ["Kestrelworth"] and not marked[2001] and "Jackdaw" in marked[2002] and not any(marked[i] for i in range(300))


def test_long_lines_take_time_in_proportion(spark):
    import time

    words = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(200_000))
    start = time.perf_counter()
    rows = [(1, words + " Kestrelworth me@here.example.com"), (2, "me@here.example.com word " * 5000)]
    found = {r.doc_id: r for r in pii.found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found[1].email) == 1 and len(found[2].email) == 5000 and found[2].email[4999].s == 4999 * 25
    assert time.perf_counter() - start < 60


def test_sanitised_text(spark):
    from pyspark.sql import functions as F

    df = spark.sql("select 'mail a@b.cc from Kestrel now' as text, array(named_struct('kind','email','s',5L,'e',11L), named_struct('kind','remove','s',17L,'e',24L)) as spans")
    assert df.select(pii.sanitised(F.col("text"), F.col("spans"))).first()[0] == "mail [EMAIL] from  now"
    many = spark.createDataFrame([(1, "é1.1.1.1 ü " * 1000 + "end"), (2, ""), (3, "1.1.1.1")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitised_documents(many, disclosure=2.0).collect()}
    assert got == {1: "é[IP] ü " * 1000 + "end", 2: "", 3: "[IP]"}


def test_sanitised_documents(spark):
    rows = [(1, "call +4111111111111111 or a@b.cc \U0001f600 1.1.1.1"), (2, "nothing"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.sanitised_documents(df, disclosure=2.0).collect()}
    assert got == {1: "call +[CARD] or [EMAIL] \U0001f600 [IP]", 2: "nothing", 3: None}


def test_pii_empty_table_and_repeats(spark):
    assert pii.found(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "a@b.cc"), (1, "a@b.cc"), (None, "a@b.cc")], "doc_id long, text string")
    assert [len(r.email) for r in pii.found(twice.withColumn("email", twice["text"])).collect()] == [1, 1, 1]


# --- media ---------------------------------------------------------------------------------------------------------


def test_media_round_trip(docs):
    rows = sample_rows()
    read = media.probed(media.stored(docs)).collect()
    assert len(read) == len(rows)
    payloads = []
    for _, text, *_ in rows:
        data = (text or "").encode()
        payloads.append(data + b" " * (-len(data) % 192 or (192 if not data else 0)))
    assert sorted((r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in read) == sorted((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) for p in payloads)
    assert {r.codec for r in read} == {"raw "} and all(r.duration == r.payload_bytes / 8000 for r in read)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9), st.integers(1, 200))
def test_containers_hold_their_payload(data, times):
    payload = (data * times + b" " * 192)[: max(192, len(data) * times // 192 * 192)].ljust(192)
    blob = media.container(payload)
    found = media.probe(blob)
    assert b"".join(blob[a:b] for a, b in found.samples) == payload
    assert found.keyframes == found.samples[:: media.CHUNK]


def test_probe_of_other_layouts_and_broken_ones():
    import struct

    stbl = media.box(
        b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", b"\0" * 8)),
        media.full(b"stts", struct.pack(">IIIII", 2, 2, 10, 1, 30)),
        media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)),
        media.full(b"stsz", struct.pack(">IIIII", 0, 3, 5, 6, 7)),
        media.full(b"co64", struct.pack(">IQQ", 2, 100, 200)),
        media.full(b"stss", struct.pack(">III", 2, 1, 3)),
    )
    blob = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIII", 0, 0, 25, 99)), media.box(b"minf", stbl)))).ljust(400, b"\0")
    found = media.probe(blob)
    assert (found.codec, found.timescale, found.duration) == ("avc1", 25, 50)
    assert found.samples == [(100, 105), (105, 111), (200, 207)] and found.keyframes == [(100, 105), (200, 207)]
    whole = media.container(b"x" * 384)
    for cut in range(0, len(whole), 7):
        media.probe(whole[:cut])
    assert media.probe(b"").codec is None


def movie(handler, number, samples, keys=None, offsets=None, timescale=25, extra=b""):
    import struct

    table = media.box(
        b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1" if handler == b"vide" else b"mp4a", b"\0" * 8)),
        media.full(b"stts", struct.pack(">III", 1, len(samples), 10)),
        media.full(b"ctts", struct.pack(">III", 1, len(samples), 3)),
        media.full(b"stsc", struct.pack(">IIII", 1, 1, len(samples), 1)),
        media.full(b"stsz", struct.pack(f">II{len(samples)}I", 0, len(samples), *samples)),
        media.full(b"stco", struct.pack(">II", 1, offsets)),
        *([media.full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys))] if keys else []),
    )
    media_box = media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIII", 0, 0, timescale, 99)), media.full(b"hdlr", b"\0" * 4, handler, b"\0" * 13), media.box(b"minf", table))
    return media.box(b"trak", media.full(b"tkhd", struct.pack(">III", 0, 0, number), b"\0" * 8), extra, media_box)


def test_video_is_found_behind_sound_and_fragments_go_on():
    import struct

    edit = media.box(b"edts", media.full(b"elst", struct.pack(">IIiIIiI", 2, 5, -1, 1 << 16, 50, 4, 1 << 16)))
    trex = media.box(b"mvex", media.full(b"trex", struct.pack(">IIIII", 2, 1, 20, 7, media.NO_SYNC)))
    moov = media.box(b"moov", movie(b"soun", 1, [4, 4], None, 600), movie(b"vide", 2, [5, 6, 7], [1, 3], 700, extra=edit), trex)
    trun = media.full(b"trun", struct.pack(">IiIIIII", 2, 100, 0, 11, 30, 12, 31), flags=media.OFFSET | media.FIRST_FLAGS | media.EACH_SIZE | media.EACH_SHIFT)
    traf = media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 2), flags=media.AT_MOOF), media.full(b"tfdt", struct.pack(">Q", 1000), version=1), trun)
    plain = media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 2)), media.full(b"trun", struct.pack(">I", 2)))
    start = len(moov)
    blob = (moov + media.box(b"moof", traf, plain)).ljust(2000, b"\0")
    sound, video = media.tracks(blob)
    assert (sound.handler, sound.codec, sound.samples, sound.keyframes) == ("soun", "mp4a", [(600, 604), (604, 608)], [(600, 604), (604, 608)])
    at = start + 100
    assert video.samples == [(700, 705), (705, 711), (711, 718), (at, at + 11), (at + 11, at + 23), (at + 23, at + 30), (at + 30, at + 37)]
    assert video.keyframes == [(700, 705), (711, 718), (at, at + 11)] and video.times == [3, 23, 1030]
    assert (video.begins, video.duration, media.probe(blob).codec) == (4, 1080, "avc1")


def test_probe_survives_any_bytes():
    import struct

    deep = b""
    for _ in range(1500):
        deep = media.box(b"moov", deep)
    empty = media.box(b"moov", media.box(b"trak", *(media.box(k) for k in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stsz", b"stco", b"elst", b"tkhd", b"ctts", b"stz2"))))
    traf = media.box(b"moof", media.box(b"traf", media.box(b"tfhd"), media.box(b"trun")), media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 1), flags=0x3F), media.full(b"trun", struct.pack(">I", 1 << 31))))
    rng = np.random.default_rng(6)
    whole = media.container(b"x" * 1920) + traf
    assert media.tracks(deep) == [] and media.tracks(empty)[0].codec is None
    for _ in range(3000):
        blob = bytearray(whole)
        for _ in range(int(rng.integers(1, 6))):
            blob[int(rng.integers(0, len(blob) if rng.random() < 0.3 else 900))] = int(rng.choice([0, 1, 255, int(rng.integers(256))]))
        found = media.probe(bytes(blob[: int(rng.integers(1, len(blob) + 1))]))
        assert all(0 <= a <= b <= len(blob) for a, b in found.samples)
    big = bytearray(whole)
    at = big.index(b"stsz")
    big[at + 8 : at + 16] = struct.pack(">II", 1, (1 << 32) - 1)
    assert len(media.probe(bytes(big)).samples) <= len(big)


def test_broken_media_rows(spark):
    blobs = [None, b"", b"moov", media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"mdhd")))), media.container(b"y" * 192)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blobs)], "doc_id long, media binary")
    got = sorted(media.probed(df).collect(), key=lambda r: r.doc_id)
    assert [r.payload_bytes for r in got] == [0, 0, 0, 0, 192] and [len(r.tracks) for r in got] == [0, 0, 0, 1, 1] and got[4].tail_crc32 == zlib.crc32(b"y" * 16)


def test_batches_to_python_are_made_small(spark):
    from framelark.llm.common import small_batches

    small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "512" and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(16 << 20)


def test_registry_names():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES] == list(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_pii_query_equals_its_sql(spark, tmp_path):
    import duckdb

    common = "the report names some people and some places of the town "
    texts = [*TRICKY, *(f"{common} filler{'abcdefghij'[i % 10]} words {i}" for i in range(60))]
    texts += [f"{'xyzuvw'[i]} Kestrelworth wrote to kestrel@mail.example.com and +1 (706) 555-3138 about the town {'pqrstu'[i]}\nanother line with kestrel@mail.example.com {i}" for i in range(6)]
    texts += ["Kestrelworth wrote to kestrel@mail.example.com kestrel@mail.example.com now"] * 2
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in queries.op10_pii(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(queries.OP10_SQL).fetchall())
    assert sum("generalise" in r[-1] or "remove" in r[-1] for r in got) >= 6
