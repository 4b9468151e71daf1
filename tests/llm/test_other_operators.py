"""URL filters, quality, licenses, packing, embeddings and the pipeline against brute force or held-out accuracy."""

import importlib.util
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framelark.llm import embedding, licenses, packing, quality, simhash, urlfilter
from framelark.llm.urlfilter import Rule

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# --- URL filters ---------------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://a.net", "http://A.NET/", "https://x.Example.NET/en/1?q=/de/", "https://example.net/en", "ftp://notexample.net/en/x", "http://example.com/de/",
    "http://example.com/de", "http://sub.sub.example.com/de/a#b", "http://org/fr/", "http://a.org/fr/x/y", "http://a.org/frx", "http://net", "http://user@a.net:80/x", "x://y://z.net/",
    "http://example.net.evil.com/en/", "//a.net/", "http://a.net\n/x", "http://.net/", "http://a..net/", "http://ünï.net/é?x", "http://a.net/" + "s/" * 5000,
    "http://ab.c/def", "http://q.ab.c/def", "http://z.ab.c/d/e/f", "http://z.ab.c/d/", "http://net/x//y", "http://net/x/y",
]
MORE = (
    Rule("allow", "net/a"), Rule("block", "net/a"), Rule("block", "deep.a.net/x/y"), Rule("allow", "a.net/x/"), Rule("allow", "org"), Rule("block", "b.org"),
    # of equal length: another host and path, and the longer host
    Rule("block", "ab.c/"), Rule("allow", "c/def"), Rule("allow", "z.ab.c/d/"), Rule("block", "ab.c/d/e/"), Rule("allow", ".net/"), Rule("block", "net/x//"),
)


def brute_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)


def parts(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:end], rest[end:]
    return "".join(c.lower() if c.isascii() else c for c in host), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


@pytest.mark.parametrize("rules", [urlfilter.RULES, urlfilter.RULES + MORE])
@pytest.mark.parametrize("how", ["trie", "joined", "table", "large table"])
def test_urls_match_brute_force(spark, monkeypatch, rules, how):
    if how in ("joined", "large table"):
        monkeypatch.setattr(urlfilter, "TRIE_RULES", 0)
    given = rules if "table" not in how else spark.createDataFrame([(r.verdict, r.text) for r in rules] + [(None, "net/"), ("block", None)], "verdict string, text string")
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in urlfilter.judged(df, given).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parts(url)
        rule = brute_rule(host, path, rules)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule and rule.text, rule.verdict if rule else "allow"), url
    assert urlfilter.judged(df.limit(0), given).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["block", "allow"]), st.lists(st.sampled_from(["a", "b", "ab", ""]), min_size=1, max_size=3), st.lists(st.sampled_from(["", "x", "xy", "x/y"]), max_size=3)), max_size=12), st.text("ab.", max_size=6), st.text("xy/", max_size=7))
def test_trie_equals_plain_search(rules, host, path):
    rules = [Rule(v, ".".join(h) + "".join("/" + p for p in ps)) for v, h, ps in rules]
    path = "/" + path if path else ""
    assert urlfilter.Trie(rules).match(host, path) == brute_rule(host, path, rules)


def test_a_host_of_very_many_rules_costs_a_url_no_more():
    import time

    trie = urlfilter.Trie([Rule("block", f"a.net/p{i}") for i in range(100_000)])
    start = time.perf_counter()
    for i in range(2000):
        assert trie.match("www.a.net", f"/p{i}x/y/z").text == f"a.net/p{i}"
    assert time.perf_counter() - start < 2


# --- quality -------------------------------------------------------------------------------------------------------


def test_quality_learns_and_holds(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    known = [(r.quality, got[r.doc_id]) for r in labels.collect()]
    assert np.mean([q == r.predicted for q, r in known]) > 0.95
    kept = {r.doc_id for r in quality.accepted(docs, labels).collect()}
    assert kept == {d for d, r in got.items() if r.predicted}


def test_quality_equals_a_plain_discriminant(spark, sf):
    """Scores against quadratic discriminant analysis written out in NumPy, with labels and folds joined by hand."""
    import zlib

    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet").collect() for n in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels}
    raw = {r.doc_id: quality.statistics(r.text) for r in docs}
    train = [d for d in raw if d in known and zlib.crc32(str(d).encode()) % 4 != 2]
    n = {d: len((r.text or "").encode().split()) for d, r in ((r.doc_id, r) for r in docs)}
    good = [d for d in train if known[d] == 1]
    prose = sum(n[d] * raw[d] for d in good) / sum(n[d] for d in good)
    x = {d: np.array([v[0], *((n[d] * v + 20 * prose) / (n[d] + 20))[1:]]) for d, v in raw.items()}
    scale = np.std([x[d] for d in train], axis=0)
    scale[scale**2 <= 1e-12] = 1
    logs = {}
    for c in (0, 1):
        own = np.array([x[d] / scale for d in train if known[d] == c])
        cov = np.cov(own.T, bias=True)
        cov = 0.9 * cov + 0.1 * max(cov.trace() / len(cov), 1e-3) * np.eye(len(cov))
        for d in x:
            apart = x[d] / scale - own.mean(axis=0)
            logs[d, c] = np.log(len(own) / len(train)) - 0.5 * (apart @ np.linalg.solve(cov, apart) + np.linalg.slogdet(cov)[1])
    got = {r.doc_id: r.score for r in quality.score(*(spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))).collect()}
    for d in x:
        assert got[d] == pytest.approx(1 / (1 + np.exp(np.clip(logs[d, 0] - logs[d, 1], -700, 700))), abs=1e-6), d


def test_held_out_rows_teach_nothing(spark):
    import zlib

    rows = [(i, ("good words in a row " * 5) + str(i) if i % 3 else "!!! ### $$$ %%% " * 9, "en", "s", 1) for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS)
    right = [(i, int(i % 3 > 0)) for i in range(90)]
    wrong = [(i, q if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - q) for i, q in right]
    scores = [{r.doc_id: (r.held_out, round(r.score, 9)) for r in quality.score(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (right, wrong)]
    assert scores[0] == scores[1]
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, (h, _) in scores[0].items())


def test_quality_edge_cases(spark):
    rows = [(1, None, "en", "s", 1), (2, "", "en", "s", 1), (None, "plain words here", "en", "s", 1), (4, " \n ", "en", "s", 1), (4, "x" * 200_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("quality", simhash.F.lit(9))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, none).collect()] == [0.5] * 5
    ones = spark.createDataFrame([(1, 1), (1, 1), (2, None)], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, ones).collect()] == [1.0] * 5
    assert quality.score(docs.limit(0), ones).count() == 0


# --- licenses ------------------------------------------------------------------------------------------------------


def test_license_spans(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-text"]
    edited = gpl.replace("redistribute it", "pass it on").replace("published", "issued")
    texts = [
        f"Some prose first.\n{mit}\nMore.", mit.upper(), f"é {mit} and {gpl}", edited, gpl[: len(gpl) // 2], "permission is granted to nobody", None, "", mit + " " + mit,
        "word " * 30000 + licenses.TEMPLATES["reserved"],
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    found = defaultdict(list)
    for r in licenses.scanned(df).collect():
        found[r.doc_id].append((r.license, texts[r.doc_id][r.start : r.end], round(r.coverage, 3)))
    assert found[0] == [("MIT", mit[:-1], 1.0)] and found[1] == [("MIT", mit.upper()[:-1], 1.0)]
    assert sorted(found[2]) == [("GPL-text", gpl[:-1], 1.0), ("MIT", mit[:-1], 1.0)]
    assert [x[0] for x in found[3]] == ["GPL-text"] and 0.8 <= found[3][0][2] < 1
    assert not found[4] and not found[5] and not found[6] and not found[7]
    assert len(found[8]) == 2 and found[9] == [("reserved", "All rights reserved", 1.0)]
    assert licenses.scanned(df.limit(0)).count() == 0


@pytest.mark.parametrize("room", [12, 60])
def test_many_templates_are_scanned_in_passes(spark, monkeypatch, room):
    whole = licenses.TEMPLATES["MIT-whole"].split()
    templates = licenses.TEMPLATES | {"a nested one": " ".join(whole[:24]), "b nested one": " ".join(whole[3:40])}
    texts = [" and ".join(templates[k] for k in ("MIT", "Apache-2.0", "reserved")), "so " + templates["MIT-whole"], templates["GPL-3.0-header"] + " x " + templates["ISC-whole"], " ".join(whole[:24]), None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0]), (0, texts[1])], "doc_id long, text string")
    once = sorted(map(tuple, licenses.scanned(df, templates).collect()), key=str)
    monkeypatch.setattr(licenses, "TEMPLATE_WORDS", room)
    assert sorted(map(tuple, licenses.scanned(df, templates).collect()), key=str) == once
    assert [r[1] for r in once if r[0] == 1] == ["MIT-whole"] and [r[1] for r in once if r[0] == 3] == ["a nested one"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), min_size=3, max_size=14), st.lists(st.integers(0, 13), max_size=3), st.lists(st.sampled_from("xyz"), max_size=4))
def test_alignment_is_the_longest_common_subsequence(template, dropped, noise):
    words = noise + [w for i, w in enumerate(template) if i not in dropped] + noise
    if not words:
        return
    own, other = (np.array([ord(w) for w in x], dtype=np.uint64) for x in (template, words))
    matched, start, end = licenses.align(own, other, len(noise))
    assert matched == lcs(template, words)
    if matched:
        assert words[start] in template and words[end - 1] in template and lcs(template, words[start:end]) == matched


def test_candidates_miss_little_of_what_alignments_everywhere_find():
    """Every template aligned at every word of corrupted texts, against what the winnowed fingerprints let through."""
    rng = np.random.default_rng(12)
    index, words = licenses.Index(licenses.TEMPLATES), licenses.Words()
    there = caught = 0
    for n in range(150):
        name = sorted(licenses.TEMPLATES)[n % len(licenses.TEMPLATES)]
        own = [w for w in licenses._WORD.findall(licenses.TEMPLATES[name])]
        for i in range(len(own)):
            if rng.random() < 0.12:
                own[i] = f"odd{rng.integers(100)}"
        for i in sorted(rng.integers(0, len(own), len(own) // 20).tolist(), reverse=True):
            own.insert(i, "more")
        text = " ".join(f"w{x}" for x in rng.integers(0, 50, 20)) + " " + " ".join(own) + " end of it"
        hashes = words.hashes([w.lower() for w in licenses._WORD.findall(text)])
        found = {f[0] for f in index.scan(text, words, 0.8)}
        for t, template in index.templates:
            slack = min(max(licenses.BAND, len(template) // 16), len(template) // 3)
            best = max(licenses.align(template, hashes, first, slack)[0] for first in range(0, len(hashes), max(1, slack)))
            if best >= 0.8 * len(template):
                there += 1
                caught += t in found
    assert there > 100 and caught >= 0.9 * there, (caught, there)
    print(f"license candidates: {caught} of {there}")


def test_scan_of_a_text_of_very_many_notices_is_linear():
    import time

    index, words = licenses.Index(licenses.TEMPLATES), licenses.Words()
    start = time.perf_counter()
    found = licenses.chosen(index.scan(licenses.TEMPLATES["reserved"] * 1 + (" " + licenses.TEMPLATES["MIT"]) * 5000, words, 0.8))
    assert len(found) == 5001 and time.perf_counter() - start < 20


# --- packing -------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_bins_hold_their_contents(pieces):
    placed = packing.pack(pieces, (8, 16, 64))
    bins = defaultdict(list)
    for size, (b, offset, length) in zip(pieces, placed):
        bins[b, length].append((offset, offset + size))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, length), spans in bins.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert length == min(c for c in (8, 16, 64) if c >= spans[-1][1])


def naive_pack(pieces, lengths):
    """Best fit as its definition says it: every open bin is tried for each piece, longest first."""
    bins, out, left = [], [None] * len(pieces), sum(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i], i)):
        fits = [(b["length"] - b["used"], n) for n, b in enumerate(bins) if b["length"] - b["used"] >= pieces[i]]
        if fits:
            b = bins[min(fits)[1]]
        else:
            length = min((c for c in lengths if c >= pieces[i]), key=lambda c: (packing.cost(c) / max(min(c, left), 1), c))
            b = {"length": length, "used": 0, "n": len(bins)}
            bins.append(b)
        b.setdefault("n", bins.index(b))
        out[i] = (b["n"], b["used"])
        b["used"] += pieces[i]
        left -= pieces[i]
    return [(b, at, min(c for c in lengths if c >= bins[b]["used"])) for b, at in out]


def best_cost(pieces, lengths):
    """The least cost of any way to pack, by trying all."""
    from functools import cache

    @cache
    def go(rest):
        if not rest:
            return 0.0
        first, others = rest[0], rest[1:]
        found = []
        for mask in range(1 << len(others)):
            own = first + sum(x for i, x in enumerate(others) if mask >> i & 1)
            if own <= max(lengths):
                found.append(packing.cost(min(c for c in lengths if c >= own)) + go(tuple(x for i, x in enumerate(others) if not mask >> i & 1)))
        return min(found)

    return go(tuple(sorted(pieces)))


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40))
def test_packing_is_best_fit(pieces):
    assert packing.pack(pieces, (8, 16, 64)) == naive_pack(pieces, (8, 16, 64))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=7))
def test_packing_is_near_the_best_of_all_ways(pieces):
    placed = packing.pack(pieces, (8, 16, 64))
    mine = sum(packing.cost(length) for length in {b: length for b, _, length in placed}.values())
    assert mine <= 2 * best_cost(pieces, (8, 16, 64)) + 1e-9


def test_groups_are_of_pieces_and_layout_does_not_matter(spark):
    rows = [(i, "w " * 30 if i % 9 else "w " * 4000, "en", "s", 1) for i in range(60)] + [(7, "same row", "en", "s", 1)] * 40 + [(None, f"nameless {i}", "en", "s", 1) for i in range(20)]
    df = spark.createDataFrame(rows, DOCS)
    kinds = [sorted(map(tuple, packing.packed(d, (8, 64), group=16).collect()), key=str) for d in (df.coalesce(1), df.repartition(7))]
    plain = [[r for r in k if r[0] != 7] for k in kinds]
    assert plain[0] and len(kinds[0]) == len(kinds[1]) == sum(max(1, -(-len(t.split()) // 64)) for _, t, *_ in rows)
    few = [sorted(map(tuple, packing.packed(d, (8, 64), group=64).collect()), key=str) for d in (df.coalesce(1), df.repartition(7))]
    assert few[0] == few[1]
    sizes = defaultdict(int)
    for r in kinds[0]:
        sizes[r[4] >> 32] += 1
    assert max(sizes.values()) <= 64  # a group is of 16 pieces or so, also of a repeated row and of long documents


def test_packed_query_equals_a_plain_pack(spark, sf):
    """The rows of the query against the naive best fit of each of its groups, in the order of the groups' hashes."""
    from framelark.llm import queries

    got = queries.op8_packing(spark, sf).collect()
    docs = {r.doc_id: len((r.text or "").encode().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    per_doc, groups = defaultdict(int), defaultdict(list)
    for r in got:
        per_doc[r.doc_id] += r.n_tokens
        if r.bin_id is not None:
            groups[r.bin_id >> 32].append(r)
    assert dict(per_doc) == docs
    for rows in groups.values():
        bins = defaultdict(list)
        for r in rows:
            bins[r.bin_id].append(r)
        mine = sum(packing.cost(b[0].bin_length) for b in bins.values())
        sizes = [r.n_tokens for r in rows]
        naive = sum(packing.cost(length) for length in {b: length for b, _, length in naive_pack(sizes, packing.LENGTHS)}.values())
        assert abs(mine - naive) <= 0.01 * naive  # ties of equal sizes may fall otherwise
        for b in bins.values():
            spans = sorted((r.bin_offset, r.bin_offset + r.n_tokens) for r in b)
            assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and b[0].bin_length == min(c for c in packing.LENGTHS if c >= spans[-1][1])


def test_packing_is_tight():
    rng = np.random.default_rng(3)
    pieces = np.minimum(rng.lognormal(5.5, 1.2, 4000).astype(int) + 1, 8192).tolist()
    placed = packing.pack(pieces)
    total = sum({b: length for b, _, length in placed}.values())
    assert sum(pieces) / total > 0.97


def test_packed_documents(spark):
    sizes = [0, 1, 511, 512, 513, 8192, 8193, 30000, 7, 7, 7]
    rows = [(i if i < 9 else 8, "w " * n, "en", "s", 1) for i, n in enumerate(sizes)] + [(None, "a b c", "en", "s", 1), (99, None, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("piece", simhash.F.lit("x")).repartition(3)
    got = packing.packed(df, group=5).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for d, n in list(enumerate(sizes))[:8]:
        own = sorted(by_doc[d], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in own) == n and [r.start for r in own] == [8192 * i for i in range(len(own))]
    assert len(by_doc[8]) == 3 and by_doc[99][0].bin_id is None and by_doc[0][0].bin_id is None
    bins = defaultdict(list)
    for r in got:
        if r.bin_id is not None:
            bins[r.bin_id, r.bin_length].append((r.bin_offset, r.bin_offset + r.n_tokens))
    for (_, length), spans in bins.items():
        spans.sort()
        assert length in packing.LENGTHS and spans[-1][1] <= length and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert packing.packed(df.limit(0)).count() == 0


# --- embeddings ----------------------------------------------------------------------------------------------------


def brute_links(vectors):
    x = {}
    for i, v in vectors:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            a = np.array(v, dtype=float) / max(abs(c) for c in v)
            x.setdefault(i, []).append(a / np.linalg.norm(a))
    return x


@pytest.mark.parametrize("cells,block", [(1, 8 << 20), (7, 8 << 20), (5, 16 * 48), (None, 8 << 20)])
def test_embeddings_match_brute_force(spark, monkeypatch, cells, block):
    monkeypatch.setattr(embedding, "BLOCK_BYTES", block)
    monkeypatch.setattr(embedding, "CELL", 20)
    rng = np.random.default_rng(cells or 9)
    base = rng.normal(size=(60, 6))
    rows = [(i, (base[i % 60] + rng.normal(size=6) * rng.choice([0, 0.1, 0.3])).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(400, None), (401, [0.0] * 6), (402, [float("nan")] + [1.0] * 5), (403, [None] + [1.0] * 5), (404, []), (None, rows[0][1]), (405, [1e300] * 6), (406, [1e-300] * 6)]
    rows += [(500 + i, rng.normal(size=3).tolist()) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("kept", simhash.F.lit(1))
    got = {r.vec_id: r for r in embedding.near_dups(df, 0.9, cells).collect() if r.vec_id is not None}
    x = brute_links(rows)
    ids = sorted(x)
    links = {i: [j for j in ids if j != i and len(x[i][0]) == len(x[j][0]) and x[i][0] @ x[j][0] >= 0.9] for i in ids}
    parent = {i: i for i in [r[0] for r in rows if r[0] is not None]}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min([parent[i]] + [parent[j] for j in links[i]])
            if low < parent[i]:
                parent[i], changed = low, True
    assert len(got) == len(parent)
    for i, p in parent.items():
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, [])), p, p == i), i


def test_smaller_reach_loses_few_links(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 48))
    rows = [(i, (base[i % 300] + rng.normal(size=48) * 0.3).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {r.vec_id: r.n_links for r in embedding.near_dups(df, 0.9, 16).collect()}
    part = {r.vec_id: r.n_links for r in embedding.near_dups(df, 0.9, 16, reach=0.5).collect()}
    assert all(part[i] <= whole[i] for i in whole) and sum(part.values()) >= 0.95 * sum(whole.values()) > 0


def test_embeddings_empty_and_invalid(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding.near_dups(spark.createDataFrame([], schema)).count() == 0
    bad = embedding.near_dups(spark.createDataFrame([(1, None), (2, [0.0])], schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in bad) == [(1, 0, 1, True), (2, 0, 2, True)]


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages_match_brute_force(spark, sf):
    import corpus_pipeline
    from tests.llm.test_text_operators import brute_fingerprint, brute_lines, brute_mix, words_of

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality classifier"](spark, docs, sf).cache()
    assert kept.columns == columns
    accepted = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == accepted

    lines = stages["line dedup"](spark, kept, sf).cache()
    assert lines.columns == columns
    rows = [tuple(r) for r in kept.collect()]
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == [(d, t) for d, _, _, t in brute_lines(rows)]
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = stages["SimHash near-dedup"](spark, lines, sf).cache()
    assert near.columns == columns
    texts = {r.doc_id: r.text for r in lines.collect()}
    sets = {d: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if (t := words_of(x.translate({c: c + 32 for c in range(65, 91)}))) else set() for d, x in texts.items()}
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    assert {r.doc_id for r in near.collect()} == {d for d, g in group.items() if d == g}

    mixed = stages["mixing sources"](spark, near, sf).cache()
    assert mixed.columns == columns
    sizes, target = brute_mix([tuple(r) for r in near.collect()])
    taken, largest = defaultdict(int), defaultdict(int)
    for r in mixed.collect():
        taken[r.source] += len(words_of(r.text))
    for r in near.collect():
        largest[r.source] = max(largest[r.source], len(words_of(r.text)))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)

    packed = stages["best-fit packing"](spark, mixed, sf)
    pieces = sorted((r.doc_id, i, min(8192, n - 8192 * i)) for r in mixed.collect() for n in [len(words_of(r.text))] for i in range(max(1, -(-n // 8192))))
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in packed.collect()) == pieces
    bins = defaultdict(list)
    for r in packed.collect():
        bins[r.bin_id, r.bin_length].append((r.bin_offset, r.bin_offset + r.n_tokens))
    naive = naive_pack([n for *_, n in pieces], packing.LENGTHS)
    assert sum(length for _, length in bins) <= 1.05 * sum({b: length for b, _, length in naive}.values())
    for (_, length), spans in bins.items():
        spans.sort()
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and length == min(c for c in packing.LENGTHS if c >= spans[-1][1])

    # run() gives the rows that the stages give one after the other
    columns = packed.columns
    assert sorted(map(str, corpus_pipeline.run(spark, sf).select(*columns).collect())) == sorted(map(str, packed.collect()))
