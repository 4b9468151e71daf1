"""License scans: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment reports matches.

Words are lower-cased and stripped of punctuation. Of the hashes of word pairs the least of every window of WINDOW is
kept, in templates and documents alike, so a common run of three words or more shares a fingerprint. Hits near one
diagonal make a candidate, and an alignment of the whole template within a band around it counts the matched words.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches
from .license_texts import TEMPLATES

#: Words of a gram, grams of a window, least half width of the alignment's band, words of all templates that may be broadcast.
GRAM, WINDOW, BAND, TEMPLATE_WORDS = 2, 2, 6, 2_000_000

_WORD = re.compile(r"[^\s\W_]+(?:[.'-][^\s\W_]+)*", re.UNICODE)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """64-bit hashes of words, by a cache that is emptied when it grows beyond a bound."""

    def __init__(self, limit: int = 500_000):
        self.cache, self.limit = {}, limit

    def hashes(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        if len(self.cache) > self.limit:
            self.cache = {}
        cache = self.cache
        for w in set(words).difference(cache):
            cache[w] = xxh64_intdigest(w.encode())
        return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(hashes: np.ndarray) -> np.ndarray:
    """A hash for every run of GRAM words; one of the whole for a shorter text."""
    n = max(len(hashes) - GRAM + 1, min(len(hashes), 1))
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(GRAM, len(hashes))):
            out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[i : i + n]
        return (out ^ (out >> np.uint64(32))) * _MIX


def winnow(values: np.ndarray) -> np.ndarray:
    """Positions kept: the least hash of each window of WINDOW, the last of equal ones."""
    if len(values) <= WINDOW:
        return np.array([len(values) - 1 - int(np.argmin(values[::-1]))]) if len(values) else np.zeros(0, dtype=np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(values, WINDOW)[:, ::-1]
    return np.unique(np.arange(WINDOW - 1, len(values)) - np.argmin(windows, axis=1))


#: Bits of a position within a band, as the alignment packs them beside the number of matches.
_POSITION = 20
_LAST = (1 << _POSITION) - 1


def align(template: np.ndarray, words: np.ndarray, first: int, slack: int = BAND) -> tuple[int, int, int]:
    """``matched, start, end`` of the best alignment of the template with words near ``first``, its expected first word; both are arrays of hashes.

    Longest common subsequence within the band; of alignments with as many matches, the one that starts first and then ends first.
    A cell of the band packs (matches, how early it starts, how early it ends) into one number, so that its maximum is the best way.
    """
    low, width = first - slack, 2 * slack + 1
    at = np.arange(len(template) + width - 1)
    there = (at + low >= 0) & (at + low < len(words))
    near = np.where(there, words[np.clip(at + low, 0, len(words) - 1)], np.uint64(0))
    same = (np.lib.stride_tricks.sliding_window_view(near, width) == template[:, None]) & np.lib.stride_tricks.sliding_window_view(there, width)
    early = _LAST - at
    before = np.zeros(width + 1, dtype=np.int64)
    for i in range(len(template)):
        best = before[1:].copy()  # the template's word skipped: the same document word was the next cell of the row before
        hit = np.flatnonzero(same[i])
        if len(hit):
            way, end = before[hit], early[i + hit]
            start = np.where(way, (way >> _POSITION) & _LAST, end)
            best[hit] = np.maximum(best[hit], (((way >> 2 * _POSITION) + 1) << 2 * _POSITION) | (start << _POSITION) | end)
        before[:-1] = np.maximum.accumulate(best)
        before[-1] = 0
    way = int(before.max())
    if not way:
        return 0, 0, 0
    return way >> 2 * _POSITION, low + _LAST - (way >> _POSITION & _LAST), low + _LAST - (way & _LAST) + 1


def chosen(found: list[tuple]) -> list[tuple]:
    """Of ``(license, matched, coverage, start, end, first word, word after the last)``, those that overlap none that comes before: by most words, least span, first, name."""
    starts, kept = [], []
    for match in sorted(found, key=lambda f: (-f[1], f[6] - f[5], f[5], f[0])):
        at = bisect_left(starts, match[5])
        if (not at or kept[at - 1][6] <= match[5]) and (at == len(starts) or match[6] <= starts[at]):
            starts.insert(at, match[5])
            kept.insert(at, match)
    return kept


class Index:
    def __init__(self, templates: dict[str, str]):
        words = Words()
        self.templates = [(name, words.hashes(found)) for name, text in sorted(templates.items()) if (found := [w.lower() for w in _WORD.findall(text)])]
        postings: dict[int, list] = {}
        self.sizes = []
        for t, (_, tokens) in enumerate(self.templates):
            values = grams(tokens)
            kept = winnow(values)
            self.sizes.append(len(kept))
            for p in kept.tolist():
                postings.setdefault(int(values[p]), []).append((t, p))
        self.postings = postings
        self.keys = np.array(sorted(postings), dtype=np.uint64)

    def scan(self, text: str | None, words: Words, coverage: float) -> list[tuple]:
        """``license, matched, coverage, start, end, first, last`` of each match, overlapping ones too: ``end`` exclusive, in code points of the whole text, and the same in words."""
        tokens = [w.lower() for w in _WORD.findall(text)] if text else []
        if not tokens or not len(self.keys):
            return []
        hashes = words.hashes(tokens)
        values = grams(hashes)
        at = winnow(values)
        least = values[at]
        place = np.minimum(np.searchsorted(self.keys, least), len(self.keys) - 1)
        hits = at[self.keys[place] == least].tolist()
        if not hits:
            return []
        diagonals: dict[int, list[int]] = {}
        for p in hits:
            for t, q in self.postings[int(values[p])]:
                diagonals.setdefault(t, []).append(p - q)
        found = []
        for t, own in diagonals.items():
            name, template = self.templates[t]
            own.sort()
            needed = max(1, int(0.3 * self.sizes[t]))
            spread = min(max(BAND, len(template) // 16), len(template) // 3)  # so that a short template's repeats are candidates of their own
            i = 0
            while i < len(own):
                j = i
                while j + 1 < len(own) and own[j + 1] - own[i] <= spread:
                    j += 1
                if j - i + 1 >= needed:
                    matched, start, end = align(template, hashes, own[i], spread)
                    if matched >= coverage * len(template):
                        found.append((name, matched, matched / len(template), start, end))
                    i = j + 1
                else:
                    i += 1
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        return [(name, matched, share, spans[start][0], spans[end - 1][1], start, end) for name, matched, share, start, end in found]


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """``doc_id, license, matched_words, coverage, start, end``: a row for each span of a document that a template covers.

    Coverage is the share of the template's words that the alignment matches, in order. Offsets are code points of the
    whole text. Documents without a match, null and empty ones give no rows; repeated rows give
    theirs again. Of overlapping matches the one with most words is reported; a tie goes to the shorter, then to the
    earlier, then by name. Extra columns are ignored. More than TEMPLATE_WORDS words of templates are scanned in several passes, whose
    indexes are broadcast apart; overlaps are settled among the matches of all passes, so the rows are the same.
    """
    parts: list[dict[str, str]] = [{}]
    room = TEMPLATE_WORDS
    for name, text in sorted(templates.items()):
        room -= len(text.split())
        if room < 0 and parts[-1]:
            parts.append({})
            room = TEMPLATE_WORDS - len(text.split())
        parts[-1][name] = text
    kind = docs.schema["doc_id"].dataType.simpleString()
    if len(parts) == 1:
        return _scanned(docs.select("doc_id", "text"), templates, coverage, chosen).select("doc_id", *NAMES[:5])
    keyed = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"))
    found = None
    for part in parts:
        one = saved(_scanned(keyed.dropDuplicates(["doc_id", "digest"]), part, coverage, lambda f: f), "license-pass")
        found = one if found is None else found.unionByName(one)

    def settle(table):
        import pyarrow as pa

        rows = chosen(list(zip(*(table.column(c).to_pylist() for c in NAMES))))
        both = [pa.array([table.column(c)[0].as_py()] * len(rows), table.schema.field(c).type) for c in ("doc_id", "digest")]
        return pa.table(both + [pa.array([r[i] for r in rows], t) for i, t in enumerate(_types())], ["doc_id", "digest", *NAMES])

    settled = found.groupBy("doc_id", "digest").applyInArrow(settle, f"doc_id {kind}, digest binary, {KINDS}")
    times = keyed.groupBy("doc_id", "digest").agg(F.count("*").cast("int").alias("times")).withColumnsRenamed({"doc_id": "_fl_id", "digest": "_fl_of"})
    again = settled.join(times, F.col("doc_id").eqNullSafe(F.col("_fl_id")) & (F.col("digest") == F.col("_fl_of")))
    return again.withColumn("_fl_n", F.explode(F.sequence(F.lit(1), "times"))).select("doc_id", *NAMES[:5])


NAMES = ("license", "matched_words", "coverage", "start", "end", "first", "last")
KINDS = "license string, matched_words long, coverage double, start long, end long, first long, last long"


def _types() -> list:
    import pyarrow as pa

    return [pa.string(), pa.int64(), pa.float64(), *[pa.int64()] * 4]


def _scanned(docs: DataFrame, templates: dict[str, str], coverage: float, settle) -> DataFrame:
    """The columns of docs but the text, and ``settle`` of the matches of each row."""
    index = docs.sparkSession.sparkContext.broadcast(Index(templates))
    keys = [c for c in docs.columns if c != "text"]

    def run(batches):
        import pyarrow as pa

        words = Words()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            rows = [(i, *m) for i, t in enumerate(texts) for m in settle(index.value.scan(t, words, coverage))]
            if rows:
                at, *columns = zip(*rows)
                own = batch.select(keys).take(pa.array(at)).columns
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, _types()))], [*keys, *NAMES])

    small_batches(docs.sparkSession)
    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{kinds}, {KINDS}")
