"""Media columns: ISO base media containers, written and probed without decoding payloads.

``container`` stores bytes as 8-bit PCM samples of a sound track. ``tracks`` walks the nested boxes and decodes the sample
tables (stts, ctts, stsc, stsz or stz2, stco or co64, stss, elst) of every track and the fragments (moof, traf, tfhd, tfdt, trun,
with the defaults of mvex and trex) that go on with it: codec, duration, and the byte ranges of its sync samples. ``probe`` gives the
first video track, without one the first track.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Bytes of a sample of the track, samples of a chunk (its first is a sync sample), and bytes a second.
SAMPLE, CHUNK, RATE = 192, 32, 8000
#: Boxes that hold boxes; how deep they may stand in each other.
PARENTS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"udta", b"moof", b"traf")
DEPTH = 16


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)
    return struct.pack(">I4s", size, kind) + b"".join(parts)


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of the text, and its bytes with blanks up to a positive multiple of SAMPLE."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (SAMPLE - len(data) if not data else -len(data) % SAMPLE)


def container(payload: bytes) -> bytes:
    """A file of one sound track whose samples are SAMPLE payload bytes each; the same bytes give the same file."""
    n = len(payload) // SAMPLE
    chunks = -(-n // CHUNK)
    matrix = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    runs = [(1, CHUNK if n >= CHUNK else n, 1)] + ([(chunks, n % CHUNK, 1)] if n > CHUNK and n % CHUNK else [])
    head = box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  ", b"isom")

    def moov(first: int) -> bytes:
        offsets = [first + i * CHUNK * SAMPLE for i in range(chunks)]
        wide = bool(offsets) and offsets[-1] >= 1 << 32
        table = full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            full(b"stss", struct.pack(f">I{chunks}I", chunks, *(1 + i * CHUNK for i in range(chunks)))),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            table,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        long = lambda kind, *parts: full(kind, *parts, version=1)
        media = box(
            b"mdia",
            long(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, len(payload), 0x55C4, 0)),
            full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"\0"),
            box(b"minf", full(b"smhd", b"\0" * 4), dinf, stbl),
        )
        track = long(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), b"\0" * 8, struct.pack(">hhhh", 0, 0, 0x100, 0), matrix, b"\0" * 8)
        movie = long(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, len(payload), 1 << 16, 0x100), b"\0" * 10, matrix, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", movie, box(b"trak", track, media))

    before = len(head) + len(moov(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return head + moov(before) + box(b"mdat", payload)


def boxes(data, start: int = 0, end: int | None = None):
    """``path, first, last``: the path of kinds and the content range of each box, parents before their children.

    A header that is cut off or reaches beyond its parent ends its parent; boxes deeper than DEPTH are not opened.
    """
    open_boxes = [((), start, len(data) if end is None else end)]
    while open_boxes:
        path, at, last = open_boxes.pop()
        if at + 8 > last:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        header = 8
        if size == 1:
            if at + 16 > last:
                continue
            size, header = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = last - at
        if size < header or at + size > last:
            continue
        own = (*path, kind)
        yield own, at + header, at + size
        open_boxes.append((path, at + size, last))
        if kind in PARENTS and len(own) < DEPTH:
            open_boxes.append((own, at + header, at + size))


@dataclass
class Track:
    """What the tables of a track say; times in ticks of ``timescale``, ranges ``(first byte, byte after the last)``."""

    number: int = 0
    handler: str | None = None
    codec: str | None = None
    timescale: int = 0
    duration: int = 0
    #: Ticks of the media at which the presentation begins, of the first edit that shows media; None without one.
    begins: int | None = None
    samples: list = field(default_factory=list)
    keyframes: list = field(default_factory=list)
    #: Presentation time of each keyframe.
    times: list = field(default_factory=list)
    #: Bytes of all samples.
    size: int = 0


class _Tables:
    """The boxes within one parent, by kind, and readers that take nothing beyond a box."""

    def __init__(self, data):
        self.data, self.of = data, {}

    def __contains__(self, kind: bytes) -> bool:
        return kind in self.of

    def read(self, kind: bytes, fmt: str, at: int = 4):
        """The numbers at a place of a box; None if it lacks them."""
        first, last = self.of.get(kind, (0, 0))
        return struct.unpack_from(">" + fmt, self.data, first + at) if first + at + struct.calcsize(">" + fmt) <= last else None

    def version(self, kind: bytes) -> tuple[int, int]:
        found = self.read(kind, "I", 0)
        return (found[0] >> 24, found[0] & 0xFFFFFF) if found else (0, 0)

    def rows(self, kind: bytes, fmt: str, at: int = 4) -> list:
        """The entries of a table whose count stands at ``at``."""
        count = self.read(kind, "I", at)
        if count is None:
            return []
        first, last = self.of[kind][0] + at + 4, self.of[kind][1]
        each = struct.calcsize(">" + fmt)
        count = min(count[0], (last - first) // each)
        return [x if len(x) > 1 else x[0] for x in struct.iter_unpack(">" + fmt, bytes(self.data[first : first + count * each]))]


def _sizes(tables: _Tables) -> tuple[int, list | None]:
    """Number of samples, and their sizes unless they have ``constant`` size: ``(n, sizes)`` with sizes a list or the constant."""
    if found := tables.read(b"stsz", "II"):
        constant, n = found
        if constant:
            return n, constant
        sizes = tables.rows(b"stsz", "I", 8)
        return len(sizes), sizes
    if found := tables.read(b"stz2", "I"):
        bits = found[0] & 0xFF
        if bits in (8, 16):
            sizes = tables.rows(b"stz2", "B" if bits == 8 else "H", 8)
            return len(sizes), sizes
        if bits == 4:
            n = (tables.read(b"stz2", "I", 8) or (0,))[0]
            first, last = tables.of[b"stz2"]
            halves = [h for x in bytes(tables.data[first + 12 : last]) for h in (x >> 4, x & 15)][:n]
            return len(halves), halves
    return 0, []


class _Times:
    """The value of each sample in runs of ``(count, value)``, asked for in order."""

    def __init__(self, runs):
        self.runs, self.left, self.value = iter(runs), 0, 0

    def next(self, default: int = 0) -> int:
        while not self.left:
            run = next(self.runs, None)
            if run is None:
                return default
            self.left, self.value = run
        self.left -= 1
        return self.value


def _sampled(track: Track, tables: _Tables) -> int:
    """Fill in the samples of the tables; returns the decode time after them."""
    data, (total, sizes) = tables.data, _sizes(tables)
    offsets = tables.rows(b"stco", "I") or tables.rows(b"co64", "Q")
    runs = tables.rows(b"stsc", "III")
    spans = tables.rows(b"stts", "II")
    each, shift = _Times(spans), _Times(tables.rows(b"ctts", "Ii" if tables.version(b"ctts")[0] else "II"))
    keys = set(tables.rows(b"stss", "I")) if b"stss" in tables else None
    run, time = -1, 0
    for chunk, offset in enumerate(offsets, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= chunk:
            run += 1
        for _ in range(runs[run][1] if run >= 0 else 0):
            at = len(track.samples)
            if at >= total or offset + (size := sizes if isinstance(sizes, int) else sizes[at]) > len(data) or track.size + size > len(data):
                break
            track.size += size
            track.samples.append((offset, offset + size))
            shown = time + shift.next()
            time += each.next()
            if keys is None or at + 1 in keys:
                track.keyframes.append((offset, offset + size))
                track.times.append(shown)
            offset += size
    return sum(n * ticks for n, ticks in spans)


#: Flags of a fragment's headers, and the bit of a sample's flags that says it is no sync sample.
BASE, DESCRIPTION, DURATION, SIZE, FLAGS, AT_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
OFFSET, FIRST_FLAGS, EACH_DURATION, EACH_SIZE, EACH_FLAGS, EACH_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NO_SYNC = 0x10000


def _fragment(track: Track, defaults: tuple, data, moof: int, header: tuple, runs: list, time: int, after: int) -> tuple[int, int]:
    """Add the samples of one track fragment; returns the decode time and the byte after them. ``after``: where data go on if nothing says where they lie."""
    tables = _Tables(data)
    tables.of[b"tfhd"] = header
    _, flags = tables.version(b"tfhd")
    at, own, start = 8, dict(zip((DURATION, SIZE, FLAGS), defaults)), moof if flags & AT_MOOF else after
    for flag, fmt in ((BASE, "Q"), (DESCRIPTION, "I"), (DURATION, "I"), (SIZE, "I"), (FLAGS, "I")):
        if flags & flag:
            found = tables.read(b"tfhd", fmt, at)
            if found is None:
                return time, after
            at += struct.calcsize(">" + fmt)
            if flag == BASE:
                start = found[0]
            elif flag in own:
                own[flag] = found[0]
    offset = start
    for place in runs:
        tables.of[b"trun"] = place
        version, flags = tables.version(b"trun")
        count, at, first_flags = tables.read(b"trun", "I"), 8, None
        if count is None:
            continue
        if flags & OFFSET and (found := tables.read(b"trun", "i", at)):
            offset, at = start + found[0], at + 4
        if flags & FIRST_FLAGS and (found := tables.read(b"trun", "I", at)):
            first_flags, at = found[0], at + 4
        wanted = [(f, "i" if f == EACH_SHIFT and version else "I") for f in (EACH_DURATION, EACH_SIZE, EACH_FLAGS, EACH_SHIFT) if flags & f]
        each = 4 * len(wanted)
        first, last = place[0] + at, place[1]
        n = min(count[0], (last - first) // each) if each else count[0]
        for i in range(n):
            values = dict(zip((f for f, _ in wanted), struct.unpack_from(">" + "".join(fmt for _, fmt in wanted), data, first + i * each))) if each else {}
            size = values.get(EACH_SIZE, own[SIZE])
            if offset < 0 or offset + size > len(data) or track.size + size > len(data) or (not size and not each):
                break
            track.size += size
            marks = values.get(EACH_FLAGS, first_flags if not i and first_flags is not None else own[FLAGS])
            track.samples.append((offset, offset + size))
            if not marks & NO_SYNC:
                track.keyframes.append((offset, offset + size))
                track.times.append(time + values.get(EACH_SHIFT, 0))
            offset += size
            time += values.get(EACH_DURATION, own[DURATION])
    return time, offset


def tracks(data) -> list[Track]:
    """Every track of a container, in its order; what is missing or cut off stays empty, whatever the bytes are.

    A track's samples end where their sizes together would exceed the container, so broken tables cost no more than it.
    """
    found, defaults, times, tables = [], {}, {}, None
    fragment, moof, after = None, 0, 0
    parts: list[tuple] = []
    for path, first, last in boxes(data):
        kind = path[-1]
        if path == (b"moov", b"trak"):
            tables = _Tables(data)
            parts.append(("track", tables))
        elif path[:2] == (b"moov", b"trak") and tables is not None:
            tables.of.setdefault(kind, (first, last))
        elif path == (b"moov", b"mvex", b"trex"):
            if last - first >= 24:
                number, _, *own = struct.unpack_from(">5I", data, first + 4)
                defaults[number] = tuple(own)
        elif path == (b"moof",):
            moof = first - (16 if bytes(data[max(0, first - 16) : first - 8]) == b"\0\0\0\1moof" else 8)
            parts.append(("moof", moof))
        elif path == (b"moof", b"traf"):
            fragment = {"moof": moof, "tfhd": None, "tfdt": None, "runs": []}
            parts.append(("traf", fragment))
        elif path[:2] == (b"moof", b"traf") and fragment is not None and len(path) == 3:
            if kind == b"trun":
                fragment["runs"].append((first, last))
            elif kind in (b"tfhd", b"tfdt"):
                fragment[kind.decode()] = (first, last)
    for what, part in parts:
        if what == "track":
            found.append(_track(part))
            times[found[-1].number] = found[-1].duration
        elif what == "moof":
            after = part
        elif part["tfhd"] and part["tfhd"][1] - part["tfhd"][0] >= 8:
            number = struct.unpack_from(">I", data, part["tfhd"][0] + 4)[0]
            track = next((t for t in found if t.number == number), None)
            if track is None:
                continue
            head = _Tables(data)
            head.of[b"tfdt"] = part["tfdt"] or (0, 0)
            start = head.read(b"tfdt", "Q" if head.version(b"tfdt")[0] else "I") if part["tfdt"] else None
            time = start[0] if start else times[number]
            times[number], after = _fragment(track, defaults.get(number, (0, 0, 0)), data, part["moof"], part["tfhd"], part["runs"], time, after)
            track.duration = max(track.duration, times[number])
    return found


def _track(tables: _Tables) -> Track:
    track = Track()
    if found := tables.read(b"tkhd", "I", 20 if tables.version(b"tkhd")[0] == 1 else 12):
        track.number = found[0]
    if found := tables.read(b"hdlr", "4s", 8):
        track.handler = found[0].decode("latin-1")
    if found := tables.read(b"stsd", "4s", 12):
        track.codec = found[0].decode("latin-1")
    long = tables.version(b"mdhd")[0] == 1
    if found := tables.read(b"mdhd", "IQ" if long else "II", 20 if long else 12):
        track.timescale, track.duration = found
    edits = tables.rows(b"elst", "QqI" if tables.version(b"elst")[0] == 1 else "IiI")
    track.begins = next((media for _, media, _ in edits if media >= 0), None)
    track.duration = _sampled(track, tables) or track.duration
    return track


def probe(data) -> Track:
    """The first video track, without one the first track; an empty one if the container has none."""
    found = tracks(data)
    return next((t for t in found if t.handler == "vide"), found[0] if found else Track())


def feature(found: Track) -> str:
    """Codec, duration in ticks and timescale, number of samples, and the byte ranges of keyframes."""
    ranges = ",".join(f"{a}-{b}" for a, b in found.keyframes)
    return f"codec={found.codec};duration={found.duration}/{found.timescale};samples={len(found.samples)};keyframes={ranges}"


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text in a container. Null text: as the empty one, one sample of blanks."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                both = [padded(t) for t in part.column(1).to_pylist()]
                media = pa.array([container(p) for _, p in both], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in both], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


PROBED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration double, keyframes array<struct<first:long,last:long>>, feature string, tracks array<struct<number:long,handler:string,codec:string,duration:double,begins:double,samples:long,keyframes:array<struct<first:long,last:long,seconds:double>>>>"


def probed(media: DataFrame, column: str = "media") -> DataFrame:
    """media with ``column`` replaced by what its container says: see PROBED; other columns stay.

    payload_*: of the samples of the probed track read back in order; tail_crc32 of their last 16 bytes; duration in seconds; ``tracks``:
    every track. Null or broken containers: no samples, codec null, payload of no bytes. Equal containers give equal values. Empty tables give no rows.
    """
    @F.pandas_udf(PROBED)
    def read(blobs: pd.Series) -> pd.DataFrame:
        rows = []
        for blob in blobs:
            blob = memoryview(blob or b"")
            every = tracks(blob)
            found = next((t for t in every if t.handler == "vide"), every[0] if every else Track())
            digest, size, tail = hashlib.sha256(), 0, b""
            for a, b in found.samples:  # samples may lie over each other, so they are not gathered
                digest.update(blob[a:b])
                size, tail = size + b - a, (tail + bytes(blob[max(a, b - 16) : b]))[-16:]
            rows.append((
                size, digest.hexdigest(), zlib.crc32(tail), len(blob), hashlib.sha256(blob).hexdigest(),
                found.codec, _seconds(found.duration, found), [{"first": a, "last": b} for a, b in found.keyframes], feature(found), [_row(t) for t in every],
            ))
        return pd.DataFrame(rows, columns=_COLUMNS)

    rest = [F.col(f"`{c}`") for c in media.columns if c != column]
    return media.select(*rest, read(F.col(column)).alias("_fl_probe")).select(*rest, "_fl_probe.*")


_COLUMNS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "duration", "keyframes", "feature", "tracks"]


def _seconds(ticks: int | None, track: Track) -> float | None:
    return ticks / track.timescale if track.timescale and ticks is not None else None


def _row(track: Track) -> dict:
    frames = [{"first": a, "last": b, "seconds": _seconds(t, track)} for (a, b), t in zip(track.keyframes, track.times)]
    return {"number": track.number, "handler": track.handler, "codec": track.codec, "duration": _seconds(track.duration, track), "begins": _seconds(track.begins, track), "samples": len(track.samples), "keyframes": frames}
