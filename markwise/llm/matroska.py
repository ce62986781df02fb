"""Media columns: Matroska files in a binary column.

mux() stores a payload losslessly as 8-bit PCM in a Matroska file; demux() parses variable-length EBML elements, tracks,
clusters, lacing and cues into a packet table with timestamps, tracks and byte ranges.

Nulls: a null text counts as an empty one (64 zero bytes of payload); a null file gives no packets, a damaged one raises.
Rows are independent, so ties and repeated rows don't matter; an empty table gives an empty result. A very long text is one file,
held whole in one task. Extra columns, whatever their names, don't matter and don't come back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, small_batches, utf8

# Element ids of the Matroska format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C, 0xE1
SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xB5, 0x9F, 0x6264, 0x23E383
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
BLOCK_DURATION, REFERENCE_BLOCK = 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: A cluster of unknown size ends where one of these begins.
_ABOVE_BLOCKS = frozenset((EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS))

#: Fixed value: the format's sampling frequency where a track names none.
DEFAULT_RATE = 8000.0
RATE = 8000
FRAME = 1024
LACED = 6
BLOCKS = 4
#: A tick of 125 microseconds: one sample at RATE.
TICK_NS = 1_000_000_000 // RATE


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def _vint(n: int) -> bytes:
    """The shortest size; all ones is kept for 'unknown'."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, body: bytes) -> bytes:
    return _id(kind) + _vint(len(body)) + body


def _uint(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed_vint(n: int) -> bytes:
    width = 1
    while not -(1 << 7 * width - 1) < n < 1 << 7 * width - 1:
        width += 1
    return ((n + (1 << 7 * width - 1) - 1) | 1 << 7 * width).to_bytes(width, "big")


def _lace(frames: list[bytes], xiph: bool) -> tuple[int, bytes]:
    """Lacing flags and the lacing head: none for one frame, fixed for equal sizes, else Xiph or EBML."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        return 0, b""
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return 0x04, head
    if xiph:
        return 0x02, head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    return 0x06, head + _vint(sizes[0]) + b"".join(_signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1], strict=False))


_HEAD = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ, 2))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _element(AUDIO, _element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """A Matroska file of one 8-bit PCM track, with laced blocks, clusters and cues."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = _element(INFO, _uint(TIMESTAMP_SCALE, TICK_NS) + _element(DURATION, struct.pack(">d", len(payload))) + _element(MUXING_APP, b"markwise") + _element(WRITING_APP, b"markwise"))
    body, cues = [info, _TRACKS], []
    at, tick = len(info) + len(_TRACKS), 0
    for c in range(0, len(frames), LACED * BLOCKS):
        start, cluster = tick, [_uint(CLUSTER_TIMESTAMP, tick)]
        for b in range(c, min(c + LACED * BLOCKS, len(frames)), LACED):
            laced = frames[b : b + LACED]
            flags, head = _lace(laced, b // LACED % 2 == 1)
            cluster.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", tick - start, 0x80 | flags) + head + b"".join(laced)))
            tick += sum(map(len, laced))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(_element(CLUSTER, b"".join(cluster)))
        at += len(body[-1])
    return _HEAD + _element(SEGMENT, b"".join(body) + _element(CUES, b"".join(cues)))


@dataclass
class Packet:
    track: int
    timestamp: int
    start: int
    size: int
    cluster: int
    block: int
    lacing: int
    keyframe: bool
    duration_ns: int


@dataclass
class Media:
    doc_type: str
    tick_ns: int
    duration: float
    tracks: dict[int, dict]
    packets: list[Packet]
    #: (time, track, byte offset of the cluster in the file)
    cues: list[tuple[int, int, int]]
    clusters: list[int]


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int | None, int]:
    """A variable-length number and the place after it; keep: with its marker, as in ids. Size 'unknown' is None."""
    first = data[at] if at < len(data) else 0
    if not first:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - first.bit_length()
    raw = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise ValueError("file ends in a variable-length number")
    if keep:
        return raw, at + width
    n = raw ^ 1 << 7 * width
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start and end of its body).

    An unknown size reaches to the parent's end; in a cluster, to the next element that can't be in a cluster.
    """
    while at < end:
        start = at
        kind, at = read_vint(data, at, keep=True)
        size, at = read_vint(data, at)
        stop = at + size if size is not None else _cluster_end(data, at, end) if kind == CLUSTER else end
        if stop > end:
            raise ValueError(f"element {kind:#x} at byte {start} is longer than its parent")
        yield kind, start, at, stop
        at = stop


def _cluster_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        kind, body = read_vint(data, at, keep=True)
        if kind in _ABOVE_BLOCKS:
            return at
        size, body = read_vint(data, body)
        if size is None:
            raise ValueError(f"element {kind:#x} at byte {at} of a cluster is of unknown size")
        at = body + size
    return end


def _laced_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    if not lacing:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            x, after = read_vint(data, at)
            size = x if i == 0 else sizes[-1] + x - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        sizes.append(size)
    return [*sizes, end - at - sum(sizes)], at


def demux(data: bytes) -> Media:
    """Parses a whole file."""
    out = Media("", 1_000_000, 0.0, {}, [], [], [])
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    real = lambda a, b: struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]
    for top, _, a, b in elements(data, 0, len(data)):
        if top == EBML:
            out.doc_type = next((data[x:y].decode() for k, _, x, y in elements(data, a, b) if k == DOC_TYPE), "")
        if top != SEGMENT:
            continue
        for kind, start, x, y in elements(data, a, b):
            if kind == INFO:
                for k, _, p, q in elements(data, x, y):
                    if k == TIMESTAMP_SCALE:
                        out.tick_ns = number(p, q)
                    elif k == DURATION:
                        out.duration = real(p, q)
            elif kind == TRACKS:
                for k, _, p, q in elements(data, x, y):
                    if k == TRACK_ENTRY:
                        _track(data, p, q, out, number, real)
            elif kind == CLUSTER:
                out.clusters.append(start)
                _cluster(data, x, y, out, number)
            elif kind == CUES:
                for k, _, p, q in elements(data, x, y):
                    if k == CUE_POINT:  # checksums and voids may stand beside them
                        out.cues.extend(_cues(data, p, q, a, number))
    return out


def _cues(data: bytes, p: int, q: int, segment: int, number) -> list[tuple[int, int, int]]:
    """A cue point's (time, track, byte offset of the cluster), for each of the tracks that it has positions of."""
    time, places = 0, []
    for k, _, u, v in elements(data, p, q):
        if k == CUE_TIME:
            time = number(u, v)
        elif k == CUE_POSITIONS:
            places.append({kk: number(m, n) for kk, _, m, n in elements(data, u, v) if kk in (CUE_TRACK, CUE_CLUSTER)})
    return [(time, x[CUE_TRACK], segment + x[CUE_CLUSTER]) for x in places]


def _track(data: bytes, p: int, q: int, out: Media, number, real) -> None:
    own = {k: (u, v) for k, _, u, v in elements(data, p, q)}
    entry = {"type": number(*own[TRACK_TYPE]), "codec": data[slice(*own[CODEC_ID])].decode(), "rate": 0.0, "channels": 1, "bits": 0, "frame_ns": number(*own[DEFAULT_DURATION]) if DEFAULT_DURATION in own else 0}
    if AUDIO in own:
        audio = {k: (u, v) for k, _, u, v in elements(data, *own[AUDIO])}
        entry["rate"] = real(*audio[SAMPLING]) if SAMPLING in audio else DEFAULT_RATE
        entry |= {name: number(*audio[k]) for k, name in ((CHANNELS, "channels"), (BIT_DEPTH, "bits")) if k in audio}
    out.tracks[number(*own[TRACK_NUMBER])] = entry


def _lasts(track: dict | None, size: int) -> int:
    """Nanoseconds of a frame: the track's default, or what its samples last; 0 where neither is known."""
    if track is None:
        return 0
    if track["frame_ns"]:
        return track["frame_ns"]
    rate = track["rate"] * track["channels"] * track["bits"]
    return round(size * 8_000_000_000 / rate) if rate and track["codec"].startswith("A_PCM") else 0


def _cluster(data: bytes, x: int, y: int, out: Media, number) -> None:
    base, block = 0, out.packets[-1].block + 1 if out.packets else 0
    for k, _, p, q in elements(data, x, y):
        if k == CLUSTER_TIMESTAMP:
            base = number(p, q)
        whole, key = None, None
        if k == BLOCK_GROUP:
            inside = {kk: (u, v) for kk, _, u, v in elements(data, p, q)}
            if BLOCK_DURATION in inside:
                whole = number(*inside[BLOCK_DURATION]) * out.tick_ns
            if BLOCK not in inside:
                continue
            key = REFERENCE_BLOCK not in inside  # what refers to no other block
            p, q = inside[BLOCK]
        if k in (SIMPLE_BLOCK, BLOCK_GROUP):
            track, at = read_vint(data, p)
            offset, flags = struct.unpack_from(">hB", data, at)
            lacing = flags >> 1 & 3
            sizes, at = _laced_sizes(data, at + 3, q, lacing)
            passed = 0
            for size in sizes:
                lasts = _lasts(out.tracks.get(track), size) if whole is None else whole // len(sizes)
                out.packets.append(Packet(track, base + offset + passed // out.tick_ns, at, size, len(out.clusters) - 1, block, lacing, bool(flags & 0x80) if key is None else key, lasts))
                at += size
                passed += lasts
            block += 1


def media_files(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, content): each text as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([mux(padded(x)) for x in utf8(part.column(1))], pa.binary())], [key, "content"])

    return small_batches(df).select(key, df[text].alias("_text")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, content binary")


def packet_table(df: DataFrame, content: str = "content", key: str = "doc_id") -> DataFrame:
    """One row per packet: key, track, packet number, timestamp_ns, duration_ns, byte range, cluster, block (numbered through the file), lacing, keyframe."""
    names = ["packet", "track", "timestamp_ns", "duration_ns", "byte_start", "byte_size", "cluster", "block", "lacing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                if (data := batch.column(1)[at].as_py()) is None:
                    continue
                m = demux(data)
                rows = [(i, p.track, p.timestamp * m.tick_ns, p.duration_ns, p.start, p.size, p.cluster, p.block, p.lacing) for i, p in enumerate(m.packets)]
                keys = pa.array([batch.column(0)[at].as_py()] * len(rows), batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[i] for r in rows], pa.int64()) for i in range(9)), pa.array([p.keyframe for p in m.packets], pa.bool_())], [key, *names, "keyframe"])

    return small_batches(df).select(key, content).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {', '.join(f'{n} long' for n in names)}, keyframe boolean")


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (64 if not text else 0))


def feature(media: Media, payload: bytes) -> str:
    """Of the packet table and the samples read back; whole numbers only, so equal payloads give equal strings."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    spread = lacing_counts(media)
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};lacing={spread};ms={len(x) * 1000 // RATE};sum={int(x.sum())};energy={int((x * x).sum())};crossings={int(np.count_nonzero(np.diff(x < 0)))};peak={int(np.abs(x).max(initial=0))}"


def lacing_counts(media: Media) -> str:
    """Packets without lacing, and with Xiph, fixed and EBML lacing."""
    return "/".join(str(sum(p.lacing == k for p in media.packets)) for k in range(4))


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stores each text as a Matroska file, reads the file's packets back and returns digests and features of them."""

    def row(data: bytes) -> tuple:
        stored = mux(padded(data))
        media = demux(stored)
        back = b"".join(stored[p.start : p.start + p.size] for p in media.packets)
        clusters = set(media.clusters)
        if any(c not in clusters for _, _, c in media.cues):
            raise ValueError("a cue points at no cluster")
        return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(media, back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for part in pieces(batch, "_text"):
                rows = list(map(row, utf8(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [key, *names])

    return small_batches(df).select(key, df[text].alias("_text")).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {SCHEMA}")


#: DuckDB's SQL for the packets of media_files over documents, as far as sizes and times follow from the payload's length.
PACKETS_SQL = f"""
WITH t AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS raw FROM documents),
p AS (SELECT doc_id, CASE WHEN raw = 0 THEN 64 ELSE raw + (64 - raw % 64) % 64 END AS n FROM t)
SELECT doc_id, i AS packet, 1::BIGINT AS track, i * {FRAME} * {TICK_NS} AS timestamp_ns, least({FRAME}, n - i * {FRAME})::BIGINT * {TICK_NS} AS duration_ns,
  least({FRAME}, n - i * {FRAME})::BIGINT AS byte_size, i // {LACED * BLOCKS} AS cluster, i // {LACED} AS block, true AS keyframe
FROM (SELECT doc_id, n, unnest(range((n + {FRAME - 1}) // {FRAME})) AS i FROM p)
"""

#: DuckDB's SQL for the payload's columns that it can express.
PAYLOAD_SQL = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT doc_id, octet_length(raw) AS n, raw || repeat('\\x00'::BLOB, CASE WHEN octet_length(raw) = 0 THEN 64 ELSE (64 - octet_length(raw) % 64) % 64 END) AS payload FROM t)
SELECT doc_id, n::BIGINT AS n_bytes, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_sha256 FROM p
"""
