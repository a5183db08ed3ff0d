"""Media columns: Matroska files as packet tables.

``demux`` walks the EBML elements of a file (variable-length ids and sizes, and
clusters and segments whose size is left open), reads tracks, clusters, simple blocks and block groups with no, Xiph,
EBML or fixed-size lacing, and cues, and lists every packet with its track,
timestamp, key flag, byte range in the file and the time of the cue that points to it. ``mux`` writes a payload as one
track of 8-bit samples, with all kinds of lacing, clusters and cues.
``packets`` makes a table of packets out of a column of files, ``cue_points`` one of cues;
``texts_as_media`` stores every text as a file and reads it back.

Defined results: a null or empty payload is one padded block of zeros; a null
file has no packets; a damaged file gives the packets before the damage (and
``Media.error``), and any bytes are read without an exception; values that the
format forbids (no channels, a rate that is no number) count as not given; cues that point to nothing mark
nothing; equal payloads give equal files; an empty table gives an empty result; where a
table already has a column of a packet's or cue's names, the new one gets underscores before its name.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

# Fixed values of the Matroska format: element ids.
EBML = 0x1A45DFA3
DOC_TYPE = 0x4282
SEGMENT = 0x18538067
INFO = 0x1549A966
TIMESTAMP_SCALE = 0x2AD7B1
DURATION = 0x4489
TRACKS = 0x1654AE6B
TRACK_ENTRY = 0xAE
TRACK_NUMBER = 0xD7
TRACK_UID = 0x73C5
TRACK_TYPE = 0x83
CODEC_ID = 0x86
DEFAULT_DURATION = 0x23E383
AUDIO = 0xE1
SAMPLING_FREQUENCY = 0xB5
CHANNELS = 0x9F
BIT_DEPTH = 0x6264
CLUSTER = 0x1F43B675
TIMESTAMP = 0xE7
SIMPLE_BLOCK = 0xA3
BLOCK_GROUP = 0xA0
BLOCK = 0xA1
BLOCK_DURATION = 0x9B
REFERENCE_BLOCK = 0xFB
CUES = 0x1C53BB6B
CUE_POINT = 0xBB
CUE_TIME = 0xB3
CUE_TRACK_POSITIONS = 0xB7
CUE_TRACK = 0xF7
CUE_CLUSTER_POSITION = 0xF1
CUE_RELATIVE_POSITION = 0xF0
#: Elements that may end an open-ended cluster or segment: those one level up.
_TOP = {EBML, SEGMENT}
_SEGMENT_CHILDREN = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3

SAMPLE_RATE = 8000
FRAME = 480
FRAMES_PER_CLUSTER = 48
UNIT = 64


class Damaged(ValueError):
    """The bytes are not what the format says."""


# ------------------------------------------------------------------ writing
def put_size(n: int, width: int = 0) -> bytes:
    """A variable-length size; the all-ones values are reserved."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def put_id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def element(i: int, body: bytes) -> bytes:
    return put_id(i) + put_size(len(body)) + body


def number(i: int, value: int) -> bytes:
    return element(i, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def real(i: int, value: float) -> bytes:
    return element(i, struct.pack(">d", value))


def lace(frames: list[bytes], kind: int) -> bytes:
    """The head and the frames of a laced block, after its track, time and flags."""
    if kind == NO_LACE:
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif kind == EBML_LACE:
        head += put_size(len(frames[0]))
        for last, f in zip(frames, frames[1:-1], strict=False):
            diff = len(f) - len(last)
            width = next(w for w in range(1, 9) if abs(diff) < 1 << 7 * w - 1)
            head += put_size(diff + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def frame_sizes(n: int) -> Iterator[tuple[int, list[int]]]:
    """Lacing and frame sizes of the blocks that n bytes go to; the kinds of lacing take turns."""
    i = 0
    while n > 0:
        kind = (NO_LACE, XIPH, FIXED, EBML_LACE)[i % 4]
        want = {NO_LACE: [FRAME], XIPH: [FRAME, FRAME // 2, FRAME + 17], FIXED: [FRAME] * 4, EBML_LACE: [FRAME, FRAME - 33, FRAME + 50, FRAME]}[kind]
        if n < sum(want):
            kind, want = NO_LACE, [min(n, FRAME)]
        yield kind, want
        n -= sum(want)
        i += 1


def mux(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """payload as 8-bit PCM samples in one audio track."""
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, len(payload) * 1000 / rate))
    audio = element(AUDIO, real(SAMPLING_FREQUENCY, rate) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    before = info + element(TRACKS, track)
    clusters, cues, place, at, count = [], [], len(before), 0, 0
    body, start = b"", 0

    def close() -> None:
        nonlocal body, place
        if body:
            inside = number(TIMESTAMP, start) + body
            cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, place) + number(CUE_RELATIVE_POSITION, len(number(TIMESTAMP, start))))))
            clusters.append(element(CLUSTER, inside))
            place += len(clusters[-1])
            body = b""

    for kind, sizes in frame_sizes(len(payload)):
        if count >= FRAMES_PER_CLUSTER or not count:
            close()
            start, count = at * 1000 // rate, 0
        frames = []
        first = at
        for size in sizes:
            frames.append(payload[at : at + size])
            at += size
        count += len(frames)
        time = struct.pack(">h", first * 1000 // rate - start)
        block = put_size(1) + time
        if kind == FIXED:  # as a group, with its duration
            body += element(BLOCK_GROUP, element(BLOCK, block + bytes([kind << 1]) + lace(frames, kind)) + number(BLOCK_DURATION, sum(sizes) * 1000 // rate))
        else:
            body += element(SIMPLE_BLOCK, block + bytes([0x80 | kind << 1]) + lace(frames, kind))
    close()
    return head + element(SEGMENT, before + b"".join(clusters) + element(CUES, b"".join(cues)))


# ------------------------------------------------------------------ reading
def get_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    if at >= end:
        raise Damaged(f"no element id at {at}")
    width = 9 - data[at].bit_length()
    if width > 4 or at + width > end:
        raise Damaged(f"bad element id at {at}")
    return int.from_bytes(data[at : at + width], "big"), at + width


def get_size(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    """A size and where it ends; None for one left open."""
    if at >= end or not data[at]:
        raise Damaged(f"bad size at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged(f"cut size at {at}")
    value = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    return (None if value == (1 << 7 * width) - 1 else value), at + width


class Element(NamedTuple):
    id: int
    start: int
    body: int
    past: int
    open: bool


def children(data: bytes, at: int, end: int, stop: set[int] = frozenset()) -> Iterator[Element]:
    """The elements in a range, up to one in stop."""
    while at < end:
        i, body = get_id(data, at, end)
        if i in stop:
            return
        size, body = get_size(data, body, end)
        if size is None:
            if i not in (SEGMENT, CLUSTER):
                raise Damaged(f"element {i:X} at {at} can't be of open size")
            yield Element(i, at, body, end, True)
            # Its own reader tells where it ended.
            at = _open_end(data, i, body, end)
            continue
        if body + size > end:
            yield Element(i, at, body, end, False)
            raise Damaged(f"element {i:X} at {at} passes its parent's end")
        yield Element(i, at, body, body + size, False)
        at = body + size


def _open_end(data: bytes, i: int, at: int, end: int) -> int:
    """Where a segment or cluster of open size ends: before the next element that can't be inside it."""
    stop = _TOP if i == SEGMENT else _TOP | _SEGMENT_CHILDREN
    while at < end:
        child, body = get_id(data, at, end)
        if child in stop:
            return at
        size, body = get_size(data, body, end)
        if size is None and (i != SEGMENT or child != CLUSTER):
            raise Damaged(f"element {child:X} at {at} can't be of open size")
        at = _open_end(data, CLUSTER, body, end) if size is None else body + size
    return min(at, end)


def get_number(data: bytes, e: Element) -> int:
    if e.past - e.body > 8:
        raise Damaged(f"number of {e.past - e.body} bytes at {e.body}")
    return int.from_bytes(data[e.body : e.past], "big")


def get_real(data: bytes, e: Element) -> float:
    kind = {0: "", 4: ">f", 8: ">d"}.get(e.past - e.body)
    if kind is None:
        raise Damaged(f"real of {e.past - e.body} bytes at {e.body}")
    return struct.unpack(kind, data[e.body : e.past])[0] if kind else 0.0


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    frame_ns: int = 0
    rate: float = 8000.0
    channels: int = 1
    bits: int = 0


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    size: int
    key: bool
    cluster: int
    lacing: int
    cue_ns: int | None = None


class Cue(NamedTuple):
    """A cue's time (in ticks), its track, and where its cluster begins in the segment and its block in the cluster's body (null: not given)."""

    time: int
    track: int
    cluster: int
    block: int | None


@dataclass
class Media:
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, Track] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    #: Where each cluster begins in the file, and where its body does.
    clusters: list[tuple[int, int]] = field(default_factory=list)
    cues: list[Cue] = field(default_factory=list)
    #: The first packet of the block that begins at a place in the file.
    blocks: dict[int, int] = field(default_factory=dict)
    segment: int = 0
    error: str | None = None


def lace_sizes(data: bytes, at: int, past: int, kind: int) -> tuple[list[int], int]:
    """Frame sizes of a block from the head of its lacing, and where the frames begin."""
    if kind == NO_LACE:
        return [past - at], at
    if at >= past:
        raise Damaged(f"no lace head at {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (past - at) % n:
            raise Damaged(f"uneven fixed lace at {at}")
        return [(past - at) // n] * n, at
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while at < past and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= past:
                raise Damaged(f"cut lace head at {at}")
            sizes.append(size + data[at])
            at += 1
    elif n > 1:
        size, at = get_size(data, at, past)
        sizes.append(size if size is not None else 0)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length() if at < past else 9
            raw, at = get_size(data, at, past)
            raw = (1 << 7 * width) - 1 if raw is None else raw
            sizes.append(sizes[-1] + raw - ((1 << 7 * width - 1) - 1))
    last = past - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise Damaged(f"lace sizes pass the block's end at {at}")
    return [*sizes, last], at


def read_block(media: Media, data: bytes, at: int, past: int, base: int, key: bool | None, frame_ticks: float | None) -> None:
    track, at = get_size(data, at, past)
    if track is None or at + 3 > past:
        raise Damaged(f"cut block at {at}")
    time = struct.unpack_from(">h", data, at)[0]
    flags = data[at + 2]
    kind = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, past, kind)
    of = media.tracks.get(track)
    each = of.frame_ns if of else 0
    stamp = (base + time) * media.scale
    for i, size in enumerate(sizes):
        if each:
            t = stamp + i * each
        elif frame_ticks is not None:
            t = stamp + i * frame_ticks * media.scale // len(sizes)
        elif of and of.bits and of.rate:  # PCM: the bytes before tell
            t = stamp + int(sum(sizes[:i]) * 8 / (of.bits * of.channels) / of.rate * 1e9)
        else:
            t = stamp
        if not -(1 << 63) <= t < 1 << 63:
            raise Damaged(f"timestamp out of range at {at}")
        media.packets.append(Packet(track, t, at, size, bool(flags & 0x80) if key is None else key, len(media.clusters) - 1, kind))
        at += size


def read_cluster(media: Media, data: bytes, cluster: Element) -> None:
    base = 0
    for e in children(data, cluster.body, cluster.past, (_TOP | _SEGMENT_CHILDREN) if cluster.open else frozenset()):
        first = len(media.packets)
        if e.id == TIMESTAMP:
            base = get_number(data, e)
        elif e.id == SIMPLE_BLOCK:
            read_block(media, data, e.body, e.past, base, None, None)
        elif e.id == BLOCK_GROUP:
            parts = {c.id: c for c in children(data, e.body, e.past)}
            if BLOCK in parts:
                ticks = get_number(data, parts[BLOCK_DURATION]) if BLOCK_DURATION in parts else None
                read_block(media, data, parts[BLOCK].body, parts[BLOCK].past, base, REFERENCE_BLOCK not in parts, ticks)
        if len(media.packets) > first:
            media.blocks[e.start] = first


def read_tracks(media: Media, data: bytes, tracks: Element) -> None:
    for entry in children(data, tracks.body, tracks.past):
        if entry.id != TRACK_ENTRY:
            continue
        t = Track()
        for e in children(data, entry.body, entry.past):
            if e.id == TRACK_NUMBER:
                t.number = get_number(data, e)
            elif e.id == TRACK_TYPE:
                t.kind = get_number(data, e)
            elif e.id == CODEC_ID:
                t.codec = data[e.body : e.past].decode("ascii", "replace")
            elif e.id == DEFAULT_DURATION:
                t.frame_ns = get_number(data, e)
            elif e.id == AUDIO:
                for x in children(data, e.body, e.past):
                    if x.id == SAMPLING_FREQUENCY:
                        rate = get_real(data, x)
                        t.rate = rate if math.isfinite(rate) and rate > 1e-6 else 0.0
                    elif x.id == CHANNELS:
                        t.channels = get_number(data, x) or 1
                    elif x.id == BIT_DEPTH:
                        t.bits = get_number(data, x)
        media.tracks[t.number] = t


def read_cues(media: Media, data: bytes, cues: Element) -> None:
    for point in children(data, cues.body, cues.past):
        if point.id != CUE_POINT:
            continue
        parts = list(children(data, point.body, point.past))
        time = next((get_number(data, e) for e in parts if e.id == CUE_TIME), None)
        if time is None:
            raise Damaged(f"cue without a time at {point.start}")
        for e in parts:  # one for each track
            if e.id == CUE_TRACK_POSITIONS:
                where = {x.id: get_number(data, x) for x in children(data, e.body, e.past) if x.id in (CUE_TRACK, CUE_CLUSTER_POSITION, CUE_RELATIVE_POSITION)}
                media.cues.append(Cue(time, where.get(CUE_TRACK, 0), where.get(CUE_CLUSTER_POSITION, 0), where.get(CUE_RELATIVE_POSITION)))


def mark_cues(media: Media) -> None:
    """Give the first packet of each block that a cue points to the cue's time: by the block's place, or else its cluster, track and time."""
    by_start = {start: k for k, (start, _) in enumerate(media.clusters)}
    first_of: dict[tuple[int, int, int], Packet] = {}
    for p in media.packets:
        first_of.setdefault((p.cluster, p.track, p.timestamp_ns), p)
    for cue in media.cues:
        cluster = by_start.get(media.segment + cue.cluster)
        if cluster is None:
            continue
        if cue.block is None:
            found = first_of.get((cluster, cue.track, cue.time * media.scale))
        else:
            at = media.blocks.get(media.clusters[cluster][1] + cue.block)
            found = media.packets[at] if at is not None and media.packets[at].track == cue.track else None
        if found is not None and cue.time * media.scale < 1 << 63:
            found.cue_ns = cue.time * media.scale


def demux(data: bytes) -> Media:
    """Everything a Matroska file says of its tracks, packets and cues."""
    media = Media()
    try:
        found = False
        for segment in children(data, 0, len(data)):
            if segment.id != SEGMENT:
                continue
            found = True
            media.segment = segment.body
            for e in children(data, segment.body, segment.past, _TOP if segment.open else frozenset()):
                if e.id == INFO:
                    for x in children(data, e.body, e.past):
                        if x.id == TIMESTAMP_SCALE:
                            media.scale = get_number(data, x)
                        elif x.id == DURATION:
                            media.duration = get_real(data, x)
                elif e.id == TRACKS:
                    read_tracks(media, data, e)
                elif e.id == CLUSTER:
                    media.clusters.append((e.start, e.body))
                    read_cluster(media, data, e)
                elif e.id == CUES:
                    read_cues(media, data, e)
        if not found:
            raise Damaged("no segment")
    except Damaged as why:
        media.error = str(why)
    mark_cues(media)
    return media


# ------------------------------------------------------------------ tables
PACKET = {"track": pa.int64(), "timestamp_ns": pa.int64(), "offset": pa.int64(), "size": pa.int64(), "key": pa.bool_(), "cluster": pa.int32(), "lacing": pa.int32(), "cue_ns": pa.int64()}
CUE = {"track": pa.int64(), "timestamp_ns": pa.int64(), "cluster_offset": pa.int64(), "block_offset": pa.int64()}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean"}


def listed(files: DataFrame, column: str, kinds: dict[str, pa.DataType], rows_of) -> DataFrame:
    """All columns of files but `column`, and those of kinds: a row for each tuple that rows_of gives of a file's Media."""
    fields = ", ".join(f"{name}: {_SQL[kind]}" for name, kind in kinds.items())

    @F.arrow_udf(f"array<struct<{fields}>>")
    def each(column: pa.Array) -> pa.Array:
        rows, ends = [], [0]
        for data in column:
            rows.extend(rows_of(demux(data.as_py())) if data.is_valid else ())
            ends.append(len(rows))
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))
        return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), flat)

    rest = files.drop(column)
    held = free_name(files, "found")
    out = files.select(*[F.col(f"`{c}`") for c in rest.columns], F.explode(each(F.col(f"`{column}`"))).alias(held))
    return out.select(*[F.col(f"`{c}`") for c in rest.columns], *[F.col(f"`{held}`")[name].alias(free_name(rest, name)) for name in kinds])


def packets(files: DataFrame, column: str) -> DataFrame:
    """All columns of files but `column`, and those of PACKET: a row a packet."""
    return listed(files, column, PACKET, lambda media: [(p.track, p.timestamp_ns, p.offset, p.size, p.key, p.cluster, p.lacing, p.cue_ns) for p in media.packets])


def cue_points(files: DataFrame, column: str) -> DataFrame:
    """All columns of files but `column`, and those of CUE: a row for each track of a cue whose numbers fit a long."""

    def rows_of(media: Media) -> list[tuple]:
        found = [(c.track, c.time * media.scale, media.segment + c.cluster, c.block) for c in media.cues]
        return [c for c in found if all(x is None or x < 1 << 63 for x in c)]

    return listed(files, column, CUE, rows_of)


def feature(media: Media, payload: bytes) -> str:
    """What the read-back samples and packets look like, as text."""
    n = len(payload)
    total = sum(payload)
    laced = sum(p.lacing != NO_LACE for p in media.packets)
    last = media.packets[-1].timestamp_ns if media.packets else 0
    return f"tracks={len(media.tracks)};clusters={len(media.clusters)};cues={sum(p.cue_ns is not None for p in media.packets)};packets={len(media.packets)};laced={laced};last_ns={last};mean={total / n:.6f};peak={max(payload)}"


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def texts_as_media(documents: DataFrame) -> DataFrame:
    """Every text through mux and demux: COLUMNS, a row a document."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw = (text or "").encode()
                data = mux(raw + bytes(-len(raw) % UNIT if raw else UNIT))
                media = demux(data)
                if media.error:
                    raise Damaged(media.error)
                back = b"".join(data[p.offset : p.offset + p.size] for p in media.packets)
                out.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, back)))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(each, COLUMNS)
