"""Matroska: EBML muxing and parsing into packet tables.

``mux`` stores bytes as 8-bit PCM packets in clusters of laced blocks with cues;
``parse`` reads any EBML stream of that family (all four lacings, SimpleBlock and
BlockGroup, elements of unknown size, Void and CRC-32) back into packets with track,
timestamp and byte range. ``packet_table`` explodes a media column, ``store_texts``
stores and reads back a text column.

Edge cases: a null or empty text is one packet of 64 zero bytes; a null or broken
media value gives no packets and, in ``packet_table``, one row with ``error`` set;
repeated rows give repeated results; an empty table gives an empty table; only the
named columns are read, so extra columns cannot clash. Null ids stay null.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import doc_text, documents, map_columns

EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS = 0xAE, 0xE1, 0xA0, 0xBB, 0xB7
SIMPLE_BLOCK, BLOCK, TIMESTAMP, SCALE, DOC_TYPE = 0xA3, 0xA1, 0xE7, 0x2AD7B1, 0x4282
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
#: What ends an element of unknown size: the elements that can only be its siblings or parents' siblings.
ENDS = {CLUSTER: {CLUSTER, CUES, TRACKS, INFO, SEGMENT, EBML, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}, SEGMENT: {SEGMENT, EBML}}
RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 63


class MatroskaError(ValueError):
    pass


def vint(n: int, width: int = 0) -> bytes:
    """A size in EBML's variable length; all-ones values are left to 'unknown'."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(ident: int, data: bytes | int | float | str) -> bytes:
    if isinstance(data, int):
        data = data.to_bytes(max(1, (data.bit_length() + 7) // 8), "big")
    elif isinstance(data, float):
        data = struct.pack(">d", data)
    elif isinstance(data, str):
        data = data.encode()
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def read_id(b: bytes, at: int) -> tuple[int, int]:
    if at >= len(b) or b[at] < 0x10:
        raise MatroskaError(f"no element id at byte {at}")
    n = 9 - b[at].bit_length()
    if at + n > len(b):
        raise MatroskaError(f"element id is cut off at byte {at}")
    return int.from_bytes(b[at : at + n], "big"), at + n


def read_size(b: bytes, at: int) -> tuple[int | None, int]:
    """The size, or None where it is unknown, and where the content begins."""
    if at >= len(b) or not b[at]:
        raise MatroskaError(f"no element size at byte {at}")
    n = 9 - b[at].bit_length()
    if at + n > len(b):
        raise MatroskaError(f"element size is cut off at byte {at}")
    value = int.from_bytes(b[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def lace(frames: list[bytes], kind: int) -> bytes:
    """The head of a laced block's content (count and sizes) and the frames. kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return frames[0]
    head = bytearray([len(frames) - 1])
    if kind == 1:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == 3:
        head += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            d = len(b) - len(a)
            w = next(w for w in range(1, 9) if abs(d) < (1 << (7 * w - 1)) - 1)
            head += vint(d + (1 << (7 * w - 1)) - 1, w)
    return bytes(head) + b"".join(frames)


def unlace(b: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Offset and length of each frame of a block's content."""
    if kind == 0:
        return [(at, end - at)]
    if at >= end:
        raise MatroskaError(f"block is cut off at byte {at}")
    n, at = b[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise MatroskaError(f"lace sizes are cut off at byte {at}")
                size, at, more = size + b[at], at + 1, b[at] == 255
                if not more:
                    break
            sizes.append(size)
    elif kind == 3 and n > 1:
        size, at = read_size(b, at)
        if size is None:
            raise MatroskaError(f"unknown frame size at byte {at}")
        sizes.append(size)
        for _ in range(n - 2):
            was = at
            raw, at = read_size(b, at)
            width = at - was
            raw = (1 << 7 * width) - 1 if raw is None else raw
            size += raw - ((1 << (7 * width - 1)) - 1)
            sizes.append(size)
    elif kind == 2:
        if (end - at) % n:
            raise MatroskaError(f"fixed lacing of {n} frames in {end - at} bytes at {at}")
        sizes = [(end - at) // n] * (n - 1)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise MatroskaError(f"frames exceed their block at byte {at}")
    out = []
    for size in [*sizes, last]:
        out.append((at, size))
        at += size
    return out


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp in ns, cluster, block, lace position, keyframe, byte offset, length)
    packets: list[tuple] = field(default_factory=list)
    #: (time in ns, track, byte offset of the cluster)
    cues: list[tuple] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


TRACK_FIELDS = {0xD7: "number", 0x83: "type", 0x86: "codec", 0x23E383: "frame_ns", 0xB5: "rate", 0x9F: "channels", 0x6264: "bits", 0x22B59C: "language"}


def parse(b: bytes) -> Media:
    """Every packet of a Matroska file. Raises MatroskaError, with the byte, where it is broken."""
    m, blocks = Media(), 0
    segment = cluster_time = 0
    track: dict = {}
    cue: dict = {}
    pending: list[tuple] = []
    stack: list[tuple[int, int | None]] = [(0, len(b))]
    at = 0
    while True:
        while len(stack) > 1 and stack[-1][1] is not None and at >= stack[-1][1]:
            ident, end = stack.pop()
            if at != end:
                raise MatroskaError(f"children exceed their parent at byte {end}")
            if ident == TRACK_ENTRY:
                m.tracks[track.get("number", 0)] = track
            elif ident == CUE_POSITIONS:
                m.cues.append((cue.get("time", 0) * m.scale, cue.get("track", 0), segment + cue.get("at", 0)))
        if at >= len(b):
            break
        start = at
        ident, at = read_id(b, at)
        size, at = read_size(b, at)
        while len(stack) > 1 and stack[-1][1] is None and ident in ENDS.get(stack[-1][0], ()):
            stack.pop()
        limit = next((e for _, e in reversed(stack) if e is not None))
        if size is None and ident not in ENDS:
            raise MatroskaError(f"unknown size of element {ident:x} at byte {start}")
        end = None if size is None else at + size
        if end is not None and end > limit:
            raise MatroskaError(f"element {ident:x} at byte {start} exceeds its parent")
        if ident in MASTERS:
            stack.append((ident, end))
            if ident == SEGMENT:
                segment = at
            elif ident == CLUSTER:
                m.clusters.append(start)
                cluster_time = 0
            elif ident == TRACK_ENTRY:
                track = {}
            elif ident == CUE_POINT:
                cue = {}
            continue
        if ident in (SIMPLE_BLOCK, BLOCK):
            number, p = read_size(b, at)
            if p + 3 > end:
                raise MatroskaError(f"block is cut off at byte {at}")
            ticks = cluster_time + int.from_bytes(b[p : p + 2], "big", signed=True)
            flags = b[p + 2]
            step = m.tracks.get(number, {}).get("frame_ns", 0)
            for k, (o, n) in enumerate(unlace(b, p + 3, end, flags >> 1 & 3)):
                m.packets.append((number, ticks * m.scale + k * step, len(m.clusters) - 1, blocks, k, bool(flags & 128) if ident == SIMPLE_BLOCK else True, o, n))
            blocks += 1
        elif ident == 0xFB and m.packets:  # a reference to another block: not a keyframe
            pending = [x for x in m.packets if x[3] == blocks - 1]
            m.packets[-len(pending) :] = [(*x[:5], False, *x[6:]) for x in pending]
        elif ident == TIMESTAMP:
            cluster_time = int.from_bytes(b[at:end], "big")
        elif ident == SCALE:
            m.scale = int.from_bytes(b[at:end], "big")
        elif ident == DOC_TYPE:
            m.doc_type = b[at:end].rstrip(b"\0").decode("ascii", "replace")
        elif ident in (0xB3, 0xF7, 0xF1):
            cue[{0xB3: "time", 0xF7: "track", 0xF1: "at"}[ident]] = int.from_bytes(b[at:end], "big")
        elif ident in TRACK_FIELDS:
            name = TRACK_FIELDS[ident]
            if name in ("codec", "language"):
                track[name] = b[at:end].decode("ascii", "replace")
            elif name == "rate":
                track[name] = struct.unpack({4: ">f", 8: ">d"}[size], b[at:end])[0] if size in (4, 8) else 0.0
            else:
                track[name] = int.from_bytes(b[at:end], "big")
        at = end
    return m


def _head() -> bytes:
    head = element(EBML, element(0x4286, 1) + element(0x42F7, 1) + element(0x42F2, 4) + element(0x42F3, 8) + element(DOC_TYPE, "matroska") + element(0x4287, 4) + element(0x4285, 2))
    return head


_INFO = element(INFO, element(SCALE, 1_000_000) + element(0x4D80, "sylvan") + element(0x5741, "sylvan"))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, element(0xD7, 1) + element(0x73C5, 1) + element(0x83, 2) + element(0x9C, 1) + element(0x86, "A_PCM/INT/LIT") + element(0x23E383, FRAME * 1_000_000_000 // RATE) + element(AUDIO, element(0xB5, float(RATE)) + element(0x9F, 1) + element(0x6264, 8))))
_HEAD = _head()


def mux(payload: bytes, lacing: int | None = None) -> bytes:
    """Bytes as 8-bit mono PCM at 8 kHz: packets of 512 samples, 8 laced to a block, 63 blocks to a cluster, cues at the end.

    lacing: 1 Xiph, 2 fixed, 3 EBML; by default fixed where packets are equal, else EBML.
    """
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    body, cues = bytearray(_INFO + _TRACKS), bytearray()
    for c in range(0, len(frames), LACED * BLOCKS):
        time = c * FRAME * 1000 // RATE
        cues += element(CUE_POINT, element(0xB3, time) + element(CUE_POSITIONS, element(0xF7, 1) + element(0xF1, len(body))))
        data = bytearray(element(TIMESTAMP, time))
        for k in range(c, min(len(frames), c + LACED * BLOCKS), LACED):
            group = frames[k : min(k + LACED, c + LACED * BLOCKS)]
            equal = len(group[0]) == len(group[-1])
            kind = 0 if len(group) == 1 else (2 if equal else 3) if lacing is None else 3 if lacing == 2 and not equal else lacing
            rel = k * FRAME * 1000 // RATE - time
            data += element(SIMPLE_BLOCK, b"\x81" + rel.to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1]) + lace(group, kind))
        body += element(CLUSTER, bytes(data))
    return _HEAD + element(SEGMENT, bytes(body + element(CUES, bytes(cues))))


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    return raw + b"\0" * (max(64, -(-n // 64) * 64) - n), n


def samples_of(media: bytes, parsed: Media, track: int = 1) -> bytes:
    return b"".join(media[o : o + n] for t, _, _, _, _, _, o, n in parsed.packets if t == track)


def feature(samples: bytes, parsed: Media) -> str:
    """Signal statistics over all samples, and the packet layout."""
    x = np.frombuffer(samples, np.uint8)
    n = len(x)
    counts = np.bincount(x, minlength=256)
    total, squares = int(counts @ np.arange(256)), int(counts @ (np.arange(256) ** 2))
    mean = total / n
    above = x > mean
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    return f"packets={len(parsed.packets)};clusters={len(parsed.clusters)};cues={len(parsed.cues)};ms={n * 1000 // RATE};peak={int(counts.nonzero()[0][-1])};mean={mean:.4f};rms={(squares / n) ** 0.5:.4f};crossings={crossings}"


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each whole text in a Matroska file and read it back from the stored bytes."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long" + ", media binary" * keep_media

    def run(_: object, ids: list, texts: list) -> dict:
        rows = []
        for i, text in zip(ids, texts):
            payload, n = payload_of(text)
            media = mux(payload)
            parsed = parse(media)
            back = samples_of(media, parsed)
            rows.append((i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, parsed), len(parsed.packets), media))
        names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "media")
        return {k: [r[j] for r in rows] for j, k in enumerate(names) if keep_media or k != "media"}

    return map_columns(doc_text(df, id_col, text_col), run, schema)


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each packet of each Matroska value: track, timestamps and byte range."""
    schema = "id string, packets array<struct<track:long,codec:string,timestamp_ns:long,cluster:int,block:int,lace:int,keyframe:boolean,byte_offset:long,byte_length:long,cue_cluster:long>>, error string"

    def run(_: object, ids: list, media: list) -> dict:
        packets, errors = [], []
        for b in media:
            try:
                if b is None:
                    raise MatroskaError("no media")
                m = parse(b)
                cued = {(t, at) for _, t, at in m.cues}
                packets.append([dict(zip(("track", "codec", "timestamp_ns", "cluster", "block", "lace", "keyframe", "byte_offset", "byte_length", "cue_cluster"), (x[0], m.tracks.get(x[0], {}).get("codec"), *x[1:], m.clusters[x[2]] if (x[0], m.clusters[x[2]]) in cued else None))) for x in m.packets])
                errors.append(None)
            except MatroskaError as e:
                packets.append(None)
                errors.append(str(e))
        return {"id": ids, "packets": packets, "error": errors}

    parsed = map_columns(df.select(F.col(id_col).cast("string").alias("id"), F.col(media_col).alias("media")), run, schema)
    return parsed.select("id", "error", F.explode_outer("packets").alias("p")).select("id", "p.*", "error")


def op1_matroska(spark, sf_dir: str) -> DataFrame:
    return store_texts(documents(spark, sf_dir))
