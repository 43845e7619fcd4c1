"""Media columns: Matroska files in a binary column, parsed into packet tables.

The parser walks variable-length EBML elements, also those of unknown size, reads clusters, simple
blocks and block groups, undoes the three kinds of lacing, and marks the clusters that cues point at. A
packet has its track, timestamp in nanoseconds and byte range in the file. The writer stores a payload
as frames of unsigned 8-bit PCM samples.

Defined results: a null text is stored as an empty one, which is one frame of padding; null media gives no
packets; a truncated or malformed file gives the packets before the damage and an error text instead of a
failed job, also where a block is shorter than its header or a number exceeds 64 bits. Repeated rows stay, and
equal texts give equal values; an empty table gives an empty result. Texts of any length are one file each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heightline.llm.columns import others
from heightline.llm.text import buffers, slices, tidied
from heightline.staging import extended

# Element ids of the Matroska specification (RFC 9559).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = frozenset((0x114D9B74, INFO, TRACKS, CLUSTER, CUES, 0x1941A469, 0x1043A770, 0x1254C367))
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME = 576
RATE = 8000
FRAME_MS = FRAME * 1000 // RATE
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 48


def vint(data, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, place after it, and whether all value bits are set (an unknown size)."""
    first = data[at]
    if not first:
        raise ValueError(f"no length marker at {at}")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise ValueError(f"cut off at {at}")
    raw = int.from_bytes(data[at : at + n], "big")
    value = raw & ((1 << 7 * n) - 1)
    return (raw if keep_marker else value), at + n, value == (1 << 7 * n) - 1


def vint_bytes(value: int, width: int = 0) -> bytes:
    n = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint_bytes(len(body)) + body


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, str] = field(default_factory=dict)
    blocks: list[tuple[int, int, int, bool, int, np.ndarray, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    segment: int = 0
    error: str | None = None

    def packets(self) -> dict[str, np.ndarray]:
        """One entry a packet, in file order."""
        counts = [len(b[5]) for b in self.blocks]
        each = lambda i, kind: np.repeat(np.array([b[i] for b in self.blocks], kind), counts)
        sizes = np.concatenate([b[5] for b in self.blocks]) if self.blocks else np.empty(0, np.int64)
        lace = np.concatenate([np.arange(n) for n in counts]) if counts else np.empty(0, np.int64)
        before = np.cumsum(sizes) - sizes
        head = np.repeat(before[np.cumsum(counts) - counts] if counts else before, counts)
        cued = [self.segment + c[2] for c in self.cues if c[2] < 1 << 62]
        cluster = each(6, np.int64)
        return {
            "track": each(0, np.int32), "timestamp_ns": each(1, np.int64) * self.scale, "byte_offset": each(4, np.int64) + before - head, "byte_size": sizes, "keyframe": each(3, bool),
            "lacing": each(2, np.int32), "lace_index": lace.astype(np.int32), "cluster_offset": cluster, "cued": np.isin(cluster, np.array(cued, np.int64)),
        }


def laced(data, at: int, stop: int, lacing: int) -> tuple[int, np.ndarray]:
    """Place and sizes of the frames of a block whose header ends at `at`."""
    if at > stop or lacing != NO_LACING and at == stop:
        raise ValueError(f"block cut off at {at}")
    if lacing == NO_LACING:
        return at, np.array([stop - at], np.int64)
    n = data[at] + 1
    at += 1
    if lacing == FIXED:
        if (stop - at) % n:
            raise ValueError(f"uneven fixed lacing at {at}")
        return at, np.full(n, (stop - at) // n, np.int64)
    sizes = []
    for i in range(n - 1):
        if lacing == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        elif i == 0:
            size, at, _ = vint(data, at)
        else:
            old = at
            step, at, _ = vint(data, at)
            size = sizes[-1] + step - ((1 << 7 * (at - old) - 1) - 1)
        sizes.append(size)
    sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"laces exceed their block at {at}")
    return at, np.array(sizes, np.int64)


def children(data, at: int, stop: int) -> Iterator[tuple[int, int, int, bool]]:
    """id, body start, body stop, whether the size was unknown."""
    while at < stop:
        ident, body, _ = vint(data, at, True)
        size, body, unknown = vint(data, body)
        end = stop if unknown else body + size
        if end > stop:
            raise ValueError(f"element {ident:X} at {at} exceeds its parent")
        at = end
        yield ident, body, end, unknown


def parse(data: bytes) -> Media:
    media = Media()
    try:
        for ident, at, stop, _ in children(data, 0, len(data)):
            if ident == SEGMENT:
                media.segment = at
                _segment(media, data, at, stop)
    except (ValueError, IndexError) as e:
        media.error = str(e) or type(e).__name__
    return media


def _number(data, at: int, stop: int) -> int:
    if stop - at > 8:
        raise ValueError(f"number of {stop - at} bytes at {at}")
    return int.from_bytes(data[at:stop], "big")


def _segment(media: Media, data, at: int, stop: int) -> None:
    while at < stop:
        began = at
        ident, body, _ = vint(data, at, True)
        size, body, unknown = vint(data, body)
        at = stop if unknown else body + size
        if ident == CLUSTER:
            media.clusters.append(began)
            at = _cluster(media, data, began, body, min(at, stop), unknown)
        elif at > stop:
            raise ValueError(f"element {ident:X} at {began} exceeds its parent")
        elif ident == INFO:
            for k, a, b, _ in children(data, body, at):
                if k == TIMESTAMP_SCALE:
                    scale = _number(data, a, b)
                    if scale >= 1 << 63:
                        raise ValueError(f"timestamp scale out of range at {a}")
                    media.scale = scale
                    if any(abs(x[1] * media.scale) >= 1 << 63 for x in media.blocks):  # of clusters before it
                        media.blocks.clear()
                        raise ValueError(f"timestamp out of range under the scale at {a}")
        elif ident == TRACKS:
            for k, a, b, _ in children(data, body, at):
                if k == TRACK_ENTRY:
                    own = {i: (x, y) for i, x, y, _ in children(data, a, b)}
                    x, y = own.get(CODEC_ID, (0, 0))
                    media.tracks[_number(data, *own[TRACK_NUMBER]) if TRACK_NUMBER in own else 0] = bytes(data[x:y]).decode("ascii", "replace")
        elif ident == CUES:
            for k, a, b, _ in children(data, body, at):
                if k == CUE_POINT:
                    parts = list(children(data, a, b))
                    time = next((_number(data, x, y) for i, x, y, _ in parts if i == CUE_TIME), 0)
                    for i, x, y, _ in parts:
                        if i == CUE_TRACK_POSITIONS:
                            own = {i: _number(data, p, q) for i, p, q, _ in children(data, x, y)}
                            media.cues.append((time, own.get(CUE_TRACK, 0), own.get(CUE_CLUSTER_POSITION, 0)))


def _cluster(media: Media, data, began: int, at: int, stop: int, unknown: bool) -> int:
    """Reads blocks up to stop, or if the size is unknown up to the next element of the level above."""
    base = 0
    while at < stop:
        ident, body, _ = vint(data, at, True)
        if unknown and ident in TOP:
            return at
        size, body, _ = vint(data, body)
        end = body + size
        if end > stop:
            raise ValueError(f"element {ident:X} at {at} exceeds its cluster")
        if ident == TIMESTAMP:
            base = _number(data, body, end)
        elif ident == SIMPLE_BLOCK:
            _block(media, data, body, end, base, began, None)
        elif ident == BLOCK_GROUP:
            parts = list(children(data, body, end))
            refers = any(i == REFERENCE_BLOCK for i, *_ in parts)
            for i, a, b, _ in parts:
                if i == BLOCK:
                    _block(media, data, a, b, base, began, not refers)
        at = end
    return at


def _block(media: Media, data, at: int, stop: int, base: int, cluster: int, key: bool | None) -> None:
    track, at, _ = vint(data, at)
    if at + 3 > stop:
        raise ValueError(f"block header exceeds its block at {at}")
    relative, flags = struct.unpack_from(">hB", data, at)
    time = base + relative
    if track >= 1 << 31 or abs(time * media.scale) >= 1 << 63:
        raise ValueError(f"track or timestamp out of range at {at}")
    lacing = flags >> 1 & 3
    first, sizes = laced(data, at + 3, stop, lacing)
    media.blocks.append((track, time, lacing, bool(flags & 0x80) if key is None else key, first, sizes, cluster))


def lace_header(frames: list[bytes], lacing: int) -> bytes:
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if lacing == XIPH:
        return head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if lacing == EBML_LACING:
        out = head + vint_bytes(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1]):
            n = next(n for n in range(1, 9) if abs(b - a) < (1 << 7 * n - 1) - 1)
            out += vint_bytes(b - a + (1 << 7 * n - 1) - 1, n)
        return out
    return head


def mux(payload: bytes, lacing: int = FIXED, frame: int = FRAME) -> bytes:
    """A Matroska file with one PCM track whose packets hold payload, `frame` bytes each."""
    head = element(EBML, unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(EBML_MAX_ID, 4) + unsigned(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + unsigned(DOC_VERSION, 4) + unsigned(DOC_READ_VERSION, 2))
    total = -(-len(payload) // frame)
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", total * FRAME_MS)) + element(MUXING_APP, b"heightline") + element(WRITING_APP, b"heightline"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    track = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + unsigned(DEFAULT_DURATION, FRAME_MS * 1_000_000) + audio))
    body, cues, parts, time = len(info) + len(track), [], [info, track], 0
    step = frame * FRAMES_A_BLOCK
    for start in range(0, len(payload), step * BLOCKS_A_CLUSTER):
        blocks, base = [unsigned(TIMESTAMP, time)], time
        for at in range(start, min(start + step * BLOCKS_A_CLUSTER, len(payload)), step):
            chunk = payload[at : at + step]
            n = -(-len(chunk) // frame)
            kind = lacing if n > 1 else NO_LACING
            laces = lace_header([chunk[i : i + frame] for i in range(0, len(chunk), frame)], kind) if kind else b""
            blocks.append(element(SIMPLE_BLOCK, vint_bytes(1) + struct.pack(">hB", time - base, 0x80 | kind << 1) + laces + chunk))
            time += n * FRAME_MS
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, body))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        body += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


PACKETS = "track int, timestamp_ns long, byte_offset long, byte_size long, keyframe boolean, lacing int, lace_index int, cluster_offset long, cued boolean"
BATCH = 16 << 20


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME))


def store(docs: DataFrame, text: str = "text", lacing: int = FIXED) -> DataFrame:
    """docs with n_bytes and a binary column media in place of `text`."""
    kept = others(docs.columns, text, "n_bytes", "media")
    source = docs.select(*kept, F.col(text).alias("media"))

    @tidied
    def run(batches):
        for batch in batches:
            for a, b in _by_bytes(batch.column(len(kept))):
                part = batch.slice(a, b - a)
                made = [padded(t) for t in part.column(len(kept)).to_pylist()]
                media = [mux(p, lacing) for _, p in made]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([n for n, _ in made], pa.int64()), pa.array(media, pa.binary())], [*kept, "n_bytes", "media"])

    return source.mapInArrow(run, extended(docs.select(*kept), "n_bytes long, media binary"))


def _by_bytes(column: pa.Array) -> Iterator[tuple[int, int]]:
    yield from slices(np.diff(buffers(column)[1]), BATCH)


def packet_table(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """key and one row a packet of the file in `column`."""
    source = media.select(key, F.col(column).alias("_media"))
    schema = extended(source.select(key), PACKETS)

    @tidied
    def run(batches):
        for batch in batches:
            for i, raw in enumerate(batch.column("_media").to_pylist()):
                found = parse(raw or b"").packets()
                n = len(found["track"])
                for a in range(0, n, 1 << 16):
                    b = min(n, a + (1 << 16))
                    keys = pa.array([batch.column(0)[i].as_py()] * (b - a), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(v[a:b]) for v in found.values())], [key, *found])

    return source.mapInArrow(run, schema)


READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def read_back(media: DataFrame, column: str = "media") -> DataFrame:
    """Parses each file, takes its payload from the packets' byte ranges, and describes both."""
    kept = others(media.columns, column, *StructType.fromDDL(READ).names)
    source = media.select(*kept, F.col(column).alias("payload_bytes"))
    schema = extended(media.select(*kept), READ)

    @tidied
    def run(batches):
        for batch in batches:
            rows = [_described(raw or b"") for raw in batch.column(len(kept)).to_pylist()]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(v, k) for v, k in zip(zip(*rows), kinds))] if rows else [*batch.columns[:-1], *(pa.array([], k) for k in kinds)], schema.names)

    return source.mapInArrow(run, schema)


def _described(raw: bytes):
    media = parse(raw)
    packets = media.packets()
    view = memoryview(raw)
    payload = b"".join([view[a : a + n] for a, n in zip(packets["byte_offset"].tolist(), packets["byte_size"].tolist())])
    samples = np.frombuffer(payload, np.uint8)
    end = int(packets["timestamp_ns"][-1]) // 1_000_000 if len(samples) else 0
    feature = f"tracks={len(media.tracks)};clusters={len(media.clusters)};cues={len(media.cues)};blocks={len(media.blocks)};packets={len(packets['track'])};last_ms={end};sum={int(samples.sum(dtype=np.int64))};peak={int(samples.max(initial=0))}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, media.error


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_back(store(docs)).drop("error")
