"""Media columns: baseline JPEG streams held in binary columns, read with numpy.

decode() parses markers and Huffman-decodes the scans of any baseline (SOF0) JPEG into quantised coefficients; thumbnail() makes the
DC-only luminance picture of them (one pixel a block), and features() sizes and thumbnail hashes. Scans are walked by tables and in step: every
restart segment of every stream of a batch is a lane, and one round of array operations takes the next code and value of each lane.

encode_many() stores bytes losslessly in the format's own unit, the quantised coefficient: each 64 bytes make a block in zig-zag
order. Bytes become values in an order in which those common in text are near zero and none is zero; blocks that only fill up the picture are zero. Each stream
has Huffman tables built from its own counts of value sizes and restarts every RESTART blocks. It is an ordinary baseline JPEG.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.textbatch import slices

BLOCK = 64
#: Blocks between restarts of streams written here; a segment is a lane of the walk.
RESTART = 16
#: Bytes of streams decoded together.
BATCH_BYTES = 4 << 20
#: Widest picture, in blocks: 16 bits of pixels.
_WIDEST = 65535 // 8


class JpegError(ValueError):
    """Not a baseline JPEG, or a broken one."""


@dataclass
class Component:
    id: int
    h: int
    v: int
    q: int
    dc: int = 0
    ac: int = 0
    #: Quantised coefficients in zig-zag order: rows of blocks, blocks, 64.
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int16))


@dataclass
class Picture:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray]
    comment: bytes = b""


def _lookup(counts: list[int], symbols: bytes) -> tuple[int, np.ndarray]:
    """Of a DHT table: its longest code, and for every pattern of so many bits 256 * length + symbol of the code that begins it (0: none)."""
    width = max((k for k, n in enumerate(counts, 1) if n), default=1)
    out, code, at = np.zeros(1 << width, np.uint16), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            if code >> length:
                raise JpegError("a Huffman table has too many codes")
            out[code << (width - length) : (code + 1) << (width - length)] = length << 8 | symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return width, out


def _unstuff(scan: bytes) -> list[bytes]:
    """The scan's segments between restart markers, without stuffed zero bytes."""
    parts, at = [], 0
    raw = np.frombuffer(scan, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)) if len(raw) else []
    for m in [*marks, len(scan)]:
        parts.append(scan[at:m].replace(b"\xff\x00", b"\xff"))
        at = m + 2
    return parts


@dataclass
class _Scan:
    """A scan to be walked: its blocks in order (component, place among the component's blocks), tables by component, segments, blocks to a segment."""

    picture: Picture
    which: np.ndarray
    place: np.ndarray
    tables: dict[int, tuple[tuple[int, np.ndarray], tuple[int, np.ndarray]]]
    segments: list[bytes]
    interval: int


def _parse(data: bytes) -> tuple[Picture, list[_Scan]]:
    """Markers of a stream; its coefficients are still zero."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no SOI marker")
    at, quant, tables, restart, pic, comment, scans = 2, {}, {}, 0, None, b"", []
    while at < len(data):
        if data[at] != 0xFF:
            raise JpegError(f"no marker at byte {at}")
        mark = data[at + 1]
        if mark == 0xFF:  # fill byte
            at += 1
            continue
        at += 2
        if mark == 0xD9:
            break
        if mark == 0x01 or 0xD0 <= mark <= 0xD7:
            continue
        n = int.from_bytes(data[at : at + 2])
        body = data[at + 2 : at + n]
        if n < 2 or len(body) != n - 2:
            raise JpegError("a marker segment ends early")
        at += n
        if mark == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                quant[k] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                if len(quant[k]) != 64:
                    raise JpegError("a quantiser table ends early")
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = _lookup(list(body[1:17]), body[17 : 17 + total])
                body = body[17 + total :]
        elif mark == 0xC0:
            if pic is not None or body[0] != 8:
                raise JpegError("not one 8-bit frame")
            pic = Picture(int.from_bytes(body[3:5]), int.from_bytes(body[1:3]), [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])], quant, comment)
            if not pic.width or not pic.height or not pic.components or not all(1 <= c.h <= 4 and 1 <= c.v <= 4 for c in pic.components):
                raise JpegError("no size")
            _lay_out(pic, len(data))
        elif 0xC1 <= mark <= 0xCF:
            raise JpegError(f"SOF {mark:02x} is not baseline")
        elif mark == 0xDD:
            restart = int.from_bytes(body[:2])
        elif mark == 0xFE:
            comment = body
            if pic:
                pic.comment = body
        elif mark == 0xDA:
            if pic is None:
                raise JpegError("scan before frame")
            chosen = []
            for i in range(body[0]):
                part = next(k for k, c in enumerate(pic.components) if c.id == body[1 + 2 * i])
                chosen.append((part, tables[body[2 + 2 * i] >> 4], tables[0x10 | body[2 + 2 * i] & 15]))
            end = at
            while True:  # the next marker that is neither stuffing nor a restart
                end = data.find(b"\xff", end)
                if end < 0 or end + 1 >= len(data):
                    end = len(data)
                    break
                if data[end + 1] and not 0xD0 <= data[end + 1] <= 0xD7:
                    break
                end += 2
            scans.append(_order(pic, chosen, restart, data[at:end]))
            at = end
    if pic is None:
        raise JpegError("no frame")
    return pic, scans


def _lay_out(pic: Picture, size: int) -> None:
    most_h, most_v = max(c.h for c in pic.components), max(c.v for c in pic.components)
    wide, high = -(-pic.width // (8 * most_h)), -(-pic.height // (8 * most_v))
    # a block takes two bits at least: no room is made that the stream cannot fill
    if wide * high * sum(c.h * c.v for c in pic.components) * 2 > 8 * size:
        raise JpegError("more blocks than the stream can hold")
    for c in pic.components:
        c.blocks = np.zeros((high * c.v, wide * c.h, 64), np.int16)


def _order(pic: Picture, chosen: list[tuple], restart: int, scan: bytes) -> _Scan:
    """The blocks of a scan in the order of its codes."""
    if not chosen:
        raise JpegError("a scan of no component")
    if len(chosen) == 1:
        k = chosen[0][0]
        one = pic.components[k]
        most_h, most_v = max(c.h for c in pic.components), max(c.v for c in pic.components)
        wide, high = -(-(-(-pic.width * one.h // most_h)) // 8), -(-(-(-pic.height * one.v // most_v)) // 8)
        place = (np.arange(high)[:, None] * one.blocks.shape[1] + np.arange(wide)).ravel()
        return _Scan(pic, np.full(len(place), k), place, {k: chosen[0][1:]}, _unstuff(scan), restart or len(place))
    first = pic.components[chosen[0][0]]
    high, wide = first.blocks.shape[0] // first.v, first.blocks.shape[1] // first.h
    y, x = np.divmod(np.arange(high * wide), wide)
    which, place = [], []
    for k, *_ in chosen:
        c = pic.components[k]
        for dy in range(c.v):
            for dx in range(c.h):
                which.append(np.full(len(y), k))
                place.append((y * c.v + dy) * c.blocks.shape[1] + x * c.h + dx)
    return _Scan(pic, np.stack(which, 1).ravel(), np.stack(place, 1).ravel(), {k: t for k, *t in chosen}, _unstuff(scan), (restart or high * wide) * len(which))


def _walk(scans: list[_Scan]) -> np.ndarray:
    """Decodes all scans in step and fills in their blocks; which of them are broken."""
    lut_width = max(t[0] for s in scans for pair in s.tables.values() for t in pair)
    luts: list[np.ndarray] = []
    bases, target, dc_of, ac_of, key = {}, [], [], [], []
    lane_scan, lane_from, lane_to, start, stop, parts = [], [], [], [], [], []
    n_blocks, n_units, n_bytes = 0, 0, 0
    broken = np.zeros(len(scans), bool)
    for i, s in enumerate(scans):
        number = {}
        for k, pair in s.tables.items():
            if (id(s.picture), k) not in bases:
                bases[id(s.picture), k] = n_blocks
                n_blocks += s.picture.components[k].blocks.shape[0] * s.picture.components[k].blocks.shape[1]
            number[k] = len(luts)
            luts += [np.repeat(t, 1 << (lut_width - w)) for w, t in pair]
        n = len(s.place)
        kinds = list(s.tables)
        base, first = (np.zeros(max(kinds) + 1, np.int64) for _ in range(2))
        base[kinds], first[kinds] = [bases[id(s.picture), k] for k in kinds], [number[k] for k in kinds]
        target.append(base[s.which] + s.place)
        dc_of.append(first[s.which])
        key.append((n_units + np.arange(n) // s.interval * s.interval) * 4 + s.which % 4)
        lanes = -(-n // s.interval)
        if len(s.segments) < lanes:
            broken[i] = True
        for k in range(min(lanes, len(s.segments))):
            lane_scan.append(i)
            lane_from.append(n_units + k * s.interval)
            lane_to.append(n_units + min(n, (k + 1) * s.interval))
            start.append(8 * n_bytes)
            n_bytes += len(s.segments[k])
            stop.append(8 * n_bytes)
            parts.append(s.segments[k])
        n_units += n
    buf = b"".join(parts) + bytes(16)
    view = np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))
    lut = np.concatenate(luts)
    target, dc_of, key = np.concatenate(target), np.concatenate(dc_of), np.concatenate(key)
    coefs = np.zeros((n_blocks, 64), np.int16)
    flat = coefs.reshape(-1)
    scan, u, to, pos, stop = (np.array(x, np.int64) for x in (lane_scan, lane_from, lane_to, start, stop))
    k = np.zeros(len(u), np.int64)
    shift = np.uint64(64 - lut_width)
    while len(u):
        window = view[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)
        is_dc = k == 0
        code = lut[((dc_of[u] + ~is_dc) << lut_width) + (window >> shift).astype(np.int64)].astype(np.int64)
        length, size = code >> 8, code & 15
        run = np.where(is_dc, 0, code >> 4 & 15)
        bits = ((window << length.astype(np.uint64)) >> (np.uint64(63) - size.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        value = bits - np.where(bits >> np.maximum(size - 1, 0) & 1, 0, (1 << size) - 1)
        pos = pos + length + size
        place = k + run
        writes = is_dc | (size > 0)
        bad = (length == 0) | (pos > stop) | writes & (place > 63)
        at = target[u] * 64 + np.minimum(place, 63)
        if writes.all():
            flat[at] = value
            k = place + 1
        else:
            flat[at[writes]] = value[writes]
            k = np.where(writes | (run == 15), place + 1, 64)
        done = k >= 64
        if done.any() or bad.any():
            u = u + done
            k[done] = 0
            if bad.any():
                broken[scan[bad]] = True
            go = (u < to) & ~bad
            if not go.all():
                u, to, pos, stop, k, scan = (x[go] for x in (u, to, pos, stop, k, scan))
    # DC values are differences within a segment and component
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    total = np.cumsum(coefs[target[order], 0], dtype=np.int64)
    before = np.concatenate([[0], total])[first]
    coefs[target[order], 0] = total - np.repeat(before, np.diff(np.append(first, len(order))))
    for s in scans:
        for k in s.tables:
            c, at = s.picture.components[k], bases[id(s.picture), k]
            c.blocks = coefs[at : at + c.blocks.shape[0] * c.blocks.shape[1]].reshape(c.blocks.shape)
    return broken


def decode_many(streams: list[bytes | None]) -> list[Picture | None]:
    """Pictures of baseline JPEGs; None for what is none, is damaged, or is null."""
    out: list[Picture | None] = []
    scans, owner = [], []
    for data in streams:
        try:
            pic, mine = _parse(data or b"")
            scans += mine
            owner += [len(out)] * len(mine)
            out.append(pic)
        except (JpegError, IndexError, KeyError, StopIteration, ValueError, OverflowError, MemoryError):
            out.append(None)
    if scans:
        for i in np.array(owner)[_walk(scans)].tolist():
            out[i] = None
    return out


def decode(data: bytes) -> Picture:
    """Markers and coefficients of a baseline JPEG. Progressive, arithmetic, lossless, 12-bit and damaged streams raise JpegError."""
    try:
        pic, scans = _parse(data)
    except (IndexError, KeyError, StopIteration, OverflowError, MemoryError) as e:
        raise JpegError(f"damaged: {e!r}") from e
    if scans and _walk(scans).any():
        raise JpegError("a scan ends early or has no such code")
    return pic


def thumbnail(pic: Picture) -> np.ndarray:
    """One luminance pixel (0 to 255) a block of the first component, from its DC coefficients alone."""
    c = pic.components[0]
    step = int(pic.quant[c.q][0]) if c.q in pic.quant else 1
    return np.clip(np.rint(c.blocks[:, :, 0].astype(np.float64) * step / 8 + 128), 0, 255).astype(np.uint8)


def _shrink(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Nearest pixels on an h by w grid."""
    return img[(np.arange(h) * 2 + 1) * img.shape[0] // (2 * h)][:, (np.arange(w) * 2 + 1) * img.shape[1] // (2 * w)].astype(np.int32)


def features(pic: Picture) -> str:
    """width x height, then the thumbnail's difference hash, mean hash (16 hex digits each) and crc32."""
    thumb = thumbnail(pic)
    small = _shrink(thumb, 8, 9)
    dhash = np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
    small = _shrink(thumb, 8, 8)
    ahash = np.packbits(small * 64 > small.sum()).tobytes().hex()
    return f"{pic.width}x{pic.height}:{dhash}:{ahash}:{zlib.crc32(np.ascontiguousarray(thumb).data):08x}"


def _segment(mark: int, body: bytes) -> bytes:
    return bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2) + body


def code_lengths(counts: list[int]) -> list[int]:
    """Lengths of a Huffman code for symbols of these counts (0: no code), in which the code of ones alone stays free, as JPEG asks."""
    heap = [(n, k, [k]) for k, n in enumerate(counts) if n]
    heap.append((0, len(counts), [len(counts)]))
    heapq.heapify(heap)
    out = [0] * (len(counts) + 1)
    while len(heap) > 1:
        (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
        for k in x + y:
            out[k] += 1
        heapq.heappush(heap, (a + b, max(i, j), x + y))
    # the free code is among the longest
    return out[:-1]


def _table(kind: int, counts: list[int], codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """A DHT segment of symbols 0 to 8 by their counts; fills in their codes and lengths."""
    got = code_lengths(counts)
    order = sorted((n, s) for s, n in enumerate(got) if n)
    numbers, code, before = [0] * 16, 0, 0
    for n, s in order:
        code <<= n - before
        codes[s], lengths[s], before = code, n, n
        code += 1
        numbers[n - 1] += 1
    return _segment(0xC4, bytes([kind, *numbers, *(s for _, s in order)]))


#: Characters common in western text, frequent ones first. They get the values 1, -1, 2, -2, ... and all other bytes, in order, those that follow.
COMMON = " etaonirshdlucmfgpwybvkxjqz.,\n0123456789-'TASIEDCMWBPHLNRFOGUVJKYQXZ:;!?()/_"
_BYTES = [*COMMON.encode(), *(b for b in range(256) if b not in COMMON.encode())]
#: Value of each payload byte (the DC values beside it are one less where positive), and the byte of each value + 128.
_VALUE, _BYTE = np.zeros(256, np.int64), np.zeros(257, np.uint8)
_VALUE[_BYTES] = [k // 2 + 1 if k % 2 == 0 else -(k // 2 + 1) for k in range(256)]
_BYTE[_VALUE + 128] = np.arange(256)
#: Size in bits of each value + 255.
_SIZE = np.array([abs(v).bit_length() for v in range(-255, 256)], np.int64)
_QUANT = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _segment(0xDD, RESTART.to_bytes(2))


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """Baseline greyscale JPEGs whose coefficients are the payloads' bytes; each length is a positive multiple of 64.

    The picture is about square; blocks after the payload's last (fewer than a row) are zero, and a comment tells the length.
    """
    shapes = []
    for p in payloads:
        n = len(p) // BLOCK
        if not n or len(p) % BLOCK:
            raise ValueError("a payload is a positive multiple of 64 bytes")
        wide = min(_WIDEST, max(1, int(np.ceil(np.sqrt(n)))))
        if (high := -(-n // wide)) > _WIDEST:
            raise ValueError("a payload of more than 4 GB is beyond a JPEG's size")
        shapes.append((wide, high))
    if not payloads:
        return []
    blocks = np.array([w * h for w, h in shapes])
    of = np.repeat(np.arange(len(payloads)), blocks)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    restarts = inside % RESTART == 0
    held = inside < np.repeat([len(p) // BLOCK for p in payloads], blocks)
    values = np.zeros((len(of), BLOCK), np.int64)
    values[held] = _VALUE[np.frombuffer(b"".join(payloads), np.uint8)].reshape(-1, BLOCK)
    dc = values[:, 0] - (values[:, 0] > 0)
    values[:, 0] = dc - np.where(restarts, 0, np.concatenate([[0], dc[:-1]]))
    # of a zero block: its DC value, and the code that ends it
    coded = held[:, None] | (np.arange(BLOCK) < 2)
    size = _SIZE[values + 255]
    # tables of each stream, from its own counts of sizes
    kind = of[:, None] * 2 + (np.arange(BLOCK) > 0)
    counts = np.bincount((kind * 9 + size)[coded], minlength=len(payloads) * 18).reshape(-1, 9)
    codes, lengths = np.zeros_like(counts), np.zeros_like(counts)
    heads = [_table(0x10 * (k % 2), c, codes[k], lengths[k]) for k, c in enumerate(counts.tolist())]
    # codes and values as bits one after another, each segment from a whole byte on
    n_bits = np.where(coded, lengths[kind, size] + size, 0)
    word = (codes[kind, size] << size) | np.where(values < 0, values + (1 << size) - 1, values)
    each = n_bits.sum(axis=1)
    seg = np.flatnonzero(restarts)
    seg_bits = np.add.reduceat(each, seg)
    seg_bytes = (seg_bits + 7) >> 3
    seg_from = np.cumsum(seg_bytes) - seg_bytes
    before = np.cumsum(n_bits.ravel()) - n_bits.ravel()
    base = before.reshape(-1, BLOCK)[seg, 0]
    per = np.diff(np.append(seg, len(of))) * BLOCK
    pos = before + np.repeat(8 * seg_from - base, per)
    shifted = np.where(coded, word, 0).ravel() << (32 - n_bits.ravel() - (pos & 7))
    total = int(seg_bytes.sum())
    out = np.zeros(total + 4)
    for k in range(4):
        out += np.bincount((pos >> 3) + k, weights=shifted >> (24 - 8 * k) & 255, minlength=total + 4)
    raw = out[:total].astype(np.uint8)
    raw[seg_from + seg_bytes - 1] |= ((1 << (8 * seg_bytes - seg_bits)) - 1).astype(np.uint8)  # ones up to the byte's end
    scan, streams, at = raw.tobytes(), [], 0
    ends = (seg_from + seg_bytes).tolist()
    for d, ((wide, high), p) in enumerate(zip(shapes, payloads, strict=True)):
        n = -(-wide * high // RESTART)
        pieces = [scan[ends[k] - int(seg_bytes[k]) : ends[k]].replace(b"\xff", b"\xff\x00") for k in range(at, at + n)]
        at += n
        body = pieces[0] + b"".join(bytes([0xFF, 0xD0 + (k % 8)]) + x for k, x in enumerate(pieces[1:]))
        frame = bytes([8]) + (high * 8).to_bytes(2) + (wide * 8).to_bytes(2) + bytes([1, 1, 0x11, 0])
        streams.append(b"\xff\xd8" + _segment(0xFE, f"payload_bytes={len(p)}".encode()) + _QUANT + heads[2 * d] + heads[2 * d + 1] + _segment(0xC0, frame) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + body + b"\xff\xd9")
    return streams


def encode_payload(payload: bytes) -> bytes:
    return encode_many([payload])[0]


def decode_payload(pic: Picture) -> bytes:
    """The payload of encode_payload, from decoded coefficients."""
    if not pic.comment.startswith(b"payload_bytes="):
        raise JpegError("no payload in this picture")
    blocks = pic.components[0].blocks.reshape(-1, 64)
    values = blocks.astype(np.int64)
    values[:, 0] += values[:, 0] >= 0
    n = int(pic.comment[14:])
    if not 0 <= n <= values.size or (np.abs(values) > 128).any():
        raise JpegError("no payload in this picture")
    return _BYTE[values.ravel()[:n] + 128].tobytes()


def media(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, media: every text (null: empty) as UTF-8 in a JPEG, zero bytes up to a positive multiple of 64 behind it.

    Texts of any length up to 4 GB go in whole; repeated rows have a stream each; other columns are left aside; an empty table gives no rows.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            streams = encode_many([x + bytes(-len(x) % BLOCK or (0 if x else BLOCK)) for x in raw])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(streams, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(store, "doc_id bigint, n_bytes bigint, media binary")


def _payload_of(pic: Picture | None) -> bytes | None:
    try:
        return None if pic is None else decode_payload(pic)
    except (JpegError, ValueError):
        return None


def media_features(media: DataFrame) -> DataFrame:
    """Reads a media column back: sizes, hashes of payload and stream, crc32 of the payload's last 64 bytes, and features.

    A stream that is no sound baseline JPEG with a payload gets nulls beside its own size and hash, a null stream nulls alone (general pictures: see picture_features).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", BATCH_BYTES):
            streams = batch.column(2).to_pylist()
            out = []
            for stream, pic in zip(streams, decode_many(streams), strict=True):
                own = (None, None) if stream is None else (len(stream), hashlib.sha256(stream).hexdigest())
                payload = _payload_of(pic)
                out.append((None, None, None, *own, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *own, features(pic)))
            cols = zip(*out, strict=True)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def picture_features(pictures: DataFrame, media: str = "media") -> DataFrame:
    """All columns of pictures with width, height, thumb_hash of each stream of the column `media` as struct picture; nulls for what is no sound baseline JPEG."""

    @F.pandas_udf("width int, height int, thumb_hash string")
    def look(streams):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = [(None, None, None) if p is None else (p.width, p.height, features(p)) for p in decode_many(list(streams))]
        return pd.DataFrame(rows, columns=["width", "height", "thumb_hash"]).astype({"width": "Int32", "height": "Int32"})

    return pictures.withColumn("picture", look(F.col(media)))
