"""Media columns: FLAC streams of 8-bit mono samples, written, verified and read back.

Blocks of equal length are coded and decoded together, one numpy step over all of them at a time.
A stream has STREAMINFO (with the MD5 of its samples), a SEEKTABLE with one point for every block,
so that any sample range is read without what stands before it, and frames with one subframe each:
a fixed predictor of order 0 to 2 or a quantised linear predictor of order 4, and Rice residuals.
Reading checks the CRC-8 of each header, the CRC-16 of each frame, the lengths and the MD5.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import text_of

BLOCK = 1024  # samples of all blocks but a stream's last
RATE = 8000
UNIT = 64  # payloads are padded to a positive multiple of this
ORDER = 4  # of the quantised linear predictor
PRECISION = 8  # bits of its coefficients
SHIFT = 6
#: The format's predictors of order 0, 1 and 2.
FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0]], np.int32)
SLICE = 2048  # blocks that are in work at a time


class CorruptStream(ValueError):
    pass


@lru_cache(maxsize=1)
def _crc8_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x << 1 ^ 0x07 if x & 128 else x << 1) & 255
        out.append(x)
    return out


def _crc8(data: bytes) -> int:
    crc, table = 0, _crc8_table()
    for x in data:
        crc = table[crc ^ x]
    return crc


_crc16_rows = np.zeros((0, 256), np.uint16)


def _crc16_by_distance(n: int) -> np.ndarray:
    """Row d: the CRC-16 of each byte with d zero bytes after it."""
    global _crc16_rows
    if len(_crc16_rows) < n:
        first = np.arange(256, dtype=np.uint32) << 8
        for _ in range(8):
            first = np.where(first & 0x8000, first << 1 ^ 0x8005, first << 1) & 0xFFFF
        first = first.astype(np.uint16)
        rows = [first]
        for _ in range(max(n, 2048) - 1):
            rows.append((rows[-1] << 8) ^ first[rows[-1] >> 8])
        _crc16_rows = np.array(rows, np.uint16)
    return _crc16_rows


def _crc16(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of each run of `flat` (runs without gaps): a run's CRC is the XOR of its bytes' own."""
    table = _crc16_by_distance(int(sizes.max()))
    distance = np.repeat(starts + sizes - 1 - starts[0], sizes) - np.arange(int(sizes.sum()))
    own = table.ravel()[distance * 256 + flat[starts[0] : starts[0] + int(sizes.sum())]]
    return np.bitwise_xor.reduceat(own, starts - starts[0])


def _number(n: int) -> bytes:
    """A frame number in the format's UTF-8 manner, up to 36 bits."""
    if n < 128:
        return bytes([n])
    tail = []
    limit = 63
    while n > limit or not tail:
        tail.append(128 | n & 63)
        n >>= 6
        limit = (1 << (6 - len(tail))) - 1
    lead = (0xFF00 >> (len(tail) + 1)) & 255
    return bytes([lead | n, *reversed(tail)])


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    lead = data[at]
    if lead < 128:
        return lead, at + 1
    n = 8 - (lead ^ 255).bit_length()
    value = lead & ((1 << (7 - n)) - 1)
    for x in data[at + 1 : at + n]:
        value = value << 6 | x & 63
    return value, at + n


def _header(number: int, n: int) -> bytes:
    head = b"\xff\xf8\x70\x02" + _number(number) + struct.pack(">H", n - 1)
    return head + bytes([_crc8(head)])


def _predictors(x: np.ndarray) -> np.ndarray:
    """Quantised predictors of each row, by the autocorrelation method; zeros where there is none."""
    wide = x.astype(np.float32)
    n = x.shape[1]
    r = np.stack([np.einsum("ij,ij->i", wide[:, k:], wide[:, : n - k]) for k in range(ORDER + 1)], 1).astype(np.float64)
    r[:, 0] = r[:, 0] * 1.0001 + 1e-3
    a = np.zeros((len(x), ORDER))
    error = r[:, 0].copy()
    for i in range(ORDER):  # Levinson-Durbin
        k = (r[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], r[:, i:0:-1])) / error
        a[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        error *= 1 - k * k
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << SHIFT)), -top, top).astype(np.int32)


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
    for j in range(width):
        bits[at + j] = value >> (width - 1 - j) & 1
    return at + width


def _encode(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """The frames of blocks of one length: the rows of `x`, samples in -128..127."""
    f, n = x.shape
    x = x.astype(np.int32)
    choices = [x[:, ORDER:], x[:, ORDER:] - x[:, ORDER - 1 : -1], x[:, ORDER:] - 2 * x[:, ORDER - 1 : -1] + x[:, ORDER - 2 : -2]]
    lpc = _predictors(x)
    guess = lpc[:, :1] * x[:, ORDER - 1 : -1]
    for j in range(1, ORDER):
        guess += lpc[:, j : j + 1] * x[:, ORDER - 1 - j : n - 1 - j]
    choices.append(x[:, ORDER:] - (guess >> SHIFT))
    worth = np.stack([np.abs(c).sum(1) for c in choices], 1)
    worth[:, 3] += ORDER * PRECISION + 9
    kind = worth.argmin(1)
    order = np.where(kind == 3, ORDER, kind)
    # residuals of the whole block; below the order, where samples stand for themselves, nothing is written
    e = np.zeros((f, n), np.int32)
    for k, c in enumerate(choices):
        e[kind == k, ORDER:] = c[kind == k]
    e[kind == 0, :ORDER] = x[kind == 0, :ORDER]
    e[kind == 1, 1:ORDER] = (x[:, 1:] - x[:, :-1])[kind == 1, : ORDER - 1]
    e[kind == 2, 2:ORDER] = (x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2])[kind == 2, : ORDER - 2]
    u = (e << 1) ^ (e >> 31)
    k0 = np.maximum(np.floor(np.log2(np.maximum(u.mean(1) * 0.69, 1e-3))), 0).astype(np.int32)
    cost = np.stack([(u >> (k0 + d)[:, None]).sum(1) + n * (k0 + d) for d in (0, 1)], 1)
    k = k0 + cost.argmin(1).astype(np.int32)
    q = u >> k[:, None]
    sizes = q + (1 + k)[:, None]
    for i in range(ORDER):
        sizes[order > i, i] = 0
    heads = [_header(number, n) for number in numbers]
    head_sizes = np.array([len(h) for h in heads])
    before = 8 + 8 * order + np.where(kind == 3, 9 + ORDER * PRECISION, 0) + 10
    body = (before + sizes.sum(1) + 7) // 8
    totals = head_sizes + body + 2
    starts = np.cumsum(totals) - totals
    bits = np.zeros(int(totals.sum()) * 8, np.uint8)
    at = (starts + head_sizes) * 8
    at = _put(bits, at, np.where(kind == 3, (32 + ORDER - 1) << 1, (8 + kind) << 1), 8)
    for i in range(ORDER):
        own = order > i
        at[own] = _put(bits, at[own], x[own, i] & 255, 8)
    own = kind == 3
    if own.any():
        p = _put(bits, at[own], np.full(own.sum(), PRECISION - 1), 4)
        p = _put(bits, p, np.full(own.sum(), SHIFT), 5)
        for j in range(ORDER):
            p = _put(bits, p, lpc[own, j] & ((1 << PRECISION) - 1), PRECISION)
        at[own] = p
    at = _put(bits, at + 6, k, 4)  # Rice coding with 4-bit parameters, one partition
    place = np.cumsum(sizes, 1)
    place += (at[:, None] - sizes) + q  # the bit that ends the unary part
    for i in range(ORDER):
        place[order > i, i] = place[order > i, ORDER]  # nothing of its own
    bits[place] = 1
    for i in range(ORDER):
        u[order > i, i] = u[order > i, ORDER]
    for width in np.unique(k):
        own = k == width
        p, v = (place, u) if own.all() else (place[own], u[own])
        for j in range(width):
            bits[p + (j + 1)] = v >> (width - 1 - j) & 1
    flat = np.packbits(bits)
    flat[np.repeat(starts - np.cumsum(head_sizes) + head_sizes, head_sizes) + np.arange(int(head_sizes.sum()))] = np.frombuffer(b"".join(heads), np.uint8)
    crc = _crc16(np.delete(flat, np.concatenate([starts + totals - 2, starts + totals - 1])), np.cumsum(totals - 2) - (totals - 2), totals - 2)
    flat[starts + totals - 2], flat[starts + totals - 1] = crc >> 8, crc & 255
    data = flat.tobytes()
    return [data[a : a + b] for a, b in zip(starts.tolist(), totals.tolist(), strict=True)]


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads, each a positive multiple of UNIT bytes of unsigned 8-bit samples."""
    frames: list[list[bytes]] = [[b""] * -(-len(p) // BLOCK) for p in payloads]
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, p in enumerate(payloads):
        for j in range(len(frames[i])):
            groups[min(BLOCK, len(p) - j * BLOCK)].append((i, j))
    for n, own in groups.items():
        for a in range(0, len(own), SLICE):
            part = own[a : a + SLICE]
            raw = b"".join([payloads[i][j * BLOCK : j * BLOCK + n] for i, j in part])
            x = (np.frombuffer(raw, np.uint8) ^ 128).view(np.int8).reshape(len(part), n)
            for (i, j), frame in zip(part, _encode(x, [j for _, j in part]), strict=True):
                frames[i][j] = frame
    out = []
    for p, own in zip(payloads, frames, strict=True):
        sizes = [len(x) for x in own]
        packed = RATE << 44 | 0 << 41 | 7 << 36 | len(p)
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed).digest()
        at, points = 0, []
        for j, size in enumerate(sizes):
            points.append(struct.pack(">QQH", j * BLOCK, at, min(BLOCK, len(p) - j * BLOCK)))
            at += size
        table = b"".join(points)
        if len(table) > 0xFFFFFF:
            raise ValueError("a seek table holds 932,067 points, or some 950 MB of one text")
        out.append(b"".join([b"fLaC\x00", (34).to_bytes(3, "big"), info, b"\x83", len(table).to_bytes(3, "big"), table, *own]))
    return out


def _parse(stream: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """Samples, MD5, seek points (sample, offset, length) and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise CorruptStream("no FLAC stream")
    at, samples, md5, points, last = 4, 0, b"", [], False
    while not last:
        last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            samples, md5 = int.from_bytes(block[10:18], "big") & ((1 << 36) - 1), block[18:34]
        elif kind == 3:
            points = list(struct.iter_unpack(">QQH", block))
    return samples, md5, points, at


def _decode(frames: list[bytes], expected: list[tuple[int, int]]) -> np.ndarray:
    """The samples of frames of one length, a row each; `expected`: frame number and length of each."""
    n = expected[0][1]
    f = len(frames)
    flat = np.frombuffer(b"".join(frames) + bytes(4), np.uint8)
    sizes = np.array([len(x) for x in frames])
    starts = np.cumsum(sizes) - sizes
    if _crc16(flat, starts, sizes).any():  # a frame with its own CRC behind it has the CRC 0
        raise CorruptStream("a frame's CRC-16 is wrong")
    coefs, shift, order, k, pos = np.zeros((f, ORDER), np.int32), np.zeros(f, np.int32), np.zeros(f, np.int32), np.zeros(f, np.int64), np.zeros(f, np.int64)
    x = np.zeros((n, f), np.int32)
    begins = starts.tolist()
    for i, frame in enumerate(frames):
        number, at = _read_number(frame, 4)
        if frame[:4] != b"\xff\xf8\x70\x02" or _crc8(frame[: at + 2]) != frame[at + 2]:
            raise CorruptStream("a frame's header is wrong")
        if (number, int.from_bytes(frame[at : at + 2], "big") + 1) != expected[i]:
            raise CorruptStream("a frame isn't where the seek table has it")
        kind = frame[at + 3] >> 1
        at += 4
        o = kind - 31 if kind >= 32 else kind - 8
        if not 0 <= o <= ORDER or kind < 8:
            raise CorruptStream("a subframe of a kind that isn't written here")
        for j in range(o):
            x[j, i] = (frame[at + j] ^ 128) - 128
        at += o
        bit = at * 8
        if kind >= 32:
            window = int.from_bytes(frame[at : at + 8], "big")
            precision, shift[i] = (window >> 60) + 1, window >> 55 & 31
            for j in range(o):
                c = window >> (55 - (j + 1) * precision) & ((1 << precision) - 1)
                coefs[i, j] = c - (1 << precision) if c >> (precision - 1) else c
            bit += 9 + o * precision
        else:
            coefs[i] = FIXED[o]
        at = bit >> 3
        window = int.from_bytes(frame[at : at + 4], "big") >> (22 - (bit & 7)) & 1023
        if window >> 4:
            raise CorruptStream("more than one Rice partition")
        order[i], k[i], pos[i] = o, window & 15, begins[i] * 8 + bit + 10
    bits = np.unpackbits(flat)
    ones = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(len(bits) - 1))
    stop_at = np.minimum.accumulate(ones[::-1])[::-1]  # the next set bit from each bit on
    stops = np.empty((n, f), np.int32)
    begun = np.empty((n, f), np.int32)
    step = (k + 1).astype(np.int32)
    at = pos.astype(np.int32)
    for i in range(n):
        begun[i] = at
        stop = stop_at[at]
        stops[i] = stop
        stop = stop + step
        at = np.where(order > i, at, stop) if i < ORDER else stop
    if (at > (starts + sizes) * 8 - 16).any():
        raise CorruptStream("residuals go on beyond their frame")
    rest = stops + 1
    wide = flat.astype(np.uint32)
    windows = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    kk = k.astype(np.int32)
    low = (windows[np.minimum(rest >> 3, len(windows) - 1)] >> (24 - (rest & 7) - kk).astype(np.uint32)).astype(np.int32) & ((1 << kk) - 1)
    u = (stops - begun) << kk | low
    e = (u >> 1) ^ -(u & 1)
    c = [np.ascontiguousarray(coefs[:, j]) for j in range(ORDER)]
    for i in range(n):
        guess = sum((c[j] * x[i - 1 - j] for j in range(min(ORDER, i))), np.zeros(f, np.int32)) if i < ORDER else c[0] * x[i - 1] + c[1] * x[i - 2] + c[2] * x[i - 3] + c[3] * x[i - 4]
        value = e[i] + (guess >> shift)
        x[i] = np.where(order > i, x[i], value) if i < ORDER else value
    return x.T


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """The payloads; raises CorruptStream where anything doesn't fit."""
    parsed = [_parse(s) for s in streams]
    blocks: list[list[bytes]] = []
    groups: dict[int, list[tuple[int, int, bytes]]] = defaultdict(list)
    for i, (stream, (samples, _, points, begin)) in enumerate(zip(streams, parsed, strict=True)):
        blocks.append([b""] * len(points))
        if sum(n for _, _, n in points) != samples:
            raise CorruptStream("the seek table doesn't cover the stream")
        ends = [offset for _, offset, _ in points[1:]] + [len(stream) - begin]
        for j, ((_, offset, n), end) in enumerate(zip(points, ends, strict=True)):
            groups[n].append((i, j, stream[begin + offset : begin + end]))
    for n, own in groups.items():
        for a in range(0, len(own), SLICE):
            part = own[a : a + SLICE]
            x = _decode([frame for *_, frame in part], [(j, n) for _, j, _ in part])
            raw = (x.astype(np.int8).view(np.uint8) ^ 128).tobytes()
            for m, (i, j, _) in enumerate(part):
                blocks[i][j] = raw[m * n : m * n + n]
    out = []
    for (_, md5, _, _), own in zip(parsed, blocks, strict=True):
        payload = b"".join(own)
        if hashlib.md5((np.frombuffer(payload, np.uint8) ^ 128).tobytes()).digest() != md5:
            raise CorruptStream("the MD5 of the samples is wrong")
        out.append(payload)
    return out


def read_samples(stream: bytes, start: int, count: int) -> bytes:
    """Samples `start` to `start + count` by the seek table: only the blocks that hold them are decoded."""
    samples, _, points, begin = _parse(stream)
    end = min(samples, start + count)
    ends = [offset for _, offset, _ in points[1:]] + [len(stream) - begin]
    out, first = [], None
    for (sample, offset, n), stop in zip(points, ends, strict=True):
        if sample < end and sample + n > start:
            first = sample if first is None else first
            row = _decode([stream[begin + offset : begin + stop]], [(sample // BLOCK, n)])[0]
            out.append((row.astype(np.int8).view(np.uint8) ^ 128).tobytes())
    return b"".join(out)[start - first : end - first] if out else b""


def payload_of(text: str) -> bytes:
    """UTF-8 with zero bytes up to a positive multiple of UNIT."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\x00")


def features_of(payload: bytes) -> str:
    """Peak, root mean square and zero crossings of the samples, in decimals that don't depend on rounding modes."""
    x = (np.frombuffer(payload, np.uint8) ^ 128).view(np.int8)
    square = int(np.dot(x.astype(np.int32), x.astype(np.int32)).item()) if len(x) < 100_000 else int((x.astype(np.int64) ** 2).sum())
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"peak={max(int(x.max()), -int(x.min()))};rms={(square / len(x)) ** 0.5:.4f};zcr={crossings / len(x):.6f}"


def _slices(sizes: list[int], most: int = 4 << 20) -> Iterator[slice]:
    """Runs of rows of about `most` bytes, one row at least."""
    begin = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > most:
            yield slice(begin, k)
            begin, total = k, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def write_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (of the text in UTF-8, without padding), media (the FLAC stream).

    A null text counts as empty, whose payload is UNIT zero bytes. Repeated rows stay repeated, an
    empty table gives none, other columns aren't looked at. A worker holds the blocks of a few MB
    of text, or of one text, at a time. A text of some 950 MB or more raises a ValueError: the
    format's seek table can't hold a point for each of its blocks.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("_text")]
            for part in _slices(sizes):
                own = batch.slice(part.start, part.stop - part.start)
                streams = encode_streams([payload_of(x) for x in own.column("_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([own.column("_id"), pa.array(sizes[part], pa.int64()), pa.array(streams, pa.binary())], [id_col, "n_bytes", "media"])

    return docs.select(docs[id_col].alias("_id"), text_of(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def read_media(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Reads back what write_media() stored: payload sums, stored sums and features of each row.

    Raises CorruptStream if a stream doesn't decode to what its checksums say.
    """
    kind = media.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices([len(x.as_buffer()) for x in batch.column("media")]):
                own = batch.slice(part.start, part.stop - part.start)
                streams = own.column("media").to_pylist()
                rows = [
                    (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(s), hashlib.sha256(s).hexdigest(), features_of(p))
                    for p, s in zip(decode_streams(streams), streams, strict=True)
                ]
                arrays = [pa.array(list(col), t) for col, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([own.column(id_col), own.column("n_bytes"), *arrays], [id_col, "n_bytes", *names])

    return media.select(id_col, "n_bytes", "media").mapInArrow(run, schema)
