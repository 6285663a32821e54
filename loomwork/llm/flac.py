"""FLAC streams for media columns: bytes as mono 8-bit samples, coded losslessly and read back with checksums.

The format is the public one: stream info, a seek table with a point for every frame, then frames of fixed block size with
a CRC-8 over the header and a CRC-16 over the frame. Frames are independent, so both directions work on some thousands of
frames at a time, of whatever streams, as NumPy columns: sample t of all frames in one step. Memory follows the number of
frames in a group (``GROUP_FRAMES``), not the length of a stream.

The encoder tries a plain copy, fixed predictors of order 0 and 1 and a linear predictor of order 4 for each frame, and
codes residuals in four Rice partitions. The decoder reads constant, verbatim, fixed and linear frames of any order with
any number of Rice partitions; it reports frames it can't read (several channels, wasted bits) instead of guessing.

A sample is a byte less 128, as any reader of 8-bit FLAC has it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 2048
RATE = 8000
ALIGN = 64
GROUP_FRAMES = 4096
PRECISION = 8
SHIFT = 6
ORDER = 4
#: Fixed values of the format: predictors of order 0 to 4.
FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {c: 256 << (c - 8) for c in range(8, 16)}


#: Bytes as signed samples, and back.
_SIGNED = bytes(x ^ 0x80 for x in range(256))


def _crc_table(poly: int, bits: int) -> np.ndarray:
    table, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = ((crc << 1) ^ poly if crc & top else crc << 1) & mask
        table.append(crc)
    return np.array(table, np.uint16)


_CRC8 = _crc_table(0x07, 8).tolist()
_CRC16 = _crc_table(0x8005, 16)
_CRC16_LIST = _CRC16.tolist()
_ZEROS16 = (16 - np.ceil(np.log2(np.arange(65536) + 1))).astype(np.int64)


def crc8(data: bytes) -> int:
    crc = 0
    for x in data:
        crc = _CRC8[crc ^ x]
    return crc


def crc16(data: bytes) -> int:
    crc = 0
    for x in data:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC16_LIST[(crc >> 8) ^ x]
    return crc


def crc16_of(frames: list[bytes]) -> np.ndarray:
    """CRC-16 of many frames, byte by byte of all of them together."""
    sizes = np.array([len(f) for f in frames])
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(frames), np.uint8)
    starts = (np.cumsum(sizes) - sizes)[order]
    ordered = sizes[order]
    crc = np.zeros(len(frames), np.uint16)
    for i in range(int(ordered[0]) if len(frames) else 0):
        n = int(np.searchsorted(-ordered, -i, "left"))  # frames longer than i
        now = crc[:n]
        crc[:n] = (now << np.uint16(8)) ^ _CRC16[(now >> np.uint16(8)) ^ data[starts[:n] + i]]
    out = np.empty(len(frames), np.uint16)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """The frame number in UTF-8's scheme, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1 if k < 7 else 36))
    tail = [0x80 | (n >> 6 * i) & 0x3F for i in range(size - 1)]
    first = (0xFF00 >> size) & 0xFF | n >> 6 * (size - 1)
    return bytes([first, *reversed(tail)])


def _header(number: int, n: int) -> bytes:
    full = n == BLOCK
    head = bytes([0xFF, 0xF8, ((BLOCK.bit_length() - 1) << 4 if full else 0x70) | 4, 0x02]) + _coded_number(number)
    head += b"" if full else (n - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


# ---------------------------------------------------------------- encoder


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(u: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
    """(parameter per frame and partition, bits per frame) for residuals u after ``skip`` warm-up samples."""
    f, n = u.shape[0], u.shape[1] + skip
    padded = np.concatenate([np.zeros((f, skip), u.dtype), u], 1).reshape(f, 4, n // 4)
    count = np.full(4, n // 4)
    count[0] -= skip
    mean = padded.sum(2) / count
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1e-9) * 0.7 + 1e-9)), 0, 12).astype(np.int32)
    low = (padded >> k[:, :, None]).sum(2) + count * (k + 1)
    up = (padded >> (k + 1)[:, :, None]).sum(2) + count * (k + 2)
    return np.where(up < low, k + 1, k), np.minimum(low, up).sum(1) + 6 + 16


def _linear(x: np.ndarray) -> np.ndarray:
    """Quantised coefficients of a linear predictor for each row."""
    n = x.shape[1]
    lags = np.stack([(x[:, : n - j].astype(np.int64) * x[:, j:]).sum(1) for j in range(ORDER + 1)], 1).astype(float)
    at = np.abs(np.arange(ORDER)[:, None] - np.arange(ORDER)[None, :])
    left = lags[:, at] + np.eye(ORDER) * (1.0 + 1e-3 * lags[:, :1, None])
    solved = np.linalg.solve(left, lags[:, 1:, None])[:, :, 0]
    return np.clip(np.round(solved * (1 << SHIFT)), -128, 127).astype(np.int32)


def _predicted(x: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    total = sum(coefficients[:, j, None] * x[:, ORDER - 1 - j : n - 1 - j] for j in range(ORDER))
    return total >> SHIFT


def _bits(tokens: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[bytes]:
    """Rows of tokens (leading zeros, width, value) as bytes, each row filled up to whole bytes."""
    zeros, width, value = (np.concatenate(x, 1) for x in zip(*tokens, strict=True))
    ends = np.cumsum(zeros + width, 1, dtype=np.int64)
    sizes = (ends[:, -1] + 7) // 8
    starts = np.cumsum(sizes) - sizes
    ends += 8 * starts[:, None]
    bits = np.zeros(8 * int(sizes.sum()), np.uint8)
    flat_ends, flat_width, flat_value = ends.ravel(), width.ravel(), value.ravel()
    for j in range(int(width.max())):
        has = (flat_width > j) & ((flat_value >> j) & 1 == 1)
        bits[flat_ends[has] - 1 - j] = 1
    data = np.packbits(bits).tobytes()
    return [data[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


def _token(f: int, width: int, value) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    value = np.asarray(value, np.int32)
    value = np.broadcast_to(value if value.ndim == 2 else value.reshape(-1, 1) if value.ndim else value, (f, value.shape[1] if value.ndim == 2 else 1))
    return np.zeros(value.shape, np.int32), np.full(value.shape, width, np.int32), value & ((1 << width) - 1)


def _residual_tokens(u: np.ndarray, k: np.ndarray, skip: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    f, n = u.shape[0], u.shape[1] + skip
    out, at = [_token(f, 6, 2)], 0  # Rice parameters of 4 bits, partitions 2^2
    for p in range(4):
        to = at + n // 4 - (skip if p == 0 else 0)
        kp, part = k[:, p, None], u[:, at:to]
        out.append(_token(f, 4, k[:, p]))
        width = np.broadcast_to(kp + 1, part.shape)
        out.append((part >> kp, width, (1 << kp) | (part & ((1 << kp) - 1))))
        at = to
    return out


def _bodies(x: np.ndarray) -> list[bytes]:
    """Subframes of the rows of ``x``, all of the same length."""
    f, n = x.shape
    plain = _zigzag(x)
    first = _zigzag(x[:, 1:] - x[:, :-1])
    k0, bits0 = _rice(plain, 0)
    k1, bits1 = _rice(first, 1)
    coefficients = _linear(x)
    linear = _zigzag(x[:, ORDER:] - _predicted(x, coefficients))
    k4, bits4 = _rice(linear, ORDER)
    costs = np.stack([np.where((x == x[:, :1]).all(1), 0, 1 << 30), np.full(f, 8 * n), bits0, bits1 + 8, bits4 + 41 + 8 * ORDER])
    kind = costs.argmin(0)
    out: list[bytes] = [b""] * f
    for c in range(5):
        own = np.flatnonzero(kind == c)
        if not len(own):
            continue
        m, xs = len(own), x[own]
        if c == 0:
            tokens = [_token(m, 8, 0), _token(m, 8, xs[:, :1])]
        elif c == 1:
            tokens = [_token(m, 8, 0x02), _token(m, 8, xs)]
        elif c == 2:
            tokens = [_token(m, 8, 0x10), *_residual_tokens(plain[own], k0[own], 0)]
        elif c == 3:
            tokens = [_token(m, 8, 0x12), _token(m, 8, xs[:, :1]), *_residual_tokens(first[own], k1[own], 1)]
        else:
            tokens = [
                _token(m, 8, (0x20 | (ORDER - 1)) << 1),
                _token(m, 8, xs[:, :ORDER]),
                _token(m, 4, PRECISION - 1),
                _token(m, 5, SHIFT),
                _token(m, PRECISION, coefficients[own]),
                *_residual_tokens(linear[own], k4[own], ORDER),
            ]
        for i, body in zip(own.tolist(), _bits(tokens), strict=True):
            out[i] = body
    return out


def _encode_frames(blocks: list[tuple[int, bytes]]) -> list[bytes]:
    """Frames of (frame number, signed samples)."""
    bodies: list[bytes] = [b""] * len(blocks)
    by_size: dict[int, list[int]] = {}
    for i, (_, data) in enumerate(blocks):
        by_size.setdefault(len(data), []).append(i)
    for n, own in by_size.items():
        x = np.frombuffer(b"".join(blocks[i][1] for i in own), np.int8).reshape(len(own), n).astype(np.int32)
        for i, body in zip(own, _bodies(x), strict=True):
            bodies[i] = body
    frames = [_header(number, len(data)) + body for (number, data), body in zip(blocks, bodies, strict=True)]
    return [f + int(c).to_bytes(2, "big") for f, c in zip(frames, crc16_of(frames), strict=True)]


def encode(payloads: Iterable[bytes]) -> Iterator[bytes]:
    """A FLAC stream of each payload; payloads are positive multiples of 64 bytes long."""
    waiting: list[tuple[bytes, int]] = []
    blocks: list[tuple[int, bytes]] = []
    done: list[bytes] = []

    def ready() -> Iterator[bytes]:
        at = 0
        while waiting and at + waiting[0][1] <= len(done):
            signed, n = waiting.pop(0)
            yield _stream(signed, done[at : at + n])
            at += n
        del done[:at]

    for payload in payloads:
        signed = payload.translate(_SIGNED)
        pieces = [signed[i : i + BLOCK] for i in range(0, len(signed), BLOCK)]
        waiting.append((signed, len(pieces)))
        for number, piece in enumerate(pieces):
            blocks.append((number, piece))
            if len(blocks) == GROUP_FRAMES:
                done += _encode_frames(blocks)
                blocks = []
        yield from ready()
    done += _encode_frames(blocks) if blocks else []
    yield from ready()


def _stream(signed: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    fields = (RATE << 44) | (0 << 41) | (7 << 36) | len(signed)
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += fields.to_bytes(8, "big") + hashlib.md5(signed).digest()
    points, at = [], 0
    for i, f in enumerate(frames):
        points.append(struct.pack(">QQH", i * BLOCK, at, min(BLOCK, len(signed) - i * BLOCK)))
        at += len(f)
    table = b"".join(points)
    blocks = [(0, info)] + ([(3, table)] if len(table) < 1 << 24 else [])
    heads = [bytes([k | (0x80 if i == len(blocks) - 1 else 0)]) + len(x).to_bytes(3, "big") for i, (k, x) in enumerate(blocks)]
    return b"fLaC" + b"".join(h + x for h, (_, x) in zip(heads, blocks, strict=True)) + b"".join(frames)


# ---------------------------------------------------------------- decoder


class Damaged(ValueError):
    """A stream that can't be read, or whose checksums don't hold."""


def _parse_header(data: bytes, at: int) -> tuple[int, int, int]:
    """(frame number, block size, header size) at a place; Damaged if no valid header starts there."""
    if data[at : at + 2] != b"\xff\xf8" or at + 6 > len(data):
        raise Damaged("no frame here")
    code, first = data[at + 2] >> 4, data[at + 4]
    more = 0 if first < 0x80 else next((k for k in range(1, 7) if not first & (0x40 >> k)), 6)
    number = first if first < 0x80 else first & (0x3F >> more)
    for b in data[at + 5 : at + 5 + more]:
        number = number << 6 | b & 0x3F
    end = at + 5 + more
    if code in (6, 7):
        n = int.from_bytes(data[end : end + code - 5], "big") + 1
        end += code - 5
    else:
        n = BLOCK_CODES.get(code, 0)
    end += {12: 1, 13: 2, 14: 2}.get(data[at + 2] & 15, 0)
    if not n or end >= len(data) or crc8(data[at:end]) != data[end]:
        raise Damaged("frame header checksum")
    if data[at + 3] >> 4:
        raise Damaged("more than one channel")
    if data[at + 3] >> 1 & 7 not in (0, 1):
        raise Damaged("samples of more than 8 bits")
    return number, n, end + 1 - at


def frames_of(data: bytes) -> tuple[list[tuple[int, int, int, int]], bytes]:
    """((start, size, header size, samples) of each frame, MD5 of the samples)."""
    if data[:4] != b"fLaC":
        raise Damaged("no FLAC stream")
    at, last, total, md5, points = 4, False, 0, b"", b""
    while not last:
        kind, size = data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        last = bool(data[at] & 0x80)
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            fields = int.from_bytes(body[10:18], "big")
            total, md5 = fields & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            points = body
        at += 4 + size
    seek = [struct.unpack_from(">QQH", points, i) for i in range(0, len(points), 18)]
    starts = [at + x[1] for x in seek if x[0] != (1 << 64) - 1]
    if sum(x[2] for x in seek if x[0] != (1 << 64) - 1) != total:
        starts = _scan(data, at)
    out = []
    for a, b in zip(starts, [*starts[1:], len(data)], strict=True):
        _, n, head = _parse_header(data, a)
        out.append((a, b - a, head, n))
    if sum(x[3] for x in out) != total:
        raise Damaged("samples are missing")
    return out, md5


def _scan(data: bytes, at: int) -> list[int]:
    """Frame starts without a whole seek table: the next valid header at which the frame's checksum holds."""
    starts, number = [at], 0
    while True:
        found = data.find(b"\xff\xf8", starts[-1] + 6)
        while found >= 0:
            try:
                if _parse_header(data, found)[0] == number + 1 and crc16(data[starts[-1] : found]) == 0:
                    break
            except Damaged:
                pass
            found = data.find(b"\xff\xf8", found + 1)
        if found < 0:
            return starts
        starts.append(found)
        number += 1


def _signed(value: int, bits: int) -> int:
    return value - (1 << bits) if value >> (bits - 1) else value


def _decode_frames(frames: list[tuple[bytes, int, int]]) -> list[bytes]:
    """Signed samples of (frame bytes, header size, samples), a byte each; damaged frames come back empty."""
    out: list[bytes] = [b""] * len(frames)
    sound = crc16_of([f[0] for f in frames]) == 0  # the CRC over a frame with its own CRC is zero
    todo, orders, coefs, shifts, warm, places = [], [], [], [], [], []
    base = 0
    for i, (data, head, n) in enumerate(frames):
        if sound[i]:
            kind = data[head] >> 1
            if data[head] & 0x81:
                kind = -1
            if kind == 0:
                out[i] = data[head + 1 : head + 2] * n
            elif kind == 1:
                out[i] = data[head + 1 : head + 1 + n]
            elif 8 <= kind <= 12 or kind >= 32:
                order = kind - 8 if kind < 32 else kind - 31
                window = int.from_bytes(data[head : head + 140], "big")
                have = 8 * len(data[head : head + 140])
                place = 8

                def read(bits: int, window=window, have=have) -> int:
                    nonlocal place
                    place += bits
                    return window >> (have - place) & ((1 << bits) - 1)

                warm.append([_signed(read(8), 8) for _ in range(order)])
                if kind < 32:
                    coefs.append(FIXED[order])
                    shifts.append(0)
                else:
                    precision = read(4) + 1
                    shifts.append(_signed(read(5), 5))
                    coefs.append([_signed(read(precision), precision) for _ in range(order)])
                if read(2) == 0 and shifts[-1] >= 0:
                    parts = read(4)
                    todo.append((i, n, order, n >> parts))
                    places.append(8 * (base + head) + place)
                else:
                    for x in (warm, coefs, shifts):
                        x.pop()
        base += len(data)
    if todo:
        for j in _decode_rice(b"".join(f[0] for f in frames), todo, coefs, shifts, warm, places, out):
            i, n, order, part = todo[j]
            place = places[j] - 8 * sum(len(f[0]) for f in frames[:i])
            out[i] = _decode_escaped(frames[i][0], place, n, part, coefs[j], shifts[j], warm[j])
    return out


def _decode_escaped(data: bytes, place: int, n: int, part: int, coefs: list[int], shift: int, warm: list[int]) -> bytes:
    """One frame with a partition whose residuals stand in plain bits, read bit by bit; such frames are rare."""
    bits, samples = bin(int.from_bytes(b"\x01" + data, "big"))[3:], list(warm)

    def read(size: int) -> int:
        nonlocal place
        place += size
        return int(bits[place - size : place] or "0", 2)

    while len(samples) < n and place < len(bits):
        k = read(4)
        plain = read(5) if k == 15 else 0
        for _ in range(part - (len(samples) if len(samples) == len(warm) else 0)):
            if k == 15:
                r = _signed(read(plain), plain) if plain else 0
            else:
                zeros = bits.find("1", place) - place
                if zeros < 0:
                    return b""
                place += zeros + 1
                u = zeros << k | read(k)
                r = (u >> 1) ^ -(u & 1)
            samples.append(r + (sum(c * samples[-1 - j] for j, c in enumerate(coefs)) >> shift))
    return bytes(x & 0xFF for x in samples) if len(samples) == n else b""


def _decode_rice(data: bytes, todo, coefs, shifts, warm, places, out: list[bytes]) -> list[int]:
    """Residuals of all frames step by step, then the predictors likewise. Places in ``todo`` of frames that this can't read."""
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    word = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    count = np.array([n - order for _, n, order, _ in todo])
    by = np.argsort(-count, kind="stable")
    count = count[by]
    order = np.array([t[2] for t in todo])[by]
    part = np.array([t[3] for t in todo])[by]
    at = np.array(places, np.int64)[by]
    left = np.zeros(len(todo), np.int64)
    first = part - order
    k = np.zeros(len(todo), np.int64)
    escaped = np.zeros(len(todo), bool)
    deepest, steps = max(1, int(order.max())), int(count[0])
    samples = np.zeros((deepest + steps, len(todo)), np.int64)
    active = np.searchsorted(-count, -np.arange(steps), "left")  # frames with more than t residuals
    limit = 8 * (len(word) - 1)
    fresh = np.ones(len(todo), bool)

    def window(p: np.ndarray) -> np.ndarray:
        p = np.minimum(p, limit)
        return word[p >> 3] << (p & 7).astype(np.uint32)

    for t in range(steps):
        n = int(active[t])
        now = np.flatnonzero(left[:n] == 0)
        if len(now):
            k[now] = window(at[now]) >> np.uint32(28)
            escaped[now] |= k[now] == 15
            at[now] += 4
            left[now] = np.where(fresh[now], first[now], part[now])
            fresh[now] = False
        p = at[:n]
        view = window(p)
        q = _ZEROS16[view >> np.uint32(16)]
        long = np.flatnonzero(q == 16)
        while len(long):
            more = _ZEROS16[window(p[long] + q[long]) >> np.uint32(16)]
            q[long] += more
            long = long[(more == 16) & (q[long] < 1 << 16)]
        p = p + q + 1
        width = k[:n]
        low = (window(p) >> np.uint32(1)).astype(np.int64) >> (31 - width)
        u = q << width | low
        samples[deepest + t, :n] = (u >> 1) ^ -(u & 1)
        at[:n] = p + width
        left[:n] -= 1
    table = np.zeros((deepest, len(todo)), np.int64)
    for column, i in enumerate(by.tolist()):
        for j, c in enumerate(coefs[i]):
            table[j, column] = c
        for j, w in enumerate(warm[i]):
            samples[deepest - order[column] + j, column] = w
    shift = np.array(shifts, np.int64)[by]
    for t in range(steps):
        n = int(active[t])
        total = np.zeros(n, np.int64)
        for j in range(deepest):
            total += table[j, :n] * samples[deepest + t - 1 - j, :n]
        samples[deepest + t, :n] += total >> shift[:n]
    rows = (samples.T & 0xFF).astype(np.uint8)
    for column, i in enumerate(by.tolist()):
        number, n, o, _ = todo[i]
        if not escaped[column]:
            out[number] = rows[column, deepest - o : deepest - o + n].tobytes()
    return by[escaped].tolist()


def decode(streams: Iterable[bytes]) -> Iterator[tuple[list[bytes], list[int], str | None]]:
    """(PCM blocks, sample offset of each, what is wrong) of each stream; a damaged stream has no blocks."""
    waiting: list[tuple[int, bytes, str | None]] = []
    frames: list[tuple[bytes, int, int]] = []
    done: list[bytes] = []

    def ready() -> Iterator[tuple[list[bytes], list[int], str | None]]:
        at = 0
        while waiting and at + waiting[0][0] <= len(done):
            n, md5, wrong = waiting.pop(0)
            blocks = done[at : at + n]
            at += n
            if wrong is None and not all(blocks):
                wrong = "frame checksum"
            if wrong is None and any(md5) and hashlib.md5(b"".join(blocks)).digest() != md5:
                wrong = "checksum of the samples"
            offsets = np.cumsum([0, *(len(b) for b in blocks)])[:-1].tolist()
            yield ([], [], wrong) if wrong else ([b.translate(_SIGNED) for b in blocks], offsets, None)
        del done[:at]

    for data in streams:
        try:
            found, md5 = frames_of(data)
            waiting.append((len(found), md5, None))
        except (Damaged, IndexError, struct.error) as e:
            found = []
            waiting.append((0, b"", str(e) or "no FLAC stream"))
        for start, size, head, n in found:
            frames.append((data[start : start + size], head, n))
            if len(frames) == GROUP_FRAMES:
                done += _decode_frames(frames)
                frames = []
        if not frames:
            yield from ready()
    done += _decode_frames(frames) if frames else []
    yield from ready()
