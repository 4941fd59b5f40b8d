"""FLAC media columns: 8-bit mono streams written and read by array operations over many frames at once.

The encoder cuts a stream into blocks, predicts each by the best of a constant, fixed predictors and a
linear predictor (autocorrelation, Levinson-Durbin, quantised coefficients), and writes Rice-coded
residuals in four partitions, or the samples themselves if that is shorter. Every frame gets a seek
point. The decoder checks both checksums of every frame and the MD5 of the whole stream. It decodes all
frames that seek points lead to side by side, one sample of each a step; frames between seek points
follow one after the other, and frames with escaped or five-bit partitions go sample by sample.

Null texts are empty; repeated rows, extra columns and very long texts need nothing special (a text is at
most as long as a binary value may be). Equal payloads give equal streams.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, per_span, ragged, slices, words_at
from .tokens import extended, with_columns

BLOCK, RATE, ORDER, PRECISION, PARTS = 1152, 8000, 6, 10, 2  # samples a frame, Hz, linear predictor, bits a coefficient, log2 of partitions
CONSTANT, VERBATIM, FIXED, LINEAR = 0, 1, 8, 32
# fixed values: the format's predictors, newest sample first
FIXED_PREDICTORS = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    pass


@cache
def _crc_table(poly: int, bits: int) -> np.ndarray:
    table = np.zeros(256, np.uint32)
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c >> (bits - 1) else 0)
            c &= (1 << bits) - 1
        table[b] = c
    return table


def crc8(data: bytes) -> int:
    table, c = _crc_table(0x07, 8), 0
    for b in data:
        c = int(table[c ^ b])
    return c


_far: list[np.ndarray] = []


def _crc16_by_distance(n: int) -> np.ndarray:
    """What a byte adds to the checksum, by how many bytes follow it."""
    table = _crc_table(0x8005, 16).astype(np.uint16)
    have = len(_far[0]) if _far else 0
    if have < n:
        n = max(n, 2 * have, 1536)
        out = np.zeros((n, 256), np.uint16)
        out[0] = table
        for d in range(1, n):
            out[d] = (out[d - 1] << np.uint16(8)) ^ table[out[d - 1] >> np.uint16(8)]
        _far[:] = [out]
    return _far[0]


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of non-empty byte spans."""
    if not len(starts):
        return np.zeros(0, np.uint16)
    out = np.zeros(len(starts), np.uint16)
    for a in range(0, len(starts), 4096):
        s, n = starts[a : a + 4096], lengths[a : a + 4096]
        at = np.cumsum(n) - n
        back = np.repeat(at + n - 1, n) - np.arange(int(n.sum()))
        parts = _crc16_by_distance(int(n.max()))[back, data[ragged(s, n)]]
        out[a : a + 4096] = np.bitwise_xor.reduceat(parts, at)
    return out


def _number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | (n >> (6 * i) & 0x3F) for i in reversed(range(size - 1))]
    return bytes([(0xFF00 >> size & 0xFF) | n >> (6 * (size - 1)), *tail])


@lru_cache(1 << 14)
def frame_header(size: int, number: int) -> bytes:
    known = {192: 1, 576: 2, 1152: 3, 2304: 4, 4608: 5, 256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12}
    code, extra = (known[size], b"") if size in known else (6, bytes([size - 1])) if size <= 256 else (7, (size - 1).to_bytes(2, "big"))
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0b0010]) + _number(number) + extra
    return head + bytes([crc8(head)])


def _zigzag(r: np.ndarray) -> np.ndarray:
    return np.where(r < 0, -2 * r - 1, 2 * r)


def _residual(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray, order: int) -> np.ndarray:
    """Samples less predictions from the order-th on; coefs newest first, one row a frame."""
    n = x.shape[1]
    guess = np.zeros((len(x), n - order), np.int32)
    for j in range(order):
        guess += coefs[:, j : j + 1] * x[:, order - 1 - j : n - 1 - j]
    return x[:, order:] - (guess >> shift[:, None])


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shifts of each frame's linear predictor."""
    n = x.shape[1]
    w = x * (1 - ((2 * np.arange(n) - n + 1) / (n + 1)) ** 2).astype(np.float32)[None, :]
    r = np.stack([np.einsum("ij,ij->i", w[:, : n - k], w[:, k:]) for k in range(ORDER + 1)], 1).astype(np.float64)
    r[:, 0] = r[:, 0] * 1.0000001 + 1e-9
    a, err = np.zeros((len(x), ORDER)), r[:, 0].copy()
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(top)).astype(np.int64) - 1, 0, 15)
    bound = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -bound, bound).astype(np.int32), shift.astype(np.int32)


def _rice(u: np.ndarray, order: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameter of each partition, and bits of each frame's residuals with them."""
    size = (u.shape[1] + order) >> parts
    cuts = [0, *(size * (p + 1) - order for p in range(1 << parts))]
    ks, bits = [], np.zeros(len(u), np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own, n = u[:, a:b], b - a
        base = np.clip(np.floor(np.log2(own.mean(1) * 0.69 + 1e-9)), 0, 13).astype(np.int32)
        costs = [(own >> (base + d)[:, None]).sum(1, dtype=np.int64) + n * (1 + base + d) for d in (0, 1)]
        better = costs[1] < costs[0]
        ks.append(base + better)
        bits += np.where(better, costs[1], costs[0]) + 4
    return np.stack(ks, 1), bits


def _write(fields: list[tuple[np.ndarray, np.ndarray, np.ndarray]], frames: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all frames, and bytes of each. fields: value, its width (up to 16), zero bits before it; columns in order."""
    value, width, zeros = (np.concatenate([np.broadcast_to(f[k], (frames, f[0].shape[1])) for f in fields], 1) for k in range(3))
    ends = np.cumsum(width + zeros, 1, dtype=np.int64)
    size = (ends[:, -1] + 7) >> 3
    first = (np.cumsum(size) - size) << 3
    at = (ends - width + first[:, None]).ravel()
    v = value.ravel().astype(np.int64) << (24 - width.ravel() - (at & 7))
    place, total = at >> 3, int(size.sum()) + 3
    out = sum(np.bincount(place + k, weights=(v >> (16 - 8 * k)) & 255, minlength=total)[:total] for k in range(3))
    return out.astype(np.uint8)[: total - 3], size


def _subframes(x: np.ndarray) -> tuple[list[bytes], None]:
    """The subframe of each row of samples (all of one block size)."""
    frames, n = x.shape
    out: list[bytes] = [b""] * frames
    parts = PARTS if n % (1 << PARTS) == 0 and n >> PARTS > ORDER else 0
    plain = 8 + 8 * n
    flat = (x == x[:, :1]).all(1)
    orders = [o for o in (0, 1, 2) if o < (n >> parts)]
    ready = {}
    sums = []
    for o in orders:
        coefs = np.broadcast_to(np.array(FIXED_PREDICTORS[o], np.int32), (frames, o))
        ready[o] = _residual(x, coefs, np.zeros(frames, np.int32), o)
        sums.append(np.abs(ready[o]).sum(1))
    fixed = np.array(orders)[np.argmin(sums, axis=0)]
    best, bits = np.full(frames, VERBATIM), np.full(frames, plain)
    ks = np.zeros((frames, 1 << parts), np.int32)
    for o in orders:
        on = np.flatnonzero((fixed == o) & ~flat)
        if len(on):
            k, cost = _rice(_zigzag(ready[o][on]), o, parts)
            cost += 8 + 8 * o + 6
            good = cost < bits[on]
            best[on[good]], bits[on[good]], ks[on[good]] = FIXED + o, cost[good], k[good]
    if (n >> parts) > ORDER:
        coefs, shift = _linear(x.astype(np.float32))
        res = _residual(x, coefs, shift, ORDER)
        k, cost = _rice(_zigzag(res), ORDER, parts)
        cost += 8 + 8 * ORDER + 6 + 9 + ORDER * PRECISION
        good = (cost < bits) & ~flat
        best[good], bits[good], ks[good] = LINEAR + ORDER - 1, cost[good], k[good]
    best[flat] = CONSTANT
    for kind in np.unique(best):
        on = np.flatnonzero(best == kind)
        if kind in (CONSTANT, VERBATIM):
            body = (x[on, :1] if kind == CONSTANT else x[on]).astype(np.int8).tobytes()
            size = 1 if kind == CONSTANT else n
            for j, i in enumerate(on.tolist()):
                out[i] = bytes([kind << 1]) + body[j * size : (j + 1) * size]
            continue
        m = len(on)
        order = ORDER if kind >= LINEAR else kind - FIXED
        u = _zigzag(res[on] if kind >= LINEAR else ready[order][on])
        column = lambda v: np.full((m, 1), v, np.int32)
        none = np.zeros((1, 1), np.int32)
        fields = [(column(kind << 1), np.full((1, 1), 8), none)]
        if order:
            fields.append((x[on, :order] & 255, np.full((1, order), 8), np.zeros((1, order), np.int32)))
        if kind >= LINEAR:
            fields.append((column(PRECISION - 1), np.full((1, 1), 4), none))
            fields.append((shift[on][:, None], np.full((1, 1), 5), none))
            fields.append((coefs[on] & ((1 << PRECISION) - 1), np.full((1, order), PRECISION), np.zeros((1, order), np.int32)))
        fields.append((column(parts), np.full((1, 1), 6), none))
        size = n >> parts
        for p in range(1 << parts):
            a, b = max(0, size * p - order), size * (p + 1) - order
            k = ks[on, p : p + 1]
            fields.append((k, np.full((1, 1), 4), none))
            own = u[:, a:b]
            fields.append(((1 << k) | (own & ((1 << k) - 1)), np.broadcast_to(k + 1, own.shape), own >> k))
        body, sizes = _write(fields, m)
        body, at = body.tobytes(), np.cumsum(sizes) - sizes
        for i, a, b in zip(on.tolist(), at.tolist(), (at + sizes).tolist(), strict=True):
            out[i] = body[a:b]
    return out


def encode(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """FLAC streams of the payloads: byte b is the sample b - 128."""
    lengths = np.diff(offsets)
    frames = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), frames)
    number = ragged(np.zeros(len(lengths), np.int64), frames)
    start = offsets[owner] + number * BLOCK
    size = np.minimum(BLOCK, offsets[owner + 1] - start)
    bodies: list[bytes] = [b""] * len(owner)
    for n in np.unique(size):
        on = np.flatnonzero(size == n)
        for part in np.array_split(on, -(-len(on) * int(n) // (1 << 20))):
            x = data[start[part, None] + np.arange(n)].astype(np.int32) - 128
            for i, body in zip(part.tolist(), _subframes(x), strict=True):
                bodies[i] = frame_header(int(n), int(number[i])) + body
    flat = np.frombuffer(b"".join(bodies), np.uint8)
    n = np.array([len(b) for b in bodies], np.int64)
    checks = crc16(flat, np.cumsum(n) - n, n)
    bodies = [b + int(c).to_bytes(2, "big") for b, c in zip(bodies, checks, strict=True)]
    out, at = [], 0
    for t, count in enumerate(frames.tolist()):
        own, total = bodies[at : at + count], int(lengths[t])
        at += count
        sizes = [len(b) for b in own]
        md5 = hashlib.md5((data[offsets[t] : offsets[t + 1]] ^ 128).tobytes()).digest()  # of signed samples
        block = BLOCK.to_bytes(2, "big")
        info = block + block + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | total).to_bytes(8, "big") + md5
        points, offset = [], 0
        for k, s in enumerate(sizes):
            points.append((k * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(BLOCK, total - k * BLOCK).to_bytes(2, "big"))
            offset += s
        table = b"".join(points)
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


def metadata(stream: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """Samples, MD5, seek points (sample, byte offset, samples) and where the first frame starts."""
    if stream[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, total, md5, points = 4, None, b"", []
    while True:
        last, kind, size = stream[at] & 0x80, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 36 & 31 != 7 or packed >> 41 & 7:
                raise FlacError("only 8-bit mono streams are read")
            total, md5 = packed & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            raw_points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
            points = [p for p in raw_points if p[0] != (1 << 64) - 1]
        if last:
            break
    if total is None:
        raise FlacError("no stream information")
    return total, md5, points, at


def parse_header(data: bytes, at: int) -> tuple[int, int, int]:
    """Block size, frame number and length of the frame header at a byte; checks its checksum."""
    if data[at] != 0xFF or data[at + 1] != 0xF8:
        raise FlacError("lost synchronisation")
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    end = at + 4
    lead = data[end]
    size = 1 if lead < 0x80 else next(k for k in range(2, 8) if not lead >> (7 - k) & 1)
    number = lead if size == 1 else lead & (0x7F >> size)
    for b in data[end + 1 : end + size]:
        number = number << 6 | b & 0x3F
    end += size
    if code in (6, 7):
        block = int.from_bytes(data[end : end + code - 5], "big") + 1
        end += code - 5
    else:
        block = 192 if code == 1 else 576 << (code - 2) if code <= 5 else 256 << (code - 8)
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(data[at:end]) != data[end]:
        raise FlacError("frame header checksum")
    return block, number, end + 1 - at


class Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int, signed: bool = False) -> int:
        if not n:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        v = int.from_bytes(self.data[a:b], "big") >> (8 * (b - a) - (self.at & 7) - n) & (1 << n) - 1
        self.at += n
        return v - (1 << n) if signed and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def _plain_residuals(bits: Bits, method: int, parts: int, block: int, order: int) -> list[int]:
    out = []
    for p in range(1 << parts):
        k = bits.take(4 + method)
        n = (block >> parts) - (order if p == 0 else 0)
        if k == (15, 31)[method]:
            width = bits.take(5)
            out += [bits.take(width, True) for _ in range(n)]
        else:
            for _ in range(n):
                u = bits.zeros() << k | bits.take(k)
                out.append(u >> 1 ^ -(u & 1))
    return out


_CLZ = np.full(1 << 16, 16, np.uint8)
for _i in range(16):
    _CLZ[1 << _i : 2 << _i] = 15 - _i


def _decode_frames(data: bytes, at: list[int]) -> tuple[list[np.ndarray], list[int], list[int]]:
    """Samples, numbers and ends of the frames at these bytes, side by side."""
    array = np.frombuffer(data, np.uint8)
    n = len(at)
    out: list = [None] * n
    numbers, ends = [0] * n, [0] * n
    todo = []  # frame, block size, order, bit of the residuals, partitions, coefficients, shift, warm-up
    for i, a in enumerate(at):
        block, numbers[i], size = parse_header(data, a)
        kind = data[a + size] >> 1
        if data[a + size] & 0x81:
            raise FlacError("wasted bits aren't read")
        first = a + size + 1
        if kind == CONSTANT:
            out[i] = np.full(block, np.frombuffer(data, np.int8, 1, first)[0], np.int32)
            ends[i] = first + 1
        elif kind == VERBATIM:
            out[i] = np.frombuffer(data, np.int8, block, first).astype(np.int32)
            ends[i] = first + block
        elif FIXED <= kind <= FIXED + 4 or kind >= LINEAR:
            order = kind - FIXED if kind < LINEAR else kind - LINEAR + 1
            bits = Bits(data, first * 8)
            warm = [bits.take(8, True) for _ in range(order)]
            coefs, shift = FIXED_PREDICTORS[order] if kind < LINEAR else None, 0
            if coefs is None:
                precision, shift = bits.take(4) + 1, bits.take(5, True)
                coefs = [bits.take(precision, True) for _ in range(order)]
            method, parts = bits.take(2), bits.take(4)
            todo.append([i, block, order, bits.at, parts, coefs, shift, warm, method])
        else:
            raise FlacError("reserved subframe")
    todo.sort(key=lambda x: -x[1])
    slow = [x for x in todo if x[8] or x[6] < 0]
    fast = [x for x in todo if not (x[8] or x[6] < 0)]
    slow += _side_by_side(array, fast, out, ends) if fast else []
    for i, block, order, bit, parts, coefs, shift, warm, method in slow:
        if method > 1 or shift < 0:
            raise FlacError("reserved coding")
        bits, x = Bits(data, bit), list(warm)
        for r in _plain_residuals(bits, method, parts, block, order):
            x.append(r + (sum(c * x[-1 - j] for j, c in enumerate(coefs)) >> shift))
        out[i], ends[i] = np.array(x, np.int32), (bits.at + 7) >> 3
    starts = np.array(at, np.int64)
    lengths = np.array(ends, np.int64) - starts
    if len(array) < max(ends, default=0) + 2:
        raise FlacError("the stream ends inside a frame")
    want = array[starts + lengths].astype(np.uint16) << np.uint16(8) | array[starts + lengths + 1]
    if (crc16(array, starts, lengths) != want).any():
        raise FlacError("frame checksum")
    return out, numbers, [e + 2 for e in ends]


def _side_by_side(array: np.ndarray, todo: list, out: list, ends: list[int]) -> list:
    """Decodes Rice residuals of all frames in step (longest block first); gives back those with escaped partitions."""
    n, most = len(todo), max(x[2] for x in todo)
    block, order = np.array([x[1] for x in todo]), np.array([x[2] for x in todo])
    bit, shift = np.array([x[3] for x in todo], np.int64), np.array([x[6] for x in todo], np.int32)
    coefs, warm = np.zeros((most, n), np.int32), np.zeros((most, n), np.int32)
    turn: dict[int, list[int]] = {}
    for f, (_, size, o, _, parts, c, _, w, _) in enumerate(todo):
        coefs[most - o :, f] = c[::-1]  # the newest sample is the last row of the history
        warm[:o, f] = w
        for p in range(1 << parts):
            turn.setdefault(max(o, (size >> parts) * p) if p == 0 else (size >> parts) * p, []).append(f)
    words = words_at(array).byteswap()
    x = np.zeros((int(block[0]) + most, n), np.int32)
    k, escaped, live = np.zeros(n, np.int64), np.zeros(n, bool), n
    for t in range(int(block[0])):
        while block[live - 1] <= t:
            live -= 1
        if t in turn:
            own = np.array(turn[t])
            k[own] = ((words[bit[own] >> 3] << (bit[own] & 7).astype(U64)) >> U64(60)).astype(np.int64)
            escaped[own] |= k[own] == 15
            k[own[k[own] == 15]] = 0
            bit[own] += 4
        at = bit[:live]
        w = words[np.minimum(at >> 3, len(words) - 1)] << (at & 7).astype(U64)
        q = _CLZ[w >> U64(48)].astype(np.int64)
        far = np.flatnonzero(q == 16)
        if len(far):
            total = np.full(len(far), 16)
            more = np.arange(len(far))
            while len(more) and total.max() < 1 << 16:
                p = at[far[more]] + total[more]
                z = _CLZ[(words[np.minimum(p >> 3, len(words) - 1)] << (p & 7).astype(U64)) >> U64(48)]
                total[more] += z
                more = more[z == 16]
            q[far] = total
            p = at[far] + total
            w[far] = words[np.minimum(p >> 3, len(words) - 1)] << (p & 7).astype(U64)
            rest = np.where(q >= 16, 0, q)
        else:
            rest = q
        own = k[:live]
        low = ((w << (rest + 1).astype(U64)) >> U64(1)) >> (63 - own).astype(U64)
        u = (q << own) | low.astype(np.int64)
        value = ((u >> 1) ^ -(u & 1)).astype(np.int32)
        if most:
            value += (coefs[:, :live] * x[t : t + most, :live]).sum(0, dtype=np.int32) >> shift[:live]
        step = q + 1 + own
        if t < most:
            early = order[:live] > t
            value = np.where(early, warm[t, :live], value)
            step[early] = 0
        x[t + most, :live] = value
        bit[:live] += step
    left = []
    for f, item in enumerate(todo):
        if escaped[f]:
            left.append(item)
        else:
            out[item[0]], ends[item[0]] = x[most : most + item[1], f], int(bit[f] + 7) >> 3
    return left


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """Samples of each stream, all checksums verified."""
    data = b"".join(streams) + bytes(8)
    heads, base = [metadata(s) for s in streams], np.cumsum([0, *map(len, streams)]).tolist()
    parts: list[dict[int, np.ndarray]] = [{} for _ in streams]
    stops: list[set[int]] = []
    open_at: list[tuple[int, int]] = []
    for s, (total, _, points, first) in enumerate(heads):
        starts = {base[s] + first + p[1] for p in points} | ({base[s] + first} if total else set())
        stops.append(starts | {base[s + 1]})
        open_at += [(s, a) for a in sorted(starts)]
    while open_at:
        again = []
        for a in range(0, len(open_at), 8192):
            now = open_at[a : a + 8192]
            samples, numbers, ends = _decode_frames(data, [p for _, p in now])
            for (s, _), x, number, end in zip(now, samples, numbers, ends, strict=True):
                parts[s][number] = x
                if end not in stops[s]:
                    again.append((s, end))
        open_at = again
    out = []
    for s, (total, md5, *_) in enumerate(heads):
        x = np.concatenate([parts[s][k] for k in sorted(parts[s])]) if parts[s] else np.zeros(0, np.int32)
        if len(x) != total or hashlib.md5(x.astype(np.int8).tobytes()).digest() != md5:
            raise FlacError("the samples don't match the stream information")
        out.append(x)
    return out


def read_at(stream: bytes, sample: int, count: int) -> np.ndarray:
    """Samples from one place on, decoding only the frames from the seek point before it."""
    total, _, points, first = metadata(stream)
    before = [p for p in points if p[0] <= sample]
    at, have = (first + before[-1][1], before[-1][0]) if before else (first, 0)
    out, start, data = [], have, stream + bytes(8)
    while have < min(total, sample + count):
        (x,), _, (at,) = _decode_frames(data, [at])
        out.append(x)
        have += len(x)
    return np.concatenate(out)[sample - start : sample - start + count] if out else np.zeros(0, np.int32)


def features(samples: list[np.ndarray]) -> list[str]:
    """Whole-number features of each stream: samples, peak, energy, sign changes, sum of steps."""
    flat = np.concatenate(samples).astype(np.int64) if samples else np.zeros(0, np.int64)
    at = np.cumsum([0, *map(len, samples)])
    inner = np.ones(len(flat), bool)
    inner[at[:-1][np.diff(at) > 0]] = False
    step = np.zeros(len(flat), np.int64)
    step[1:] = np.diff(flat)
    step *= inner
    turn = np.zeros(len(flat), np.int64)
    turn[1:] = (flat[1:] < 0) != (flat[:-1] < 0)
    turn *= inner
    energy, turns, steps = per_span(flat * flat, at), per_span(turn, at), per_span(np.abs(step), at)
    peak = [int(np.abs(x).max()) if len(x) else 0 for x in samples]
    return [f"samples={len(x)};peak={p};energy={e};turns={t};steps={v}" for x, p, e, t, v in zip(samples, peak, energy, turns, steps, strict=True)]


def payloads(data: np.ndarray, offsets: np.ndarray, unit: int = 192) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with blanks to a positive multiple of ``unit`` bytes."""
    n = np.diff(offsets)
    size = np.maximum(-(-n // unit), 1) * unit
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    out = np.full(int(at[-1]), 32, np.uint8)
    out[ragged(at[:-1], n)] = data
    return out, at


def store(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_bytes and media (binary, a FLAC stream of the padded text) to each row."""
    df, schema = extended(df, [("n_bytes", "long"), ("media", "binary")])

    def run(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, text):
                yield with_columns(rows, {"n_bytes": pa.array(np.diff(offsets)), "media": pa.array(encode(*payloads(data, offsets)), pa.binary())})

    return df.mapInArrow(run, schema)


def _media(batch: pa.RecordBatch, column: str):
    """Runs of rows with a few megabytes of streams, and their decoded samples; null streams give none."""
    first, streams = 0, batch.column(column).to_pylist()
    while first < batch.num_rows:
        last, volume = first, 0
        while last < batch.num_rows and (last == first or volume < 2 << 20):
            volume += len(streams[last] or b"")
            last += 1
        own = [s for s in streams[first:last] if s is not None]
        decoded = iter(decode(own))
        yield batch.slice(first, last - first), streams[first:last], [None if s is None else next(decoded) for s in streams[first:last]]
        first = last


def read_back(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds payload_bytes, payload_sha256, tail_crc32 (of the last 16 bytes), media_bytes, media_sha256, feature."""
    added = [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
    df, schema = extended(df, added)

    def run(batches):
        for batch in batches:
            for rows, streams, samples in _media(batch, media):
                bodies = [None if x is None else (x + 128).astype(np.uint8).tobytes() for x in samples]
                told = iter(features([x for x in samples if x is not None]))
                of = lambda f, xs=bodies: [None if x is None else f(x) for x in xs]
                new = {
                    "payload_bytes": pa.array(of(len), pa.int64()),
                    "payload_sha256": pa.array(of(lambda b: hashlib.sha256(b).hexdigest()), pa.string()),
                    "tail_crc32": pa.array(of(lambda b: zlib.crc32(b[-16:])), pa.int64()),
                    "media_bytes": pa.array([None if s is None else len(s) for s in streams], pa.int64()),
                    "media_sha256": pa.array([None if s is None else hashlib.sha256(s).hexdigest() for s in streams], pa.string()),
                    "feature": pa.array(of(lambda _: next(told)), pa.string()),
                }
                yield with_columns(rows, new)

    return df.mapInArrow(run, schema)


def pcm_blocks(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row for each block of PCM: key, block, sample_offset, samples, pcm (signed bytes); any block can be sought by its offset."""
    rows = df.select(F.col(key).alias("key"), F.col(media).alias("media")).filter("media is not null")
    kind = dict(rows.dtypes)["key"]

    def run(batches):
        for batch in batches:
            for own, _, samples in _media(batch, "media"):
                keys = own.column("key").to_pylist()
                out = [(k, b, a, min(BLOCK, len(x) - a), x[a : a + BLOCK].astype(np.int8).tobytes()) for k, x in zip(keys, samples, strict=True) for b, a in enumerate(range(0, len(x), BLOCK))]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                types = [own.schema.field("key").type, pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [key, "block", "sample_offset", "samples", "pcm"])

    return rows.mapInArrow(run, f"`{key}` {kind}, block int, sample_offset long, samples int, pcm binary")
