import hashlib
import random
import zlib

import numpy as np
import pytest

from cartograf.llm import flac


def streams(payloads):
    data = np.frombuffer(b"".join(payloads), np.uint8)
    return flac.encode(data, np.cumsum([0, *map(len, payloads)]))


def payload_cases():
    rng = random.Random(3)
    words = [bytes(rng.choices(b"etaoin shrdlu,.", k=n)) for n in (192, 384, 1152, 1344, 5000 * 192 // 192 * 192)]
    ramp = bytes(128 + int(90 * np.sin(i / 9)) for i in range(2304))
    spikes = bytes(0 if i % 190 else 255 for i in range(1152))
    return [*words, b" " * 192, b" " * 4608, ramp, spikes, bytes(range(256)) * 9, rng.randbytes(1920)]


def test_round_trip_and_checks():
    cases = payload_cases()
    encoded = streams(cases)
    for case, x in zip(cases, flac.decode(encoded)):
        assert (x + 128).astype(np.uint8).tobytes() == case
    assert len(encoded[7]) < len(cases[7]) * 0.6  # smooth: linear prediction pays
    bad = bytearray(encoded[3])
    bad[-20] ^= 1
    with pytest.raises(flac.FlacError):
        flac.decode([bytes(bad)])


def test_all_kinds_of_frames_occur():
    kinds = set()
    for s in streams(payload_cases()):
        _, _, points, first = flac.metadata(s)
        for _, offset, _ in points:
            _, _, size = flac.parse_header(s, first + offset)
            kinds.add(s[first + offset + size] >> 1)
    assert {flac.CONSTANT, flac.VERBATIM} < kinds and any(k >= flac.LINEAR for k in kinds) and any(flac.FIXED <= k < flac.LINEAR for k in kinds)


def test_seek_reads_any_place():
    case = payload_cases()[4]
    (s,) = streams([case])
    for a, n in ((0, 10), (1151, 3), (4000, 900), (len(case) - 5, 50)):
        assert (flac.read_at(s, a, n) + 128).astype(np.uint8).tobytes() == case[a : a + n]


def write_bits(fields):
    text = "".join(f"{v & (1 << n) - 1:0{n}b}" for v, n in fields if n)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def test_foreign_streams_without_seek_table_and_with_escapes():
    """A stream put together by hand: order-3 fixed frames, one with an escaped and one with a five-bit partition."""
    x = [int(60 * np.sin(i / 7)) for i in range(400)]
    frames = []
    for number, part in enumerate((x[:192], x[192:384], x[384:])):
        order = 3
        res = [part[i] - (3 * part[i - 1] - 3 * part[i - 2] + part[i - 3]) for i in range(order, len(part))]
        fields = [((flac.FIXED + order) << 1, 8), *((v, 8) for v in part[:order])]
        if number == 0:
            fields += [(0, 2), (0, 4), (15, 4), (12, 5), *((r, 12) for r in res)]
        else:
            method = number - 1
            fields += [(method, 2), (0, 4), (1, 4 + method)]
            for r in res:
                u = -2 * r - 1 if r < 0 else 2 * r
                fields += [(0, u >> 1), (1, 1), (u & 1, 1)]
        body = flac.frame_header(len(part), number) + write_bits(fields)
        check = int(flac.crc16(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0])
        frames.append(body + check.to_bytes(2, "big"))
    md5 = hashlib.md5(np.array(x, np.int8).tobytes()).digest()
    info = b"\0\xc0\0\xc0" + bytes(6) + (8000 << 44 | 7 << 36 | len(x)).to_bytes(8, "big") + md5
    stream = b"fLaC\x80\0\0\x22" + info + b"".join(frames)
    assert flac.decode([stream])[0].tolist() == x
    assert flac.read_at(stream, 380, 9).tolist() == x[380:389]


def test_checksums_are_the_format_s():
    def plain(data, poly, bits):
        c = 0
        for b in data:
            c ^= b << (bits - 8)
            for _ in range(8):
                c = (c << 1 ^ (poly if c >> (bits - 1) & 1 else 0)) & (1 << bits) - 1
        return c

    data = random.Random(1).randbytes(3000)
    assert flac.crc8(data) == plain(data, 0x07, 8)
    assert flac.crc16(np.frombuffer(data, np.uint8), np.array([0, 5]), np.array([3000, 7])).tolist() == [plain(data, 0x8005, 16), plain(data[5:12], 0x8005, 16)]


def test_columns(spark):
    rows = [(1, "héllo " * 500, "a"), (2, None, "b"), (3, "", "b"), (4, "x" * 192, "c"), (5, "héllo " * 500, "a"), (6, "the end. " * 14000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Media string")
    stored = flac.store(df)
    assert [c for c in stored.columns] == ["doc_id", "text", "n_bytes", "media"]
    got = {r.doc_id: r for r in flac.read_back(stored).collect()}
    for i, t, _ in rows:
        b = (t or "").encode()
        p = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert got[1][2:] == got[5][2:] and got[2][2:] == got[3][2:]
    blocks = sorted((r.doc_id, r.block, r.sample_offset, bytes(r.pcm)) for r in flac.pcm_blocks(stored).collect())
    whole = b"".join(b[3] for b in blocks if b[0] == 1)
    assert (np.frombuffer(whole, np.int8).astype(int) + 128).astype(np.uint8).tobytes().decode().startswith("héllo")
    assert [b[2] for b in blocks if b[0] == 6] == [1152 * k for k in range(len([b for b in blocks if b[0] == 6]))]
    assert flac.read_back(flac.store(df.limit(0))).count() == 0
