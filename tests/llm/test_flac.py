import random

import numpy as np
import pytest

from jsonloom.llm import flac


def payloads():
    rng = random.Random(1)
    made = [b"", b"a", b"x" * 192, b"y" * 193, bytes(range(256)) * 30, rng.randbytes(4000), bytes(128 + int(90 * np.sin(i / 9)) for i in range(192 * 300)), bytes(128 + (100 if i == 50 else 0) for i in range(192)), bytes(i % 251 for i in range(192 * 3)), "é中😀 ".encode() * 900]
    made += [" ".join(rng.choice(["alpha", "beta", "Gamma"]) for _ in range(rng.randint(1, 400))).encode() for _ in range(40)]
    return [flac.padded_payload(x) for x in made]


def test_round_trip():
    made = payloads()
    media = flac.streams(made)
    back = flac.decoded(media)
    assert [p for p, _ in back] == made
    for stream, (payload, starts) in zip(media, back, strict=True):
        assert len(starts) == len(payload) // 192
        assert all(stream[s : s + 2] == b"\xff\xf8" for s in starts.tolist())
    assert flac.streams(made[:3]) == media[:3]
    assert flac.decoded(flac.streams([b""]))[0][0] == b""


def test_predictors_are_used():
    wave = bytes(128 + int(60 * np.sin(i / 11) + 40 * np.sin(i / 5)) for i in range(192 * 40))
    samples = (np.frombuffer(wave, np.uint8).astype(np.int16) - 128).reshape(-1, 192)
    data, length = flac.encode_frames(samples, np.arange(40))
    start = np.cumsum(length) - length
    assert (data[start + 6] >> 1).max() >= 9
    assert len(data) < len(wave) * 0.6


def test_known_checksums():
    nine = np.frombuffer(b"123456789", np.uint8)
    assert flac.crc16(nine, np.array([0]), np.array([9]))[0] == 0xFEE8
    assert flac.crc8(nine.reshape(1, -1))[0] == 0xF4


@pytest.mark.parametrize("at", [-1, -40, 30])
def test_damage_is_found(at):
    stream = bytearray(flac.streams([flac.padded_payload(b"some words to store " * 40)])[0])
    stream[at] ^= 0x10
    with pytest.raises(ValueError):
        flac.decoded([bytes(stream)])


def test_columns(spark, odd, none):
    stored = flac.with_media(odd)
    assert stored.columns == [*odd.columns, "media"]
    back = flac.read_back(stored.select("doc_id", "text", "media")).collect()
    assert all(bytes(r.payload) == flac.padded_payload((r.text or "").encode()) for r in back)
    blocks = flac.pcm_blocks(stored.where("doc_id = 10").limit(1), "doc_id", frames=16).orderBy("block").collect()
    text = odd.where("doc_id = 10").first().text.encode()
    assert b"".join(bytes(b.pcm) for b in blocks) == flac.padded_payload(text)
    assert [b.sample_offset for b in blocks] == [i * 16 * 192 for i in range(len(blocks))]
    assert flac.with_media(none).count() == 0
    rows = {r.doc_id: r for r in flac.digests(odd).collect()}
    assert rows[1].n_bytes == 0 and rows[1].payload_bytes == 192 and rows[0].payload_sha256 == rows[1].payload_sha256
    from pyspark.sql import functions as F

    assert flac.read_back(stored.withColumn("media", F.lit(None).cast("binary")).limit(2)).where("payload is null").count() == 2


def plain(stream):
    """One stream's samples by a decoder that goes bit by bit, as the format says; it checks neither CRC nor MD5."""
    bits = "".join(f"{b:08b}" for b in stream)
    at = 32
    last = False
    at = 32  # behind the mark
    while not last:
        last, size = bits[at] == "1", int(bits[at + 8 : at + 32], 2)
        at += 32 + 8 * size
    out = []

    def take(n):
        nonlocal at
        value = int(bits[at : at + n] or "0", 2)
        at += n
        return value

    def signed(n):
        value = take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    while at < len(bits) - 16:
        assert take(14) == 0b11111111111110
        take(2)
        size, _, _, bps, _ = take(4), take(4), take(4), take(3), take(1)
        first = take(8)
        for _ in range(max(f"{first:08b}".index("0") - 1, 0) if first >= 0x80 else 0):
            take(8)
        n = {1: 192, 6: None, 7: None}[size] or take(8 if size == 6 else 16) + 1
        take(8)
        assert bps in (0, 1) and take(1) == 0
        kind, wasted = take(6), take(1)
        assert not wasted
        if kind == 0:
            own = [signed(8)] * n
        elif kind == 1:
            own = [signed(8) for _ in range(n)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            own = [signed(8) for _ in range(order)]
            if kind < 32:
                factors, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
            else:
                width = take(4) + 1
                shift = signed(5)
                factors = [signed(width) for _ in range(order)]
            method, parts = take(2), take(4)
            wide = 4 if method == 0 else 5
            for part in range(1 << parts):
                rice = take(wide)
                count = (n >> parts) - (order if part == 0 else 0)
                raw = take(5) if rice == (1 << wide) - 1 else None
                for _ in range(count):
                    if raw is not None:
                        residual = signed(raw)
                    else:
                        high = bits.index("1", at) - at
                        at += high + 1
                        value = (high << rice) | take(rice)
                        residual = (value >> 1) ^ -(value & 1)
                    own.append(residual + (sum(f * x for f, x in zip(factors, own[::-1], strict=False)) >> shift))
        out += own
        at += -at % 8 + 16
    return bytes(x + 128 for x in out)


def test_against_a_plain_decoder():
    made = payloads()[:14]
    assert [plain(s) for s in flac.streams(made)] == made
