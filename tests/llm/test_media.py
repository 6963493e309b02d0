from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from skyledger.llm import media_png as m


@pytest.mark.parametrize("text", [b"", b"a", b"x" * 192, "Ünï ".encode() * 999, bytes(range(256)) * 30])
def test_round_trip(text):
    payload = m.padded(text)
    assert len(payload) % 192 == 0 and payload and payload.rstrip(b" ") == text.rstrip(b" ")
    assert m.decode_png(m.encode_png(payload)).tobytes() == payload


def test_all_filters():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (10, 192)).astype(int)
    lines = []
    for i, row in enumerate(rows):
        kind, above = i % 5, rows[i - 1] if i else np.zeros(192, int)
        left = np.concatenate(([0] * 3, row[:-3]))
        corner = np.concatenate(([0] * 3, above[:-3]))
        guess = {0: 0 * row, 1: left, 2: above, 3: (left + above) // 2}.get(kind)
        if guess is None:
            p = left + above - corner
            a, b, c = abs(p - left), abs(p - above), abs(p - corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        lines.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
    head = struct.pack(">IIBBBBB", 64, 10, 8, 2, 0, 0, 0)
    packed = zlib.compress(b"".join(lines))
    media = m._MAGIC + m._chunk(b"IHDR", head) + m._chunk(b"IDAT", packed[:50]) + m._chunk(b"IDAT", packed[50:]) + m._chunk(b"IEND", b"")
    assert (m.decode_png(media).reshape(10, 192) == rows).all()


def test_damage_is_found():
    media = bytearray(m.encode_png(m.padded(b"some text")))
    media[50] ^= 1
    with pytest.raises(ValueError):
        m.decode_png(bytes(media))
    with pytest.raises(ValueError):
        m.decode_png(b"GIF89a")
    with pytest.raises(ValueError):
        m.decode_png(m.encode_png(m.padded(b"x"))[:-12])


def test_query_rows(make_docs):
    rows = [(1, "Grüße"), (2, None), (3, ""), (4, "Grüße"), (None, "x" * 1000)]
    found = m.media_features(m.store_media(make_docs(rows))).collect()
    by = {}
    for r in found:
        by.setdefault(r.id, []).append(r)
    assert len(found) == 5 and by[1][0].feature == by[4][0].feature and by[2][0].media_sha256 == by[3][0].media_sha256
    payload = "Grüße".encode().ljust(192)
    assert (by[1][0].n_bytes, by[1][0].payload_bytes, by[1][0].payload_sha256, by[1][0].tail_crc32) == (7, 192, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert m.media_features(m.store_media(make_docs([]))).count() == 0


def test_hash_by_plain_sums():
    samples = m.decode_png(m.encode_png(m.padded(b"The quick brown fox " * 500)))
    image = np.array([[samples[h * len(samples) // 32 : max((h + 1) * len(samples) // 32, h * len(samples) // 32 + 1), 2 * w : 2 * w + 2].astype(float).sum(axis=(1, 2)).mean() for w in range(32)] for h in range(32)])
    low = [[sum(image[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]
    flat = np.array(low).ravel()
    assert np.packbits(flat > np.median(flat[1:])).tobytes() == m.cosine_hash(samples)
