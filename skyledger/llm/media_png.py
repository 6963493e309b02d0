"""Texts as PNG images: lossless storage, checked decoding and cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import map_arrow, picked, portions, text_bytes, written

#: Bytes of an image row: 64 pixels of 8-bit red, green and blue.
ROW = 192
_MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def padded(text: bytes) -> bytes:
    """Spaces fill up to a positive multiple of ``ROW``; an empty text gives one row of spaces."""
    return text + b" " * (-len(text) % ROW if text else ROW)


def encode_png(payload: bytes) -> bytes:
    """A 64-pixel-wide RGB image; each row takes the filter (none, left, up) of least absolute sum."""
    raw = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    left, up = raw.copy(), raw.copy()
    left[:, 3:] -= raw[:, :-3]
    up[1:] -= raw[:-1]
    kinds = np.stack([raw, left, up])
    sums = np.minimum(kinds, 0 - kinds).sum(axis=2, dtype=np.uint32)
    best = sums.argmin(axis=0)
    lines = np.empty((len(raw), ROW + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = kinds[best, np.arange(len(raw))]
    head = struct.pack(">IIBBBBB", ROW // 3, len(raw), 8, 2, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples as (height, 64, 3). Every chunk's checksum is tested; a bad one raises ValueError."""
    if media[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, head, data = 8, None, []
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if len(body) != size or struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"bad checksum in {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    else:
        raise ValueError("no end chunk")
    if head is None or head[2:] != (8, 2, 0, 0, 0):
        raise ValueError("only 8-bit RGB without interlace")
    width, height = head[:2]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 3 * width + 1)
    return _unfiltered(lines[:, 0], lines[:, 1:].copy()).reshape(height, width, 3)


def _unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undoes the row filters in place: none, left, up, average and Paeth."""
    zero = np.zeros(rows.shape[1], np.uint8)
    for i in np.flatnonzero(kinds).tolist():
        kind, row, above = kinds[i], rows[i], rows[i - 1] if i else zero
        if kind == 1:
            rows[i] = row.reshape(-1, 3).cumsum(axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            for j in range(len(row)):
                a, b, c = (int(row[j - 3]) if j > 2 else 0), int(above[j]), (int(above[j - 3]) if j > 2 else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if p <= q and p <= r else b if q <= r else c
                row[j] = (int(row[j]) + guess) & 255
        else:
            raise ValueError(f"filter {kind}")
    return rows


_SIDE, _LOW = 32, 8
_COS = np.cos(np.pi * (2 * np.arange(_SIDE)[None, :] + 1) * np.arange(_LOW)[:, None] / (2 * _SIDE))


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the 32 x 32 grey image exceed the median of all but the first."""
    rows = samples.sum(axis=(2,), dtype=np.int64).reshape(len(samples), _SIDE, -1).sum(axis=2)
    edge = np.arange(_SIDE + 1) * len(rows) // _SIDE
    total = np.concatenate((np.zeros((1, _SIDE), np.int64), rows.cumsum(axis=0)))
    first, last = edge[:-1], np.maximum(edge[1:], edge[:-1] + 1)
    image = (total[last] - total[first]) / (last - first)[:, None]
    low = (_COS @ image @ _COS.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as a PNG in a binary column, written to the shared folder.

    Null counts as empty; an empty text is one row of spaces. Equal texts give equal bytes. Repeated rows are
    each stored, a null id stays null, an empty table gives no rows, a text of any length is one image, and
    other columns may have any names.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for part in portions(b, 200, 8_000_000):
                texts = text_bytes(part)
                yield {"id": part.column("id"), "n_bytes": [len(x) for x in texts], "media": [encode_png(padded(x)) for x in texts]}

    return written(map_arrow(picked(docs, id_col, text_col), {"id": "long", "n_bytes": "long", "media": "binary"}, rows), "media")


def media_features(stored: DataFrame) -> DataFrame:
    """(id, n_bytes, digests of payload and media, dct_hash, feature) of every stored image, decoded from its bytes.

    Every row is answered, repeated ones too; no rows give none. A damaged image raises.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for part in portions(b, 200, 8_000_000, "media"):
                out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "dct_hash")}
                for media in part.column("media").to_pylist():
                    samples = decode_png(media)
                    payload = samples.tobytes()
                    for k, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples))):
                        out[k].append(v)
                yield {"id": part.column("id"), "n_bytes": part.column("n_bytes")} | out

    columns = {"id": "long", "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "dct_hash": "binary"}
    return map_arrow(stored, columns, rows).withColumn("feature", F.lower(F.hex("dct_hash")))
