"""Language identification by nearest centroids of TF-IDF n-gram vectors.

ASCII letters are lower-cased and runs of other ASCII characters become one space, so that marks and digits
say nothing. Byte 2- and 3-grams of the result are hashed into ``DIMENSIONS`` buckets, weighted by
log(1 + count) and inverse document frequency, and normalised. Each language has up to ``CENTROIDS``
centroids from spherical k-means. A text gets the language of the centroid of greatest cosine; it is
rejected when its cosine is below that centroid's own limit.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.llm.common import held_out, map_arrow, picked, portions

DIMENSIONS, CENTROIDS, ROUNDS = 4096, 4, 8
#: The bound of the labelled sample: documents of each language, and characters of one document.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 30_000
FOLDS, HELD_FOLD = 3, 1
#: Bytes of a text that are counted at once, so that memory does not grow with a text's length.
BLOCK = 1 << 20


#: ASCII letters to lower case, other ASCII to a space; bytes of other characters stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _buckets(data: np.ndarray, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2- and 3-grams that start at some places of ``data`` (uint32 bytes, two more behind the last place)."""
    one, after, third = (data[at], data[at + 1], data[at + 2]) if isinstance(at, np.ndarray) else (data[:-2], data[1:-1], data[2:])
    two = one * np.uint32(0x9E3779B1) + after * np.uint32(0x85EBCA77)
    three = (two ^ np.uint32(0x27D4EB2F)) + third * np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - DIMENSIONS.bit_length() + 1)
    mixed = lambda x: ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift
    return mixed(two), mixed(three)


def _normal(text: bytes | memoryview) -> Iterator[bytes]:
    """A text's letters and single spaces, block by block, without a space at either end."""
    begun = gap = False
    for at in range(0, len(text), BLOCK):
        part = bytes(text[at : at + BLOCK]).translate(_LETTERS)
        words = part.split()
        if words:
            yield b" " * (begun and (gap or part[0] == 32)) + b" ".join(words)
            begun, gap = True, part[-1] == 32
        else:
            gap = True


def _long_counts(text: bytes | memoryview) -> np.ndarray:
    total, tail = np.zeros(DIMENSIONS, np.int64), b" "
    for piece in chain(_normal(text), [b"   "]):
        data = tail + piece
        for found in _buckets(np.frombuffer(data, np.uint8).astype(np.uint32), slice(None)):
            total += np.bincount(found, minlength=DIMENSIONS)
        tail = data[-2:]
    return total.astype(np.float32)


def counts(texts: list[bytes | memoryview]) -> np.ndarray:
    """n-gram counts of each text as float32 rows; each text stands between spaces. Texts of more than ``BLOCK`` bytes are counted block by block."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    some = [i for i, t in enumerate(texts) if len(t) <= BLOCK]
    for i in set(range(len(texts))).difference(some):
        out[i] = _long_counts(texts[i])
    if some:
        words = [b" ".join(bytes(texts[i]).translate(_LETTERS).split()) for i in some]
        data = np.frombuffer(b"".join(b" " + t + b"   " for t in words), np.uint8).astype(np.uint32)
        size = np.array([len(t) + 2 for t in words])
        start = np.concatenate(([0], (size + 2)[:-1].cumsum()))
        # the n-grams of a text start at its leading space and end at the space behind it at the latest
        at = np.arange(size.sum()) - np.repeat(size.cumsum() - size, size) + np.repeat(start, size)
        row = np.repeat(np.arange(len(some), dtype=np.int64) * DIMENSIONS, size)
        total = sum(np.bincount(row + found, minlength=len(some) * DIMENSIONS) for found in _buckets(data, at))
        out[some] = total.reshape(len(some), DIMENSIONS)
    return out


def has_letter(text: memoryview) -> bool:
    """Whether any character of the UTF-8 is a letter; decoded block by block up to the first."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    step = 256
    at = 0
    while at < len(text):
        if any(map(str.isalpha, decoder.decode(bytes(text[at : at + step])))):
            return True
        at, step = at + step, min(BLOCK, 4 * step)
    return False


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    names: list[str]
    limits: np.ndarray

    def predict(self, texts: list[bytes | memoryview]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine in 0 to 1, rejected) of each text."""
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = _unit(np.log1p(counts(texts)) * self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        top = cosine[np.arange(len(texts)), best].astype(np.float64).clip(0, 1)
        return [self.names[i] for i in best], top, top < self.limits[best]


def _cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means, first centroids by farthest point: (centroids, cluster of each row)."""
    chosen = [0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen]
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        c = _unit(np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c, (x @ c.T).argmax(axis=1)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fits on at most ``SAMPLE_DOCS`` documents of each language (least hash of the id first), texts of at
    most ``SAMPLE_CHARS`` characters, never on held-out ids. Null languages and texts are left out; a
    repeated id counts once. Without rows nothing is learned and every text is ``und``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.length(text_col).alias("n"))
    rows = rows.filter("lang is not null and n > 0").filter((F.col("n") <= SAMPLE_CHARS) & F.col("id").isNotNull() & ~held_out("id", FOLDS, HELD_FOLD))
    order = [F.xxhash64("id"), F.col("id")]
    # the first of each of 64 parts of a language, then the first of these: the second step has a fixed bound
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = rows.withColumn("rank", rank("lang", "part")).filter(F.col("rank") <= SAMPLE_DOCS // 8)
    rows = rows.withColumn("rank", rank("lang")).filter(F.col("rank") <= SAMPLE_DOCS)
    chosen = {r.id: r.lang for r in rows.select("id", "lang").orderBy("id", F.desc("lang")).collect()}
    if not chosen:
        return LanguageModel(np.zeros(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), [], np.zeros(0))
    ids = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in chosen], "id long"))  # SAMPLE_DOCS for each language
    found = picked(docs, id_col, text_col).join(ids, "id").filter(F.length("text") <= SAMPLE_CHARS).groupBy("id").agg(F.min("text").alias("text")).collect()
    found = sorted((r.id, r.text.encode()) for r in found if r.text)
    raw = np.concatenate([counts([t for _, t in found[i : i + 100]]) for i in range(0, len(found), 100)])
    idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _unit(np.log1p(raw) * idf)
    langs = np.array([chosen[i] for i, _ in found])
    centroids, names, limits = [], [], []
    for name in sorted(set(langs.tolist())):
        own = x[langs == name]
        c, cluster = _cluster(own, CENTROIDS)
        near = (own * c[cluster]).sum(axis=1)
        centroids.append(c)
        names += [name] * len(c)
        limits += [max(0.0, float(np.mean(near[cluster == i]) - 4 * np.std(near[cluster == i]))) if (cluster == i).any() else 0.0 for i in range(len(c))]
    return LanguageModel(idf, np.concatenate(centroids).astype(np.float32), names, np.array(limits))


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) for every row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0. A rejected text keeps the language
    that lies nearest; ``rejected`` says that it lies too far from it; of equal cosines the first language by
    name counts. Repeated rows are each answered, an empty table gives no rows, and a text of any length is
    counted in blocks.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        empty = memoryview(b"")
        for b in batches:
            for part in portions(b, 100, 2_000_000):
                texts = [memoryview(t.as_buffer()) if t.is_valid else empty for t in part.column("text")]
                letters = [has_letter(t) for t in texts]
                names, score, rejected = model.predict(texts)
                yield {
                    "id": part.column("id"), "lang_pred": [n if ok else "und" for n, ok in zip(names, letters)],
                    "score": np.where(letters, score, 0.0), "rejected": np.where(letters, rejected, True),
                }

    found = map_arrow(picked(docs, id_col, text_col), {"id": "long", "lang_pred": "string", "score": "double", "rejected": "boolean"}, rows)
    return found.select("id", held_out("id", FOLDS, HELD_FOLD).alias("held_out"), "lang_pred", "score", "rejected")
