"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks of ``CHUNK`` bytes whose windows reach ``WIDTH`` - 2 bytes
into the next, so that windows cover the whole document. ``FILTERS`` learned filters of ``WIDTH`` bytes
respond to each window; each filter's responses are max-pooled over a chunk, and the means and maxima
over all chunks are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import bounded_sample, held_out, map_arrow, picked, portions, text_bytes

CHUNK, WIDTH, STRIDE, FILTERS = 512, 8, 2, 16
#: The bound of the labelled sample: documents of each label, and characters of one document.
SAMPLE_DOCS, SAMPLE_CHARS = 1200, 30_000
FOLDS, HELD_FOLD, THRESHOLD = 5, 0, 0.3


def laid_out(text: bytes) -> np.ndarray:
    """Bytes of whole chunks and the overlap of the last; spaces fill up. An empty text is one chunk."""
    size = max(1, -(-len(text) // CHUNK)) * CHUNK + WIDTH
    return np.frombuffer(text.ljust(size, b" "), np.uint8)


class ByteCnn:
    """Parameters and passes of the network."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.w = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def _responses(self, data: np.ndarray, first: int, last: int) -> np.ndarray:
        """(chunk, window, filter) responses of some chunks."""
        n = (last - first) * CHUNK // STRIDE
        at = data[first * CHUNK : last * CHUNK + WIDTH]
        out = self.w[0].take(at[0 : n * STRIDE : STRIDE], axis=0)
        for j in range(1, WIDTH):
            out += self.w[j].take(at[j : j + n * STRIDE : STRIDE], axis=0)
        return out.reshape(last - first, CHUNK // STRIDE, FILTERS)

    def pooled(self, data: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each chunk's greatest responses, and with ``where`` the windows that gave them."""
        n = (len(data) - WIDTH) // CHUNK
        top, arg = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64) if where else None
        for first in range(0, n, 16):
            last = min(n, first + 16)
            out = self._responses(data, first, last)
            top[first:last] = out.max(axis=1)
            if where:
                arg[first:last] = out.argmax(axis=1)
        return top, arg

    def probability(self, text: bytes) -> float:
        top, _ = self.pooled(laid_out(text))
        return float(self._combine(np.maximum(top + self.b, 0))[0])

    def _combine(self, g: np.ndarray) -> tuple[float, np.ndarray]:
        h = np.concatenate((g.mean(axis=0), g.max(axis=0)))
        z = float(np.clip(h @ self.v + self.c[0], -30, 30))
        return 1 / (1 + np.exp(-z)), h

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = 12, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> ByteCnn:
        """Adam on the cross entropy with both labels weighing the same. One label or none: a constant.

        In each round a third of the texts is replaced by a short random piece, so that the network meets
        short texts of either label as often as long ones.
        """
        y = np.array(labels, np.float32)
        if not len(y) or y.min() == y.max():
            self.v[:] = 0
            self.c[0] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
            return self
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        data, rng = [laid_out(t) for t in texts], np.random.default_rng(seed)
        names = ("w", "b", "v", "c")
        m, s = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 32):
                grad = {k: np.zeros_like(getattr(self, k)) for k in names}
                batch = order[at : at + 32]
                for i in batch.tolist():
                    whole = data[i]
                    if rng.random() < 1 / 3 and len(texts[i]) > 40:
                        n = int(min(len(texts[i]), 10 ** rng.uniform(1.0, 2.6)))
                        first = int(rng.integers(len(texts[i]) - n + 1))
                        whole = laid_out(texts[i][first : first + n])
                    self._backward(whole, y[i], weight[i] / len(batch), grad)
                step += 1
                for k in names:
                    p, g = getattr(self, k), grad[k] + decay * getattr(self, k)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    p -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def _backward(self, data: np.ndarray, y: float, weight: float, grad: dict[str, np.ndarray]) -> None:
        top, arg = self.pooled(data, where=True)
        g = np.maximum(top + self.b, 0)
        p, h = self._combine(g)
        dz = np.float32(weight * (p - y))
        grad["v"] += dz * h
        grad["c"] += dz
        dg = np.broadcast_to(dz * self.v[:FILTERS] / len(g), g.shape).copy()
        dg[g.argmax(axis=0), np.arange(FILTERS)] += dz * self.v[FILTERS:]
        dg[g <= 0] = 0
        grad["b"] += dg.sum(axis=0)
        chunk, f = np.nonzero(dg)
        start, d = chunk * CHUNK + arg[chunk, f] * STRIDE, dg[chunk, f]
        for j in range(WIDTH):
            np.add.at(grad["w"][j], (data[start + j], f), d)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ByteCnn:
    """Fits on at most ``SAMPLE_DOCS`` documents of each label (least hash of the id first), texts of at
    most ``SAMPLE_CHARS`` characters, never on held-out ids. Null labels, ids and texts are left out; an
    id that is labelled twice counts with its least label.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id", FOLDS, HELD_FOLD))
    marked = marked.groupBy("id").agg(F.min("label").alias("label"))
    each = [marked.filter(F.col("label") == k) for k in (0, 1)]
    some = [bounded_sample(rows, rows, SAMPLE_DOCS) for rows in each]
    chosen = {r.id: r.label for r in some[0].union(some[1]).collect()}
    if not chosen:
        return ByteCnn().fit([], [])
    ids = F.broadcast(spark.createDataFrame([(i,) for i in chosen], "id long"))  # at most 2 * SAMPLE_DOCS rows
    texts = picked(docs, id_col, text_col).join(ids, "id").filter(F.length("text") <= SAMPLE_CHARS).groupBy("id").agg(F.min("text").alias("text"))
    rows = sorted((r.id, r.text) for r in texts.collect())
    return ByteCnn().fit([t.encode() for _, t in rows], [chosen[i] for i, _ in rows])


def score_quality(docs: DataFrame, model: ByteCnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``; null and empty texts are scored as spaces.

    Repeated rows are each answered, an empty table gives no rows, a text of any length is read in chunks, a
    score of just ``THRESHOLD`` is predicted as 1, and other columns may have any names.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for part in portions(b, 500, 8_000_000):
                yield {"id": part.column("id"), "score": [model.probability(t) for t in text_bytes(part)]}

    scored = map_arrow(picked(docs, id_col, text_col), {"id": "long", "score": "double"}, rows)
    return scored.select("id", held_out("id", FOLDS, HELD_FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: ByteCnn, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least ``THRESHOLD``, all columns as they were.

    Null and empty texts are scored as spaces and go or stay by that; rows with a null id are judged like any
    other, repeated rows alike; an empty table stays empty. Columns may have any names.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, 500, 8_000_000, text_col):
                yield part.filter(pa.array([model.probability(t) >= THRESHOLD for t in text_bytes(part, text_col)], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
