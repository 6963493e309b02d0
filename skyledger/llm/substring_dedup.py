"""Substring dedup by seed and extend over winnowed anchors.

A window is ``window`` consecutive words. Of the ``SEED``-word hashes in a window the least one (the
last of equals) is its anchor, so equal windows have equal anchors wherever they stand. A run is a
stretch of windows with one anchor, and its span is all words of these windows: the anchor extended
both ways as far as it is picked. Documents meet on anchors (seed), then on spans (extend). Where all
spans of an anchor are equal the extension is decided for the whole run; where they differ, as at the
ends of a repeat, the windows of one representative of each span are compared one by one. Adjacent
removed windows make up the maximal repeats. Pairs of documents are never formed: each class of equal
anchors, spans or windows is reduced to its least document id, with partial sums before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import map_arrow, picked, portions, text_bytes, written

SEED = 8
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_EMPTY = hashlib.sha256(b"").hexdigest()


class _Powers:
    """Powers of the inverse bases modulo 2**64, and of the bases, as long as the longest document so far."""

    def __init__(self) -> None:
        self.n = 0

    def upto(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 4096)
            power = lambda base: np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(self.n, base, np.uint64)))
            self.up = [power(b) for b in _BASE]
            self.down = [power(pow(b, -1, 1 << 64)) for b in _BASE]


_POWERS = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """128-bit hashes of any stretch of a document's words, from prefix sums."""

    def __init__(self, words: list[bytes]) -> None:
        n = len(words)
        _POWERS.upto(n + 1)
        word = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(n, 2)
        self.sums = [np.concatenate((np.zeros(1, np.uint64), (word[:, i] * _POWERS.down[i][:n]).cumsum(dtype=np.uint64))) for i in (0, 1)]

    def of(self, start: np.ndarray, size: np.ndarray | int, i: int = 0) -> np.ndarray:
        s = self.sums[i]
        return _mix((s[start + size] - s[start]) * _POWERS.up[i][start] + np.uint64(0xA24BAED4963EE407) * np.asarray(size, np.uint64))


@dataclass
class Runs:
    """Of each run: its first and last window, its anchor's hash and its span's."""

    first: np.ndarray
    last: np.ndarray
    seed: np.ndarray
    low: np.ndarray
    high: np.ndarray


def runs_of(hashes: Hashes, n: int, window: int) -> Runs:
    """Runs of a document of ``n`` words, at least ``window``."""
    h = hashes.of(np.arange(n - SEED + 1), SEED)
    wide, best, reach = window - SEED + 1, np.arange(len(h)), 1
    later = lambda a, b: np.where(h[b] <= h[a], b, a)
    while reach * 2 <= wide:
        best, reach = later(best[:-reach], best[reach:]), reach * 2
    if wide > reach:
        best = later(best[: n - window + 1], best[wide - reach : wide - reach + n - window + 1])
    cut = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
    last = np.append(cut[1:], len(best)) - 1
    size = last - cut + window
    return Runs(cut, last, h[best[cut]], hashes.of(cut, size), hashes.of(cut, size, 1))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _digested(docs: DataFrame, window: int) -> DataFrame:
    """(id, n_words, sha256, words, seeds, lows, highs) of each document: its words compressed, its runs as arrays."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        zstd = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for part in portions(b, 200, 8_000_000):
                out = {k: [] for k in ("n_words", "sha256", "words", "seeds", "lows", "highs")}
                for text in text_bytes(part):
                    words = text.split()
                    joined = b" ".join(words)
                    out["n_words"].append(len(words))
                    out["sha256"].append(hashlib.sha256(joined).hexdigest())
                    out["words"].append(zstd.compress(joined) if len(words) >= window else b"")
                    r = runs_of(Hashes(words), len(words), window) if len(words) >= window else None
                    for k, v in (("seeds", r and r.seed), ("lows", r and r.low), ("highs", r and r.high)):
                        out[k].append(np.zeros(0, np.int64) if v is None else _signed(v))
                yield {"id": part.column("id")} | out

    columns = {"id": "long", "n_words": "long", "sha256": "string", "words": "binary", "seeds": "array<long>", "lows": "array<long>", "highs": "array<long>"}
    return map_arrow(docs, columns, rows)


def _covered(words: DataFrame, window: int) -> DataFrame:
    """(id, n_words, n_removed, kept, kept_sha256) of (id, n_words, words, removed, starts): runs and single windows removed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        zstd = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                out = {k: [] for k in ("n_removed", "kept_sha256")}
                for packed, removed, starts in zip(part.column("words").to_pylist(), part.column("removed").to_pylist(), part.column("starts").to_pylist()):
                    split = zstd.decompress(packed).split(b" ")
                    step = np.zeros(len(split) + 1, np.int64)
                    if removed:
                        r = runs_of(Hashes(split), len(split), window)
                        np.add.at(step, r.first[removed], 1)
                        np.add.at(step, r.last[removed] + window, -1)
                    for s in starts or ():
                        step[s] += 1
                        step[s + window] -= 1
                    gone = step.cumsum()[:-1] > 0
                    out["n_removed"].append(int(gone.sum()))
                    out["kept_sha256"].append(hashlib.sha256(b" ".join([w for w, g in zip(split, gone.tolist()) if not g])).hexdigest())
                yield {"id": part.column("id"), "n_words": part.column("n_words")} | out

    return map_arrow(words.select("id", "n_words", "words", "removed", "starts"), {"id": "long", "n_words": "long", "n_removed": "long", "kept_sha256": "string"}, rows)


def _windows(words: DataFrame, window: int) -> DataFrame:
    """(row, id, start, low, high) of every window of the runs in ``open``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        zstd = zstandard.ZstdDecompressor()
        for b in batches:
            for row, doc, packed, opened in zip(b.column("row").to_pylist(), b.column("id").to_pylist(), b.column("words").to_pylist(), b.column("open").to_pylist()):
                split = zstd.decompress(packed).split(b" ")
                hashes = Hashes(split)
                r = runs_of(hashes, len(split), window)
                start = np.concatenate([np.arange(r.first[i], r.last[i] + 1) for i in opened])
                n = len(start)
                yield {"row": [row] * n, "id": [doc] * n, "start": start.astype(np.int32), "low": _signed(hashes.of(start, window)), "high": _signed(hashes.of(start, window, 1))}

    return map_arrow(words.filter(F.size("open") > 0).select("row", "id", "words", "open"), {"row": "long", "id": "long", "start": "int", "low": "long", "high": "long"}, rows)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for every row of ``docs``.

    A word goes if a window over it has words that also start, as a window, in a row of smaller id.
    Words are runs of anything but ASCII white space; null and empty texts have none, and texts of fewer
    words than ``window`` keep all. A repeated row is judged like its twin, since their ids are equal; a
    row with a null id neither loses words nor makes others lose them. An empty table gives no rows.
    """
    if window <= SEED:
        raise ValueError(f"a window has over {SEED} words")
    base = written(_digested(picked(docs, id_col, text_col), window).withColumn("row", F.monotonically_increasing_id()), "digested")
    runs = base.select("row", "id", F.posexplode(F.arrays_zip("seeds", "lows", "highs")).alias("run", "r")).select("row", "id", "run", "r.seeds", "r.lows", "r.highs")
    seeds = runs.groupBy("seeds").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.min("lows").alias("low"), F.max("lows").alias("high"))
    seeds = written(seeds.filter("least < most").select("seeds", (F.col("low") != F.col("high")).alias("mixed")), "seeds")
    met = written(runs.join(seeds, "seeds").select("row", "id", "run", "mixed", "lows", "highs"), "met")
    spans = written(met.groupBy("lows", "highs").agg(F.min("id").alias("least")), "spans")
    judged = met.join(spans, ["lows", "highs"]).withColumn("gone", F.coalesce(F.col("id") > F.col("least"), F.lit(False)))
    judged = judged.filter("gone or mixed").groupBy("row").agg(
        F.collect_list(F.when(F.col("gone"), F.col("run"))).alias("removed"), F.collect_list(F.when(~F.col("gone"), F.col("run"))).alias("open"), F.count_if("gone").alias("n_gone")
    )
    judged = written(judged, "judged")
    light = base.select("row", "id", "n_words", "sha256", F.size("seeds").alias("n_runs")).join(judged.select("row", "n_gone"), "row", "left")
    whole = light.filter("n_gone is null or n_gone = n_runs").select("id", "n_words", F.when(F.col("n_gone") > 0, F.col("n_words")).otherwise(F.lit(0)).alias("n_removed"), F.when(F.col("n_gone") > 0, F.lit(_EMPTY)).otherwise(F.col("sha256")).alias("kept_sha256"))
    part = base.select("row", "id", "n_words", "words", F.size("seeds").alias("n_runs")).join(judged, "row").filter("n_gone < n_runs").drop("n_gone", "n_runs")
    part = written(part, "part")
    windows = written(_windows(part, window), "windows")
    least = written(windows.groupBy("low", "high").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").drop("most"), "least")
    starts = windows.join(least, ["low", "high"]).filter("id > least").groupBy("row").agg(F.collect_list("start").alias("starts"))
    return whole.union(_covered(part.join(starts, "row", "left"), window))
