"""Shared helpers: Arrow batch maps, remembered words, bounded samples. Tables in the shared folder come from the library's own helper."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.sources.scratch import discard, new_path, shared_folder, written  # noqa: F401  for the operators here

def map_arrow(df: DataFrame, columns: dict[str, str], rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` where ``rows`` yields dicts of column lists and ``columns`` gives Spark's types."""
    arrow = pa.schema([(name, ARROW[kind]) for name, kind in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()  # workers live on between tasks

    return df.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in columns.items()))


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()),
}


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


class Recent:
    """Results by word, kept for the words of the last ``most`` to twice as many new ones; longer words than ``short`` are not kept."""

    def __init__(self, most: int, short: int) -> None:
        self.most, self.short = most, short
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def of(self, words: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Results of distinct words; ``learn`` gives those that are not kept."""
        out = list(map(self.young.get, words))
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        again, new = [], []
        for i, x in enumerate(out):
            if x is None:
                (again if words[i] in self.old else new).append(i)
        for i in again:
            out[i] = self.old[words[i]]
        for i, x in zip(new, learn([words[i] for i in new])):
            out[i] = x
        self.young |= [(words[i], out[i]) for part in (again, new) for i in part if len(words[i]) <= self.short]
        return out


def portions(batch: pa.RecordBatch, rows: int, size: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows whose texts have about ``size`` bytes, one row at least."""
    lengths = pc.binary_length(batch.column(name).cast(pa.binary()).fill_null(b"")).to_numpy().astype(np.int64)
    upto, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        base = upto[at - 1] if at else 0
        till = min(at + rows, max(at + 1, int(np.searchsorted(upto, base + size, side="right"))))
        yield batch.slice(at, till - at)
        at = till


def ids_by_word(words: pa.ListArray, kind: str, ids_of: Callable[[list], list[bytes]]) -> list[np.ndarray]:
    """Ids of each row of ``words``: ``ids_of`` gives those of the distinct words, packed as ``kind``, and
    they are put together by index, so that Python never walks over all words."""
    coded = words.flatten().dictionary_encode()
    index = coded.indices.to_numpy().astype(np.int64)
    packed = ids_of(coded.dictionary.to_pylist())
    size = np.fromiter(map(len, packed), np.int64, len(packed)) // np.dtype(kind).itemsize
    flat = np.frombuffer(b"".join(packed), kind)
    n = size[index]
    upto = np.concatenate((np.zeros(1, np.int64), n.cumsum()))
    width = np.int32 if max(len(flat), upto[-1]) < 2**31 else np.int64
    at = np.repeat(((size.cumsum() - size)[index] - upto[:-1]).astype(width), n)
    at += np.arange(upto[-1], dtype=width)
    every = flat[at]
    edges = upto[words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()].tolist()
    return [every[a:b] for a, b in zip(edges, edges[1:])]


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` as (id, text), whatever other columns it has."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def bounded_sample(rows: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """At most ``n`` of ``rows``, least hash of ``id`` first. A share of the hashes that holds some ``4 n``
    rows of ``table`` goes on to the sort, so that tasks do not each send ``n`` rows."""
    spot = F.xxhash64("id")
    total = table.count()
    if total > 8 * n:
        rows = rows.filter(F.pmod(spot, F.lit(1_000_000_007)) < int(4 * n / total * 1_000_000_007) + 1)
    return rows.orderBy(F.pmod(spot, F.lit(1_000_000_007)), spot, "id").limit(n)


def held_out(id_col: str | Column, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text, modulo ``folds``, is ``fold``; a null id counts as empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds == fold
