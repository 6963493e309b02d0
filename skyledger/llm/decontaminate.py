"""Benchmark decontamination with a generalised suffix automaton over normalised words.

The automaton holds every run of words of every item. A document's words stream through it; the
longest match that ends at each word is tracked by suffix links. A match of ``window`` words or more
marks its words as hit, and so does a whole shorter item. The benchmark is written in blocks of some
``BLOCK_WORDS`` words, one automaton each, so that what a worker holds does not grow with it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import map_arrow, new_path, picked, portions, text_bytes, unused_name, written

#: Words of items in one automaton; a larger benchmark is matched block by block.
BLOCK_WORDS = 400_000
#: A-Z to a-z; every ASCII byte that is no digit or letter to a space; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def item_words(text: bytes) -> list[bytes]:
    """Normalised words: A-Z lower-cased, runs of letters, digits and non-ASCII characters."""
    return text.translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window, self.vocab = window, {}
        self.next, self.link, self.size = [{}], [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: Of a state: the items whose windows end there, by the state of the window itself.
        self.items: dict[int, set[str]] = {}
        #: Of a state: (length, items) of whole short items that it ends with.
        self.short: dict[int, dict[int, set[str]]] = {}
        for name, codes in coded:
            state = 0
            for i, c in enumerate(codes):
                state = self.next[state][c]
                if i + 1 >= window:
                    self.items.setdefault(self._shortened(state, window), set()).add(name)
            if len(codes) < window:
                self.short.setdefault(self._shortened(state, len(codes)), {}).setdefault(len(codes), set()).add(name)
        self.least = min([window, *(len(codes) for _, codes in coded)])
        #: The nearest state at or above one that ends a short item; -1 if none.
        self.ends = [-1] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.size.__getitem__):
            self.ends[v] = v if v in self.short else self.ends[self.link[v]]

    def _shortened(self, state: int, size: int) -> int:
        while self.size[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _extend(self, last: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        if c in nxt[last]:
            q = nxt[last][c]
            if size[q] == size[last] + 1:
                return q
            return self._clone(last, q, c)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(hit spans of word numbers, end exclusive, in order; names of the items whose windows occur)."""
        spans, names, window = [], set(), self.window
        codes = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int64, len(words))
        known = np.concatenate(([0], codes > 0, [0])).astype(np.int8)
        edge = np.flatnonzero(np.diff(known))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):  # an unknown word ends every match
            if end - start < self.least:
                continue
            state = matched = 0
            for i, c in enumerate(codes[start:end].tolist(), start + 1):
                while state and c not in self.next[state]:
                    state = self.link[state]
                    matched = self.size[state]
                if c in self.next[state]:
                    state, matched = self.next[state][c], matched + 1
                longest = 0
                if matched >= window:
                    longest = matched
                    names |= self.items[self._shortened(state, window)]
                short = self.ends[state]
                while short > 0:
                    for size, found in self.short[short].items():
                        if size <= matched:
                            names |= found
                            longest = max(longest, size)
                    short = self.ends[self.link[short]]
                if longest:
                    first = i - longest
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, i))
        return spans, names


@dataclass(frozen=True)
class Blocks:
    """The items in a folder of the shared store, in ``count`` blocks; the driver holds no item."""

    path: str
    count: int


def stored_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Blocks:
    """Writes the items in blocks of about ``BLOCK_WORDS`` words. An item is never cut: one longer than a block makes its block longer."""
    items = benchmark.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text")).filter("name is not null and text is not null")
    words = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = Blocks(new_path(benchmark.sparkSession, "items"), 1 + int(words) // (4 * BLOCK_WORDS))
    items.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(blocks.count))).repartition("block").write.partitionBy("block").parquet(blocks.path)
    return blocks


@lru_cache(maxsize=1)
def automaton_of(path: str, block: int, window: int) -> Automaton:
    """The automaton of one stored block; a worker keeps it between tasks."""
    from pyarrow import dataset, fs

    store, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    folder = f"{place}/block={block}"
    if store.get_file_info(folder).type == fs.FileType.NotFound:
        return Automaton([], window)
    table = dataset.dataset(folder, filesystem=store, format="parquet").to_table(columns=["name", "text"])
    rows = sorted(zip(table.column("name").to_pylist(), table.column("text").to_pylist()))
    return Automaton([(name, item_words(text.encode())) for name, text in rows], window)


def _scanned(docs: DataFrame, text_col: str, window: int, blocks: Blocks, block: int, schema: T.StructType, then) -> DataFrame:
    """``then`` applied to each portion of ``docs`` with its numbers of words, hit spans and items of one block."""
    path = blocks.path

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(path, block, window)
        for b in batches:
            for part in portions(b, 500, 8_000_000, text_col):
                n, spans, items = [], [], []
                for text in text_bytes(part, text_col):
                    words = item_words(text)
                    hit, names = automaton.stream(words)
                    n.append(len(words))
                    spans.append([x for pair in hit for x in pair])
                    items.append(sorted(names))
                yield then(part, n, spans, items)

    return docs.mapInArrow(rows, schema)


#: Names of the columns that ``matches`` adds.
FOUND = ("__n_words", "__spans", "__items")


def _with_matches(docs: DataFrame, text_col: str, window: int, blocks: Blocks, block: int, names: Sequence[str]) -> DataFrame:
    """``docs`` with the three columns for the items of one block."""

    def then(part: pa.RecordBatch, n: list, spans: list, items: list) -> pa.RecordBatch:
        new = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *names])

    more = [T.StructField(name, kind) for name, kind in zip(names, (T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())))]
    return _scanned(docs, text_col, window, blocks, block, T.StructType([*docs.schema.fields, *more]), then)


def matches(docs: DataFrame, benchmark: DataFrame | Blocks, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, names: Sequence[str] = FOUND) -> DataFrame:
    """``docs`` with three columns, named by ``names``: the number of words, the spans (hit words as flat pairs of word
    numbers, end exclusive, merged and in order) and the items that occur (sorted names).

    Null and empty texts have no words; a text may be of any length. Items without words or with a null id are
    skipped; an empty benchmark hits nothing, an empty table gives no rows. Repeated rows are each answered.
    Columns of these names must not exist yet. A benchmark beyond one block costs one pass over the documents
    for each block; the passes are joined on a row number that was written.
    """
    if taken := set(names) & set(docs.columns):
        raise ValueError(f"columns exist already: {', '.join(sorted(taken))}")
    blocks = benchmark if isinstance(benchmark, Blocks) else stored_items(benchmark, item_id, item_text)
    if blocks.count == 1:
        return _with_matches(docs, text_col, window, blocks, 0, names)
    row = unused_name(docs, "__row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(row).alias("row"), F.col(f"`{text_col}`").alias("text"))
    passes = None
    for block in range(blocks.count):
        found = _with_matches(texts, "text", window, blocks, block, ("n", "spans", "items")).drop("text")
        passes = found if passes is None else passes.union(found)
    every = passes.groupBy("row").agg(F.max("n").alias("n"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out = []
            for flat in b.column("spans").to_pylist():
                spans: list[list[int]] = []
                for s, e in sorted(zip(flat[::2], flat[1::2])):
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(e, spans[-1][1])
                    else:
                        spans.append([s, e])
                out.append([x for pair in spans for x in pair])
            yield {c: b.column(c) for c in ("row", "n", "items")} | {"spans": out}

    every = map_arrow(every, {"row": "long", "n": "long", "spans": "array<int>", "items": "array<string>"}, merged)
    return numbered.join(every.select("row", "n", "spans", "items").toDF(row, *names), row).drop(row)


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``."""
    found = matches(picked(docs, id_col, text_col), benchmark, **names)
    spans = F.col("__spans")
    hit = F.aggregate(F.transform(spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, x: a + x)
    return found.select(
        "id", F.col("__n_words").alias("n_words"), hit.cast("long").alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"), (F.size(spans) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` with the spans that match an item cut from the text. A document whose hit words are over
    ``max_coverage`` of all its words goes. Texts without hits, null ones among them, stay as they are. Repeated
    rows are each judged, an empty table gives no rows, columns may have any names."""

    names = docs.columns

    def cut(b: pa.RecordBatch, words: list, spans: list, _items: list) -> pa.RecordBatch:
        texts, keep = b.column(text_col).to_pylist(), [True] * b.num_rows
        for i, (flat, n) in enumerate(zip(spans, words)):
            if flat:
                keep[i] = sum(flat[1::2]) - sum(flat[::2]) <= max_coverage * n
                raw = texts[i].encode()
                at = [m.span() for m in _WORD.finditer(raw)]
                cuts = [0, *(x for s, e in zip(flat[::2], flat[1::2]) for x in (at[s][0], at[e - 1][1])), len(raw)]
                texts[i] = b"".join(raw[s:e] for s, e in zip(cuts[::2], cuts[1::2])).decode()
        columns = [pa.array(texts, pa.string()) if name == text_col else b.column(name) for name in names]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    blocks = stored_items(benchmark)
    if blocks.count == 1:
        return _scanned(docs, text_col, window, blocks, 0, docs.schema, cut)
    added = [unused_name(docs, name) for name in FOUND]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield cut(b, b.column(added[0]).to_pylist(), b.column(added[1]).to_pylist(), [])

    return matches(docs, blocks, text_col, window=window, names=added).mapInArrow(rows, docs.schema)


def digest(names: set[str]) -> str:
    """The digest of item names as ``report`` gives it."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
