"""SimHash near-duplicates with anchor-point covering.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in at most five bits
differ in at most two bits of one half. The anchors of a half are the codewords of the perfect
(31, 26) Hamming code over its low 31 bits: every 31-bit word lies within covering radius 1 of
exactly one anchor. Two half-words at distance at most 2 have a point half way, at most 1 from
either, so the anchor of that point lies within covering radius 1 plus 1 (the threshold that falls
to each side) of both. Each distinct fingerprint is therefore copied to every anchor within
distance 2 of either half, at most 16 each, and only fingerprints that share an anchor are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.llm.common import discard, map_arrow, picked, portions, text_bytes, unused_name, written
from skyledger.llm.components import connected_components, star

#: Fingerprints of one anchor that a task compares at once; fuller anchors are dealt out in pairs of chunks.
CHUNK = 2048
#: Fingerprints in whose anchors full ones are looked for beforehand.
SAMPLE = 5_000
#: The greatest number of a group of fingerprints that are tied already.
TIES = (1 << 32) - 1
#: Up to this many fingerprints of an anchor are compared by shifts over the whole batch.
SMALL = 48


@lru_cache(maxsize=4)
def _offsets(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the patterns of weight at most 2 within ``bits`` bits that lead to a codeword, and how many there are."""
    table, count = np.zeros((32, 16), np.int64), np.zeros(32, np.int64)
    for s in range(32):
        one = [0] if s == 0 else [1 << (s - 1)] if s <= bits else []
        found = one + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, bits + 1) if i < i ^ s <= bits]
        table[s, : len(found)], count[s] = found, len(found)
    return table, count


def anchors(words: np.ndarray, bits: int = 31) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, anchors): every codeword within distance 2 of the low ``bits`` bits of each word."""
    table, count = _offsets(bits)
    word = words.astype(np.int64) & ((1 << bits) - 1)
    syndrome = np.zeros(len(word), np.int64)
    for i in range(1, bits + 1):
        syndrome ^= np.where(word >> (i - 1) & 1, i, 0)
    n = count[syndrome]
    keep = np.arange(16)[None, :] < n[:, None]
    return np.repeat(np.arange(len(word)), n), (word[:, None] ^ table[syndrome])[keep]


def fingerprint(text: bytes, shingle_words: int = 4) -> int:
    """Bit i is 1 if over half of the shingles' XXH64 (seed 42) have it; no words: 0.

    A-Z are lower-cased, words are runs of anything but ASCII white space, fewer words than
    ``shingle_words`` make one shingle.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_digest
    total, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 16384):
        till = min(n, at + 16384)
        some = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[at:till].tolist(), ends[at + k - 1 : till + k - 1].tolist())])
        total += np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long. Null text counts as empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for part in portions(b, 500, 8_000_000):
                yield {"id": part.column("id"), "fp": [_signed(fingerprint(x, shingle_words)) for x in text_bytes(part)]}

    return map_arrow(picked(docs, id_col, text_col), {"id": "long", "fp": "long"}, rows)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit numbers."""
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _forest(bits: np.ndarray, group: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Edges (first numbers of rows) of a spanning forest of the graph that links rows at ``most`` or fewer bits, but for
    those within a ``group`` (0: none), which are tied already."""
    left = np.arange(len(bits))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = _apart(bits[left], bits[x]) <= most
            if hit.any():
                found = left[hit]
                left = left[~hit]
                yield from ((int(bits[x, 0]), int(bits[y, 0])) for y in found if not group[x] or group[x] != group[y])
                queue.extend(found)


def _links(key: np.ndarray, bits: np.ndarray, most: int, group: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links within runs of equal keys: short runs by shifts, each run's links reduced to a forest; none within a ``group``."""
    group = np.zeros(len(key), np.int64) if group is None else group
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(cut, len(key)))
    run = np.repeat(np.arange(len(cut)), size)
    small = np.flatnonzero(size[run] <= SMALL)
    r, f, g = run[small], bits[small], group[small]
    parent: dict[tuple[int, int], int] = {}

    def top(k: int, x: int) -> int:
        while (y := parent.get((k, x), x)) != x:
            x = y
        return x

    for d in range(1, int(min(SMALL, size.max(initial=1)))):
        same = np.flatnonzero(r[d:] == r[:-d])
        if not len(same):
            break
        for i in same[_apart(f[same + d], f[same]) <= most].tolist():
            k, x, y = int(r[i]), int(f[i, 0]), int(f[i + d, 0])
            p, q = top(k, x), top(k, y)
            if p != q:
                parent[k, max(p, q)] = min(p, q)
                if not g[i] or g[i] != g[i + d]:
                    yield x, y
    for i in np.flatnonzero(size > SMALL).tolist():
        yield from _forest(bits[cut[i] : cut[i] + size[i]], group[cut[i] : cut[i] + size[i]], most)


def _covered(nodes: DataFrame, bits: int, prints: Sequence[str], grouped: bool) -> DataFrame:
    """(cell, and the 64-bit ``prints``): each fingerprint at every anchor within distance 2 of each of its words. If
    ``grouped``, the lower 32 bits of cell are the column ``tie``, a place that the shuffle does not pay for."""
    more = ("tie",) if grouped else ()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            every = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in prints]
            words = b.column("words").flatten().to_numpy().reshape(b.num_rows, -1)
            for at in range(0, b.num_rows, 20_000):
                for part in range(words.shape[1]):
                    row, anchor = anchors(words[at : at + 20_000, part], bits)
                    cell = anchor << 6 | part
                    if grouped:
                        cell = cell << 32 | b.column("tie").to_numpy()[at : at + 20_000][row]
                    yield {"cell": cell} | {c: x[at : at + 20_000][row] for c, x in zip(prints, every)}

    return map_arrow(nodes.select(*prints, *more, "words"), {"cell": "long"} | dict.fromkeys(prints, "long"), rows)


def _met(dealt: DataFrame, most: int, prints: Sequence[str], bound: int | None, grouped: bool) -> DataFrame:
    """(a, b, cell, prints) of rows (cell, prints) in the order of cells: a link, or, for the rows of a cell of over
    ``bound`` rows, the cell and the fingerprint, for another pass."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cell, fp, full = np.zeros(0, np.int64), np.zeros((0, len(prints) + grouped), np.int64), None

        def out(edges: list[tuple[int, int]], k: np.ndarray = cell, f: np.ndarray = fp) -> dict:
            no = pa.nulls(len(k), pa.int64())
            link = {"a": pa.concat_arrays([pa.array([x for x, _ in edges], pa.int64()), no]), "b": pa.concat_arrays([pa.array([y for _, y in edges], pa.int64()), no])}
            blank = pa.nulls(len(edges), pa.int64())
            return link | {"cell": pa.concat_arrays([blank, pa.array(k << 32 | f[:, -1] if grouped else k)])} | {c: pa.concat_arrays([blank, pa.array(f[:, i])]) for i, c in enumerate(prints)}

        for b in chain(batches, [None]):
            if b is None:
                done = len(cell)
            else:
                k, f = b.column("cell").to_numpy(), np.stack([b.column(c).to_numpy() for c in prints], axis=1)
                if grouped:
                    k, f = k >> 32, np.column_stack((f, k & TIES))
                if full is not None:
                    n = int(np.searchsorted(k, full, side="right"))
                    yield out([], k[:n], f[:n])
                    k, f, full = k[n:], f[n:], full if n == len(k) else None
                cell, fp = np.concatenate((cell, k)), np.concatenate((fp, f))
                done = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            first = np.flatnonzero(np.concatenate(([True], (cell[1:done] != cell[: done - 1]) | (fp[1:done] != fp[: done - 1]).any(axis=1)))) if done else np.zeros(0, np.int64)
            k, f = cell[first], fp[first]  # texts that share a fingerprint are one here
            if bound is not None and done:
                edge = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
                size = np.diff(np.append(edge, len(k)))
                over = np.repeat(size > bound, size)
                if over.any():
                    yield out([], k[over], f[over])
                    k, f = k[~over], f[~over]
            if len(k):
                yield out(list(_links(k, f[:, :-1], most, f[:, -1]) if grouped else _links(k, f, most)))
            cell, fp = cell[done:], fp[done:]
            if bound is not None and len(cell) > bound:
                yield out([], cell, fp)
                full, cell, fp = cell[0], cell[:0], fp[:0]

    return map_arrow(dealt, dict.fromkeys(("a", "b", "cell", *prints), "long"), rows)


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges that connect the same nodes: each node and its smaller neighbours are tied to the least of these, which is
    an aggregate that is joined back, so that no row holds a node's neighbours."""
    edges = written(edges.filter("a <> b").distinct(), "links")
    fewer, least = star(edges, False, 0)
    fewer = written(fewer, "contracted")
    discard(edges, least)
    return fewer


def cell_links(nodes: DataFrame, most: int, bits: int = 31, prints: Sequence[str] = ("fp",), contract: bool = True, grouped: bool = False) -> DataFrame:
    """Edges (a, b) that connect the fingerprints of ``nodes`` (prints, words array<int>) that share an anchor of
    a word and differ in at most ``most`` bits. Anchors are the codewords of the Hamming code over ``bits`` bits,
    perfect at 31 and shortened below. A fingerprint is one or more longs ``prints`` and is named by the first; if ``grouped``,
    a column ``tie`` numbers the groups of fingerprints that are tied already (1 to ``TIES``, 0: none), within which no edge is given.

    Each anchor gives a spanning forest of its links, so that a group of n has at most n - 1 edges for each
    anchor, and with ``contract`` the forests are contracted (not so that each edge can still be tested). Anchors with over ``CHUNK`` fingerprints are dealt out as pairs of
    chunks: those that a sample of ``SAMPLE`` fingerprints shows never meet in one task, others are passed on by
    the task that counts them.
    """
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rate = min(1.0, SAMPLE / max(1, nodes.count()))
    some = nodes if rate == 1 else nodes.filter(F.pmod(F.xxhash64(prints[0], F.lit("sample")), F.lit(1_000_003)) < int(rate * 1_000_003) + 1)
    place = F.shiftright("cell", 32) if grouped else F.col("cell")
    known = _covered(some, bits, prints, grouped).groupBy(place.alias("cell")).count().filter(F.col("count") > max(CHUNK * rate, 16)).select("cell")
    known = written(known, "known")  # a sample and a least count bound its rows
    copies = _covered(nodes, bits, prints, grouped)
    hot = None
    if not known.isEmpty():
        known = known.toDF("__known")
        hot = copies.join(F.broadcast(known), place == F.col("__known")).select("cell", *prints)
        copies = copies.join(F.broadcast(known), place == F.col("__known"), "left_anti")
    met = written(_met(copies.repartition(parts, place).sortWithinPartitions("cell", *prints), most, prints, CHUNK, grouped), "met")
    edges, more = met.filter("cell is null").select("a", "b"), met.filter("cell is not null").select("cell", *prints)
    if hot is not None or not more.isEmpty():
        more = written((more if hot is None else more.union(hot)).distinct(), "more")
        n = written(more.groupBy(place.alias("hot")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n")), "chunks")
        mine = F.pmod(F.xxhash64(prints[0]), "n").cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.least(mine, j) * F.col("n") + F.greatest(mine, j))
        key = F.xxhash64("hot", "pair")
        if grouped:
            key = F.shiftleft(key.bitwiseAND(F.lit((1 << 31) - 1)), 32).bitwiseOR(F.col("cell").bitwiseAND(F.lit(TIES)))
        dealt = more.withColumn("hot", place).join(n, "hot").select("hot", "cell", *prints, F.explode(pairs).alias("pair")).withColumn("cell", key)
        dealt = dealt.repartition(parts, place).sortWithinPartitions("cell", *prints)
        edges = edges.union(_met(dealt.select("cell", *prints), most, prints, None, grouped).select("a", "b"))
        out = contracted(edges) if contract else written(edges.distinct(), "edges")
        discard(known, met, more, n)
        return out
    out = contracted(edges) if contract else written(edges.distinct(), "edges")
    discard(known, met)
    return out


def links(distinct: DataFrame, max_distance: int = 4) -> DataFrame:
    """Edges (a, b) that connect every two fingerprints (fp long, distinct) at ``max_distance`` or fewer bits."""
    if not 0 <= max_distance <= 5:
        raise ValueError("two halves with threshold 2 cover at most 5 differing bits")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    return cell_links(distinct.select("fp", F.array(low, high).alias("words")), max_distance)


def named(prints: DataFrame, rooted: DataFrame) -> DataFrame:
    """(id, fp, component) of ``prints`` (id, fp): the least of the ids ``first`` that share a root in ``rooted``."""
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component")), "least")
    named = written(rooted.join(least, "root").select("fp", "component"), "named")
    return prints.join(named, "fp").select("id", "fp", "component")


def rooted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, first, root) of ``nodes`` (fp, first): the least fp that ``edges`` reach."""
    groups = connected_components(edges).withColumnRenamed("node", "fp")
    return written(nodes.join(groups, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_distance: int = 4) -> DataFrame:
    """(id, fp, component): every row of ``docs`` with its fingerprint and the least id that links reach.

    Texts without words (null and empty too) have fingerprint 0 and link like any other. A repeated row
    gives its row again. A null id keeps its row and never names a component unless all ids of it are null.
    An empty table gives no rows. Equal fingerprints are one node, so copies never meet in pairs.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    return named(prints, rooted(nodes, links(nodes, max_distance)))


def with_fingerprint(docs: DataFrame, text_col: str, shingle_words: int, name: str) -> DataFrame:
    """``docs`` with one more column ``name``, the fingerprint as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, 500, 8_000_000, text_col):
                fp = pa.array([_signed(fingerprint(x, shingle_words)) for x in text_bytes(part, text_col)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, fp], names=[*part.schema.names, name])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def keep_least(docs: DataFrame, prints: DataFrame, roots: DataFrame, id_col: str, with_fp: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``docs`` with one row of each group: that of the least id and, of one id, of the least fingerprint.

    ``prints`` is (id, fp) of the rows, ``roots`` (fp, first, root) of the fingerprints, ``with_fp`` adds the
    fingerprint to rows under a name. Rows with a null id stay. Rows that share an id but belong to different
    groups are judged each by their own group; of rows of equal id and fingerprint the one of least hash
    over all columns stays. No text leaves without another of its group that stays.
    """
    best = written(roots.filter("first is not null").groupBy("root").agg(F.min(F.struct("first", "fp")).alias("best")), "best")
    fate = written(roots.join(best, "root").filter(F.col("best.fp") == F.col("fp")).select("fp", F.col("best.first").alias("kept")), "fate")
    ids = prints.filter("id is not null").join(fate, "fp", "left").groupBy("id").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("kept") == F.col("id"), F.lit(False))).alias("stays"))
    ids = written(ids.filter("n > 1 or not stays"), "ids")
    key, own, fp = F.col(id_col).cast("long"), unused_name(docs, "__id"), unused_name(docs, "__fp")
    gone = ids.select(F.col("id").alias(own))
    out = docs.join(gone, key == F.col(own), "left_anti")
    repeated = written(ids.filter("n > 1 and stays").select(F.col("id").alias(own)), "repeated")
    if repeated.isEmpty():
        return out
    rows = with_fp(docs.join(repeated, key == F.col(own), "left_semi"), fp)
    names = unused_name(docs, "__kept_fp"), unused_name(docs, "__kept_id")
    rows = rows.join(fate.toDF(*names), (F.col(fp) == F.col(names[0])) & (key == F.col(names[1])), "left_semi")
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    one = rows.groupBy(key.alias(own), fp).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*hashed)).alias("row"))
    return out.unionByName(one.select("row.*"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, max_distance: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group; which one is in ``keep_least``."""
    found = written(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    nodes = written(found.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    return keep_least(docs, found, rooted(nodes, links(nodes, max_distance)), id_col, lambda some, name: with_fingerprint(some, text_col, shingle_words, name))
