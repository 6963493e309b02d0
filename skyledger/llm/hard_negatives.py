"""Hard negatives by dual-tree search.

Rows are dealt into cells of space (splits learned from a bounded sample), and a cell with many rows into chunks by
a hash, so that a group of copies is dealt out too. Each chunk becomes a tree over its rows, stored by itself in the shared
folder: a node has a centre, a radius and the range of its labels. Anchors are dealt out in the same way; a task builds the tree of one group of
anchors and walks it against the tree of one chunk after the other. For two nodes the inner products lie in

    c.d - (|c| s + |d| r + r s)  to  c.d + |c| s + |d| r + r s        (centres c, d; radii r, s)

so a pair of nodes whose interval misses what the anchors of the node still want is left out with all its rows; pairs of
leaves are scored exactly. First each anchor's positives are found, then the negatives in the windows which these open. A
task holds one group of anchors, the list of chunks in portions, and one chunk: both sides of the search may grow.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import discard, map_arrow, new_path, written

#: Rows of a chunk and anchors of a group, about.
CHUNK_ROWS, GROUP_ANCHORS = 8192, 256
#: Rows that the splits into cells are learned from, and the most cells: four sampled rows a cell.
SAMPLE, MOST_CELLS = 4096, 1024
#: Rows of a leaf, and anchors of one: few, so that they lie close together.
LEAF, ANCHOR_LEAF = 64, 8
#: Chunks whose outlines a task reads at once.
OUTLINES = 4096
#: Components beyond this size after scaling could give scores beyond a long.
MOST = float(1 << 24)


def _split(vectors: np.ndarray) -> tuple[int, float] | None:
    """(dimension, value) that halves the rows where they spread most: up to the value, and over it; None if all are equal."""
    spread = np.ptp(vectors, axis=0) if vectors.size else np.zeros(0)
    if not len(spread) or not spread.max():
        return None
    d = int(spread.argmax())
    x = np.sort(vectors[:, d])
    value = x[(len(x) - 1) // 2]
    return d, float(value if value < x[-1] else x[np.searchsorted(x, value) - 1])


class Cells:
    """Splits learned from a sample; ``of`` gives the cell of each row."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.nodes: list[tuple] = []
        parts = [sample]
        self.nodes.append(())
        queue = [(0, 0)]
        self.count = 1
        while queue and self.count < cells:
            queue.sort(key=lambda x: -len(parts[x[1]]))
            node, part = queue.pop(0)
            if len(parts[part]) < 8 or (cut := _split(parts[part])) is None:
                continue
            low = parts[part][:, cut[0]] <= cut[1]
            children = []
            for side in (low, ~low):
                parts.append(parts[part][side])
                self.nodes.append(())
                children.append(len(self.nodes) - 1)
                queue.append((len(self.nodes) - 1, len(parts) - 1))
            self.nodes[node] = (*cut, *children)
            self.count += 1

    def of(self, vectors: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(vectors), np.int64), [(0, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if not self.nodes[node]:
                out[rows] = node
                continue
            d, value, left, right = self.nodes[node]
            low = vectors[rows, d] <= value
            stack += [(left, rows[low]), (right, rows[~low])]
        return out


def _halves(vectors: np.ndarray) -> np.ndarray | None:
    """Which rows lie nearer to the first of two rows far apart; where that leaves a side under an eighth, a cut at a
    value; None if all rows are equal."""
    far = vectors[((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    apart = ((vectors - far) ** 2).sum(axis=1)
    if not len(apart) or not apart.max():
        return None
    low = apart < ((vectors - vectors[apart.argmax()]) ** 2).sum(axis=1)
    if min(low.sum(), (~low).sum()) * 8 >= len(low):
        return low
    d, value = _split(vectors)
    return vectors[:, d] <= value


class Tree:
    """Rows in an order in which every node is a range of them. Labels are split first, then space."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        order = np.lexsort((ids, labels))
        self.nodes: list[list] = []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            lo, hi, parent, side = stack.pop()
            rows = order[lo:hi]
            mine, own = vectors[rows], labels[rows]
            centre = mine.mean(axis=0)
            radius = math.sqrt(max(0.0, float(((mine - centre) ** 2).sum(axis=1).max(initial=0)))) * (1 + 1e-9)
            self.nodes.append([centre, radius, float(np.linalg.norm(centre)), lo, hi, int(own.min()), int(own.max()), -1, -1])
            here = len(self.nodes) - 1
            if parent >= 0:
                self.nodes[parent][7 + side] = here
            if hi - lo <= leaf:
                continue
            if own.min() < own.max():  # sorted by label until here
                at = np.flatnonzero(own[1:] != own[:-1]) + 1
                at = int(at[np.abs(at - len(own) // 2).argmin()])
            elif (low := _halves(mine)) is not None:
                order[lo:hi] = np.concatenate((rows[low], rows[~low]))
                at = int(low.sum())
            else:
                at = len(rows) // 2  # copies
            stack += [(lo, lo + at, here, 0), (lo + at, hi, here, 1)]
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]


def interval(a: list, b: list) -> tuple[float, float]:
    """Between which the inner products of the rows of two nodes lie."""
    middle = float(a[0] @ b[0])
    reach = a[2] * b[1] + b[2] * a[1] + a[1] * b[1]
    slack = 0.5 + 1e-11 * (abs(middle) + reach)  # scores are whole numbers
    return middle - reach - slack, middle + reach + slack


class _Best:
    """The first ``k`` of each query: highest score, then least id."""

    def __init__(self, queries: int, k: int) -> None:
        self.score = np.full((queries, k), -np.inf, np.longdouble)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` (rows x ids), -inf where a row does not want it."""
        k = self.score.shape[1]
        some = (score >= self.score[rows, -1:]) & (score > -np.inf)
        for r, i in enumerate(rows.tolist()):
            at = np.flatnonzero(some[r])
            if not len(at):
                continue
            s, x = np.concatenate((self.score[i], score[r, at])), np.concatenate((self.id[i], ids[at]))
            order = np.lexsort((x, -s))[:k]
            self.score[i], self.id[i] = s[order], x[order]


class Search:
    """The search of one group of anchors through any number of chunk trees."""

    def __init__(self, anchors: Tree, positives: int, negatives: int, low: int, high: int) -> None:
        self.anchors, self.low, self.high, self.positives = anchors, low, high, positives
        n = len(anchors.ids)
        self.near, self.far = _Best(n, positives), _Best(n * positives, negatives)
        self.pairs = 0  # leaf pairs that were scored

    def wants(self, second: bool, node: list) -> tuple[float, float]:
        """Scores that rows of an anchor node still want: from, to."""
        lo, hi = node[3], node[4]
        if not second:
            return float(self.near.score[lo:hi, -1].min()), math.inf
        least, most = self.window[0][lo:hi], self.window[1][lo:hi]
        if not np.isfinite(most).any():
            return math.inf, -math.inf
        least = np.maximum(least, self.far.score[lo * self.positives : hi * self.positives, -1].reshape(hi - lo, self.positives))
        return float(least.min()), float(most.max())

    def start_negatives(self) -> None:
        score = self.near.score  # -inf where an anchor has fewer positives
        with np.errstate(invalid="ignore"):
            self.window = np.where(score > -np.inf, np.ceil(self.low * score / 100), np.inf), np.where(score > -np.inf, np.floor(self.high * score / 100), -np.inf)

    def can_help(self, second: bool, a: list, b: list) -> bool:
        if not second and (a[5] > b[6] or b[5] > a[6]):
            return False
        if second and a[5] == a[6] == b[5] == b[6]:
            return False
        least, most = interval(a, b)
        low, high = self.wants(second, a)
        return most >= low and least <= high

    def walk(self, chunk: Tree, second: bool) -> None:
        mine, theirs = self.anchors.nodes, chunk.nodes
        stack = [(0, 0)]
        while stack:
            i, j = stack.pop()
            a, b = mine[i], theirs[j]
            if not self.can_help(second, a, b):
                continue
            if a[7] < 0 and b[7] < 0:
                self._score(chunk, a, b, second)
                continue
            if b[7] < 0 or (a[7] >= 0 and a[4] - a[3] > b[4] - b[3]):
                next_ = [(a[7], j), (a[8], j)]
            else:
                next_ = [(i, b[7]), (i, b[8])]
            next_.sort(key=lambda x: interval(mine[x[0]], theirs[x[1]])[1])  # the more promising is walked first
            stack += next_

    def _score(self, chunk: Tree, a: list, b: list, second: bool) -> None:
        self.pairs += 1
        rows, cols = slice(a[3], a[4]), slice(b[3], b[4])
        x, y = self.anchors.vectors[rows], chunk.vectors[cols]
        exact = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[1] < 2**53
        score = (x @ y.T).astype(np.longdouble) if exact else x.astype(np.longdouble) @ y.astype(np.longdouble).T
        same = self.anchors.labels[rows, None] == chunk.labels[None, cols]
        ids, number = chunk.ids[cols], np.arange(a[3], a[4])
        if not second:
            other = self.anchors.ids[rows, None] != ids[None, :]
            self.near.offer(number, np.where(same & other, score, -np.inf), ids)
            return
        for p in range(self.positives):
            fits = ~same & (score >= self.window[0][rows, p, None]) & (score <= self.window[1][rows, p, None])
            if fits.any():
                self.far.offer(number * self.positives + p, np.where(fits, score, -np.inf), ids)

    def found(self) -> dict[str, np.ndarray]:
        shape = (*self.near.score.shape, self.far.score.shape[1])
        negative, score = self.far.id.reshape(shape), self.far.score.reshape(shape)
        at = np.nonzero(score > -np.inf)
        return {
            "anchor_id": self.anchors.ids[at[0]], "positive_id": self.near.id[at[0], at[1]], "rank": (at[2] + 1).astype(np.int32), "negative_id": negative[at],
            "positive_score": self.near.score[at[0], at[1]].astype(np.int64), "negative_score": score[at].astype(np.int64),
        }


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of doubles, shorter ones filled up with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(n.cumsum() - n, n)] = flat
    return out


def whole_numbers(rows: DataFrame, id_col: str, label_col: str | Column, vector_col: str, scale: float) -> DataFrame:
    """(id, label, vector): components times ``scale``, rounded down. Rows without an id, label or vector, or with
    a component that is null, not finite or beyond ``MOST``, go; of rows that share an id the least (label, vector) stays."""
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    x = F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.floor(v * scale).cast("double"))
    out = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("vector"), F.col(vector_col).cast("array<double>").alias("raw"))
    fine = F.forall("raw", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= MOST / abs(scale)))
    out = out.filter("id is not null and label is not null and raw is not null").filter(fine)
    return out.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")


def _grouped(rows: DataFrame, name: str, size: int) -> DataFrame:
    """``rows`` (with a cell) with the number of a group of some ``size`` rows: a cell is cut by a hash of the id."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("n"))  # at most MOST_CELLS rows
    return rows.join(F.broadcast(counts), "cell").withColumn(name, F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("id"), "n"))


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@lru_cache(maxsize=24)
def _chunk(path: str, chunk: int, width: int) -> Tree:
    """The tree of one stored chunk; a worker keeps a few."""
    from pyarrow import dataset

    store, place = _store(path)
    table = dataset.dataset(f"{place}/chunk={chunk}", filesystem=store, format="parquet").to_table(columns=["id", "label", "vector"])
    return Tree(table.column("id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("vector"), width))


def _outlines(path: str, width: int) -> Iterator[tuple[int, list]]:
    """(chunk, its root node) of all chunks."""
    from pyarrow import dataset

    store, place = _store(path)
    for b in dataset.dataset(place, filesystem=store, format="parquet").to_batches(batch_size=OUTLINES):
        centre = _matrix(b.column("centre"), width)
        for i, (chunk, radius, least, most) in enumerate(zip(*(b.column(c).to_pylist() for c in ("chunk", "radius", "least", "most")))):
            yield chunk, [centre[i], radius, float(np.linalg.norm(centre[i])), 0, 0, least, most, -1, -1]


def mine(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, chunk_rows: int = CHUNK_ROWS, group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score for an anchor is the inner product of both vectors in whole numbers. The positives of an anchor (rows
    where ``anchors`` over ``id`` holds) are its first ``positives`` other rows of its label, the negatives of each positive
    the first ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score;
    higher scores come first, of ties the least id. What rows take part is in ``whole_numbers``; vectors shorter than
    the longest count as filled up with zeros. No rows, no anchors or nothing in a window give no rows; other columns may have any names.
    """
    spark = rows.sparkSession
    taking = written(whole_numbers(rows, id_col, label_col, vector_col, scale), "vectors")
    total, width = taking.agg(F.count("*"), F.max(F.size("vector"))).first()
    width = width or 0
    spot = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    some = taking if total <= SAMPLE else taking.filter(spot < int(SAMPLE / total * 1_000_003) + 1)
    sample = np.zeros((0, width))
    if total and width:
        sample = _matrix(pa.array([r.vector for r in some.orderBy(spot, "id").limit(SAMPLE).collect()], pa.list_(pa.float64())), width)
    cells = Cells(sample, min(MOST_CELLS, max(8, -(-total // chunk_rows))))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {c: b.column(c) for c in ("id", "label", "vector")} | {"cell": cells.of(_matrix(b.column("vector"), width))}

    dealt_out = written(map_arrow(taking, {"id": "long", "label": "long", "vector": "array<double>", "cell": "long"}, dealt), "cells")
    chunks = _grouped(dealt_out, "chunk", chunk_rows)
    chunk_path, outline_path = new_path(spark, "chunks"), new_path(spark, "outlines")
    chunks.select("chunk", "id", "label", "vector").repartition("chunk").write.partitionBy("chunk").parquet(chunk_path)

    def outlined(table: pa.Table) -> pa.Table:
        x, label = _matrix(table.column("vector"), width), table.column("label").to_numpy()
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9)
        return pa.table({"chunk": [table.column("chunk")[0].as_py()], "centre": pa.array([centre], pa.list_(pa.float64())), "radius": [radius], "least": [label.min()], "most": [label.max()]})

    chunks.select("chunk", "label", "vector").groupBy("chunk").applyInArrow(outlined, "chunk long, centre array<double>, radius double, least long, most long").write.parquet(outline_path)
    groups = _grouped(dealt_out.filter(anchors), "part", group_anchors)

    def searched(table: pa.Table) -> pa.Table:
        mine_ = Tree(table.column("id").to_numpy(), table.column("label").to_numpy(), _matrix(table.column("vector"), width), ANCHOR_LEAF)
        search = Search(mine_, positives, negatives, low, high)
        for second in (False, True):
            if second:
                search.start_negatives()
            held: list[tuple[int, list]] = []
            for outline in _outlines(outline_path, width):
                held.append(outline)
                if len(held) == OUTLINES:
                    _through(search, held, chunk_path, width, second)
                    held = []
            _through(search, held, chunk_path, width, second)
        return pa.table(search.found())

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number of its own, so that small groups are not put into one task
    found = groups.select("part", "id", "label", "vector").repartition(parts, "part").groupBy("part").applyInArrow(searched, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = written(found, "negatives")
    discard(taking, dealt_out, chunk_path, outline_path)
    return out


def _through(search: Search, outlines: list[tuple[int, list]], path: str, width: int, second: bool) -> None:
    """The most promising chunks first; one whose outline holds nothing wanted is not read."""
    root = search.anchors.nodes[0]
    for chunk, outline in sorted(outlines, key=lambda x: -interval(root, x[1])[1]):
        if search.can_help(second, root, outline):
            search.walk(_chunk(path, chunk, width), second)
