"""Newton boosting of trees on gradient histograms, for a logistic loss.

Values are put into bins once and written. For each level of a tree one pass over the rows sums gradients and hessians by
(node, feature, bin) in the tasks; Spark adds the sums up, and the driver, which never sees a row, finds the splits of
that level. Its tables are bounded by the parameters: open nodes x features x bins. Only the smaller child of a split is summed, its
sibling is the rest of the parent. Gradients are whole multiples of 1 / ``UNIT``, so that sums do not depend on how rows are dealt out
and, with the same bins and without sampled rows, the same rows give the same model on any cluster.

Leaves have L1 and L2 terms; missing values take the direction of greater gain at each split; a category feature is
split into one level and the rest, or, with more than ``one_hot`` levels, by levels in the order of their gradient.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType, StructField, StructType

from skyledger.sources.scratch import discard, written

UNIT = 1 << 26
#: Least gain of a split.
LEAST_GAIN = 1e-6


@dataclass
class Tree:
    """Nodes in the order they were made, the root first. ``left`` is -1 in leaves, ``bin`` the last bin that goes left
    (levels that go left are in ``levels``), ``value`` a leaf's step, ``hessian`` and ``rows`` what reached the node in training."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    levels: list[list[int] | None] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    hessian: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    def add(self, hessian: float, rows: int) -> int:
        for name, x in (("feature", -1), ("bin", -1), ("levels", None), ("missing_left", False), ("left", -1), ("right", -1), ("value", 0.0), ("gain", 0.0), ("hessian", hessian), ("rows", rows)):
            getattr(self, name).append(x)
        return len(self.left) - 1

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        """Which rows of binned ``x`` (0: missing) go left at an inner node."""
        b = x[:, self.feature[node]]
        low = np.isin(b - 1, self.levels[node]) if self.levels[node] is not None else b - 1 <= self.bin[node]
        return np.where(b == 0, self.missing_left[node], low)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        out, stack = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.left[node] < 0 or not len(rows):
                out[rows] = node
                continue
            low = self.goes_left(node, x[rows])
            stack += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf(x)]


@dataclass
class Boosted:
    """A fitted ensemble and how values are put into bins. ``edges`` are the upper bounds of the bins of numbers."""

    numeric: list[str]
    categorical: list[str]
    edges: list[list[float]]
    levels: dict[str, list[str]]
    base: float
    trees: list[Tree]

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.predict(x)
        return out

    def importances(self, kind: str = "gain") -> dict[str, float]:
        """Of each feature that splits: the mean gain of its splits, their ``total_gain``, or their number, the ``weight``."""
        total, n = dict.fromkeys(self.features, 0.0), dict.fromkeys(self.features, 0)
        for tree in self.trees:
            for node, f in enumerate(tree.feature):
                if f >= 0:
                    total[self.features[f]] += tree.gain[node]
                    n[self.features[f]] += 1
        used = [f for f in self.features if n[f]]
        return {f: {"gain": total[f] / n[f], "total_gain": total[f], "weight": float(n[f])}[kind] for f in used}

    def as_dict(self) -> dict:
        """What JSON can hold."""
        return {**{k: v for k, v in vars(self).items() if k != "trees"}, "trees": [asdict(t) for t in self.trees]}

    @classmethod
    def of_dict(cls, kept: dict) -> Boosted:
        return cls(**{k: v for k, v in kept.items() if k != "trees"}, trees=[Tree(**t) for t in kept["trees"]])


@dataclass(frozen=True)
class Settings:
    rounds: int = 50
    depth: int = 8
    rate: float = 0.05
    min_hessian: float = 20.0
    alpha: float = 0.05
    lambda_: float = 5.0
    one_hot: int = 16
    subsample: float = 0.85
    columns: float = 0.85
    seed: int = 42


def bin_edges(rows: DataFrame, numeric: Sequence[str], bins: int, accuracy: int = 100_000) -> list[list[float]]:
    """Upper bounds of at most ``bins`` bins of each column at about equal numbers of rows, one pass; the last bin has no
    bound. Null, NaN and infinite values count for none. Bounds are values of the table, within 1 / ``accuracy`` of their rank."""
    if not numeric:
        return []
    at = [(i + 1) / bins for i in range(bins - 1)]
    known = [F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double")) for c in numeric]
    row = rows.agg(*(F.percentile_approx(x, at, accuracy).alias(f"e{i}") for i, x in enumerate(known)), *(F.max(x).alias(f"m{i}") for i, x in enumerate(known))).first()
    return [sorted({float(v) for v in row[f"e{i}"] or [] if v < row[f"m{i}"]}) for i in range(len(numeric))]


def bin_rules(categorical: Sequence[str], edges: Sequence[Sequence[float]], levels: dict[str, list[str]]) -> tuple[list[np.ndarray], list[dict[str, int]]]:
    """What ``to_bins`` needs: the bounds of each number and the code of each level."""
    return [np.array(e, np.float64) for e in edges], [{v: i + 1 for i, v in enumerate(levels[c])} for c in categorical]


def to_bins(numbers: Sequence[pa.Array], words: Sequence[pa.Array], bounds: Sequence[np.ndarray], codes: Sequence[dict[str, int]]) -> np.ndarray:
    """Rows x features: 0 for a missing number or an unknown level, else the bin from 1 on. A bin ends with its bound."""
    x = np.zeros((len(numbers[0] if numbers else words[0]), len(bounds) + len(codes)), np.int16)
    for i, (column, e) in enumerate(zip(numbers, bounds)):
        v = column.to_numpy(zero_copy_only=False).astype(np.float64)  # null is NaN
        x[:, i] = np.where(np.isnan(v), 0, np.searchsorted(e, v, side="left") + 1)
    for i, (column, known) in enumerate(zip(words, codes), len(bounds)):
        coded = column.dictionary_encode()
        of = np.array([known.get(v, 0) for v in coded.dictionary.to_pylist()] + [0], np.int16)
        x[:, i] = of[coded.indices.fill_null(len(of) - 1).to_numpy(zero_copy_only=False)]
    return x


def binned(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], edges: Sequence[Sequence[float]], levels: dict[str, list[str]], *keep: str) -> DataFrame:
    """``keep`` and x, an array<short> of ``to_bins``."""
    rules, features = bin_rules(categorical, edges, levels), len(edges) + len(categorical)
    names = [*(f"__n{i}" for i in range(len(edges))), *(f"__c{i}" for i in range(len(categorical)))]
    made = rows.select(*keep, *(F.col(c).cast("double").alias(k) for c, k in zip(numeric, names)), *(F.col(c).cast("string").alias(k) for c, k in zip(categorical, names[len(edges) :])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [b.column(k) for k in names]
            flat = to_bins(values[: len(edges)], values[len(edges) :], *rules).ravel() if names else np.zeros(0, np.int16)
            lists = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * features, pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), lists], names=[*keep, "x"])

    return made.mapInArrow(run, StructType([*(made.schema[k] for k in keep), StructField("x", ArrayType(ShortType()))]))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _gradients(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - y) * UNIT).astype(np.int64), np.maximum(np.rint(p * (1 - p) * UNIT).astype(np.int64), 1)


def _sampled(row: np.ndarray, share: float, seed: int, number: int) -> np.ndarray:
    """Which rows a tree is fitted on, by a hash of their number."""
    h = row.astype(np.uint64) + np.uint64((seed * 1_000_003 + number) * 0x9E3779B97F4A7C15 % (1 << 64))
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (h ^ h >> np.uint64(31)) < np.uint64(min(share, 1 - 2**-53) * 2.0**64)


class _Fit:
    """What the rounds of one fit share."""

    def __init__(self, settings: Settings, sizes: list[int], numbers: int, base: float) -> None:
        self.settings, self.sizes, self.numbers, self.base = settings, sizes, numbers, base
        self.width = max([1, *sizes]) + 1  # bins of the widest feature, and missing

    def sums(self, table: DataFrame, before: list[Tree], tree: Tree, number: int, slots: dict[int, int], columns: np.ndarray) -> np.ndarray:
        """(slots, columns, width, 3): gradients, hessians and rows of the nodes in ``slots``."""
        s, width, features, share = self.settings, self.width, len(self.sizes), self.settings.subsample
        shape = (len(slots), len(columns), width)
        to_slot = np.full(len(tree.left), -1)
        for node, slot in slots.items():
            to_slot[node] = slot
        offset = (np.arange(len(columns)) * width)[None, :]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, int(np.prod(shape))), np.int64)
            for b in batches:
                x, y = matrix(b.column("x"), features), b.column("y").to_numpy()
                margin = b.column("margin").to_numpy().copy()
                for t in before:
                    margin += t.predict(x)
                slot = to_slot[tree.leaf(x)]
                use = slot >= 0
                if share < 1:
                    use &= _sampled(b.column("row").to_numpy(), share, s.seed, number)
                if not use.any():
                    continue
                g, h = _gradients(margin[use], y[use])
                key = (slot[use, None] * (len(columns) * width) + offset + x[use][:, columns]).ravel()
                n = len(columns)
                for i, v in enumerate((g, h, np.ones(len(g)))):  # whole numbers, exact in doubles up to 2^53
                    total[i] += np.rint(np.bincount(key, np.repeat(v, n), total.shape[1])).astype(np.int64)
            at = np.flatnonzero(total[2])
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(v[at]) for v in total)], names=["key", "g", "h", "n"])

        found = table.mapInArrow(run, "key long, g long, h long, n long").groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
        out = np.zeros((int(np.prod(shape)), 3), np.int64)
        for i, c in enumerate("ghn"):
            out[found.column("key").to_numpy(), i] = found.column(c).to_numpy()
        return out.reshape(*shape, 3)

    def _soft(self, g: np.ndarray) -> np.ndarray:
        return np.sign(g) * np.maximum(np.abs(g) - self.settings.alpha, 0)

    def _worth(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return self._soft(g) ** 2 / np.maximum(h + self.settings.lambda_, 1e-12)

    def best_split(self, sums: np.ndarray, columns: np.ndarray) -> tuple | None:
        """(gain, feature, bin, levels, missing_left) of one node, from its (columns, width, 3) sums. Of equal gains the first feature,
        then the first place, then missing to the right."""
        best = None
        for c, f in enumerate(columns.tolist()):  # lambda may be 0: empty sides are left out below
            g, h, n = (sums[c, : self.sizes[f] + 1, i] / (UNIT if i < 2 else 1) for i in range(3))
            if n[1:].sum() == 0:
                continue
            total = g.sum(), h.sum()
            if f < self.numbers:
                order = np.arange(1, len(g))
                gl, hl, nl = g[order].cumsum(), h[order].cumsum(), n[order].cumsum()
            else:
                present = np.flatnonzero(n[1:]) + 1
                if self.sizes[f] > self.settings.one_hot:
                    order = present[np.lexsort((present, g[present] / np.maximum(h[present] + self.settings.lambda_, 1e-12)))]
                    gl, hl, nl = g[order].cumsum(), h[order].cumsum(), n[order].cumsum()
                else:
                    order = present
                    gl, hl, nl = g[order], h[order], n[order]
            gl, hl, nl = (np.stack((v, v + v0), axis=1) for v, v0 in ((gl, g[0]), (hl, h[0]), (nl, n[0])))
            gr, hr, nr = total[0] - gl, total[1] - hl, n.sum() - nl
            gain = self._worth(gl, hl) + self._worth(gr, hr) - self._worth(np.array(total[0]), np.array(total[1]))
            gain[(hl < self.settings.min_hessian) | (hr < self.settings.min_hessian) | (nl == 0) | (nr == 0)] = -np.inf
            at, left = np.unravel_index(gain.argmax(), gain.shape)
            if gain[at, left] > max(LEAST_GAIN, best[0] if best else LEAST_GAIN):
                levels = None
                if f >= self.numbers:
                    levels = sorted((order[: at + 1] if self.sizes[f] > self.settings.one_hot else order[at : at + 1]) - 1)
                best = (float(gain[at, left]), f, int(at) if levels is None else -1, None if levels is None else [int(v) for v in levels], bool(left))
        return best

    def grow(self, table: DataFrame, before: list[Tree], number: int) -> Tree:
        s = self.settings
        rng = np.random.default_rng([s.seed, number])
        n = max(1, round(s.columns * len(self.sizes)))
        columns = np.sort(rng.choice(len(self.sizes), n, replace=False)) if n < len(self.sizes) else np.arange(n)
        tree = Tree()
        tree.add(0.0, 0)
        sums = {0: self.sums(table, before, tree, number, {0: 0}, columns)[0]}
        tree.hessian[0], tree.rows[0] = float(sums[0][0, :, 1].sum() / UNIT), int(sums[0][0, :, 2].sum())
        for level in range(s.depth + 1):
            wanted, rest = {}, {}
            for node, own in sums.items():
                split = self.best_split(own, columns) if level < s.depth else None
                g, h = own[0, :, 0].sum() / UNIT, own[0, :, 1].sum() / UNIT
                if split is None:
                    tree.value[node] = float(-s.rate * self._soft(np.array(g)) / (h + s.lambda_))
                    continue
                gain, f, at, levels, missing_left = split
                mine = own[np.flatnonzero(columns == f)[0]]
                low = np.zeros(self.width, bool)
                low[[v + 1 for v in levels] if levels is not None else slice(1, at + 2)] = True
                low[0] = missing_left
                if levels is not None:  # a level that no row had here goes where missing values go
                    low[1:] |= (mine[1:, 2] == 0) & missing_left
                    levels = [int(v) for v in np.flatnonzero(low[1 : self.sizes[f] + 1])]
                children = []
                for side in (low, ~low):
                    children.append(tree.add(float(mine[side, 1].sum() / UNIT), int(mine[side, 2].sum())))
                tree.feature[node], tree.bin[node], tree.levels[node], tree.missing_left[node], tree.gain[node] = f, at, levels, missing_left, gain
                tree.left[node], tree.right[node] = children
                small = min(children, key=lambda c: tree.rows[c])
                wanted[small] = len(wanted)
                rest[children[0] if small == children[1] else children[1]] = (small, own)
            if not wanted:
                break
            if level + 1 == s.depth:  # leaves need their sums of gradients only, which any one column has
                one = self.sums(table, before, tree, number, wanted, columns[:1])
                sums = {node: one[slot] for node, slot in wanted.items()}
                sums |= {node: own[:1] - sums[small] for node, (small, own) in rest.items()}
            else:
                made = self.sums(table, before, tree, number, wanted, columns)
                sums = {node: made[slot] for node, slot in wanted.items()}
                sums |= {node: own - sums[small] for node, (small, own) in rest.items()}
            sums = dict(sorted(sums.items()))
        return tree


def with_margin(table: DataFrame, trees: list[Tree], features: int) -> DataFrame:
    """``table`` (x, margin and others) with the steps of ``trees`` added to margin."""
    names = table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, margin = matrix(b.column("x"), features), b.column("margin").to_numpy().copy()
            for t in trees:
                margin += t.predict(x)
            yield pa.RecordBatch.from_arrays([pa.array(margin) if c == "margin" else b.column(c) for c in names], names=names)

    return table.mapInArrow(run, table.schema)


def fit(rows: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], levels: dict[str, list[str]], edges: Sequence[Sequence[float]], settings: Settings, base: float | None = None,
        validation: DataFrame | None = None, patience: int = 100, precision: Callable[[DataFrame], float] | None = None, block: int = 10) -> tuple[Boosted, list[float]]:
    """The ensemble, and ``precision`` (of a table of y and margin) after each round on ``validation``.

    Rounds end ``patience`` rounds after the first of greatest precision; no later round is fitted, and the trees up to that one
    are kept. Without validation all rounds are fitted. ``base`` is the margin before the first tree, by default the log odds
    of the target. Rows without a target take no part. Margins are written every ``block`` rounds, so that a pass adds
    the steps of at most that many trees.
    """
    made = binned(rows.withColumns({"__y": F.col(target).cast("double"), "__row": F.monotonically_increasing_id()}).filter("__y is not null"), numeric, categorical, edges, levels, "__y", "__row")
    table = written(made.select(F.col("__row").alias("row"), F.col("__y").alias("y"), "x", F.lit(0.0).alias("margin")), "binned")
    n, mean = table.agg(F.count("*"), F.avg("y")).first()
    if base is None:
        base = float(np.log(mean / (1 - mean))) if n and 0 < mean < 1 else 0.0
    sizes = [len(e) + 1 for e in edges] + [len(levels[c]) for c in categorical]
    model = Boosted(list(numeric), list(categorical), [list(map(float, e)) for e in edges], dict(levels), base, [])
    values: list[float] = []
    if not n or not sizes:
        return model, values
    work = _Fit(settings, sizes, len(numeric), base)
    table_now, held = table.withColumn("margin", F.lit(base)), [table]
    later = None
    if validation is not None:
        seen = binned(validation.withColumn("__y", F.col(target).cast("double")).filter("__y is not null"), numeric, categorical, edges, levels, "__y")
        later = written(seen.select(F.col("__y").alias("y"), "x", F.lit(base).alias("margin")), "validation")
    fresh: list[Tree] = []
    for number in range(settings.rounds):
        tree = work.grow(table_now, fresh, number)
        model.trees.append(tree)
        fresh.append(tree)
        if later is not None:
            values.append(precision(with_margin(later, fresh, len(sizes)).select("y", "margin")))
            best = int(np.argmax(values))
            if number - best >= patience:
                break
        if len(fresh) == block:
            table_now, old = written(with_margin(table_now, fresh, len(sizes)), f"margin{number}"), held
            held = [table_now]
            if later is not None:
                later, last = written(with_margin(later, fresh, len(sizes)), f"later{number}"), later
                old = [*old, last]
            discard(*old)
            fresh = []
    if values:
        model.trees = model.trees[: int(np.argmax(values)) + 1]
    discard(*held, *([later] if later is not None else []))
    return model, values
