"""Gradient boosting by histograms: leaf-wise trees (M9), and one tree a class a round on softmax gradients (M8, M9).

Features are cut into at most ``BINS`` bins once, and rows are kept in blocks, feature by feature. A pass adds
up, for every open node of every class, rows, gradients and second derivatives by (feature, bin): a histogram
inside each task, whose pieces are then added up as arrays. The driver sees (nodes x features x bins) sums, never
a row. Sums are of whole numbers (gradients in steps of 2^-26 of the largest), so the model is the same under any
partitioning and after lost executors. Only the smaller of two siblings is counted, the other is the rest of the
parent. Scores move on and gradients are found once a round, and kept until the next.

A node's best split depends on its own rows alone, so the levels down to ``max_depth`` are counted first, and
best-first growth then accepts splits by gain until the tree has its leaves: the tree that growing one leaf
at a time gives, with as many passes as levels.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import written

Batches = Iterator[pa.RecordBatch]

BINS = 255
BIN_ERROR = 1e-3
STEPS = float(1 << 26)
ROUNDS_PER_TABLE = 8
CELLS_PER_TASK = 1 << 13
BLOCK_ROWS = 1 << 16
BLOCK_BYTES = 1 << 22
BLOCKS_PER_PART = 16
DIRECT_BYTES = 1 << 25


@dataclass(frozen=True)
class Boosting:
    """Settings; the defaults are those of leaf-wise boosters. ``newton_gain`` weighs splits by second
    derivatives, otherwise by rows (least squares on the gradients)."""

    n_estimators: int = 50
    max_depth: int = 6
    learning_rate: float = 0.1
    num_leaves: int = 31
    min_child_samples: int = 20
    min_child_weight: float = 1e-3
    newton_gain: bool = True


@dataclass
class Tree:
    """Nodes by number; a leaf has feature -1. ``bins`` are thresholds among bins: a row with at most that goes left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bins: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        low = len(self.feature)
        self.feature[node], self.bins[node], self.left[node], self.right[node] = feature, cut, low, low + 1
        for _ in range(2):
            for column, v in ((self.feature, -1), (self.bins, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
                column.append(v)
        return low, low + 1

    def leaves(self) -> list[int]:
        return [node for node, f in enumerate(self.feature) if f < 0]

    def rows(self, bins: np.ndarray, wanted: list[int]) -> list[tuple[int, np.ndarray | None]]:
        """The wanted leaves and the rows in each, all rows as None; ``bins`` has a line a feature."""
        asked, above = set(wanted), set(wanted)
        for node in reversed(range(len(self.feature))):
            if self.feature[node] >= 0 and (self.left[node] in above or self.right[node] in above):
                above.add(node)
        open_: list[tuple[int, np.ndarray | None]] = [(0, None)]
        found = []
        while open_:
            node, rows = open_.pop()
            if node in asked:
                found.append((node, rows))
            elif node in above:
                cells = bins[self.feature[node]]
                low = (cells if rows is None else cells[rows]) <= self.bins[node]
                for child, side in ((self.left[node], low), (self.right[node], ~low)):
                    if child in above:
                        kept = np.flatnonzero(side)
                        open_.append((child, kept if rows is None else rows[kept]))
        return found


@dataclass(frozen=True)
class Loss:
    """``kind`` is squared, logistic or softmax; weights are at most ``heaviest``, gradients at most ``steepest``.
    ``even`` says that all second derivatives are the largest, so that they need not be kept."""

    kind: str
    n_scores: int
    heaviest: float
    steepest: float
    even: bool = False

    def slopes(self, scores: np.ndarray, y: np.ndarray, w: np.ndarray | float, k: int, newton: bool) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and second derivative of one class's score, in whole steps."""
        if self.kind == "squared":
            g, h = scores[:, 0] - y, np.ones(len(y))
        elif self.kind == "logistic":
            p = 1 / (1 + np.exp(-scores[:, 0]))
            g, h = p - y, p * (1 - p)
        else:
            e = np.exp(scores - scores.max(axis=1, keepdims=True))
            p = e[:, k] / e.sum(axis=1)
            g = p - (y == k)
            factor = self.n_scores / (self.n_scores - 1)
            h = factor * (p * (1 - p) if newton else np.abs(g) * (1 - np.abs(g)))
        w = w / self.heaviest
        return np.rint(g * w * (STEPS / self.steepest)).astype(np.int64), np.rint(h * w * STEPS).astype(np.int64)


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Binary values of ``width`` numbers each as rows, without a Python object a row."""
    column = column.cast(pa.binary())
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros((0, width), dtype)
    first = int(np.frombuffer(ends, np.int32)[column.offset])
    return np.frombuffer(data, dtype, len(column) * width, first).reshape(-1, width)


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows as binary values, the other way round."""
    size = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _block(batch: pa.RecordBatch, name: str, i: int, n: int, dtypes: tuple[type, ...]) -> np.ndarray:
    """The numbers of one block; their size tells which of the types was kept for ``n`` numbers."""
    column = batch.column(name).slice(i, 1)
    size = pc.binary_length(column)[0].as_py()
    dtype = next(t for t in dtypes if np.dtype(t).itemsize * n == size)
    return _matrix(column, dtype, n)[0]


def _bins(batch: pa.RecordBatch, i: int, n_features: int) -> np.ndarray:
    size = pc.binary_length(batch.column("bins"))[i].as_py()
    return _block(batch, "bins", i, size, (np.uint8,)).reshape(n_features, -1)


def _narrow(values: np.ndarray, dtype: type) -> np.ndarray:
    """As the narrow type where that changes no number."""
    with np.errstate(invalid="ignore"):
        small = values.astype(dtype)
    return small if (small == values).all() else values


def _one(*columns: np.ndarray) -> list[pa.Array]:
    return [_packed(np.ascontiguousarray(c).reshape(1, -1)) for c in columns]


TABLE = "bins binary, y binary, w binary, scores binary"
ROUND = f"{TABLE}, slopes binary"


def _names(shape: str) -> list[str]:
    return [c.split()[0] for c in shape.split(", ")]


def _block_rows(n_features: int, n_scores: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (n_features + 16 * n_scores)))


def _binned(edges: list[list[float]], start: list[float], weighted: bool) -> Callable[[Batches], Batches]:
    """Blocks of rows: bins by feature, label, weight (nothing if all weigh the same) and first scores."""

    def block(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        bins, y, w = (np.concatenate(c, axis=-1) for c in zip(*parts))
        scores = np.tile(np.array(start, np.float64), (len(y), 1))
        return pa.record_batch(_one(bins, _narrow(y, np.uint8), w if weighted else w[:0], scores), names=_names(TABLE))

    def run(batches: Batches) -> Batches:
        most, held, parts = _block_rows(len(edges), len(start)), 0, []
        for b in batches:
            values = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(edges))
            bins = np.stack([np.searchsorted(e, values[:, f], side="left") for f, e in enumerate(edges)]).astype(np.uint8)
            y, w = b.column(1).to_numpy(), b.column(2).to_numpy()
            at = 0
            while at < len(y):
                end = min(len(y), at + most - held)
                parts.append((bins[:, at:end], y[at:end], w[at:end]))
                held, at = held + end - at, end
                if held == most:
                    yield block(parts)
                    held, parts = 0, []
        if held:
            yield block(parts)

    return run


def _advanced(grown: list[tuple[int, Tree]], loss: Loss, n_features: int, newton: bool) -> Callable[[Batches], Batches]:
    """Scores after the trees of a round, and the gradients and second derivatives there."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            for i in range(b.num_rows):
                bins = _bins(b, i, n_features)
                n = bins.shape[1]
                y = _block(b, "y", i, n, (np.uint8, np.float64))
                weighted = pc.binary_length(b.column("w"))[i].as_py() > 0
                w = _block(b, "w", i, n, (np.float64,)) if weighted else 1.0
                scores = _block(b, "scores", i, n * loss.n_scores, (np.float64,)).reshape(n, -1).copy()
                for k, tree in grown:
                    for node, rows in tree.rows(bins, tree.leaves()):
                        scores[slice(None) if rows is None else rows, k] += tree.value[node]
                slopes = np.stack([loss.slopes(scores, y, w, k, newton)[: 1 if loss.even else 2] for k in range(loss.n_scores)])
                same = [b.column(c).slice(i, 1) for c in ("bins", "y", "w")]
                yield pa.record_batch([*same, *_one(scores, _narrow(slopes, np.int32))], names=_names(ROUND))

    return run


def _histograms(open_: list[tuple[int, Tree, list[int]]], loss: Loss, n_features: int) -> Callable[[Batches], Batches]:
    """(slab, sums): the sums of a task of rows, gradients and second derivatives by class, node, feature and
    bin, in slabs of cells."""

    def run(batches: Batches) -> Batches:
        sums = np.zeros((3, sum(len(nodes) for _, _, nodes in open_), n_features, BINS + 1), np.int64)
        kept = 1 if loss.even else 2
        for b in batches:
            for i in range(b.num_rows):
                bins = _bins(b, i, n_features)
                n = bins.shape[1]
                slopes = _block(b, "slopes", i, n * kept * loss.n_scores, (np.int32, np.int64)).reshape(-1, kept, n)
                low = 0
                for k, tree, nodes in open_:
                    found = tree.rows(bins, nodes)
                    rows = None if found[0][1] is None else np.concatenate([r for _, r in found])
                    first = 0 if rows is None else np.repeat([nodes.index(node) * (BINS + 1) for node, _ in found], [len(r) for _, r in found])
                    # Whole numbers whose sums in a block stay below 2^53: sums of doubles are exact.
                    weights = [None, *((v if rows is None else v[rows]).astype(np.float64) for v in slopes[k])]
                    for f in range(n_features):
                        cells = first + (bins[f] if rows is None else bins[f][rows]).astype(np.int64)
                        for j, v in enumerate(weights):
                            total = np.bincount(cells, v, len(nodes) * (BINS + 1))
                            sums[j, low : low + len(nodes), f] += total.astype(np.int64).reshape(-1, BINS + 1)
                    low += len(nodes)
        if loss.even:
            sums[2] = sums[0] * int(STEPS)
        flat = sums.reshape(3, -1)
        for slab, at in enumerate(range(0, flat.shape[1], CELLS_PER_TASK)):
            part = flat[:, at : at + CELLS_PER_TASK]
            if part[0].any():
                yield pa.record_batch([pa.array([slab], pa.int32()), *_one(part)], names=["slab", "sums"])

    return run


def _added(batches: Batches) -> Batches:
    """The sums of each slab over all tasks."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for i, slab in enumerate(b.column("slab").to_pylist()):
            size = pc.binary_length(b.column("sums"))[i].as_py() // 8
            part = _block(b, "sums", i, size, (np.int64,))
            sums[slab] = sums[slab] + part if slab in sums else part.copy()
    for slab, part in sums.items():
        yield pa.record_batch([pa.array([slab], pa.int32()), *_one(part)], names=["slab", "sums"])


@dataclass
class _Node:
    number: int
    depth: int
    sums: np.ndarray  # of n, g, h
    histogram: np.ndarray | None = None  # (3, features, bins)
    best: tuple[float, int, int, np.ndarray] | None = None  # gain, feature, bin, sums to the left
    children: tuple[_Node, _Node] | None = None


def _best_split(node: _Node, s: Boosting, unit: float) -> tuple[float, int, int, np.ndarray] | None:
    """The split of highest gain, of equals the first by feature and bin."""
    left = np.cumsum(node.histogram, axis=2)[:, :, :-1]
    right = node.sums[:, None, None] - left
    mass = [(side[2] if s.newton_gain else side[0]).astype(np.float64) for side in (left, right)]
    fits = (left[0] >= s.min_child_samples) & (right[0] >= s.min_child_samples) & (left[0] > 0) & (right[0] > 0)
    if s.newton_gain:
        fits &= (left[2] >= s.min_child_weight * unit) & (right[2] >= s.min_child_weight * unit)
    fits &= (mass[0] > 0) & (mass[1] > 0)
    if not fits.any():
        return None
    gain = sum(np.where(fits, side[1].astype(np.float64) ** 2 / np.where(fits, m, 1.0), 0.0) for side, m in zip((left, right), mass))
    whole = float(node.sums[1]) ** 2 / float(node.sums[2] if s.newton_gain else node.sums[0])
    gain = np.where(fits, gain - whole, -np.inf)
    f, cut = np.unravel_index(int(np.argmax(gain)), gain.shape)
    best = float(gain[f, cut])
    return (best, int(f), int(cut), left[:, f, cut]) if best > 1e-12 * max(whole, 1.0) else None


class _Round:
    """The trees of one round, one a class, grown together."""

    def __init__(self, s: Boosting, loss: Loss, n_features: int, n_parts: int):
        self.s, self.loss, self.n_features, self.n_parts = s, loss, n_features, n_parts
        self.trees = [Tree() for _ in range(loss.n_scores)]
        self.roots: list[_Node] = []

    def grow(self, rows: DataFrame) -> list[Tree]:
        level: list[tuple[int, _Node]] = []
        for k, found in self._count(rows, [(k, [0]) for k in range(len(self.trees))]).items():
            node = _Node(0, 0, found[0][:, 0, :].sum(axis=1), found[0])
            self.roots.append(node)
            level.append((k, node))
        for depth in range(self.s.max_depth):
            below: list[tuple[int, _Node, _Node, _Node]] = []
            for k, node in level:
                node.best = _best_split(node, self.s, STEPS / self.loss.heaviest)
                if node.best:
                    _, f, cut, left = node.best
                    numbers = self.trees[k].split(node.number, f, cut)
                    node.children = _Node(numbers[0], depth + 1, left), _Node(numbers[1], depth + 1, node.sums - left)
                    small, large = sorted(node.children, key=lambda c: c.sums[0])
                    below.append((k, node, small, large))
            if not below or depth + 1 == self.s.max_depth:
                break
            asked = [(k, [small.number for j, _, small, _ in below if j == k]) for k in sorted({b[0] for b in below})]
            found = self._count(rows, asked)
            for k, node, small, large in below:
                small.histogram = found[k][small.number]
                large.histogram, node.histogram = node.histogram - small.histogram, None
            level = [(k, c) for k, _, small, large in below for c in (small, large)]
        return [self._chosen(k, root) for k, root in enumerate(self.roots)]

    def _count(self, rows: DataFrame, asked: list[tuple[int, list[int]]]) -> dict[int, dict[int, np.ndarray]]:
        open_ = [(k, self.trees[k], nodes) for k, nodes in asked]
        slabs = rows.select("bins", "slopes").mapInArrow(_histograms(open_, self.loss, self.n_features), "slab int, sums binary")
        slots = [(k, node) for k, nodes in asked for node in nodes]
        flat = np.zeros((3, len(slots) * self.n_features * (BINS + 1)), np.int64)
        # A task has added up its cells, so they go straight to as few tasks as hold them, or to the driver if
        # those of all tasks are small: a second step of a pass costs as much as a scan of a small table.
        if self.n_parts * flat.nbytes > DIRECT_BYTES:
            n_tasks = math.ceil(flat.shape[1] / CELLS_PER_TASK)
            slabs = slabs.repartition(n_tasks, "slab").mapInArrow(_added, "slab int, sums binary")
        found = slabs.toArrow()
        for slab, sums in zip(found.column("slab").to_pylist(), found.column("sums")):
            at = slab * CELLS_PER_TASK
            flat[:, at : at + CELLS_PER_TASK] += np.frombuffer(sums.as_buffer(), np.int64).reshape(3, -1)
        out: dict[int, dict[int, np.ndarray]] = {k: {} for k, _ in asked}
        for (k, node), h in zip(slots, np.moveaxis(flat.reshape(3, len(slots), self.n_features, BINS + 1), 1, 0)):
            out[k][node] = h
        return out

    def _chosen(self, k: int, root: _Node) -> Tree:
        """Best-first: of all leaves the one whose split gains most is split next, until there are enough."""
        tree, place = Tree(), {root.number: 0}
        leaves, heap, order = {root.number: root}, [], 0
        if root.best:
            heapq.heappush(heap, (-root.best[0], order, root.number, root))
        while heap and len(leaves) < self.s.num_leaves:
            _, _, number, node = heapq.heappop(heap)
            del leaves[number]
            for child, at in zip(node.children, tree.split(place[number], node.best[1], node.best[2])):
                place[child.number], leaves[child.number] = at, child
                if child.best:
                    order += 1
                    heapq.heappush(heap, (-child.best[0], order, child.number, child))
        for number, leaf in leaves.items():
            _, g, h = (float(v) for v in leaf.sums)
            tree.value[place[number]] = -self.s.learning_rate * g * self.loss.steepest / h if h > 0 else 0.0
        return tree


def _short(values: list[float]) -> list[float]:
    """Twelve digits: the order in which tasks end, which moves the last ones of a sum, leaves no trace."""
    return [float(f"{v:.12g}") for v in values]


def fit_boosted(rows: DataFrame, features: str, label: str, n_features: int, n_classes: int, s: Boosting, weight: str | None = None, **columns: str) -> BoostedTrees:
    """Fit on rows of a vector and a label: a number (``n_classes`` 0), or the index of a class."""
    w = F.col(weight) if weight else F.lit(1.0)
    given = rows.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"), w.cast("double").alias("w"))
    probs = [i / BINS for i in range(BINS)]
    wide = given.select(*[F.col("x")[f].alias(f"x{f}") for f in range(n_features)])
    edges = [sorted({float(v) for v in q}) for q in wide.approxQuantile(wide.columns, probs, BIN_ERROR)]
    if n_classes:
        masses = {r["y"]: r["m"] for r in given.groupBy("y").agg(F.sum("w").alias("m")).collect()}
        heaviest = given.agg(F.max("w")).first()[0]
        total = sum(masses.values())
        share = [min(max(masses.get(float(k), 0.0) / total, 1e-15), 1 - 1e-15) for k in range(n_classes)]
        start = _short([math.log(share[1] / share[0])] if n_classes == 2 else [math.log(p) for p in share])
        loss = Loss("logistic" if n_classes == 2 else "softmax", len(start), heaviest, 1.0)
    else:
        mean, heaviest, low, high = given.agg(F.sum(F.col("w") * F.col("y")) / F.sum("w"), F.max("w"), F.min("y"), F.max("y")).first()
        start = _short([mean])
        # Scores stay within the labels, so no residual is larger than their range.
        loss = Loss("squared", 1, heaviest, max(high - low, 1e-300), weight is None)
    n_scores = len(start)
    # Every pass runs over this table, so it is dealt out evenly and to all cores.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_parts = cores * max(1, math.ceil(given.count() / (cores * BLOCKS_PER_PART * _block_rows(n_features, n_scores))))
    table = written(given.repartition(n_parts).mapInArrow(_binned(edges, start, weight is not None), TABLE)).repartition(n_parts)
    done: list[tuple[int, Tree]] = []
    recent: list[tuple[int, Tree]] = []
    held: list[DataFrame] = []
    try:
        for i in range(s.n_estimators):
            held.append(table.mapInArrow(_advanced(recent, loss, n_features, s.newton_gain), ROUND).persist(StorageLevel.MEMORY_AND_DISK))
            recent = list(enumerate(_Round(s, loss, n_features, n_parts).grow(held[-1])))
            done += recent
            table = held[-1].select(*_names(TABLE))
            if (i + 1) % ROUNDS_PER_TABLE == 0 and i + 1 < s.n_estimators:
                table = written(table).repartition(n_parts)
            for old in held[:-1]:
                old.unpersist()
            held = held[-1:]
    finally:
        for old in held:
            old.unpersist()
    forest: dict[str, Any] = {"kind": loss.kind, "start": start, "n_features": n_features, "trees": []}
    for k, tree in done:
        cuts = [edges[f][b] if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.bins)]
        forest["trees"].append({"k": k, "nodes": [{"f": f, "t": t, "l": lo, "r": hi, "v": v} for f, t, lo, hi, v in zip(tree.feature, cuts, tree.left, tree.right, tree.value)]})
    return BoostedTrees(forest=json.dumps(forest), featuresCol=features, **columns)


def _constant(trees: list[list[dict]]) -> str:
    """Trees as SQL that the optimizer makes one constant, where parsed JSON would be parsed for every row.
    A leaf leads to itself, so a step looks a node up once and asks nothing about it."""

    def node(at: int, n: dict) -> str:
        f, low, high = (n["f"], n["l"], n["r"]) if n["f"] >= 0 else (0, at, at)
        return f"named_struct('f', {f}, 't', double('{n['t']!r}'), 'l', {low}, 'r', {high}, 'v', double('{n['v']!r}'))"

    return f"array({', '.join('array(' + ', '.join(node(at, n) for at, n in enumerate(t)) + ')' for t in trees)})"


class BoostedTrees(Transformer, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted booster: adds the prediction, and for classes the vector of their probabilities.

    The trees are a constant of the plan that rows walk through array lookups: no Python, any stream.
    """

    forest = Param(Params._dummy(), "forest", "the trees as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, forest: str | None = None, featuresCol: str = "features", predictionCol: str = "prediction", probabilityCol: str | None = None):
        super().__init__()
        self._setDefault(forest="", predictionCol="prediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def _model(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault("forest"))

    @property
    def featureImportances(self) -> Any:
        """The share of all splits that use a feature."""
        model = self._model
        counts = np.zeros(model["n_features"])
        for tree in model["trees"]:
            for node in tree["nodes"]:
                counts[node["f"]] += node["f"] >= 0
        return Vectors.dense(counts / max(counts.sum(), 1.0))

    def _scores(self, x: Column) -> Column:
        """One sum of leaf values a class. The array is bound to a variable, or every step would build it again."""
        return F.get(F.transform(F.array(x), self._sums), F.lit(0))

    def _sums(self, x: Column) -> Column:
        model = self._model

        def adding(deepest: int) -> Callable[[Column, Column], Column]:
            def add(total: Column, tree: Column) -> Column:
                def step(node: Column, _: Column) -> Column:
                    return F.get(tree, F.when(F.get(x, node["f"]) <= node["t"], node["l"]).otherwise(node["r"]))

                return total + F.aggregate(F.sequence(F.lit(1), F.lit(deepest)), F.get(tree, F.lit(0)), step)["v"]

            return add

        def depth(nodes: list[dict], at: int = 0) -> int:
            return 0 if nodes[at]["f"] < 0 else 1 + max(depth(nodes, nodes[at]["l"]), depth(nodes, nodes[at]["r"]))

        sums = []
        for k, first in enumerate(model["start"]):
            trees = [t["nodes"] for t in model["trees"] if t["k"] == k]
            deepest = max([depth(t) for t in trees], default=0)
            if not deepest:
                sums.append(F.lit(first + sum(t[0]["v"] for t in trees)))
                continue
            sums.append(F.aggregate(F.expr(_constant(trees)), F.lit(float(first)), adding(deepest)))
        return F.array(*sums)

    def _transform(self, df: DataFrame) -> DataFrame:
        kind, out = self._model["kind"], self.getOrDefault("predictionCol")
        held = df.withColumn("_scores", self._scores(vector_to_array(F.col(self.getOrDefault("featuresCol")))))
        s = F.col("_scores")
        if kind == "squared":
            return held.withColumn(out, s[0]).drop("_scores")
        if kind == "logistic":
            p = 1 / (1 + F.exp(-s[0]))
            shares = F.array(1 - p, p)
        else:
            raised = F.transform(s, lambda v: F.exp(v - F.array_max(s)))
            total = F.aggregate(raised, F.lit(0.0), lambda a, v: a + v)
            shares = F.transform(raised, lambda v: v / total)
        held = held.withColumn("_shares", shares)
        held = held.withColumn(out, (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double"))
        return held.withColumn(self.getOrDefault("probabilityCol"), array_to_vector(F.col("_shares"))).drop("_scores", "_shares")
