"""Least squares with a quadratic penalty for any number of classes and features (M2, M4).

One scan fits all classes: they share the products of the features and differ in the right-hand side only. Up
to ``GRAM_COLUMNS`` features those products are added up as one matrix and solved on the driver. Beyond that no
matrix of features by features exists anywhere: conjugate gradients, for all classes at once, need one scan a
step, which sends each task the directions (features x classes) and gets sums of the same size back.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM_COLUMNS = 1024
MAX_STEPS = 1000
TOLERANCE = 1e-11

Batches = Iterator[pa.RecordBatch]


def _cells(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of the stored cells of a batch of vectors, dense or sparse."""
    values, indices = vectors.field("values"), vectors.field("indices")
    lengths = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(vectors)), lengths)
    feature = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sparse = vectors.field("type").to_numpy(zero_copy_only=False) == 0
    feature[sparse[row]] = indices.flatten().to_numpy(zero_copy_only=False)
    return row, feature, values.flatten().to_numpy(zero_copy_only=False)


def _targets(y: np.ndarray, n_classes: int) -> np.ndarray:
    """One column a right-hand side: the number, or +1 / -1 for each class (for two classes the second)."""
    if not n_classes:
        return y[:, None]
    return np.where(y[:, None] == (np.array([1]) if n_classes == 2 else np.arange(n_classes)), 1.0, -1.0)


def _multiplied(width: int, n_classes: int, centre: np.ndarray, by: np.ndarray | None) -> Callable[[Batches], Batches]:
    """A task's sums of x times weighted outputs: of ``x by - centre``, or of the targets less their means."""
    sides = len(centre)

    def run(batches: Batches) -> Batches:
        sums = np.zeros((sides, width))
        total = np.zeros(sides)
        for b in batches:
            row, feature, value = _cells(b.column(0))
            w = b.column(2).to_numpy()
            if by is None:
                out = _targets(b.column(1).to_numpy(), n_classes)
            else:
                out = np.stack([np.bincount(row, value * by[feature, k], len(w)) for k in range(sides)], axis=1)
            out = (out - centre) * w[:, None]
            total += out.sum(axis=0)
            for k in range(sides):
                sums[k] += np.bincount(feature, value * out[row, k], width)
        flat = np.concatenate([sums.ravel(), total])
        used = np.flatnonzero(flat)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(flat[used], pa.float64())], names=["cell", "s"])

    return run


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """Sums of the products of every two elements of the array column ``v``: one scan, added up in a tree."""
    vectors = rows.select(array_to_vector("v").alias("v"))
    old_kind = MLUtils.convertVectorColumnsFromML(vectors, "v")
    return RowMatrix(old_kind, numCols=width).computeGramianMatrix().toArray()


class _Products:
    """Sums over the standardised features z = (x - mean) / spread without ever making a sparse row dense."""

    def __init__(self, rows: DataFrame, mean: np.ndarray, spread: np.ndarray, n_classes: int):
        self.rows, self.mean, self.spread, self.n_classes = rows, mean, spread, n_classes

    def _sum(self, centre: np.ndarray, by: np.ndarray | None) -> np.ndarray:
        width, sides = len(self.mean), len(centre)
        cells = self.rows.mapInArrow(_multiplied(width, self.n_classes, centre, by), "cell long, s double")
        found = cells.groupBy("cell").agg(F.sum("s").alias("s")).toArrow()
        flat = np.zeros(sides * width + sides)
        flat[found.column("cell").to_numpy()] = found.column("s").to_numpy()
        sums, total = flat[: sides * width].reshape(sides, width).T, flat[sides * width :]
        return (sums - self.mean[:, None] * total) / self.spread[:, None]

    def targets(self, means: np.ndarray) -> np.ndarray:
        return self._sum(means, None)

    def times(self, directions: np.ndarray) -> np.ndarray:
        by = directions / self.spread[:, None]
        return self._sum(self.mean @ by, by)


def _conjugate(products_of: _Products, right: np.ndarray, penalty: np.ndarray, mass: float) -> np.ndarray:
    """Solve (Z'WZ + penalty) g = right for all columns, preconditioned by the diagonal."""
    scale = 1 / (mass + penalty)[:, None]
    found, rest = np.zeros_like(right), right.copy()
    ready = scale * rest
    direction, size = ready.copy(), (rest * ready).sum(axis=0)
    goal = TOLERANCE**2 * size
    for _ in range(MAX_STEPS):
        open_ = np.flatnonzero(size > goal)
        if not len(open_):
            return found
        d = direction[:, open_]
        moved = products_of.times(d) + penalty[:, None] * d
        step = size[open_] / (d * moved).sum(axis=0)
        found[:, open_] += step * d
        rest[:, open_] -= step * moved
        ready = scale * rest
        new = (rest * ready).sum(axis=0)
        direction[:, open_] = ready[:, open_] + new[open_] / size[open_] * d
        size = np.where(size > goal, new, size)
    raise RuntimeError(f"The ridge did not settle in {MAX_STEPS} steps: scale the features or raise alpha")


def fit_ridge(rows: DataFrame, features: str, label: str, n_classes: int, alpha: float, weight: str | None = None, **columns: str) -> RidgeModel:
    """Minimise sum w (y - x b - c)^2 + alpha |b|^2 for a number (``n_classes`` 0) or for +1 / -1 of every class."""
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w")
    given = rows.select(F.col(features).alias("v"), F.col(label).cast("double").alias("y"), w)
    moments = given.agg(Summarizer.metrics("mean", "std").summary(F.col("v"), F.col("w")).alias("m"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")).first()
    mean, spread, mass = moments["m"]["mean"].toArray(), moments["m"]["std"].toArray(), moments["w"]
    spread = np.where((spread > 0) & np.isfinite(spread), spread, 1.0)
    if n_classes:
        held = {r["y"]: r["w"] for r in given.groupBy("y").agg(F.sum("w").alias("w")).collect()}
        means = np.array([2 * held.get(float(k), 0.0) / mass - 1 for k in ([1] if n_classes == 2 else range(n_classes))])
    else:
        means = np.array([moments["wy"] / mass])
    penalty = alpha / spread**2
    width, sides = len(mean), len(means)
    if width + sides <= GRAM_COLUMNS:
        x, y, root = vector_to_array(F.col("v")), F.col("y"), F.sqrt("w")
        z = F.transform(F.arrays_zip(x.alias("x"), F.lit(mean.tolist()).alias("m"), F.lit(spread.tolist()).alias("s")), lambda c: (c["x"] - c["m"]) / c["s"] * root)
        called = [1] if n_classes == 2 else range(n_classes)
        out = [F.when(y == k, 1.0).otherwise(-1.0) for k in called] if n_classes else [y]
        out = F.array(*[(t - float(m)) * root for t, m in zip(out, means)])
        sums = _gram(given.select(F.concat(z, out).alias("v")), width + sides)
        solved = np.linalg.lstsq(sums[:width, :width] + np.diag(penalty), sums[:width, width:], rcond=None)[0]
    else:
        unwrapped = given.select(F.unwrap_udt("v").alias("v"), "y", "w")
        z = _Products(unwrapped, mean, spread, n_classes)
        solved = _conjugate(z, z.targets(means), penalty, mass)
    slopes = (solved / spread[:, None]).T
    held = {"classes": n_classes, "slopes": slopes.tolist(), "intercepts": (means - slopes @ mean).tolist()}
    return RidgeModel(fitted=json.dumps(held), featuresCol=features, **columns)


class RidgeModel(Transformer, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the number, or the class of the largest output (for two classes: its sign)."""

    fitted = Param(Params._dummy(), "fitted", "slopes and intercepts as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, fitted: str | None = None, featuresCol: str = "features", predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(fitted="", predictionCol="prediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def model(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault("fitted"))

    @property
    def coefficientMatrix(self) -> DenseMatrix:
        slopes = np.array(self.model["slopes"])
        return DenseMatrix(*slopes.shape, slopes.ravel(order="F"))

    @property
    def interceptVector(self) -> DenseVector:
        return Vectors.dense(self.model["intercepts"])

    @property
    def coefficients(self) -> DenseVector:
        return Vectors.dense(self.model["slopes"][0])

    @property
    def intercept(self) -> float:
        return self.model["intercepts"][0]

    def _transform(self, df: DataFrame) -> DataFrame:
        model, out = self.model, self.getOrDefault("predictionCol")
        held = F.from_json(F.lit(json.dumps(model["slopes"])), "array<array<double>>")
        x = vector_to_array(F.col(self.getOrDefault("featuresCol")))
        sums = []
        for k, c in enumerate(model["intercepts"]):
            terms = F.zip_with(x, held[k], lambda a, b: a * b)
            sums.append(F.aggregate(terms, F.lit(float(c)), lambda s, t: s + t))
        if not model["classes"]:
            return df.withColumn(out, sums[0])
        if model["classes"] == 2:
            return df.withColumn(out, F.when(sums[0] > 0, 1.0).otherwise(0.0))
        votes = df.withColumn("_votes", F.array(*sums))
        return votes.withColumn(out, (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")).drop("_votes")
