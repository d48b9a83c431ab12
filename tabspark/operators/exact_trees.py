"""Decision trees whose splits are searched over all distinct values (M6 with ``exact_splits``).

For each level, rows are counted by (node, feature, value, class), map-side first, so a value that repeats is
one row however frequent it is. The score of a cut needs the sums of squared class counts on either side. Both
change by a known amount with each value and class, so running sums over the values in order give them for any
number of classes, without a row per class and cut. The values of a feature are dealt out in ranges; whole
ranges are added up first, so that no task orders more than one range of one feature of one node. The driver
sees the best cut of each open node.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import range_ends, range_number
from ..functions.session import written

ROWS_PER_RANGE = 1_000_000
NODE = "array<struct<f:int,t:double,l:int,r:int,open:boolean,v:array<double>>>"


@dataclass
class Node:
    """``feature`` -1 is a leaf; rows of at most ``cut`` go to ``left``. ``gain`` is the fall in weight times impurity."""

    depth: int
    feature: int = -1
    cut: float = 0.0
    left: int = -1
    right: int = -1
    open: bool = True
    gain: float = 0.0
    value: list[float] = field(default_factory=list)


def _constant(nodes: list[Node]) -> Column:
    held = [{"f": n.feature, "t": n.cut, "l": n.left, "r": n.right, "open": n.open, "v": n.value} for n in nodes]
    return F.from_json(F.lit(json.dumps(held)), NODE)


def _walk(nodes: Column, x: Column, depth: int) -> Column:
    """The number of the node that each row ends in."""
    if not depth:
        return F.lit(0)

    def step(at: Column, _: Column) -> Column:
        node = F.get(nodes, at)
        down = F.when(F.get(x, node["f"]) <= node["t"], node["l"]).otherwise(node["r"])
        return F.when(node["f"] < 0, at).otherwise(down)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)


def _both_sides(df: DataFrame, parts: list[str], order: str, before: Column, total: Column) -> DataFrame:
    """Per step of ``order``: by how much the sums of squares at or below it and above it change."""
    s = F.col("s")
    below, above = before, total - before
    changes = df.withColumn("dl", s * (2 * below + s)).withColumn("dr", s * (s - 2 * above))
    return changes.groupBy(*parts, order).agg(*[F.sum(c).alias(c) for c in ("n", "c", "dl", "dr")])


def best_cuts(counted: DataFrame, least: int) -> DataFrame:
    """The best cut of each node: ``node, n, c, e, q, gain, f, cut`` (``f`` is NULL where there is none).

    ``counted`` has ``node, f, b, v, j`` (range, value, class) with summed weights ``n``, rows ``c``, ``s`` (what
    is squared by class) and ``e``. Of equal gains, to twelve digits of the node's impurity, the first by
    feature and value wins.
    """
    classes = counted.where("f = 0").groupBy("node", "j").agg(*[F.sum(c).alias(c) for c in ("n", "c", "s", "e")])
    totals = classes.groupBy("node").agg(
        F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("e").alias("e"), F.sum(F.col("s") * F.col("s")).alias("q")
    )
    # Whole ranges: what lies below each, by class, and the sums of squares where it begins.
    by_range = counted.groupBy("node", "f", "j", "b").agg(*[F.sum(c).alias(c) for c in ("n", "c", "s")])
    whole = Window.partitionBy("node", "f", "j")
    earlier = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    by_range = by_range.withColumn("before", F.coalesce(F.sum("s").over(earlier), F.lit(0.0))).withColumn("total", F.sum("s").over(whole))
    steps = _both_sides(by_range, ["node", "f"], "b", F.col("before"), F.col("total"))
    firsts = counted.groupBy("node", "f", "b").agg(F.min("v").alias("first"))
    along = Window.partitionBy("node", "f").orderBy("b")
    sofar = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = steps.join(firsts, ["node", "f", "b"]).select(
        "node", "f", "b", F.lead("first").over(along).alias("after"),
        *[F.coalesce(F.sum(c).over(sofar), F.lit(0)).alias(f"{c}0") for c in ("n", "c", "dl", "dr")],
    )
    # Values inside their range.
    inside = Window.partitionBy("node", "f", "b", "j").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    values = counted.join(by_range.select("node", "f", "j", "b", "before", "total"), ["node", "f", "j", "b"])
    before = F.col("before") + F.coalesce(F.sum("s").over(inside), F.lit(0.0))
    values = _both_sides(values.withColumn("before", before), ["node", "f", "b"], "v", F.col("before"), F.col("total"))
    order = Window.partitionBy("node", "f", "b").orderBy("v")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = values.join(offsets, ["node", "f", "b"]).select(
        "node", "f", "v", F.coalesce(F.lead("v").over(order), F.col("after")).alias("next"),
        *[(F.sum(c).over(upto) + F.col(f"{c}0")).alias(f"{c}_to") for c in ("n", "c", "dl", "dr")],
    )
    low, high = F.col("dl_to") / F.col("n_to"), (F.col("q") + F.col("dr_to")) / (F.col("n") - F.col("n_to"))
    fits = F.col("next").isNotNull() & (F.col("c_to") >= least) & (F.col("c") - F.col("c_to") >= least)
    cuts = placed.join(totals, "node").where(fits & (F.col("n_to") > 0) & (F.col("n_to") < F.col("n")))
    gain = low + high - F.col("q") / F.col("n")
    impurity = F.col("e") - F.col("q") / F.col("n")
    middle = F.col("v") / 2 + F.col("next") / 2
    cut = F.when(middle < F.col("next"), middle).otherwise(F.col("v"))
    ranked = F.struct(F.round(F.try_divide(gain, impurity), 12).alias("share"), (-F.col("f")).alias("f"), (-F.col("v")).alias("v"), gain.alias("gain"), cut.alias("cut"))
    best = cuts.groupBy("node").agg(F.max(ranked).alias("best"))
    chosen = totals.join(best, "node", "left")
    return chosen.select("node", "n", "c", "e", "q", F.col("best.gain").alias("gain"), (-F.col("best.f")).alias("f"), F.col("best.cut").alias("cut"))


def fit_exact_tree(
    rows: DataFrame, features: str, label: str, n_features: int, n_classes: int, max_depth: int,
    min_split: int = 2, min_leaf: int = 1, weight: str | None = None, **columns: str,
) -> ExactTree:
    """Fit on rows of a vector and a label: a number (``n_classes`` 0: least squares), or the index of a class (Gini)."""
    w = (F.col(weight) if weight else F.lit(1.0)).cast("double")
    given = rows.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"))
    wide = given.select(*[F.col("x")[f].alias(f"x{f}") for f in range(n_features)])
    ends = range_ends(wide, wide.columns, ROWS_PER_RANGE)

    def cell(v: Column, f: Column) -> Column:
        return F.struct(f.alias("f"), range_number(ends, f, v).alias("b"), v.alias("v"))

    table = written(given.withColumn("cells", F.transform("x", cell)))
    y, w = F.col("y"), F.col("w")
    if n_classes:
        j, s, e, centre = y.cast("int"), w, w, 0.0
    else:
        centre = table.agg(F.try_divide(F.sum(w * y), F.sum(w))).first()[0] or 0.0
        j, s, e = F.lit(0), w * (y - centre), w * (y - centre) * (y - centre)
    nodes = [Node(0)]
    for depth in range(max_depth):
        at = _walk(_constant(nodes), F.col("x"), depth)
        open_rows = table.withColumn("node", at).where(F.get(_constant(nodes), F.col("node"))["open"])
        cells = open_rows.select("node", j.alias("j"), s.alias("s"), e.alias("e"), w.alias("n"), F.inline("cells"))
        counted = cells.groupBy("node", "f", "b", "v", "j").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"), F.sum("s").alias("s"), F.sum("e").alias("e")
        )
        for node in nodes:
            node.open = False
        for r in best_cuts(written(counted), min_leaf).collect():
            impure = r["e"] - r["q"] / r["n"] > 1e-12 * max(r["e"], 1e-300) if r["n"] else False
            if r["f"] is None or not impure or r["c"] < min_split:
                continue
            node = nodes[r["node"]]
            node.feature, node.cut, node.gain = r["f"], r["cut"], r["gain"]
            node.left, node.right = len(nodes), len(nodes) + 1
            nodes += [Node(depth + 1), Node(depth + 1)]
        if not any(n.open for n in nodes):
            break
    deepest = max(n.depth for n in nodes)
    ended = table.select(_walk(_constant(nodes), F.col("x"), deepest).alias("node"), j.alias("j"), "y", "w")
    sums = ended.groupBy("node", "j").agg(F.sum("w").alias("w"), F.sum(w * (y - centre)).alias("s"), F.count(F.lit(1)).alias("c"))
    masses: dict[int, list[float]] = {}
    for r in sums.collect():
        mass = masses.setdefault(r["node"], [0.0] * max(n_classes, 1))
        if n_classes:
            mass[r["j"]] = r["w"]
        else:
            mass[0] = centre + (r["s"] / r["w"] if r["w"] else 0.0)
    for number, mass in masses.items():
        total = sum(mass)
        nodes[number].value = [m / total if total else 1 / n_classes for m in mass] if n_classes else mass
    held = [{"f": n.feature, "t": n.cut, "l": n.left, "r": n.right, "open": False, "v": n.value, "gain": n.gain} for n in nodes]
    return ExactTree(tree=json.dumps({"classes": n_classes, "n_features": n_features, "depth": deepest, "nodes": held}), featuresCol=features, **columns)


class ExactTree(Transformer, HasFeaturesCol, HasPredictionCol, HasProbabilityCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted tree: adds the prediction, and for classes the vector of their shares in the leaf.

    The nodes are a constant of the plan that rows walk through array lookups: no Python, any stream.
    """

    tree = Param(Params._dummy(), "tree", "the nodes as JSON", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, tree: str | None = None, featuresCol: str = "features", predictionCol: str = "prediction", probabilityCol: str | None = None):
        super().__init__()
        self._setDefault(tree="", predictionCol="prediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def model(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault("tree"))

    @property
    def featureImportances(self) -> Any:
        """Each feature's share of the fall in impurity."""
        model = self.model
        falls = np.zeros(model["n_features"])
        for node in model["nodes"]:
            if node["f"] >= 0:
                falls[node["f"]] += node["gain"]
        return Vectors.dense(falls / falls.sum() if falls.sum() > 0 else falls)

    def _transform(self, df: DataFrame) -> DataFrame:
        model, out = self.model, self.getOrDefault("predictionCol")
        nodes = F.from_json(F.lit(json.dumps(model["nodes"])), NODE)
        x = vector_to_array(F.col(self.getOrDefault("featuresCol")))
        held = df.withColumn("_leaf", F.get(nodes, _walk(nodes, x, model["depth"]))["v"])
        if not model["classes"]:
            return held.withColumn(out, F.col("_leaf")[0]).drop("_leaf")
        best = (F.array_position("_leaf", F.array_max("_leaf")) - 1).cast("double")
        return held.withColumn(out, best).withColumn(self.getOrDefault("probabilityCol"), array_to_vector(F.col("_leaf"))).drop("_leaf")
