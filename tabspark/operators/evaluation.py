"""Evaluation of predictions (V1-V6, V8-V10): aggregates over a scored table.

A scored table has ``label`` and ``prediction`` and, for binary classifiers that give one,
``probability`` of the positive (greater) label.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, col, require_columns
from ..functions.ordering import SEED, first_rows, running_totals
from ..functions.session import local_table, written
from ..functions.stats import long_report, ratio
from .charts import histogram
from .profiling import stage_summary

LABEL, PREDICTION, PROBABILITY = "label", "prediction", "probability"


def confusion_counts(scored: DataFrame) -> DataFrame:
    """``actual, predicted, row_count`` of the pairs that occur."""
    return scored.groupBy(
        col(LABEL).cast("string").alias("actual"), col(PREDICTION).cast("string").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("row_count"))


def classification_metrics(scored: DataFrame, with_auc: bool = False) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    One scan: everything follows from the confusion counts. Undefined ratios are 0. ``with_auc`` adds,
    for two labels with probabilities, the area under the ROC curve as one more line.
    """
    if with_auc:
        values = [F.col("auc").alias(m) for m in ("precision", "recall", "f1")]
        area = _area(scored).select(F.lit("roc auc").alias("class"), *values, "support")
        return classification_metrics(scored).unionByName(area)
    n, hit = F.col("row_count"), F.col("actual") == F.col("predicted")
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("actual").alias("class"), n.alias("support"), zero.alias("called"), F.when(hit, n).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("class"), zero.alias("support"), n.alias("called"), zero.alias("tp")),
    )
    per = confusion_counts(scored).select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("tp").alias("tp")
    )
    none = F.lit(0.0)
    per = per.select(
        "class",
        "support",
        "tp",
        F.coalesce(ratio(F.col("tp"), F.col("called")), none).alias("precision"),
        F.coalesce(ratio(F.col("tp"), F.col("support")), none).alias("recall"),
        F.coalesce(ratio(2 * F.col("tp"), F.col("called") + F.col("support")), none).alias("f1"),
    )
    names = ["precision", "recall", "f1"]
    # The grand-total row of the rollup holds the averages; a class row averages only itself.
    rolled = per.rollup("class").agg(
        F.grouping("class").alias("total"),
        F.sum("support").alias("support"),
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(m) for m in names],
        *[F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"w_{m}") for m in names],
    )

    def line(label: Column, values: list[Column]) -> Column:
        return F.struct(label.alias("class"), *[F.round(v, 4).alias(m) for v, m in zip(values, names)], F.col("support"))

    own = [F.col(m) for m in names]
    summary = F.array(
        line(F.lit("accuracy"), [F.col("accuracy")] * 3),
        line(F.lit("macro avg"), own),
        line(F.lit("weighted avg"), [F.col(f"w_{m}") for m in names]),
    )
    return rolled.select(F.inline(F.when(F.col("total") == 1, summary).otherwise(F.array(line(F.col("class"), own)))))


def accuracy(scored: DataFrame) -> DataFrame:
    hit = col(LABEL).cast("string") == col(PREDICTION).cast("string")
    return scored.agg(F.round(ratio(F.count_if(hit), F.count(F.lit(1))), 4).alias("accuracy"), F.count(F.lit(1)).alias("total_predictions"))


def regression_scores(y: Column, p: Column) -> dict[str, Column]:
    """Unrounded aggregate expressions."""
    e = y - p
    n = F.count(e)
    lost, spread = F.sum(e * e), F.var_pop(y) * n
    exact = F.when(lost == 0, 1.0).otherwise(0.0)
    return {
        "mae": F.avg(F.abs(e)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "r2": F.coalesce(1 - F.try_divide(lost, spread), exact),
    }


def regression_metrics(scored: DataFrame, n_features: int) -> DataFrame:
    """One row: errors, R2, adjusted R2 (NULL unless rows exceed features + 1), residual mean and std."""
    y, p = as_double(LABEL), as_double(PREDICTION)
    seen = scored.agg(
        F.count(y - p).alias("total_predictions"),
        *[e.alias(m) for m, e in regression_scores(y, p).items()],
        F.avg(y - p).alias("residual_mean"),
        F.stddev_pop(y - p).alias("residual_std"),
    )
    n = F.col("total_predictions")
    adjusted = F.when(n > n_features + 1, 1 - (1 - F.col("r2")) * F.try_divide((n - 1).cast("double"), n - n_features - 1))
    rounded = {m: F.round(F.col(m), 4) for m in ["mae", "mse", "rmse", "r2"]}
    return seen.select(
        *[v.alias(m) for m, v in rounded.items()],
        F.round(adjusted, 4).alias("adjusted_r2"),
        "total_predictions",
        F.round("residual_mean", 4).alias("residual_mean"),
        F.round("residual_std", 4).alias("residual_std"),
    )


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """Counts for every pair of the classes that occur as label or prediction, zeros included."""
    counts = confusion_counts(scored)
    classes = counts.agg(
        F.array_union(F.collect_set("actual"), F.collect_set("predicted")).alias("all")
    )
    cells = classes.select("all", F.explode("all").alias("actual")).select("actual", F.explode("all").alias("predicted"))
    found = cells.join(counts, ["actual", "predicted"], "left")
    return found.select("actual", "predicted", F.coalesce("row_count", F.lit(0)).alias("row_count"))


def _binary(scored: DataFrame) -> tuple[DataFrame, int, int]:
    """``score, pos, neg`` per distinct score with the class totals; refuses anything but two labels.

    The scored plan runs once: its counts per score and label are written, and all else reads those.
    """
    if PROBABILITY not in scored.columns:
        raise ValueError("The scored table has no probability column: score it with a model that gives one")
    require_columns(scored, [LABEL])
    labelled = scored.where(col(LABEL).isNotNull())
    per = written(labelled.groupBy(as_double(PROBABILITY).alias("score"), col(LABEL).alias("label")).agg(F.count(F.lit(1)).alias("n")))
    low, high, n = per.agg(F.min("label"), F.max("label"), F.sum("n")).first()
    pos = F.when(F.col("label") == F.lit(high), F.col("n")).otherwise(F.lit(0).cast("long"))
    neg = F.when(F.col("label") == F.lit(low), F.col("n")).otherwise(F.lit(0).cast("long"))
    n_pos, n_neg = per.agg(F.sum(pos), F.sum(neg)).first()
    if low == high or n_pos + n_neg != n:
        raise ValueError(f"Curves need exactly two values of {LABEL!r}")
    return per.select("score", pos.alias("pos"), neg.alias("neg")), n_pos, n_neg


def roc_curve(scored: DataFrame) -> DataFrame:
    """``threshold, fpr, tpr`` at every distinct score, and the start (0, 0) without a threshold."""
    rows, n_pos, n_neg = _binary(scored)
    points = running_totals(rows, "score", ["pos", "neg"]).select(
        F.col("score").alias("threshold"),
        (F.col("cum_neg") / F.lit(float(n_neg))).alias("fpr"),
        (F.col("cum_pos") / F.lit(float(n_pos))).alias("tpr"),
    )
    start = local_table(scored.sparkSession, [(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return points.unionByName(start)


def _area(scored: DataFrame) -> DataFrame:
    rows, n_pos, n_neg = _binary(scored)
    above = F.col("cum_pos") - F.col("pos")
    area = F.sum(F.col("neg") * (above + F.col("pos") / 2.0)) / F.lit(float(n_pos)) / F.lit(float(n_neg))
    totals = running_totals(rows, "score", ["pos", "neg"])
    return totals.agg(F.round(area, 4).alias("auc")).withColumn("support", F.lit(n_pos + n_neg).cast("long"))


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezoids."""
    return _area(scored).select("auc")


def pr_curve(scored: DataFrame) -> DataFrame:
    """``threshold, precision, recall`` at every distinct score, and the end (1, 0) without a threshold."""
    rows, n_pos, _ = _binary(scored)
    called = (F.col("cum_pos") + F.col("cum_neg")).cast("double")
    points = running_totals(rows, "score", ["pos", "neg"]).select(
        F.col("score").alias("threshold"),
        (F.col("cum_pos") / called).alias("precision"),
        (F.col("cum_pos") / F.lit(float(n_pos))).alias("recall"),
    )
    end = local_table(scored.sparkSession, [(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return points.unionByName(end)


def average_precision(scored: DataFrame) -> DataFrame:
    """Precision at each score weighted by the recall gained there."""
    rows, n_pos, _ = _binary(scored)
    called = (F.col("cum_pos") + F.col("cum_neg")).cast("double")
    gained = F.sum(F.col("pos") * F.col("cum_pos") / called) / F.lit(float(n_pos))
    return running_totals(rows, "score", ["pos", "neg"]).agg(F.round(gained, 4).alias("average_precision"))


def calibration(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    """Per uniform bin of the probability: ``bin, mean_predicted, fraction_positive, row_count``.

    Bins are right-closed: a probability on an edge belongs to the lower bin. Empty bins are left out.
    """
    rows, _, _ = _binary(scored)
    if rows.where((F.col("score") < 0) | (F.col("score") > 1)).limit(1).count():
        raise ValueError("Probabilities must lie between 0 and 1")
    step = 1.0 / n_bins
    index = F.lit(n_bins - 1)
    for i in range(n_bins - 1, 0, -1):
        index = F.when(F.col("score") <= F.lit(i * step), i - 1).otherwise(index)
    n = F.col("pos") + F.col("neg")  # a row stands for all rows of its score and label
    return rows.groupBy(index.alias("bin")).agg(
        (F.sum(F.col("score") * n) / F.sum(n)).alias("mean_predicted"),
        (F.sum("pos") / F.sum(n)).alias("fraction_positive"),
        F.sum(n).alias("row_count"),
    )


def calibration_gap(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    gap = F.abs(F.col("fraction_positive") - F.col("mean_predicted"))
    return calibration(scored, n_bins).agg(F.round(F.avg(gap), 4).alias("mean_calibration_gap"))


def score_histogram(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    return histogram(scored, PROBABILITY, 2 * n_bins)


def _order(scored: DataFrame, keys: Sequence[str] | None) -> list[str]:
    if keys:
        require_columns(scored, keys)
    return list(keys or scored.columns)


def prediction_sample(scored: DataFrame, n: int = 50, keys: Sequence[str] | None = None) -> DataFrame:
    """The first rows in key order with a mismatch flag."""
    differ = ~col(LABEL).cast("string").eqNullSafe(col(PREDICTION).cast("string"))
    names = [*(keys or []), LABEL, PREDICTION]
    return scored.orderBy(*[col(k) for k in _order(scored, keys)]).limit(n).select(*[col(c) for c in names], differ.alias("mismatch"))


def mismatch_rate(scored: DataFrame) -> DataFrame:
    differ = ~col(LABEL).cast("string").eqNullSafe(col(PREDICTION).cast("string"))
    return scored.agg(F.count_if(differ).alias("mismatches"), F.count(F.lit(1)).alias("total"), F.round(ratio(F.count_if(differ), F.count(F.lit(1))), 4).alias("mismatch_rate"))


def residuals(scored: DataFrame) -> DataFrame:
    """The scored table with ``residual`` = label - prediction."""
    return scored.withColumn("residual", as_double(LABEL) - as_double(PREDICTION))


def residual_histogram(scored: DataFrame, n_bins: int = 30) -> DataFrame:
    return histogram(residuals(scored), "residual", n_bins)


def residual_range(scored: DataFrame) -> DataFrame:
    """Ends of the identity line: ``min_value, max_value`` over labels and predictions."""
    y, p = as_double(LABEL), as_double(PREDICTION)
    return scored.agg(F.least(F.min(y), F.min(p)).alias("min_value"), F.greatest(F.max(y), F.max(p)).alias("max_value"))


def residual_points(
    scored: DataFrame, n: int | None = None, keys: Sequence[str] | None = None, seed: int = SEED
) -> DataFrame:
    """The points to draw: all of them, or a repeatable random sample of ``n``."""
    points = residuals(scored)
    return points if n is None else first_rows(points, n, _order(scored, keys), seed)


def residual_grid(scored: DataFrame, n_bins: int = 50, x: str = PREDICTION, y: str = "residual") -> DataFrame:
    """The picture of all points as row counts of at most ``n_bins`` squared cells, empty ones left out.

    ``x`` and ``y`` are two of label, prediction and residual; one pass finds their ends and one counts. Cells are
    left-closed, the highest value belongs to the last one, and rows without either value are in none.
    """
    if n_bins < 1:
        raise ValueError("At least 1 bin is needed")
    points = residuals(scored).select(as_double(x).alias("x"), as_double(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    ends = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if ends[0] is None:
        return local_table(scored.sparkSession, [], "x_bin int, y_bin int, x_low double, x_high double, y_low double, y_high double, row_count long")
    cells, edges = [], []
    for c, lo, hi in (("x", *ends[:2]), ("y", *ends[2:])):
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        width = (hi - lo) / n_bins
        cells.append(F.least(F.floor((F.col(c) - F.lit(lo)) * n_bins / (hi - lo)), F.lit(n_bins - 1)).cast("int").alias(f"{c}_bin"))
        edges += [(F.lit(lo) + (F.col(f"{c}_bin") + step) * width).alias(f"{c}_{end}") for step, end in ((0, "low"), (1, "high"))]
    counted = points.groupBy(*cells).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.select("x_bin", "y_bin", *edges, "row_count")


def report(
    stages: dict[str, DataFrame], model: str, scored: DataFrame, problem_type: str, n_features: int
) -> DataFrame:
    """Shapes, model and metrics as one long table ``section, item, value``."""
    spark = scored.sparkSession
    shape = stage_summary(stages).select(
        F.lit("shape").alias("section"),
        F.col("stage").alias("item"),
        F.concat_ws(" x ", F.col("rows").cast("string"), F.col("columns").cast("string")).alias("value"),
    )
    named = local_table(spark, [("model", "model_type", model), ("model", "problem_type", problem_type)], "section string, item string, value string")
    if problem_type == "classification":
        found = classification_metrics(scored)
        cells: list[dict[str, Any]] = [
            {"section": F.lit("metrics"), "item": F.concat_ws(" ", F.col("class"), F.lit(m)), "value": F.col(m).cast("string")}
            for m in ("precision", "recall", "f1", "support")
        ]
    else:
        found = regression_metrics(scored, n_features)
        cells = [
            {"section": F.lit("metrics"), "item": F.lit(m), "value": F.col(m).cast("string")} for m in found.columns
        ]
    return shape.unionByName(named).unionByName(long_report(found, cells))
