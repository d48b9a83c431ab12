"""Feature selection by variance, correlation and univariate scores (K1-K7)."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_double, col, numeric_columns, require_columns, require_numeric
from ..functions.neighbours import mutual_info_neighbours
from ..functions.quantiles import exact_quantiles
from ..functions.session import local_table, written
from ..functions.stats import corr_pairs, rounded, upper_pairs
from .columns import features_numeric
from .features import bin_index

METHODS = ["f_classif", "f_regression", "mutual_info_classif", "mutual_info_regression", "chi2"]
MI_BINS = 10


def fit_low_variance(df: DataFrame, target: str, threshold: float = 0.01) -> list[str]:
    """Numeric features whose sample variance is below the threshold; an undefined one is kept."""
    require_columns(df, [target])
    names = numeric_columns(df, [target])
    if not names:
        return []
    seen = df.agg(*[F.var_samp(as_double(c)).alias(f"v{i}") for i, c in enumerate(names)]).first()
    return [c for c, v in zip(names, seen) if v is not None and v < threshold]


def drop_low_variance(df: DataFrame, target: str, threshold: float = 0.01) -> DataFrame:
    return df.drop(*fit_low_variance(df, target, threshold))


def fit_correlated(df: DataFrame, target: str, threshold: float = 0.95) -> list[str]:
    """Features that follow an earlier one more closely than the threshold, dropped or not."""
    require_columns(df, [target])
    found = corr_pairs(df, upper_pairs(numeric_columns(df, [target])))
    late = {b for (_, b), r in found.items() if r is not None and abs(r) > threshold}
    return [c for c in df.columns if c in late]


def drop_correlated(df: DataFrame, target: str, threshold: float = 0.95) -> DataFrame:
    return df.drop(*fit_correlated(df, target, threshold))


@dataclass(frozen=True)
class FeatureScores:
    """Scores in column order (None if undefined) and the chosen features, best first."""

    scores: dict[str, float | None]
    selected: list[str]


def _filled(df: DataFrame, target: str, names: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """Features as doubles with missing values at the median, and a rough centre of each."""
    aggs = []
    for i, c in enumerate(names):
        aggs += [F.count_if(col(c).isNull()).alias(f"n{i}"), F.avg(as_double(c)).alias(f"a{i}")]
    seen = df.agg(*aggs).first()
    gaps = [c for i, c in enumerate(names) if seen[f"n{i}"]]
    medians = exact_quantiles(df, gaps, [0.5])
    values = []
    for c in names:
        x = as_double(c)
        values.append((F.coalesce(x, F.lit(medians[c][0]).cast("double")) if c in medians else x).alias(c))
    return df.select(col(target), *values), {c: seen[f"a{i}"] or 0.0 for i, c in enumerate(names)}


def _per_feature(grouped: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    """Wide per-class aggregates (``{field}{i}``) to one row per class and feature."""
    structs = [
        F.struct(F.lit(c).alias("feature"), F.col("n"), *[F.col(f"{f}{i}").alias(f) for f in fields])
        for i, c in enumerate(names)
    ]
    return grouped.select(F.inline(F.array(*structs)))


def _f_classif(df: DataFrame, target: str, names: list[str], centre: dict[str, float]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        x = as_double(c) - F.lit(centre[c])
        aggs += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    per = _per_feature(df.groupBy(col(target)).agg(*aggs), names, ["m", "v"])
    n, m, v = F.col("n"), F.col("m"), F.col("v")
    total = F.sum(n * m)
    between = F.sum(n * m * m) - total * total / F.sum(n)
    within = F.sum(n * v)
    classes = F.count(F.lit(1))
    table = per.groupBy("feature").agg(
        between.alias("b"), within.alias("w"), classes.alias("g"), F.sum(n).alias("n")
    )
    top = F.try_divide(F.col("b"), F.col("g") - 1)
    bottom = F.try_divide(F.col("w"), F.col("n") - F.col("g"))
    spread = F.when((F.col("w") == 0) & (F.col("b") > 0), float("inf"))
    return table.select("feature", F.coalesce(spread, F.try_divide(top, bottom)).alias("score"))


def _f_regression(df: DataFrame, target: str, names: list[str]) -> DataFrame:
    n = df.count()
    found = corr_pairs(df, [(c, target) for c in names])
    rows = []
    for (c, _), r in found.items():
        # A constant feature scores 0, a perfect one the largest double: scores stay finite.
        r2 = 0.0 if r is None else r * r
        rows.append((c, r2 / (1 - r2) * (n - 2) if r2 < 1 else sys.float_info.max))
    return local_table(df.sparkSession, rows, "feature string, score double")


def _chi2(df: DataFrame, target: str, names: list[str]) -> DataFrame:
    low = df.agg(*[F.min(as_double(c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    if any(v is not None and v < 0 for v in low):
        raise ValueError("chi2 counts shares of each feature, so no feature may be below 0")
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(as_double(c)).alias(f"o{i}") for i, c in enumerate(names)]
    per = _per_feature(df.groupBy(col(target)).agg(*aggs), names, ["o"])
    whole = Window.partitionBy("feature")
    expected = F.col("n") * F.sum("o").over(whole) / F.sum("n").over(whole)
    gaps = per.select("feature", "o", expected.alias("e"))
    gap = F.col("o") - F.col("e")
    return gaps.groupBy("feature").agg(F.sum(F.try_divide(gap * gap, F.col("e"))).alias("score"))


def _mutual_info(df: DataFrame, target: str, names: list[str], continuous: bool, n_bins: int) -> DataFrame:
    """Plug-in estimate over decile bins: sum p ln(p / (px py))."""
    binned = names + [target] if continuous else names
    edges = exact_quantiles(df, binned, [i / n_bins for i in range(n_bins + 1)])

    def bin_of(c: str) -> Column:
        return bin_index(as_double(c), sorted({e for e in edges[c] if e is not None}))

    y = bin_of(target) if continuous else col(target)
    cells = [F.struct(F.lit(c).alias("feature"), bin_of(c).alias("bx"), y.alias("by")) for c in names]
    counted = df.select(F.inline(F.array(*cells))).groupBy("feature", "bx", "by").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature"))
    nx = F.sum("n").over(Window.partitionBy("feature", "bx"))
    ny = F.sum("n").over(Window.partitionBy("feature", "by"))
    parts = counted.select("feature", "n", total.alias("t"), nx.alias("nx"), ny.alias("ny"))
    n, t = F.col("n"), F.col("t")
    return parts.groupBy("feature").agg(F.sum(n / t * F.ln(n * t / (F.col("nx") * F.col("ny")))).alias("score"))


def score_features(
    df: DataFrame, target: str, method: str = "f_classif", n_bins: int = MI_BINS, n_neighbors: int | None = None
) -> DataFrame:
    """``feature, score`` for every feature; missing feature values count as the median.

    The mutual informations are estimated from quantile bins: repeatable and one shuffle. That of a class
    is estimated from nearest neighbours instead, with no bins, if ``n_neighbors`` says how many.
    """
    if method not in METHODS:
        raise ValueError(f"method={method!r} is none of {METHODS}")
    names = features_numeric(df, target)
    if not names:
        raise ValueError("Nothing to choose from: the table has no numeric column beside the target")
    if method.endswith("regression"):
        require_numeric(df, target)
    if n_neighbors is not None and (method != "mutual_info_classif" or n_neighbors < 1):
        raise ValueError("n_neighbors, from 1 on, goes with mutual_info_classif")
    if n_neighbors:
        # Its many scans read a narrow table; the joins behind ``df``, and what they send to the driver, run once.
        df = written(df.select(col(target), *[col(c) for c in names]))
    filled, centre = _filled(df.where(col(target).isNotNull()), target, names)
    if method == "f_classif":
        return _f_classif(filled, target, names, centre)
    if method == "f_regression":
        return _f_regression(filled, target, names)
    if method == "chi2":
        return _chi2(filled, target, names)
    if n_neighbors:
        return mutual_info_neighbours(filled, target, names, n_neighbors)
    return _mutual_info(filled, target, names, method.endswith("regression"), n_bins)


def fit_k_best(
    df: DataFrame, target: str, k: int = 10, method: str = "f_classif", n_neighbors: int | None = None
) -> FeatureScores:
    """The k best features; undefined scores come last, and of equal ones the later column wins."""
    scored = score_features(df, target, method, n_neighbors=n_neighbors)
    found = {r["feature"]: r["score"] for r in scored.collect()}
    names = [c for c in df.columns if c in found]
    key = {c: -math.inf if found[c] is None else found[c] for c in names}
    kept = set(sorted(names, key=lambda c: (key[c], names.index(c)))[-min(k, len(names)) :])
    best = sorted((c for c in names if c in kept), key=lambda c: round(key[c], 4) if math.isfinite(key[c]) else key[c], reverse=True)
    return FeatureScores({c: found[c] for c in names}, best)


def apply_k_best(df: DataFrame, target: str, fitted: FeatureScores) -> DataFrame:
    return df.select(col(target), *[col(c) for c in fitted.selected])


def select_k_best(df: DataFrame, target: str, k: int = 10, method: str = "f_classif") -> DataFrame:
    """Target and the k best features, best first."""
    return apply_k_best(df, target, fit_k_best(df, target, k, method))


def k_best_report(df: DataFrame, fitted: FeatureScores) -> DataFrame:
    """``feature, score, selected``."""
    rows = [
        (c, rounded(s), c in fitted.selected)
        for c, s in fitted.scores.items()
    ]
    return local_table(df.sparkSession, rows, "feature string, score double, selected boolean")
