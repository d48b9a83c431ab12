"""The aggregates behind the usual pictures (G1-G3, G5); nothing is drawn."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, col, is_numeric, numeric_columns, require_columns, require_numeric
from ..functions.quantiles import exact_quantiles
from ..functions.session import local_table
from ..functions.stats import corr_pairs, iqr_bounds, long_report, rounded

DENSITY_POINTS = 200
DENSITY_BINS = 1000


def _auto_bins(df: DataFrame, column: str, lo: float, hi: float, n: int) -> int:
    """The narrower of the Freedman-Diaconis and the Sturges bin width."""
    q1, q3 = exact_quantiles(df, [column], [0.25, 0.75])[column]
    sturges = (hi - lo) / (math.log2(n) + 1)
    diaconis = 2 * (q3 - q1) / n ** (1 / 3)
    width = min(sturges, diaconis) if diaconis > 0 else sturges
    return max(1, math.ceil((hi - lo) / width)) if width > 0 else 1


def histogram(df: DataFrame, column: str, n_bins: int | str = 30) -> DataFrame:
    """Equal-width bins over the non-null values: ``bin, lower_edge, upper_edge, row_count``, empty ones too.

    Bins are left-closed; the highest value belongs to the last one.
    """
    require_numeric(df, column)
    x = as_double(column)
    n, lo, hi = df.agg(F.count(x), F.min(x), F.max(x)).first()
    schema = "bin int, lower_edge double, upper_edge double, row_count long"
    if not n:
        return local_table(df.sparkSession, [], schema)
    count = _auto_bins(df, column, lo, hi, n) if n_bins == "auto" else int(n_bins)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    index = F.least(F.floor((x - F.lit(lo)) * count / (hi - lo)), F.lit(count - 1)).cast("int")
    filled = df.where(x.isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    width = (hi - lo) / count
    frame = df.sparkSession.range(count).select(F.col("id").cast("int").alias("bin"))
    return frame.join(filled, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * width).alias("lower_edge"),
        (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper_edge"),
        F.coalesce("c", F.lit(0)).alias("row_count"),
    )


def distribution(df: DataFrame, column: str, n_bins: int | str = 30) -> DataFrame:
    """Value counts, most first, of a category; a histogram of a number."""
    require_columns(df, [column])
    if is_numeric(df, column):
        return histogram(df, column, n_bins)
    value = col(column).cast("string")
    counted = df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.orderBy(F.col("row_count").desc(), "value")


def density(df: DataFrame, column: str, points: int = DENSITY_POINTS, bins: int = DENSITY_BINS) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth over a fine histogram: ``x, density``."""
    require_numeric(df, column)
    v = as_double(column)
    n, lo, hi, std = df.agg(F.count(v), F.min(v), F.max(v), F.stddev_samp(v)).first()
    if not n or not std:
        return local_table(df.sparkSession, [], "x double, density double")
    bandwidth = std * n ** (-1 / 5)
    counts = histogram(df, column, bins).where(F.col("row_count") > 0)
    centre = (F.col("lower_edge") + F.col("upper_edge")) / 2
    # Every bin of the (bounded) histogram contributes to every point of the (bounded) grid.
    spread = counts.select(
        centre.alias("c"), "row_count", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    )
    x = F.lit(lo) + F.col("i") * ((hi - lo) / (points - 1))
    z = (x - F.col("c")) / bandwidth
    kernel = F.col("row_count") * F.exp(-z * z / 2)
    scale = 1 / (n * bandwidth * math.sqrt(2 * math.pi))
    return (
        spread.groupBy("i").agg(F.sum(kernel).alias("k")).select(x.alias("x"), (F.col("k") * scale).alias("density"))
    )


def correlation_heatmap(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The square correlation matrix in long form, with its diagonal: ``col_1, col_2, correlation``."""
    names = columns or numeric_columns(df)
    if not names:
        raise ValueError("A heatmap needs numeric columns, and the table has none")
    found = corr_pairs(df, [(a, b) for i, a in enumerate(names) for b in names[i:]])
    rows = [(p, q, rounded(r)) for (a, b), r in found.items() for p, q in ([(a, b), (b, a)] if a != b else [(a, b)])]
    return local_table(df.sparkSession, rows, "col_1 string, col_2 string, correlation double")


def boxplot_stats(
    df: DataFrame, columns: list[str] | None = None, target: str | None = None, max_columns: int = 12
) -> DataFrame:
    """Quartiles, whiskers (extreme values within 1.5 IQR) and outlier count of up to 12 numeric columns."""
    names = numeric_columns(df, [target])
    if columns is not None:
        require_columns(df, columns)
        names = [c for c in columns if c in names]
    if not names:
        raise ValueError("Boxes are drawn of numeric columns, and the table has none")
    names = names[:max_columns]
    quartiles = exact_quantiles(df, names, [0.25, 0.5, 0.75])
    aggs, rows = [F.count(F.lit(1)).alias("_n")], []
    for i, c in enumerate(names):
        x = as_double(c)
        lo, hi = iqr_bounds(quartiles[c][0], quartiles[c][2])
        inside = x.between(F.lit(lo), F.lit(hi))
        aggs += [
            F.min(F.when(inside, x)).alias(f"lo{i}"),
            F.max(F.when(inside, x)).alias(f"hi{i}"),
            F.count_if(~inside).alias(f"o{i}"),
        ]
        rows.append(
            {
                "column": F.lit(c),
                "q1": F.lit(quartiles[c][0]).cast("double"),
                "median": F.lit(quartiles[c][1]).cast("double"),
                "q3": F.lit(quartiles[c][2]).cast("double"),
                "whisker_low": F.col(f"lo{i}"),
                "whisker_high": F.col(f"hi{i}"),
                "outlier_count": F.col(f"o{i}"),
            }
        )
    return long_report(df.agg(*aggs), rows)
