"""Reports over a table's columns, each from one fused aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    as_double,
    categorical_columns,
    col,
    is_numeric,
    numeric_columns,
    require_columns,
    require_numeric,
)
from ..functions.quantiles import exact_quantiles
from ..functions.session import local_table
from ..functions.stats import (
    corr_pairs,
    iqr_bounds,
    long_report,
    pct,
    rounded,
    upper_pairs,
)

# Names taken for the prediction target, in order of preference.
TARGET_NAMES = [
    "target", "label", "class", "churn", "attrition",
    "price", "salary", "survived", "outcome", "y", "output",
]
MAX_CLASSES = 20


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: type, missing count and share; for numbers also count, mean, std and quartiles.

    ``approx`` takes the quartiles from a sketch within the same scan; exact ones need passes of
    their own.
    """
    numbers = numeric_columns(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(col(c)).alias(f"c{i}"))
        if c in numbers:
            x = as_double(c)
            aggs += [
                F.avg(x).alias(f"mean{i}"),
                F.stddev_samp(x).alias(f"std{i}"),
                F.min(x).alias(f"min{i}"),
                F.max(x).alias(f"max{i}"),
            ]
            if approx:
                aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}"))
    quartiles = {} if approx else exact_quantiles(df, numbers, [0.25, 0.5, 0.75])
    rows = []
    none = F.lit(None).cast("double")
    for i, c in enumerate(df.columns):
        number = c in numbers
        missing = F.col("n") - F.col(f"c{i}")
        row = {
            "column": F.lit(c),
            "dtype": F.lit(df.schema[c].dataType.simpleString()),
            "missing": missing,
            "missing_pct": pct(missing, F.col("n")),
            "count": F.col(f"c{i}") if number else F.lit(None).cast("long"),
            "mean": F.col(f"mean{i}") if number else none,
            "std": F.col(f"std{i}") if number else none,
            "min": F.col(f"min{i}") if number else none,
        }
        for j, p in enumerate(("p25", "p50", "p75")):
            if not number:
                row[p] = none
            elif approx:
                row[p] = F.col(f"q{i}")[j]
            else:
                row[p] = F.lit(quartiles[c][j]).cast("double")
        row["max"] = F.col(f"max{i}") if number else none
        rows.append(row)
    return long_report(df.agg(*aggs), rows)


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def find_target(df: DataFrame, target: str | None = None) -> tuple[str | None, str]:
    """The target column's name and how it was found; no job runs."""
    if target and target in df.columns:
        return target, "user_specified"
    by_name: dict[str, str] = {}
    for c in df.columns:
        by_name.setdefault(c.lower().strip(), c)
    for name in TARGET_NAMES:
        if name in by_name:
            return by_name[name], "auto_detected"
    return None, "not_found"


def identify_target(df: DataFrame, target: str | None = None) -> DataFrame:
    """``target, method, problem_type, dtype, nunique``: classification for text or up to 20 values."""
    name, method = find_target(df, target)
    if name is None:
        return local_table(
            df.sparkSession,
            [(None, method, None, None, None)],
            "target string, method string, problem_type string, dtype string, nunique long",
        )
    classes = F.lit(True) if not is_numeric(df, name) else F.col("nunique") <= MAX_CLASSES
    return df.agg(F.countDistinct(col(name)).alias("nunique")).select(
        F.lit(name).alias("target"),
        F.lit(method).alias("method"),
        F.when(classes, "classification").otherwise("regression").alias("problem_type"),
        F.lit(df.schema[name].dataType.simpleString()).alias("dtype"),
        "nunique",
    )


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns: ``col_1, col_2, correlation``."""
    names = columns or numeric_columns(df)
    if not names:
        raise ValueError("Correlations need a numeric column, and the table has none")
    found = corr_pairs(df, upper_pairs(names))
    rows = [(a, b, rounded(r)) for (a, b), r in found.items()]
    return local_table(df.sparkSession, rows, "col_1 string, col_2 string, correlation double")


def top_correlations(df: DataFrame, k: int = 10) -> DataFrame:
    strongest = F.abs("correlation").desc_nulls_last()
    return correlations(df).orderBy(strongest, "col_1", "col_2").limit(k)


def outlier_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Q1 - 1.5 IQR and Q3 + 1.5 IQR per column."""
    quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    return {c: iqr_bounds(*quartiles[c]) for c in columns}


def _outside(name: str, bounds: tuple[float | None, float | None]):
    lo, hi = bounds
    if lo is None:
        return F.lit(False)
    x = as_double(name)
    return F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False))


def detect_outliers(df: DataFrame, target: str) -> DataFrame:
    """Columns with values outside their IQR bounds; a missing value is no outlier."""
    require_columns(df, [target])
    names = numeric_columns(df, [target])
    bounds = outlier_bounds(df, names)
    one_row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(_outside(c, bounds[c])).alias(f"o{i}") for i, c in enumerate(names)],
    )
    rows = [
        {
            "column": F.lit(c),
            "outlier_count": F.col(f"o{i}"),
            "lower_bound": F.round(F.lit(bounds[c][0]).cast("double"), 4),
            "upper_bound": F.round(F.lit(bounds[c][1]).cast("double"), 4),
        }
        for i, c in enumerate(names)
    ]
    return long_report(one_row, rows).where(F.col("outlier_count") > 0)


def outlier_rows(df: DataFrame, target: str) -> DataFrame:
    """``total_outlier_rows, total_rows``: rows outside the bounds of at least one column."""
    require_columns(df, [target])
    names = numeric_columns(df, [target])
    bounds = outlier_bounds(df, names)
    anywhere = F.lit(False)
    for c in names:
        anywhere = anywhere | _outside(c, bounds[c])
    return df.agg(F.count_if(anywhere).alias("total_outlier_rows"), F.count(F.lit(1)).alias("total_rows"))


def check_leakage(df: DataFrame, target: str, threshold: float = 0.95) -> DataFrame:
    """Absolute correlation of each numeric feature with a numeric target, flagged from ``threshold`` on."""
    require_numeric(df, target)
    names = numeric_columns(df, [target])
    if not names:
        raise ValueError("Beside the target no column is numeric, so nothing can leak")
    found = corr_pairs(df, [(c, target) for c in names])
    rows = [(c, None if r is None else rounded(abs(r)), r is not None and abs(r) >= threshold) for (c, _), r in found.items()]
    return local_table(df.sparkSession, rows, "feature string, abs_corr double, flagged boolean")


def top_safe(leakage: DataFrame, k: int = 10) -> DataFrame:
    """The strongest correlations of a leakage report that were not flagged."""
    return leakage.where(~F.col("flagged")).orderBy(F.col("abs_corr").desc_nulls_last(), "feature").limit(k)


def missingness(df: DataFrame) -> DataFrame:
    """Columns with missing values, most first: ``column, missing, missing_pct``."""
    one_row = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    )
    rows = [
        {
            "column": F.lit(c),
            "missing": F.col("n") - F.col(f"c{i}"),
            "missing_pct": pct(F.col("n") - F.col(f"c{i}"), F.col("n")),
        }
        for i, c in enumerate(df.columns)
    ]
    return long_report(one_row, rows).where(F.col("missing") > 0).orderBy(F.col("missing").desc(), "column")


def missing_patterns(df: DataFrame) -> DataFrame:
    """How often each combination of missing columns occurs; ``pattern`` has one 0/1 per column."""
    bits = F.concat(*[F.when(col(c).isNull(), "1").otherwise("0") for c in df.columns])
    return df.groupBy(bits.alias("pattern")).agg(F.count(F.lit(1)).alias("row_count"))


def stage_summary(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each named table."""
    out = None
    for name, df in stages.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("stage"), "rows", F.lit(len(df.columns)).cast("long").alias("columns")
        )
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("No stages given.")
    return out


def column_kinds(df: DataFrame) -> dict[str, list[str]]:
    return {"numeric": numeric_columns(df), "categorical": categorical_columns(df)}
