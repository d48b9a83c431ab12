"""Selecting, renaming, casting and editing columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    NUMERIC_TYPES,
    as_double,
    categorical_columns,
    chunks,
    col,
    is_numeric,
    numeric_columns,
    require_columns,
    require_numeric,
    string_columns,
    text_to_double,
    text_to_whole,
)
from ..functions.quantiles import exact_quantiles
from ..functions.session import local_table
from ..functions.stats import long_report
from .profiling import outlier_bounds

# Accepted type names and the Spark type each one stands for.
CAST_TYPES = {
    "int": "bigint",
    "int8": "tinyint",
    "int16": "smallint",
    "int32": "int",
    "int64": "bigint",
    "float": "double",
    "float32": "float",
    "float64": "double",
    "str": "string",
    "string": "string",
    "object": "string",
    "category": "string",
    "bool": "boolean",
    "datetime": "timestamp_ntz",
    "datetime64[ns]": "timestamp_ntz",
}
WHOLE_TYPES = {"tinyint", "smallint", "int", "bigint"}


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    require_columns(df, columns)
    return df.drop(*columns)


def select_features(df: DataFrame, columns: list[str]) -> DataFrame:
    require_columns(df, columns)
    return df.select(*[col(c) for c in columns])


def clean_name(name: str) -> str:
    """Lower case, words joined by underscores, only letters, digits and underscores left."""
    return re.sub(r"[^\w]", "", re.sub(r"[ -]", "_", name.strip().lower()))


def _rename(df: DataFrame, names: list[str]) -> DataFrame:
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"Renaming would give several columns the names {twice}")
    return df.toDF(*names)


def rename_columns(df: DataFrame, rename_map: dict[str, str] | None = None, clean_all: bool = False) -> DataFrame:
    """Rename by map, or clean every name."""
    if rename_map:
        require_columns(df, rename_map)
        return _rename(df, [rename_map.get(c, c) for c in df.columns])
    if clean_all:
        return _rename(df, [clean_name(c) for c in df.columns])
    raise ValueError("Nothing to rename: pass rename_map, or clean_all=True")


@dataclass(frozen=True)
class CastPlan:
    casts: dict[str, str]
    failed: dict[str, str] = field(default_factory=dict)


def _cast(df: DataFrame, name: str, to: str) -> Column:
    kind = df.schema[name].dataType
    if to == "boolean" and not isinstance(kind, T.BooleanType):
        # Truth of a value as such: not zero, or a text that is not empty; missing counts as true.
        truth = col(name) != 0 if isinstance(kind, NUMERIC_TYPES) else F.length(col(name).cast("string")) > 0
        return F.coalesce(truth, F.lit(True))
    if isinstance(kind, T.StringType):
        if to in WHOLE_TYPES:
            return text_to_whole(col(name), to)
        if to in ("float", "double"):
            return text_to_double(col(name)).cast(to)
    return col(name).try_cast(to)


def fit_casts(df: DataFrame, type_map: dict[str, str]) -> CastPlan:
    """Find in one scan which of the casts work for every value."""
    require_columns(df, type_map)
    failed = {c: f"unknown type '{t}'" for c, t in type_map.items() if t not in CAST_TYPES}
    casts = {c: CAST_TYPES[t] for c, t in type_map.items() if c not in failed}
    if not casts:
        return CastPlan({}, failed)
    bad = []
    for i, (c, to) in enumerate(casts.items()):
        lost = _cast(df, c, to).isNull()
        # A missing cell cannot become a whole number; elsewhere it stays missing.
        bad.append(F.count_if(lost if to in WHOLE_TYPES else lost & col(c).isNotNull()).alias(f"b{i}"))
    for (c, to), n in zip(list(casts.items()), df.agg(*bad).first()):
        if n:
            failed[c] = f"{n} values cannot be cast to {to}"
            del casts[c]
    return CastPlan(casts, failed)


def apply_casts(df: DataFrame, plan: CastPlan) -> DataFrame:
    return df.select(*[_cast(df, c, plan.casts[c]).alias(c) if c in plan.casts else col(c) for c in df.columns])


def cast_types(df: DataFrame, type_map: dict[str, str]) -> DataFrame:
    """Cast each column whose every value can be cast; the others stay as they are."""
    return apply_casts(df, fit_casts(df, type_map))


def strip_whitespace(df: DataFrame) -> DataFrame:
    """Trim all kinds of white space around texts and column names."""
    texts = set(string_columns(df))
    trimmed = df.select(
        *[F.regexp_replace(col(c), r"^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "").alias(c) if c in texts else col(c) for c in df.columns]
    )
    return _rename(trimmed, [c.strip() for c in df.columns])


def _same_kind(dtype: T.DataType, values: list[Any]) -> bool:
    values = [v for v in values if v is not None]
    if isinstance(dtype, T.StringType):
        return all(isinstance(v, str) for v in values)
    if isinstance(dtype, T.BooleanType):
        return all(isinstance(v, bool) for v in values)
    if isinstance(dtype, NUMERIC_TYPES):
        return all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
    return False


def replace_values(df: DataFrame, column: str, replace_map: dict[Any, Any]) -> DataFrame:
    """Replace values of one column, all at once; replacements of another kind make it text."""
    require_columns(df, [column])
    if not replace_map:
        return df
    dtype = df.schema[column].dataType
    news = list(replace_map.values())
    if not _same_kind(dtype, news):
        to = "string"
    elif isinstance(dtype, NUMERIC_TYPES) and any(isinstance(v, float) for v in news):
        to = "double"
    else:
        to = dtype.simpleString()
    out = None
    for old, new in replace_map.items():
        hit = col(column).isNull() if old is None else col(column) == F.lit(old)
        value = F.lit(new).cast(to)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return df.withColumn(column, out.otherwise(col(column).cast(to)))


def replace_report(df: DataFrame, column: str, replace_map: dict[Any, Any]) -> DataFrame:
    """Occurrences of each old value before, and distinct values after, the replacement."""
    require_columns(df, [column])
    after = replace_values(df.select(col(column).alias(column), col(column).alias("_old")), column, replace_map)
    counts = [
        F.count_if(F.col("_old").isNull() if old is None else F.col("_old") == F.lit(old)).alias(f"n{i}")
        for i, old in enumerate(replace_map)
    ]
    one_row = after.agg(*counts, F.countDistinct(col(column)).alias("unique_after"))
    rows = [
        {
            "old_value": F.lit(str(old)),
            "occurrences": F.col(f"n{i}"),
            "unique_after": F.col("unique_after"),
        }
        for i, old in enumerate(replace_map)
    ]
    return long_report(one_row, rows)


@dataclass(frozen=True)
class ClipBounds:
    column: str
    lower: float | None
    upper: float | None


def fit_clip(df: DataFrame, column: str, lower: float | None = None, upper: float | None = None) -> ClipBounds:
    """The given bounds, or the IQR bounds when there are none."""
    require_numeric(df, column)
    if lower is None and upper is None:
        lower, upper = outlier_bounds(df, [column])[column]
    return ClipBounds(column, lower, upper)


def apply_clip(df: DataFrame, bounds: ClipBounds) -> DataFrame:
    x = as_double(bounds.column)
    out = x
    if bounds.lower is not None:
        out = F.greatest(out, F.lit(float(bounds.lower)))
    if bounds.upper is not None:
        out = F.least(out, F.lit(float(bounds.upper)))
    # greatest and least skip nulls, which would turn a missing value into a bound.
    return df.withColumn(bounds.column, F.when(x.isNotNull(), out))


def clip_values(df: DataFrame, column: str, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """Clamp a numeric column; the result is double."""
    return apply_clip(df, fit_clip(df, column, lower, upper))


def clip_report(df: DataFrame, bounds: ClipBounds) -> DataFrame:
    x = as_double(bounds.column)
    low = F.count_if(x < F.lit(bounds.lower)) if bounds.lower is not None else F.lit(0).cast("long")
    high = F.count_if(x > F.lit(bounds.upper)) if bounds.upper is not None else F.lit(0).cast("long")
    counted = df.agg(F.count(F.lit(1)).alias("_n"), low.alias("clipped_lower"), high.alias("clipped_upper"))
    return counted.select(
        F.lit(bounds.column).alias("column"),
        F.lit(bounds.lower).cast("double").alias("lower_bound"),
        F.lit(bounds.upper).cast("double").alias("upper_bound"),
        "clipped_lower",
        "clipped_upper",
        (F.col("clipped_lower") + F.col("clipped_upper")).alias("total_clipped"),
    )


def fit_high_missing(df: DataFrame, target: str | None = None, threshold: float = 0.5) -> dict[str, float]:
    """Columns whose missing share reaches the threshold, with that share in per cent."""
    names = [c for c in df.columns if c != target]
    seen = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    if not seen["n"]:
        return {}
    shares = {c: (seen["n"] - seen[f"c{i}"]) / seen["n"] for i, c in enumerate(names)}
    return {c: round(s * 100, 2) for c, s in shares.items() if s >= threshold}


def drop_high_missing(df: DataFrame, target: str | None = None, threshold: float = 0.5) -> DataFrame:
    return df.drop(*fit_high_missing(df, target, threshold))


def fit_high_cardinality(df: DataFrame, target: str, threshold: float = 0.8) -> list[str]:
    """Categorical columns whose distinct values reach ``threshold`` of the rows.

    A sketch (2 % standard error) settles the clear cases; columns within 15 % of the threshold
    are counted exactly.
    """
    require_columns(df, [target])
    names = categorical_columns(df, [target])
    if not names:
        return []
    seen = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.approx_count_distinct(col(c), 0.02).alias(f"d{i}") for i, c in enumerate(names)],
    ).first()
    if not seen["n"]:
        return []
    bar = threshold * seen["n"]
    estimate = {c: seen[f"d{i}"] for i, c in enumerate(names)}
    dropped = {c for c, d in estimate.items() if d > bar * 1.15}
    close = [c for c, d in estimate.items() if bar * 0.85 <= d <= bar * 1.15]
    for part in chunks(close, 8):
        exact = df.agg(*[F.countDistinct(col(c)).alias(f"d{i}") for i, c in enumerate(part)]).first()
        dropped |= {c for c, d in zip(part, exact) if d / seen["n"] >= threshold}
    return [c for c in names if c in dropped]


def drop_high_cardinality(df: DataFrame, target: str, threshold: float = 0.8) -> DataFrame:
    return df.drop(*fit_high_cardinality(df, target, threshold))


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, Any]:
    """The most frequent non-null value per column, the smallest of equals; columns of all types.

    Values are counted per (column, value), merged before the shuffle, so neither a frequent value
    nor a column of mostly distinct values meets in one task.
    """
    out: dict[str, Any] = {}
    by_type: dict[str, list[str]] = {}
    for c in columns:
        by_type.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    for names in by_type.values():
        cells = F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("v")) for i, c in enumerate(names)])
        counted = (
            df.select(F.inline(cells)).where(F.col("v").isNotNull()).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
        )
        best = counted.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("n"), "v"))["v"].alias("v"))
        out.update({names[r["i"]]: r["v"] for r in best.collect()})
    return out


@dataclass(frozen=True)
class FillValues:
    values: dict[str, Any]
    how: dict[str, str]


def fit_fill(df: DataFrame, target: str | None) -> FillValues:
    """Median of numbers (0 if there is none), mode of the rest (``Unknown`` if there is none)."""
    if target is not None:
        require_columns(df, [target])
    names = [c for c in df.columns if c != target]
    nulls = df.agg(*[F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)]).first()
    gaps = [c for c, n in zip(names, nulls) if n]
    numbers = [c for c in gaps if is_numeric(df, c)]
    others = [c for c in gaps if c not in numbers]
    medians = exact_quantiles(df, numbers, [0.5])
    modes = most_frequent(df, others) if others else {}
    values, how = {}, {}
    for c in gaps:
        if c in medians:
            values[c] = 0.0 if medians[c][0] is None else medians[c][0]
            how[c] = f"median ({values[c]})"
        else:
            values[c] = modes.get(c, "Unknown")
            how[c] = f"mode ({values[c]})" if c in modes else "placeholder ('Unknown')"
    return FillValues(values, how)


def apply_fill(df: DataFrame, fill: FillValues) -> DataFrame:
    """Fill gaps; a whole-number column becomes double only for a fractional median."""
    out = []
    for c in df.columns:
        if c not in fill.values:
            out.append(col(c))
            continue
        value, dtype = fill.values[c], df.schema[c].dataType
        if isinstance(value, float):
            whole = isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and value.is_integer()
            to = dtype.simpleString() if whole else "double"
        elif value == "Unknown":
            to = "string"
        else:
            to = dtype.simpleString()
        out.append(F.coalesce(col(c).cast(to), F.lit(value).cast(to)).alias(c))
    return df.select(*out)


def fill_missing(df: DataFrame, target: str | None) -> DataFrame:
    return apply_fill(df, fit_fill(df, target))


def fill_report(df: DataFrame, fill: FillValues) -> DataFrame:
    """``column, method`` per filled column."""
    return local_table(df.sparkSession, list(fill.how.items()), "column string, method string")


def remaining_nulls(df: DataFrame) -> DataFrame:
    total = sum((F.count_if(col(c).isNull()) for c in df.columns[1:]), F.count_if(col(df.columns[0]).isNull()))
    return df.agg(total.alias("remaining_nulls"))


def features_numeric(df: DataFrame, target: str) -> list[str]:
    """The feature names, if all of them are numeric."""
    require_columns(df, [target])
    rest = categorical_columns(df, [target])
    if rest:
        raise ValueError(f"Features must be numbers, but {rest} are not: encode or drop them")
    return numeric_columns(df, [target])
