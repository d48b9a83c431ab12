"""Keeping, dropping and sampling rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, col, numeric_columns, require_columns
from ..functions.ordering import SEED, chunk_number, first_rows, hash_cuts, part_sizes
from ..functions.session import small_side
from .profiling import outlier_bounds

CONDITIONS = [
    "eq", "neq", "gt", "gte", "lt", "lte",
    "contains", "not_contains", "isin", "notin", "isnull", "notnull",
]


def _matches(name: str, value: Any) -> Column:
    return F.coalesce(col(name).cast("string").rlike(str(value)), F.lit(False))


def _member(name: str, value: Any) -> Column:
    present = [v for v in value if v is not None]
    found = F.coalesce(col(name).isin(present), F.lit(False)) if present else F.lit(False)
    return found | col(name).isNull() if len(present) < len(value) else found


def condition(name: str, kind: str, value: Any = None) -> Column:
    """The filter expression. A missing cell passes the negative conditions and no other."""
    if kind not in CONDITIONS:
        raise ValueError(f"condition={kind!r} is none of {CONDITIONS}")
    if kind == "isnull":
        return col(name).isNull()
    if kind == "notnull":
        return col(name).isNotNull()
    if value is None:
        raise ValueError(f"condition={kind!r} compares with a value: pass one")
    if kind in ("isin", "notin"):
        if isinstance(value, (str, bytes)) or not isinstance(value, Sequence):
            raise ValueError(f"'{kind}' needs a list of values")
        return _member(name, value) if kind == "isin" else ~_member(name, value)
    if kind == "contains":
        return _matches(name, value)
    if kind == "not_contains":
        return ~_matches(name, value)
    x, v = col(name), F.lit(value)
    if kind == "eq":
        return x == v
    if kind == "neq":
        return ~x.eqNullSafe(v)
    if kind == "gt":
        return x > v
    if kind == "gte":
        return x >= v
    if kind == "lt":
        return x < v
    return x <= v


def filter_rows(df: DataFrame, column: str, kind: str, value: Any = None) -> DataFrame:
    """Keep rows that meet one of the conditions; ``contains`` searches a regular expression."""
    require_columns(df, [column])
    return df.where(condition(column, kind, value))


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    require_columns(df, [target])
    return df.where(col(target).isNotNull())


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of equal rows, nulls equal; copies are merged before the shuffle."""
    return df.dropDuplicates()


def inside_bounds(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    keep = F.lit(True)
    for c, (lo, hi) in bounds.items():
        # A column without a single value has no bounds; comparing with none keeps nothing.
        keep = keep & (as_double(c).between(F.lit(lo), F.lit(hi)) if lo is not None else F.lit(False))
    return df.where(keep)


def remove_outliers(df: DataFrame, target: str) -> DataFrame:
    """Keep rows inside the IQR bounds of every numeric feature; a missing feature drops the row.

    ``detect_outliers`` does not count missing values, this drops them: both as specified.
    """
    require_columns(df, [target])
    return inside_bounds(df, outlier_bounds(df, numeric_columns(df, [target])))


def subsample(
    df: DataFrame,
    n_rows: int = 30_000,
    keys: Sequence[str] | None = None,
    stratify: str | None = None,
    seed: int = SEED,
) -> DataFrame:
    """The table itself up to ``n_rows`` rows, else a sample in hash order of the row key.

    Plain: exactly ``n_rows``. Stratified: each stratum's proportional share, rounded half to even;
    rows without a stratum are left out. Only cut points are computed; no row is moved.
    """
    total = df.count()
    if total <= n_rows:
        return df
    keys = list(keys or df.columns)
    if not stratify or stratify not in df.columns:
        return first_rows(df, n_rows, keys, seed, total)
    share = F.bround(F.lit(float(n_rows)) * F.col("n") / F.lit(float(total)), 0).cast("long")
    ranks = part_sizes(df, stratify).select("part", "n", F.lit(0).alias("cut"), share.alias("rank"))
    cuts = hash_cuts(df, stratify, keys, ranks, seed)
    return chunk_number(df, stratify, keys, cuts, "_chunk", seed).where(F.col("_chunk") == 0).drop("_chunk")


def semi_filter(df: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``kept``; a missing key matches a missing key."""
    require_columns(df, [key])
    require_columns(kept, [key])
    wanted = small_side(kept.select(col(key).alias("_kept_key")).distinct())
    return df.join(wanted, col(key).eqNullSafe(F.col("_kept_key")), "left_semi")


def subsample_related(
    df: DataFrame, related: dict[str, DataFrame], key: str, n_rows: int = 30_000, **options
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Sample ``df`` and cut the related tables to the keys that are left."""
    require_columns(df, [key])
    for other in related.values():
        require_columns(other, [key])
    if df.count() <= n_rows:
        return df, related
    sampled = subsample(df, n_rows, **options)
    return sampled, {name: semi_filter(other, sampled, key) for name, other in related.items()}
