"""Aggregate expressions that stay inside one scan, and reshaping of one-row aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import as_double, chunks

Batches = Iterator[pa.RecordBatch]

PAIRS_PER_JOB = 10
BLOCK_VALUES = 1 << 21
FIRST_ROWS = 1_000
FAR_OFF = 1e-3
ROUNDING = 1e-9


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, NULL where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct(part: Column, whole: Column) -> Column:
    return F.round(ratio(part * 100, whole), 2)


def rounded(x: float | None, digits: int = 4) -> float | None:
    """Half up, on the shortest decimal form, as Spark's ``round`` does it."""
    if x is None or not math.isfinite(x):
        return x
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0


def corr(x: str, y: str) -> Column:
    """Pearson correlation over the rows where both are present; NULL when either is constant."""
    a, b = as_double(x), as_double(y)
    spread = F.sqrt(F.var_pop(F.when(b.isNotNull(), a))) * F.sqrt(F.var_pop(F.when(a.isNotNull(), b)))
    return F.try_divide(F.covar_pop(a, b), spread)


def _block_products(centre: np.ndarray, scale: np.ndarray) -> Callable[[Batches], Batches]:
    """Columns to the numbered rows of a task's sums of products of all elements; then their least and greatest values."""

    def run(batches: Batches) -> Batches:
        n = len(centre)
        width = 3 * n + 1
        sums, step = np.zeros((width, width)), max(1, BLOCK_VALUES // width)
        ends = np.stack([np.full(n, np.inf), np.full(n, -np.inf)])
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                columns = batch.slice(start, step).columns
                there = np.stack([pc.is_valid(c).to_numpy(zero_copy_only=False) for c in columns])
                x = np.stack([pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in columns])
                ends[0] = np.minimum(ends[0], np.where(there, x, np.inf).min(axis=1))
                ends[1] = np.maximum(ends[1], np.where(there, x, -np.inf).max(axis=1))
                z = np.where(there, (x - centre[:, None]) / scale[:, None], 0.0)
                block = np.concatenate([z, np.ones((1, z.shape[1])), there.astype(np.float64), z * z])
                sums += block @ block.T
        rows = [*sums, ends[0], ends[1]]
        yield pa.record_batch([pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["i", "v"])

    return run


def _added(n: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        i = table.column("i")[0].as_py()
        parts = np.stack([np.frombuffer(v.as_py()) for v in table.column("v")])
        total = parts.sum(axis=0) if i <= 3 * n else (parts.min(axis=0) if i == 3 * n + 1 else parts.max(axis=0))
        return pa.table({"i": pa.array([i], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})

    return run


def products(x: DataFrame, centre: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In one scan, sums of the products of every two elements: the columns less ``centre`` by ``scale`` (0 where
    missing), a one, flags for the columns' presence and their squares; and the least and greatest value of every column.

    A task multiplies blocks of rows as matrices and gives one matrix, whose rows are added up apart from each other.
    """
    n = len(centre)
    found = x.mapInArrow(_block_products(centre, scale), "i int, v binary").groupBy("i").applyInArrow(_added(n), "i int, v binary").toArrow()
    sums, ends = np.zeros((3 * n + 1, 3 * n + 1)), np.stack([np.full(n, np.inf), np.full(n, -np.inf)])
    for i, v in zip(found.column("i").to_pylist(), found.column("v").to_pylist()):
        out, at = (sums, i) if i <= 3 * n else (ends, i - 3 * n - 1)
        out[at] = np.frombuffer(v)
    return sums, ends


def corr_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Pearson correlation of each pair over the rows where both are present; None if one is constant.

    One scan for any number of pairs adds up all products of the values, a one, flags for presence and squares;
    values are taken about the means of some first rows, in their spreads. Where those are far off, a second scan
    takes the means and spreads that the first one found. Pairs whose spread could drown in rounding are computed
    once more by central moments.
    """
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    if not pairs:
        return {}
    x = df.select(*[as_double(c).alias(f"x{i}") for i, c in enumerate(names)])
    some = x.limit(FIRST_ROWS).agg(*[f(c) for c in x.columns for f in (F.avg, F.stddev_pop)]).first()
    some = np.array([0.0 if v is None or not math.isfinite(v) else v for v in some])
    centre, scale = some[::2], np.where(some[1::2] > 0, some[1::2], 1.0)
    one = len(names)
    for last in (False, True):
        sums, ends = products(x, centre, scale)
        n = np.maximum(np.diag(sums)[one + 1 : 2 * one + 1], 1.0)
        mean, mass = sums[:one, one] / n, np.diag(sums)[:one] / n
        spread = mass - mean * mean
        off = (ends[0] < ends[1]) & np.isfinite(mass) & (spread < FAR_OFF * mass)
        if last or not off.any():
            break
        centre, scale = np.where(off, centre + mean * scale, centre), np.where(off, scale * np.sqrt(np.maximum(spread, ROUNDING * mass)), scale)
    at = {c: i for i, c in enumerate(names)}
    flat = {c for c, i in at.items() if ends[0][i] >= ends[1][i]}
    out: dict[tuple[str, str], float | None] = {pair: None for pair in pairs}
    live = [(a, b) for a, b in pairs if a not in flat and b not in flat]
    present = {c: one + 1 + i for c, i in at.items()}
    squared = 2 * one + 1

    unsure = []
    for a, b in live:
        n = sums[present[a], present[b]]
        if not n:
            continue
        ma, mb = sums[at[a], present[b]] / n, sums[at[b], present[a]] / n
        qa, qb = (sums[squared + at[c], present[d]] / n for c, d in ((a, b), (b, a)))
        va, vb = qa - ma * ma, qb - mb * mb
        if va <= ROUNDING * qa or vb <= ROUNDING * qb:
            unsure.append((a, b))
        else:
            out[a, b] = float(max(-1.0, min(1.0, (sums[at[a], at[b]] / n - ma * mb) / math.sqrt(va * vb))))
    for part in chunks(unsure, PAIRS_PER_JOB):
        out.update(zip(part, df.agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(part)]).first()))
    return out


def upper_pairs(columns: list[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


def skew(x: Column) -> Column:
    """Bias-corrected sample skewness; NULL below three values, 0 for a constant."""
    n = F.count(x).cast("double")
    corrected = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(F.var_pop(x) <= 0, 0.0).otherwise(corrected)


def long_report(one_row: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into one output row per entry of ``rows``, without a second scan."""
    structs = [F.struct(*[value.alias(name) for name, value in r.items()]) for r in rows]
    return one_row.select(F.inline(F.array(*structs)))


def iqr_bounds(q1: float | None, q3: float | None, k: float = 1.5) -> tuple[float | None, float | None]:
    if q1 is None or q3 is None:
        return None, None
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)
