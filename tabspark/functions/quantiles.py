"""Exact quantiles from histograms that are refined around the wanted ranks.

A round counts rows by (range, cell) with an ordinary aggregate: map-side first, spread over all reducers
after. Cells are an order-preserving map of the values of a range, so the counts tell in which cell each
wanted rank lies, and only that cell is looked at in the next round. No map of values and no sketch of a
whole column is ever put together in one place, and every round is one scan for all columns and ranks.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import as_double, chunks, col
from .session import join_groups, written

CELLS = 1024
VALUE_ROWS = 4096
SKETCH_ACCURACY = 10_000
SKETCH_MARGIN = 4 / SKETCH_ACCURACY
COLUMNS_PER_JOB = 30


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], small: int | None = None
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column over its non-null values, ``None`` if it has none.

    Ranges of at most ``small`` rows are counted value by value instead of by cells.
    """
    narrow = df.select(*[as_double(c).alias(f"v{i}") for i, c in enumerate(columns)])
    found: dict[str, list[float | None]] = {}
    for part in chunks(narrow.columns, COLUMNS_PER_JOB):
        found.update(_refined(narrow.select(*part), probs, VALUE_ROWS if small is None else small))
    return {c: found[f"v{i}"] for i, c in enumerate(columns)}


def range_ends(df: DataFrame, columns: list[str], per_range: int, most: int = 1_000) -> list[list[float]]:
    """Upper ends of all but the last of equally filled ranges of each column; none for a short table."""
    n_ranges = min(most, df.count() // per_range)
    if n_ranges < 2:
        return [[] for _ in columns]
    found = exact_quantiles(df, columns, [i / n_ranges for i in range(1, n_ranges)])
    return [sorted({e for e in found[c] if e is not None}) for c in columns]


def range_number(ends: list[list[float]], column: Column, x: Column) -> Column:
    """The range that ``x`` lies in among the ends of the column of that number."""
    held = F.from_json(F.lit(json.dumps(ends)), "array<array<double>>")
    return F.size(F.filter(F.get(held, column), lambda e: e < x))


@dataclass
class _Range:
    """The rows of a column from one value to another, how many lie below them, and the 0-based ranks wanted among them."""

    column: str
    low: float
    high: float
    rows: int
    below: int
    turn: int = 0
    ranks: list[int] = field(default_factory=list)

    def cell(self) -> Column:
        """A number that never falls as the value grows.

        Even rounds cut the range into equal widths. Odd rounds cut it by magnitude, so that values of
        very different size cannot share one cell for long; a range on both sides of 0 is cut there.
        """
        x, low, high = F.col(self.column), self.low, self.high
        if self.turn % 2 and low < 0 < high:
            return F.signum(x)
        if self.turn % 2 and low > 0 and high / low > 4:
            return self._steps(F.log2(x), math.log2(low), math.log2(high))
        if self.turn % 2 and high < 0 and low / high > 4:
            return self._steps(-F.log2(-x), -math.log2(-low), -math.log2(-high))
        return self._steps(x, low, high)

    @staticmethod
    def _steps(x: Column, low: float, high: float) -> Column:
        half = 0.5 if math.isinf(high - low) else 1.0
        width = high * half - low * half
        return F.floor((x * half - low * half) / F.lit(width) * CELLS).cast("double") if width else F.lit(0.0)


def _refined(df: DataFrame, probs: list[float], small: int) -> dict[str, list[float | None]]:
    def tally(c: str) -> list[Column]:
        x, inf = col(c), float("inf")
        finite = F.when((x > -inf) & (x < inf), x)
        return [F.count(x), F.count_if(x == -inf), F.count(finite), F.min(finite), F.max(finite)]

    ends = df.agg(*[t.alias(f"t{i}_{c}") for c in df.columns for i, t in enumerate(tally(c))]).first()
    counts: dict[str, int] = {}
    found: dict[tuple[str, int], float] = {}
    ranges: list[_Range] = []
    for i, c in enumerate(df.columns):
        n, least, finite, low, high = ends[5 * i : 5 * i + 5]
        counts[c] = n
        whole = _Range(c, low, high, finite, least) if finite else None
        for k in sorted({k for p in probs for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))} if n else ()):
            if k < least or k >= least + finite:
                found[c, k] = -math.inf if k < least else math.inf
            else:
                whole.ranks.append(k)
        if whole and whole.ranks:
            ranges.append(whole)
    while ranges:
        ranges = _round(df, ranges, small, found)

    def quantile(c: str, p: float) -> float | None:
        at = p * (counts[c] - 1)
        low, high = found[c, math.floor(at)], found[c, math.ceil(at)]
        return low if low == high else low + (high - low) * (at - math.floor(at))

    return {c: [quantile(c, p) if counts[c] else None for p in probs] for c in df.columns}


def _round(df: DataFrame, ranges: list[_Range], small: int, found: dict[tuple[str, int], float]) -> list[_Range]:
    """Count the cells of all ranges in one scan; the ranges that are left, smaller ones."""
    of_column: dict[str, list[tuple[int, _Range]]] = defaultdict(list)
    for i, r in enumerate(ranges):
        of_column[r.column].append((i, r))
    entries = []
    for c, own in of_column.items():
        x, entry = F.col(c), F.lit(None).cast("struct<i:int,k:double,x:double>")
        for i, r in own:
            cell = x if r.rows <= small else r.cell()
            inside = x.between(F.lit(r.low), F.lit(r.high))
            entry = F.when(inside, F.struct(F.lit(i).alias("i"), cell.alias("k"), x.alias("x"))).otherwise(entry)
        entries.append(entry)
    rows = df.select(F.explode(F.array(*entries)).alias("e")).where("e IS NOT NULL").select("e.*")
    cells = rows.groupBy("i", "k").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    seen: dict[int, list] = defaultdict(list)
    for c in cells:
        seen[c["i"]].append(c)
    left: list[_Range] = []
    for i, r in enumerate(ranges):
        at, wanted = r.below, iter(sorted(r.ranks))
        k = next(wanted, None)
        for c in sorted(seen[i], key=lambda c: c["low"]):
            inner = _Range(r.column, c["low"], c["high"], c["n"], at, r.turn + 1)
            at += c["n"]
            while k is not None and k < at:
                if c["low"] == c["high"]:
                    found[r.column, k] = c["low"]
                else:
                    inner.ranks.append(k)
                k = next(wanted, None)
            if inner.ranks:
                left.append(inner)
            if k is None:
                break
    return left


def grouped_median(df: DataFrame, group: str, value: str, out: str, few_groups: bool = False) -> DataFrame:
    """Exact median of ``value`` per non-null ``group``: one row per group, columns ``group, out``.

    A sketch per group brackets the middle; rows are then counted per value inside the bracket, and
    everything below it collapses into one count, so a group holding much of the table is merged
    map-side and only a sliver of its distinct values is ever ordered. ``few_groups`` says that the
    caller has checked that one row per group can be broadcast; otherwise only frequent groups are.
    """
    g, v = col(group), as_double(value)
    base = df.select(g.alias("_g"), v.alias("_v")).where(F.col("_g").isNotNull() & F.col("_v").isNotNull())
    around = F.array(F.lit(0.5 - SKETCH_MARGIN), F.lit(0.5 + SKETCH_MARGIN))
    brackets = base.groupBy("_g").agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", around, SKETCH_ACCURACY).alias("_b")
    )
    brackets = brackets.select(
        "_g", "_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi")
    )
    # Small groups: the sketch ends may fall between the two middle values, so take the whole group.
    tiny = F.col("_n") <= SKETCH_ACCURACY
    brackets = brackets.select(
        "_g",
        "_n",
        F.when(~tiny, F.col("_lo")).alias("_lo"),
        F.when(~tiny, F.col("_hi")).alias("_hi"),
    )
    brackets = brackets.withColumnRenamed("_g", "_k")
    if few_groups:
        near = base.join(F.broadcast(brackets), F.col("_g") == F.col("_k"))
    else:
        near = join_groups(base, "_g", written(brackets), "_k", "_n")
    near = near.where(F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))
    counted = near.groupBy(
        "_g",
        "_n",
        F.when(F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo")), F.col("_v")).alias("_v"),
    ).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(
        Window.partitionBy("_g").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = counted.select("_g", "_n", "_v", upto.alias("_upto"))
    low = F.floor((F.col("_n") - 1) / 2)
    high = F.floor(F.col("_n") / 2)
    picked = ranked.groupBy("_g").agg(
        F.min(F.when(F.col("_upto") > low, F.struct("_upto", "_v"))).alias("_a"),
        F.min(F.when(F.col("_upto") > high, F.struct("_upto", "_v"))).alias("_b"),
    )
    missed = F.col("_a")["_v"].isNull() | F.col("_b")["_v"].isNull()
    median = (F.col("_a")["_v"] + F.col("_b")["_v"]) / 2
    return picked.select(
        F.col("_g").alias(group),
        F.when(missed, F.raise_error(F.lit("median outside its sketch bracket"))).otherwise(median).cast("double").alias(out),
    )
