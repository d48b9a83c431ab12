"""Merging two tables on key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import require_columns
from ..functions.session import small_side, written
from .profiling import stage_summary

KINDS = ["inner", "left", "right", "outer"]
HOT_PAIRS = 1_000_000
BLOCK_ROWS = 1_000


def merge_tables(
    left: DataFrame,
    right: DataFrame,
    on: str | list[str] | None = None,
    left_on: str | list[str] | None = None,
    right_on: str | list[str] | None = None,
    how: str = "inner",
) -> DataFrame:
    """Equi-join in which missing keys match each other.

    Without a key the first common column, in left order, is used. Other columns the tables share get
    ``_x`` and ``_y``. A key named by ``on`` appears once; keys of different names both stay. An outer
    join is a left join plus the right rows without a partner: both parts may be broadcast or have
    skewed partitions split by adaptive execution, which a full outer join may not. Keys that make many
    pairs, as missing ones do, are counted first and joined block by block, so no task makes all pairs of
    one; streams are joined as they are.
    """
    if how not in KINDS:
        raise ValueError(f"how={how!r} is none of {KINDS}")
    if on is None and left_on is None and right_on is None:
        common = [c for c in left.columns if c in right.columns]
        if not common:
            raise ValueError("The tables share no column name to join on: pass on, or left_on with right_on")
        on = common[0]
    if on is None and (left_on is None or right_on is None):
        raise ValueError("Give both 'left_on' and 'right_on'.")
    lk, rk = _names(left_on if on is None else on), _names(right_on if on is None else on)
    if len(lk) != len(rk):
        raise ValueError("'left_on' and 'right_on' need the same number of columns")
    require_columns(left, lk)
    require_columns(right, rk)

    shared_keys = [a for a, b in zip(lk, rk) if a == b]
    overlap = {c for c in left.columns if c in right.columns and c not in shared_keys}
    a = left.toDF(*[f"l{i}" for i in range(len(left.columns))])
    b = right.toDF(*[f"r{i}" for i in range(len(right.columns))])
    l_at = {c: f"l{i}" for i, c in enumerate(left.columns)}
    r_at = {c: f"r{i}" for i, c in enumerate(right.columns)}
    on_left, on_right = [l_at[x] for x in lk], [r_at[y] for y in rk]
    match = _equal(on_left, on_right)

    pairs = None
    if not a.isStreaming and not b.isStreaming:
        hot = _hot_keys(a, b, on_left, on_right)
        if hot is not None:
            pairs = _block_pairs(a, b, on_left, on_right, hot)
            held = small_side(hot.select(*_key_names(lk)))
            a = a.join(held, _equal(on_left, held.columns), "left_anti")
            b = b.join(held, _equal(on_right, held.columns), "left_anti")
    if how == "outer":
        lonely = b.join(a, match, "left_anti")
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in a.schema.fields]
        joined = a.join(b, match, "left").unionByName(lonely.select(*empty, *[F.col(c) for c in b.columns]))
    else:
        joined = a.join(b, match, how)
    if pairs is not None:
        joined = joined.unionByName(pairs)

    out = []
    for c in left.columns:
        if c in shared_keys:
            out.append(F.coalesce(F.col(l_at[c]), F.col(r_at[c])).alias(c))
        else:
            out.append(F.col(l_at[c]).alias(f"{c}_x" if c in overlap else c))
    for c in right.columns:
        if c not in shared_keys:
            out.append(F.col(r_at[c]).alias(f"{c}_y" if c in overlap else c))
    return joined.select(*out)


def _key_names(keys: list[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(keys))]


def _equal(left: list[str], right: list[str]) -> Column:
    match = F.lit(True)
    for x, y in zip(left, right):
        match = match & F.col(x).eqNullSafe(F.col(y))
    return match


def _hot_keys(a: DataFrame, b: DataFrame, on_left: list[str], on_right: list[str]) -> DataFrame | None:
    """Keys of more than ``HOT_PAIRS`` pairs with a number of their own and the blocks of rows on either side; None if there are none."""
    keys = _key_names(on_left)
    here = a.groupBy(*[F.col(c).alias(k) for k, c in zip(keys, on_left)]).agg(F.count(F.lit(1)).alias("_nl"))
    there = b.groupBy(*[F.col(c).alias(f"{k}r") for k, c in zip(keys, on_right)]).agg(F.count(F.lit(1)).alias("_nr"))
    both = here.join(there, _equal(keys, [f"{k}r" for k in keys]))
    blocks = [F.ceil(F.col(n) / BLOCK_ROWS).alias(g) for n, g in (("_nl", "_gl"), ("_nr", "_gr"))]
    hot = written(both.where(F.col("_nl").cast("double") * F.col("_nr") > HOT_PAIRS).select(*keys, *blocks))
    return None if hot.isEmpty() else written(hot.withColumn("_key", F.monotonically_increasing_id()))


def _block_pairs(a: DataFrame, b: DataFrame, on_left: list[str], on_right: list[str], hot: DataFrame) -> DataFrame:
    """All pairs of the rows of hot keys. Rows are dealt to blocks by their place, and a block of either side
    meets every block of the other in a cell of its own."""
    held = small_side(hot)
    cell = ["_key", "_i", "_j"]
    n_tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = []
    for df, on, own, other in ((a, on_left, ("_gl", "_i"), ("_gr", "_j")), (b, on_right, ("_gr", "_j"), ("_gl", "_i"))):
        rows = df.join(held, _equal(on, _key_names(on))).select(*df.columns, "_key", "_gl", "_gr")
        # Written, so that a row keeps its place when a task runs again.
        placed = written(rows).withColumn(own[1], F.pmod(F.monotonically_increasing_id(), F.col(own[0])))
        copies = placed.withColumn(other[1], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other[0]) - 1)))
        sides.append(copies.select(*df.columns, *cell).repartition(n_tasks, *cell))
    return sides[0].join(sides[1], cell).drop(*cell)


def _names(key: str | list[str] | None) -> list[str]:
    return [key] if isinstance(key, str) else list(key or [])


def merge_shapes(left: DataFrame, right: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows and columns before and after."""
    return stage_summary({"left": left, "right": right, "merged": merged})


