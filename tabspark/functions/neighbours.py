"""Mutual information of numbers and classes by nearest neighbours, without comparing rows with rows.

For each row the distance to the k-th nearest row of its class, then the rows of any class within it. Rows are
first counted by (feature, value, class). Distinct values are numbered in order by range: whole ranges are added
up to offsets, so no task orders more than one range. Numbered values are dealt out in chunks that also hold the
k values beyond either border, so the neighbours of every value lie in its chunk. Rows within a distance are two
running counts, of the values and the ends asked for, in one order.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import range_ends, range_number
from .session import written

ROWS_PER_RANGE = 1_000_000
CHUNK = 100_000
SHIFT = 8


def digamma(n: Column) -> Column:
    """The digamma function of whole numbers from 1 on, to about 14 digits: a series eight steps on."""
    z = n.cast("double") + SHIFT
    steps = functools.reduce(operator.add, [1 / (n.cast("double") + i) for i in range(SHIFT)])
    z2 = 1 / (z * z)
    series = z2 * (F.lit(1 / 12) - z2 * (F.lit(1 / 120) - z2 * (F.lit(1 / 252) - z2 * (F.lit(1 / 240) - z2 / 132))))
    return F.ln(z) - 1 / (2 * z) - series - steps


def _running(df: DataFrame, part: list[str], order: list[str], value: Column) -> DataFrame:
    """Add ``upto``: the running sum of ``value`` over ``order`` in each ``part``, through all ranges ``b``."""
    valued = df.withColumn("_add", value)
    along = Window.partitionBy(*part).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = valued.groupBy(*part, "b").agg(F.sum("_add").alias("_sum"))
    offsets = offsets.select(*part, "b", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*part, "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = valued.join(offsets, [*part, "b"])
    return joined.withColumn("upto", F.col("_before") + F.sum("_add").over(inside)).drop("_add", "_before")


def _reach(numbered: DataFrame, k: int) -> DataFrame:
    """Per (feature, class, value): ``among`` neighbours of its class as near as the k-th, and the ends ``low`` and ``high``."""
    number = F.col("upto") - 1
    home = F.floor(number / CHUNK)
    into = F.array_distinct(F.array(home, F.floor((number - k) / CHUNK), F.floor((number + k) / CHUNK)))
    dealt = numbered.withColumn("home", home).withColumn("chunk", F.explode(into))
    order = Window.partitionBy("f", "y", "chunk").orderBy("upto")
    v = F.col("v")
    near = [F.struct(F.lit(0.0).alias("d"), (F.col("c") - 1).alias("c"), v.alias("v"))]
    for move in [i for i in range(-k, k + 1) if i]:
        there = F.lag("v", -move).over(order)
        near.append(F.struct(F.abs(there - v).alias("d"), F.lag("c", -move).over(order).alias("c"), there.alias("v")))
    nearest = dealt.withColumn("near", F.array(*near)).where("home = chunk")
    known = F.array_sort(F.filter("near", lambda x: x["v"].isNotNull()))
    want = F.least(F.lit(k).cast("long"), F.col("size") - 1)

    def further(state: Column, x: Column) -> Column:
        enough = state["n"] >= want
        return F.struct(F.when(enough, state["n"]).otherwise(state["n"] + x["c"]).alias("n"), F.when(enough, state["d"]).otherwise(x["d"]).alias("d"))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d"))
    reached = nearest.withColumn("near", known).withColumn("r", F.aggregate("near", start, further)["d"])
    inside = F.filter("near", lambda x: x["d"] <= F.col("r"))
    return reached.select(
        "f", "y", "v", "c", "size",
        F.aggregate(inside, F.lit(0).cast("long"), lambda n, x: n + x["c"]).alias("among"),
        F.least(v - F.col("r"), F.array_min(F.transform(inside, lambda x: x["v"]))).alias("low"),
        F.greatest(v + F.col("r"), F.array_max(F.transform(inside, lambda x: x["v"]))).alias("high"),
    )


def mutual_info_neighbours(df: DataFrame, target: str, names: list[str], k: int = 3) -> DataFrame:
    """``feature, score``: digamma(N) + mean(digamma(k) - digamma(rows of the class) - digamma(m)), at least 0.

    ``m`` are the other rows within the distance of the k-th neighbour of a row's own class (from v - r to v + r,
    ends included). Among equal distances all count, in k as well: no noise is added to tell them apart, and a
    feature of few values scores as it would by its counts. Classes of one row take no part. Features have no nulls.
    """
    x = df.select(F.col(target).alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    sizes = x.groupBy("y").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    ends = range_ends(x, [f"x{i}" for i in range(len(names))], ROWS_PER_RANGE)
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"x{i}").alias("v")) for i in range(len(names))])
    counted = x.select("y", F.inline(cells)).groupBy("f", "v", "y").agg(F.count(F.lit(1)).alias("c"))
    points = written(counted.join(sizes, "y").withColumn("b", range_number(ends, F.col("f"), F.col("v"))))
    reach = written(_reach(_running(points, ["f", "y"], ["v"], F.lit(1).cast("long")), k))
    asked = [
        reach.select("f", F.col(end).alias("at"), F.lit(turn).alias("turn"), F.lit(0).cast("long").alias("rows"), "y", "v", F.lit(sign).alias("sign"))
        for end, turn, sign in (("low", 0, -1), ("high", 2, 1))
    ]
    held = points.groupBy("f", "v").agg(F.sum("c").alias("rows")).select(
        "f", F.col("v").alias("at"), F.lit(1).alias("turn"), "rows", F.lit(None).cast(x.schema["y"].dataType).alias("y"), "v", F.lit(0).alias("sign")
    )
    both = held.unionByName(asked[0]).unionByName(asked[1]).withColumn("b", range_number(ends, F.col("f"), F.col("at")))
    placed = _running(both, ["f"], ["at", "turn"], F.col("rows")).where("sign <> 0")
    within = placed.groupBy("f", "y", "v").agg((F.sum(F.col("sign") * F.col("upto")) - 1).alias("m"))
    # Both sides have a row a value and grow with the table, so neither goes through the driver.
    rows = reach.join(within.hint("merge"), ["f", "y", "v"])
    gain = F.col("c") * (digamma(F.col("among")) - digamma(F.col("size")) - digamma(F.col("m")))
    found = rows.groupBy("f").agg(F.sum(gain).alias("gain"), F.sum("c").alias("n"))
    score = F.greatest(digamma(F.col("n")) + F.col("gain") / F.col("n"), F.lit(0.0))
    label = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("f") + 1)
    return found.select(label.alias("feature"), score.alias("score"))
