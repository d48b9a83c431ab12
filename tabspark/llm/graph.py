"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.functions.session import written


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of a task by stars around the least node of each group."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = root(parent.setdefault(a, a) and a), root(parent.setdefault(b, b) and b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    out = [(x, root(x)) for x in parent]
    out = [(x, r) for x, r in out if x != r]
    if out:
        high, low = zip(*out)
        yield pa.record_batch([pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["a", "b"])


def _lowest(links: DataFrame) -> DataFrame:
    """Of every node that has links, the least node among it and its neighbours; written, so that a
    join with it has two plain sides and adaptive execution may split a hot node."""
    return written(links.groupBy("a").agg(F.least("a", F.min("b")).alias("low")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the least node that it reaches.

    Large-star and small-star steps in turn: every node links its larger neighbours, then its smaller
    ones, to the least node it knows, until only stars are left. The number of rounds grows with the
    logarithm of the longest path. Each round is written to the shared folder, so no lineage grows and
    nothing is lost with an executor. Links to oneself and links with a NULL end are ignored.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").mapInArrow(_forest, "a long, b long")
    links = written(links.distinct())  # from here on a > b
    state = _state(links)
    while state[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_lowest(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(large.where("a <> b").distinct())
        down = _lowest(large)  # all links point down, so the least neighbour is the least of all
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.union(down.select("a", F.col("low").alias("b")))
        links = written(small.where("a <> b").distinct())
        before, state = state, _state(links)
        if before == state:
            break
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(links.select("b", "b").distinct())


def key_components(links: DataFrame) -> DataFrame:
    """``components`` for nodes of any ordered type, by DataFrame operations only."""
    both = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    links = written(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(links)
    while state[0]:
        turned = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = turned.join(_lowest(turned), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(large.distinct())
        low = _lowest(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        links = written(small.union(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct())
        before, state = state, _state(links)
        if before == state:
            break
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(links.select("b", "b").distinct())
