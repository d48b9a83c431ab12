"""Exact top-k search by inner product over a vector-approximation file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabspark.functions.session import written

Batches = Iterator[pa.RecordBatch]
CELL_BITS = 6


def _integer(batches: Batches) -> Batches:
    """(id, vector) to (id, dims, exact): floor(256 * x) of each component, as 64-bit integers."""
    for b in batches:
        exact = [np.floor(256.0 * np.array(v, np.float64)).astype("<i8").tobytes() for v in b.column(1).to_pylist()]
        dims = [len(e) // 8 for e in exact]
        yield pa.record_batch([b.column(0), pa.array(dims, pa.int32()), pa.array(exact, pa.binary())], names=["id", "dims", "exact"])


def _ranges(batches: Batches) -> Batches:
    """The lowest and highest value of each place, of the vectors of one task, by length."""
    low: dict[int, np.ndarray] = {}
    high: dict[int, np.ndarray] = {}
    for b in batches:
        for n, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            v = np.frombuffer(e, "<i8")
            low[n] = np.minimum(low[n], v) if n in low else v
            high[n] = np.maximum(high[n], v) if n in high else v
    rows = [(n, i, int(a), int(z)) for n in low for i, (a, z) in enumerate(zip(low[n], high[n]))]
    if rows:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
        yield pa.record_batch(columns, names=["dims", "place", "low", "high"])


Grid = dict[int, tuple[np.ndarray, np.ndarray]]  # by length: lowest value and cell width of each place


def _cells(grid: Grid) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for b in batches:
            cells = []
            for n, e in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                low, width = grid[n]
                cells.append(((np.frombuffer(e, "<i8") - low) // width).astype(np.uint8).tobytes())
            yield pa.record_batch([*b.columns, pa.array(cells, pa.binary())], names=["id", "dims", "exact", "cells"])

    return run


def _bounds(grid: Grid, k: int) -> Callable[[Batches], Batches]:
    """One block of approximations and one of queries to the candidates that the bounds leave.

    An inner product with a query lies within the sum, over places, of the query's value times either
    end of the cell. A row's payload is its cells and a hash of the exact vector. Equal vectors are looked
    at once and give their k + 1 least ids: at most one of those is the query's own, and ties go to
    the smaller ids.
    """

    def group(n: int, queries: list, rows: list) -> Batches:
        low, width = grid[n]
        equal: dict[bytes, list[int]] = {}
        for i, c in rows:
            equal.setdefault(c, []).append(i)
        cells = np.frombuffer(b"".join(equal), np.uint8).reshape(len(equal), n + 8)[:, :n].astype(np.float64)
        ids = [sorted(v)[: k + 1] for v in equal.values()]
        for a in range(0, len(queries), 64):
            part = queries[a : a + 64]
            q = np.stack([np.frombuffer(e, "<i8") for _, e in part]).astype(np.float64)
            base = (q * width) @ cells.T + (q @ low)[:, None]
            lower = base + (np.minimum(q, 0) @ (width - 1))[:, None]
            upper = base + (np.maximum(q, 0) @ (width - 1))[:, None]
            out = []
            for r, (query, _) in enumerate(part):
                order = np.argsort(-lower[r], kind="stable")
                count, floor = 0, -np.inf
                for c in order:  # the kth lower bound that is certain, the query's own row left out
                    count += len(ids[c]) - (query in ids[c])
                    if count >= k:
                        floor = lower[r, c]
                        break
                for c in np.flatnonzero(upper[r] >= floor):
                    out += [(query, i, float(upper[r, c]), float(lower[r, c])) for i in ids[c] if i != query]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["query_id", "id", "upper", "lower"])

    def run(batches: Batches) -> Batches:
        now, queries, rows = None, [], []
        for b in batches:
            for block, dims, role, i, payload in zip(*(b.column(c).to_pylist() for c in range(5))):
                if (block, dims) != now:
                    if queries and rows:
                        yield from group(now[1], queries, rows)
                    now, queries, rows = (block, dims), [], []
                (queries if role == 0 else rows).append((i, payload))
        if queries and rows:
            yield from group(now[1], queries, rows)

    return run


def _scores(batches: Batches) -> Batches:
    for b in batches:
        scores = [
            int(np.frombuffer(x, "<i8") @ np.frombuffer(y, "<i8")) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())
        ]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(scores, pa.int64())], names=["query_id", "vec_id", "score"])


def top_inner_products(
    vectors: DataFrame,
    k: int = 5,
    every: int = 50,
    id: str = "vec_id",
    vector: str = "embedding",
    rows_per_block: int = 4096,
    queries_per_block: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, exactly.

    Components count as floor(256 * x) of x as a double. Queries are the rows whose id is divisible by
    ``every``; candidates are all rows but the query's own; ties go to the smaller id; a query with fewer
    than k candidates has them all. Vectors that are NULL or hold a NULL or a value that is not finite,
    and rows without an id, take no part; only vectors of equal length meet. Rows of one id are one
    vector: equal ones count once, and of different ones the first in order of their values. Scores
    must fit in 64 bits. Other columns are ignored.

    The approximation file has 6 bits a place, a cell of the range that the place has over all rows.
    It is scanned for bounds by pairs of blocks, one of queries and one of approximations, each pair
    a group of its own; a row goes to as many groups as there are blocks of queries. The kth highest
    certain lower bound of a query, over all its blocks, leaves a few candidates; exact vectors are
    read for those with the highest upper bounds first, then for the rest that can still be among
    the k.
    """
    value = F.col(vector)
    given = vectors.select(F.col(id).cast("long").alias("id"), value.cast("array<double>").alias("v"))
    given = given.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    given = given.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    exact = given.mapInArrow(_integer, "id long, dims int, exact binary")
    exact = written(exact.groupBy("id").agg(F.min(F.struct("dims", "exact")).alias("x")).select("id", "x.dims", "x.exact"))
    ends = exact.select("dims", "exact").mapInArrow(_ranges, "dims int, place int, low long, high long")
    ends = ends.groupBy("dims", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    grid: Grid = {}
    spans: dict[int, list[tuple[int, int]]] = {}
    for row in ends.orderBy("dims", "place").collect():  # as long as the vectors are
        spans.setdefault(row["dims"], []).append((row["low"], row["high"]))
    for n, span in spans.items():
        low, high = np.array(span, np.int64).T
        grid[n] = (low, np.maximum(1, -(-(high - low + 1) // (1 << CELL_BITS))))
    grid[0] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    file = written(exact.mapInArrow(_cells(grid), "id long, dims int, exact binary, cells binary"))

    asked = file.where(F.col("id") % every == 0)
    n_rows, n_queries = file.count(), asked.count()
    row_blocks, query_blocks = -(-n_rows // rows_per_block) or 1, -(-n_queries // queries_per_block) or 1

    def place(blocks: int) -> F.Column:
        return F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long")

    def all_of(blocks: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))

    pair = (F.col("qb") * row_blocks + F.col("rb")).alias("block")
    q = asked.withColumn("qb", place(query_blocks)).withColumn("rb", all_of(row_blocks))
    r = file.withColumn("rb", place(row_blocks)).withColumn("qb", all_of(query_blocks))
    q = q.select(pair, "dims", F.lit(0).alias("role"), "id", F.col("exact").alias("payload"))
    r = r.select(pair, "dims", F.lit(1).alias("role"), "id", F.concat("cells", F.to_binary(F.lpad(F.hex(F.xxhash64("exact")), 16, "0"), F.lit("hex"))).alias("payload"))
    blocks = q.union(r).repartition("block").sortWithinPartitions("block", "dims", "role")
    left = written(blocks.mapInArrow(_bounds(grid, k), "query_id long, id long, upper double, lower double"))

    def best(column: str) -> F.Window:
        return Window.partitionBy("query_id").orderBy(F.col(column).desc(), "id")

    def kth(rows: DataFrame, column: str) -> DataFrame:
        ranked = rows.withColumn("_r", F.row_number().over(best(column))).where(F.col("_r") <= k)
        return ranked.groupBy("query_id").agg(F.when(F.count("*") == k, F.min(column)).alias("floor"))

    def read(pairs: DataFrame) -> DataFrame:
        vector_of = file.select("id", "exact")
        both = pairs.select("query_id", "id").join(vector_of, "id")
        own = vector_of.select(F.col("id").alias("query_id"), F.col("exact").alias("own"))
        return both.join(own, "query_id").select("query_id", "id", "own", "exact").mapInArrow(_scores, "query_id long, vec_id long, score long")

    possible = left.join(written(kth(left, "lower")), "query_id").where("floor IS NULL OR upper >= floor")
    ranked = written(possible.withColumn("_r", F.row_number().over(best("upper"))).select("query_id", "id", "upper", "_r"))
    first = written(read(ranked.where(F.col("_r") <= k)))
    floors = written(first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")))
    rest = ranked.where(F.col("_r") > k).join(floors, "query_id").where((F.col("n") < k) | (F.col("upper") >= F.col("floor")))
    scored = first.union(read(rest))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
