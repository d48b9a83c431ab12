"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.functions.session import written

HASH_BITS = 60
STEP = 6


def shard_hash(id: str, text: str) -> str:
    """SQL for 60 hash bits of a document: of its id and of its text, so a repeated id still spreads."""
    return f"CAST(conv(substr(md5(concat(coalesce(CAST({id} AS string), ''), '|', coalesce({text}, ''))), 1, 15), 16, 10) AS long)"


def extendible_shards(docs: DataFrame, limit: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The given rows with (shard, shard_depth, n_bytes, shard_bytes, oversize).

    A directory indexed by leading hash bits starts as one bucket. Only a bucket of more than ``limit``
    bytes splits, on the next bit, until every bucket fits; a bucket is a shard, named by its bits.
    The bytes of a document are those of its text in UTF-8 (NULL: 0).

    The directory stays a table. A round adds up the bytes of the rows in oversized buckets by their next
    six bits (merged map-side, so no bucket's rows meet in a task), and reads off where each of the
    finer buckets stops splitting; rows of finished buckets take no further part. A document larger
    than the limit has a shard of its own, or one with documents of its very hash; rows that are equal
    in id and text have equal hashes and cannot be parted. Such shards are marked ``oversize``.
    Columns of the given table with the names of the new ones are replaced. An empty table gives none.
    """
    new = ["shard", "shard_depth", "n_bytes", "shard_bytes", "oversize"]
    given = docs.drop(*new)
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    hashed = F.expr(shard_hash(f"`{id}`", f"`{text}`"))
    cells = written(given.select(hashed.alias("h"), size.alias("b")).groupBy("h").agg(F.sum("b").alias("b")))
    total = cells.agg(F.sum("b")).first()[0] or 0
    spark = docs.sparkSession
    root = "SELECT '' AS shard, 0 AS shard_depth, CAST({} AS long) AS shard_bytes"
    if total <= limit:
        directory, leaves = spark.sql(root.format(total)), []
    else:
        directory, leaves = None, []
        open_cells, depth = cells, 0
        while depth < HASH_BITS:
            directory, open_cells = _split(open_cells, depth, limit)
            leaves.append(directory)
            depth += STEP
            if open_cells is None:
                break
    for more in leaves[:-1]:
        directory = directory.union(more)
    depths = [r[0] for r in directory.select("shard_depth").distinct().collect()]  # at most HASH_BITS + 1
    return _place(given, directory, sorted(depths), hashed, size, limit)


def _bits(depth: int) -> str:
    return f"substr(lpad(bin(h), {HASH_BITS}, '0'), 1, {depth})"


def _split(cells: DataFrame, depth: int, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Buckets that end in the next six bits, and the cells of those that must go on."""
    last = min(depth + STEP, HASH_BITS)
    finest = written(cells.groupBy(F.expr(_bits(last)).alias("bits")).agg(F.sum("b").alias("b")))
    sums = None
    for d in range(depth, last + 1):
        level = finest.groupBy(F.expr(f"substr(bits, 1, {d})").alias("shard")).agg(F.sum("b").alias("shard_bytes"))
        level = level.withColumn("shard_depth", F.lit(d))
        sums = level if sums is None else sums.union(level)
    sums = written(sums)
    full = sums.where(F.col("shard_bytes") > limit)
    # A bucket exists if the one above it is oversized; those above this round's first were.
    parent = full.select(F.col("shard").alias("above"))
    below = sums.where(F.col("shard_depth") > depth)
    there = below.join(parent, F.expr("substr(shard, 1, shard_depth - 1) = above"), "left_semi")
    done = there.where((F.col("shard_bytes") <= limit) | (F.col("shard_depth") == HASH_BITS))
    done = done.select("shard", "shard_depth", "shard_bytes")
    going_on = full.where((F.col("shard_depth") == last) & (F.col("shard_depth") < HASH_BITS)).select("shard")
    if going_on.isEmpty():
        return done, None
    return done, written(cells.join(going_on, F.expr(f"{_bits(last)} = shard"), "left_semi"))


def _place(given: DataFrame, directory: DataFrame, depths: list[int], hashed, size, limit: int) -> DataFrame:
    """Look every row up in the directory by the bits of each depth that the directory has."""
    directory = written(directory)
    marked = given.withColumns({"_h": hashed, "n_bytes": size})
    if depths == [0]:
        found = marked.withColumns(
            {"shard": F.lit(""), "shard_depth": F.lit(0), "shard_bytes": F.lit(directory.first()["shard_bytes"]).cast("long")}
        )
    else:
        # Leaves form a prefix code: sorted by their lowest hash, a row belongs to the last leaf at or below it.
        low = F.expr(f"CAST(conv(rpad(shard, {HASH_BITS}, '0'), 2, 10) AS long)")
        coarse = min(depths)
        leaves = directory.select("shard", "shard_depth", "shard_bytes", low.alias("low"))
        leaves = leaves.withColumn("_p", F.expr(f"shiftright(low, {HASH_BITS - coarse})"))
        packed = leaves.groupBy("_p").agg(F.sort_array(F.collect_list(F.struct("low", "shard", "shard_depth", "shard_bytes"))).alias("_l"))
        probed = marked.withColumn("_p", F.expr(f"shiftright(_h, {HASH_BITS - coarse})"))
        found = probed.join(written(packed), "_p").withColumn("_x", F.expr("element_at(filter(_l, x -> x.low <= _h), -1)"))
        found = found.select("*", "_x.shard", "_x.shard_depth", "_x.shard_bytes")
    over = F.col("shard_bytes") > limit
    return found.select(*[F.col(f"`{c}`") for c in given.columns], "shard", "shard_depth", "n_bytes", "shard_bytes", over.alias("oversize"))
