"""Seeded random order, exact cut points in it, running totals and dense codes.

A window without a partition pulls all rows into one task, and one partitioned by a label puts a
frequent label there. The helpers below work from counts instead: a histogram of hash prefixes says
where the row of a wanted rank lies, only that bucket is looked at row by row, and the full table is
then compared with the cut, which needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import as_double, col, require_columns
from .session import SMALL_SIDE_ROWS, cut_lineage, local_table, small_side

SEED = 42
PREFIX_STEP = 3
BUCKET_ROWS = 50_000
MAX_BUCKETS = 10_000
ROWS_PER_BUCKET = 1_000_000
COPIES_PER_BLOCK = 10_000


def order_hash(keys: Sequence[str], seed: int = SEED) -> Column:
    """The md5 text of the seed and the row key, joined by '|': the same in any SQL engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Give rows of a table without a unique key a stable id, by writing the table once."""
    return cut_lineage(df.withColumn(name, F.monotonically_increasing_id()))


WHOLE = ""


def part_sizes(df: DataFrame, part: str | None) -> DataFrame:
    """Rows per value of ``part`` (one part '' if None): columns ``part, n``; null parts are left out."""
    key = F.lit(WHOLE) if part is None else col(part)
    return df.select(key.alias("part")).where(F.col("part").isNotNull()).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def hash_cuts(
    df: DataFrame, part: str | None, keys: Sequence[str], ranks: DataFrame, seed: int = SEED
) -> DataFrame:
    """The order hash of the row at each wanted rank.

    ``ranks`` has ``part, n, cut, rank``: the part's size and a 1-based rank in it (rank 0 gives '',
    which no hash is below or equal to). Returns ``part, cuts, within`` with a part's hashes in order of
    ``cut``. Equal rows share a hash when all columns are the key: where a cut falls among them,
    ``within`` says how many of them lie before it, and is NULL elsewhere.
    Parts of more than ``BUCKET_ROWS`` rows are first narrowed down by counting hash prefixes.
    """
    require_columns(df, keys)
    hashed = order_hash(keys, seed)
    # The one part of a whole table is taken from the hash, so that it stays a join key to the planner.
    key = F.substring(hashed, 1, 0) if part is None else col(part)
    base = df.select(key.alias("part"), hashed.alias("h")).where(F.col("part").isNotNull())
    ranks = small_side(ranks.select("part", "n", "cut", F.col("rank").cast("long").alias("rank")))
    located = ranks.where(F.col("rank") > 0).withColumn("prefix", F.lit(""))
    length = 0
    while True:
        widest = located.agg(F.max("n")).first()[0]
        if widest is None or widest <= BUCKET_ROWS or length + PREFIX_STEP >= 32:
            break
        located = small_side(_refine(base, located, length, length + PREFIX_STEP))
        length += PREFIX_STEP
    last = _refine(base, located, length, 32)
    among = F.col("rank") < F.col("n")
    if set(keys) == set(df.columns):
        within = F.when(among, F.col("rank"))
    else:
        clash = F.raise_error(F.lit(f"Rows share the key {list(keys)}: name more columns, or none to use all of them"))
        within = F.when(among, clash.cast("long"))
    found = last.select("part", "cut", F.col("prefix").alias("h"), within.alias("within"))
    nothing = ranks.where(F.col("rank") <= 0)
    found = found.unionByName(nothing.select("part", "cut", F.lit("").alias("h"), F.lit(None).cast("long").alias("within")))
    listed = F.array_sort(F.collect_list(F.struct("cut", "h", "within")))
    in_order = found.groupBy("part").agg(listed.alias("listed"))
    return small_side(in_order.select("part", F.col("listed.h").alias("cuts"), F.col("listed.within").alias("within")))


def _refine(base: DataFrame, located: DataFrame, length: int, deeper: int) -> DataFrame:
    """Count the buckets that hold a wanted rank again, by a longer hash prefix."""
    near = base.withColumn("prefix", F.substring("h", 1, length))
    if length:
        near = near.join(located.select("part", "prefix").distinct(), ["part", "prefix"])
    counted = near.groupBy("part", "prefix", F.substring("h", 1, deeper).alias("longer")).agg(
        F.count(F.lit(1)).alias("n")
    )
    order = Window.partitionBy("part", "prefix").orderBy("longer").rowsBetween(Window.unboundedPreceding, 0)
    running = counted.withColumn("upto", F.sum("n").over(order))
    return (
        located.drop("n")
        .join(running, ["part", "prefix"])
        .where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        .select("part", "cut", F.col("longer").alias("prefix"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "n")
    )


def chunk_number(
    df: DataFrame, part: str | None, keys: Sequence[str], cuts: DataFrame, name: str, seed: int = SEED
) -> DataFrame:
    """Add how many cuts of its part lie before each row (0 = up to the first cut); null without a part."""
    marked = df.withColumn("_h", order_hash(keys, seed))
    if part is None:
        passed = [(F.lit(c) < F.col("_h")).cast("int") for c in cuts.first()["cuts"]]
        marked = marked.withColumn("_part", F.substring("_h", 1, 0))
        numbered = marked.withColumn(name, sum(passed[1:], passed[0]))
    else:
        joined = marked.join(cuts.select(F.col("part").alias("_part"), "cuts"), col(part) == F.col("_part"), "left")
        number = F.size(F.filter(F.col("cuts"), lambda c: c < F.col("_h")))
        numbered = joined.withColumn(name, F.when(F.col("cuts").isNotNull(), number))
        marked = marked.withColumn("_part", col(part))
    columns = [col(c) for c in df.columns]
    tied = cuts.where(F.exists("within", lambda w: w.isNotNull()))
    if tied.isEmpty():
        return numbered.select(*columns, name)
    places = tied.select("part", F.col("cuts").alias("all"), F.explode(F.arrays_zip("cuts", "within")).alias("x"))
    earlier = F.size(F.filter("all", lambda c: c < F.col("x.cuts")))
    ties = places.where("x.within IS NOT NULL").groupBy(F.col("part").alias("_tied"), F.col("x.cuts").alias("_tied_h")).agg(
        F.array_sort(F.collect_list("x.within")).alias("_ranks"), F.first(earlier).alias("_before")
    )
    ties = small_side(ties)
    here = (F.col("_part") == F.col("_tied")) & (F.col("_h") == F.col("_tied_h"))
    others = numbered.join(ties, here, "left_anti").select(*columns, name)
    return others.unionByName(_split_ties(marked.join(ties, here), df.columns, name).select(*columns, name))


def _split_ties(equal: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Rows that a cut falls among, counted and laid out again with the chunk of each.

    Equal rows are merged map-side to a count, so a row repeated any number of times is one row here.
    Different rows of one hash (a NULL beside an empty text) are put in order of their values.
    """
    kept = [col(c) for c in columns]
    counted = equal.groupBy(*kept, "_part", "_h", "_ranks", "_before").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_part", "_h").orderBy(*kept).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_to", F.sum("_n").over(order))
    ends = F.concat(F.array(F.lit(0).cast("long")), "_ranks", F.array("_to"))
    edges = F.transform(ends, lambda r: F.least(F.greatest(r, F.col("_to") - F.col("_n")), F.col("_to")))
    n_pieces = F.size("_ranks") + 1
    sizes = F.zip_with(F.slice("_edges", 2, n_pieces), F.slice("_edges", 1, n_pieces), lambda end, start: end - start)
    pieces = placed.withColumn("_edges", edges).select(*kept, "_before", F.posexplode(sizes).alias("_piece", "_times"))
    return repeat_rows(pieces.withColumn(name, F.col("_before") + F.col("_piece")), "_times")


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Every row ``times`` times (none for 0); many copies of one row are dealt out in blocks."""
    copies = col(times)
    last = F.floor((copies - 1) / COPIES_PER_BLOCK)
    blocks = df.where(copies > 0).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    # A given number of partitions, as adaptive execution would join up blocks by their few bytes.
    n_tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(n_tasks, "_block", *[col(c) for c in df.columns])
    in_block = F.least(F.lit(COPIES_PER_BLOCK).cast("long"), copies - F.col("_block") * COPIES_PER_BLOCK)
    return dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), in_block))).drop("_block", "_copy")


def first_rows(
    df: DataFrame, n: int, keys: Sequence[str] | None = None, seed: int = SEED, total: int | None = None
) -> DataFrame:
    """A uniform sample of exactly ``n`` rows (all if there are fewer): the first ones in hash order of their key."""
    keys = list(keys or df.columns)
    total = df.count() if total is None else total
    if total <= n:
        return df
    ranks = local_table(df.sparkSession, [(WHOLE, total, 0, n)], "part string, n long, cut int, rank long")
    kept = chunk_number(df, None, keys, hash_cuts(df, None, keys, ranks, seed), "_chunk", seed)
    return kept.where(F.col("_chunk") == 0).drop("_chunk")


def running_totals(df: DataFrame, order: str, sums: Sequence[str], descending: bool = True) -> DataFrame:
    """Running sums over the distinct values of a numeric column, in order, over the whole table.

    Rows are first added up per value. Range edges come from a sketch; whole ranges are added up to
    offsets, so that each range orders only its own values.
    """
    values = df.select(as_double(order).alias("v"), *[col(s) for s in sums]).where(F.col("v").isNotNull())
    n_buckets = max(8, min(MAX_BUCKETS, values.count() // ROWS_PER_BUCKET))
    steps = F.array(*[F.lit(i / n_buckets) for i in range(1, n_buckets)])
    edges = values.agg(F.percentile_approx("v", steps, max(10_000, 2 * n_buckets))).first()[0] or [0.0]
    splits = [-float("inf"), *sorted(set(edges)), float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="v", outputCol="bucket").transform(values)
    totals = bucketed.groupBy("bucket").agg(*[F.sum(s).alias(s) for s in sums])
    before = {s: 0 for s in sums}
    offsets = []
    for row in sorted(totals.collect(), key=lambda r: r["bucket"], reverse=descending):
        offsets.append((row["bucket"], *[before[s] for s in sums]))
        before = {s: before[s] + (row[s] or 0) for s in sums}
    offset = local_table(df.sparkSession, offsets, totals.schema).withColumnsRenamed({s: f"_off_{s}" for s in sums})
    per_value = bucketed.groupBy("bucket", "v").agg(*[F.sum(s).alias(s) for s in sums])
    by = F.col("v").desc() if descending else F.col("v").asc()
    frame = Window.partitionBy("bucket").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return per_value.join(offset, "bucket").select(
        F.col("v").alias(order),
        *[F.col(s) for s in sums],
        *[(F.sum(s).over(frame) + F.col(f"_off_{s}")).alias(f"cum_{s}") for s in sums],
    )


# monotonically_increasing_id puts the partition in the upper bits and the position in the lower 33.
POSITION = 2**33


def running(df: DataFrame, order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """Add the sum of a whole number over all rows before each one in ``order``, over the whole table.

    The table is sorted into ranges and written once, so that its partitions stay put; the driver adds up one
    sum a partition, and each partition orders only its own rows.
    """
    ordered = cut_lineage(df.withColumn(name, value.cast("long")).sort(*order)).withColumn("_id", F.monotonically_increasing_id())
    placed = ordered.withColumn("_p", F.floor(F.col("_id") / POSITION))
    before, offsets = 0, []
    for p, n in sorted(tuple(r) for r in placed.groupBy("_p").agg(F.sum(name)).collect()):
        offsets.append((p, before))
        before += n
    offset = local_table(df.sparkSession, offsets, "_p long, _before long")
    inside = Window.partitionBy("_p").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.join(offset, "_p").withColumn(name, F.col("_before") + F.coalesce(F.sum(name).over(inside), F.lit(0)))
    return summed.select(*[col(c) for c in df.columns], name)


def dense_codes(values: DataFrame, max_rows: int = SMALL_SIDE_ROWS, estimate: int | None = None) -> DataFrame:
    """Codes 0.. for the distinct values of a one-column string table, ascending: ``value, code``.

    A short dictionary is numbered on the driver. A long one is sorted into ranges, written once so
    that its partitions stay put, and numbered by partition offset plus position. An ``estimate`` of
    the distinct values saves asking whether a long one is short.
    """
    spark = values.sparkSession
    distinct = values.select(col(values.columns[0]).alias("value")).where(F.col("value").isNotNull()).distinct()
    if estimate is None or estimate <= 1.5 * max_rows:
        found = distinct.limit(max_rows + 1).collect()
        if len(found) <= max_rows:
            codes = [(value, i) for i, value in enumerate(sorted(r["value"] for r in found))]
            return local_table(spark, codes, "value string, code long")
    return running(distinct, ["value"], F.lit(1), "code")
