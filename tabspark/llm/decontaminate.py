"""Documents that hold items of a benchmark, found with DataFrame functions alone.

The method: SimHash fingerprints of item-sized windows, a multi-index over blocks of their bits that
misses no fingerprint within the radius, and an exact similarity of weighted shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.functions.session import written

RADIUS = 21
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    """Hashes of the words of a text, A-Z as a-z."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[\\x20\\x09-\\x0D]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _shingles(words: str, k: int) -> Column:
    """Hashes of all runs of ``k`` words, in order; none if there are fewer words."""
    run = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return F.expr(f"IF(size({words}) >= {k}, transform(sequence(0, size({words}) - {k}), i -> xxhash64({run})), array())")


def _fingerprint(shingles: str) -> Column:
    """64 bits: each is the sign of the sum, over shingles with repeats, of +1 or -1 by that bit."""
    bits = f"transform(sequence(0, 63), b -> aggregate({shingles}, 0, (s, x) -> s + IF(getbit(x, b) = 1, 1, -1)))"
    return F.expr(f"aggregate({bits}, 0L, (f, s) -> shiftleft(f, 1) | IF(s > 0, 1L, 0L))")


def _blocks(radius: int) -> Column:
    """The fingerprint cut into radius + 1 blocks of bits: two that differ in at most ``radius`` bits
    agree in one block."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    mask = [(1 << (b - a)) - 1 for a, b in zip(edges, edges[1:])]
    return F.array(
        *[F.struct(F.lit(i).alias("block"), F.expr(f"shiftrightunsigned(fp, {a}) & {m}L").alias("bits")) for i, (a, m) in enumerate(zip(edges, mask))]
    )


def text_key(text: str) -> list[Column]:
    """What tells texts apart: 64 hash bits and the length."""
    return [F.xxhash64(F.col(text)).alias("_key"), F.length(F.col(text)).alias("_length")]


def contaminated_texts(
    docs: DataFrame, benchmark: DataFrame, n: int = 5, percent: int = 80, radius: int = RADIUS, text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(_key, _length, item_id, similarity, start, n_words): the best window of every text and item.

    A window has as many words as the item (all words of a shorter text). The similarity is the weighted
    Jaccard of the shingles of ``n`` words, each weighing as often as it occurs; pairs of ``percent``
    or more are returned, with the first of the best windows. An item of fewer words is one shingle
    of all its words. Items without words match nothing.

    A window that reaches the similarity shares one of any few shingles of the item, so only texts with
    one of those (an item's lowest hashes) go on. A best window begins or ends at a shared shingle, so
    only such windows get fingerprints; these meet those of the items by blocks of bits, and pairs
    within the radius are compared exactly. The radius is four standard deviations above the mean
    distance of windows at the threshold.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(text).alias("text")).where("text IS NOT NULL")
    items = benchmark.select(F.col(item).alias("item_id"), _words(F.col(item_text)).alias("w")).where("size(w) > 0")
    items = written(items.select("item_id", "w", F.size("w").alias("n_words"), F.least(F.size("w"), F.lit(n)).alias("k")))
    kinds = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most n
    found = None
    for k in kinds:
        part = _matches(given, items.where(F.col("k") == k), k, percent, radius)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "_key long, _length int, item_id long, similarity double, start int, n_words int")
    return found


def _matches(given: DataFrame, items: DataFrame, k: int, percent: int, radius: int) -> DataFrame:
    items = items.select("item_id", "n_words", _shingles("w", k).alias("s")).withColumn("m", F.size("s"))
    items = written(items.select("*", _fingerprint("s").alias("fp")))
    # Windows of m shingles meet the threshold from this many shared ones on; a shorter text needs as many.
    least = f"CAST(ceil({percent} * m / 100.0) AS int)"
    rare = items.select("item_id", F.explode(F.expr(f"array_distinct(slice(sort_array(s), 1, m - {least} + 1))")).alias("shingle"))
    rare = written(rare.select("shingle").distinct())

    texts = given.select(*text_key("text"), "text", _words(F.col("text")).alias("w"))
    seen = texts.select("_key", "_length", F.explode(_shingles("w", k)).alias("shingle")).join(rare, "shingle", "left_semi")
    seen = written(seen.select("_key", "_length").distinct())
    some = given.select(*text_key("text"), "text").join(seen, ["_key", "_length"], "left_semi")
    some = some.groupBy("_key", "_length").agg(F.first("text").alias("text"))
    some = some.select("_key", "_length", _words(F.col("text")).alias("w"))
    some = written(some.select("_key", "_length", _shingles("w", k).alias("all")))

    shared = items.select("item_id", "n_words", "m", F.explode(F.array_distinct("s")).alias("shingle"))
    hits = some.select("_key", "_length", F.size("all").alias("held"), F.posexplode("all").alias("at", "shingle"))
    hits = hits.join(written(shared), "shingle")
    starts = F.explode(F.array(F.col("at"), F.col("at") - F.col("m") + 1))
    windows = hits.select("_key", "_length", "n_words", "m", "held", starts.alias("x"))
    windows = windows.select("_key", "_length", "n_words", "m", F.expr("greatest(0, least(x, held - m))").alias("start")).distinct()
    windows = windows.join(some, ["_key", "_length"]).select("_key", "_length", "n_words", "start", F.expr("slice(all, start + 1, m)").alias("s"))
    windows = written(windows.select("*", _fingerprint("s").alias("fp")))

    def indexed(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select(*columns, "n_words", "fp", F.explode(_blocks(radius)).alias("x")).select(*columns, "n_words", "fp", "x.block", "x.bits")

    near = indexed(windows, "_key", "_length", "start").join(
        written(indexed(items, "item_id").withColumnRenamed("fp", "item_fp")), ["n_words", "block", "bits"]
    )
    near = near.where(F.expr(f"bit_count(fp ^ item_fp) <= {radius}")).select("_key", "_length", "n_words", "start", "item_id").distinct()
    both = near.join(windows.select("_key", "_length", "n_words", "start", "s"), ["_key", "_length", "n_words", "start"])
    both = both.join(items.select("item_id", F.col("s").alias("t")), "item_id")
    common = "aggregate(array_distinct(t), 0, (c, x) -> c + least(size(filter(s, y -> y = x)), size(filter(t, y -> y = x))))"
    both = both.withColumn("common", F.expr(common)).withColumn("total", F.expr("size(s) + size(t) - common"))
    both = both.where(F.col("common") * 100 >= F.col("total") * percent)
    both = both.withColumn("similarity", F.col("common") / F.col("total"))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("b")
    out = both.groupBy("_key", "_length", "item_id").agg(best)
    return out.select("_key", "_length", "item_id", "b.similarity", (-F.col("b.back")).alias("start"), "b.n_words")


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): a row for each document and item it holds.

    ``start`` is the number of words before the best window. A NULL or empty text holds nothing; rows
    of equal texts share their result, whatever their ids, and a NULL id stays NULL; repeated rows are
    repeated. Empty tables give no row. Options as in ``contaminated_texts``.
    """
    text = options.get("text", "text")
    found = written(contaminated_texts(docs, benchmark, **options))
    names = docs.select(F.col(id).alias(id), *text_key(text))
    return names.join(found, ["_key", "_length"]).select(id, "item_id", "similarity", "start", "n_words")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item of the benchmark, with all their columns."""
    text = options.get("text", "text")
    keys = written(contaminated_texts(docs, benchmark, **options).select(F.col("_key").alias("_k"), F.col("_length").alias("_l")).distinct())
    key, length = text_key(text)
    return docs.withColumns({"_key": key, "_length": length}).join(
        keys, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_length").eqNullSafe(F.col("_l")), "left_anti"
    ).select(*[F.col(f"`{c}`") for c in docs.columns])
