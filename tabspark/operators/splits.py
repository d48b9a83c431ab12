"""Target and features, hold-out split, folds, class balance, scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_double, col, is_numeric, numeric_columns, require_columns
from ..functions.ordering import COPIES_PER_BLOCK, SEED, chunk_number, hash_cuts, part_sizes, repeat_rows, running
from ..functions.session import local_table, small_side

SPLIT = "_split"
FOLD = "_fold"
WEIGHT = "_weight"
STRATIFY_BELOW = 20
STRATEGIES = ["class_weight", "undersample", "oversample"]


def separate_features_target(df: DataFrame, target: str) -> DataFrame:
    """All features as one struct column ``features`` beside ``label``."""
    require_columns(df, [target])
    rest = [c for c in df.columns if c != target]
    return df.select(F.struct(*[col(c) for c in rest]).alias("features"), col(target).alias("label"))


def shapes(df: DataFrame, target: str) -> DataFrame:
    """``x_rows, x_columns, y_rows``."""
    require_columns(df, [target])
    counted = df.agg(F.count(F.lit(1)).alias("x_rows"))
    return counted.select("x_rows", F.lit(len(df.columns) - 1).cast("long").alias("x_columns"), F.col("x_rows").alias("y_rows"))


def is_stratified(df: DataFrame, target: str) -> bool:
    """Text targets, and numbers with fewer than 20 values. A sketch settles the clear cases."""
    require_columns(df, [target])
    if not is_numeric(df, target):
        return True
    if df.agg(F.approx_count_distinct(col(target))).first()[0] > 2 * STRATIFY_BELOW:
        return False
    return df.agg(F.countDistinct(col(target))).first()[0] < STRATIFY_BELOW


def allocate(sizes: DataFrame, total: int) -> DataFrame:
    """Share ``total`` among the parts by size: whole shares, then the largest remainders, ties by part.

    The parts are put in order by range, so there may be any number of them.
    """
    everything = sizes.agg(F.sum("n")).first()[0]
    if not everything:
        return sizes.select("part", "n", F.lit(0).cast("long").alias("share"))
    every = F.lit(everything).cast("decimal(38,0)")
    shared = (F.lit(total).cast("decimal(18,0)") * F.col("n").cast("decimal(18,0)")).cast("decimal(38,0)")
    quota = sizes.select("part", "n", (shared % every).alias("rest"), shared.alias("shared"))
    whole = quota.withColumn("base", ((F.col("shared") - F.col("rest")) / every).cast("long"))
    left_over = total - whole.agg(F.sum("base")).first()[0]
    if not left_over:
        return whole.select("part", "n", F.col("base").alias("share"))
    placed = running(whole, [F.col("rest").desc(), "part"], F.lit(1), "place")
    extra = (F.col("place") < left_over).cast("long")
    return placed.select("part", "n", (F.col("base") + extra).alias("share"))


def _no_gaps(df: DataFrame, part: str | None) -> None:
    """Rows without a class would be in no part: ask for them to be dropped or filled first."""
    if part is not None and (gaps := df.where(col(part).isNull()).count()):
        raise ValueError(f"{gaps} rows have no {part!r} to stratify by: drop or fill them first")


def split_data(
    df: DataFrame,
    target: str,
    test_size: float = 0.2,
    keys: Sequence[str] | None = None,
    seed: int = SEED,
    stratify: bool | None = None,
) -> DataFrame:
    """Add ``_split`` (train or test): exactly ceil(n * test_size) test rows, per class if stratified.

    ``keys`` identify a row (all columns unless named). Rows are told apart by cut points in the
    seeded hash order of their class, so the table itself is not shuffled.
    """
    keys = list(keys or df.columns)
    part = target if (is_stratified(df, target) if stratify is None else stratify) else None
    _no_gaps(df, part)
    sizes = small_side(part_sizes(df, part))
    n, classes, least = sizes.agg(F.sum("n"), F.count(F.lit(1)), F.min("n")).first()
    total = math.ceil((n or 0) * test_size)
    if not n or total >= n:
        raise ValueError(f"Cannot hold out {total} of {n or 0} rows")
    if part is not None and least < 2:
        raise ValueError("The least populated class has fewer than 2 rows")
    if part is not None and min(total, n - total) < classes:
        raise ValueError(f"{total} test and {n - total} train rows cannot hold {classes} classes")
    ranks = allocate(sizes, total).select("part", "n", F.lit(0).alias("cut"), F.col("share").alias("rank"))
    cuts = hash_cuts(df, part, keys, ranks, seed)
    chunk = chunk_number(df, part, keys, cuts, "_chunk", seed)
    return chunk.withColumn(SPLIT, F.when(F.col("_chunk") == 0, "test").when(F.col("_chunk") > 0, "train")).drop("_chunk")


def split_summary(df: DataFrame) -> DataFrame:
    return df.groupBy(col(SPLIT).alias("split")).agg(F.count(F.lit(1)).alias("rows"))


def fold_ranks(sizes: DataFrame, n_folds: int) -> DataFrame:
    """Last rank of each fold but the last one, per class.

    With the classes laid end to end, fold f gets as many rows of a class as it has positions j with
    j mod n_folds = f, so folds differ by one row at most, in each class and in total.
    """
    placed = running(sizes.select("part", "n"), ["part"], F.col("n"), "start")
    cut = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(n_folds - 2, 0)))).alias("cut"))
    # Positions j < at with j mod n_folds <= cut, for the class's end minus its start.
    def below(at: Column) -> Column:
        whole = F.floor(at / n_folds)
        return whole * (F.col("cut") + 1) + F.least(at - whole * n_folds, F.col("cut") + 1)

    rank = below(F.col("start") + F.col("n")) - below(F.col("start"))
    return cut.select("part", "n", "cut", rank.cast("long").alias("rank"))


def create_folds(
    df: DataFrame,
    target: str,
    n_folds: int = 5,
    keys: Sequence[str] | None = None,
    seed: int = SEED,
    stratify: bool | None = None,
) -> DataFrame:
    """Add ``_fold`` (0 ..): shuffled folds of equal size, in each class if stratified."""
    if n_folds < 2:
        raise ValueError("At least 2 folds are needed")
    keys = list(keys or df.columns)
    part = target if (is_stratified(df, target) if stratify is None else stratify) else None
    _no_gaps(df, part)
    sizes = small_side(part_sizes(df, part))
    if (sizes.agg(F.max("n")).first()[0] or 0) < n_folds:
        raise ValueError(f"{n_folds} folds need at least as many rows in a class")
    cuts = hash_cuts(df, part, keys, fold_ranks(sizes, n_folds), seed)
    return chunk_number(df, part, keys, cuts, FOLD, seed)


def fold_summary(df: DataFrame) -> DataFrame:
    """``fold`` (from 1), ``train_rows``, ``val_rows``."""
    sizes = df.groupBy(col(FOLD).alias("f")).agg(F.count(F.lit(1)).alias("val_rows"))
    everything = F.sum("val_rows").over(Window.partitionBy())  # one row a fold
    return sizes.select((F.col("f") + 1).alias("fold"), (everything - F.col("val_rows")).alias("train_rows"), "val_rows")


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    return part_sizes(df, target).select(F.col("part").alias("label"), F.col("n").alias("rows"))


def class_balance(
    df: DataFrame,
    target: str,
    strategy: str = "class_weight",
    keys: Sequence[str] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Balance the classes of the training rows (of all rows if there is no ``_split``).

    ``class_weight`` adds ``_weight`` = n / (classes * n_class); ``undersample`` keeps as many rows
    of each class as the rarest has; ``oversample`` repeats rows evenly up to the most frequent class.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy={strategy!r} is none of {STRATEGIES}")
    require_columns(df, [target])
    split = SPLIT in df.columns
    train = df.where(col(SPLIT) == "train") if split else df
    rest = df.where(~col(SPLIT).eqNullSafe("train")) if split else None
    sizes = small_side(part_sizes(train, target))
    n, classes, least, most = sizes.agg(F.sum("n"), F.count(F.lit(1)), F.min("n"), F.max("n")).first()
    if not n:
        raise ValueError("No training rows with a label")
    if strategy == "class_weight":
        weights = sizes.select(F.col("part").alias("_part"), (F.lit(float(n)) / (classes * F.col("n"))).alias(WEIGHT))
        out = df.join(weights, col(target) == F.col("_part"), "left").drop("_part")
        return out.withColumn(WEIGHT, F.coalesce(WEIGHT, F.lit(1.0)))
    _no_gaps(train, target)
    keys = list(keys or df.columns)
    if strategy == "undersample":
        ranks = sizes.select("part", "n", F.lit(0).alias("cut"), F.lit(least).alias("rank"))
        cuts = hash_cuts(train, target, keys, ranks, seed)
        out = chunk_number(train, target, keys, cuts, "_chunk", seed).where(F.col("_chunk") == 0).drop("_chunk")
    else:
        ranks = sizes.select("part", "n", F.lit(0).alias("cut"), (F.lit(most) % F.col("n")).alias("rank"))
        cuts = hash_cuts(train, target, keys, ranks, seed)
        marked = chunk_number(train, target, keys, cuts, "_chunk", seed)
        whole = sizes.select(F.col("part").alias("_part"), F.floor(F.lit(most) / F.col("n")).alias("_whole"))
        copies = F.col("_whole") + (F.col("_chunk") == 0).cast("long")
        counted = marked.join(whole, col(target) == F.col("_part")).withColumn("_times", copies)
        # A class whose rows are each repeated a few times needs no second exchange.
        if most // least <= COPIES_PER_BLOCK:
            repeated = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
        else:
            repeated = repeat_rows(counted, "_times")
        out = repeated.select(*[col(c) for c in df.columns])
    return out.unionByName(rest) if rest is not None else out


@dataclass(frozen=True)
class Scaler:
    means: dict[str, float]
    stds: dict[str, float]


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    """Mean and population standard deviation (1 for a constant) of the training rows."""
    require_columns(df, columns)
    train = df.where(col(SPLIT) == "train") if SPLIT in df.columns else df
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(as_double(c)).alias(f"m{i}"), F.stddev_pop(as_double(c)).alias(f"s{i}")]
    seen = train.agg(*aggs).first()
    means = {c: seen[f"m{i}"] or 0.0 for i, c in enumerate(columns)}
    return Scaler(means, {c: seen[f"s{i}"] or 1.0 for i, c in enumerate(columns)})


def scaled(name: str, scaler: Scaler) -> Column:
    return (as_double(name) - F.lit(scaler.means[name])) / F.lit(scaler.stds[name])


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.select(*[scaled(c, scaler).alias(c) if c in scaler.means else col(c) for c in df.columns])


def scale_features(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """Standardise the numeric features, fitted on the training rows."""
    names = columns or [c for c in numeric_columns(df, [target]) if not c.startswith("_")]
    return apply_scaler(df, fit_scaler(df, names))


def scaler_report(df: DataFrame, scaler: Scaler) -> DataFrame:
    rows = [(c, round(scaler.means[c], 4), round(scaler.stds[c], 4)) for c in scaler.means]
    return local_table(df.sparkSession, rows, "column string, mean double, std double")
