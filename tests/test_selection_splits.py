import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.operators import selection as k
from tabspark.operators import splits as d


def labelled(spark, counts, start=0):
    """One row per member: id, label, x."""
    rows, i = [], start
    for label, n in counts.items():
        for _ in range(n):
            rows.append((i, label, float(i % 13)))
            i += 1
    return spark.createDataFrame(rows, "id long, label string, x double")


def test_low_variance_keeps_undefined(spark):
    one = spark.createDataFrame([(1.0, 1)], "x double, t int")
    assert k.fit_low_variance(one, "t") == []
    two = spark.createDataFrame([(1.0, 1.0, 0), (1.1, 5.0, 0)], "a double, b double, t int")
    assert k.fit_low_variance(two, "t") == ["a"]


def test_dropped_columns_still_count(spark):
    df = spark.range(50).select(
        F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"), (F.col("id") * -3.0).alias("c"), (F.col("id") % 7).alias("e"), F.lit(1).alias("t")
    )
    assert k.fit_correlated(df, "t") == ["b", "c"]
    assert k.drop_correlated(df, "t").columns == ["a", "e", "t"]


def test_f_classif_by_hand(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (4.0, 1), (6.0, 1), (None, 1)], "x double, t int")
    # The gap counts as the median, 3.
    a, b = np.array([1.0, 2.0]), np.array([4.0, 6.0, 3.0])
    m = np.concatenate([a, b]).mean()
    between = 2 * (a.mean() - m) ** 2 + 3 * (b.mean() - m) ** 2
    within = ((a - a.mean()) ** 2).sum() + ((b - b.mean()) ** 2).sum()
    assert k.score_features(df, "t").first()["score"] == pytest.approx(between / (within / 3))


def test_separated_and_constant_features(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0), (0.0, 1.0, 0), (9.0, 1.0, 1), (9.0, 1.0, 1)], "x double, c double, t int")
    scores = {r["feature"]: r["score"] for r in k.score_features(df, "t").collect()}
    assert scores == {"x": math.inf, "c": None}
    perfect = {r["feature"]: r["score"] for r in k.score_features(df, "t", "f_regression").collect()}
    assert perfect["c"] == 0.0 and perfect["x"] > 1e10


def test_chi2_by_hand(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (6.0, "b")], "x double, t string")
    want = (4 - 20 / 3) ** 2 / (20 / 3) + (6 - 10 / 3) ** 2 / (10 / 3)
    assert k.score_features(df, "t", "chi2").first()["score"] == pytest.approx(want)
    with pytest.raises(ValueError):
        k.score_features(df.withColumn("x", -F.col("x")), "t", "chi2")


def test_equal_scores_prefer_the_later_column(spark):
    df = spark.range(30).select(
        *[(F.col("id") % 5).cast("double").alias(c) for c in ("a", "b", "c")], F.lit(1.0).alias("flat"), (F.col("id") % 2).alias("t")
    )
    fitted = k.fit_k_best(df, "t", 2)
    assert fitted.selected == ["b", "c"] and fitted.scores["flat"] is None
    assert k.select_k_best(df, "t", 99).columns[-1] == "flat"


def test_mutual_information_of_a_copy_is_the_entropy(spark):
    df = spark.range(400).select((F.col("id") % 4).cast("double").alias("x"), (F.col("id") % 4).alias("t"), (F.floor(F.col("id") / 4) % 2).cast("double").alias("free"))
    scores = {r["feature"]: r["score"] for r in k.score_features(df, "t", "mutual_info_classif").collect()}
    assert scores["x"] > 1.0 and scores["free"] == pytest.approx(0.0, abs=1e-9)


def test_selection_errors(spark):
    df = spark.createDataFrame([("a", 1.0, 0)], "s string, x double, t int")
    for args in [("t", "f_classif"), ("zz", "f_classif")]:
        with pytest.raises(ValueError):
            k.score_features(df, *args)
    with pytest.raises(ValueError):
        k.score_features(df.drop("s"), "t", "magic")
    with pytest.raises(ValueError):
        k.score_features(df.select("t"), "t")


@pytest.mark.parametrize("n, kind", [(19, True), (20, False), (21, False)])
def test_stratify_threshold(spark, n, kind):
    assert d.is_stratified(spark.range(n), "id") is kind


def test_split_sizes_and_repeatability(spark):
    df = labelled(spark, {"a": 50, "b": 31, "c": 22})
    out = d.split_data(df, "label", keys=["id"])
    sizes = Counter((r["label"], r["_split"]) for r in out.collect())
    # ceil(103 * 0.2) = 21 test rows: shares 10.19, 6.32, 4.49 -> 10, 6, 5.
    assert (sizes["a", "test"], sizes["b", "test"], sizes["c", "test"]) == (10, 6, 5)
    assert out.count() == 103
    again = d.split_data(df.repartition(9), "label", keys=["id"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    assert {r["split"]: r["rows"] for r in d.split_summary(out).collect()} == {"test": 21, "train": 82}


def test_split_of_a_number_is_plain(spark):
    out = d.split_data(spark.range(101).withColumn("y", F.col("id") * 1.5), "y", keys=["id"])
    assert Counter(r["_split"] for r in out.collect()) == {"test": 21, "train": 80}


def test_split_errors(spark):
    with pytest.raises(ValueError):
        d.split_data(labelled(spark, {"a": 9, "b": 1}), "label", keys=["id"])
    with pytest.raises(ValueError):
        d.split_data(labelled(spark, {c: 2 for c in "abcdef"}), "label", 0.2, keys=["id"])
    with pytest.raises(ValueError):
        d.split_data(labelled(spark, {"a": 9, "b": 3}), "label", 1.0, keys=["id"])


def test_split_many_classes_joins_by_shuffle(spark, monkeypatch):
    from tabspark.functions import ordering

    df = spark.range(3000).select("id", F.concat(F.lit("c"), F.col("id") % 300).alias("label"))
    want = sorted(map(tuple, d.split_data(df, "label", keys=["id"]).collect()))
    for m in (d, ordering):
        monkeypatch.setattr(m, "small_side", lambda x, *a: x)
    assert sorted(map(tuple, d.split_data(df, "label", keys=["id"]).collect())) == want


@pytest.mark.parametrize("n_folds", [2, 3, 5])
def test_folds_differ_by_one_row(spark, n_folds):
    df = labelled(spark, {"a": 17, "b": 9, "c": 8})
    out = d.create_folds(df, "label", n_folds, keys=["id"])
    folds = [(r["label"], r["_fold"]) for r in out.collect()]
    for label in "abc":
        sizes = [folds.count((label, f)) for f in range(n_folds)]
        assert max(sizes) - min(sizes) <= 1
    totals = Counter(f for _, f in folds)
    assert max(totals.values()) - min(totals.values()) <= 1 and set(totals) == set(range(n_folds))
    summary = {r["fold"]: (r["train_rows"], r["val_rows"]) for r in d.fold_summary(out).collect()}
    assert all(sum(v) == 34 for v in summary.values())


def test_fold_errors(spark):
    df = labelled(spark, {"a": 2, "b": 2})
    for n in (1, 3):
        with pytest.raises(ValueError):
            d.create_folds(df, "label", n, keys=["id"])


def test_class_balance(spark):
    df = labelled(spark, {"hot": 30, "rare": 4, "mid": 13})
    count = lambda x: {r["label"]: r["rows"] for r in d.class_distribution(x, "label").collect()}
    assert count(d.class_balance(df, "label", "undersample", ["id"])) == {"hot": 4, "rare": 4, "mid": 4}
    over = d.class_balance(df, "label", "oversample", ["id"])
    assert count(over) == {"hot": 30, "rare": 30, "mid": 30}
    copies = Counter(r["id"] for r in over.collect() if r["label"] == "rare")
    assert set(copies.values()) == {7, 8}
    weights = {r["label"]: r["_weight"] for r in d.class_balance(df, "label").collect()}
    assert weights == pytest.approx({"hot": 47 / 90, "rare": 47 / 12, "mid": 47 / 39})
    with pytest.raises(ValueError):
        d.class_balance(df, "label", "smote")


def test_balance_leaves_test_rows_alone(spark):
    df = d.split_data(labelled(spark, {"hot": 40, "rare": 10}), "label", keys=["id"])
    for strategy in ("undersample", "oversample"):
        out = d.class_balance(df, "label", strategy, ["id"])
        assert sorted(map(tuple, out.where("_split = 'test'").collect())) == sorted(map(tuple, df.where("_split = 'test'").collect()))


def test_scaler_uses_training_rows_and_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0, "train"), (3.0, 5.0, "train"), (100.0, 6.0, "test")], "x double, c double, _split string")
    s = d.fit_scaler(df, ["x", "c"])
    assert s.means == {"x": 2.0, "c": 5.0} and s.stds == {"x": 1.0, "c": 1.0}
    assert [tuple(r)[:2] for r in d.apply_scaler(df, s).collect()] == [(-1.0, 0.0), (1.0, 0.0), (98.0, 1.0)]
    assert d.scaler_report(df, s).count() == 2


def test_separate(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "x int, t string, z double")
    out = d.separate_features_target(df, "t")
    assert out.columns == ["features", "label"] and out.select("features.*").columns == ["x", "z"]
    assert tuple(d.shapes(df, "t").first()) == (1, 2, 1)


def test_rows_without_a_class_are_refused(spark):
    import pytest

    from tabspark.operators.splits import class_balance, create_folds, split_data

    df = spark.createDataFrame([(i, [None, "a", "b"][i % 3]) for i in range(60)], "id long, y string")
    for run in (
        lambda: split_data(df, "y", keys=["id"]),
        lambda: create_folds(df, "y", keys=["id"]),
        lambda: class_balance(df, "y", "undersample", keys=["id"]),
        lambda: class_balance(df, "y", "oversample", keys=["id"]),
    ):
        with pytest.raises(ValueError, match="20 rows have no 'y'"):
            run()
    assert split_data(df, "y", keys=["id"], stratify=False).where("_split IS NULL").count() == 0


def test_repeated_rows_are_split_exactly(spark):
    """Rows that nothing tells apart, one of them in half the table, and NULL beside an empty text."""
    rows = [("a", "x")] * 500 + [("a", None)] * 30 + [("a", "")] * 20 + [("b", str(i % 7)) for i in range(450)]
    df = spark.createDataFrame(rows, "k string, v string").repartition(5)
    for part in (True, False):
        placed = d.split_data(df, "k", 0.3, stratify=part)
        sizes = {r["_split"]: r["count"] for r in placed.groupBy("_split").count().collect()}
        assert sizes == {"test": 300, "train": 700}
        assert sorted(map(str, placed.drop("_split").collect())) == sorted(map(str, df.collect()))
    folds = d.create_folds(df, "k", 4)
    assert [r["n"] for r in folds.groupBy("_fold").agg(F.count("*").alias("n")).orderBy("_fold").collect()] == [250] * 4


def test_rows_are_repeated_in_blocks(spark, monkeypatch):
    from tabspark.functions import ordering

    monkeypatch.setattr(ordering, "COPIES_PER_BLOCK", 10)
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 10), ("d", 25)], "k string, n long")
    counts = {r["k"]: r["count"] for r in ordering.repeat_rows(df, "n").groupBy("k").count().collect()}
    assert counts == {"b": 1, "c": 10, "d": 25}


def test_oversample_of_a_rare_class(spark, monkeypatch):
    from tabspark.operators import splits

    monkeypatch.setattr(splits, "COPIES_PER_BLOCK", 10)
    df = spark.range(101).select("id", F.when(F.col("id") == 0, "rare").otherwise("often").alias("k"))
    balanced = d.class_balance(df, "k", "oversample", ["id"])
    assert {r["k"]: r["count"] for r in balanced.groupBy("k").count().collect()} == {"rare": 100, "often": 100}


def test_shares_and_starts_of_a_million_classes(spark):
    n = 1_000_000
    sizes = spark.range(n).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("part"), (F.col("id") % 3 + 2).alias("n"))
    total = 700_000
    shared = d.allocate(sizes, total).withColumn("i", F.substring("part", 2, 7).cast("long"))
    everything = sum(i % 3 + 2 for i in range(n))
    left = total - sum((i % 3 + 2) * total // everything for i in range(3)) * (n // 3) - (2 * total // everything)
    found = shared.agg(F.sum("share"), F.count(F.lit(1)), F.max("share")).first()
    assert tuple(found) == (total, n, 1) and left == total
    # All of the largest remainder (size 2 or 3 or 4 times the total) come first, ties by name.
    by_size = {r["n"]: (r["s"], r["last"]) for r in shared.groupBy("n").agg(F.sum("share").alias("s"), F.max(F.when(F.col("share") > 0, F.col("i"))).alias("last")).collect()}
    largest = n // 3
    assert by_size[4][0] == largest and by_size[3][0] == largest
    assert by_size[2] == (total - 2 * largest, 3 * (total - 2 * largest - 1))
    ranks = d.fold_ranks(sizes.where("part < 'c0000999'"), 3)
    last = {(r["part"], r["cut"]): r["rank"] for r in ranks.collect()}
    start = 0
    for i in range(999):
        size = i % 3 + 2
        for cut in (0, 1):
            assert last[f"c{i:07d}", cut] == sum(1 for j in range(start, start + size) if j % 3 <= cut)
        start += size


def test_a_class_a_row_pair_is_split_without_one_task_for_all(spark):
    df = spark.range(4000).select("id", F.concat(F.lit("c"), F.floor(F.col("id") / 2)).alias("k"))
    split = d.split_data(df, "k", 0.5, keys=["id"])
    assert split.groupBy("k").agg(F.count_if(F.col("_split") == "test").alias("t")).where("t <> 1").isEmpty()
