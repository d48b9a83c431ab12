"""Fits of a search run side by side, on rows that are dealt out."""

from threading import Barrier, Lock

from pyspark.sql import functions as F

from tabspark.operators import models


def test_folds_of_one_setting_run_side_by_side(spark, monkeypatch):
    """Three fits of one setting wait for each other; one after the other they would break the barrier."""
    together, lock, seen, fit = Barrier(3, timeout=60), Lock(), [], models._estimators

    def spy(rows, spec, n_classes):
        with lock:
            seen.append(rows)
            first = len(seen) <= 3
        if first:
            together.wait()
        return fit(rows, spec, n_classes)

    monkeypatch.setattr(models, "_estimators", spy)
    df = spark.range(120).select("id", (F.col("id") % 7 * 1.0).alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    found, _, _ = models.tune(df, "y", "ridge_classifier", "classification", 3, ["x"], ["id"], {"alpha": [1.0]})
    assert found.count() == 1 and len(seen) == 4


def test_rows_of_one_part_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(models, "PART_ROWS", 50)
    rows = spark.range(400).coalesce(1).persist()
    dealt = models._dealt(rows)
    parts = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(parts) == 4 and max(parts) <= 150 and sum(parts) == 400
    assert not rows.is_cached and models._dealt(dealt) is dealt
    few = spark.range(80).coalesce(1).persist()
    assert models._dealt(few) is few
    empty = spark.range(0).persist()
    assert models._dealt(empty) is empty
    for df in (dealt, few, empty):
        df.unpersist()


def test_same_scores_dealt_or_not(spark, monkeypatch):
    df = spark.range(300).select("id", (F.col("id") * 37 % 101 * 1.0).alias("x"), (F.col("id") * 37 % 101 + F.col("id") % 20 > 60).cast("int").alias("y"))
    whole = models.tune(df.coalesce(1), "y", "logistic_regression", "classification", 3, ["x"], ["id"])[0].collect()
    monkeypatch.setattr(models, "PART_ROWS", 50)
    assert models.tune(df.coalesce(1), "y", "logistic_regression", "classification", 3, ["x"], ["id"])[0].collect() == whole
