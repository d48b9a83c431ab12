"""Models of a comparison are fitted side by side, on rows that are dealt out."""

from threading import Barrier

from pyspark.sql import functions as F

from tabspark.operators import models


def table(spark):
    x = (F.col("id") * 37 % 101 * 1.0).alias("x")
    y = (F.col("id") * 37 % 101 + F.col("id") % 20 > 60).cast("int").alias("y")
    split = F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("_split")
    return spark.range(400).coalesce(1).select("id", x, y, split)


def test_fits_wait_for_each_other_and_one_may_fail(spark, monkeypatch):
    """One after the other they would break the barrier."""
    together, fit, parts = Barrier(3, timeout=60), models._estimators, []

    def spy(rows, spec, n_classes):
        together.wait()
        parts.append(rows.rdd.getNumPartitions())
        if spec.model_type == "decision_tree":
            raise ValueError("no tree")
        return fit(rows, spec, n_classes)

    monkeypatch.setattr(models, "_estimators", spy)
    monkeypatch.setattr(models, "PART_ROWS", 50)
    found, best = models.compare_models(table(spark), "y", "classification", ["ridge_classifier", "decision_tree", "logistic_regression"], ["x"])
    got = {r["model"]: (r["accuracy"], r["status"]) for r in found.collect()}
    assert parts == [4, 4, 4]
    assert got["decision_tree"] == (None, "failed: no tree")
    assert got["ridge_classifier"][1] == got["logistic_regression"][1] == "success" and best is not None


def test_same_table_as_one_after_the_other(spark):
    names = ["decision_tree", "ridge_classifier"]
    together, _ = models.compare_models(table(spark), "y", "classification", names, ["x"])
    alone, _ = models.compare_models(table(spark), "y", "classification", names, ["x"], parallelism=1)
    assert together.collect() == alone.collect()


def test_rows_that_cannot_be_assembled_are_reported(spark):
    df = table(spark).withColumn("x", F.when(F.col("id") != 7, F.col("x")))
    found, best = models.compare_models(df, "y", "classification", ["ridge_classifier", "decision_tree"], ["x"])
    assert best is None and all(r["accuracy"] is None and r["status"].startswith("failed: ") for r in found.collect())
