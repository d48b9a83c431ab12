import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.operators import charts as g
from tabspark.operators import evaluation as v


def scored(spark, n=400):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(y * 0.3 + rng.random(n) * 0.7, 0, 1), 2)
    rows = [(int(a), int(b > 0.5), float(b)) for a, b in zip(y, p)]
    return spark.createDataFrame(rows, "label int, prediction int, probability double"), y, p


def test_auc_counts_pairs(spark):
    df, y, p = scored(spark)
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert v.auc(df).first()[0] == pytest.approx(want, abs=5e-5)
    curve = v.roc_curve(df).orderBy("fpr", "tpr").toPandas()
    assert np.trapezoid(curve["tpr"], curve["fpr"]) == pytest.approx(want, abs=1e-9)


def test_average_precision_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.7), (0, 0.1)], "label int, probability double")
    assert v.average_precision(df).first()[0] == pytest.approx(round(1 / 3 * 1 + 2 / 3 * 3 / 4, 4))
    end = v.pr_curve(df).where("threshold is null").first()
    assert (end["precision"], end["recall"]) == (1.0, 0.0)


def test_curves_need_two_labels_and_probabilities(spark):
    one = spark.createDataFrame([(1, 0.5), (1, 0.6)], "label int, probability double")
    three = spark.createDataFrame([(0, 0.5), (1, 0.6), (2, 0.6)], "label int, probability double")
    for df in (one, three, one.drop("probability")):
        with pytest.raises(ValueError):
            v.roc_curve(df)
    words = spark.createDataFrame([("no", 0.2), ("yes", 0.9)], "label string, probability double")
    assert v.auc(words).first()[0] == 1.0


def test_calibration_edges_belong_to_the_lower_bin(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.1), (1, 0.11), (0, 1.0)], "label int, probability double")
    got = {r["bin"]: (r["row_count"], r["fraction_positive"]) for r in v.calibration(df).collect()}
    assert got == {0: (2, 0.5), 1: (1, 1.0), 9: (1, 0.0)}
    with pytest.raises(ValueError):
        v.calibration(df.withColumn("probability", F.col("probability") * 2))


def test_calibration_counts_rows_not_scores(spark):
    rows = [(1, 0.32)] * 5 + [(0, 0.32)] * 3 + [(1, 0.38)] + [(0, 0.75)] * 4
    df = spark.createDataFrame(rows, "label int, probability double")
    got = {r["bin"]: tuple(r)[1:] for r in v.calibration(df).collect()}
    assert got[3] == pytest.approx(((8 * 0.32 + 0.38) / 9, 6 / 9, 9)) and got[7] == (0.75, 0.0, 4)
    gap = v.calibration_gap(df).first()[0]
    assert gap == pytest.approx((abs(6 / 9 - (8 * 0.32 + 0.38) / 9) + 0.75) / 2, abs=5e-5)


def test_metrics_cover_labels_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "label string, prediction string")
    got = {r["class"]: tuple(r)[1:] for r in v.classification_metrics(df).collect()}
    assert got["b"] == (0.0, 0.0, 0.0, 0) and got["c"] == (0.0, 0.0, 0.0, 1)
    assert got["a"] == (0.5, 0.5, 0.5, 2)
    assert got["accuracy"][0] == pytest.approx(0.3333)
    assert got["macro avg"][0] == pytest.approx(0.1667) and got["weighted avg"][0] == pytest.approx(0.3333)
    matrix = {(r["actual"], r["predicted"]): r["row_count"] for r in v.confusion_matrix(df).collect()}
    assert len(matrix) == 9 and sum(matrix.values()) == 3 and matrix["c", "a"] == 1


def test_adjusted_r2_needs_rows(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "label double, prediction double")
    assert v.regression_metrics(df, 2).first()["adjusted_r2"] is None
    assert v.regression_metrics(df, 1).first()["adjusted_r2"] is not None
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    assert v.regression_metrics(flat, 5).first()["r2"] == 1.0
    assert v.regression_metrics(flat.withColumn("prediction", F.lit(2.0)), 5).first()["r2"] == 0.0


def test_report_follows_the_problem_type(spark):
    df, _, _ = scored(spark, 40)
    sections = v.report({"main": df}, "m", df, "classification", 1)
    assert {r["section"] for r in sections.collect()} == {"shape", "model", "metrics"}
    assert sections.where("item = 'accuracy f1'").count() == 1


def test_histograms_match_numpy(spark):
    x = np.random.default_rng(0).normal(size=500)
    df = spark.createDataFrame([(float(a),) for a in x] + [(None,)], "x double")
    for bins in (7, 30, "auto"):
        got = g.histogram(df, "x", bins).orderBy("bin").collect()
        counts, edges = np.histogram(x, bins)
        assert [r["row_count"] for r in got] == counts.tolist()
        assert [r["lower_edge"] for r in got] == pytest.approx(edges[:-1].tolist())
    flat = spark.createDataFrame([(2.0,)] * 3, "x double")
    assert [r["row_count"] for r in g.histogram(flat, "x", 3).orderBy("bin").collect()] == np.histogram([2.0] * 3, 3)[0].tolist()
    assert g.histogram(df.where("x is null"), "x").count() == 0


def test_density_is_close_to_the_exact_kernel_sum(spark):
    x = np.random.default_rng(1).normal(size=300)
    df = spark.createDataFrame([(float(a),) for a in x], "x double")
    got = g.density(df, "x").orderBy("x").collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    for r in got[::20]:
        exact = np.exp(-(((r["x"] - x) / h) ** 2) / 2).sum() / (len(x) * h * np.sqrt(2 * np.pi))
        assert r["density"] == pytest.approx(exact, rel=1e-2)


def test_boxplot_and_heatmap_rules(spark):
    df = spark.createDataFrame([(float(a), "s") for a in [1, 2, 3, 4, 100]] + [(None, "s")], "x double, s string")
    r = g.boxplot_stats(df).first()
    assert (r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"], r["outlier_count"]) == (2, 3, 4, 1, 4, 1)
    with pytest.raises(ValueError):
        g.boxplot_stats(df, ["s"])
    wide = df.withColumn("y", F.col("x") * 2).withColumn("c", F.lit(1.0))
    cells = {(q["col_1"], q["col_2"]): q["correlation"] for q in g.correlation_heatmap(wide).collect()}
    assert len(cells) == 9 and cells["x", "x"] == 1.0 and cells["y", "x"] == cells["x", "y"] == 1.0 and cells["c", "c"] is None


def test_residual_grid_counts_every_point_once(spark):
    rng = np.random.default_rng(1)
    y, e = rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(a - b)) for a, b in zip(y, e)] + [(None, 1.0), (1.0, None)], "label double, prediction double")
    grid = v.residual_grid(df, 6).toPandas()
    want, xs, ys = np.histogram2d(y - e, y - (y - e), bins=6)
    found = np.zeros((6, 6))
    found[grid["x_bin"], grid["y_bin"]] = grid["row_count"]
    assert (found == want).all() and np.allclose(grid["x_low"], xs[grid["x_bin"]]) and np.allclose(grid["y_high"], ys[grid["y_bin"] + 1])
    assert v.residual_grid(df.where("label IS NULL")).count() == 0
    assert [tuple(r) for r in v.residual_grid(df.limit(0).unionByName(spark.createDataFrame([(2.0, 2.0)] * 3, df.schema)), 4).select("x_bin", "y_bin", "row_count").collect()] == [(2, 2, 3)]
