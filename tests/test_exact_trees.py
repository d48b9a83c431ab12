"""Exact trees against a search over all cuts in numpy, with values in one range and in many."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from tabspark.operators import exact_trees as e
from tabspark.operators import models as m


def data(n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 60, n) / 8, rng.normal(size=n).round(2), rng.integers(0, 2, n)], axis=1).astype(float)
    y = (x[:, 0] > 3).astype(int) + ((x[:, 1] > 0.2) & (x[:, 2] > 0)).astype(int)
    return x, np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), y), np.where(x[:, 2] > 0, 1.0, 0.5)


def grown(x, target, w, depth, least, min_split, classes):
    """Predictions (class shares or means) by trying every cut of every node."""

    def impurity(rows):
        n = w[rows].sum()
        if classes:
            return n - sum(w[rows][target[rows] == k].sum() ** 2 for k in range(classes)) / n
        mean = (w[rows] * target[rows]).sum() / n
        return (w[rows] * (target[rows] - mean) ** 2).sum()

    def leaf(rows):
        n = w[rows].sum()
        return [w[rows][target[rows] == k].sum() / n for k in range(classes)] if classes else [(w[rows] * target[rows]).sum() / n]

    out = np.zeros((len(x), classes or 1))

    def split(rows, left):
        whole = impurity(rows)
        if left and len(rows) >= min_split and whole > 1e-9:
            options = []
            for f in range(x.shape[1]):
                for v in np.unique(x[rows, f])[:-1]:
                    low, high = rows[x[rows, f] <= v], rows[x[rows, f] > v]
                    if min(len(low), len(high)) >= least:
                        options.append((round((whole - impurity(low) - impurity(high)) / whole, 11), -f, -v, low, high))
            if options:
                _, _, _, low, high = max(options, key=lambda t: t[:3])
                split(low, left - 1)
                split(high, left - 1)
                return
        out[rows] = leaf(rows)

    split(np.arange(len(x)), depth)
    return out


def fitted(spark, x, target, w, classes, **settings):
    cells = [(i, *map(float, r), float(t), float(v)) for i, (r, t, v) in enumerate(zip(x, target, w))]
    df = spark.createDataFrame(cells, "id int, x0 double, x1 double, x2 double, y double, w double").repartition(5)
    rows = VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="features").transform(df)
    columns = {"probabilityCol": "p"} if classes else {}
    return e.fit_exact_tree(rows, "features", "y", 3, classes, weight="w", **settings, **columns), rows


@pytest.mark.parametrize("per_range", [1_000_000, 70])
def test_classes_as_by_trying_every_cut(spark, monkeypatch, per_range):
    monkeypatch.setattr(e, "ROWS_PER_RANGE", per_range)
    x, y, w = data(300)
    model, rows = fitted(spark, x, y, w, 3, max_depth=3, min_split=5, min_leaf=2)
    found = {r["id"]: list(r["p"]) for r in model.transform(rows).select("id", "p").collect()}
    assert np.allclose([found[i] for i in range(len(x))], grown(x, y, w, 3, 2, 5, 3))


@pytest.mark.parametrize("per_range", [1_000_000, 50])
def test_numbers_as_by_trying_every_cut(spark, monkeypatch, per_range):
    monkeypatch.setattr(e, "ROWS_PER_RANGE", per_range)
    x, y, w = data(200)
    target = np.sin(x[:, 0]) + y
    model, rows = fitted(spark, x, target, w, 0, max_depth=2)
    found = {r["id"]: r["prediction"] for r in model.transform(rows).select("id", "prediction").collect()}
    assert np.allclose([found[i] for i in range(len(x))], grown(x, target, w, 2, 1, 2, 0)[:, 0])
    assert sum(model.featureImportances) == pytest.approx(1)


def test_one_value_everywhere_is_a_leaf_and_a_tree_survives_saving(spark, tmp_path):
    x, y = np.ones((20, 3)), np.arange(20) % 2
    model, rows = fitted(spark, x, y, np.ones(20), 2, max_depth=3)
    assert {tuple(r["p"]) for r in model.transform(rows).collect()} == {(0.5, 0.5)}
    df = spark.createDataFrame([(i, float(i), "b" if i > 6 else "a") for i in range(10)], "id int, v double, k string")
    both = df.selectExpr("*", "'train' AS _split").unionByName(df.selectExpr("*", "'test' AS _split"))
    trained, _ = m.train(both, "k", "decision_tree", "classification", ["v"], {"exact_splits": True})
    assert [(r["feature"], r["cut"]) for r in m.tree_nodes(trained).orderBy("node").collect()] == [("v", 6.5), (None, None), (None, None)]
    m.save_model(trained, f"file://{tmp_path}/tree")
    again = m.score(m.load_model(f"file://{tmp_path}/tree"), df)
    assert again.where("prediction <> k").isEmpty()
