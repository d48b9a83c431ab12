import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.operators import evaluation as v
from tabspark.operators import models as m
from tabspark.operators import splits as d


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3)) * [1, 10, 0.1]
    y = 3 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(size=600)
    z = (y + rng.normal(size=600) > 0).astype(int)
    k = np.digitize(y, [-2, 2])
    rows = [(i, *map(float, x[i]), float(y[i]), int(z[i]), "abc"[k[i]]) for i in range(600)]
    return d.split_data(
        spark.createDataFrame(rows, "id long, `a.1` double, `b 2` double, c double, y double, z int, k string"), "z", keys=["id"]
    ).persist()


FEATURES = ["a.1", "b 2", "c"]


def arrays(df, target):
    rows = df.select(*[F.col(f"`{c}`") for c in FEATURES], target).collect()
    a = np.array([list(r) for r in rows], dtype=float)
    return a[:, :-1], a[:, -1]


def terms(model):
    return {r["term"]: r["value"] for r in m.coefficients(model).collect()}


@pytest.mark.parametrize("alpha", [0.1, 1.0, 500.0])
def test_ridge_solves_the_normal_equations(table, alpha):
    model, _ = m.train(table, "y", "ridge", "regression", FEATURES, {"alpha": alpha})
    x, y = arrays(table.where("_split = 'train'"), "y")
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    got = terms(model)
    assert [got[c] for c in FEATURES] == pytest.approx(w.tolist(), rel=1e-9)
    assert got["intercept"] == pytest.approx(y.mean() - x.mean(0) @ w)


@pytest.mark.parametrize("weighted", [False, True])
def test_logistic_solves_the_penalised_likelihood(table, weighted):
    df = d.class_balance(table, "z") if weighted else table
    model, scored = m.train(df, "z", "logistic_regression", "classification", FEATURES, {"C": 0.5})
    train = df.where("_split = 'train'")
    x, y = arrays(train, "z")
    cw = np.array([r["_weight"] for r in train.select("_weight").collect()]) if weighted else np.ones(len(y))
    a, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ w))
        grad = 0.5 * a.T @ (cw * (p - y)) + np.append(w[:3], 0)
        hess = 0.5 * (a * (cw * p * (1 - p))[:, None]).T @ a + np.diag([1, 1, 1, 0])
        w -= np.linalg.solve(hess, grad)
    got = terms(model)
    assert [got[c] for c in [*FEATURES, "intercept"]] == pytest.approx(w.tolist(), abs=2e-4)
    assert model.has_probability and "probability" in scored.columns
    assert 0.8 < v.auc(scored).first()[0] <= 1


def test_lasso_drops_the_weak_feature(table):
    model, _ = m.train(table, "y", "lasso", "regression", FEATURES, {"alpha": 0.5})
    x, y = arrays(table.where("_split = 'train'"), "y")
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.zeros(3)
    for _ in range(2000):
        for j in range(3):
            rest = yc - xc @ w + xc[:, j] * w[j]
            c = xc[:, j] @ rest / len(y)
            w[j] = np.sign(c) * max(abs(c) - 0.5, 0) / (xc[:, j] @ xc[:, j] / len(y))
    got = terms(model)
    assert got["c"] == 0 and [got[c] for c in FEATURES] == pytest.approx(w.tolist(), abs=1e-5)


def test_ridge_classifier_votes(table):
    model, scored = m.train(table, "z", "ridge_classifier", "classification", FEATURES)
    assert not model.has_probability and "probability" not in scored.columns
    with pytest.raises(ValueError):
        v.roc_curve(scored)
    got = terms(model)
    votes = sum(F.col(f"`{c}`") * got[c] for c in FEATURES) + got["intercept"]
    assert scored.where((votes > 0).cast("int").cast("string") != F.col("prediction")).count() == 0
    many, _ = m.train(table, "k", "ridge_classifier", "classification", FEATURES)
    x, _ = arrays(table, "y")
    w = {}
    for r in m.coefficients(many).collect():
        w.setdefault(r["class"], {})[r["term"]] = r["value"]
    scores = np.array([[w[k][c] for c in FEATURES] for k in "abc"]) @ x.T + np.array([[w[k]["intercept"]] for k in "abc"])
    want = ["abc"[i] for i in scores.argmax(0)]
    assert [r["prediction"] for r in m.score(many, table).collect()] == want


@pytest.mark.parametrize("kind", ["decision_tree", "random_forest", "gradient_boosting", "lightgbm"])
def test_trees_learn_both_problems(table, kind):
    small = {"n_estimators": 5} if kind != "decision_tree" else {}
    model, scored = m.train(table, "z", kind, "classification", FEATURES, small)
    assert v.accuracy(scored).first()["accuracy"] > 0.7 and model.has_probability
    assert sum(r["importance"] for r in m.rank_features(model).collect()) == pytest.approx(1, abs=1e-3)
    _, predicted = m.train(table, "y", kind, "regression", FEATURES, small)
    assert v.regression_metrics(predicted, 3).first()["r2"] > 0.4
    again, _ = m.train(table, "z", kind, "classification", FEATURES, small)
    assert [r["prediction"] for r in m.score(again, table).collect()] == [r["prediction"] for r in m.score(model, table).collect()]


def test_boosting_three_classes_has_probabilities(table):
    model, scored = m.train(table, "k", "gradient_boosting", "classification", FEATURES, {"n_estimators": 3})
    assert model.has_probability and set(model.classes) == {"a", "b", "c"}
    for r in m.class_probabilities(model, table).collect():
        assert set(r["probabilities"]) == set("abc") and sum(r["probabilities"].values()) == pytest.approx(1, abs=1e-12)
        assert r["probabilities"][r["prediction"]] == max(r["probabilities"].values())
    assert v.accuracy(scored).first()["accuracy"] > 0.5
    assert m.rank_features(model).first()["feature"] in FEATURES


def test_round_trip_and_saved_predictions(spark, table, tmp_path):
    for target, kind, problem in [("z", "logistic_regression", "classification"), ("k", "random_forest", "classification"), ("y", "lasso", "regression")]:
        model, scored = m.train(table, target, kind, problem, FEATURES, {"n_estimators": 3} if kind == "random_forest" else None, scale=True)
        path = f"{tmp_path}/{kind}"
        m.save_model(model, path)
        again = m.load_model(path)
        assert again.spec == model.spec and again.classes == model.classes
        assert sorted(map(tuple, m.score(again, table.where("_split = 'test'")).collect())) == sorted(map(tuple, scored.collect()))
    m.save_predictions(model, table, f"{tmp_path}/p.csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/p.csv")
    assert back.columns == [*FEATURES, "actual", "predicted"] and back.count() == 120
    with pytest.raises(FileNotFoundError):
        m.load_model(f"{tmp_path}/absent")


def test_requests_are_checked(table):
    for args in [("z", "svm", "classification"), ("z", "ridge", "classification"), ("z", "ridge", "ranking"), ("zz", "ridge", "regression")]:
        with pytest.raises(ValueError):
            m.train(table, *args, FEATURES)
    with pytest.raises(ValueError, match="must be numbers"):
        m.train(table, "z", features=["k"])
    with pytest.raises(ValueError, match="no settings to search"):
        m.tune(table, "y", "linear_regression", "regression", features=FEATURES)
    with pytest.raises(ValueError, match="fewer than two classes"):
        m.train(table.withColumn("z", F.lit(1)), "z", features=FEATURES)


def test_compare_reports_failures_and_picks_the_best(table):
    table_, best = m.compare_models(
        table, "z", features=FEATURES, model_types=["decision_tree", "logistic_regression", "random_forest"],
        params={"random_forest": {"n_estimators": -1}},
    )
    got = [(r["model"], r["accuracy"], r["status"][:6]) for r in table_.collect()]
    assert got[-1] == ("random_forest", None, "failed") and got[0][1] >= got[1][1]
    assert best.spec.model_type == got[0][0]


def test_class_weights_reach_models_that_take_them(table):
    df = d.class_balance(table, "z")
    assert m.make_spec(df, "z", "decision_tree", "classification", FEATURES).weighted
    assert not m.make_spec(df, "z", "gradient_boosting", "classification", FEATURES).weighted
    assert not m.make_spec(df, "y", "ridge", "regression", FEATURES).weighted
    assert "_weight" not in m.make_spec(df.drop("k", "y", "id"), "z", "decision_tree", "classification").features


def test_cross_validation_and_tuning(table):
    folds = m.cross_validate(table, "y", "ridge", "regression", 4, FEATURES, ["id"])
    assert [r["fold"] for r in folds.collect()] == [1, 2, 3, 4] and m.cv_summary(folds).first()["mean_score"] > 0.5
    results, best, scored = m.tune(table, "z", "logistic_regression", "classification", 3, FEATURES, ["id"])
    rows = results.collect()
    assert len(rows) == 6 and sum(r["best"] for r in rows) == 1
    top = max(rows, key=lambda r: r["mean_score"])
    chosen = json.loads(next(r["params"] for r in rows if r["best"]))
    assert {k: best.spec.params[k] for k in chosen} == chosen
    assert next(r["mean_score"] for r in rows if r["best"]) == top["mean_score"]
    assert scored.count() == 120


def test_retrain_scales_on_all_rows(table):
    model, _ = m.train(table, "y", "linear_regression", "regression", FEATURES, scale=True)
    full = m.retrain_full(model, table)
    x, y = arrays(table, "y")
    w = np.linalg.lstsq(np.hstack([(x - x.mean(0)) / x.std(0), np.ones((len(x), 1))]), y, rcond=None)[0]
    got = terms(full)
    assert [got[c] for c in [*FEATURES, "intercept"]] == pytest.approx(w.tolist(), rel=1e-8)


def test_learning_curve_grows(table):
    model, _ = m.train(table, "z", "logistic_regression", "classification", FEATURES)
    curve = m.learning_curve(table, model, 4, ["id"]).orderBy("size").collect()
    assert [r["size"] for r in curve] == [48, 192, 336, 480]
    assert all(0 <= r["val_score"] <= 1 for r in curve)


def test_preview_is_ordered(table):
    model, _ = m.train(table, "z", "decision_tree", "classification", FEATURES)
    ids = [r["id"] for r in m.preview_predictions(model, table, 5, ["id"]).collect()]
    assert ids == sorted(ids) and len(ids) == 5
    assert m.feature_importance(model, 2).count() == 2


def test_missing_features_are_refused(table):
    gap = table.withColumn("c", F.when(F.col("id") > 5, F.col("c")))
    with pytest.raises(Exception, match="null|NULL"):
        m.train(gap, "z", features=FEATURES)
