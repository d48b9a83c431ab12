"""Ridge by one matrix and by conjugate gradients against the normal equations."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tabspark.operators import ridge as r


def solved(x, y, w, alpha):
    mean, out = (w @ x) / w.sum(), (w @ y) / w.sum()
    z = x - mean
    b = np.linalg.solve(z.T @ (w[:, None] * z) + alpha * np.eye(x.shape[1]), z.T @ (w[:, None] * (y - out)))
    return b.T, out - mean @ b


@pytest.mark.parametrize("gram", [1024, 0])
@pytest.mark.parametrize("classes", [0, 2, 3])
def test_equals_the_normal_equations(spark, monkeypatch, gram, classes):
    monkeypatch.setattr(r, "GRAM_COLUMNS", gram)
    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=120) * 50 + 7, rng.random(120), np.ones(120), (rng.random(120) < 0.1) * 2.0], axis=1)
    y = rng.integers(0, classes, 120).astype(float) if classes else x @ [1, 2, 3, 4] + rng.normal(size=120)
    w = rng.random(120) + 0.5
    vectors = [Vectors.dense(v) if i % 2 else Vectors.sparse(4, [(j, a) for j, a in enumerate(v) if a]) for i, v in enumerate(x)]
    df = spark.createDataFrame([(v, float(a), float(b)) for v, a, b in zip(vectors, y, w)], ["features", "y", "w"]).repartition(3)
    model = r.fit_ridge(df, "features", "y", classes, 2.0, "w")
    slopes, intercepts = solved(x, r._targets(y, classes), w, 2.0)
    assert np.allclose(model.coefficientMatrix.toArray(), slopes, atol=1e-8)
    assert np.allclose(model.interceptVector.toArray(), intercepts, atol=1e-7)
    called = [row["prediction"] for row in model.transform(df).collect()]
    sums = [slopes @ row["features"].toArray() + intercepts for row in df.collect()]
    want = [s[0] if not classes else float(s[0] > 0) if classes == 2 else float(np.argmax(s)) for s in sums]
    assert np.allclose(called, want)


def test_five_thousand_one_hot_columns(spark):
    width, n = 5_000, 10_000
    df = spark.createDataFrame([(Vectors.sparse(width, [(i % width, 1.0)]), float(i % width % 3)) for i in range(n)], ["features", "y"])
    model = r.fit_ridge(df, "features", "y", 3, 0.5)
    assert model.transform(df.limit(300)).where("prediction <> y").isEmpty()
    # A shared level c and a slope of (t - c) * n / (n + alpha) for each one-hot column of n rows.
    t = np.where(np.arange(width) % 3 == 0, 1.0, -1.0)
    assert np.allclose(model.coefficientMatrix.toArray()[0], (t - t.mean()) * 2 / 2.5, atol=1e-6)
