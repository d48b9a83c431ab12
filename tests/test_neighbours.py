"""Nearest-neighbour mutual information against comparing all rows, in one range and in many."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.functions import neighbours as nb
from tabspark.operators import selection as s


def psi(n):
    return sum(1 / i for i in range(1, int(n))) - 0.5772156649015329


def brute(v, y, k):
    kept = np.isin(y, [c for c in np.unique(y) if (y == c).sum() > 1])
    v, y = v[kept], y[kept]
    total = 0.0
    for i in range(len(v)):
        own = np.flatnonzero((y == y[i]) & (np.arange(len(v)) != i))
        d = np.abs(v[own] - v[i])
        r = np.sort(d)[min(k, len(own)) - 1]
        near = np.append(v[own][d <= r], v[i])
        low, high = min(v[i] - r, near.min()), max(v[i] + r, near.max())
        total += psi((d <= r).sum()) - psi(len(own) + 1) - psi(((v >= low) & (v <= high)).sum() - 1)
    return max(0.0, psi(len(v)) + total / len(v))


@pytest.mark.parametrize(("per_range", "chunk"), [(1_000_000, 100_000), (60, 7)])
def test_equals_comparing_all_rows(spark, monkeypatch, per_range, chunk):
    monkeypatch.setattr(nb, "ROWS_PER_RANGE", per_range)
    monkeypatch.setattr(nb, "CHUNK", chunk)
    rng = np.random.default_rng(8)
    y = np.append(rng.integers(0, 3, 240), [9, 7, 7])
    x = np.stack([rng.normal(size=243) + y, rng.integers(0, 12, 243) / 10 + (y == 1), np.ones(243)], axis=1)
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y)], "a double, b double, c double, y int").repartition(5)
    found = {r["feature"]: r["score"] for r in s.score_features(df, "y", "mutual_info_classif", n_neighbors=3).collect()}
    assert found == pytest.approx({c: brute(x[:, i], y, 3) for i, c in enumerate("abc")}, abs=1e-9)


def test_digamma_and_wrong_use(spark):
    df = spark.createDataFrame([(1,), (2,), (50,), (10**6,)], "n long")
    found = [r[0] for r in df.orderBy("n").select(nb.digamma(F.col("n"))).collect()]
    assert found[:3] == pytest.approx([psi(1), psi(2), psi(50)], abs=1e-13)
    assert found[3] == pytest.approx(math.log(1e6) - 0.5e-6, abs=1e-9)
    with pytest.raises(ValueError, match="n_neighbors"):
        s.score_features(spark.createDataFrame([(1.0, 2.0)], "a double, y double"), "y", "f_regression", n_neighbors=3)


def test_the_given_table_is_read_once(spark):
    """Its rows may come from joins that send a side to the driver, every time they run."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(0, 600, 1, 2).selectExpr("int(id % 2) AS y", "double(id % 50) AS a", "double(id % 7 + id % 2) AS b")
    scored = s.score_features(df.mapInArrow(counted, df.schema), "y", "mutual_info_classif", n_neighbors=3)
    assert scored.count() == 2 and seen.value == 600
