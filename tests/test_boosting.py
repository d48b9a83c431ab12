"""Leaf-wise boosting against growing one leaf at a time in numpy, and what must hold for any partitioning."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tabspark.operators import boosting as b
from tabspark.operators import models as m


def data(n=900, seed=4):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 40, n), rng.integers(-5, 5, n) / 4, rng.integers(0, 2, n)], axis=1).astype(float)
    y = np.sin(x[:, 0] / 6) * 3 + x[:, 1] * x[:, 2] * 4 + rng.normal(size=n) * 0.3
    w = np.where(x[:, 2] > 0, 1.0, 0.5)
    return x, y, w


def leafwise(x, g, h, s, gain_mass):
    """A tree by splitting the leaf of highest gain, one at a time."""
    leaves = {0: (np.arange(len(x)), 0)}
    out = np.zeros(len(x))

    def best(rows, depth):
        if depth >= s.max_depth:
            return None
        found = []
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                low, high = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(low), len(high)) >= s.min_child_samples and min(h[low].sum(), h[high].sum()) >= s.min_child_weight:
                    gain = sum(g[p].sum() ** 2 / gain_mass[p].sum() for p in (low, high)) - g[rows].sum() ** 2 / gain_mass[rows].sum()
                    found.append((gain, -f, -cut, low, high))
        found = max(found, key=lambda t: t[:3], default=None)
        return found if found and found[0] > 1e-9 else None

    options = {0: best(*leaves[0])}
    while len(leaves) < s.num_leaves and any(options.values()):
        node = max((k for k in options if options[k]), key=lambda k: options[k][0])
        _, _, _, low, high = options.pop(node)
        _, depth = leaves.pop(node)
        for part in (low, high):
            new = max([*leaves, node]) + 1
            leaves[new] = (part, depth + 1)
            options[new] = best(part, depth + 1)
    for rows, _ in leaves.values():
        out[rows] = -s.learning_rate * g[rows].sum() / h[rows].sum()
    return out, len(leaves)


def brute(x, y, w, kind, s, n_classes=0):
    if kind == "squared":
        scores = np.full((len(x), 1), np.average(y, weights=w))
    else:
        share = np.array([w[y == k].sum() / w.sum() for k in range(n_classes)])
        scores = np.tile([np.log(share[1] / share[0])] if kind == "logistic" else np.log(share), (len(x), 1))
    for _ in range(s.n_estimators):
        new = scores.copy()
        for k in range(scores.shape[1]):
            if kind == "squared":
                g, h = scores[:, 0] - y, np.ones(len(y))
            elif kind == "logistic":
                p = 1 / (1 + np.exp(-scores[:, 0]))
                g, h = p - y, p * (1 - p)
            else:
                p = np.exp(scores[:, k]) / np.exp(scores).sum(axis=1)
                g = p - (y == k)
                h = n_classes / (n_classes - 1) * (p * (1 - p) if s.newton_gain else abs(g) * (1 - abs(g)))
            new[:, k] += leafwise(x, g * w, h * w, s, h * w if s.newton_gain else np.ones(len(x)))[0]
        scores = new
    return scores


def rows_of(spark, x, y, w):
    df = spark.createDataFrame([(*map(float, r), float(t), float(u)) for r, t, u in zip(x, y, w)], "a double, b double, c double, y double, w double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="v").transform(df)


@pytest.mark.parametrize("kind", ["squared", "logistic", "softmax", "softmax by rows"])
def test_equals_growing_one_leaf_at_a_time(spark, monkeypatch, kind):
    monkeypatch.setattr(b, "ROUNDS_PER_TABLE", 2)
    x, y, w = data()
    n_classes = {"squared": 0, "logistic": 2}.get(kind, 3)
    y = y if not n_classes else np.digitize(y, [0.0] if n_classes == 2 else [-1.0, 1.5]).astype(float)
    s = b.Boosting(3, 4, 0.3, 7, 10, newton_gain=kind != "softmax by rows")
    if kind == "softmax by rows":
        w = np.ones(len(y))
    df = rows_of(spark, x, y, w)
    model = b.fit_boosted(df.repartition(3), "v", "y", 3, n_classes, s, "w", predictionCol="p", probabilityCol="q")
    want = brute(x, y, w, kind.split()[0], s, n_classes)
    got = np.array([r[0] for r in df.select(model._scores(F.array("a", "b", "c"))).collect()])
    assert got == pytest.approx(want, rel=1e-5, abs=1e-5)
    other = b.fit_boosted(df.repartition(7).sortWithinPartitions("w"), "v", "y", 3, n_classes, s, "w", predictionCol="p", probabilityCol="q")
    assert json.loads(other.getOrDefault("forest")) == json.loads(model.getOrDefault("forest"))
    leaves = [sum(n["f"] < 0 for n in t["nodes"]) for t in json.loads(model.getOrDefault("forest"))["trees"]]
    assert max(leaves) == 7 and len(leaves) == 3 * max(1, n_classes if n_classes > 2 else 1)


def test_constant_feature_and_label_leave_the_start(spark):
    df = rows_of(spark, np.ones((50, 3)), np.full(50, 2.5), np.ones(50))
    model = b.fit_boosted(df, "v", "y", 3, 0, b.Boosting(2), None, predictionCol="p")
    assert {r["p"] for r in model.transform(df).collect()} == {2.5} and model.featureImportances.toArray().tolist() == [0, 0, 0]


def test_many_values_are_cut_into_bins(spark):
    """One pass a level and 255 bins a feature serve any number of distinct values."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("a"), F.lit(0.0).alias("b"))
    df = df.withColumn("y", F.when(F.col("a") < 7000, 1.0).otherwise(5.0))
    spec = m.make_spec(df, "y", "lightgbm", "regression", ["a", "b"], {"n_estimators": 30})
    model = m.fit_model(df, spec)
    error = m.score(model, df).select(F.avg(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert error < 0.15 and m.rank_features(model).first()["feature"] == "a"


def test_saved_and_loaded(spark, tmp_path):
    x, y, w = data(300)
    df = rows_of(spark, x, np.digitize(y, [-1.0, 1.5]).astype(float), w).drop("v", "w").withColumn("y", F.col("y").cast("int"))
    spec = m.make_spec(df, "y", "lightgbm", "classification", ["a", "b", "c"], {"n_estimators": 2})
    model = m.fit_model(df, spec)
    m.save_model(model, str(tmp_path / "model"))
    again = m.load_model(str(tmp_path / "model"))
    assert m.class_probabilities(again, df).collect() == m.class_probabilities(model, df).collect()
    assert "Python" not in m.score(again, df)._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_partition_are_dealt_to_all_cores(spark, monkeypatch):
    """Every pass scans the binned table: from one input partition it ran in one task."""
    parts, write = [], b.written
    monkeypatch.setattr(b, "written", lambda df: parts.append(df.rdd.getNumPartitions()) or write(df))
    rows = spark.range(400).coalesce(1).selectExpr("array(double(id % 10), double(id % 7)) AS a", "double(id % 10) AS y")
    rows = rows.select(array_to_vector("a").alias("x"), "y")
    model = b.fit_boosted(rows, "x", "y", 2, 0, b.Boosting(n_estimators=9, max_depth=2), predictionCol="p")
    assert len(parts) == 2 and min(parts) >= spark.sparkContext.defaultParallelism
    assert model.transform(rows).count() == 400


def test_packed_rows_read_back_from_slices():
    numbers = np.arange(12.0).reshape(4, 3)
    packed = b._packed(numbers)
    assert packed.to_pylist() == [r.tobytes() for r in numbers]
    for kind in (pa.binary(), pa.large_binary()):
        assert (b._matrix(packed.cast(kind).slice(1, 2), np.float64, 3) == numbers[1:3]).all()
    assert b._matrix(packed.slice(2, 0), np.float64, 3).shape == (0, 3)


def blocks_of(x, y, w, loss, trees, newton=True):
    """What a pass reads, made in this process: blocks with the slopes after ``trees``."""
    edges = [sorted(set(c)) for c in x.T]
    given = pa.record_batch([pa.array(list(x)), pa.array(y), pa.array(w)], names=["x", "y", "w"])
    first = b._binned(edges, [0.25] * loss.n_scores, True)(iter([given.slice(0, 500), given.slice(500)]))
    return list(b._advanced(trees, loss, x.shape[1], newton)(first))


def test_a_pass_reads_bins_and_slopes_alone(monkeypatch):
    """Scores move and slopes are found once a round; they were found again for every level, with all trees since the last table."""
    monkeypatch.setattr(b, "BLOCK_ROWS", 128)
    x, y, w = data()
    loss = b.Loss("squared", 1, 1.0, float(np.ptp(y)) * 2)
    tree = b.Tree()
    low, high = tree.split(0, 0, 20)
    tree.value[low], tree.value[high] = -1.0, 1.0
    made = blocks_of(x, y, w, loss, [(0, tree)])
    assert [len(r.column("y")[0].as_buffer()) // 8 for r in made] == [128] * 7 + [4]
    binned = np.concatenate([b._bins(r, 0, 3) for r in made], axis=1)
    scores = 0.25 + np.where(binned[0] <= 20, -1.0, 1.0)
    g, h = loss.slopes(scores[:, None], y, w, 0, True)
    monkeypatch.setattr(b.Loss, "slopes", None)
    grown = b.Tree()
    low, high = grown.split(0, 1, 4)
    left, right = grown.split(high, 0, 10)
    narrow = [r.select(["bins", "slopes"]) for r in made]
    found = list(b._histograms([(0, grown, [right, low])], loss, 3)(iter(narrow)))
    again = list(b._added(iter([*found[:2], *found])))
    sums = b._block(found[0], "sums", 0, 3 * 2 * 3 * 256, (np.int64,)).reshape(3, 2, 3, 256)
    assert len(found) == len(again) == 1 and (b._block(again[0], "sums", 0, sums.size, (np.int64,)) == 2 * sums.ravel()).all()
    for slot, rows in enumerate([(binned[1] > 4) & (binned[0] > 10), binned[1] <= 4]):
        for f in range(3):
            for j, v in enumerate((np.ones_like(g), g, h)):
                want = np.zeros(256, np.int64)
                np.add.at(want, binned[f][rows], v[rows])
                assert (sums[j, slot, f] == want).all()


def test_slopes_beyond_four_bytes_are_kept_whole():
    x, y, w = data(100)
    loss = b.Loss("logistic", 1, 1.0, 1.0 / (1 << 8))
    made = blocks_of(x, (y > 0).astype(float), w, loss, [])
    kept = b._block(made[0], "slopes", 0, 200, (np.int32, np.int64)).reshape(2, -1)
    g, h = loss.slopes(np.full((100, 1), 0.25), (y > 0).astype(float), w, 0, True)
    assert kept.dtype == np.int64 and (kept == [g, h]).all()


def test_same_sums_at_the_driver_or_in_tasks(spark, monkeypatch):
    x, y, w = data(400)
    df, s = rows_of(spark, x, y, w), b.Boosting(2, 3, 0.3, 5, 10)
    direct = b.fit_boosted(df, "v", "y", 3, 0, s, "w", predictionCol="p").getOrDefault("forest")
    monkeypatch.setattr(b, "DIRECT_BYTES", 0)
    monkeypatch.setattr(b, "CELLS_PER_TASK", 500)
    assert b.fit_boosted(df, "v", "y", 3, 0, s, "w", predictionCol="p").getOrDefault("forest") == direct
    assert not spark.sparkContext._jsc.getPersistentRDDs()
