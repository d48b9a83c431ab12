"""Hard negatives against comparing every anchor with every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.llm import negatives
from tabspark.llm.negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, k=10, every=100):
    seen = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        e = tuple(int(np.floor(256 * x)) for x in v)
        width = 2 if all(abs(x) < 1 << 15 for x in e) else 8
        key = (len(e), b"".join(int(x).to_bytes(width, "little", signed=True) for x in e), label)
        seen[i] = min(seen.get(i, (key, e, label)), (key, e, label))
    out = set()
    for a, (_, e, label) in seen.items():
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(e, f)), i, other == label) for i, (_, f, other) in seen.items() if i != a and len(f) == len(e)]
        for ps, p, _ in sorted(s for s in scores if s[2])[:positives]:
            fit = sorted((ns, n) for ns, n, same in scores if not same and 30 * -ps <= 100 * -ns <= 90 * -ps)
            out.update((a, p, r, n, -ps, -ns) for r, (ns, n) in enumerate(fit[:k], 1))
    return out


def clouds(n=700, dims=6, seed=3, n_labels=4, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_labels, dims))
    labels = rng.integers(0, n_labels, n)
    x = centres[labels] + spread * rng.normal(size=(n, dims)) + 0.4
    moved = np.where(np.arange(n) % 7 == 0, (labels + 1) % n_labels, labels)
    return [(int(i), [float(c) for c in v], int(lab)) for i, (v, lab) in enumerate(zip(x, moved))]


def result(spark, rows, **options):
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(5), **options).collect()
    return {tuple(r) for r in got}, len(got)


@pytest.mark.parametrize("options", [{}, {"rows_per_list": 60, "members_per_list": 3}])
def test_equals_all_comparisons(spark, monkeypatch, options):
    monkeypatch.setattr(negatives, "MEMBERS_PER_CLUSTER", 4)
    monkeypatch.setattr(negatives, "STEP", 16)
    rows = clouds()
    rows += [(1000 + i, rows[10][1], rows[10][2]) for i in range(60)]  # equal vectors of one label
    rows += [(2000 + 10 * i, rows[10][1], i % 3) for i in range(30)]  # and of several, anchors among them
    want = brute(rows, every=20)
    got, n = result(spark, rows, every=20, **options)
    assert got == want and n == len(want) > 500


def test_awkward_rows(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.5, 0.25], 2), (3, [0.5, 0.25], 2), (3, [0.5, 0.25], 2), (4, [0.6, 0.1], None),
        (5, None, 2), (6, [nan, 1.0], 2), (7, [None, 1.0], 2), (None, [0.5, 0.25], 2), (8, [0.5, 0.25, 0.1], 2), (100, [0.0, 0.0], 1),
        (200, [-1.0, -1.0], 3), (9, [1.0, 1.0], 3), (300, [], 4), (10, [], 4), (11, [], 5), (400, [3e4, 2e4], 6), (12, [3e4, 1e4], 6),
        (13, [1e4, 2e4], 7), (14, [0.5, 0.2], 2), (14, [0.4, 0.2], 2), (500, [1.0], 8), (15, [float("inf")], 8),
    ]
    got, n = result(spark, rows)
    assert got == brute(rows) and n == len(got)
    assert {r[0] for r in got} == {0, 100, 300, 400}


def test_empty_and_clashing_columns(spark):
    assert result(spark, [])[1] == 0
    rows = clouds(300)
    odd = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("id"), F.lit(1).alias("cluster"), F.lit(2).alias("exact"))
    assert {tuple(r) for r in hard_negatives(odd).collect()} == brute(rows)


def test_members_stop_before_the_end_of_a_list(spark, monkeypatch):
    """The bound ends a walk: of a long list only the head is compared."""
    read = []
    whole = negatives._products
    monkeypatch.setattr(negatives, "_products", lambda a, b, m: read.append(len(b)) or whole(a, b, m))
    rng = np.random.default_rng(1)
    vectors = np.vstack([[10.0, 0.1], np.c_[rng.uniform(0, 10, 20_000), rng.uniform(0, 1, 20_000)]])
    table = negatives.pa.table
    exact = [np.floor(256 * v).astype("<i8") for v in vectors]  # fits 16 bits too; both are read
    norms = [float(np.linalg.norm(e)) for e in exact]
    member = table({"id": [-1], "label": [1], "dims": [2], "exact": [exact[0].tobytes()], "norm": [norms[0]], "floor": [negatives.LOWEST]})
    bounds = [n * np.cos(max(0, np.arctan2(e[1], e[0]) - 0.01)) for n, e in zip(norms, exact)]
    listed = table({"id": range(len(exact)), "label": [1] * len(exact), "dims": [2] * len(exact), "exact": [e.tobytes() for e in exact], "norm": norms, "bound": bounds})
    found = negatives._find_positives(5)(member, listed).to_pylist()
    best = sorted((-int(e @ exact[0]), i) for i, e in enumerate(exact))[:5]
    assert [(-r["positive_score"], r["positive_id"]) for r in found] == best and sum(read) < 5000
