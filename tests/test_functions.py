"""The paths that only large inputs take, forced on small ones and checked against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.functions import ordering, quantiles, session, stats
from tabspark.functions.columns import nan_to_null, numeric_columns


def skewed(spark, n=20_000):
    """One third of all rows share a value, a third of all rows share a group, some values are missing."""
    df = spark.range(n).withColumn("u", (F.col("id") * 7919) % 10007)
    return df.select(
        "id",
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).when(F.col("id") % 11 != 0, F.col("u") / 7.0).alias("x"),
        F.when(F.col("id") % 3 == 1, F.lit("hot")).when(F.col("id") % 13 != 0, F.concat(F.lit("g"), F.col("u") % 50)).alias("g"),
        (F.col("u") % 17).cast("double").alias("y"),
    )


@pytest.mark.parametrize("limit", [5, 500, 1_000_000])
def test_exact_quantiles_equal_pandas(spark, limit):
    df = skewed(spark)
    probs = [0.0, 0.05, 0.25, 0.5, 0.613, 0.75, 0.999, 1.0]
    found = quantiles.exact_quantiles(df, ["x", "y", "id"], probs, small=limit)
    pdf = df.toPandas()
    for c in ("x", "y", "id"):
        assert found[c] == pytest.approx(pdf[c].quantile(probs).tolist(), rel=1e-12)


@pytest.mark.parametrize("small", [4096, 1])
def test_exact_quantiles_of_any_magnitude(spark, small):
    """Values of very different size, of both signs, nearly equal ones, the least and greatest doubles, and infinities."""
    rng = np.random.default_rng(2)
    wide = np.exp(rng.uniform(-700, 700, 900)) * rng.choice([-1.0, 1.0], 900)
    close = np.nextafter(1.0, 2.0) ** rng.integers(0, 50, 900)
    edge = np.tile([5e-324, 1e-323, 1.5e-323, -5e-324, 1.7e308, -1.7e308, 0.0, -0.0, 1.0], 100)
    ends = np.where(np.arange(900) < 200, -np.inf, np.where(np.arange(900) < 300, np.inf, rng.normal(size=900)))
    columns = {"wide": wide, "close": close, "edge": edge, "ends": ends, "tail": np.r_[np.zeros(899), 1e300]}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns.values())], list(columns)).repartition(3)
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0]
    found = quantiles.exact_quantiles(df, list(columns), probs, small=small)
    for c, v in columns.items():
        v = np.sort(v)
        for p, q in zip(probs, found[c]):
            at = p * (len(v) - 1)
            low, high = float(v[int(np.floor(at))]), float(v[int(np.ceil(at))])
            assert q == (low if low == high else low + (high - low) * (at - np.floor(at))), (c, p)


def test_quantiles_put_no_map_or_sketch_together(spark, monkeypatch):
    """Every round is an aggregate by (range, cell) with bounded results, however many rows and values."""
    rounds = []
    whole = quantiles._round
    monkeypatch.setattr(quantiles, "CELLS", 32)
    monkeypatch.setattr(quantiles, "_round", lambda df, ranges, *a: rounds.append([r.rows for r in ranges]) or whole(df, ranges, *a))
    df = spark.range(50_000).select((F.col("id") * 7919 % 50_021).alias("x"))
    assert quantiles.exact_quantiles(df, ["x"], [0.25, 0.5], small=40)["x"] == np.quantile(np.arange(50_000) * 7919 % 50_021, [0.25, 0.5]).tolist()
    assert rounds[0] == [50_000] and max(rounds[1]) < 50_000 / 20 and len(rounds) <= 4


def test_exact_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert quantiles.exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.5]}
    assert quantiles.exact_quantiles(df, ["a", "b"], [0.5], small=1) == {"a": [None], "b": [1.5]}


@pytest.mark.parametrize("accuracy", [10_000, 200])
def test_grouped_median_equals_pandas(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "SKETCH_MARGIN", 4 / accuracy)
    df = skewed(spark)
    for value in ("x", "y"):
        found = {r["g"]: r["m"] for r in quantiles.grouped_median(df, "g", value, "m").collect()}
        want = df.toPandas().groupby("g")[value].median().to_dict()
        assert found == pytest.approx(want)


def test_hash_cuts_refine_like_a_full_sort(spark, monkeypatch):
    df = skewed(spark, 5000).where("g is not null")
    sizes = ordering.part_sizes(df, "g")
    ranks = sizes.select("part", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("cut"), (F.col("n") * (F.col("cut") + 1) / 3).cast("long").alias("rank"))
    pdf = df.select("g", ordering.order_hash(["id"]).alias("h")).toPandas()
    ordered = {g: sorted(p["h"]) for g, p in pdf.groupby("g")}
    wanted = {(r["part"], r["cut"]): r["rank"] for r in ranks.collect()}
    for limit in (1_000_000, 20):
        monkeypatch.setattr(ordering, "BUCKET_ROWS", limit)
        cuts = {r["part"]: r["cuts"] for r in ordering.hash_cuts(df, "g", ["id"], ranks).collect()}
        for (g, cut), rank in wanted.items():
            assert cuts[g][cut] == (ordered[g][rank - 1] if rank else "")


def test_hash_cuts_without_small_sides(spark, monkeypatch):
    """Many classes: nothing is held on the driver, the same rows come out."""
    df = skewed(spark, 3000).where("g is not null")
    sizes = ordering.part_sizes(df, "g")
    ranks = sizes.select("part", "n", F.lit(0).alias("cut"), F.ceil(F.col("n") / 4).alias("rank"))
    held = ordering.chunk_number(df, "g", ["id"], ordering.hash_cuts(df, "g", ["id"], ranks), "c")
    want = {r["id"]: r["c"] for r in held.collect()}
    monkeypatch.setattr(ordering, "small_side", lambda d, *a: d)
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 50)
    joined = ordering.chunk_number(df, "g", ["id"], ordering.hash_cuts(df, "g", ["id"], ranks), "c")
    assert {r["id"]: r["c"] for r in joined.collect()} == want


def test_shared_keys_are_refused_and_row_ids_help(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate("a" * 30 + "b" * 10)], "k string, i long")
    with pytest.raises(Exception, match="share the key"):
        ordering.first_rows(df, 7, ["k"]).collect()
    kept = ordering.first_rows(ordering.with_row_id(df), 7, ["row_id"])
    assert kept.count() == 7


def test_first_rows_is_exact_and_repeatable(spark):
    df = skewed(spark, 3000)
    one = {r["id"] for r in ordering.first_rows(df, 100, ["id"]).collect()}
    two = {r["id"] for r in ordering.first_rows(df.repartition(5), 100, ["id"]).collect()}
    assert one == two and len(one) == 100
    assert {r["id"] for r in ordering.first_rows(df, 100, ["id"], seed=7).collect()} != one
    assert ordering.first_rows(df, 5000, ["id"]).count() == 3000


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals_equal_pandas(spark, monkeypatch, descending):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 100)
    df = skewed(spark, 5000).select("x", F.lit(1).cast("long").alias("one"), F.col("id"))
    found = ordering.running_totals(df, "x", ["one", "id"], descending).toPandas().sort_values("x", ascending=not descending)
    grouped = df.toPandas().dropna().groupby("x")[["one", "id"]].sum().sort_index(ascending=not descending)
    assert found["x"].tolist() == grouped.index.tolist()
    assert found["cum_one"].tolist() == grouped["one"].cumsum().tolist()
    assert found["cum_id"].tolist() == grouped["id"].cumsum().tolist()


@pytest.mark.parametrize("limit", [3, 100_000])
def test_dense_codes_are_sorted_positions(spark, limit):
    words = ["pear", "Apple", "äpfel", "fig", "apple", "", "fig", "zoo", "ζ", "😀", "￿"]
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    codes = {r["value"]: r["code"] for r in ordering.dense_codes(df, limit).collect()}
    assert codes == {w: i for i, w in enumerate(sorted(set(words)))}


def test_small_side_keeps_large_tables_distributed(spark):
    df = spark.range(10)
    assert session.small_side(df, 5) is df
    held = session.small_side(df, 10)
    assert "LocalTableScan" in held._jdf.queryExecution().toString() and held.count() == 10


def test_groups_fit_broadcast_checks_keys_and_width(spark, monkeypatch):
    df = spark.range(1000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    assert session.groups_fit_broadcast(df, "k", 3)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1000)
    assert not session.groups_fit_broadcast(df, "k", 3)


def test_correlations_equal_pandas(spark):
    df = skewed(spark, 3000).select("id", "x", "y", F.when(F.col("id") % 4 != 0, F.col("y") + F.col("x")).alias("z"), F.lit(0.1).alias("c"))
    names = numeric_columns(df)
    found = stats.corr_pairs(df, stats.upper_pairs(names))
    want = df.toPandas()[names].corr()
    for (a, b), r in found.items():
        if "c" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-12)


def test_correlation_of_a_subset_far_from_the_mean(spark):
    """Where both are present x varies by a hair around a far value: rounding must not hide it."""
    rng = np.random.default_rng(0)
    near = [(1e6 + 1e-3 * i, float(i) + rng.normal()) for i in range(200)]
    far = [(float(v), None) for v in rng.normal(0, 1e5, 2000)]
    df = spark.createDataFrame(near + far, "x double, y double")
    want = pd.DataFrame(near, columns=["x", "y"]).corr().loc["x", "y"]
    assert stats.corr_pairs(df, [("x", "y")])["x", "y"] == pytest.approx(want, abs=1e-6)


def test_correlation_where_one_side_is_constant_beside_the_other(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (5.0, None), (None, 4.0)], "x double, y double")
    assert stats.corr_pairs(df, [("x", "y")])["x", "y"] is None


def test_skew_rules(spark):
    def one(values):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        return df.agg(stats.skew(F.col("x"))).first()[0]

    assert one([1.0, 2.0]) is None
    assert one([3.0, 3.0, 3.0]) == 0.0
    assert one([1.0, 2.0, 10.0, None]) == pytest.approx(pd.Series([1.0, 2.0, 10.0]).skew())


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, None)], "x double, s string")
    assert [r["x"] for r in nan_to_null(df).collect()] == [None, 1.0]


def test_rounded_matches_spark(spark):
    values = [0.12345, -0.00004, 2.5e-5, 1234.56785, 1e17]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [stats.rounded(v) for v in values] == [r[0] for r in df.select(F.round("x", 4)).collect()]


def test_frequent_groups_join_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(session, "HOT_SHARE", 10)
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 50 != 1, F.col("id") % 100).alias("g"), "id")
    groups = session.written(df.where("g is not null").groupBy(F.col("g").alias("k")).agg(F.count("*").alias("n"), F.sum("id").alias("s")))
    joined = session.join_groups(df, "g", groups, "k", "n")
    got = {r["id"]: (r["g"], r["s"]) for r in joined.collect()}
    sums = {r["k"]: r["s"] for r in groups.collect()}
    assert len(got) == joined.count() == 1000 and all(s == sums.get(g) for g, s in got.values())
    hot = [r for r in joined._jdf.queryExecution().toString().split("\n") if "LocalTableScan" in r or "LocalRelation [k" in r]
    assert hot and "BroadcastHashJoin" in joined._jdf.queryExecution().toString()


def test_correlations_far_from_the_first_rows(spark):
    """First rows far away from all others, gaps, a constant and a large offset: one or two scans, as numpy has it."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=4000)
    a[:1500] += 1e7
    b = a * 0.5 + rng.normal(size=4000)
    c = 1e9 + rng.normal(size=4000)
    d = np.where(np.arange(4000) % 3 == 0, np.nan, b + rng.normal(size=4000))
    table = pd.DataFrame({"a": a, "b": b, "c": c, "d": d, "e": 5.0})
    df = spark.createDataFrame([tuple(None if x != x else x for x in r) for r in table.itertuples(index=False)], "a double, b double, c double, d double, e double")
    pairs = stats.upper_pairs(list("abcde"))
    got = stats.corr_pairs(df.coalesce(1), pairs)
    for x, y in pairs:
        want = table[x].corr(table[y])
        assert got[x, y] is None if "e" in (x, y) else abs(got[x, y] - want) < 1e-6, (x, y)


def test_correlations_take_one_scan(spark):
    """Close to the first rows, no second scan of the table is needed."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(0, 200_000, 1, 4).selectExpr("double(id % 50) AS a", "double(id % 7) AS b").mapInArrow(counted, "a double, b double")
    assert stats.corr_pairs(df, [("a", "b")])["a", "b"] is not None
    assert 200_000 <= seen.value < 300_000
