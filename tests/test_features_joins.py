import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.operators import features as f
from tabspark.operators import joins
from tabspark.operators.joins import merge_tables


def test_one_hot_drops_the_first_and_leaves_missing_at_zero(spark):
    df = spark.createDataFrame([("b", 1), (None, 1), ("a", 1), ("c", 1)], "c string, t int")
    out = f.encode_categorical(df, "t")
    assert out.columns == ["t", "c_b", "c_c"]
    assert [tuple(r)[1:] for r in out.collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]
    assert out.schema["c_b"].dataType.simpleString() == "tinyint"


def test_fifteen_values_are_one_hot_sixteen_are_coded(spark):
    df = spark.range(64).select(
        F.format_string("v%02d", F.col("id") % 15).alias("a"), F.format_string("v%02d", F.col("id") % 16).alias("b"), F.lit(1).alias("t")
    )
    enc = f.fit_encoding(df, "t")
    assert list(enc.one_hot) == ["a"] and list(enc.codes) == ["b"]
    out = f.apply_encoding(df, enc)
    assert len(out.columns) == 2 + 14 and out.agg(F.max("b")).first()[0] == 15


def test_text_target_is_coded_and_missing_is_text(spark):
    df = spark.createDataFrame([("z", 1), (None, 2), ("a", 3)], "t string, x int")
    out = f.encode_categorical(df, "t")
    assert {r["x"]: r["t"] for r in out.collect()} == {1: 2, 2: 1, 3: 0}


def test_booleans_are_categories(spark):
    df = spark.createDataFrame([(True, 1), (False, 2), (None, 3)], "b boolean, t int")
    out = f.encode_categorical(df, "t")
    assert {r["t"]: r["b_True"] for r in out.collect()} == {1: 1, 2: 0, 3: 0}


def test_quantile_edges_and_counts(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0, 0, 1, 2, 3, 4, 10]], "x double")
    bins = f.fit_bins(df, "x", 4)
    assert bins.edges == [0.0, 1.5, 3.25, 10.0]
    assert [r["row_count"] for r in f.bin_counts(df, bins).orderBy("bin").collect()] == [4, 2, 2]
    assert bins.labels == [str(i) for i in pd.qcut([0, 0, 0, 1, 2, 3, 4, 10], 4, duplicates="drop").categories.map(lambda i: f"({i.left:g}, {i.right:g}]")]


def test_uniform_edges_and_counts(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (10.0,), (None,)], "x double")
    bins = f.fit_bins(df, "x", 5, "uniform")
    assert bins.edges == pytest.approx([-0.01, 2, 4, 6, 8, 10])
    assert [r["row_count"] for r in f.bin_counts(df, bins).orderBy("bin").collect()] == [3, 0, 0, 0, 1]
    out = f.apply_bins(df, bins)
    assert out.where("x_original is null").first()["x"] is None
    with pytest.raises(ValueError):
        f.fit_bins(df, "x", 5, "uniform", ["only", "two"])
    with pytest.raises(ValueError):
        f.fit_bins(df, "x", 5, "other")


def test_constant_columns_bin_like_pandas(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert f.fit_bins(df, "x", 2, "uniform").edges == pytest.approx(pd.cut([2.0, 2.0], 2, retbins=True)[1].tolist())
    assert f.bin_continuous(df, "x", 3).first()["x"] is None


def test_log_rules(spark):
    df = spark.createDataFrame([(0.0, -1.0, 1.0, "a")] * 30 + [(1000.0, -1000.0, 2.0, "b")], "up double, neg double, flat double, s string")
    assert f.fit_log(df).columns == ["up", "flat"] or f.fit_log(df).columns == ["up"]
    gap = df.unionByName(df.limit(1).withColumn("up", F.lit(None).cast("double")))
    assert "up" not in f.fit_log(gap).columns
    chosen = f.fit_log(df, ["up", "neg", "s"])
    assert chosen.columns == ["up"] and chosen.skipped == {"s": "not numeric", "neg": "contains negative values"}
    assert f.apply_log(df, chosen).agg(F.max("up")).first()[0] == pytest.approx(math.log1p(1000))


def test_dates_in_several_layouts(spark):
    df = spark.createDataFrame([("2024-02-03 04:05:06",), ("2/3/2024",), ("2024/02/03",), ("junk",), (None,), ("2024-02-03T04:05",)], "d string")
    out = f.datetime_parts(df, "d", ["year", "day", "dayofweek", "is_weekend", "quarter"], drop_original=False)
    got = {r["d"]: tuple(r)[1:] for r in out.collect()}
    for d in ("2024-02-03 04:05:06", "2/3/2024", "2024/02/03", "2024-02-03T04:05"):
        assert got[d] == (2024, 3, 5, 1, 1)
    assert got["junk"] == (None, None, None, 0, None)
    assert f.datetime_failures(df, "d").first()[0] == 1
    with pytest.raises(ValueError):
        f.datetime_parts(df, "d", ["century"])


def test_interactions_skip_bad_pairs(spark):
    df = spark.createDataFrame([(2, 3.0, "a")], "a int, b double, s string")
    out = f.create_interactions(df, [("a", "b"), ("a",), ("a", "s"), ("a", "q")])
    assert out.columns == ["a", "b", "s", "a_x_b"] and out.first()["a_x_b"] == 6.0
    assert [x[1] for x in f.skipped_pairs(df, [("a",), ("a", "s"), ("a", "q")])] == ["must be length 2", "not numeric", "column not found"]


def test_large_products_do_not_overflow(spark):
    df = spark.createDataFrame([(2**62, 2**62)], "a long, b long")
    assert f.create_interactions(df, [("a", "b")]).first()["a_x_b"] == float(2**62) ** 2


def test_ratio_of_zero_takes_the_median(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 4.0), (None, 1.0)], "a double, b double")
    assert [r["a_div_b"] for r in f.create_ratios(df, [("a", "b")]).collect()] == [0.5, 0.5, 0.5]
    assert tuple(f.ratio_report(df, f.fit_ratios(df, [("a", "b")])).first()) == ("a_div_b", 0, 2)


def test_group_rules_for_missing(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None), ("a", None), ("b", 2.0)], "g string, x double")
    out = f.aggregate_features(df, "g", ["x"], ["sum", "count", "mean", "std", "median"])
    got = sorted({tuple(r)[:1] + tuple(r)[2:] for r in out.collect()}, key=str)
    assert got == [("a", 0.0, 0, None, None, None), ("b", 2.0, 1, 2.0, None, 2.0), (None, None, None, None, None, None)]
    with pytest.raises(ValueError):
        f.aggregate_features(df, "g", ["x"], ["mode"])


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_merge_equals_pandas(spark, rows, how):
    left = pd.DataFrame({"k": ["a", "b", None, "b", "z"], "v": [1, 2, 3, 4, 5], "l": [1.0, 2.0, 3.0, 4.0, 5.0]})
    right = pd.DataFrame({"k": ["b", None, "c", "b"], "v": [10, 20, 30, 40], "r": [7, 8, 9, 6]})
    want = left.merge(right, on="k", how=how)
    a = spark.createDataFrame([tuple(None if pd.isna(x) else x for x in t) for t in left.itertuples(index=False)], "k string, v long, l double")
    b = spark.createDataFrame([tuple(None if pd.isna(x) else x for x in t) for t in right.itertuples(index=False)], "k string, v long, r long")
    got = merge_tables(a, b, on="k", how=how)
    assert got.columns == want.columns.tolist()
    plain = lambda t: tuple(None if pd.isna(x) else (float(x) if not isinstance(x, str) else x) for x in t)
    assert sorted(map(plain, got.collect()), key=str) == sorted(map(plain, want.itertuples(index=False)), key=str)


def test_merge_errors(spark):
    a, b = spark.range(1).toDF("a"), spark.range(1).toDF("b")
    for bad in [dict(how="cross"), dict(), dict(left_on="a"), dict(on="a"), dict(left_on=["a"], right_on=["b", "b"])]:
        with pytest.raises(ValueError):
            merge_tables(a, b, **bad)
    assert merge_tables(a, b, left_on="a", right_on="b").columns == ["a", "b"]


def test_merge_keeps_an_equi_join(spark):
    a = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    b = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    plan = merge_tables(a, b, left_on="o_custkey", right_on="c_custkey", how="outer")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("how", joins.KINDS)
def test_hot_keys_are_joined_in_blocks(spark, rows, monkeypatch, how):
    a = spark.createDataFrame([("n" if i % 3 else None, i) for i in range(12)] + [("a", 12), ("a", 12)], "k string, v long")
    b = spark.createDataFrame([(None, i) for i in range(5)] + [("n", 7), ("n", 7), ("b", 8)], "k string, w long")
    want = rows(merge_tables(a, b, on="k", how=how))
    monkeypatch.setattr(joins, "HOT_PAIRS", 3)
    monkeypatch.setattr(joins, "BLOCK_ROWS", 2)
    assert rows(merge_tables(a, b, on="k", how=how)) == want


@pytest.mark.parametrize("how", joins.KINDS)
def test_no_task_makes_all_pairs_of_missing_keys(spark, how):
    a = spark.range(3000).selectExpr("CAST(NULL AS long) AS k", "id AS v")
    b = spark.range(1000).selectExpr("CAST(NULL AS long) AS k", "id AS w")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = merge_tables(a, b, on="k", how=how).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    counts = [r["count"] for r in made]
    assert sum(counts) == 3_000_000 and max(counts) < 2_500_000
