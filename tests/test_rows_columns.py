import pytest
from pyspark.sql import functions as F

from tabspark.operators import columns as c
from tabspark.operators import profiling as p
from tabspark.operators import rows as r


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(
        [(1, "ab", 1.0), (2, "b", None), (3, None, 3.0), (4, "ab", 40.0)], "i long, s string, x double"
    )


@pytest.mark.parametrize(
    "kind, column, value, want",
    [
        ("eq", "s", "ab", [1, 4]),
        ("neq", "s", "ab", [2, 3]),
        ("gt", "x", 1.0, [3, 4]),
        ("gte", "x", 3, [3, 4]),
        ("lt", "x", 3, [1]),
        ("lte", "x", 3, [1, 3]),
        ("contains", "s", "^a", [1, 4]),
        ("not_contains", "s", "^a", [2, 3]),
        ("contains", "x", "0", [1, 3, 4]),
        ("isin", "s", ["b"], [2]),
        ("isin", "s", ["b", None], [2, 3]),
        ("notin", "s", ["b"], [1, 3, 4]),
        ("notin", "s", [], [1, 2, 3, 4]),
        ("isnull", "x", None, [2]),
        ("notnull", "x", None, [1, 3, 4]),
    ],
)
def test_conditions(small, kind, column, value, want):
    assert sorted(x["i"] for x in r.filter_rows(small, column, kind, value).collect()) == want


def test_condition_errors(small):
    for args in [("s", "like", "a"), ("s", "eq", None), ("nope", "eq", 1), ("s", "isin", "ab")]:
        with pytest.raises(ValueError):
            r.filter_rows(small, *args)


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = r.filter_rows(df, "l_quantity", "gt", 45.0).select("l_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a")], "a int, b string")
    assert r.drop_duplicates(df).count() == 2


def test_outliers_are_counted_without_and_removed_with_nulls(spark):
    df = spark.createDataFrame([(float(v), 1) for v in range(20)] + [(1000.0, 1), (None, 1)], "x double, t int")
    assert [tuple(x)[:2] for x in p.detect_outliers(df, "t").collect()] == [("x", 1)]
    assert tuple(p.outlier_rows(df, "t").first()) == (1, 22)
    assert r.remove_outliers(df, "t").count() == 20


def test_subsample_rules(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 90, F.when(F.col("id") < 60, "a").otherwise("b")).alias("s"))
    assert r.subsample(df, 100, ["id"]) is df
    assert r.subsample(df, 10, ["id"]).count() == 10
    kept = r.subsample(df, 25, ["id"], stratify="s").groupBy("s").count().collect()
    # 25 * 60 / 100 = 15, 25 * 30 / 100 = 7.5 -> 8; rows without a stratum are left out.
    assert {x["s"]: x["count"] for x in kept} == {"a": 15, "b": 8}
    assert r.subsample(df, 25, ["id"], stratify="absent").count() == 25


def test_semi_filter_matches_missing_keys(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(2,), (None,), (None,)], "k int")
    assert sorted(str(x["k"]) for x in r.semi_filter(left, right, "k").collect()) == ["2", "None"]


def test_fill_rules(spark):
    df = spark.createDataFrame(
        [("b", None, 1, None, True, 1), ("a", None, None, None, None, 2), ("c", None, 4, None, False, 3), ("b", None, 2, None, False, 4), ("a", None, 3, None, None, 5), (None, None, None, None, None, None)],
        "s string, n double, i long, e string, f boolean, t int",
    )
    fill = c.fit_fill(df, "t")
    assert fill.values == {"s": "a", "n": 0.0, "i": 2.5, "e": "Unknown", "f": False}
    out = c.apply_fill(df, fill)
    assert out.schema["i"].dataType.simpleString() == "double"
    assert out.where("t is null").first().asDict() == {"s": "a", "n": 0.0, "i": 2.5, "e": "Unknown", "f": False, "t": None}
    assert c.remaining_nulls(out).first()[0] == 1
    assert {x["column"] for x in c.fill_report(df, fill).collect()} == set(fill.values)


def test_whole_median_keeps_whole_numbers(spark):
    df = spark.createDataFrame([(1, 0), (3, 0), (None, 0), (5, 0)], "i int, t int")
    assert c.fill_missing(df, "t").schema["i"].dataType.simpleString() == "int"


def test_casts(spark):
    df = spark.createDataFrame([("1", "1.5", 2.9, None, "x"), (" 2 ", "3", -1.2, 1, "")], "a string, b string, d double, n long, s string")
    plan = c.fit_casts(df, {"a": "int", "b": "int", "d": "int", "n": "int", "s": "bool"})
    assert plan.casts == {"a": "bigint", "d": "bigint", "s": "boolean"}
    assert set(plan.failed) == {"b", "n"}
    assert [tuple(x) for x in c.apply_casts(df, plan).select("a", "d", "s").collect()] == [(1, 2, True), (2, -1, False)]
    assert c.fit_casts(df, {"a": "complex"}).failed == {"a": "unknown type 'complex'"}
    with pytest.raises(ValueError):
        c.fit_casts(df, {"zzz": "int"})


def test_strip_all_white_space(spark):
    df = spark.createDataFrame([(" \t a b\n ",), (None,)], " s  string".replace(" s ", "s"))
    out = c.strip_whitespace(df.toDF(" s "))
    assert out.columns == ["s"] and [x["s"] for x in out.collect()] == ["a b", None]


def test_replace_is_simultaneous_and_typed(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert [x["s"] for x in c.replace_values(df, "s", {"a": "b", "b": "a"}).collect()] == ["b", "a", None]
    assert [x["s"] for x in c.replace_values(df, "s", {"a": 1}).collect()] == ["1", "b", None]
    numbers = spark.createDataFrame([(1,), (2,)], "n int")
    assert [x["n"] for x in c.replace_values(numbers, "n", {1: 1.5}).collect()] == [1.5, 2.0]


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (1.0,), (9.0,)], "x double")
    assert [x["x"] for x in c.clip_values(df, "x", upper=5).collect()] == [None, 1.0, 5.0]
    with pytest.raises(ValueError):
        c.clip_values(spark.createDataFrame([("a",)], "x string"), "x")


def test_high_missing_includes_the_threshold(spark):
    df = spark.createDataFrame([(None, 1, None), (1, 1, None)], "half int, full int, none int")
    assert c.fit_high_missing(df, "full", 0.5) == {"half": 50.0, "none": 100.0}
    assert c.drop_high_missing(df, "none", 0.5).columns == ["full", "none"]


def test_high_cardinality_near_the_threshold_is_exact(spark):
    df = spark.range(1000).select(
        F.col("id").alias("t"),
        F.concat(F.lit("v"), F.least(F.col("id"), F.lit(799))).alias("at"),
        F.concat(F.lit("v"), F.least(F.col("id"), F.lit(798))).alias("under"),
    )
    assert c.fit_high_cardinality(df, "t", 0.8) == ["at"]
    assert c.fit_high_cardinality(df.limit(0), "t") == []


def test_renames(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert c.rename_columns(df, {"a": "x"}).columns == ["x", "b"]
    assert c.rename_columns(df.toDF("A b-c", "d.%"), clean_all=True).columns == ["a_b_c", "d"]
    for bad in [dict(rename_map={"a": "b"}), dict(rename_map={"q": "b"}), dict()]:
        with pytest.raises(ValueError):
            c.rename_columns(df, **bad)


def test_drop_and_select_check_names(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, c int")
    assert c.drop_columns(df, ["c"]).columns == ["a.b"]
    assert c.select_features(df, ["c", "a.b"]).columns == ["c", "a.b"]
    for f in (c.drop_columns, c.select_features):
        with pytest.raises(ValueError):
            f(df, ["zz"])


@pytest.mark.parametrize("n, kind", [(19, "classification"), (20, "classification"), (21, "regression")])
def test_problem_type_threshold(spark, n, kind):
    found = p.identify_target(spark.range(n).toDF("Price "))
    assert tuple(found.first())[:3] == ("Price ", "auto_detected", kind)


def test_target_name_order_beats_column_order(spark):
    df = spark.createDataFrame([("a", 1)], "price string, label int")
    assert p.find_target(df) == ("label", "auto_detected")
    assert p.find_target(df, "nope") == ("label", "auto_detected")
    assert p.identify_target(df, "price").first()["problem_type"] == "classification"
    assert p.find_target(df.select(F.lit(1).alias("q"))) == (None, "not_found")
    assert p.identify_target(df.select(F.lit(1).alias("q"))).first()["method"] == "not_found"


def test_profile_options_agree_on_small_tables(spark, small):
    exact = {x["column"]: x.asDict() for x in p.profile(small).collect()}
    approx = {x["column"]: x.asDict() for x in p.profile(small, approx=True).collect()}
    assert exact["x"]["p50"] == 3.0 and approx["x"]["p50"] == 3.0
    assert exact["s"]["missing_pct"] == 25.0 and exact["s"]["mean"] is None
    assert exact["x"]["std"] == approx["x"]["std"]
    assert p.head(small, 2).count() == 2


def test_leakage_errors(spark, small):
    with pytest.raises(ValueError):
        p.check_leakage(small, "s")
    with pytest.raises(ValueError):
        p.check_leakage(small.select("x"), "x")
    with pytest.raises(ValueError):
        p.correlations(small.select("s"))
