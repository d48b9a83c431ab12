"""What must hold at any scale: no rows through the driver or one task, no row-at-a-time Python."""

import re
from pathlib import Path

import pytest

from tabspark import plans
from tabspark.functions import ordering
from tabspark.operators import columns, features, joins, rows, splits
from tabspark.plans.catalog import view

SF = "/root/testdata/sf0.001"
SOURCES = sorted(Path(__file__).resolve().parent.parent.joinpath("tabspark").rglob("*.py"))


@pytest.mark.parametrize("path", SOURCES, ids=lambda p: p.name)
def test_sources_avoid_single_machine_calls(path):
    text = path.read_text()
    for word in ("toPandas", "localCheckpoint", "crossJoin", "coalesce(1)", "@udf", "F.udf", "pandas_udf", ".rdd", "toLocalIterator", "spark.conf.set"):
        assert word not in text, word


def plan_of(df):
    return df._jdf.queryExecution().toString()


def check(df):
    text = plan_of(df)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in text, bad
    return text


def test_splits_move_no_rows(spark):
    """Sample, split, folds and balancing compare each row with cut points: no shuffle in the result."""
    df = view(spark, SF, "orders")
    done = [
        rows.subsample(df, 100, ["o_orderkey"], stratify="o_orderstatus"),
        splits.split_data(df, "o_orderstatus", keys=["o_orderkey"]),
        splits.split_data(df, "o_totalprice", keys=["o_orderkey"]),
        rows.subsample(df, 100, ["o_orderkey"]),
        splits.create_folds(df, "o_orderstatus", keys=["o_orderkey"]),
        splits.class_balance(df, "o_orderstatus", "undersample", ["o_orderkey"]),
        splits.class_balance(df, "o_orderstatus", "oversample", ["o_orderkey"]),
        splits.class_balance(df, "o_orderstatus"),
    ]
    for out in done:
        physical = check(out).split("== Physical Plan ==")[1]
        assert "Exchange hashpartitioning" not in physical and "Window" not in physical


def test_applies_are_narrow(spark):
    df = view(spark, SF, "dirty_lines")
    out = columns.apply_fill(df, columns.fit_fill(df, "l_tax"))
    out = features.apply_encoding(out.drop("row_tag", "l_shipdate"), features.fit_encoding(out.drop("row_tag", "l_shipdate"), "l_tax"))
    out = features.apply_bins(out, features.fit_bins(out, "l_quantity"))
    out = rows.remove_outliers(out.drop("l_quantity", "l_quantity_original", "l_quantity_bin"), "l_tax")
    assert "Exchange" not in check(out).split("== Physical Plan ==")[1]


def test_unused_columns_are_not_read(spark):
    df = view(spark, SF, "dirty_lines")
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(features.create_polynomials(df, ["l_tax"]).select("l_tax_pow2")))
    assert read == ["l_tax:double"]


def test_group_features_aggregate_before_the_shuffle(spark):
    df = view(spark, SF, "lineitem")
    text = check(features.aggregate_features(df, "l_partkey", ["l_quantity"])).split("== Physical Plan ==")[1]
    assert "partial_avg" in text and "BroadcastHashJoin" in text


def test_large_sides_are_not_hinted(spark, monkeypatch):
    monkeypatch.setattr("tabspark.functions.session.BROADCAST_BYTES", 10)
    df = view(spark, SF, "lineitem")
    out = features.aggregate_features(df, "l_partkey", ["l_quantity"], ["mean", "median"])
    assert "ResolvedHint" not in plan_of(out) and "broadcast" not in out._jdf.queryExecution().logical().toString()


def test_joins_are_equi_joins_also_for_missing_keys(spark):
    left, right = view(spark, SF, "left_t"), view(spark, SF, "right_t")
    for how in joins.KINDS:
        check(joins.merge_tables(left, right, on="k", how=how))
    check(rows.semi_filter(left, right, "k"))


def test_windows_over_rows_have_partitions(spark):
    df = view(spark, SF, "scored").selectExpr("probability", "cast(label as long) as pos")
    text = check(ordering.running_totals(df, "probability", ["pos"]))
    assert re.search(r"Window \[.*\], \[bucket", text)


def test_every_twin_has_a_query():
    assert set(plans.oracle_sql()) <= set(plans.queries())
    assert not [n for n in plans.queries() if re.match(r"op\d", n)]
