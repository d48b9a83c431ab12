"""P1-P7."""

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import profiling as op
from .catalog import query, table, view

# Column name -> Spark type of the dirty_lines view.
LINE_TYPES = {
    "l_orderkey": "bigint",
    "l_partkey": "bigint",
    "l_suppkey": "bigint",
    "l_linenumber": "int",
    "l_quantity": "double",
    "l_extendedprice": "double",
    "l_discount": "double",
    "l_tax": "double",
    "l_returnflag": "string",
    "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
    "mostly_null": "double",
    "const_col": "double",
    "dup_price": "double",
    "row_tag": "string",
}
LINE_NUMBERS = [c for c, t in LINE_TYPES.items() if t in ("bigint", "int", "double")]
LINE_TEXTS = [c for c in LINE_TYPES if c not in LINE_NUMBERS]


def union(parts):
    return "\nUNION ALL\n".join(parts)


def r(x, digits=4):
    """Round, without a negative zero."""
    return f"(round({x}, {digits}) + 0.0)"


def sql_corr(a, b):
    return f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END"


def _profile_row(c, t):
    head = f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct"
    if c in LINE_NUMBERS:
        q = ", ".join(f"{r(f'quantile_cont({c}, {p})')} AS p{n}" for n, p in ((25, 0.25), (50, 0.5), (75, 0.75)))
        rest = f"CAST(count({c}) AS double) AS count, {r(f'avg({c})', 3)} AS mean, {r(f'stddev_samp({c})', 3)} AS std, CAST(min({c}) AS double) AS min, {q}, CAST(max({c}) AS double) AS max"
    else:
        rest = ", ".join(f"CAST(NULL AS double) AS {n}" for n in ("count", "mean", "std", "min", "p25", "p50", "p75", "max"))
    return f"{head}, {rest} FROM {{dirty_lines}}"


PROFILE_SQL = union(_profile_row(c, t) for c, t in LINE_TYPES.items())


@query("p1_profile", PROFILE_SQL)
def profile(spark, sf_dir):
    found = op.profile(view(spark, sf_dir, "dirty_lines"))
    rounded = [F.round(c, 3).alias(c) for c in ("mean", "std")]
    rounded += [F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")]
    return found.select(
        "column", "dtype", "missing", "missing_pct", F.col("count").cast("double").alias("count"), "min", "max", *rounded
    )


@query(
    "p2_identify_target",
    """
SELECT 'label' AS target, 'auto_detected' AS method, 'classification' AS problem_type, 'string' AS dtype, count(DISTINCT label) AS nunique FROM {order_features}
UNION ALL
SELECT 'y_reg', 'user_specified', CASE WHEN count(DISTINCT y_reg) <= 20 THEN 'classification' ELSE 'regression' END, 'double', count(DISTINCT y_reg) FROM {order_features}
UNION ALL
SELECT 'y_bin', 'user_specified', CASE WHEN count(DISTINCT y_bin) <= 20 THEN 'classification' ELSE 'regression' END, 'int', count(DISTINCT y_bin) FROM {order_features}""",
)
def identify(spark, sf_dir):
    df = view(spark, sf_dir, "order_features")
    found = [op.identify_target(df, t) for t in (None, "y_reg", "y_bin")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _corr_rows(columns, source):
    return union(
        f"SELECT '{a}' AS col_1, '{b}' AS col_2, {r(sql_corr(a, b))} AS correlation FROM {source}"
        for a, b in combinations(columns, 2)
    )


@query("p3_correlations", _corr_rows(LINE_NUMBERS, "{dirty_lines}"))
def correlations(spark, sf_dir):
    return op.correlations(view(spark, sf_dir, "dirty_lines"))


WIDE_NUMBERS = [f"x{i}" for i in range(60)]


@query(
    "p3_correlations_wide",
    "SELECT unnest(["
    + ", ".join(
        f"{{'col_1': '{a}', 'col_2': '{b}', 'correlation': {r(sql_corr(a, b))}}}" for a, b in combinations(WIDE_NUMBERS, 2)
    )
    + "], recursive := true) FROM {wide_lines}",
)
def correlations_wide(spark, sf_dir):
    return op.correlations(view(spark, sf_dir, "wide_lines"))


@query(
    "p3_top_correlations",
    f"SELECT * FROM ({_corr_rows(LINE_NUMBERS, '{dirty_lines}')}) ORDER BY abs(correlation) DESC NULLS LAST, col_1, col_2 LIMIT 10",
)
def top_correlations(spark, sf_dir):
    return op.top_correlations(view(spark, sf_dir, "dirty_lines"))


FEATURES_OF_QUANTITY = [c for c in LINE_NUMBERS if c != "l_quantity"]


def bounds_sql(columns, source):
    """One row with lo_/hi_ IQR bounds per column."""
    parts = []
    for c in columns:
        q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
        parts += [f"{q1} - 1.5 * ({q3} - {q1}) AS lo_{c}", f"{q3} + 1.5 * ({q3} - {q1}) AS hi_{c}"]
    return f"SELECT {', '.join(parts)} FROM {source}"


@query(
    "p4_detect_outliers",
    f"WITH b AS ({bounds_sql(FEATURES_OF_QUANTITY, '{dirty_lines}')}), f AS ("
    + union(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < lo_{c} OR {c} > hi_{c}) AS outlier_count, "
        f"{r(f'any_value(lo_{c})')} AS lower_bound, {r(f'any_value(hi_{c})')} AS upper_bound FROM {{dirty_lines}}, b"
        for c in FEATURES_OF_QUANTITY
    )
    + ") SELECT * FROM f WHERE outlier_count > 0",
)
def detect_outliers(spark, sf_dir):
    return op.detect_outliers(view(spark, sf_dir, "dirty_lines"), "l_quantity")


@query(
    "p4_outlier_rows",
    f"WITH b AS ({bounds_sql(FEATURES_OF_QUANTITY, '{dirty_lines}')}) SELECT count(*) FILTER (WHERE "
    + " OR ".join(f"{c} < lo_{c} OR {c} > hi_{c}" for c in FEATURES_OF_QUANTITY)
    + ") AS total_outlier_rows, count(*) AS total_rows FROM {dirty_lines}, b",
)
def outlier_rows(spark, sf_dir):
    return op.outlier_rows(view(spark, sf_dir, "dirty_lines"), "l_quantity")


LEAK_SQL = union(
    f"SELECT '{c}' AS feature, round(abs({sql_corr(c, 'l_extendedprice')}), 4) AS abs_corr, "
    f"coalesce(abs({sql_corr(c, 'l_extendedprice')}) >= 0.95, false) AS flagged FROM {{dirty_lines}}"
    for c in LINE_NUMBERS
    if c != "l_extendedprice"
)


@query("p5_check_leakage", LEAK_SQL)
def leakage(spark, sf_dir):
    return op.check_leakage(view(spark, sf_dir, "dirty_lines"), "l_extendedprice")


@query("p5_top_safe", f"SELECT * FROM ({LEAK_SQL}) WHERE NOT flagged ORDER BY abs_corr DESC NULLS LAST, feature LIMIT 10")
def top_safe(spark, sf_dir):
    return op.top_safe(op.check_leakage(view(spark, sf_dir, "dirty_lines"), "l_extendedprice"))


@query(
    "p6_missingness",
    "SELECT * FROM ("
    + union(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct FROM {{dirty_lines}}"
        for c in LINE_TYPES
    )
    + ") WHERE missing > 0",
)
def missingness(spark, sf_dir):
    return op.missingness(view(spark, sf_dir, "dirty_lines"))


@query(
    "p6_missing_patterns",
    "SELECT concat("
    + ", ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in LINE_TYPES)
    + ") AS pattern, count(*) AS row_count FROM {dirty_lines} GROUP BY 1",
)
def patterns(spark, sf_dir):
    return op.missing_patterns(view(spark, sf_dir, "dirty_lines"))


@query(
    "p7_stage_summary",
    """
SELECT 'lineitem' AS stage, count(*) AS rows, 11 AS columns FROM lineitem
UNION ALL SELECT 'orders', count(*), 6 FROM orders
UNION ALL SELECT 'customer', count(*), 5 FROM customer""",
)
def stages(spark, sf_dir):
    return op.stage_summary({n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer")})
