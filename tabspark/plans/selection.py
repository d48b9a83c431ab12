"""K1-K7."""

from pyspark.sql import functions as F

from ..operators import selection as op
from .catalog import query, view
from .profiling import r, sql_corr, union

FEATURES = ["y_rare", "y_reg", "c_acctbal", "c_nationkey", "lifted", "order_month", "const_col"]


def numbers(spark, sf_dir):
    return view(spark, sf_dir, "numeric_orders")


@query("k1_drop_low_variance", "SELECT * EXCLUDE (l_discount, l_tax, const_col) FROM {dirty_lines}")
def drop_low_variance(spark, sf_dir):
    return op.drop_low_variance(view(spark, sf_dir, "dirty_lines"), "l_quantity")


@query("k2_drop_correlated", "SELECT * EXCLUDE (mostly_null, dup_price) FROM {dirty_lines}")
def drop_correlated(spark, sf_dir):
    return op.drop_correlated(view(spark, sf_dir, "dirty_lines"), "l_quantity")


# Features with missing values at the median, as all scores take them.
FILLED = (
    "WITH raw AS (SELECT * FROM {numeric_orders}), d AS (SELECT y_bin, y_rare, y_reg, c_acctbal, c_nationkey, "
    "coalesce(lifted, (SELECT median(lifted) FROM raw)) AS lifted, order_month, const_col FROM raw)"
)


def _f_classif(c):
    return (
        f"SELECT '{c}' AS feature, (SELECT CASE WHEN sum(w) = 0 THEN NULL ELSE (sum(b) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) END "
        f"FROM (SELECT count(*) AS n, count(*) * pow(avg({c}) - (SELECT avg({c}) FROM d), 2) AS b, count(*) * var_pop({c}) AS w FROM d GROUP BY y_bin)) AS score"
    )


def _f_regression(c):
    rr = f"pow({sql_corr(c, 'y_reg')}, 2)"
    return f"SELECT '{c}' AS feature, coalesce({rr} / (1 - {rr}) * (count(*) - 2), 0) AS score FROM d"


CHI_FEATURES = ["y_rare", "y_reg", "c_nationkey", "order_month", "const_col"]


def _chi2(c):
    return (
        f"SELECT '{c}' AS feature, (SELECT sum(pow(o - n / tn * t, 2) / (n / tn * t)) FROM (SELECT sum({c}) AS o, count(*) AS n, "
        f"(SELECT sum({c}) FROM d) AS t, (SELECT CAST(count(*) AS double) FROM d) AS tn FROM d GROUP BY y_bin)) AS score"
    )


def _edges(c):
    return f"(SELECT list_sort(list_distinct(quantile_cont({c}, [{', '.join(str(i / 10) for i in range(11))}]))) FROM d)"


def _bin(c, e):
    """Right-closed bin among sorted edges; NULL where there is a single edge."""
    return f"CASE WHEN len({e}) < 2 THEN NULL ELSE greatest(len(list_filter({e}, lambda x: x < {c})) - 1, 0) END"


def _mi(c, target):
    y = "y_bin" if target == "y_bin" else _bin("y_reg", "ey")
    return (
        f"SELECT '{c}' AS feature, (WITH e AS (SELECT {_edges(c)} AS ex, {_edges('y_reg')} AS ey), "
        f"x AS (SELECT {_bin(c, 'ex')} AS bx, {y} AS by_ FROM d, e), "
        "n AS (SELECT bx, by_, CAST(count(*) AS double) AS n FROM x GROUP BY ALL), "
        "t AS (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY bx) AS nx, sum(n) OVER (PARTITION BY by_) AS ny FROM n) "
        "SELECT sum(n / t * ln(n * t / (nx * ny))) FROM t) AS score"
    )


def _scores(rows, digits):
    return f"SELECT feature, {r('score', digits)} AS score FROM ({union(rows)})"


def _score_query(target, names, method, digits):
    def run(spark, sf_dir):
        df = numbers(spark, sf_dir).select(target, *[c for c in names if c != target])
        return op.score_features(df, target, method).select("feature", F.round("score", digits).alias("score"))

    return run


CLASSIF = [c for c in FEATURES if c != "y_bin"]
REGRESS = [c for c in ["y_bin", *FEATURES] if c != "y_reg"]
query("k3_f_classif", f"{FILLED} {_scores([_f_classif(c) for c in CLASSIF], 3)}")(
    _score_query("y_bin", CLASSIF, "f_classif", 3)
)
query("k4_f_regression", f"{FILLED} {_scores([_f_regression(c) for c in REGRESS], 3)}")(
    _score_query("y_reg", REGRESS, "f_regression", 3)
)
query("k5_chi2", f"{FILLED} {_scores([_chi2(c) for c in CHI_FEATURES], 2)}")(
    _score_query("y_bin", CHI_FEATURES, "chi2", 2)
)
query("k6_mutual_info_classif", f"{FILLED} {_scores([_mi(c, 'y_bin') for c in CLASSIF], 6)}")(
    _score_query("y_bin", CLASSIF, "mutual_info_classif", 6)
)
query("k6_mutual_info_regression", f"{FILLED} {_scores([_mi(c, 'y_reg') for c in REGRESS], 6)}")(
    _score_query("y_reg", REGRESS, "mutual_info_regression", 6)
)


NEIGHBOURS = 3
NEAR = [i for i in range(-NEIGHBOURS, NEIGHBOURS + 1) if i]


def _neighbours(c):
    """The nearest values on both sides by lag and lead, and the rows within the distance by a range frame."""
    sides = ", ".join(f"{{'d': abs(lag(v, {i}) OVER w - v), 'c': lag(c, {i}) OVER w}}" for i in NEAR)
    return (
        f"SELECT '{c}' AS feature, (WITH p AS (SELECT CAST({c} AS double) AS v, y_bin AS y, count(*) AS c FROM d GROUP BY ALL), "
        "s AS (SELECT *, sum(c) OVER (PARTITION BY y) AS size, sum(c) OVER () AS n FROM p), "
        f"a AS (SELECT *, list_sort(list_filter([{{'d': 0.0::double, 'c': c - 1}}, {sides}], lambda x: x.d IS NOT NULL)) AS near FROM s "
        "WINDOW w AS (PARTITION BY y ORDER BY v)), "
        f"r AS (SELECT *, list_min(list_transform(list_filter(near, lambda x: list_sum(list_transform(list_filter(near, lambda z: z.d <= x.d), lambda z: z.c)) >= least({NEIGHBOURS}, size - 1)), lambda x: x.d)) AS r FROM a), "
        "m AS (SELECT *, list_sum(list_transform(list_filter(near, lambda x: x.d <= r), lambda x: x.c)) AS among, "
        "sum(c) OVER (ORDER BY v RANGE BETWEEN r PRECEDING AND r FOLLOWING) - 1 AS m FROM r) "
        "SELECT greatest(0, any_value(hn.h) - 0.5772156649015329 + sum(c * (ha.h - hs.h - hm.h + 0.5772156649015329)) / any_value(n)) "
        "FROM m JOIN harmonic ha ON ha.i = m.among JOIN harmonic hs ON hs.i = m.size JOIN harmonic hm ON hm.i = m.m JOIN harmonic hn ON hn.i = m.n) AS score"
    )


# Digamma of a whole number is the harmonic sum before it, less Euler's constant.
HARMONIC = "harmonic AS MATERIALIZED (SELECT i, coalesce(sum(1.0::double / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS h FROM (SELECT row_number() OVER () AS i FROM raw))"


@query("k6_mutual_info_neighbours", f"{FILLED}, {HARMONIC} {_scores([_neighbours(c) for c in CLASSIF], 4)}")
def mutual_info_neighbours(spark, sf_dir):
    df = numbers(spark, sf_dir).select("y_bin", *CLASSIF)
    return op.score_features(df, "y_bin", "mutual_info_classif", n_neighbors=NEIGHBOURS).select("feature", F.round("score", 4).alias("score"))


@query(
    "k7_select_k_best",
    f"""{FILLED}, s AS ({union(_f_classif(c) for c in CLASSIF)}),
k AS (SELECT feature, row_number() OVER (ORDER BY score DESC NULLS LAST) AS k FROM s)
SELECT feature, {r('score')} AS score, k <= 3 AS selected FROM s JOIN k USING (feature)""",
)
def select_k_best(spark, sf_dir):
    df = numbers(spark, sf_dir).select("y_bin", *CLASSIF)
    fitted = op.fit_k_best(df, "y_bin", 3)
    assert op.apply_k_best(df, "y_bin", fitted).columns == ["y_bin", *fitted.selected]
    return op.k_best_report(df, fitted)
