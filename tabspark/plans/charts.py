"""G1-G3, G5."""

from pyspark.sql import functions as F

from ..operators import charts as op
from .catalog import query, view
from .evaluation import histogram_sql, rounded_histogram
from .profiling import LINE_NUMBERS, r, sql_corr, union


def lines(spark, sf_dir):
    return view(spark, sf_dir, "dirty_lines")


@query(
    "g1_value_counts",
    "SELECT l_returnflag AS value, count(*) AS row_count FROM {dirty_lines} WHERE l_returnflag IS NOT NULL GROUP BY 1",
)
def value_counts(spark, sf_dir):
    return op.distribution(lines(spark, sf_dir), "l_returnflag")


@query("g1_histogram", histogram_sql("l_extendedprice", "{dirty_lines}", 30, 4))
def histogram(spark, sf_dir):
    return rounded_histogram(op.distribution(lines(spark, sf_dir), "l_extendedprice"), 4)


@query(
    "g1_histogram_auto",
    """
WITH v AS (SELECT value AS x FROM events WHERE value IS NOT NULL),
q AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, 2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / pow(count(*), 1 / 3.0) AS fd, (max(x) - min(x)) / (log2(count(*)) + 1) AS st FROM v),
m AS (SELECT lo, hi, CAST(ceil((hi - lo) / CASE WHEN fd > 0 THEN least(fd, st) ELSE st END) AS integer) AS k FROM q),
b AS (SELECT least(CAST(floor((x - lo) * k / (hi - lo)) AS integer), k - 1) AS bin, count(*) AS c FROM v, m GROUP BY 1)
SELECT i AS bin, round(lo + i * ((hi - lo) / k), 6) AS lower_edge, round(lo + (i + 1) * ((hi - lo) / k), 6) AS upper_edge, coalesce(c, 0) AS row_count
FROM (SELECT unnest(range(k)) AS i, lo, hi, k FROM m) LEFT JOIN b ON bin = i""",
)
def histogram_auto(spark, sf_dir):
    return rounded_histogram(op.distribution(view(spark, sf_dir, "events"), "value", "auto"))


@query(
    "g2_density",
    """
WITH v AS (SELECT value AS x FROM events WHERE value IS NOT NULL),
m AS (SELECT count(*) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(*), -0.2) AS h FROM v),
b AS (SELECT least(CAST(floor((x - lo) * 1000 / (hi - lo)) AS integer), 999) AS bin, count(*) AS c FROM v, m GROUP BY 1),
p AS (SELECT lo + (bin + 0.5) * ((hi - lo) / 1000) AS centre, c FROM b, m),
g AS (SELECT i, lo + i * ((hi - lo) / 199) AS x, h, n FROM range(200) AS t(i), m)
SELECT round(x, 6) AS x, round(sum(c * exp(-pow((x - centre) / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 8) AS density FROM g, p GROUP BY i, x, h, n""",
)
def density(spark, sf_dir):
    found = op.density(view(spark, sf_dir, "events"), "value")
    return found.select(F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query(
    "g3_correlation_heatmap",
    union(
        f"SELECT '{a}' AS col_1, '{b}' AS col_2, {r(sql_corr(a, b))} AS correlation FROM {{dirty_lines}}"
        for a in LINE_NUMBERS
        for b in LINE_NUMBERS
    ),
)
def heatmap(spark, sf_dir):
    return op.correlation_heatmap(lines(spark, sf_dir))


BOXED = ["l_quantity", "l_extendedprice", "l_discount", "mostly_null"]


def _box(c):
    q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
    return (
        f"(WITH q AS (SELECT {q1} AS q1, median({c}) AS q2, {q3} AS q3 FROM {{dirty_lines}}) "
        f"SELECT '{c}' AS \"column\", any_value(q1) AS q1, any_value(q2) AS median, any_value(q3) AS q3, "
        f"min({c}) FILTER (WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low, "
        f"max({c}) FILTER (WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high, "
        f"count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count FROM {{dirty_lines}}, q)"
    )


@query("g5_boxplot_stats", f"SELECT \"column\", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, whisker_low, whisker_high, outlier_count FROM ({union(_box(c) for c in BOXED)})")
def boxplot(spark, sf_dir):
    found = op.boxplot_stats(lines(spark, sf_dir), BOXED)
    return found.withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})
