"""V1-V6, V8, V9 on a scored table that needs no model."""

from pyspark.sql import functions as F

from ..operators import evaluation as op
from .catalog import query, view
from .profiling import r, union


def scored(spark, sf_dir):
    return view(spark, sf_dir, "scored")


def regression(spark, sf_dir):
    return scored(spark, sf_dir).selectExpr("event_id", "y_true AS label", "y_pred AS prediction")


def classes_sql(source, label="label", prediction="prediction"):
    """Per-class metrics and averages over any scored table."""
    return f"""
s AS (SELECT CAST({label} AS varchar) AS l, CAST({prediction} AS varchar) AS p FROM {source}),
cls AS (SELECT l AS class FROM s UNION SELECT p FROM s),
cnt AS (SELECT class, count(*) FILTER (WHERE l = class) AS support, count(*) FILTER (WHERE p = class) AS called,
  count(*) FILTER (WHERE l = class AND p = class) AS tp FROM cls, s GROUP BY class),
per AS (SELECT class, support, tp, coalesce(tp / nullif(called, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall,
  coalesce(2.0 * tp / nullif(called + support, 0), 0.0) AS f1 FROM cnt),
lines AS (SELECT class, precision, recall, f1, support FROM per
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM per
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM per
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM per)
SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, CAST(support AS bigint) AS support FROM lines"""


@query("v1_classification_metrics", f"WITH {classes_sql('{scored}')}")
def classification_metrics(spark, sf_dir):
    return op.classification_metrics(scored(spark, sf_dir))


TYPES = """
SELECT event_id, event_type AS label,
  CASE WHEN event_id % 3 = 0 THEN 'click' WHEN event_id % 7 = 0 THEN 'other' ELSE event_type END AS prediction
FROM {events}"""


@query("v1_classification_metrics_many", f"WITH t AS ({TYPES}), {classes_sql('t')}")
def classification_metrics_many(spark, sf_dir):
    return op.classification_metrics(spark.sql(TYPES, events=view(spark, sf_dir, "events")))


@query(
    "v1_accuracy",
    "SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 4) AS accuracy, count(*) AS total_predictions FROM {scored}",
)
def accuracy(spark, sf_dir):
    return op.accuracy(scored(spark, sf_dir))


def regression_sql(source, n_features, y="label", p="prediction"):
    e = f"({y} - {p})"
    r2 = f"1 - sum({e} * {e}) / (var_pop({y}) * count(*))"
    return f"""SELECT {r(f'avg(abs({e}))')} AS mae, {r(f'avg({e} * {e})')} AS mse, {r(f'sqrt(avg({e} * {e}))')} AS rmse,
  {r(r2)} AS r2, {r(f'1 - (1 - ({r2})) * (count(*) - 1) / (count(*) - {n_features} - 1)')} AS adjusted_r2,
  count(*) AS total_predictions, {r(f'avg({e})')} AS residual_mean, {r(f'stddev_pop({e})')} AS residual_std FROM {source}"""


@query("v2_regression_metrics", regression_sql("{scored}", 3, "y_true", "y_pred"))
def regression_metrics(spark, sf_dir):
    return op.regression_metrics(regression(spark, sf_dir), 3)


@query(
    "v3_confusion_matrix",
    f"WITH t AS ({TYPES}), c AS (SELECT label AS class FROM t UNION SELECT prediction FROM t) "
    "SELECT a.class AS actual, b.class AS predicted, (SELECT count(*) FROM t WHERE label = a.class AND prediction = b.class) AS row_count FROM c a, c b",
)
def confusion_matrix(spark, sf_dir):
    return op.confusion_matrix(spark.sql(TYPES, events=view(spark, sf_dir, "events")))


CUMULATED = """
WITH g AS (SELECT probability AS score, sum(label) AS pos, sum(1 - label) AS neg FROM {scored} GROUP BY 1),
c AS (SELECT score, pos, neg, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM g
  WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(
    "v1_metrics_auc",
    f"WITH {classes_sql('{scored}')} UNION ALL SELECT 'roc auc', auc, auc, auc, (SELECT count(*) FROM {{scored}}) FROM "
    f"({CUMULATED} SELECT round(sum(neg * (cp - pos + pos / 2.0)) / any_value(tp) / any_value(tn), 4) AS auc FROM c) AS areas",
)
def metrics_auc(spark, sf_dir):
    return op.classification_metrics(scored(spark, sf_dir), with_auc=True)


def _rounded(df, digits=8):
    return df.select(*[F.round(c, digits).alias(c) for c in df.columns])


@query(
    "v4_roc_curve",
    f"{CUMULATED} SELECT round(score, 8) AS threshold, round(cn / tn, 8) AS fpr, round(cp / tp, 8) AS tpr FROM c UNION ALL SELECT NULL, 0.0, 0.0",
)
def roc_curve(spark, sf_dir):
    return _rounded(op.roc_curve(scored(spark, sf_dir)))


@query(
    "v4_auc", f"{CUMULATED} SELECT round(sum(neg * (cp - pos + pos / 2.0)) / any_value(tp) / any_value(tn), 4) AS auc FROM c"
)
def auc(spark, sf_dir):
    return op.auc(scored(spark, sf_dir))


@query(
    "v5_pr_curve",
    f"{CUMULATED} SELECT round(score, 8) AS threshold, round(cp / (cp + cn), 8) AS precision, round(cp / tp, 8) AS recall FROM c UNION ALL SELECT NULL, 1.0, 0.0",
)
def pr_curve(spark, sf_dir):
    return _rounded(op.pr_curve(scored(spark, sf_dir)))


@query(
    "v5_average_precision",
    f"{CUMULATED} SELECT round(sum(pos * cp / (cp + cn)) / any_value(tp), 4) AS average_precision FROM c",
)
def average_precision(spark, sf_dir):
    return op.average_precision(scored(spark, sf_dir))


CALIBRATION_BIN = "CASE " + " ".join(f"WHEN probability <= CAST({i * 0.1!r} AS double) THEN {i - 1}" for i in range(1, 10)) + " ELSE 9 END"


@query(
    "v6_calibration",
    f"SELECT {CALIBRATION_BIN} AS bin, round(avg(probability), 6) AS mean_predicted, round(avg(label), 6) AS fraction_positive, count(*) AS row_count FROM {{scored}} GROUP BY 1",
)
def calibration(spark, sf_dir):
    found = op.calibration(scored(spark, sf_dir))
    return found.select(
        "bin", F.round("mean_predicted", 6).alias("mean_predicted"), F.round("fraction_positive", 6).alias("fraction_positive"), "row_count"
    )


@query(
    "v6_calibration_gap",
    f"WITH b AS (SELECT {CALIBRATION_BIN} AS bin, abs(avg(label) - avg(probability)) AS gap FROM {{scored}} GROUP BY 1) SELECT round(avg(gap), 4) AS mean_calibration_gap FROM b",
)
def calibration_gap(spark, sf_dir):
    return op.calibration_gap(scored(spark, sf_dir))


def histogram_sql(column, source, n, digits=6):
    """Equal-width bins, empty ones included."""
    return f"""
WITH v AS (SELECT CAST({column} AS double) AS x FROM {source} WHERE {column} IS NOT NULL), m AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT least(CAST(floor((x - lo) * {n} / (hi - lo)) AS integer), {n} - 1) AS bin, count(*) AS c FROM v, m GROUP BY 1)
SELECT i AS bin, {r(f'lo + i * ((hi - lo) / {n})', digits)} AS lower_edge, {r(f'lo + (i + 1) * ((hi - lo) / {n})', digits)} AS upper_edge, coalesce(c, 0) AS row_count
FROM range({n}) AS t(i) CROSS JOIN m LEFT JOIN b ON bin = i"""


def rounded_histogram(df, digits=6):
    return df.select("bin", F.round("lower_edge", digits).alias("lower_edge"), F.round("upper_edge", digits).alias("upper_edge"), "row_count")


@query("v6_score_histogram", histogram_sql("probability", "{scored}", 20))
def score_histogram(spark, sf_dir):
    return rounded_histogram(op.score_histogram(scored(spark, sf_dir)))


@query(
    "v8_prediction_sample",
    "SELECT event_id, label, prediction, label <> prediction AS mismatch FROM {scored} ORDER BY event_id LIMIT 50",
)
def prediction_sample(spark, sf_dir):
    return op.prediction_sample(scored(spark, sf_dir), 50, ["event_id"])


@query(
    "v8_mismatch_rate",
    "SELECT count(*) FILTER (WHERE label <> prediction) AS mismatches, count(*) AS total, round(count(*) FILTER (WHERE label <> prediction) / count(*), 4) AS mismatch_rate FROM {scored}",
)
def mismatch_rate(spark, sf_dir):
    return op.mismatch_rate(scored(spark, sf_dir))


@query("v9_residuals", "SELECT event_id, y_true AS label, y_pred AS prediction, y_true - y_pred AS residual FROM {scored}")
def residuals(spark, sf_dir):
    return op.residuals(regression(spark, sf_dir))


@query("v9_residual_histogram", histogram_sql("(y_true - y_pred)", "{scored}", 30))
def residual_histogram(spark, sf_dir):
    return rounded_histogram(op.residual_histogram(regression(spark, sf_dir)))


@query(
    "v9_residual_range",
    "SELECT least(min(y_true), min(y_pred)) AS min_value, greatest(max(y_true), max(y_pred)) AS max_value FROM {scored}",
)
def residual_range(spark, sf_dir):
    return op.residual_range(regression(spark, sf_dir))


@query(
    "v9_residual_points",
    "SELECT event_id, y_true AS label, y_pred AS prediction, y_true - y_pred AS residual FROM {scored}",
)
def residual_points(spark, sf_dir):
    return op.residual_points(regression(spark, sf_dir))


GRID_BINS = 50


def _cell(x, n):
    return f"least(floor(({x} - lo_{x}) * {n} / (hi_{x} - lo_{x})), {n - 1})::int"


@query(
    "v9_residual_grid",
    "WITH p AS (SELECT CAST(y_pred AS double) AS x, CAST(y_true AS double) - CAST(y_pred AS double) AS y FROM {scored}), "
    "d AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL), e AS (SELECT min(x) AS lo_x, max(x) AS hi_x, min(y) AS lo_y, max(y) AS hi_y FROM d), "
    f"c AS (SELECT {_cell('x', GRID_BINS)} AS x_bin, {_cell('y', GRID_BINS)} AS y_bin, count(*) AS row_count FROM d, e GROUP BY ALL) "
    "SELECT x_bin, y_bin, "
    + ", ".join(f"round(lo_{a} + ({a}_bin + {step}) * (hi_{a} - lo_{a}) / {GRID_BINS}, 6) AS {a}_{end}" for a in "xy" for step, end in ((0, "low"), (1, "high")))
    + ", row_count FROM c, e",
)
def residual_grid(spark, sf_dir):
    grid = op.residual_grid(regression(spark, sf_dir), GRID_BINS)
    return grid.select("x_bin", "y_bin", *[F.round(c, 6).alias(c) for c in ("x_low", "x_high", "y_low", "y_high")], "row_count")
