"""M1-M9, T1-T6, K8, V7, V10, G4, S4, S5 and the flagship flow.

Linear models on one feature have a closed form (logistic regression: a few Newton steps), so their
SQL twins are exact. Trees have none and are checked by invariants in the tests.
"""

from pyspark.sql import functions as F

from ..functions.session import fresh_dir, written
from ..operators import columns as columns_op
from ..operators import evaluation as eval_op
from ..operators import features as features_op
from ..operators import joins as joins_op
from ..operators import models as op
from ..operators import rows as rows_op
from ..operators import splits as splits_op
from ..sources import load_table
from .catalog import query, table, view
from .evaluation import classes_sql, regression_sql
from .profiling import r, union
from .splits import KEYS, ORDER, PLAIN_SPLIT, folds_sql, split_sql

CARRIED = ["o_orderkey", "signal", "hint", "y_bin", "y_reg", "label"]


def orders(spark, sf_dir):
    return view(spark, sf_dir, "model_orders")


def split_for(spark, sf_dir, target, columns=CARRIED):
    return splits_op.split_data(orders(spark, sf_dir).select(*columns), target, keys=KEYS)


F_SQL = "f AS (SELECT * FROM {model_orders})"


def scaled_sql(x, target):
    """Table z: all rows with the split and x standardised on the training rows; table t: training rows."""
    split = split_sql(target, "f") if target in ("y_bin", "label") else PLAIN_SPLIT
    return (
        f"{F_SQL}, {split}, m AS (SELECT avg({x}) AS mx, stddev_pop({x}) AS sx FROM split WHERE \"_split\" = 'train'), "
        f"z AS MATERIALIZED (SELECT split.*, ({x} - mx) / sx AS x FROM split, m), "
        "t AS MATERIALIZED (SELECT * FROM z WHERE \"_split\" = 'train')"
    )


# Slope and intercept by model, from moments of a table with columns x and y.
SXX, SXY = "(var_pop(x) * count(*))", "(covar_pop(x, y) * count(*))"
SLOPES = {
    "linear_regression": f"{SXY} / {SXX}",
    "ridge": f"{SXY} / ({SXX} + {{alpha}})",
    "lasso": "sign(covar_pop(x, y)) * greatest(abs(covar_pop(x, y)) - {alpha}, 0) / var_pop(x)",
}


def line_sql(model, source, alpha=1.0, by=""):
    slope = SLOPES[model].format(alpha=alpha)
    keys, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"SELECT {keys}{slope} AS w, avg(y) - ({slope}) * avg(x) AS b FROM {source}{group}"


def terms_sql(label="''", term="hint", digits=3):
    return (
        f"SELECT {label} AS class, '{term}' AS term, {r('w', digits)} AS value FROM line "
        f"UNION ALL SELECT {label}, 'intercept', {r('b', digits)} FROM line"
    )


def _terms(model, digits=3):
    return op.coefficients(model).select("class", "term", F.round("value", digits).alias("value"))


REGRESSION = f"WITH {scaled_sql('hint', 'y_reg')}, xy AS (SELECT x, y_reg AS y FROM t)"


def _linear(name, model):
    @query(name, f"{REGRESSION}, line AS ({line_sql(model, 'xy')}) {terms_sql()}")
    def run(spark, sf_dir):
        fitted, _ = op.train(split_for(spark, sf_dir, "y_reg"), "y_reg", model, "regression", ["hint"], scale=True)
        return _terms(fitted)


_linear("m3_linear_regression", "linear_regression")
_linear("m4_ridge", "ridge")
_linear("m5_lasso", "lasso")


def newton_sql(source, steps=12):
    """L2-penalised logistic regression (C = 1) on x and y in 0/1, as a chain of Newton steps."""
    out = ["n0 AS MATERIALIZED (SELECT CAST(0 AS double) AS w, CAST(0 AS double) AS b)"]
    for i in range(steps):
        p = f"(1 / (1 + exp(-(n{i}.w * x + n{i}.b))))"
        out.append(
            f"g{i} AS MATERIALIZED (SELECT any_value(w) AS w, any_value(b) AS b, sum(({p} - y) * x) + any_value(w) AS gw, sum({p} - y) AS gb, "
            f"sum({p} * (1 - {p}) * x * x) + 1 AS hww, sum({p} * (1 - {p}) * x) AS hwb, sum({p} * (1 - {p})) AS hbb FROM {source}, n{i}), "
            f"n{i + 1} AS MATERIALIZED (SELECT w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb) AS w, b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb) AS b FROM g{i})"
        )
    return ", ".join(out) + f", line AS MATERIALIZED (SELECT w, b FROM n{steps})"


BINARY = f"WITH {scaled_sql('signal', 'y_bin')}, xy AS MATERIALIZED (SELECT x, CAST(y_bin AS double) AS y FROM t)"
LOGISTIC = f"{BINARY}, {newton_sql('xy')}"


def _logistic(spark, sf_dir):
    return op.train(split_for(spark, sf_dir, "y_bin"), "y_bin", "logistic_regression", "classification", ["signal"], scale=True)


@query("m1_logistic_regression", f"{LOGISTIC} {terms_sql(chr(39) + '1' + chr(39), 'signal', 4)}")
def logistic(spark, sf_dir):
    return _terms(_logistic(spark, sf_dir)[0], 4)


SIGNED = f"WITH {scaled_sql('signal', 'y_bin')}, xy AS (SELECT x, CASE WHEN y_bin = 1 THEN 1.0 ELSE -1.0 END AS y FROM t)"


@query("m2_ridge_classifier", f"{SIGNED}, line AS ({line_sql('ridge', 'xy')}) {terms_sql(chr(39) + '1' + chr(39), 'signal', 6)}")
def ridge_classifier(spark, sf_dir):
    df = split_for(spark, sf_dir, "y_bin")
    return _terms(op.train(df, "y_bin", "ridge_classifier", "classification", ["signal"], scale=True)[0], 6)


SCALED_LABEL = f"WITH {scaled_sql('hint', 'label')}"
STATUSES = ["F", "O", "P"]


@query(
    "m2_ridge_classifier_many",
    SCALED_LABEL
    + "".join(f", xy{k} AS (SELECT x, CASE WHEN label = '{k}' THEN 1.0 ELSE -1.0 END AS y FROM t), l{k} AS ({line_sql('ridge', f'xy{k}')})" for k in STATUSES)
    + ", line AS (SELECT "
    + ", ".join(f"l{k}.w AS w{k}, l{k}.b AS b{k}" for k in STATUSES)
    + " FROM lF, lO, lP) "
    + union(f"SELECT '{k}' AS class, 'hint' AS term, {r(f'w{k}', 6)} AS value FROM line UNION ALL SELECT '{k}', 'intercept', {r(f'b{k}', 6)} FROM line" for k in STATUSES),
)
def ridge_classifier_many(spark, sf_dir):
    df = split_for(spark, sf_dir, "label")
    return _terms(op.train(df, "label", "ridge_classifier", "classification", ["hint"], scale=True)[0], 6)


TREE_FEATURES = ["signal", "c_acctbal", "c_nationkey", "order_month"]
REG_FEATURES = ["hint", "c_acctbal", "c_nationkey", "order_month"]


def _tree(name, model):
    @query(f"{name}_classifier")
    def classify(spark, sf_dir):
        df = split_for(spark, sf_dir, "y_bin", ["o_orderkey", "y_bin", *TREE_FEATURES])
        return eval_op.classification_metrics(op.train(df, "y_bin", model, "classification", TREE_FEATURES)[1])

    @query(f"{name}_regressor")
    def regress(spark, sf_dir):
        df = split_for(spark, sf_dir, "y_reg", ["o_orderkey", "y_reg", *REG_FEATURES])
        return eval_op.regression_metrics(op.train(df, "y_reg", model, "regression", REG_FEATURES)[1], len(REG_FEATURES))


_tree("m6_decision_tree", "decision_tree")
_tree("m7_random_forest", "random_forest")
_tree("m8_gradient_boosting", "gradient_boosting")
_tree("m9_lightgbm", "lightgbm")

NATIONS = "c_nationkey"


def _stump_sql(extra, value):
    """The best cut of one feature for a gradient g, at least 20 rows a side, and the value of either side."""
    return f"""
c AS (SELECT x, sum(g) AS g, count(*) AS n, {extra} AS h FROM d GROUP BY x),
s AS (SELECT x, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(h) OVER w AS hl, sum(g) OVER () AS g, sum(n) OVER () AS n, sum(h) OVER () AS h FROM c WINDOW w AS (ORDER BY x)),
best AS (SELECT *, gl * gl / nl + (g - gl) * (g - gl) / (n - nl) AS gain FROM s WHERE nl >= {{least}} AND n - nl >= {{least}} ORDER BY gain DESC, x LIMIT 1),
leaf AS (SELECT x AS cut, {value.format(g="gl", h="hl")} AS low, {value.format(g="(g - gl)", h="(h - hl)")} AS high FROM best)"""


@query(
    "m9_leafwise_round",
    f"""
WITH m AS (SELECT avg(y_reg) AS mean FROM {{order_features}}),
d AS (SELECT {NATIONS} AS x, mean - y_reg AS g FROM {{order_features}}, m), {_stump_sql("count(*)", "-0.1 * {g} / {h}").format(least=20)}
SELECT {NATIONS}, count(*) AS row_count, round(any_value(mean + CASE WHEN {NATIONS} <= cut THEN low ELSE high END), 2) AS prediction
FROM {{order_features}}, m, leaf GROUP BY {NATIONS}""",
)
def leafwise_round(spark, sf_dir):
    """One round of one split on one feature: every step of it can be told in SQL."""
    df = view(spark, sf_dir, "order_features").select(NATIONS, "y_reg")
    spec = op.make_spec(df, "y_reg", "lightgbm", "regression", [NATIONS], {"n_estimators": 1, "max_depth": 1})
    scored = op.score(op.fit_model(df, spec), df)
    return scored.groupBy(NATIONS).agg(F.count("*").alias("row_count"), F.round(F.first("prediction"), 2).alias("prediction"))


def _class_round_sql(k):
    return f"""
d AS (SELECT {NATIONS} AS x, (SELECT count(*) FILTER (label = '{k}') / count(*) FROM {{order_features}}) - CASE WHEN label = '{k}' THEN 1.0 ELSE 0.0 END AS g FROM {{order_features}}),
{_stump_sql("sum(abs(g) * (1 - abs(g)))", "-0.1 * 2 / 3.0 * {g} / {h}").format(least=1)}
SELECT {NATIONS}, (SELECT ln(count(*) FILTER (label = '{k}') / count(*)) FROM {{order_features}}) + CASE WHEN {NATIONS} <= cut THEN low ELSE high END AS s
FROM (SELECT DISTINCT {NATIONS} FROM {{order_features}}), leaf"""


@query(
    "m8_multiclass_round",
    "WITH "
    + ", ".join(f"r{k} AS (WITH {_class_round_sql(k)})" for k in STATUSES)
    + f", e AS (SELECT {NATIONS}, exp(rF.s) AS f, exp(rO.s) AS o, exp(rP.s) AS p FROM rF JOIN rO USING ({NATIONS}) JOIN rP USING ({NATIONS})) "
    + f"SELECT {NATIONS}, " + ", ".join(f"round({k.lower()} / (f + o + p), 5) AS {k.lower()}" for k in STATUSES) + " FROM e",
)
def multiclass_round(spark, sf_dir):
    """One round of one split a class on softmax gradients."""
    df = view(spark, sf_dir, "order_features").select(NATIONS, "label")
    spec = op.make_spec(df, "label", "gradient_boosting", "classification", [NATIONS], {"n_estimators": 1, "max_depth": 1})
    scored = op.class_probabilities(op.fit_model(df, spec), df).groupBy(NATIONS).agg(F.first("probabilities").alias("p"))
    return scored.select(NATIONS, *[F.round(F.col("p")[k], 5).alias(k.lower()) for k in STATUSES])


@query("m8_multiclass_probabilities", "SELECT count(*) AS row_count, count(*) AS adding_up, 3 AS classes FROM {order_features}")
def multiclass_probabilities(spark, sf_dir):
    df = view(spark, sf_dir, "order_features").withColumn("month", F.month("o_orderdate")).select("label", "c_acctbal", NATIONS, "month")
    spec = op.make_spec(df, "label", "gradient_boosting", "classification", None, {"n_estimators": 3, "max_depth": 3})
    shares = F.map_values("probabilities")
    scored = op.class_probabilities(op.fit_model(df, spec), df).select(shares.alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, b: a + b)
    fair = (F.abs(total - 1) < 1e-9) & F.forall("p", lambda x: (x > 0) & (x < 1))
    return scored.agg(F.count("*").alias("row_count"), F.count_if(fair).alias("adding_up"), F.max(F.size("p")).alias("classes"))


CALLED = "SELECT CAST(y_bin AS varchar) AS label, CASE WHEN w * x + b > 0 THEN '1' ELSE '0' END AS prediction FROM z, line WHERE \"_split\" = 'test'"


@query("t1_train_classifier", f"{LOGISTIC}, scored AS ({CALLED}), {classes_sql('scored')}")
def train_classifier(spark, sf_dir):
    return eval_op.classification_metrics(_logistic(spark, sf_dir)[1])


PREDICTED = "SELECT o_orderkey, y_reg AS label, w * x + b AS prediction FROM z, line WHERE \"_split\" = 'test'"
REG_LINE = f"{REGRESSION}, line AS ({line_sql('linear_regression', 'xy')})"


def _regressor(spark, sf_dir):
    df = split_for(spark, sf_dir, "y_reg")
    return df, *op.train(df, "y_reg", "linear_regression", "regression", ["hint"], scale=True)


@query("t1_train_regressor", f"{REG_LINE}, scored AS ({PREDICTED}) {regression_sql('scored', 1)}")
def train_regressor(spark, sf_dir):
    return eval_op.regression_metrics(_regressor(spark, sf_dir)[2], 1)


def _r2(y="y", p="p"):
    return f"1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count(*))"


@query(
    "t2_compare_models",
    f"WITH {scaled_sql('hint', 'y_reg')}, xy AS (SELECT x, y_reg AS y FROM t)"
    + "".join(f", l_{m} AS ({line_sql(m, 'xy')})" for m in SLOPES)
    + ", s AS ("
    + union(f"SELECT '{m}' AS model, y_reg AS y, w * x + b AS p FROM z, l_{m} WHERE \"_split\" = 'test'" for m in SLOPES)
    + f") SELECT model, {r(_r2())} AS r2, {r('avg(abs(y - p))')} AS mae, {r('sqrt(avg((y - p) * (y - p)))')} AS rmse, 'success' AS status FROM s GROUP BY model",
)
def compare_linear(spark, sf_dir):
    df = split_for(spark, sf_dir, "y_reg")
    found, _ = op.compare_models(df, "y_reg", "regression", list(SLOPES), ["hint"], scale=True)
    return found


@query("t2_compare_all_classifiers")
def compare_classifiers(spark, sf_dir):
    df = split_for(spark, sf_dir, "y_bin", ["o_orderkey", "y_bin", *TREE_FEATURES])
    return op.compare_models(df, "y_bin", "classification", features=TREE_FEATURES, scale=True)[0]


FOLDED = f"WITH {F_SQL}, {folds_sql(None, 5)}, xy AS (SELECT \"_fold\" AS f, hint AS x, y_reg AS y FROM folded)"


def cv_sql(model, k, alpha=1.0):
    """R2 on each held-out fold of xy(f, x, y)."""
    return (
        f"others AS (SELECT t.i AS i, x, y FROM range({k}) AS t(i), xy WHERE f <> t.i), lines AS ({line_sql(model, 'others', alpha, 'i')}), "
        f"held AS (SELECT i, y, w * x + b AS p FROM xy JOIN lines ON f = i)"
    )


@query("t3_cross_validate", f"{FOLDED}, {cv_sql('linear_regression', 5)} SELECT i + 1 AS fold, {r(_r2(), 6)} AS score FROM held GROUP BY i")
def cross_validate(spark, sf_dir):
    found = op.cross_validate(orders(spark, sf_dir), "y_reg", "linear_regression", "regression", 5, ["hint"], KEYS)
    return found.select("fold", F.round("score", 6).alias("score"))


@query(
    "t3_cv_summary",
    f"{FOLDED}, {cv_sql('linear_regression', 5)}, s AS (SELECT {_r2()} AS score FROM held GROUP BY i) SELECT round(avg(score), 4) AS mean_score, round(stddev_pop(score), 4) AS std_score FROM s",
)
def cv_summary(spark, sf_dir):
    return op.cv_summary(op.cross_validate(orders(spark, sf_dir), "y_reg", "linear_regression", "regression", 5, ["hint"], KEYS))


@query("t3_cross_validate_logistic")
def cross_validate_logistic(spark, sf_dir):
    return op.cross_validate(orders(spark, sf_dir), "y_bin", "logistic_regression", "classification", 5, TREE_FEATURES, KEYS)


TUNED = f"WITH f0 AS (SELECT * FROM {{model_orders}}), s AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rk FROM f0), f AS (SELECT * EXCLUDE (rk) FROM s WHERE rk > (SELECT ceil(count(*) * 0.2) FROM f0)), {folds_sql(None, 3)}, xy AS (SELECT \"_fold\" AS f, hint AS x, y_reg AS y FROM folded)"


def _tuned(alpha):
    return (
        f"SELECT '{{\"alpha\": {alpha}}}' AS params, round(avg(score), 4) AS mean_score, round(stddev_pop(score), 4) AS std_score FROM "
        f"(WITH {cv_sql('ridge', 3, alpha)} SELECT {_r2()} AS score FROM held GROUP BY i)"
    )


@query("t4_tune_ridge", f"{TUNED} {union(_tuned(a) for a in (0.1, 1.0, 10.0))}")
def tune_ridge(spark, sf_dir):
    found, _, _ = op.tune(split_for(spark, sf_dir, "y_reg"), "y_reg", "ridge", "regression", 3, ["hint"], KEYS)
    return found.drop("best")


@query("t4_tune_logistic")
def tune_logistic(spark, sf_dir):
    df = split_for(spark, sf_dir, "y_bin", ["o_orderkey", "y_bin", *TREE_FEATURES])
    return op.tune(df, "y_bin", "logistic_regression", "classification", 3, TREE_FEATURES, KEYS)[0]


@query("t4_tune_decision_tree")
def tune_tree(spark, sf_dir):
    df = split_for(spark, sf_dir, "y_bin", ["o_orderkey", "y_bin", *TREE_FEATURES])
    return op.tune(df, "y_bin", "decision_tree", "classification", 3, TREE_FEATURES, KEYS)[0]


@query(
    "t5_retrain_full",
    f"WITH {F_SQL}, m AS (SELECT avg(hint) AS mx, stddev_pop(hint) AS sx FROM f), xy AS (SELECT (hint - mx) / sx AS x, y_reg AS y FROM f, m), line AS ({line_sql('linear_regression', 'xy')}) {terms_sql()}",
)
def retrain(spark, sf_dir):
    df, model, _ = _regressor(spark, sf_dir)
    return _terms(op.retrain_full(model, df))


@query(
    "t6_preview_predictions",
    f"{REG_LINE}, scored AS ({PREDICTED}) SELECT o_orderkey, label, round(prediction, 3) AS prediction FROM scored ORDER BY o_orderkey LIMIT 10",
)
def preview(spark, sf_dir):
    df, model, _ = _regressor(spark, sf_dir)
    found = op.preview_predictions(model, df, 10, KEYS)
    return found.withColumn("prediction", F.round("prediction", 3))


@query(
    "v7_learning_curve",
    f"""WITH {F_SQL}, {PLAIN_SPLIT},
tr AS (SELECT hint AS x, y_reg AS y, row_number() OVER (ORDER BY {ORDER}) AS rn FROM split WHERE "_split" = 'train'),
te AS (SELECT hint AS x, y_reg AS y FROM split WHERE "_split" = 'test'),
sizes AS (SELECT i, greatest(CAST(floor((SELECT count(*) FROM tr) * round(0.1 + 0.9 * i / 4, 12)) AS bigint), 2) AS size FROM range(5) AS q(i)),
part AS (SELECT size AS i, x, y FROM tr, sizes WHERE rn <= size),
lines AS ({line_sql('linear_regression', 'part', 1.0, 'i')}),
a AS (SELECT i, {_r2('y', '(w * x + b)')} AS s FROM part JOIN lines USING (i) GROUP BY i),
v AS (SELECT i, {_r2('y', '(w * x + b)')} AS s FROM te, lines GROUP BY i)
SELECT a.i AS size, {r('a.s')} AS train_score, {r('v.s')} AS val_score FROM a JOIN v USING (i)""",
)
def learning_curve(spark, sf_dir):
    df = split_for(spark, sf_dir, "y_reg")
    model, _ = op.train(df, "y_reg", "linear_regression", "regression", ["hint"])
    return op.learning_curve(df, model, 5, KEYS)


RANKED = f"""WITH {F_SQL}, {PLAIN_SPLIT}, t AS (SELECT hint AS a, c_acctbal AS c, y_reg AS y FROM split WHERE "_split" = 'train'),
s AS (SELECT var_pop(a) AS aa, var_pop(c) AS cc, covar_pop(a, c) AS ac, covar_pop(a, y) AS ay, covar_pop(c, y) AS cy FROM t),
w AS (SELECT 'hint' AS feature, abs((ay * cc - cy * ac) / (aa * cc - ac * ac)) AS v FROM s UNION ALL SELECT 'c_acctbal', abs((cy * aa - ay * ac) / (aa * cc - ac * ac)) FROM s)
SELECT row_number() OVER (ORDER BY v DESC) AS rank, feature, round(v, 4) AS importance FROM w"""


def _ranked(spark, sf_dir):
    df = split_for(spark, sf_dir, "y_reg", ["o_orderkey", "y_reg", "hint", "c_acctbal"])
    return op.train(df, "y_reg", "linear_regression", "regression", ["hint", "c_acctbal"])[0]


@query("k8_rank_features", RANKED)
def rank_features(spark, sf_dir):
    return op.rank_features(_ranked(spark, sf_dir))


@query("g4_feature_importance", f"SELECT * FROM ({RANKED}) WHERE rank <= 1")
def feature_importance(spark, sf_dir):
    return op.feature_importance(_ranked(spark, sf_dir), 1)


STUMP_FEATURES = ["signal", "hint"]


def _exact_stump_sql(target, classes):
    """The cut of highest gain over all values of the training rows, and what lies on its sides."""
    sums = [f"count(*) FILTER (y = '{k}')" for k in classes] or ["sum(y - m)"]
    named = ", ".join(f"{s} AS s{k}" for k, s in enumerate(sums))
    every = range(len(sums))
    low = " + ".join(f"CAST(l{k} AS double) * l{k}" for k in every)
    high = " + ".join(f"CAST(t{k} - l{k} AS double) * (t{k} - l{k})" for k in every)
    whole = " + ".join(f"CAST(t{k} AS double) * t{k}" for k in every)
    values = union(f"SELECT {i} AS f, '{c}' AS feature, CAST({c} AS double) AS v, y, m FROM t" for i, c in enumerate(STUMP_FEATURES))
    split = split_sql(target, "f") if classes else PLAIN_SPLIT
    mean = "0" if classes else "avg(CAST({0} AS double)) OVER ()".format(target)
    left, right = ([f"l{k} / nl" for k in every], [f"(t{k} - l{k}) / (n - nl)" for k in every]) if classes else (["m + l0 / nl"], ["m + (t0 - l0) / (n - nl)"])
    spread, digits = ("n", 4) if classes else ("e", -6)
    rows = " UNION ALL ".join(
        f"SELECT '{side}' AS side, feature, cut, round(gain, {digits}) AS gain, {k} AS place, round({x}, 6) AS value FROM best"
        for side, shares in (("left", left), ("right", right)) for k, x in enumerate(shares)
    )
    return f"""WITH {F_SQL}, {split}, t AS MATERIALIZED (SELECT *, {target} AS y, {mean} AS m FROM split WHERE "_split" = 'train'),
x AS ({values}), c AS (SELECT f, feature, v, count(*) AS c, max(m) AS m, {named}, {"count(*)" if classes else "sum((y - m) * (y - m))"} AS ee FROM x GROUP BY f, feature, v),
r AS (SELECT f, feature, v, m, lead(v) OVER (PARTITION BY f ORDER BY v) AS nx, sum(c) OVER w AS nl, sum(c) OVER p AS n, sum(ee) OVER p AS e,
{", ".join(f"sum(s{k}) OVER w AS l{k}, sum(s{k}) OVER p AS t{k}" for k in every)} FROM c
WINDOW w AS (PARTITION BY f ORDER BY v ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY f)),
g AS (SELECT *, ({low}) / nl + ({high}) / (n - nl) - ({whole}) / n AS gain, {spread} - ({whole}) / n AS impurity, v / 2 + nx / 2 AS cut FROM r WHERE nx IS NOT NULL),
best AS MATERIALIZED (SELECT * FROM g ORDER BY round(gain / impurity, 12) DESC, f, v LIMIT 1) {rows}"""


def _exact_stump(target, problem_type, digits):
    def run(spark, sf_dir):
        df = split_for(spark, sf_dir, target)
        model, _ = op.train(df, target, "decision_tree", problem_type, STUMP_FEATURES, {"max_depth": 1, "exact_splits": True})
        nodes = op.tree_nodes(model)
        top = nodes.where("node = 0").select("feature", "cut", F.round("gain", digits).alias("gain"), F.col("left").alias("l"))
        leaves = nodes.where("depth = 1").select("node", F.posexplode("values").alias("place", "value"))
        side = F.when(F.col("node") == F.col("l"), "left").otherwise("right").alias("side")
        return top.join(leaves, F.lit(True)).select(side, "feature", "cut", "gain", "place", F.round("value", 6).alias("value"))

    return run


query("m6_stump_exact", _exact_stump_sql("label", STATUSES))(_exact_stump("label", "classification", 4))
query("m6_stump_exact_regression", _exact_stump_sql("y_reg", []))(_exact_stump("y_reg", "regression", -6))


@query("m6_tree_exact_training")
def exact_tree(spark, sf_dir):
    """Leaf sizes, means and errors of a deep exact tree on its training rows."""
    df = written(split_for(spark, sf_dir, "y_reg"))
    model, _ = op.train(df, "y_reg", "decision_tree", "regression", STUMP_FEATURES, {"max_depth": 4, "exact_splits": True})
    scored = op.score(model, df.where("_split = 'train'"))
    gap = F.col("label") - F.col("prediction")
    return scored.groupBy(F.round("prediction", 6).alias("leaf")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.abs(gap)), 6).alias("error"))


@query("k8_rank_features_forest")
def rank_forest(spark, sf_dir):
    df = split_for(spark, sf_dir, "y_bin", ["o_orderkey", "y_bin", *TREE_FEATURES])
    return op.rank_features(op.train(df, "y_bin", "random_forest", "classification", TREE_FEATURES)[0])


@query(
    "s4_save_predictions",
    f"{REGRESSION}, line AS ({line_sql('linear_regression', 'xy')}) SELECT hint, y_reg AS actual, round(w * x + b, 3) AS predicted FROM z, line WHERE \"_split\" = 'test'",
)
def save_predictions(spark, sf_dir):
    df, model, _ = _regressor(spark, sf_dir)
    path = fresh_dir(spark, "predictions") + ".csv"
    op.save_predictions(model, df, path)
    return load_table(spark, path).withColumn("predicted", F.round("predicted", 3))


@query(
    "s5_model_round_trip",
    f"WITH {F_SQL}, {split_sql('y_bin', 'f')} SELECT count(*) AS rows, 0 AS different FROM split WHERE \"_split\" = 'test'",
)
def model_round_trip(spark, sf_dir):
    model, scored = _logistic(spark, sf_dir)
    path = fresh_dir(spark, "model")
    op.save_model(model, path)
    again = op.score(op.load_model(path), scored.drop("label", "prediction", "probability"))
    both = scored.select("o_orderkey", "prediction", "probability").join(
        again.select("o_orderkey", F.col("prediction").alias("p2"), F.col("probability").alias("q2")), "o_orderkey"
    )
    differ = (F.col("prediction") != F.col("p2")) | (F.col("probability") != F.col("q2"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(differ).alias("different"))


@query("v10_report")
def report(spark, sf_dir):
    df, model, scored = _regressor(spark, sf_dir)
    stages = {"main": df, "train": df.where("_split = 'train'"), "test": df.where("_split = 'test'")}
    return eval_op.report(stages, model.spec.model_type, scored, "regression", 1)


@query("flow_order_status")
def order_status(spark, sf_dir):
    """Join, clean, engineer and encode; write the table once; split, scale, fit and evaluate."""
    joined = joins_op.merge_tables(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), left_on="o_custkey", right_on="c_custkey"
    )
    df = rows_op.drop_missing_target(joined, "o_orderstatus")
    df = columns_op.strip_whitespace(columns_op.drop_columns(df, ["c_custkey", "c_name"]))
    df = columns_op.fill_missing(df, "o_orderstatus")
    df = features_op.datetime_parts(df, "o_orderdate")
    df = features_op.aggregate_features(df, "o_custkey", ["o_totalprice"], ["mean", "count"])
    df = written(features_op.encode_categorical(columns_op.drop_columns(df, ["o_custkey"]), "o_orderstatus"))
    df = splits_op.split_data(df, "o_orderstatus", keys=KEYS)
    names = [c for c in df.columns if c not in ("o_orderkey", "o_orderstatus", "_split")]
    _, scored = op.train(df, "o_orderstatus", "logistic_regression", "classification", names, scale=True)
    return eval_op.classification_metrics(scored)
