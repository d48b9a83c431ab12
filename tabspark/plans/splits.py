"""D1-D7."""

from pyspark.sql import functions as F

from ..operators import splits as op
from .catalog import query, table, view


def orders(spark, sf_dir):
    return view(spark, sf_dir, "order_features")


KEYS = ["o_orderkey"]
ORDER = "md5(concat_ws('|', 42, o_orderkey))"


@query(
    "d1_separate",
    "SELECT o_orderkey, y_reg, c_acctbal, label FROM {order_features}",
)
def separate(spark, sf_dir):
    df = op.separate_features_target(orders(spark, sf_dir), "label")
    return df.select("features.o_orderkey", "features.y_reg", "features.c_acctbal", "label")


@query("d1_shapes", "SELECT count(*) AS x_rows, 9 AS x_columns, count(*) AS y_rows FROM {order_features}")
def shapes(spark, sf_dir):
    return op.shapes(orders(spark, sf_dir), "label")


def allocation_sql(label, source, test_size="0.2"):
    """Test rows per class: whole shares, then the largest remainders."""
    return f"""
sizes AS (SELECT {label} AS part, count(*) AS n FROM {source} GROUP BY 1),
total AS (SELECT CAST(ceil(sum(n) * {test_size}) AS bigint) AS k, CAST(sum(n) AS bigint) AS a FROM sizes),
quota AS (SELECT part, n, (k * n) // a AS base, (k * n) % a AS rest, k FROM sizes, total),
share AS (SELECT part, n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, part) <= k - sum(base) OVER () THEN 1 ELSE 0 END AS share FROM quota)"""


def split_sql(label, source):
    return f"""{allocation_sql(label, source)},
ranked AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {ORDER}) AS rn FROM {source}),
split AS (SELECT ranked.* EXCLUDE (rn), CASE WHEN rn <= share THEN 'test' ELSE 'train' END AS "_split" FROM ranked JOIN share ON part = {label})"""


@query(
    "d2_split_stratified",
    f'WITH f AS (SELECT * FROM {{order_features}}), {split_sql("label", "f")} SELECT o_orderkey, label, y_reg, "_split" FROM split',
)
def split_stratified(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_orderkey", "label", "y_reg")
    return op.split_data(df, "label", keys=KEYS)


PLAIN_SPLIT = f"""
ranked AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rn FROM f),
split AS (SELECT * EXCLUDE (rn), CASE WHEN rn <= (SELECT ceil(count(*) * 0.2) FROM f) THEN 'test' ELSE 'train' END AS "_split" FROM ranked)"""


@query(
    "d2_split_plain",
    f'WITH f AS (SELECT * FROM {{order_features}}), {PLAIN_SPLIT} SELECT o_orderkey, y_reg, "_split" FROM split',
)
def split_plain(spark, sf_dir):
    return op.split_data(orders(spark, sf_dir).select("o_orderkey", "y_reg"), "y_reg", keys=KEYS)


@query(
    "d2_split_summary",
    "SELECT 'test' AS split, CAST(ceil(count(*) * 0.2) AS bigint) AS rows FROM {order_features} UNION ALL SELECT 'train', count(*) - CAST(ceil(count(*) * 0.2) AS bigint) FROM {order_features}",
)
def split_summary(spark, sf_dir):
    return op.split_summary(op.split_data(orders(spark, sf_dir), "y_rare", keys=KEYS))


def folds_sql(label, k):
    """Fold of every row: fold f of a class holds as many rows as positions j = f (mod k) fall to it."""
    part = label or "1"
    count = "len(list_filter(range(start, start + n), lambda j: j % {k} = i))".replace("{k}", str(k))
    return f"""
sizes AS (SELECT {part} AS part, count(*) AS n FROM f GROUP BY 1),
placed AS (SELECT part, n, CAST(coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start FROM sizes),
per AS (SELECT part, i AS fold, {count} AS c FROM placed, range({k}) AS t(i)),
upto AS (SELECT part, fold, sum(c) OVER (PARTITION BY part ORDER BY fold) AS hi, sum(c) OVER (PARTITION BY part ORDER BY fold) - c AS lo FROM per),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {ORDER}) AS rn FROM f),
folded AS (SELECT ranked.* EXCLUDE (rn), fold AS "_fold" FROM ranked JOIN upto ON part = {part} AND rn > lo AND rn <= hi)"""


@query(
    "d3_folds_stratified",
    f'WITH f AS (SELECT * FROM {{order_features}}), {folds_sql("label", 5)} SELECT o_orderkey, label, "_fold" FROM folded',
)
def folds_stratified(spark, sf_dir):
    return op.create_folds(orders(spark, sf_dir).select("o_orderkey", "label"), "label", keys=KEYS)


@query(
    "d3_folds_plain",
    f'WITH f AS (SELECT * FROM {{order_features}}), {folds_sql(None, 4)} SELECT o_orderkey, y_reg, "_fold" FROM folded',
)
def folds_plain(spark, sf_dir):
    return op.create_folds(orders(spark, sf_dir).select("o_orderkey", "y_reg"), "y_reg", 4, keys=KEYS)


@query(
    "d3_fold_summary",
    f'WITH f AS (SELECT * FROM {{order_features}}), {folds_sql("label", 5)} SELECT "_fold" + 1 AS fold, (SELECT count(*) FROM f) - count(*) AS train_rows, count(*) AS val_rows FROM folded GROUP BY "_fold"',
)
def fold_summary(spark, sf_dir):
    return op.fold_summary(op.create_folds(orders(spark, sf_dir), "label", keys=KEYS))


# Few columns of many rows, which repeat hundreds of times; all columns are the key.
REPEATED = "f AS (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem)"
REPEATED_ORDER = "md5(concat_ws('|', 42, l_returnflag, l_linestatus, l_quantity))"


def _repeated(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")


@query(
    "d2_split_repeated_rows",
    f"WITH {REPEATED}, {split_sql('l_returnflag', 'f').replace(ORDER, REPEATED_ORDER)} "
    'SELECT l_returnflag, l_linestatus, l_quantity, "_split" FROM split',
)
def split_repeated_rows(spark, sf_dir):
    return op.split_data(_repeated(spark, sf_dir), "l_returnflag")


@query(
    "d3_folds_repeated_rows",
    f"WITH {REPEATED}, {folds_sql('l_linestatus', 5).replace(ORDER, REPEATED_ORDER)} "
    'SELECT l_returnflag, l_linestatus, l_quantity, "_fold" FROM folded',
)
def folds_repeated_rows(spark, sf_dir):
    return op.create_folds(_repeated(spark, sf_dir), "l_linestatus")


@query(
    "d4_class_weight",
    "WITH s AS (SELECT y_rare AS part, count(*) AS n FROM {order_features} GROUP BY 1) "
    'SELECT o_orderkey, y_rare, round((SELECT sum(n) FROM s) / ((SELECT count(*) FROM s) * n), 8) AS "_weight" FROM {order_features} JOIN s ON part = y_rare',
)
def class_weight(spark, sf_dir):
    out = op.class_balance(orders(spark, sf_dir).select("o_orderkey", "y_rare"), "y_rare")
    return out.withColumn("_weight", F.round("_weight", 8))


SPLIT_RARE = f'f AS (SELECT * FROM {{order_features}}), {split_sql("y_rare", "f")}'
TRAIN_RANKED = f"""
train AS (SELECT * FROM split WHERE "_split" = 'train'),
counts AS (SELECT y_rare AS cls, count(*) AS n FROM train GROUP BY 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY y_rare ORDER BY {ORDER}) AS rn FROM train JOIN counts ON cls = y_rare)"""
TEST_ROWS = "SELECT o_orderkey, y_rare, \"_split\" FROM split WHERE \"_split\" = 'test'"


def _split_rare(spark, sf_dir):
    return op.split_data(orders(spark, sf_dir).select("o_orderkey", "y_rare"), "y_rare", keys=KEYS)


@query(
    "d5_undersample",
    f'WITH {SPLIT_RARE}, {TRAIN_RANKED} SELECT o_orderkey, y_rare, "_split" FROM placed WHERE rn <= (SELECT min(n) FROM counts) UNION ALL {TEST_ROWS}',
)
def undersample(spark, sf_dir):
    return op.class_balance(_split_rare(spark, sf_dir), "y_rare", "undersample", KEYS)


@query(
    "d6_oversample",
    f"WITH {SPLIT_RARE}, {TRAIN_RANKED}, c AS (SELECT *, (SELECT max(n) FROM counts) AS most FROM placed) "
    'SELECT o_orderkey, y_rare, "_split" FROM (SELECT *, unnest(range(most // n + CASE WHEN rn <= most % n THEN 1 ELSE 0 END)) FROM c) '
    f"UNION ALL {TEST_ROWS}",
)
def oversample(spark, sf_dir):
    return op.class_balance(_split_rare(spark, sf_dir), "y_rare", "oversample", KEYS)


@query(
    "d6_distribution",
    f"WITH {SPLIT_RARE}, {TRAIN_RANKED} SELECT cls AS label, (SELECT max(n) FROM counts) AS rows FROM counts",
)
def distribution(spark, sf_dir):
    balanced = op.class_balance(_split_rare(spark, sf_dir), "y_rare", "oversample", KEYS)
    return op.class_distribution(balanced.where(F.col("_split") == "train"), "y_rare")


SPLIT_LABEL = f'f AS (SELECT * FROM {{order_features}}), {split_sql("label", "f")}'


@query(
    "d7_scale_features",
    f"WITH {SPLIT_LABEL}, m AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(y_reg) AS mr, stddev_pop(y_reg) AS sr FROM split WHERE \"_split\" = 'train') "
    'SELECT o_orderkey, label, "_split", round((c_acctbal - ma) / sa, 8) AS c_acctbal, round((y_reg - mr) / sr, 8) AS y_reg FROM split, m',
)
def scale(spark, sf_dir):
    df = op.split_data(orders(spark, sf_dir).select("o_orderkey", "label", "c_acctbal", "y_reg"), "label", keys=KEYS)
    out = op.scale_features(df, "label", ["c_acctbal", "y_reg"])
    return out.withColumns({c: F.round(c, 8) for c in ("c_acctbal", "y_reg")})


@query(
    "d7_scaler_report",
    f"WITH {SPLIT_LABEL}, t AS (SELECT * FROM split WHERE \"_split\" = 'train') "
    "SELECT 'c_acctbal' AS \"column\", round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS std FROM t "
    "UNION ALL SELECT 'y_reg', round(avg(y_reg), 4), round(stddev_pop(y_reg), 4) FROM t",
)
def scaler_report(spark, sf_dir):
    df = op.split_data(orders(spark, sf_dir), "label", keys=KEYS)
    return op.scaler_report(df, op.fit_scaler(df, ["c_acctbal", "y_reg"]))
