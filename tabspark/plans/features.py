"""E1-E10."""

from pyspark.sql import functions as F

from ..operators import features as op
from .catalog import query, view
from .profiling import r, sql_corr, union

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def orders(spark, sf_dir):
    return view(spark, sf_dir, "order_features")


def lines(spark, sf_dir):
    return view(spark, sf_dir, "dirty_lines")


def _dummies(c, values):
    return ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for v in values[1:])


@query(
    "e1_encode_categorical",
    "SELECT o_orderkey, dense_rank() OVER (ORDER BY label) - 1 AS label, y_bin, y_reg, "
    "dense_rank() OVER (ORDER BY CAST(o_orderdate AS varchar)) - 1 AS o_orderdate, c_acctbal, c_nationkey, y_rare, "
    + _dummies("o_orderpriority", PRIORITIES)
    + ", "
    + _dummies("c_mktsegment", SEGMENTS)
    + " FROM {order_features}",
)
def encode(spark, sf_dir):
    return op.encode_categorical(orders(spark, sf_dir), "label")


@query(
    "e1_one_hot_missing",
    "SELECT l_orderkey, l_partkey, l_quantity, "
    + _dummies("l_returnflag", ["  A ", "  N ", "  R ", "A", "N", "R"])
    + ", CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS \"l_linestatus_O\" FROM {dirty_lines}",
)
def one_hot_missing(spark, sf_dir):
    df = lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    return op.encode_categorical(df, "l_quantity")


@query(
    "e2_label_codes",
    "SELECT l_orderkey, l_partkey, l_linenumber, dense_rank() OVER (ORDER BY CASE WHEN l_partkey % 13 = 0 THEN 'nan' ELSE row_tag END) - 1 AS row_tag FROM {dirty_lines}",
)
def label_codes(spark, sf_dir):
    tag = F.when(F.col("l_partkey") % 13 != 0, F.col("row_tag"))
    df = lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_linenumber", tag.alias("row_tag"))
    return op.encode_categorical(df, "l_linenumber")


@query(
    "e3_encode_target",
    "SELECT l_orderkey, l_partkey, dense_rank() OVER (ORDER BY coalesce(l_returnflag, 'nan')) - 1 AS l_returnflag FROM {dirty_lines}",
)
def encode_target(spark, sf_dir):
    return op.encode_categorical(lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_returnflag"), "l_returnflag")


def _bin_case(column, n):
    return "CASE " + " ".join(f"WHEN {column} <= e[{i + 1}] THEN {i - 1}" for i in range(1, n + 1)) + " END"


@query(
    "e4_bin_quantile",
    "WITH b AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM {dirty_lines}) "
    f"SELECT l_orderkey, l_partkey, l_extendedprice AS l_extendedprice_original, {_bin_case('l_extendedprice', 5)} AS l_extendedprice_bin FROM {{dirty_lines}}, b",
)
def bin_quantile(spark, sf_dir):
    df = lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_extendedprice")
    return op.bin_continuous(df, "l_extendedprice", 5).drop("l_extendedprice")


UNIFORM = (
    "WITH m AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {{{v}}}), "
    "b AS (SELECT [lo - 0.001 * (hi - lo), lo + 1 * (hi - lo) / 4, lo + 2 * (hi - lo) / 4, lo + 3 * (hi - lo) / 4, hi] AS e FROM m) "
)


@query(
    "e4_bin_uniform",
    UNIFORM.format(c="l_discount", v="dirty_lines")
    + "SELECT l_orderkey, l_partkey, l_discount AS l_discount_original, "
    + f"CAST({_bin_case('l_discount', 4)} AS double) AS l_discount_bin, CASE {_bin_case('l_discount', 4)} WHEN 0 THEN 'low' WHEN 1 THEN 'mid' WHEN 2 THEN 'high' WHEN 3 THEN 'top' END AS l_discount FROM {{dirty_lines}}, b",
)
def bin_uniform(spark, sf_dir):
    df = lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_discount")
    out = op.bin_continuous(df, "l_discount", 4, "uniform", ["low", "mid", "high", "top"])
    return out.withColumn("l_discount_bin", F.col("l_discount_bin").cast("double"))


@query(
    "e4_bin_counts",
    UNIFORM.format(c="l_quantity", v="dirty_lines")
    + f", x AS (SELECT {_bin_case('l_quantity', 4)} AS bin FROM {{dirty_lines}}, b) "
    + union(
        f"SELECT {i} AS bin, {r(f'any_value(b.e[{i + 1}])')} AS lower_edge, {r(f'any_value(b.e[{i + 2}])')} AS upper_edge, (SELECT count(*) FROM x WHERE bin = {i}) AS row_count FROM b"
        for i in range(4)
    ),
)
def bin_counts(spark, sf_dir):
    df = lines(spark, sf_dir)
    return op.bin_counts(df, op.fit_bins(df, "l_quantity", 4, "uniform")).drop("label")


@query(
    "e5_log_transform",
    "SELECT l_orderkey, l_partkey, l_quantity, round(ln(l_extendedprice + 1), 6) AS l_extendedprice, l_discount, round(ln(dup_price + 1), 6) AS dup_price FROM {dirty_lines}",
)
def log_transform(spark, sf_dir):
    df = lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "dup_price")
    out = op.log_transform(df, target="l_discount")
    return out.withColumns({c: F.round(c, 6) for c in ("l_extendedprice", "dup_price")})


@query(
    "e5_log_report",
    union(
        f"SELECT '{c}' AS \"column\", {r(f'skewness({c})')} AS skew_before, {r(f'skewness(ln({c} + 1))')} AS skew_after FROM {{dirty_lines}}"
        for c in ("l_quantity", "l_extendedprice")
    ),
)
def log_report(spark, sf_dir):
    df = lines(spark, sf_dir)
    return op.log_report(df, op.fit_log(df, ["l_quantity", "l_extendedprice", "l_returnflag"]))


TIME = "try_cast(ts_text AS timestamp)"


@query(
    "e6_datetime_parts",
    f"""
SELECT event_id, CAST(year({TIME}) AS double) AS ts_text_year, CAST(month({TIME}) AS double) AS ts_text_month,
  CAST(day({TIME}) AS double) AS ts_text_day, CAST(isodow({TIME}) - 1 AS double) AS ts_text_dayofweek,
  CAST(hour({TIME}) AS double) AS ts_text_hour, CAST(minute({TIME}) AS double) AS ts_text_minute,
  CAST(quarter({TIME}) AS double) AS ts_text_quarter, CAST(coalesce(isodow({TIME}) >= 6, false) AS double) AS ts_text_is_weekend
FROM {{event_times}}""",
)
def datetime_parts(spark, sf_dir):
    df = view(spark, sf_dir, "event_times").select("event_id", "ts_text")
    out = op.datetime_parts(df, "ts_text", op.DATE_PARTS)
    return out.select("event_id", *[F.col(c).cast("double").alias(c) for c in out.columns if c != "event_id"])


@query(
    "e6_datetime_failures",
    f"SELECT count(*) FILTER (WHERE ts_text IS NOT NULL AND {TIME} IS NULL) AS parse_failures FROM {{event_times}}",
)
def datetime_failures(spark, sf_dir):
    return op.datetime_failures(view(spark, sf_dir, "event_times"), "ts_text")


@query(
    "e7_interactions_given",
    "SELECT l_orderkey, l_partkey, round(l_quantity * l_extendedprice, 4) AS l_quantity_x_l_extendedprice, round(l_discount * l_tax, 6) AS l_discount_x_l_tax FROM {dirty_lines}",
)
def interactions(spark, sf_dir):
    pairs = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax"), ("l_returnflag", "l_tax"), ("absent", "l_tax")]
    out = op.create_interactions(lines(spark, sf_dir), pairs)
    return out.select(
        "l_orderkey",
        "l_partkey",
        F.round("l_quantity_x_l_extendedprice", 4).alias("l_quantity_x_l_extendedprice"),
        F.round("l_discount_x_l_tax", 6).alias("l_discount_x_l_tax"),
    )


AUTO = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "dup_price", "const_col"]


@query(
    "e7_interactions_auto",
    "WITH c AS ("
    + union(f"SELECT '{c}' AS f, {i} AS pos, {sql_corr(c, 'l_extendedprice')} AS r FROM {{dirty_lines}}" for i, c in enumerate(AUTO))
    + "), t AS (SELECT f, row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, pos) AS k FROM c), "
    + "s AS ("
    + union(f"SELECT '{a}' AS fa, '{b}' AS fb, sum(CAST({a} AS double) * {b}) AS total FROM {{dirty_lines}}" for a in AUTO for b in AUTO if a != b)
    + ") SELECT concat(a.f, '_x_', b.f) AS pair, round(total, 1) AS total FROM t a JOIN t b ON a.k < b.k AND b.k <= 5 JOIN s ON fa = a.f AND fb = b.f",
)
def interactions_auto(spark, sf_dir):
    df = lines(spark, sf_dir).select(*AUTO, "l_extendedprice")
    out = op.create_interactions(df, target="l_extendedprice")
    new = [c for c in out.columns if "_x_" in c]
    totals = out.agg(*[F.sum(c).alias(c) for c in new])
    rows = [F.struct(F.lit(c).alias("pair"), F.round(F.col(c), 1).alias("total")) for c in new]
    return totals.select(F.inline(F.array(*rows)))


@query(
    "e8_polynomials",
    "SELECT l_orderkey, l_partkey, pow(l_quantity, 2) AS l_quantity_pow2, pow(l_quantity, 3) AS l_quantity_pow3, round(pow(l_tax, 2), 8) AS l_tax_pow2, round(pow(l_tax, 3), 8) AS l_tax_pow3 FROM {dirty_lines}",
)
def polynomials(spark, sf_dir):
    out = op.create_polynomials(lines(spark, sf_dir), ["l_quantity", "l_tax", "l_returnflag"], degree=3)
    return out.select(
        "l_orderkey",
        "l_partkey",
        "l_quantity_pow2",
        "l_quantity_pow3",
        F.round("l_tax_pow2", 8).alias("l_tax_pow2"),
        F.round("l_tax_pow3", 8).alias("l_tax_pow3"),
    )


PAIRS = [("l_extendedprice", "l_quantity"), ("l_quantity", "l_discount"), ("l_tax", "l_tax")]


def _ratio(a, b):
    return f"({a} / nullif({b}, 0))"


@query(
    "e9_ratios",
    "WITH d AS (SELECT *, "
    + ", ".join(f"{_ratio(a, b)} AS q{i}" for i, (a, b) in enumerate(PAIRS))
    + " FROM {dirty_lines}) SELECT l_orderkey, l_partkey, "
    + ", ".join(f"coalesce(q{i}, (SELECT coalesce(median(q{i}), 0) FROM d)) AS {a}_div_{b}" for i, (a, b) in enumerate(PAIRS))
    + " FROM d",
)
def ratios(spark, sf_dir):
    out = op.create_ratios(lines(spark, sf_dir), PAIRS)
    return out.select("l_orderkey", "l_partkey", *[f"{a}_div_{b}" for a, b in PAIRS])


@query(
    "e9_ratio_report",
    union(
        f"SELECT '{a}_div_{b}' AS \"column\", 0 AS infs_replaced, count(*) FILTER (WHERE {_ratio(a, b)} IS NULL) AS nulls_filled FROM {{dirty_lines}}"
        for a, b in PAIRS
    ),
)
def ratio_report(spark, sf_dir):
    df = lines(spark, sf_dir)
    return op.ratio_report(df, op.fit_ratios(df, PAIRS))


SQL_AGGS = {
    "mean": "round(avg({c}), 4)",
    "sum": "round(coalesce(sum({c}), 0), 2)",
    "count": "CAST(count({c}) AS double)",
    "min": "min({c})",
    "max": "max({c})",
    "std": "round(stddev_samp({c}), 4)",
    "median": "round(median({c}), 4)",
}


def _grouped(group, columns, source="{dirty_lines}"):
    parts = [f"{e.format(c=c)} AS {group}_{c}_{f}" for c in columns for f, e in SQL_AGGS.items()]
    names = [f"{group}_{c}_{f}" for c in columns for f in SQL_AGGS]
    return (
        f"WITH g AS (SELECT {group} AS k, {', '.join(parts)} FROM {source} WHERE {group} IS NOT NULL GROUP BY {group}) "
        f"SELECT l_orderkey, l_partkey, l_linenumber, {', '.join(names)} FROM {source} LEFT JOIN g ON {group} = k"
    )


def _group_query(group, columns, source=None, **options):
    source = source or lines

    def run(spark, sf_dir):
        out = op.aggregate_features(source(spark, sf_dir), group, columns, op.AGG_FUNCTIONS, **options)
        digits = {"mean": 4, "sum": 2, "std": 4, "median": 4}
        new = []
        for c in columns:
            for f in op.AGG_FUNCTIONS:
                name = f"{group}_{c}_{f}"
                value = F.col(name).cast("double")
                new.append((F.round(value, digits[f]) if f in digits else value).alias(name))
        return out.select("l_orderkey", "l_partkey", "l_linenumber", *new)

    return run


query("e10_group_features", _grouped("l_returnflag", ["l_quantity", "l_extendedprice"]))(
    _group_query("l_returnflag", ["l_quantity", "l_extendedprice"])
)
query("e10_group_features_many", _grouped("l_partkey", ["l_quantity"]))(_group_query("l_partkey", ["l_quantity"]))

# One group holds a third of the rows, some rows have none, and no table of groups may be broadcast.
HOT_LINES = """
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity,
  CASE WHEN l_orderkey % 3 = 0 THEN 0 WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_partkey END AS part
FROM {lineitem}"""


@query("e10_group_features_hot", _grouped("part", ["l_quantity"], f"({HOT_LINES}) AS t"))
def group_features_hot(spark, sf_dir):
    return _group_query("part", ["l_quantity"], broadcast_bytes=0, source=hot_lines)(spark, sf_dir)


def hot_lines(spark, sf_dir):
    return spark.sql(HOT_LINES, lineitem=view(spark, sf_dir, "lineitem"))
