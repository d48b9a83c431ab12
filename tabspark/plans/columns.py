"""C1-C10."""

from pyspark.sql import functions as F

from ..operators import columns as op
from .catalog import query, view
from .profiling import LINE_NUMBERS, LINE_TEXTS, LINE_TYPES, bounds_sql, union


def lines(spark, sf_dir):
    return view(spark, sf_dir, "dirty_lines")


@query("c1_drop_columns", "SELECT * EXCLUDE (row_tag, dup_price, l_shipdate) FROM {dirty_lines}")
def drop_columns(spark, sf_dir):
    return op.drop_columns(lines(spark, sf_dir), ["row_tag", "dup_price", "l_shipdate"])


@query("c2_select_features", "SELECT l_tax, l_orderkey, l_returnflag FROM {dirty_lines}")
def select_features(spark, sf_dir):
    return op.select_features(lines(spark, sf_dir), ["l_tax", "l_orderkey", "l_returnflag"])


@query("c3_rename_map", "SELECT o_orderkey AS id, o_totalprice AS price, o_orderstatus FROM orders")
def rename_map(spark, sf_dir):
    orders = view(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return op.rename_columns(orders, {"o_orderkey": "id", "o_totalprice": "price"})


@query("c3_rename_clean", "SELECT o_orderkey AS order_key, o_totalprice AS total_price_usd, o_orderstatus AS status FROM orders")
def rename_clean(spark, sf_dir):
    orders = view(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return op.rename_columns(orders.toDF(" Order-Key ", "Total Price (USD)", "STATUS!"), clean_all=True)


@query(
    "c4_cast_types",
    """
SELECT CAST(l_orderkey AS varchar) AS l_orderkey, CAST(l_linenumber AS double) AS l_linenumber, l_quantity,
  CAST(trunc(l_extendedprice) AS bigint) AS l_extendedprice, l_returnflag, CAST(l_suppkey AS bigint) AS supp_text,
  CASE WHEN l_discount = 0 THEN false ELSE true END AS l_discount
FROM {dirty_lines}""",
)
def cast_types(spark, sf_dir):
    df = lines(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_returnflag",
        F.col("l_suppkey").cast("string").alias("supp_text"),
        "l_discount",
    )
    return op.cast_types(
        df,
        {
            "l_orderkey": "str",
            "l_linenumber": "float",
            "l_quantity": "int",
            "l_extendedprice": "int",
            "l_returnflag": "float",
            "supp_text": "int",
            "l_discount": "bool",
        },
    )


@query(
    "c5_strip_whitespace",
    "SELECT l_orderkey, l_partkey, l_linenumber, trim(l_returnflag) AS flag, l_linestatus FROM {dirty_lines}",
)
def strip_whitespace(spark, sf_dir):
    df = lines(spark, sf_dir)
    padded = F.concat(F.lit("\t "), "l_linestatus", F.lit(" \n"))
    df = df.select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_returnflag").alias(" flag "), padded.alias("l_linestatus"))
    return op.strip_whitespace(df)


FLAG_MAP = {"A": "N", "N": "R", "R": "A"}


@query(
    "c6_replace_values",
    "SELECT l_orderkey, l_partkey, CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' WHEN 'R' THEN 'A' ELSE l_returnflag END AS l_returnflag FROM {dirty_lines}",
)
def replace_values(spark, sf_dir):
    df = lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_returnflag")
    return op.replace_values(df, "l_returnflag", FLAG_MAP)


@query(
    "c6_replace_report",
    union(
        f"SELECT '{k}' AS old_value, count(*) FILTER (WHERE l_returnflag = '{k}') AS occurrences, "
        "count(DISTINCT CASE l_returnflag WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' WHEN 'R' THEN 'A' ELSE l_returnflag END) AS unique_after FROM {dirty_lines}"
        for k in FLAG_MAP
    ),
)
def replace_report(spark, sf_dir):
    return op.replace_report(lines(spark, sf_dir), "l_returnflag", FLAG_MAP)


@query(
    "c7_clip_given",
    "SELECT l_orderkey, l_partkey, CASE WHEN l_quantity < 5 THEN 5 WHEN l_quantity > 40 THEN 40 ELSE l_quantity END AS l_quantity FROM {dirty_lines}",
)
def clip_given(spark, sf_dir):
    return op.clip_values(lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_quantity"), "l_quantity", 5, 40)


PRICE_BOUNDS = f"WITH b AS ({bounds_sql(['l_extendedprice'], '{dirty_lines}')})"


@query(
    "c7_clip_iqr",
    f"{PRICE_BOUNDS} SELECT l_orderkey, l_partkey, round(greatest(least(l_extendedprice, hi_l_extendedprice), lo_l_extendedprice), 4) AS l_extendedprice FROM {{dirty_lines}}, b",
)
def clip_iqr(spark, sf_dir):
    df = lines(spark, sf_dir).select("l_orderkey", "l_partkey", "l_extendedprice")
    return op.clip_values(df, "l_extendedprice").withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query(
    "c7_clip_report",
    f"{PRICE_BOUNDS} SELECT 'l_extendedprice' AS \"column\", round(any_value(lo_l_extendedprice), 4) AS lower_bound, round(any_value(hi_l_extendedprice), 4) AS upper_bound, "
    "count(*) FILTER (WHERE l_extendedprice < lo_l_extendedprice) AS clipped_lower, count(*) FILTER (WHERE l_extendedprice > hi_l_extendedprice) AS clipped_upper, "
    "count(*) FILTER (WHERE l_extendedprice < lo_l_extendedprice OR l_extendedprice > hi_l_extendedprice) AS total_clipped FROM {dirty_lines}, b",
)
def clip_report(spark, sf_dir):
    df = lines(spark, sf_dir)
    found = op.clip_report(df, op.fit_clip(df, "l_extendedprice"))
    return found.withColumns({c: F.round(c, 4) for c in ("lower_bound", "upper_bound")})


@query("c8_drop_high_missing", "SELECT * EXCLUDE (mostly_null) FROM {dirty_lines}")
def drop_high_missing(spark, sf_dir):
    return op.drop_high_missing(lines(spark, sf_dir), "l_returnflag", 0.5)


@query("c9_drop_high_cardinality", "SELECT * EXCLUDE (row_tag) FROM {dirty_lines}")
def drop_high_cardinality(spark, sf_dir):
    return op.drop_high_cardinality(lines(spark, sf_dir), "l_returnflag", 0.8)


def _filled(c):
    if c == "l_linenumber":
        return c
    if c in LINE_NUMBERS:
        return f"coalesce({c}, (SELECT coalesce(median({c}), 0) FROM d)) AS {c}"
    mode = f"(SELECT {c} FROM d WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
    return f"coalesce({c}, {mode}) AS {c}"


@query(
    "c10_fill_missing",
    "WITH d AS (SELECT * FROM {dirty_lines}) SELECT " + ", ".join(_filled(c) if c in ("l_quantity", "l_returnflag", "mostly_null") else c for c in LINE_TYPES) + " FROM d",
)
def fill_missing(spark, sf_dir):
    return op.fill_missing(lines(spark, sf_dir), "l_tax")


@query("c10_remaining_nulls", "SELECT count(*) - count(l_returnflag) AS remaining_nulls FROM {dirty_lines}")
def remaining_nulls(spark, sf_dir):
    return op.remaining_nulls(op.fill_missing(lines(spark, sf_dir), "l_returnflag"))


@query(
    "c10_most_frequent",
    union(
        f"(SELECT '{c}' AS \"column\", CAST({c} AS varchar) AS value FROM {{dirty_lines}} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        for c in LINE_TEXTS
    ),
)
def most_frequent(spark, sf_dir):
    from ..functions.session import local_table

    found = op.most_frequent(lines(spark, sf_dir), LINE_TEXTS)
    return local_table(spark, [(c, str(v)) for c, v in found.items()], "column string, value string")
