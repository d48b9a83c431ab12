"""R1-R5, J2."""

from ..operators import rows as op
from .catalog import query, table, view
from .profiling import FEATURES_OF_QUANTITY, bounds_sql

# Condition -> column, value, SQL test.
FILTERS = {
    "eq": ("l_returnflag", "A", "l_returnflag = 'A'"),
    "neq": ("l_returnflag", "A", "l_returnflag IS DISTINCT FROM 'A'"),
    "gt": ("l_quantity", 45.0, "l_quantity > 45"),
    "gte": ("l_quantity", 45.0, "l_quantity >= 45"),
    "lt": ("l_quantity", 5.0, "l_quantity < 5"),
    "lte": ("l_quantity", 5.0, "l_quantity <= 5"),
    "contains": ("l_returnflag", "^[AN] *$", "coalesce(regexp_matches(l_returnflag, '^[AN] *$'), false)"),
    "not_contains": ("l_returnflag", "^[AN] *$", "NOT coalesce(regexp_matches(l_returnflag, '^[AN] *$'), false)"),
    "isin": ("l_returnflag", ["A", "R"], "l_returnflag IN ('A', 'R')"),
    "notin": ("l_returnflag", ["A", "R"], "NOT coalesce(l_returnflag IN ('A', 'R'), false)"),
    "isnull": ("l_quantity", None, "l_quantity IS NULL"),
    "notnull": ("mostly_null", None, "mostly_null IS NOT NULL"),
}


def _register(kind, column, value, test):
    @query(f"r1_filter_{kind}", f"SELECT l_orderkey, l_partkey, l_quantity, l_returnflag, mostly_null FROM {{dirty_lines}} WHERE {test}")
    def run(spark, sf_dir):
        kept = op.filter_rows(view(spark, sf_dir, "dirty_lines"), column, kind, value)
        return kept.select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "mostly_null")


for _kind, _spec in FILTERS.items():
    _register(_kind, *_spec)


@query("r2_drop_missing_target", "SELECT * FROM {dirty_lines} WHERE l_returnflag IS NOT NULL")
def drop_missing_target(spark, sf_dir):
    return op.drop_missing_target(view(spark, sf_dir, "dirty_lines"), "l_returnflag")


COPIED = "SELECT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax FROM {dirty_lines}"


@query("r3_drop_duplicates", f"SELECT DISTINCT * FROM ({COPIED})")
def drop_duplicates(spark, sf_dir):
    lines = view(spark, sf_dir, "dirty_lines")
    return op.drop_duplicates(lines.select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"))


@query(
    "r4_remove_outliers",
    f"WITH b AS ({bounds_sql(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount'], '{dirty_lines}')}) "
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM {dirty_lines}, b WHERE "
    + " AND ".join(f"{c} BETWEEN lo_{c} AND hi_{c}" for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]),
)
def remove_outliers(spark, sf_dir):
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return op.remove_outliers(view(spark, sf_dir, "dirty_lines").select(*names), "l_tax")


@query(
    "r4_remove_outliers_gaps",
    f"WITH b AS ({bounds_sql(FEATURES_OF_QUANTITY, '{dirty_lines}')}) SELECT l_orderkey, l_partkey, mostly_null FROM {{dirty_lines}}, b WHERE "
    + " AND ".join(f"{c} BETWEEN lo_{c} AND hi_{c}" for c in FEATURES_OF_QUANTITY),
)
def remove_outliers_gaps(spark, sf_dir):
    kept = op.remove_outliers(view(spark, sf_dir, "dirty_lines"), "l_quantity")
    return kept.select("l_orderkey", "l_partkey", "mostly_null")


SAMPLED = "SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', 42, o_orderkey))) AS rn FROM orders"


@query("r5_subsample", f"SELECT * EXCLUDE (rn) FROM ({SAMPLED}) WHERE rn <= 1000")
def subsample(spark, sf_dir):
    return op.subsample(table(spark, sf_dir, "orders"), 1000, ["o_orderkey"])


@query(
    "r5_subsample_repeated_rows",
    "SELECT l_returnflag, l_quantity FROM lineitem ORDER BY md5(concat_ws('|', 42, l_returnflag, l_quantity)) LIMIT 1000",
)
def subsample_repeated_rows(spark, sf_dir):
    return op.subsample(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), 1000)


@query(
    "r5_subsample_stratified",
    """
WITH s AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat_ws('|', 42, o_orderkey))) AS rn,
  count(*) OVER (PARTITION BY o_orderpriority) AS n, count(*) OVER () AS total FROM orders)
SELECT o_orderkey, o_orderpriority, o_totalprice FROM s WHERE rn <= round_even(1000.0 * n / total, 0)""",
)
def subsample_stratified(spark, sf_dir):
    kept = op.subsample(table(spark, sf_dir, "orders"), 1000, ["o_orderkey"], stratify="o_orderpriority")
    return kept.select("o_orderkey", "o_orderpriority", "o_totalprice")


@query(
    "r5_subsample_related",
    f"""
WITH s AS (SELECT o_custkey FROM ({SAMPLED}) WHERE rn <= 500)
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM s)""",
)
def subsample_related(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    _, related = op.subsample_related(
        table(spark, sf_dir, "orders"), {"customer": customer}, "o_custkey", 500, keys=["o_orderkey"]
    )
    return related["customer"].select("o_custkey", "c_name").withColumnRenamed("o_custkey", "c_custkey")


@query(
    "j2_semi_filter",
    "SELECT row_id, CAST(k AS double) AS k FROM {left_t} WHERE EXISTS (SELECT 1 FROM {right_t} WHERE right_t.k IS NOT DISTINCT FROM left_t.k)",
)
def semi_filter(spark, sf_dir):
    kept = op.semi_filter(view(spark, sf_dir, "left_t"), view(spark, sf_dir, "right_t"), "k")
    return kept.select("row_id", kept.k.cast("double").alias("k"))
