"""J1."""

from pyspark.sql import functions as F

from ..operators import joins as op
from .catalog import query, table, view

ON = "left_t.k IS NOT DISTINCT FROM right_t.k"


def _sql(how):
    return (
        "SELECT CAST(row_id AS double) AS row_id, CAST(coalesce(left_t.k, right_t.k) AS double) AS k, left_t.v AS v_x, right_t.v AS v_y, c_mktsegment "
        f"FROM {{left_t}} {how} JOIN {{right_t}} ON {ON}"
    )


def _register(how, sql_how):
    @query(f"j1_merge_{how}", _sql(sql_how))
    def run(spark, sf_dir):
        out = op.merge_tables(view(spark, sf_dir, "left_t"), view(spark, sf_dir, "right_t"), on="k", how=how)
        return out.select(F.col("row_id").cast("double").alias("row_id"), F.col("k").cast("double").alias("k"), "v_x", "v_y", "c_mktsegment")


for _how, _sql_how in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL OUTER")):
    _register(_how, _sql_how)


@query(
    "j1_merge_two_names",
    "SELECT o_orderkey, o_custkey, c_custkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey",
)
def two_names(spark, sf_dir):
    out = op.merge_tables(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), left_on="o_custkey", right_on="c_custkey"
    )
    return out.select("o_orderkey", "o_custkey", "c_custkey", "c_name", "o_totalprice")


@query(
    "j1_merge_common",
    "SELECT nation.n_nationkey AS nation, n_name, c_custkey, c_acctbal FROM nation JOIN customer ON n_nationkey = c_nationkey",
)
def common(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS nation", "n_name")
    customer = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_nationkey AS nation", "c_acctbal")
    return op.merge_tables(nation, customer)


@query(
    "j1_merge_shapes",
    f"""
SELECT 'left' AS stage, count(*) AS rows, 3 AS columns FROM {{left_t}}
UNION ALL SELECT 'right', count(*), 3 FROM {{right_t}}
UNION ALL SELECT 'merged', count(*), 5 FROM {{left_t}} JOIN {{right_t}} ON {ON}""",
)
def shapes(spark, sf_dir):
    left, right = view(spark, sf_dir, "left_t"), view(spark, sf_dir, "right_t")
    return op.merge_shapes(left, right, op.merge_tables(left, right, on="k"))
