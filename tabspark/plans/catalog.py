"""The registry of queries and the input views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]

# Views over the given tables, in SQL that Spark and DuckDB read alike. The tables hold no gaps, odd
# values or padding, so these are put in by arithmetic on the values; all rows stay.
VIEWS = {
    "dirty_lines": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN (l_orderkey + l_partkey) % 97 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS l_extendedprice,
  l_discount, l_tax,
  CASE WHEN l_partkey % 13 = 0 THEN NULL
       WHEN l_partkey % 5 = 0 THEN concat('  ', l_returnflag, ' ') ELSE l_returnflag END AS l_returnflag,
  l_linestatus, l_shipdate,
  CASE WHEN l_suppkey % 10 < 7 THEN NULL ELSE CAST(l_suppkey AS double) END AS mostly_null,
  CAST(1 AS double) AS const_col,
  CASE WHEN (l_orderkey + l_partkey) % 97 = 0 THEN l_extendedprice * 40 ELSE l_extendedprice * 2 END AS dup_price,
  concat('L', CAST(l_orderkey AS string), '-', CAST(l_partkey AS string)) AS row_tag
FROM {lineitem}""",
    "wide_lines": "SELECT "
    + ", ".join(
        f"CASE WHEN (l_orderkey + {i} * l_linenumber) % {5 + i} <> 0 THEN l_quantity * {i % 7} + l_extendedprice * {i % 4} / 1000 "
        f"+ l_discount * {i % 11} * 100 + l_tax * {i + 1} * 10 END AS x{i}"
        for i in range(60)
    )
    + " FROM {lineitem}",
    "order_features": """
SELECT o_orderkey, o_orderstatus AS label,
  CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS y_bin,
  o_totalprice AS y_reg, o_orderdate, o_orderpriority,
  c_acctbal, c_mktsegment, c_nationkey,
  CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END AS y_rare
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "scored": """
SELECT event_id, event_type,
  CASE WHEN value > 20 THEN 1 ELSE 0 END AS label,
  CASE WHEN (event_id * 7919) % 100 < 70 THEN CASE WHEN value > 20 THEN 1 ELSE 0 END ELSE 0 END AS prediction,
  CAST((event_id * 7919) % 1000 AS double) / 1000 * 0.6 + CASE WHEN value > 20 THEN 0.3 ELSE 0.0 END AS probability,
  value AS y_true, CAST((event_id * 7919) % 1000 AS double) / 20 AS y_pred
FROM {events}""",
    "event_times": """
SELECT event_id, user_id, event_type, value,
  CASE WHEN event_id % 17 = 0 THEN 'not a date' WHEN event_id % 19 = 0 THEN NULL
       ELSE CAST(date_trunc('second', ts) AS string) END AS ts_text
FROM {events}""",
    "left_t": """
SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS k, o_totalprice AS v
FROM {orders}""",
    "right_t": """
SELECT CASE WHEN c_custkey % 500 = 0 THEN NULL ELSE c_custkey + 100 END AS k, c_acctbal AS v, c_mktsegment
FROM {customer}""",
    "numeric_orders": """
SELECT y_bin, y_rare, y_reg, c_acctbal, c_nationkey,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE c_acctbal * 2 + y_bin * 500 END AS lifted,
  CAST(extract(month FROM o_orderdate) AS double) AS order_month,
  CAST(1 AS double) AS const_col
FROM {order_features}""",
    # signal separates y_bin and hint follows y_reg, both with noise.
    "model_orders": """
SELECT o_orderkey, label, y_bin, y_rare, y_reg, c_acctbal, c_nationkey,
  CAST(extract(month FROM o_orderdate) AS double) AS order_month,
  c_acctbal * 0.1 + y_bin * 400 AS signal, y_reg * 0.01 + c_acctbal * 0.3 AS hint
FROM {order_features}""",
}

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and its SQL twin; views are named in braces, in both."""

    def add(run: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"Query {name} is registered twice")
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = resolve_sql(sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over them."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    inputs = {n: view(spark, sf_dir, n) for n in _used(VIEWS[name])}
    return spark.sql(VIEWS[name], **inputs)


def _used(sql: str) -> list[str]:
    return [n for n in [*TABLES, *VIEWS] if "{" + n + "}" in sql]


def resolve_sql(sql: str) -> str:
    """Replace views in braces by subqueries over the given tables."""
    while names := _used(sql):
        for n in names:
            sql = sql.replace("{" + n + "}", n if n in TABLES else f"({VIEWS[n]}) AS {n}")
    return sql


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
