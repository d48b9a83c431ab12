"""S1-S3, S6, S7 on files that Spark writes from the given tables."""

from pyspark.sql import functions as F

from ..functions.session import fresh_dir
from ..sources import (
    concat_tables,
    load_table,
    read_registry,
    register_version,
    rows_per_source,
    save_table,
    validate_source,
)
from ..sources.tables import NA_TOKENS
from .catalog import query, table, view

CUSTOMER_AS_PARTY = "SELECT c_custkey AS party_key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer"
SUPPLIER_AS_PARTY = "SELECT s_suppkey AS party_key, s_name AS name, s_nationkey AS nation, s_acctbal AS balance, s_nationkey * 1.5 AS factor FROM supplier"


def _as_csv(df, label):
    path = fresh_dir(df.sparkSession, label) + ".csv"
    save_table(df, path)
    return path


def _parties(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS party_key", "c_name AS name", "c_nationkey AS nation", "c_acctbal AS balance", "c_mktsegment AS segment"
    )
    supplier = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS party_key", "s_name AS name", "s_nationkey AS nation", "s_acctbal AS balance", "s_nationkey * 1.5D AS factor"
    )
    return [_as_csv(customer, "customer"), _as_csv(supplier, "supplier")]


@query("s1_load_csv", "SELECT * FROM customer")
def load_csv(spark, sf_dir):
    return load_table(spark, _as_csv(table(spark, sf_dir, "customer"), "customer"))


@query(
    "s1_load_csv_missing",
    "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, mostly_null, l_linestatus FROM {dirty_lines}",
)
def load_csv_missing(spark, sf_dir):
    lines = view(spark, sf_dir, "dirty_lines").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "mostly_null", "l_linestatus"
    )
    texts = lines.select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.coalesce(F.col("l_quantity").cast("string"), F.lit("NA")).alias("l_quantity"),
        F.coalesce(F.col("mostly_null").cast("string"), F.lit("nan")).alias("mostly_null"),
        "l_linestatus",
    )
    return load_table(spark, _as_csv(texts, "lines"))


# Texts as a CSV gives them back: those that mean "missing" are NULL.
DOCUMENTS_BACK = f"""
SELECT doc_id, CASE WHEN text NOT IN ({", ".join(f"'{t}'" for t in NA_TOKENS)}) THEN text END AS text, lang, source, n_chars
FROM documents"""


@query(
    "s1_load_csv_multiline",
    """
SELECT doc_id, concat('"', source, '", ', lang, chr(10), text, chr(10), '"') AS quoted, n_chars
FROM documents""",
)
def load_csv_multiline(spark, sf_dir):
    quoted = F.concat(F.lit('"'), "source", F.lit('", '), "lang", F.lit("\n"), "text", F.lit('\n"'))
    texts = table(spark, sf_dir, "documents").select("doc_id", quoted.alias("quoted"), "n_chars")
    return load_table(spark, _as_csv(texts, "quoted"))


@query("s3_round_trip_text", DOCUMENTS_BACK)
def round_trip_text(spark, sf_dir):
    return load_table(spark, _as_csv(table(spark, sf_dir, "documents"), "documents"))


@query(
    "s7_corrupt_rows",
    """
SELECT CASE WHEN count(*) FILTER (s_nationkey < 5) = 0 THEN 'valid' ELSE 'corrupt rows' END AS status, count(*) AS row_count,
  count(*) FILTER (s_nationkey < 5) AS corrupt_rows, 0 AS missing_cells, 3 AS column_count,
  's_suppkey,s_name,s_nationkey' AS columns
FROM supplier""",
)
def corrupt_rows(spark, sf_dir):
    """Names of the first nations' suppliers hold a bare comma, and so one cell too many."""
    name = F.when(F.col("s_nationkey") < 5, F.concat("s_name", F.lit(",EXTRA"))).otherwise(F.col("s_name"))
    path = fresh_dir(spark, "corrupt") + ".csv"
    damaged = table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("s_name"), "s_nationkey")
    damaged.write.options(header=True, quote="").csv(path)
    return validate_source(spark, path)


@query("s1_load_parquet", "SELECT l_orderkey, l_quantity, l_extendedprice, l_shipdate FROM lineitem")
def load_parquet(spark, sf_dir):
    return load_table(spark, f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )


@query("s2_concat_tables", f"({CUSTOMER_AS_PARTY}) UNION ALL BY NAME ({SUPPLIER_AS_PARTY})")
def concat(spark, sf_dir):
    return concat_tables(spark, _parties(spark, sf_dir))


@query("s2_concat_separator", f"({CUSTOMER_AS_PARTY}) UNION ALL BY NAME ({SUPPLIER_AS_PARTY})")
def concat_separator(spark, sf_dir):
    """The same files with semicolons between cells."""
    paths = []
    for path in _parties(spark, sf_dir):
        paths.append(fresh_dir(spark, "semicolons") + ".csv")
        load_table(spark, path).write.options(header=True, sep=";", escape='"').csv(paths[-1])
    return concat_tables(spark, paths, sep=";")


@query(
    "s2_rows_per_file",
    "SELECT 'customer' AS source, count(*) AS row_count FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier",
)
def rows_per_file(spark, sf_dir):
    paths = _parties(spark, sf_dir)
    stacked = concat_tables(spark, paths, source_column="source_file")
    counted = rows_per_source(stacked, "source_file")
    return counted.select(F.regexp_extract("source", r"([a-z]+)-[0-9a-f]+\.csv$", 1).alias("source"), "row_count")


@query("s3_save_table", "SELECT * FROM orders")
def save(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    path = fresh_dir(spark, "orders")
    save_table(orders, path, fmt="parquet", partition_by=["o_orderstatus"])
    return load_table(spark, path).select(*orders.columns)


@query("s3_save_csv", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def save_csv(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return load_table(spark, _as_csv(part, "part"), schema=part.schema)


@query(
    "s6_register_version",
    """
SELECT 'orders' AS dataset, 1 AS version_number, count(*) AS row_count, 6 AS column_count,
  'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns FROM orders
UNION ALL
SELECT 'orders', 2, count(*), 2, 'o_orderkey,o_totalprice' FROM orders
UNION ALL
SELECT 'copy', 1, count(*), 2, 'o_orderkey,o_totalprice' FROM orders""",
)
def versions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    path = fresh_dir(spark, "versions")
    narrow = orders.select("o_orderkey", "o_totalprice")
    register_version(orders, "orders", path)
    register_version(narrow, "orders", path)
    register_version(orders.repartition(7, "o_custkey"), "orders", path)
    register_version(narrow, "copy", path)
    return read_registry(spark, path).drop("fingerprint")


@query(
    "s7_validate_source",
    """
SELECT 'valid' AS status, count(*) AS row_count, 0 AS corrupt_rows, 0 AS missing_cells, 4 AS column_count,
  's_suppkey,s_name,s_nationkey,s_acctbal' AS columns FROM supplier""",
)
def validate(spark, sf_dir):
    return validate_source(spark, _as_csv(table(spark, sf_dir, "supplier"), "supplier"))
