"""Shared storage and size-checked small sides of joins."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .columns import col

SMALL_SIDE_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, in the temporary space of
    the one machine it runs on. A cluster session without it is refused.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="tabspark-")
    sc.setCheckpointDir("file://" + folder)
    return "file://" + folder


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used; nothing is created yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there (survives lost executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    For a prepared table that several fits scan: each of them then reads only the columns it needs
    instead of repeating the joins and aggregates before, and nothing is lost with an executor.
    """
    path = fresh_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A small table held by the plan itself, so that Catalyst knows its size."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrow = to_arrow_schema(fields)
    data = pa.table([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(data, schema=fields)


def small_side(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Run ``df`` and hold the result in the plan if it is small, so that joins with it need no shuffle.

    Rows beyond ``max_rows`` are never fetched: such a table is returned as it is and joins by
    shuffle, where adaptive execution splits skewed partitions.
    """
    found = df.limit(max_rows + 1).toArrow()
    return df if found.num_rows > max_rows else df.sparkSession.createDataFrame(found, schema=df.schema)


def groups_fit_broadcast(df: DataFrame, key: str, n_columns: int, max_bytes: int | None = None) -> bool:
    """Whether a table with one row per value of ``key`` and ``n_columns`` numbers can be broadcast.

    The bound comes from one narrow pass: distinct keys (sketch, with a margin) times the widest key
    plus the fixed-width columns.
    """
    text = col(key).cast("string")
    n_keys, width = df.agg(F.approx_count_distinct(col(key)), F.max(F.octet_length(text))).first()
    return 1.25 * n_keys * ((width or 0) + 16 * n_columns) <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def join_groups(df: DataFrame, key: str, groups: DataFrame, group: str, size: str) -> DataFrame:
    """Left join to a written table of one row per non-null ``group`` and its row count ``size``.

    Adaptive execution does not split a partition where the next step needs the same partitioning, so
    frequent groups go another way: those of more than one in ``HOT_SHARE`` rows are fewer than
    ``HOT_SHARE``, are held in the plan and meet their rows wherever those lie. Any other group is a
    sliver of the table and joins by shuffle. Rows without a group meet nothing.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = col(size) * HOT_SHARE > total
    hot = small_side(groups.where(is_hot), HOT_SHARE)
    on = col(key) == col(group)
    grouped = df.where(col(key).isNotNull())
    others = grouped.join(hot.select(group), on, "left_anti").join(groups.where(~is_hot), on, "left")
    met = grouped.join(hot, on).unionByName(others)
    return met.unionByName(df.where(col(key).isNull()), allowMissingColumns=True)
