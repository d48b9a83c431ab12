"""File streams in, file streams out.

Fitted parameters are plain values or small tables, so every ``apply_*`` function, ``filter_rows``,
``select_features``, ``datetime_parts``, ``score`` and the other stateless operators take a streaming
table as they take a batch one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.columns import col, nan_to_null
from ..functions.session import fresh_dir


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    files: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """New files of a folder as they come; ``files`` is a glob on their names. The schema is given."""
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return nan_to_null(reader.load(path))


def stream_duplicates_dropped(stream: DataFrame, time_column: str, delay: str, keys: list[str] | None = None) -> DataFrame:
    """Drop repeats that come within ``delay`` of each other; state older than that is let go."""
    marked = stream.withWatermark(time_column, delay)
    return marked.dropDuplicatesWithinWatermark(keys or [c for c in stream.columns if c != time_column])


def run_available(
    stream: DataFrame,
    apply: Callable[[DataFrame], DataFrame] | None = None,
    path: str | None = None,
    partition_by: list[str] | None = None,
) -> DataFrame:
    """Process all files there are, write parquet with exactly-once bookkeeping, and read it back."""
    spark = stream.sparkSession
    out = apply(stream) if apply else stream
    target = path or fresh_dir(spark, "stream-out")
    writer = out.writeStream.format("parquet").option("checkpointLocation", fresh_dir(spark, "stream-log"))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start(target)
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(target).select(*[col(c) for c in out.columns])
