"""A registry of dataset versions, told apart by their content."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..functions.session import local_table

REGISTRY_SCHEMA = (
    "dataset string, fingerprint string, version_number long, row_count long, column_count long, columns string"
)


def content_fingerprint(df: DataFrame) -> DataFrame:
    """One row ``row_count, column_count, columns, fingerprint``; the order of rows does not matter.

    One aggregate over two hashes per row, of all cells and of which of them are NULL; their sums tell
    copies apart. Column names are part of the print.
    """
    cells = [x for c in df.columns for x in (col(c).isNull(), col(c))]
    hashes = [F.xxhash64(F.lit(salt), *cells).alias(name) for salt, name in ((1, "h"), (2, "g"))]
    summed = df.select(*hashes).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total"),
        F.coalesce(F.sum(F.col("g").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("mix"),
    )
    names = ",".join(df.columns)
    return summed.select(
        "row_count",
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        F.lit(names).alias("columns"),
        F.sha2(F.concat_ws("|", F.lit(names), F.col("row_count").cast("string"), "total", "mix"), 256).alias("fingerprint"),
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """All registered versions. Each is a file of its own, so a listing sees whole versions only."""
    try:
        return spark.read.schema(REGISTRY_SCHEMA).option("recursiveFileLookup", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return local_table(spark, [], REGISTRY_SCHEMA)


def _commit(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Put a whole file in place unless one of that name is there already: whether this writer did.

    The file is written under a hidden name first. A local folder then links it, which fails if the name is
    taken; other file systems must rename without overwriting, in one step, as HDFS does.
    """
    sc = spark.sparkContext
    jvm = sc._jvm
    final, hidden = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}") for n in (name, f"_{uuid.uuid4().hex}"))
    fs = final.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(final.getParent())
    if fs.getUri().getScheme() == "file":
        source, goal = hidden.toUri().getPath(), final.toUri().getPath()
        with open(source, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(source, goal)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(source)
    out = fs.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(final) and fs.rename(hidden, final):
        return True
    fs.delete(hidden, False)
    return False


def register_version(df: DataFrame, dataset: str, registry_path: str) -> DataFrame:
    """Register ``df`` as the next version of ``dataset`` unless its content is already registered.

    Returns the version's registry row. Any number of writers may register at once: a version is a file named by
    its dataset and number that only one of them can put in place. The others look again, find the content they
    meant to register or take the next number.
    """
    spark = df.sparkSession
    seen = content_fingerprint(df).first()
    folder = f"{registry_path.rstrip('/')}/{hashlib.sha256(dataset.encode()).hexdigest()}"
    while True:
        known = read_registry(spark, registry_path).where(F.col("dataset") == dataset)
        same = known.where(F.col("fingerprint") == seen["fingerprint"])
        if not same.isEmpty():
            return same
        number = (known.agg(F.max("version_number")).first()[0] or 0) + 1
        row = {"dataset": dataset, "version_number": number, **seen.asDict()}
        _commit(spark, folder, f"{number:020d}.json", json.dumps(row))
