"""CSV and parquet tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NUMERIC_TYPES, col, nan_to_null, text_to_double, text_to_whole
from ..functions.stats import long_report
from .records import ENCODINGS, csv_records

# The texts a CSV cell may hold for "missing" (the reader's documented defaults).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

CORRUPT = "_corrupt_record"


def load_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
    line_breaks: bool = True,
) -> DataFrame:
    """Read one table and make NULL its only missing value.

    CSV needs a header row. One aggregate over the texts decides per column between bigint, double,
    boolean and string, after missing-value texts have become NULL (a numeric column with ``NA`` cells
    stays numeric); with ``schema`` the types are given and the aggregate only counts unreadable rows.
    A row with fewer cells than the header is filled up with NULL; rows with more cells, or with a
    quote that is never closed, are an error that tells how many there are.

    Quoted cells may hold line breaks. A file in UTF-8 or ISO-8859-1 is still read by many tasks
    (``sources.records``); in any other encoding it is one task. ``line_breaks=False`` says that no cell
    holds one: a line that opens a quote without closing it is then an error, and files are read less often.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    if fmt != "csv":
        try:
            return nan_to_null(spark.read.format(fmt).load(path))
        except AnalysisException as e:
            raise _not_readable(path, e) from e
    if not line_breaks:
        _require_closed_quotes(spark, path, encoding)
    raw = _read_texts(spark, path, sep, encoding, line_breaks)
    *names, record = raw.columns
    texts = raw.select(*[_present(c).alias(c) for c in names])
    if schema is None:
        kinds = [F.bit_or(_kind(_present(c))) for c in names]
        unreadable, *seen = raw.agg(F.count_if(_unreadable(record, sep, len(names))), *kinds).first()
        _refuse(path, unreadable, len(names))
        return _typed(texts, _narrowest(names, seen))
    # Spark wants a cell beside the record.
    unreadable, _ = raw.agg(F.count_if(_unreadable(record, sep, len(names))), F.count(col(names[0]))).first()
    _refuse(path, unreadable, len(names))
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    missing = [f.name for f in wanted if f.name not in texts.columns]
    if missing:
        raise ValueError(f"The schema asks for {missing}, which the header of {path} lacks: {texts.columns}")
    return _typed(texts, {f.name: f.dataType.simpleString() for f in wanted})


def _not_readable(path: str, error: Exception) -> Exception:
    if "PATH_NOT_FOUND" in str(error):
        return FileNotFoundError(f"There is no table at {path}")
    return ValueError(f"Spark cannot read {path}: {error}")


def _read_texts(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", line_breaks: bool = True) -> DataFrame:
    """All cells as text, and last the whole record where it has another number of cells than the header."""
    options = {"header": True, "multiLine": line_breaks, "escape": '"', "sep": sep, "encoding": encoding}
    try:
        header = spark.read.options(**options).csv(path).columns
    except AnalysisException as e:
        raise _not_readable(path, e) from e
    if not header:
        raise ValueError(f"{path} has not even a header row")
    record = CORRUPT
    while record in header:
        record = "_" + record
    declared = T.StructType([T.StructField(c, T.StringType()) for c in [*header, record]])
    if line_breaks and encoding.upper() in ENCODINGS:
        shape = ", ".join(f"`{c.replace('`', '``')}` string" for c in declared.names)
        as_cells = {**{k: str(v) for k, v in options.items()}, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": record}
        cells = F.from_csv("record", shape, as_cells).alias("cells")
        return csv_records(spark, path, sep, encoding).select(cells).select("cells.*")
    # Without pruning every cell is parsed, whichever columns are asked for.
    reader = spark.read.schema(declared).options(**options, columnPruning=False, mode="PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", record).csv(path)


def _unreadable(record: str, sep: str, n_cells: int) -> Column:
    """Whether a record of the wrong length has too many cells or an open quote; a short one is neither."""
    bare = F.regexp_replace(col(record), '"[^"]*"', "")
    cells = F.size(F.split(bare, re.escape(sep), -1))
    return F.coalesce((cells > n_cells) | bare.contains('"'), F.lit(False))


def _refuse(path: str, unreadable: int, n_cells: int) -> None:
    if unreadable:
        raise ValueError(f"{unreadable} rows of {path} do not fit its {n_cells} columns: mend them, or name the right sep")


def _require_closed_quotes(spark: SparkSession, path: str, encoding: str) -> None:
    try:
        lines = spark.read.option("encoding", encoding).text(path)
    except AnalysisException as e:
        raise _not_readable(path, e) from e
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    open_lines = lines.where(quotes % 2 == 1).count()
    if open_lines:
        raise ValueError(f"{open_lines} lines of {path} end inside a quote: load it with line_breaks=True")


def _present_test(name: str) -> Column:
    return col(name).isNotNull() & ~col(name).isin(NA_TOKENS)


def _present(name: str) -> Column:
    return F.when(_present_test(name), col(name))


def _kind(text: Column) -> Column:
    """One bit for the narrowest kind a cell fits: 1 whole number, 2 number, 4 truth value, 8 text."""
    return (
        F.when(text.isNull(), None)
        .when(text_to_whole(text).isNotNull(), 1)
        .when(text_to_double(text).isNotNull(), 2)
        .when(F.trim(text).isin("True", "False", "TRUE", "FALSE", "true", "false"), 4)
        .otherwise(8)
    )


def _narrowest(names: list[str], seen: list[int | None]) -> dict[str, str]:
    """The narrowest type all cells of a column fit."""
    # No value at all: a numeric column of nothing but missing values.
    types = {None: "double", 1: "bigint", 2: "double", 3: "double", 4: "boolean"}
    return {c: types.get(kinds, "string") for c, kinds in zip(names, seen)}


def _typed(texts: DataFrame, types: dict[str, str]) -> DataFrame:
    def value(c: str, to: str) -> Column:
        if to == "string":
            return col(c)
        if to in ("tinyint", "smallint", "int", "bigint"):
            return text_to_whole(col(c), to)
        if to in ("float", "double"):
            return text_to_double(col(c)).cast(to)
        return F.trim(col(c)).try_cast(to)

    return nan_to_null(texts.select(*[value(c, t).alias(c) for c, t in types.items()]))


def _common_type(types: list[T.DataType]) -> T.DataType:
    kinds = {t.simpleString() for t in types}
    if len(kinds) == 1:
        return types[0]
    if all(isinstance(t, NUMERIC_TYPES) for t in types):
        whole = all(isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for t in types)
        return T.LongType() if whole else T.DoubleType()
    if all(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in types):
        return T.TimestampNTZType()
    return T.StringType()


def stack_tables(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables, columns united by name, absent ones NULL, differing types widened."""
    if not tables:
        raise ValueError("There is no table to stack")
    types: dict[str, list[T.DataType]] = {}
    for df in tables:
        for f in df.schema.fields:
            types.setdefault(f.name, []).append(f.dataType)
    common = {c: _common_type(t) for c, t in types.items()}
    widened = [df.select(*[col(c).cast(common[c]).alias(c) for c in df.columns]) for df in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), widened)


def concat_tables(
    spark: SparkSession,
    paths: list[str],
    fmt: str | None = None,
    schemas: list[T.StructType | str] | None = None,
    source_column: str | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
    line_breaks: bool = True,
) -> DataFrame:
    """Stack many files, each read as ``load_table`` reads it. ``source_column`` adds the path each row came from."""
    tables = []
    for i, p in enumerate(paths):
        df = load_table(spark, p, fmt, schemas[i] if schemas else None, sep, encoding, line_breaks)
        tables.append(df.withColumn(source_column, F.lit(p)) if source_column else df)
    return stack_tables(tables)


def rows_per_source(df: DataFrame, source_column: str) -> DataFrame:
    return df.groupBy(col(source_column).alias("source")).agg(F.count(F.lit(1)).alias("row_count"))


def save_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Write a folder of part files, one per task; nothing is pulled together into one file."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        # Blanks at the ends of a text are part of it.
        kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(header=True, escape='"', **kept).csv(path)
    else:
        writer.format(fmt).save(path)


def validate_source(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Check that a CSV exists and parses: ``status, row_count, corrupt_rows, missing_cells, column_count, columns``.

    Corrupt are the rows that ``load_table`` refuses: with too many cells, or an open quote. Of short rows,
    which it fills up with NULL, the absent cells count as missing.
    """
    if not path:
        raise ValueError("Name the CSV file or folder to check")
    if not path.rstrip("/").endswith(".csv"):
        raise ValueError(f"Only a path that ends in .csv can be checked, not {path}")
    checked = _read_texts(spark, path, sep, encoding)
    *header, record = checked.columns
    refused = _unreadable(record, sep, len(header))
    gaps = sum((F.count_if(~_present_test(c)) for c in header[1:]), F.count_if(~_present_test(header[0])))
    counted = checked.agg(F.count(F.lit(1)).alias("rows"), F.count_if(refused).alias("corrupt"), gaps.alias("gaps"))
    return long_report(
        counted,
        [
            {
                "status": F.when(F.col("corrupt") == 0, "valid").otherwise("corrupt rows"),
                "row_count": F.col("rows"),
                "corrupt_rows": F.col("corrupt"),
                "missing_cells": F.col("gaps"),
                "column_count": F.lit(len(header)).cast("long"),
                "columns": F.lit(",".join(header)),
            }
        ],
    )
