"""Column selection, quoting and validation against a DataFrame's schema (no jobs)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its exact name, also when it holds dots, spaces or backticks."""
    return F.col(quote(name))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, exclude: Iterable[str | None] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in skip]


def categorical_columns(df: DataFrame, exclude: Iterable[str | None] = ()) -> list[str]:
    """Everything that is not a number; booleans and timestamps count as categories."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC_TYPES) and f.name not in skip]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"The table lacks {missing}; it has {df.columns}")


def require_numeric(df: DataFrame, name: str) -> None:
    require_columns(df, [name])
    if not is_numeric(df, name):
        raise ValueError(f"{name!r} must hold numbers, not {df.schema[name].dataType.simpleString()}")


def as_double(name: str) -> Column:
    return col(name).cast("double")


# A failing try_cast of a text costs an exception, so only texts that look right are tried.
NUMBER_FIRST = list("0123456789+-.iInN")
NUMBER_LAST = list("0123456789.fFyYnN")


def text_to_whole(text: Column, to: str = "bigint") -> Column:
    """The whole number a text spells, else NULL."""
    value = F.trim(text)
    return F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast(to))


def text_to_double(text: Column) -> Column:
    """The number a text spells, else NULL; Java's own spellings (1f, 0x1p3) are no numbers."""
    value = F.trim(text)
    last = F.right(value, F.lit(1))
    likely = F.substring(value, 1, 1).isin(NUMBER_FIRST) & last.isin(NUMBER_LAST)
    spelled = value.contains("x") | (F.lower(last) == "f") & ~F.lower(value).endswith("inf")
    return F.when(likely & ~spelled, value.try_cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float column, so that NULL is the only missing value."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(n)), col(n)).alias(n) if n in floats else col(n)
            for n in df.columns
        ]
    )


def chunks(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]
