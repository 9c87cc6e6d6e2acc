"""Schema listings and the column classes other operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame
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

LISTING_SCHEMA = "pos int, name string, type string, nullable boolean"


def quoted(name: str) -> str:
    """Back-tick a column name so dots and quotes in it are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def dedupe_names(names: list[str]) -> list[str]:
    """Give repeated names the suffixes ``_1``, ``_2``, ... in order.

    Names that differ by case alone repeat each other: queries ignore case.
    """
    taken = {name.lower() for name in names}
    seen: dict[str, int] = {}
    out = []
    for name in names:
        key = name.lower()
        if key not in seen:
            seen[key] = 0
            out.append(name)
            continue
        candidate = name
        while candidate.lower() in taken:
            seen[key] += 1
            candidate = f"{name}_{seen[key]}"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def describe(df: DataFrame) -> DataFrame:
    """One row per column: position, name, Spark type, nullability."""
    names = dedupe_names(df.columns)
    rows = [
        (i, name, field.dataType.simpleString(), field.nullable)
        for i, (name, field) in enumerate(zip(names, df.schema.fields))
    ]
    return df.sparkSession.createDataFrame(rows, LISTING_SCHEMA)


def is_native_geometry(dtype: T.DataType) -> bool:
    return dtype.typeName().startswith(("geometry", "geography"))


def is_opaque(dtype: T.DataType) -> bool:
    """Binary or native geometry: left out of default projections."""
    return isinstance(dtype, T.BinaryType) or is_native_geometry(dtype)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def field_of(df: DataFrame, name: str) -> T.StructField:
    for field in df.schema.fields:
        if field.name == name:
            return field
    raise ValueError(f"no column named {name!r}; columns are {df.columns}")
