"""Display text and type categories as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.sources.schema import is_native_geometry, quoted

MISSING = "—"

# Type words per category, and column names that hold geometry.
INT_TYPES = (
    "TINYINT", "SMALLINT", "INT", "INTEGER", "BIGINT", "HUGEINT",
    "INT2", "INT4", "INT8", "UINTEGER", "UBIGINT",
)
FLOAT_TYPES = ("FLOAT", "DOUBLE", "REAL")
DECIMAL_TYPES = ("DECIMAL", "NUMERIC")
STRING_TYPES = ("VARCHAR", "TEXT", "STRING", "CHAR")
BOOLEAN_TYPES = ("BOOLEAN", "BOOL")
NUMERIC_TYPES = (
    "TINYINT", "SMALLINT", "INT", "INTEGER", "BIGINT", "HUGEINT",
    "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT",
    "FLOAT", "DOUBLE", "REAL", "DECIMAL", "NUMERIC",
)
GEOMETRY_TYPES = ("BLOB", "BINARY", "GEOMETRY", "WKB_BLOB")
GEOMETRY_NAMES = ("geometry", "geom", "wkb_geometry", "wkt", "shape")


def type_base(type_text: Column) -> Column:
    """Upper-cased type word before any parameter list."""
    return F.upper(F.trim(F.regexp_extract(type_text, r"^([^(<]*)", 1)))


def type_category(type_text: Column) -> Column:
    """INT, FLT, DEC, STR, DATE, TIME, BOOL, else the first four letters."""
    base = type_base(type_text)
    return (
        F.when(base.isin(*INT_TYPES), "INT")
        .when(base.isin(*FLOAT_TYPES), "FLT")
        .when(base.isin(*DECIMAL_TYPES), "DEC")
        .when(base.isin(*STRING_TYPES), "STR")
        .when(base == "DATE", "DATE")
        .when(base.startswith("TIMESTAMP"), "TIME")
        .when(base.isin(*BOOLEAN_TYPES), "BOOL")
        .otherwise(F.substring(base, 1, 4))
    )


def is_numeric_type(type_text: Column) -> Column:
    return type_base(type_text).isin(*NUMERIC_TYPES)


def is_geometry_column(name: Column, type_text: Column) -> Column:
    """By type (binary or geometry) or by one of the known names."""
    base = type_base(type_text)
    return (
        base.isin(*GEOMETRY_TYPES)
        | base.startswith("GEOMETRY")
        | F.lower(name).isin(*GEOMETRY_NAMES)
    )


def fmt_bytes(size: Column) -> Column:
    """Byte count as B, KB, MB (one decimal) or GB (two decimals)."""
    kb, mb, gb = 1024, 1024**2, 1024**3
    return (
        F.when(size.isNull(), MISSING)
        .when(size < kb, F.format_string("%d B", size.cast("long")))
        .when(size < mb, F.format_string("%.1f KB", size / F.lit(float(kb))))
        .when(size < gb, F.format_string("%.1f MB", size / F.lit(float(mb))))
        .otherwise(F.format_string("%.2f GB", size / F.lit(float(gb))))
    )


def fmt_number(number: Column) -> Column:
    """Thousands-grouped text with at most three decimals; ties round away from 0."""
    return F.coalesce(F.call_function("format_number", F.round(number, 3), F.lit("#,##0.###")), F.lit(MISSING))


def plain_number(number: Column) -> Column:
    """A double as text without exponent or a trailing ``.0`` where it can be."""
    size = F.abs(number)
    readable = (number == 0) | ((size >= 1e-6) & (size < 1e21))
    return F.when(readable, F.call_function("format_number", number, F.lit("0.#################"))).otherwise(
        number.cast("string")
    )


def fmt_cell(value: Column, dtype: T.DataType, geometry: bool = False) -> Column:
    """Cell text by type; null becomes the empty string."""
    if isinstance(dtype, T.BinaryType) or is_native_geometry(dtype):
        text = F.when(value.isNotNull(), F.lit("[geometry]" if geometry else "[blob]"))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        text = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        text = F.to_json(value, {"ignoreNullFields": "false"})
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        # A float keeps its own short digits: widening it would show more.
        text = plain_number(value.cast("string").cast("double"))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def format_cells(df: DataFrame) -> DataFrame:
    """Every column as the text shown in a result table."""
    return df.select(
        [
            fmt_cell(
                F.col(quoted(f.name)),
                f.dataType,
                geometry=f.name.lower() in GEOMETRY_NAMES or is_native_geometry(f.dataType),
            ).alias(f.name)
            for f in df.schema.fields
        ]
    )


def parse_epsg(text: Column) -> Column:
    """EPSG number in ``26912``, ``EPSG:26912``; leading digits are enough."""
    digits = F.regexp_extract(text, r"(?i)^\s*(?:EPSG:\s*)?([-+]?\d+)", 1)
    code = digits.try_cast("bigint")
    return F.when((code > 0) & (code <= 999999), code.cast("int"))
