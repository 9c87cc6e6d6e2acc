"""Column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions.format import GEOMETRY_NAMES, fmt_number
from lakelens.operators.rows import sample_prefix
from lakelens.session import stage
from lakelens.sources.schema import field_of, is_numeric, is_opaque, quoted


def holds_geometry(field: T.StructField) -> bool:
    """Binary, native geometry, or a name geometry columns go by."""
    return is_opaque(field.dataType) or field.name.lower() in GEOMETRY_NAMES


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.VariantType)


def null_percentage(nulls: Column, total: Column) -> Column:
    """Share of nulls in percent with one decimal; 0 without rows."""
    return F.when(total > 0, F.round(F.lit(100.0) * nulls / total, 1)).otherwise(F.lit(0.0))


def _shown(value: Column, dtype: T.DataType) -> Column:
    return fmt_number(value) if is_numeric(dtype) else value.cast("string")


def _approximate(df: DataFrame, names: list[str]) -> DataFrame:
    """All columns in one aggregate and one pass; distincts are estimates."""
    aggs, rows = [F.count(F.lit(1)).alias("total")], []
    nothing = F.lit(None).cast("string")
    for i, name in enumerate(names):
        field, col = field_of(df, name), F.col(quoted(name))
        aggs.append(F.count_if(col.isNull()).alias(f"nulls{i}"))
        distinct, lo, hi = F.lit(0).cast("bigint"), nothing, nothing
        if not holds_geometry(field) and not _has_map(field.dataType):
            aggs += [F.approx_count_distinct(col, 0.02).alias(f"distinct{i}"),
                     F.min(col).alias(f"lo{i}"), F.max(col).alias(f"hi{i}")]
            distinct = F.col(f"distinct{i}")
            lo, hi = (_shown(F.col(f"{end}{i}"), field.dataType) for end in ("lo", "hi"))
        rows.append(F.struct(
            F.lit(name).alias("name"), F.col(f"nulls{i}").alias("null_count"),
            distinct.alias("distinct_count"), F.col("total").alias("total"),
            lo.alias("min_val"), hi.alias("max_val"),
            null_percentage(F.col(f"nulls{i}"), F.col("total")).alias("null_pct"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def _column_profile(df: DataFrame, name: str) -> DataFrame:
    """One row for one column, exact.

    Grouping by the value first collapses repeats map-side and spreads distinct
    values over the tasks; every other figure follows from the groups. One
    aggregate with a distinct count per column would copy each row once per
    column instead.
    """
    field = field_of(df, name)
    col = F.col(quoted(name))
    is_null = col.isNull()
    if holds_geometry(field) or _has_map(field.dataType):
        grouped = df.agg(
            F.count_if(is_null).alias("null_count"), F.count(F.lit(1)).alias("total"),
        ).withColumns({"distinct_count": F.lit(0).cast("bigint"), "lo": F.lit(None).cast("string"),
                       "hi": F.lit(None).cast("string")})
    else:
        grouped = (
            df.groupBy(col.alias("v")).agg(F.count(F.lit(1)).alias("n"))
            .agg(
                F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0))
                .alias("null_count"),
                F.count("v").alias("distinct_count"),
                F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
                F.min("v").alias("lo"), F.max("v").alias("hi"),
            )
        )
    lo, hi = F.col("lo"), F.col("hi")
    if not holds_geometry(field) and not _has_map(field.dataType):
        lo, hi = _shown(lo, field.dataType), _shown(hi, field.dataType)
    return grouped.select(
        F.lit(name).alias("name"), "null_count", "distinct_count", "total",
        lo.alias("min_val"), hi.alias("max_val"),
        null_percentage(F.col("null_count"), F.col("total")).alias("null_pct"),
    )


def profile(
    df: DataFrame,
    cols: list[str] | None = None,
    sample_rows: int | None = None,
    approx: bool = False,
) -> DataFrame:
    """Nulls, distincts, minimum and maximum of each column, one row per column.

    Of all rows, or of the first ``sample_rows`` in file order, which are then
    written once for all columns to read.
    """
    if sample_rows is not None:
        df = sample_prefix(df, sample_rows)
        df = df if approx else stage(df)
    names = cols or df.columns
    if approx:
        return _approximate(df, names)
    return reduce(DataFrame.unionByName, [_column_profile(df, c) for c in names])
