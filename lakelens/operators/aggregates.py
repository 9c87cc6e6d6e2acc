"""Grouped and global aggregates of the structured query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.sources.schema import field_of, quoted

FUNCTIONS = ("COUNT", "SUM", "AVG", "MIN", "MAX")


@dataclass(frozen=True)
class Agg:
    fn: str
    col: str = "*"
    alias: str | None = None

    def name(self) -> str:
        given = (self.alias or "").strip()
        return given or f"{self.fn.lower()}_{'count' if self.col == '*' else self.col}"


def aggregate_column(df: DataFrame, agg: Agg, widen: bool = True) -> Column:
    """One aggregate. Sums of integers are decimals of 38 digits, so that they do not
    overflow; ``widen=False`` keeps them longs, which fail when they do."""
    fn = agg.fn.upper()
    if fn not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {agg.fn!r}; known: {FUNCTIONS}")
    if agg.col == "*":
        if fn != "COUNT":
            raise ValueError(f"{fn} needs a column")
        return F.count(F.lit(1)).alias(agg.name())
    dtype = field_of(df, agg.col).dataType
    col = F.col(quoted(agg.col))
    if fn == "COUNT":
        out = F.count(col)
    elif fn == "SUM":
        wide = widen and isinstance(dtype, T.IntegralType)
        out = F.sum(col.cast("decimal(38,0)") if wide else col)
    elif fn == "AVG":
        out = F.avg(col.cast("double") if isinstance(dtype, T.DecimalType) else col)
    else:
        out = F.min(col) if fn == "MIN" else F.max(col)
    return out.alias(agg.name())


def aggregate(
    df: DataFrame, group_by: list[str], aggs: list[Agg], widen: bool = True
) -> DataFrame:
    """Group and aggregate; groups alone give their distinct values."""
    keys = [F.col(quoted(c)) for c in group_by]
    columns = [aggregate_column(df, a, widen) for a in aggs]
    if keys and columns:
        return df.groupBy(*keys).agg(*columns)
    if keys:
        return df.select(*keys).distinct()
    return df.agg(*columns) if columns else df


def recent_distinct(
    df: DataFrame, entity: str, key: str, ts: str, n: int = 20
) -> DataFrame:
    """The last ``n`` different keys per entity, newest first.

    Repeats collapse before the ranking, and the rank limit is applied in each
    map task first, so no task receives an entity's whole history.
    """
    from pyspark.sql import Window

    latest = df.groupBy(entity, key).agg(F.max(ts).alias(ts))
    order = Window.partitionBy(entity).orderBy(F.col(ts).desc(), F.col(key))
    return latest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
