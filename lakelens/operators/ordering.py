"""Sort keys: nulls last in both directions, and natural text order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.sources.schema import field_of, is_numeric, quoted

ROW_ID = "__row_id"


@dataclass(frozen=True)
class Sort:
    col: str
    dir: str = "ASC"


def sort_key(sort: Sort) -> Column:
    col = F.col(quoted(sort.col))
    direction = sort.dir.upper()
    if direction not in ("ASC", "DESC"):
        raise ValueError(f"sort direction is ASC or DESC, not {sort.dir!r}")
    return col.desc_nulls_last() if direction == "DESC" else col.asc_nulls_last()


def sort_keys(df: DataFrame, sorts: list[Sort] | tuple[Sort, ...]) -> list[Column]:
    for s in sorts:
        field_of(df, s.col)
    return [sort_key(s) for s in sorts]


def natural_key(text: Column) -> Column:
    """Text whose order ignores case and accents and counts digit runs.

    A digit run is replaced by its length and itself without leading zeros, so
    runs of any length compare as numbers.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))

    def piece(run: Column) -> Column:
        digits = F.regexp_replace(run, r"^0+(?=\d)", "")
        size = F.lpad(F.length(digits).cast("string"), 10, "0")
        return F.when(run.rlike(r"^\d"), F.concat(size, digits)).otherwise(run)

    return F.collate(F.array_join(F.transform(runs, piece), ""), "UNICODE_CI_AI")


def natural_sort(df: DataFrame, col: str, dir: str = "ASC", tie: str = ROW_ID) -> DataFrame:
    """Order a result by one column; equal values keep their row order."""
    dtype = field_of(df, col).dataType
    value = F.col(quoted(col))
    if not (is_numeric(dtype) or isinstance(
            dtype, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType))):
        text = value if isinstance(dtype, T.StringType) else (
            F.to_json(value) if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))
            else value.cast("string"))
        value = natural_key(text)
    key = value.desc_nulls_last() if dir.upper() == "DESC" else value.asc_nulls_last()
    return df.orderBy(key, F.col(tie).asc())
