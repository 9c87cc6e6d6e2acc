"""Set operations on rows with repeats.

Repeats are counted map-side, so a row held by a third of either side travels
as one row and a number. What the result repeats is laid out again in bounded
runs over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelens.sources.schema import quoted

RUN_ROWS = 1 << 18  # copies of one row written by one task


def _counted(df: DataFrame, name: str) -> DataFrame:
    columns = [F.col(quoted(c)) for c in df.columns]
    return df.groupBy(F.struct(*columns).alias("__row")).agg(F.count(F.lit(1)).alias(name))


def _repeated(rows: DataFrame, copies: Column, run_rows: int) -> DataFrame:
    """``__row`` as often as ``copies`` says."""
    wanted = rows.select("__row", copies.alias("__n")).filter("__n > 0")
    runs = wanted.select(
        "__row", "__n",
        F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / F.lit(run_rows)))).alias("__run"),
    )
    spread = runs.repartition("__row", "__run")
    size = F.least(F.lit(run_rows), F.col("__n") - F.col("__run") * F.lit(run_rows)).cast("int")
    return spread.select("__row", F.explode(F.array_repeat(F.lit(0), size))).select("__row.*")


def except_all(left: DataFrame, right: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Rows of ``left``, each as many times as it outnumbers ``right``."""
    both = _counted(left, "__l").join(_counted(right, "__r"), "__row", "left")
    return _repeated(both, F.col("__l") - F.coalesce("__r", F.lit(0)), run_rows)


def intersect_all(left: DataFrame, right: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Rows of both, each as many times as in the side with fewer."""
    both = _counted(left, "__l").join(_counted(right, "__r"), "__row")
    return _repeated(both, F.least("__l", "__r"), run_rows)
