"""Free SQL over registered relations, in Spark's dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakelens.operators.ordering import Sort
from lakelens.operators.rows import with_row_id, written_ids
from lakelens.session import configure

_QUOTES = "spark.sql.ansi.doubleQuotedIdentifiers"
_COMMANDS = ("describe", "desc", "show", "explain", "set", "refresh", "analyze", "summarize")


def run_sql(
    spark: SparkSession, text: str, views: dict[str, DataFrame] | None = None
) -> DataFrame:
    """Run a statement; ``"name"`` quotes an identifier."""
    configure(spark)
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    before = spark.conf.get(_QUOTES)
    spark.conf.set(_QUOTES, "true")
    try:
        return spark.sql(text.strip().rstrip(";"))
    finally:
        spark.conf.set(_QUOTES, before)


def run_sql_numbered(
    spark: SparkSession,
    text: str,
    views: dict[str, DataFrame] | None = None,
    order_by: list[Sort] | None = None,
) -> DataFrame:
    """``run_sql`` with row ids; statements that are no query come as they are.

    Without ``order_by`` the result is written first, which fixes its own order.
    """
    df = run_sql(spark, text, views)
    if text.split(None, 1)[0].lower() in _COMMANDS:
        return df
    return with_row_id(df, order_by) if order_by else written_ids(df)
