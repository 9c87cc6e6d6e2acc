"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.sources.schema import quoted

#: Bytes of text that one call of a vectorised kernel takes at once. A longer
#: text is a slice of its own: texts are never cut.
SLICE_BYTES = 1 << 21


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder, by a path that only Spark's readers may know."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once.

    Catalyst pastes a column into every place that uses it, lambdas included;
    a lambda's own variable is a value.
    """
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def packed(docs: DataFrame, name: str = "row") -> Column:
    """All columns of ``docs`` as one, so that an operator's own cannot clash with them."""
    return F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias(name)


def unpacked(docs: DataFrame, name: str = "row") -> list[Column]:
    """The columns of ``docs`` out of what ``packed`` made."""
    return [F.col(name)[c].alias(c) for c in docs.columns]


def free_name(names: list[str], wanted: str) -> str:
    """``wanted`` with as many underscores behind it as make it differ from all ``names``."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = 1 << 62) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of ``column`` and at most
    ``rows`` rows each."""
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for row, size in enumerate(lengths.tolist()):
        if row > start and (total + size > limit or row - start == rows):
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)
