"""Pages of a sorted relation that is sorted once.

The relation is written in its order, in files of a bounded number of rows, with a
manifest of one short row per file: its first row id, its rows, and the nulls and the
least and greatest value of the first sort key. A page then opens the one or two files
that hold its ids, and a page that begins at a key value finds its file by the bounds.
Ids are those of ``with_row_id``.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.operators.ordering import ROW_ID, Sort, sort_keys
from lakelens.operators.rows import (
    _FILE,
    _POS,
    BLOCK_ROWS,
    PAGE_SIZE,
    _chunks,
    _columns,
    _offsets,
    with_position,
)
from lakelens.session import scratch_dir
from lakelens.sources.schema import quoted

FILE_ROWS = 1 << 18  # rows of one file: what a page may have to pass over

_LOW, _HIGH = "__low", "__high"


@dataclass(frozen=True)
class PageIndex:
    """A sorted relation on storage; lives as long as the folder ``path``."""

    spark: SparkSession
    path: str
    sort: Sort

    @property
    def manifest(self) -> DataFrame:
        """(file, first_id, rows, nulls, __low, __high), one row per file."""
        return self.spark.read.parquet(f"{self.path}/manifest")

    def rows(self) -> int:
        return self.manifest.agg(F.sum("rows")).first()[0] or 0

    def _files(self, condition) -> list:
        return self.manifest.where(condition).orderBy("first_id").select("file", "first_id").collect()

    def _read(self, files: list) -> DataFrame:
        """Rows of a few files with their ids."""
        if not files:
            return self._read(self._files(F.lit(True))[:1]).limit(0)
        each = []
        for file, first in files:
            rows = self.spark.read.parquet(file)
            each.append(rows.select((F.lit(first) + F.col("_metadata.row_index")).alias(ROW_ID), *_columns(rows)))
        return reduce(DataFrame.union, each)

    def between(self, start: int, end: int) -> DataFrame:
        """Rows with ids from ``start`` to before ``end``, in order."""
        files = self._files((F.col("first_id") < end) & (F.col("first_id") + F.col("rows") > start))
        held = (F.col(ROW_ID) >= start) & (F.col(ROW_ID) < end)
        return self._read(files).where(held).orderBy(ROW_ID)

    def page(self, page: int = 0, size: int = PAGE_SIZE) -> DataFrame:
        """One page with its ids; a negative page is the first."""
        first = max(0, page) * size
        return self.between(first, first + size)

    def seek(self, value: object) -> int:
        """Id of the first row whose first sort key is ``value`` or comes after it, as nulls do."""
        down = self.sort.dir.upper() == "DESC"
        given = F.lit(value)
        bound = F.col(_LOW) <= given if down else F.col(_HIGH) >= given
        files = self._files((F.col("nulls") > 0) | bound)[:1]
        if not files:
            return self.rows()
        key = F.col(quoted(self.sort.col))
        here = key.isNull() | (key <= given if down else key >= given)
        found = self._read(files).where(here).agg(F.min(ROW_ID)).first()[0]
        return self.rows() if found is None else found

    def page_from(self, value: object, size: int = PAGE_SIZE) -> DataFrame:
        """``size`` rows from the first whose first sort key is ``value`` or comes after it."""
        start = self.seek(value)
        return self.between(start, start + size)


def build_page_index(
    df: DataFrame, sorts: list[Sort] | tuple[Sort, ...], path: str | None = None, file_rows: int = FILE_ROWS
) -> PageIndex:
    """Sort ``df`` once and write it with its manifest, to ``path`` or the scratch folder.

    Ranges end with the place in the file, so one key value on a third of the rows is cut
    into many files like any other.
    """
    spark = df.sparkSession
    path = path or f"{scratch_dir(spark)}/pages-{uuid.uuid4().hex}"
    tagged = with_position(df)
    order = [*sort_keys(df, sorts), F.col(_FILE).asc(), F.col(_POS).asc()]
    chunks = _chunks(df, tagged.count(), BLOCK_ROWS)
    ranges = tagged.repartitionByRange(chunks, *order).sortWithinPartitions(*order).select(*_columns(df))
    ranges.write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    written = spark.read.schema(df.schema).parquet(f"{path}/rows")
    key = F.col(quoted(sorts[0].col))
    # file names go by task, then by file of the task: the order of the rows
    counts = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(key.isNull()).alias("nulls"), F.min(key).alias(_LOW), F.max(key).alias(_HIGH))
    counts = counts.where("n > 0")
    offsets = _offsets(counts, ["file"])
    counts.join(offsets, "file").select(
        "file", F.col("__before").alias("first_id"), F.col("n").alias("rows"), "nulls", _LOW, _HIGH,
    ).coalesce(1).write.parquet(f"{path}/manifest")
    return PageIndex(spark, path, sorts[0])
