"""Dense row ids, pages, samples.

Ids count from 0 without gaps. Nothing here numbers a whole relation in one
task: rows are numbered inside bounded blocks, and only the block counts (one
small row each) are summed up in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.operators.ordering import ROW_ID, Sort, sort_keys
from lakelens.session import bounded_broadcast, stage
from lakelens.sources.schema import is_native_geometry, is_opaque, quoted

PAGE_SIZE = 1000
BLOCK_ROWS = 1 << 20  # rows numbered together in one task
BROADCAST_BLOCKS = 500_000  # block counts (a name and two numbers) sent to executors
SMALL_CHUNK = 1 << 14  # rows worth a task of their own
TOP_ROWS = 200_000  # a sorted prefix up to this long is taken as a top-k

_FILE, _POS, _BLOCK, _CHUNK = "__file", "__pos", "__block", "__chunk"


def file_position(df: DataFrame) -> tuple[Column, Column] | None:
    """(file, row in file) if the rows of ``df`` still are rows of files."""
    hidden = df._jdf.queryExecution().analyzed().metadataOutput()
    for i in range(hidden.size()):
        column = hidden.apply(i)
        if column.name() == "_metadata" and "row_index:" in column.dataType().simpleString():
            return F.col("_metadata.file_path"), F.col("_metadata.row_index")
    return None


def with_position(df: DataFrame) -> DataFrame:
    """Add file and row in file; what no longer is rows of files gets written."""
    df = df if file_position(df) else stage(df)
    path, row = file_position(df)
    return df.select("*", path.alias(_FILE), row.alias(_POS))


def _offsets(counts: DataFrame, order: list[str]) -> DataFrame:
    """Number of each block and rows before it.

    One input row per block, so one task will do.
    """
    blocks = Window.orderBy(*order)
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *order,
        F.row_number().over(blocks).alias("__no"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"),
    )


def _ties(df: DataFrame) -> list[Column]:
    """What ends a sort key: nothing for rows of files, whose position does, else
    every column that can be compared, so that pages agree with each other."""
    if file_position(df):
        return []
    return [F.col(quoted(f.name)).asc_nulls_last() for f in df.schema.fields if _comparable(f.dataType)]


def _comparable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _comparable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_comparable(f.dataType) for f in dtype.fields)
    return isinstance(dtype, T.AtomicType) and not isinstance(dtype, T.VariantType) and not is_native_geometry(dtype)


def _columns(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def _file_order_ids(df: DataFrame, block_rows: int) -> DataFrame:
    """Blocks are stretches of a file, so the same rows meet on every run.

    Blocks get their number before the shuffle, which then carries a number per
    row and no file name.
    """
    blocked = with_position(df).withColumn(_BLOCK, F.expr(f"{_POS} div {block_rows}"))
    counts = blocked.groupBy(_FILE, _BLOCK).agg(F.count(F.lit(1)).alias("n"))
    offsets = bounded_broadcast(_offsets(counts, [_FILE, _BLOCK]), BROADCAST_BLOCKS)
    rank = F.row_number().over(Window.partitionBy("__no").orderBy(_POS))
    return blocked.join(offsets, [_FILE, _BLOCK]).select(
        (F.col("__before") + rank - 1).alias(ROW_ID), *_columns(df)
    )


def written_ids(df: DataFrame) -> DataFrame:
    """Write ``df`` once; ids follow its partitions and the order inside them.

    A task writes one file, so a row's place in its file is its rank there.
    """
    written = stage(df.select(*_columns(df), F.spark_partition_id().alias(_CHUNK)))
    counts = written.groupBy(_CHUNK).agg(F.count(F.lit(1)).alias("n"))
    offsets = bounded_broadcast(_offsets(counts, [_CHUNK]), BROADCAST_BLOCKS)
    placed = written.select("*", F.col("_metadata.row_index").alias(_POS))
    return placed.join(offsets, _CHUNK).select(
        (F.col("__before") + F.col(_POS)).alias(ROW_ID), *_columns(df)
    )


def _chunks(df: DataFrame, rows: int, block_rows: int) -> int:
    """Ranges to sort: of at most ``block_rows`` while these are no more tasks than a
    shuffle has, else of at most ``BLOCK_ROWS``; small relations still use all cores.

    A range is sorted on disk if need be and numbered by its file, so it need not end
    where a block does. Every task sends a sample of its keys and a report of its file
    to the driver, which many short ranges would fill.
    """
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    worth_a_task = math.ceil(rows / min(SMALL_CHUNK, block_rows))
    return max(1, min(shuffle, worth_a_task), math.ceil(rows / max(block_rows, BLOCK_ROWS)))


def _sorted_ids(df: DataFrame, keys: list[Column], block_rows: int) -> DataFrame:
    """Range-partition, sort, write once: a row's place in its file is its rank.

    The file position ends the sort key, so one value held by a third of the
    rows is still cut into many ranges, and reruns agree.
    """
    tagged = with_position(df)
    rows = tagged.count()
    chunks = _chunks(df, rows, block_rows)
    order = [*keys, F.col(_FILE).asc(), F.col(_POS).asc()]
    ranges = tagged.repartitionByRange(chunks, *order).sortWithinPartitions(*order)
    return written_ids(ranges.select(*_columns(df)))


def number_scan(df: DataFrame) -> DataFrame:
    """``__row_id`` for a plain scan, rows and columns as loaded, without a shuffle.

    A row's id is its place in its file plus the rows of the files before.
    """
    path, row = file_position(df)
    tagged = df.select("*", path.alias(_FILE), row.alias(_POS))
    # Counting reads footers alone; one row per file, as many as Spark lists.
    counts = tagged.groupBy(_FILE).agg(F.count(F.lit(1)).alias("n"))
    offsets = bounded_broadcast(_offsets(counts, [_FILE]))
    return tagged.join(offsets, _FILE).select(
        (F.col("__before") + F.col(_POS)).alias(ROW_ID),
        *_columns(df),
    )


def with_row_id(
    df: DataFrame,
    order_by: list[Sort] | tuple[Sort, ...] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``__row_id`` = 0, 1, 2, ... in sort order, else in file order."""
    if order_by:
        return _sorted_ids(df, [*sort_keys(df, order_by), *_ties(df)], block_rows)
    if file_position(df):
        return _file_order_ids(df, block_rows)
    return written_ids(df)


def limited_row_id(
    df: DataFrame, order_by: list[Sort] | tuple[Sort, ...], limit: int, offset: int = 0
) -> DataFrame:
    """The rows ``offset`` .. ``offset + limit - 1`` of the sorted relation, with ids."""
    end = offset + limit
    if end > TOP_ROWS:
        ids = with_row_id(df, order_by)
        return ids.filter((F.col(ROW_ID) >= offset) & (F.col(ROW_ID) < end))
    columns = _columns(df)
    keys = sort_keys(df, order_by)
    if not keys or file_position(df):
        df = with_position(df)
        keys = [*keys, F.col(_FILE).asc(), F.col(_POS).asc()]
    else:
        keys = [*keys, *_ties(df)]
    top = df.orderBy(*keys).offset(offset).limit(limit)
    number = F.row_number().over(Window.orderBy(*keys)) - 1 + offset
    return top.select(number.cast("bigint").alias(ROW_ID), *columns)


def page(
    df: DataFrame, page: int = 0, size: int = PAGE_SIZE, sort: Sort | None = None
) -> DataFrame:
    """One page with 0-based ids; binary columns are left out.

    Pages beyond ``TOP_ROWS`` number the relation first. To turn many of those,
    keep ``with_row_id(df, ...)`` and take them with ``numbered_page``.
    """
    offset = max(0, page) * size
    kept = [f.name for f in df.schema.fields if f.dataType.typeName() != "binary"]
    shown = df.select([F.col(quoted(c)) for c in kept]) if kept else df
    if sort is None:
        if offset + size > TOP_ROWS:
            return numbered_page(with_row_id(shown), page, size)
        shown = sample_prefix(shown, offset + size)
    return limited_row_id(shown, [sort] if sort else [], size, offset)


def numbered_page(numbered: DataFrame, page: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """A page of a relation that has its ids already."""
    first = max(0, page) * size
    return numbered.filter((F.col(ROW_ID) >= first) & (F.col(ROW_ID) < first + size))


def page_count_column(rows: Column, size: int = PAGE_SIZE) -> Column:
    return F.ceil(rows / F.lit(size)).cast("bigint")


def page_count(df: DataFrame, size: int = PAGE_SIZE) -> int:
    return math.ceil(df.count() / size)


def row_lookup(numbered: DataFrame, row_id: int) -> DataFrame:
    return numbered.filter(F.col(ROW_ID) == F.lit(row_id).cast("bigint"))


def select_visible(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """The chosen columns in result order (all if none chosen), ids hidden."""
    names = [c for c in df.columns if c != ROW_ID and (not cols or c in cols)]
    return df.select([F.col(quoted(c)) for c in names])


def sample_prefix(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in file order.

    Only as many leading files are read as hold ``n`` rows of ``df``: the file
    list doubles until they do. A prefix too long for a top-k is cut by row ids.
    What no longer is rows of files is written first, and its order is that of the
    written files: at every length the same.
    """
    position = file_position(df)
    if n > TOP_ROWS:
        return with_row_id(df).filter(F.col(ROW_ID) < n).drop(ROW_ID)
    if position is None:
        return sample_prefix(stage(df), n)
    path, row = position
    # The file list writes file:///a where the metadata column has file:/a.
    files = sorted(f.replace("file:///", "file:/", 1) for f in df.inputFiles())
    take = 1
    prefix = df
    while take < len(files):
        prefix = df.filter(path <= F.lit(files[take - 1]))
        if prefix.limit(n).count() >= n:
            break
        take *= 2
        prefix = df
    columns = _columns(df)
    return with_position(prefix).orderBy(_FILE, _POS).limit(n).select(columns)


def default_columns(df: DataFrame) -> list[str]:
    """Every column but binary and geometry ones; all if nothing is left."""
    kept = [f.name for f in df.schema.fields if not is_opaque(f.dataType)]
    return kept or df.columns
