"""Loading Parquet files, folders and globs as the relation ``data``."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.operators.ordering import ROW_ID
from lakelens.operators.rows import file_position, number_scan, with_row_id
from lakelens.session import configure
from lakelens.sources.drift import read_groups, schema_groups
from lakelens.sources.footers import _open, as_list, list_files
from lakelens.sources.schema import dedupe_names, quoted

VIEW = "data"

# A bucket's own https address, as ``normalized_url`` writes it.
_BUCKET_URL = re.compile(r"(?i)^https?://([^/]+)\.s3(?:[.-][a-z0-9-]+)?\.amazonaws\.com/(.*)$")


def hadoop_uri(uri: str) -> str:
    """The URI as Spark's file systems spell it."""
    uri = uri.strip()
    if uri.startswith("s3://"):
        return "s3a://" + uri[len("s3://"):]
    if bucket := _BUCKET_URL.match(uri):
        return f"s3a://{bucket[1]}/{bucket[2]}"
    if uri.lower().startswith(("http://", "https://")):
        raise ValueError(
            "Spark has no seekable HTTP file system: copy the file to shared storage first"
        )
    return uri


def normalized_url(uri: Column) -> Column:
    """Trimmed URI; ``s3://bucket/key`` becomes the bucket's https address."""
    text = F.regexp_replace(uri, r"^\s+|\s+$", "")
    bucket = F.regexp_extract(text, r"^s3://([^/]*)", 1)
    key = F.regexp_extract(text, r"(?s)^s3://[^/]*(/.*)$", 1)
    return F.when(
        text.startswith("s3://"),
        F.concat(
            F.lit("https://"), bucket, F.lit(".s3.amazonaws.com"),
            F.when(key == "", F.lit("/")).otherwise(key),
        ),
    ).otherwise(text)


def normalize_uris(df: DataFrame, col: str) -> DataFrame:
    """Add ``url`` and ``is_valid`` (an http or https address with a host)."""
    with_url = df.withColumn("url", normalized_url(F.col(quoted(col))))
    return with_url.withColumn(
        "is_valid",
        F.coalesce(
            F.col("url").rlike(r"(?i)^https?:[/\\]*[^/\\?#\s<>^|]+([/\\?#].*)?$"),
            F.lit(False),
        ),
    )


def load(
    spark: SparkSession,
    path: str | list[str],
    view: str | None = VIEW,
    columns: list[str] | None = None,
    row_id: bool = False,
    mixed_units: bool = False,
    unify: bool = True,
) -> DataFrame:
    """Read Parquet and register it, replacing what ``view`` named before.

    ``row_id`` adds dense ids in file order, which at this point need no shuffle.

    Files Spark's reader refuses, by the first file's footer, are read through Arrow,
    a task per row group: nanosecond timestamps become microseconds (earlier ones
    within a microsecond, by floor), times of day become microseconds since
    midnight, and repeated column names are told apart by position. No setting of
    the session is touched. ``mixed_units`` looks at every footer, for folders in
    which only later files hold such columns.

    Files of different schemas are read group by group and cast to common types (see
    ``drift``); ``unify=False`` spares the look at the footers of a folder known to be
    of one schema.
    """
    configure(spark)
    paths = [hadoop_uri(p) for p in as_list(path)]
    for p in paths:
        spark.catalog.refreshByPath(p)
    try:
        df = spark.read.parquet(*paths)
        if unify and len(df._jdf.inputFiles()) > 1 and len(groups := schema_groups(spark, paths)) > 1:
            df = read_groups(groups, _reader(spark, paths), row_id)
        elif mixed_units and _any_foreign(spark, paths):
            df = load_by_position(spark, paths)
    except Exception:  # a refused schema shows as several kinds of error
        if not _foreign(_first_arrow_schema(spark, paths)):
            raise
        df = load_by_position(spark, paths)
    if columns:
        numbered = [ROW_ID] if ROW_ID in df.columns and row_id else []
        df = df.select([F.col(quoted(c)) for c in [*numbered, *columns]])
    if row_id and ROW_ID not in df.columns:
        df = number_scan(df) if file_position(df) else with_row_id(df)
    if view:
        df.createOrReplaceTempView(view)
    return df


def _reader(spark: SparkSession, paths: list[str]):
    """Reads files of one schema, with the partition columns of the folder they are in."""
    def read(files: list[str]) -> DataFrame:
        options = {"basePath": paths[0]} if len(paths) == 1 and paths[0] not in files else {}
        try:
            return spark.read.options(**options).parquet(*files)
        except Exception:
            if not _foreign(_first_arrow_schema(spark, files)):
                raise
            return load_by_position(spark, files)
    return read


def _data_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return list_files(spark, paths).filter(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]"))


def _first_arrow_schema(spark: SparkSession, paths: list[str]) -> pa.Schema:
    import pyarrow.parquet as pq

    first = _data_files(spark, paths).agg(F.min("path")).first()[0]
    fs, name = _open(first)
    with fs.open_input_file(name) as handle:
        return pq.read_schema(handle)


def _is_nanos(dtype: pa.DataType) -> bool:
    return pa.types.is_timestamp(dtype) and dtype.unit == "ns"


def _foreign(schema: pa.Schema) -> bool:
    """Whether Spark's own reader would refuse a file of this schema."""
    repeated = len({n.lower() for n in schema.names}) < len(schema.names)
    return repeated or any(pa.types.is_time(f.type) or _is_nanos(f.type) for f in schema)


def _any_foreign(spark: SparkSession, paths: list[str]) -> bool:
    import pyarrow.parquet as pq

    def look(batches):
        for batch in batches:
            for file in batch.column("path").to_pylist():
                fs, name = _open(file)
                with fs.open_input_file(name) as handle:
                    if _foreign(pq.read_schema(handle)):
                        yield pa.RecordBatch.from_pydict({"path": [file]})

    return not _data_files(spark, paths).mapInArrow(look, "path string").isEmpty()


def _plain_type(dtype: pa.DataType) -> pa.DataType:
    if pa.types.is_time(dtype):
        return pa.int64()
    return pa.timestamp("us", dtype.tz) if _is_nanos(dtype) else dtype


def _plain(column: pa.ChunkedArray, dtype: pa.DataType) -> pa.ChunkedArray:
    if pa.types.is_time(column.type):
        column = column.cast(pa.time64("us"), safe=False).cast(pa.int64())
    elif _is_nanos(column.type):
        column = pa.compute.floor_temporal(column, unit="microsecond").cast(pa.timestamp("us", column.type.tz))
    return column.cast(dtype)


def load_by_position(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Read files Spark's reader refuses, columns by position; one task per row group."""
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema

    paths = [hadoop_uri(p) for p in as_list(path)]
    arrow = _first_arrow_schema(spark, paths)
    names = dedupe_names(arrow.names)
    target = pa.schema([pa.field(n, _plain_type(f.type), f.nullable) for f, n in zip(arrow, names)])
    schema = from_arrow_schema(target, prefer_timestamp_ntz=True)

    def count_groups(batches):
        for batch in batches:
            for file in batch.column("path").to_pylist():
                fs, name = _open(file)
                with fs.open_input_file(name) as handle:
                    groups = pq.ParquetFile(handle).num_row_groups
                yield pa.RecordBatch.from_pydict(
                    {"path": [file] * groups, "group": list(range(groups))}
                )

    def read_groups(batches):
        for batch in batches:
            for file, group in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                fs, name = _open(file)
                with fs.open_input_file(name) as handle:
                    table = pq.ParquetFile(handle).read_row_group(group)
                columns = [_plain(c, f.type) for c, f in zip(table.columns, target)]
                yield from pa.Table.from_arrays(columns, schema=target).to_batches()

    groups = _data_files(spark, paths).mapInArrow(count_groups, "path string, `group` bigint")
    return groups.repartition("path", "group").mapInArrow(read_groups, schema)
