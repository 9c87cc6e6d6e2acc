"""Parquet footers as DataFrames: statistics, key-value metadata, audits.

Files are listed by Spark (``binaryFile`` with the content column pruned) or in tasks, and
the footers are read inside the tasks, a batch of files each, so a directory of
many files costs one job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

FOOTER_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("file_size_bytes", pa.int64()),
        ("row_count", pa.int64()),
        ("column_count", pa.int32()),
        ("row_group_count", pa.int32()),
        ("created_by", pa.string()),
        ("format_version", pa.int32()),
        ("codecs", pa.list_(pa.string())),
        ("kv", pa.map_(pa.string(), pa.binary())),
        (
            "columns",
            pa.list_(
                pa.struct(
                    [("name", pa.string()), ("type", pa.string()), ("nullable", pa.bool_())]
                )
            ),
        ),
        ("message", pa.string()),
    ]
)

# Error classes in the order they are tried; each is (class, all of these
# groups must match, any word of a group is enough). Fixed values.
ERROR_CLASSES = (
    ("cors", (("cors", "failed to fetch", "networkerror", "cross-origin"),)),
    ("forbidden", (("http",), ("403", "forbidden"))),
    ("not_found", (("http",), ("404", "not found"))),
    ("not_parquet", (("not a parquet file", "invalid parquet"),)),
    ("zstd", (("zstd", "zstandard"),)),
)

# What to do about each class of error.
ADVICE = {
    "cors": "copy the file to storage the cluster reads and load it from there",
    "forbidden": "the file is not readable with these credentials",
    "not_found": "check the address: nothing is stored there",
    "not_parquet": "the bytes are not a Parquet file: write it again",
    "zstd": "rewrite it with another codec, for example recompress(spark, src, dst, 'snappy')",
    "damaged": "the footer is whole but data is not: restore the file or write it again",
    "unsupported_type": "load() leaves these columns out; cast them when writing",
}


def as_list(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def list_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, length) of every file below the given files, folders or globs."""
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(as_list(paths))
        .select("path", "length")
    )
    # A listing row is tiny, but Spark sizes its splits by file length. Merge
    # them (no shuffle) so that a task reads a batch of footers.
    return listing.coalesce(8 * spark.sparkContext.defaultParallelism)


_GLOB = re.compile(r"[*?\[\]{}]")
_FILES = "path string, length bigint, message string"


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every file below each root, or why there is none."""
    import pyarrow.fs as pafs

    for batch in batches:
        for root in batch.column("path").to_pylist():
            rows = []
            try:
                fs, name = _open(root)
                info = fs.get_file_info(name)
                if info.type == pafs.FileType.NotFound:
                    rows.append((root, None, f"FileNotFound: {root}"))
                elif info.type == pafs.FileType.File:
                    rows.append((root, info.size, None))
                else:
                    rows += [(f.path, f.size, None) for f in fs.get_file_info(pafs.FileSelector(name, recursive=True))
                             if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
            except Exception as error:  # the audit reports whatever the store says
                rows.append((root, None, f"{type(error).__name__}: {error}"))
            paths, sizes, messages = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch({"path": pa.array(paths, pa.string()), "length": pa.array(sizes, pa.int64()),
                                   "message": pa.array(messages, pa.string())})


def walk_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, message): files below files and folders, listed in tasks, empty and
    missing ones included."""
    roots = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return roots.mapInArrow(_walked, _FILES)


def _open(path: str):
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        local = unquote(path[len("file:"):])
        return pafs.LocalFileSystem(), "/" + local.lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return pafs.LocalFileSystem(), path


def _footer_row(path: str, length: int) -> dict:
    import pyarrow.parquet as pq

    row: dict = {"path": path, "file_size_bytes": length}
    try:
        fs, name = _open(path)
        with fs.open_input_file(name) as handle:
            meta = pq.ParquetFile(handle).metadata
            arrow_schema = meta.schema.to_arrow_schema()
            row["row_count"] = meta.num_rows
            row["column_count"] = len(arrow_schema)
            row["row_group_count"] = meta.num_row_groups
            row["created_by"] = (meta.created_by or "").strip() or None
            row["format_version"] = int(str(meta.format_version).split(".")[0])
            row["codecs"] = sorted(
                {
                    meta.row_group(g).column(c).compression
                    for g in range(meta.num_row_groups)
                    for c in range(meta.num_columns)
                }
            )
            row["kv"] = [
                (k.decode("utf-8", "replace"), v)
                for k, v in (meta.metadata or {}).items()
            ]
            row["columns"] = [
                {"name": f.name, "type": str(f.type), "nullable": f.nullable}
                for f in arrow_schema
            ]
    except Exception as error:  # the audit reports whatever the reader raised
        row["message"] = f"{type(error).__name__}: {error}"
    return row


def _damage(path: str, length: int) -> str | None:
    """Where a file's data is not what its footer says: every column chunk is read.

    Chunks must lie inside the file; their pages are walked, decompressed and decoded,
    with checksums where the writer left some. A chunk is in memory at a time.
    """
    import pyarrow.parquet as pq

    fs, name = _open(path)
    with fs.open_input_file(name) as handle:
        file = pq.ParquetFile(handle, page_checksum_verification=True)
        for g in range(file.metadata.num_row_groups):
            group, tops = file.metadata.row_group(g), []
            for c in range(group.num_columns):
                chunk = group.column(c)
                start = chunk.dictionary_page_offset or chunk.data_page_offset
                if start < 4 or start + chunk.total_compressed_size > length:
                    return f"damaged data: row group {g}, column {chunk.path_in_schema}: outside the file"
                top = chunk.path_in_schema.split(".")[0]
                tops += [top] if top not in tops else []
            for top in tops:
                try:
                    rows = file.read_row_group(g, columns=[top], use_threads=False).num_rows
                except Exception as error:
                    return f"damaged data: row group {g}, column {top}: {error}"
                if rows != group.num_rows:
                    return f"damaged data: row group {g}, column {top}: {rows} of {group.num_rows} rows"
    return None


def _read_footers(deep: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                row = _footer_row(path, length)
                if deep and row.get("message") is None:
                    row["message"] = _damage(path, length)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, FOOTER_SCHEMA)
    return run


def footers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file with everything the footer says, or why it failed."""
    return list_files(spark, paths).mapInArrow(_read_footers(), from_arrow_schema(FOOTER_SCHEMA))


def file_stats(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Row, column and row-group counts, size, writer, version per file."""
    return footers(spark, paths).select(
        "path", "row_count", "column_count", "file_size_bytes", "created_by",
        "row_group_count", "format_version", "codecs",
    )


def kv_metadata(spark: SparkSession, paths: str | list[str], key: str | None = None) -> DataFrame:
    """(path, key, value) of footer key-value entries, values decoded as UTF-8."""
    entries = footers(spark, paths).select(
        "path", F.explode("kv").alias("key", "raw")
    )
    if key is not None:
        entries = entries.filter(F.col("key") == key)
    return entries.select("path", "key", F.decode("raw", "UTF-8").alias("value"))


def schema_drift(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """How many files declare each (column, type): more than one type is drift."""
    declared = footers(spark, paths).select("path", F.explode("columns").alias("c"))
    by_type = declared.groupBy(
        F.col("c.name").alias("name"), F.col("c.type").alias("type")
    ).agg(F.count(F.lit(1)).alias("files"))
    names = by_type.groupBy("name").agg(F.count(F.lit(1)).alias("n_types"))
    return by_type.join(names, "name").select(
        "name", "type", "files", (F.col("n_types") > 1).alias("drifted")
    )


def classify_message(message: Column) -> Column:
    """Error class of a message text; the first class that matches wins."""
    text = F.lower(message)
    chain = F.when(message.isNull(), F.lit(None).cast("string"))
    for name, groups in ERROR_CLASSES:
        hit = F.lit(True)
        for words in groups:
            any_word = F.lit(False)
            for word in words:
                any_word = any_word | text.contains(word)
            hit = hit & any_word
        chain = chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit("other"))


def advice(error_class: Column) -> Column:
    known = F.create_map(*[F.lit(v) for pair in ADVICE.items() for v in pair])
    return F.element_at(known, error_class)


def _audit_class(message: Column) -> Column:
    """Classes a storage reader adds to the message rules."""
    text = F.lower(message)
    unreadable = (
        text.contains("magic bytes")
        | text.contains("parquet file size is")
        | text.contains("couldn't deserialize thrift")
        | text.contains("arrowinvalid")
    )
    return (
        F.when(message.isNull(), F.lit(None).cast("string"))
        .when(text.startswith("damaged data"), F.lit("damaged"))
        .when(text.contains("filenotfound"), F.lit("not_found"))
        .when(unreadable, F.lit("not_parquet"))
        .otherwise(classify_message(message))
    )


def audit_files(spark: SparkSession, paths: str | list[str], deep: bool = False) -> DataFrame:
    """Status of every file: ok, unsupported (Spark cannot read a type) or error.

    Files are listed and read in tasks; a path with wildcards is listed by Spark, which
    does not show empty files. ``deep`` reads all data as well: a file whose pages are
    damaged is an error that names the first such row group and column.
    """
    whole = [p for p in as_list(paths) if not _GLOB.search(p)]
    globs = [p for p in as_list(paths) if _GLOB.search(p)]
    listed = walk_files(spark, whole) if whole else spark.createDataFrame([], _FILES)
    for path in globs:
        try:
            found = list_files(spark, path).withColumn("message", F.lit(None).cast("string"))
        except AnalysisException as error:
            found = spark.createDataFrame([(path, None, "FileNotFound: " + str(error).split("\n")[0])], _FILES)
        listed = listed.unionByName(found)
    listed = listed.withColumn("message", F.when(F.col("length") == 0, "not a Parquet file: no content").otherwise(
        F.col("message")))
    refused = F.filter(
        F.col("columns"), lambda c: c["type"].startswith("time32") | c["type"].startswith("time64")
    )
    cores = spark.sparkContext.defaultParallelism
    sound = listed.where("message IS NULL").select("path", "length").repartition(4 * cores if deep else cores)
    found = sound.mapInArrow(_read_footers(deep), from_arrow_schema(FOOTER_SCHEMA)).select(
        "path", F.transform(refused, lambda c: c["name"]).alias("unsupported"), "message")
    found = found.unionByName(listed.where("message IS NOT NULL").select(
        "path", F.array().cast("array<string>").alias("unsupported"), "message"))
    return found.select(
        "path",
        F.when(F.col("message").isNotNull(), "error")
        .when(F.size("unsupported") > 0, "unsupported")
        .otherwise("ok")
        .alias("status"),
        F.when(F.col("message").isNotNull(), _audit_class(F.col("message")))
        .when(F.size("unsupported") > 0, "unsupported_type")
        .alias("error_class"),
        F.coalesce(
            "message",
            F.when(
                F.size("unsupported") > 0,
                F.concat(F.lit("columns of type TIME: "), F.array_join("unsupported", ", ")),
            ),
        ).alias("message"),
    ).withColumn("advice", advice(F.col("error_class")))
