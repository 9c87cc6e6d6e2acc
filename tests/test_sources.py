import datetime as dt
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import lakelens as L
from lakelens.sources.footers import classify_message
from lakelens.sources.load import hadoop_uri
from lakelens.sources.schema import dedupe_names

TESTDATA = "/root/testdata/sf0.001"


def write(path, table, **options):
    pq.write_table(table, str(path), **options)
    return str(path)


@pytest.fixture
def files(tmp_path):
    table = pa.table({"a": [1, 2, 3], "b": ["x", None, "z"]})
    write(tmp_path / "plain.parquet", table, row_group_size=2)
    write(tmp_path / "zstd.parquet", table, compression="zstd")
    write(tmp_path / "time.parquet", pa.table({"a": [1], "t": pa.array([5], pa.time64("us"))}))
    (tmp_path / "corrupt.parquet").write_bytes(b"PAR1 this is no footer PAR1")
    (tmp_path / "empty.parquet").write_bytes(b"")
    return tmp_path


def test_load_registers_and_replaces(spark, files):
    L.load(spark, str(files / "plain.parquet"))
    assert spark.table("data").count() == 3
    L.load(spark, f"{TESTDATA}/nation.parquet")
    assert spark.table("data").count() == 25


def test_load_folder_and_glob(spark, tmp_path):
    for i in range(3):
        write(tmp_path / f"part-{i}.parquet", pa.table({"a": [i, i + 10]}))
    assert L.load(spark, str(tmp_path)).count() == 6
    assert L.load(spark, str(tmp_path / "part-[01].parquet")).count() == 4


def test_uris():
    assert hadoop_uri(" s3://b/k ") == "s3a://b/k"
    with pytest.raises(ValueError, match="shared storage"):
        hadoop_uri("https://h/a.parquet")


def test_normalize_uris(spark):
    cases = {
        "s3://b/k/x.parquet": ("https://b.s3.amazonaws.com/k/x.parquet", True),
        "s3://b": ("https://b.s3.amazonaws.com/", True),
        "  https://h/a  ": ("https://h/a", True),
        "http://h/a": ("http://h/a", True),
        "ftp://h/a": ("ftp://h/a", False),
        "S3://b/k": ("S3://b/k", False),
        "abc": ("abc", False),
        "": ("", False),
    }
    rows = L.normalize_uris(spark.createDataFrame([(u,) for u in cases], "u string"), "u").collect()
    assert {r.u: (r.url, r.is_valid) for r in rows} == cases


def test_file_stats_match_duckdb(spark):
    path = f"{TESTDATA}/lineitem.parquet"
    row = L.file_stats(spark, path).first()
    con = duckdb.connect()
    meta = con.sql(
        f"SELECT num_rows, num_row_groups, format_version, created_by "
        f"FROM parquet_file_metadata('{path}')").fetchall()[0]
    assert (row.row_count, row.row_group_count, row.format_version) == meta[:3]
    assert row.created_by == meta[3] and row.file_size_bytes == os.path.getsize(path)
    assert row.codecs == ["SNAPPY"] and row.column_count == 11


def test_kv_metadata_keys_match_duckdb(spark):
    path = f"{TESTDATA}/orders.parquet"
    keys = {r.key for r in L.kv_metadata(spark, path).collect()}
    rows = duckdb.sql(f"SELECT decode(key) FROM parquet_kv_metadata('{path}')").fetchall()
    assert keys == {r[0] for r in rows}


def test_audit(spark, files):
    rows = L.audit_files(spark, [str(files), str(files / "missing.parquet")]).collect()
    found = {os.path.basename(r.path): (r.status, r.error_class) for r in rows}
    assert found == {
        "plain.parquet": ("ok", None),
        "zstd.parquet": ("ok", None),
        "time.parquet": ("unsupported", "unsupported_type"),
        "corrupt.parquet": ("error", "not_parquet"),
        "empty.parquet": ("error", "not_parquet"),
        "missing.parquet": ("error", "not_found"),
    }
    assert all(r.message and r.advice for r in rows if r.status != "ok")


def test_audit_of_data(spark, tmp_path):
    """Footers are whole; pages of one column chunk are not."""
    table = pa.table({"a": list(range(5000)), "b": [f"text {i}" for i in range(5000)], "c": [[i] for i in range(5000)]})
    for name, options in (("snappy", {}), ("plain", {"compression": "none", "use_dictionary": False, "write_page_checksum": True})):
        path = str(tmp_path / f"{name}.parquet")
        pq.write_table(table, path, row_group_size=2000, **options)
        chunk = pq.ParquetFile(path).metadata.row_group(1).column(1)
        start = chunk.dictionary_page_offset or chunk.data_page_offset
        for kind, at, size in (("good", 0, 0), ("zeroed", start, chunk.total_compressed_size),
                               ("inside", start + chunk.total_compressed_size // 2, 2000)):
            raw = bytearray(open(path, "rb").read())
            raw[at:at + size] = bytes(size)
            (tmp_path / f"{name}-{kind}.parquet").write_bytes(bytes(raw))
    shallow = L.audit_files(spark, str(tmp_path)).collect()
    assert {r.status for r in shallow} == {"ok"} and len(shallow) == 8
    rows = {os.path.basename(r.path): r for r in L.audit_files(spark, str(tmp_path), deep=True).collect()}
    for name, r in rows.items():
        bad = "zeroed" in name or "inside" in name
        assert (r.status, r.error_class) == (("error", "damaged") if bad else ("ok", None)), name
        assert not bad or "row group 1, column b" in r.message
    one = L.audit_files(spark, [str(tmp_path / "*-good.parquet"), str(tmp_path / "none-*")], deep=True).collect()
    assert sorted(r.status for r in one) == ["error", "ok", "ok"]


def test_message_classes(spark):
    cases = {
        "CORS and http 404": "cors",
        "TypeError: Failed to fetch": "cors",
        "HTTP 403": "forbidden",
        "403 without protocol": "other",
        "HTTP: Not Found": "not_found",
        "is not a parquet file": "not_parquet",
        "Zstandard frame": "zstd",
        "something else": "other",
    }
    rows = spark.createDataFrame([(m,) for m in cases], "m string").select(
        "m", classify_message(F.col("m")).alias("c")).collect()
    assert {r.m: r.c for r in rows} == cases


def test_recompress(spark, files, tmp_path):
    out = str(tmp_path / "out")
    L.recompress(spark, str(files / "zstd.parquet"), out, "gzip")
    codecs = [r.codecs for r in L.file_stats(spark, out).collect() if r.codecs]
    assert codecs == [["GZIP"]]
    assert spark.read.parquet(out).count() == 3


def test_describe_and_duplicate_names(spark, tmp_path):
    assert dedupe_names(["a", "a", "b", "a", "a_1"]) == ["a", "a_2", "b", "a_3", "a_1"]
    twice = pa.Table.from_arrays([pa.array([1, 2, 3]), pa.array(["x", "y", "z"])], names=["a", "a"])
    path = write(tmp_path / "dup.parquet", twice, row_group_size=2)
    df = L.load(spark, path)
    assert [(r.name, r.type) for r in L.describe(df).collect()] == [("a", "bigint"), ("a_1", "string")]
    assert sorted(map(tuple, df.collect())) == [(1, "x"), (2, "y"), (3, "z")]


def test_names_differing_by_case(spark, tmp_path):
    path = write(tmp_path / "case.parquet", pa.table({"a": [1], "A": [2]}))
    df = L.load(spark, path)
    assert df.columns == ["a", "A_1"] and tuple(df.first()) == (1, 2)


def test_time_and_nanosecond_columns(spark, tmp_path, files):
    assert set(L.load(spark, str(files / "time.parquet")).columns) > {"a"}
    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    moment = dt.datetime(2024, 5, 6, 7, 8, 9, 123456)
    table = pa.table({"n": [7], "t": pa.array([moment], pa.timestamp("ns")),
                      "clock": pa.array([dt.time(1, 2, 3, 4)], pa.time64("us")),
                      "short": pa.array([dt.time(0, 0, 1)], pa.time32("ms"))})
    path = write(tmp_path / "ns.parquet", table)
    for _ in range(2):
        assert tuple(L.load(spark, path).first()) == (7, moment, 3723000004, 1000000)
    assert L.load(spark, f"{TESTDATA}/events.parquet").schema["event_id"].dataType.typeName() == "long"
    after = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    assert {k: v for k, v in after.items() if "arquet" in k} == {k: v for k, v in before.items() if "arquet" in k}
    out = str(tmp_path / "again")
    L.recompress(spark, path, out, "gzip")
    assert spark.read.parquet(out).schema["t"].dataType.typeName().startswith("timestamp")
    assert spark.read.parquet(out).first().t == moment


def test_a_folder_of_mixed_units(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    early = dt.datetime(1960, 1, 2, 3, 4, 5, 6)
    write(folder / "a.parquet", pa.table({"t": pa.array([early], pa.timestamp("us"))}))
    write(folder / "b.parquet", pa.table({"t": pa.array([early], pa.timestamp("ns"))}))
    assert [r.t for r in L.load(spark, str(folder), mixed_units=True).collect()] == [early, early]


def test_bucket_addresses_load_as_s3a():
    from lakelens.sources.load import hadoop_uri

    assert hadoop_uri("https://b.s3.amazonaws.com/k/x.parquet") == "s3a://b/k/x.parquet"
    assert hadoop_uri("https://my.b.s3.eu-west-1.amazonaws.com/k") == "s3a://my.b/k"
    with pytest.raises(ValueError):
        hadoop_uri("https://example.com/x.parquet")


def test_schema_drift(spark, tmp_path):
    for i, kind in enumerate((pa.int64(), pa.int64(), pa.string())):
        write(tmp_path / f"part-{i}.parquet", pa.table(
            {"id": [i], "v": pa.array([None], kind)}), row_group_size=1)
    rows = {(r.name, r.type): (r.files, r.drifted) for r in L.schema_drift(spark, str(tmp_path)).collect()}
    assert rows == {
        ("id", "int64"): (3, False), ("v", "int64"): (2, True), ("v", "string"): (1, True)}


def test_odd_column_names(spark, tmp_path):
    names = ['a"b', "a.b", "a`b", "select"]
    path = write(tmp_path / "odd.parquet", pa.table({n: [1, 2] for n in names}))
    df = L.load(spark, path)
    for name in names:
        spec = L.QuerySpec(columns=(name,), filters=(L.Filter(name, ">", "1"),), sorts=(L.Sort(name),))
        assert L.run_spec(df, spec).collect() == [(2,)]
        assert L.run(df, spec).df.columns == ["__row_id", name]
    assert L.profile(df).count() == 4
    assert L.page(df, 0).count() == 2


def test_types_file(spark, tmp_path):
    import decimal

    table = pa.table({
        "flag": pa.array([True, None]), "i8": pa.array([1, 2], pa.int8()),
        "u8": pa.array([1, 2], pa.uint8()), "u32": pa.array([1, 2], pa.uint32()),
        "u64": pa.array([1, 2**63], pa.uint64()), "f": pa.array([0.1, 2.0], pa.float32()),
        "d": pa.array([1e10, 0.25]), "dec": pa.array([decimal.Decimal("1.50"), None], pa.decimal128(38, 2)),
        "s": ["x", "y"], "bin": pa.array([b"1", b"2"]), "day": pa.array([dt.date(2020, 1, 2), None]),
        "ts": pa.array([dt.datetime(2020, 1, 2, 3, 4, 5), None], pa.timestamp("us")),
        "tz": pa.array([dt.datetime(2020, 1, 2, 3, 4, 5), None], pa.timestamp("us", "UTC")),
        "l": pa.array([[1, 2], None]), "st": pa.array([{"x": 1}, None]),
        "m": pa.array([[("k", 1)], None], pa.map_(pa.string(), pa.int64())),
    })
    df = L.load(spark, write(tmp_path / "types.parquet", table))
    types = {r.name: r.type for r in L.describe(df).collect()}
    assert types["u64"] == "decimal(20,0)" and types["ts"] == "timestamp_ntz" and types["u8"] == "smallint"
    prof = {r.name: r for r in L.profile(df).collect()}
    assert prof["bin"].min_val is None and prof["m"].min_val is None and prof["m"].null_count == 1
    assert prof["d"].max_val == "10,000,000,000" and prof["dec"].min_val == "1.5"
    assert prof["day"].min_val == "2020-01-02" and prof["flag"].distinct_count == 1
    from lakelens.functions.format import format_cells
    cells = format_cells(df).collect()[0].asDict()
    assert cells["d"] == "10000000000" and cells["f"] == "0.1" and cells["bin"] == "[blob]"
    assert cells["ts"] == "2020-01-02 03:04:05" and cells["day"] == "2020-01-02 00:00:00"
    assert cells["st"] == '{"x":1}' and cells["dec"] == "1.50" and cells["flag"] == "true"
    assert L.preview(df).columns == [c for c in df.columns if c != "bin"]


def test_scratch_folder_is_shared():
    from types import SimpleNamespace

    from lakelens.session import scratch_dir

    session = lambda conf: SimpleNamespace(conf=SimpleNamespace(
        get=lambda key, default=None: conf.get(key, default)))
    assert scratch_dir(session({"spark.checkpoint.dir": "s3a://b/c/"})) == "s3a://b/c"
    assert scratch_dir(session({"spark.master": "local[2]"})) != ""
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(session({"spark.master": "yarn"}))


def test_broadcast_is_bounded(spark):
    from lakelens.session import bounded_broadcast

    plan = lambda df: spark.range(10).join(df, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(bounded_broadcast(spark.range(10), 10))
    assert "strategy=broadcast" not in plan(bounded_broadcast(spark.range(11), 10))
