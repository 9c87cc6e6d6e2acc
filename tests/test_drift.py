"""Folders whose files differ in schema: common types, names, exact values, order."""

from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

import lakelens as L
from lakelens.sources.drift import Irreconcilable, common_type, drift_report, uncast_values
from workload import folders
from workload.registry import Tables

D, S = T.DecimalType, T.StringType()


@pytest.mark.parametrize("a, b, want", [
    (T.IntegerType(), T.LongType(), T.LongType()), (T.ByteType(), T.ShortType(), T.ShortType()),
    (T.LongType(), T.DoubleType(), T.DoubleType()), (T.FloatType(), T.DoubleType(), T.DoubleType()),
    (T.IntegerType(), D(5, 2), D(12, 2)), (T.LongType(), D(38, 30), S), (D(10, 2), D(8, 4), D(12, 4)),
    (D(10, 2), T.FloatType(), T.DoubleType()), (T.BooleanType(), T.IntegerType(), S), (S, T.DateType(), S),
    (T.DateType(), T.TimestampNTZType(), T.TimestampNTZType()),
    (T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType()), T.ArrayType(T.LongType())),
])
def test_lattice(a, b, want):
    assert common_type(a, b) == want == common_type(b, a)


def test_no_common_type():
    for a, b in ((T.BinaryType(), S), (T.ArrayType(S), S), (T.StructType([]), T.LongType())):
        with pytest.raises(Irreconcilable):
            common_type(a, b)


def write(folder, file, **columns):
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table(columns), str(folder / file))


@pytest.fixture
def folder(tmp_path):
    base = tmp_path / "a folder"
    write(base, "1.parquet", id=pa.array([1, 2**53 + 1, None], pa.int64()), name=["a", "b", "c"],
          at=pa.array([date(2024, 1, 1)] * 3), tags=pa.array([[1], None, []], pa.list_(pa.int32())))
    write(base, "2.parquet", id=pa.array([0.5, float("nan")], pa.float64()), Name=pa.array([7, None], pa.int32()),
          at=pa.array([datetime(2024, 1, 1, 5)] * 2, pa.timestamp("us")), tags=pa.array([[2**40], [None]], pa.list_(pa.int64())))
    write(base, "3.parquet", id=pa.array([Decimal("1.25")], pa.decimal128(5, 2)))
    write(base, "4.parquet", id=pa.array([9, -(2**63)], pa.int64()), name=["d", "e"], at=pa.array([None, None], pa.date32()),
          tags=pa.array([None, None], pa.list_(pa.int32())))
    return str(base)


def test_folder_of_drifted_files(spark, folder):
    df = L.load(spark, folder, view=None, row_id=True)
    assert {f.name: f.dataType.simpleString() for f in df.schema} == {
        "__row_id": "bigint", "id": "double", "name": "string", "at": "timestamp_ntz", "tags": "array<bigint>",
        "__uncast": "array<struct<name:string,value:string>>"}
    rows = df.orderBy("__row_id").collect()
    assert [r["__row_id"] for r in rows] == list(range(8))
    assert [r.id for r in rows if r.id == r.id] == [1.0, None, None, 0.5, 1.25, 9.0, -(2.0**63)]
    assert [r.name for r in rows] == ["a", "b", "c", "7", None, None, "d", "e"]
    assert rows[0].at == datetime(2024, 1, 1) and rows[3].at == datetime(2024, 1, 1, 5)
    assert [r.tags for r in rows] == [[1], None, [], [2**40], [None], None, None, None]
    assert [tuple(r) for r in uncast_values(df).collect()] == [("id", str(2**53 + 1))]


def test_filters_reach_each_group(spark, folder):
    plan = L.load(spark, folder, view=None).where("name = 'a'").select("name")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # the group without the column is not read at all
    assert "PushedFilters: [IsNotNull(name), EqualTo(name,a)]" in plan
    assert "ReadSchema: struct<name:string>" in plan


def test_report_and_switch(spark, folder):
    told = {(r.name, r.type): (r.files, r.target) for r in drift_report(spark, folder).collect()}
    assert told[("id", "bigint")] == (2, "double") and told[("id", "decimal(5,2)")] == (1, "double")
    assert told[("name", "int")] == (1, "string") and told[("name", None)] == (1, "string")
    assert set(L.load(spark, folder, view=None, unify=False).columns) == {"id", "name", "at", "tags"}


def test_names_that_differ_in_one_file_stay_apart(spark, tmp_path):
    base = tmp_path / "case"
    write(base, "1.parquet", v=[1, 2], w=["x", "y"])
    write(base, "2.parquet", v=[1.5], w=["z"], u=[True])
    df = L.load(spark, str(base), view=None, columns=["v", "u"])
    assert sorted(map(tuple, df.collect()), key=repr) == [(1.0, None), (1.5, True), (2.0, None)]


def test_partition_columns_survive(spark, tmp_path):
    base = tmp_path / "parts"
    base.mkdir()
    write(base / "p=1", "1.parquet", v=pa.array([1], pa.int64()))
    write(base / "p=2", "1.parquet", v=pa.array([2.5], pa.float64()))
    assert sorted(map(tuple, L.load(spark, str(base), view=None).select("p", "v").collect())) == [(1, 1.0), (2, 2.5)]


def test_clash_names_the_column(spark, tmp_path):
    base = tmp_path / "clash"
    write(base, "1.parquet", v=pa.array([b"x"], pa.binary()))
    write(base, "2.parquet", v=pa.array([1], pa.int64()))
    with pytest.raises(Irreconcilable, match="column 'v'"):
        L.load(spark, str(base), view=None)


@pytest.fixture
def wide_orders(tmp_path):
    """Orders whose keys are too large for the narrow types of some files."""
    keys = [1, 2, 3, 4, 5, 2**31 + 2, 2**31 + 3, 2**31 + 4, 8]
    pq.write_table(pa.table({
        "o_orderkey": pa.array(keys, pa.int64()),
        "o_custkey": pa.array([7, 32_767, 8, None, 32_768, 40_000, 50_000, 90_000, None], pa.int64()),
        "o_orderstatus": pa.array(["O"] * 9), "o_totalprice": pa.array([1.25] * 9),
        "o_orderdate": pa.array([datetime(2024, 1, 1)] * 9, pa.timestamp("us")), "o_orderpriority": pa.array(["1"] * 9),
    }), str(tmp_path / "orders.parquet"))
    return str(tmp_path), keys


def test_keys_too_large_for_a_narrow_file(spark, wide_orders):
    base, keys = wide_orders
    got = {r.o_orderkey: r for r in folders.drifted_folder(Tables(spark, base)).collect()}
    assert sorted(got) == sorted(keys)
    assert [got[k].o_custkey for k in keys] == [7, 32_767, 8, None, 32_768, 40_000, 50_000, 90_000, None]
    assert [got[k].o_totalprice for k in keys] == [None if k % 3 == 2 else 1.25 for k in keys]
    assert [got[k].o_orderstatus for k in keys] == ["O" if k % 3 == 2 else None for k in keys]


def test_numbers_of_a_folder_with_wide_keys(spark, wide_orders):
    base, keys = wide_orders
    row = folders.drifted_folder_numbered(Tables(spark, base)).first()
    assert (row.n, row.ids, row["first"], row["last"]) == (len(keys), len(keys), 0, len(keys) - 1)


def test_plan_of_a_folder_with_wide_keys(spark, wide_orders):
    found = {tuple(r) for r in folders.drifted_folder_plan(Tables(spark, wide_orders[0])).collect()}
    assert found == {
        ("o_orderkey", "bigint", "bigint"), ("o_orderkey", "int", "bigint"),
        ("o_custkey", "bigint", "double"), ("o_custkey", "double", "double"), ("o_custkey", "smallint", "double"),
        ("o_totalprice", "double", "double"), ("o_totalprice", "decimal(15,2)", "double"), ("o_totalprice", None, "double"),
        ("o_orderdate", "timestamp_ntz", "timestamp_ntz"), ("o_orderdate", "date", "timestamp_ntz"),
        ("o_orderdate", None, "timestamp_ntz"), ("o_orderstatus", "string", "string"), ("o_orderstatus", None, "string")}
