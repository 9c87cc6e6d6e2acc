import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import lakelens as L
from lakelens.operators import rows as rows_module
from lakelens.operators.ordering import natural_sort

TESTDATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(tmp_path):
    """Seven files of uneven length; ``n`` counts through them in file order."""
    n = 0
    for i, size in enumerate((5, 1, 0, 40, 3, 17, 9)):
        pq.write_table(
            pa.table({"n": pa.array(range(n, n + size), pa.int64()), "k": pa.array([1] * size, pa.int64())}),
            str(tmp_path / f"f{i}.parquet"), row_group_size=4)
        n += size
    return str(tmp_path)


def test_file_order_ids(spark, folder):
    df = L.load(spark, folder)
    for block in (3, 1000):
        got = L.with_row_id(df, block_rows=block).collect()
        assert sorted((r["__row_id"], r.n) for r in got) == [(i, i) for i in range(75)]
    kept = L.with_row_id(df.filter("n % 3 = 0"), block_rows=4).collect()
    assert sorted((r["__row_id"], r.n) for r in kept) == [(i, 3 * i) for i in range(25)]


def test_plain_scan_ids_need_no_shuffle_of_rows(spark, folder):
    df = L.load(spark, folder, view="data", row_id=True)
    assert sorted((r["__row_id"], r.n) for r in df.collect()) == [(i, i) for i in range(75)]
    assert spark.table("data").columns[0] == "__row_id"
    for piece in plan(df).split("Exchange hashpartitioning")[1:]:
        assert "HashAggregate" in piece.split("FileScan")[0]


def test_long_unsorted_prefix(spark, folder, monkeypatch):
    monkeypatch.setattr(rows_module, "TOP_ROWS", 10)
    df = L.load(spark, folder)
    assert sorted(r.n for r in L.sample_prefix(df, 30).collect()) == list(range(30))


def test_prefix_reads_leading_files(spark, folder):
    df = L.load(spark, folder)
    assert [r.n for r in L.sample_prefix(df, 7).collect()] == list(range(7))
    odd = df.filter("n % 2 = 1")
    assert [r.n for r in L.sample_prefix(odd, 30).collect()] == list(range(1, 60, 2))
    assert L.sample_prefix(df, 1000).count() == 75
    # Only the files holding the prefix are listed for the scan.
    assert L.sample_prefix(df, 5).select(F.input_file_name()).distinct().count() == 1


def test_sorted_ids_split_one_hot_value(spark, folder):
    """All rows share the sort key: the file position still cuts them apart."""
    df = L.load(spark, folder)
    got = L.with_row_id(df, [L.Sort("k")], block_rows=10)
    assert sorted((r["__row_id"], r.n) for r in got.collect()) == [(i, i) for i in range(75)]
    assert len(got.inputFiles()) > 3


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    values=st.lists(st.one_of(st.none(), st.integers(0, 4)), min_size=0, max_size=60),
    parts=st.integers(1, 6), block=st.integers(1, 50), desc=st.booleans(),
)
def test_ids_are_dense_for_any_partitioning(spark, values, parts, block, desc):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(parts)
    sorts = [L.Sort("v", "DESC" if desc else "ASC"), L.Sort("i")]
    got = sorted((r["__row_id"], r.v, r.i) for r in L.with_row_id(df, sorts, block).collect())
    key = lambda p: (p[1] is None, (-p[1] if desc else p[1]) if p[1] is not None else 0, p[0])
    assert [(v, i) for _, v, i in got] == [(v, i) for i, v in sorted(enumerate(values), key=key)]
    assert [g[0] for g in got] == list(range(len(values)))


def test_numbering_never_gathers_the_rows(spark):
    df = L.load(spark, f"{TESTDATA}/lineitem.parquet")
    for numbered in (L.with_row_id(df), L.with_row_id(df, [L.Sort("l_quantity")], 1000)):
        text = plan(numbered)
        # The only one-task exchange sits above the count per block.
        for piece in text.split("Exchange SinglePartition")[1:]:
            assert "HashAggregate" in piece.split("FileScan")[0]


def test_pages_join_to_the_full_sort(spark, monkeypatch):
    df = L.load(spark, f"{TESTDATA}/orders.parquet")
    expected = [r.o_orderkey for r in df.orderBy(F.col("o_totalprice").desc(), "o_orderkey").collect()]
    pages = lambda: [
        r for p in range(L.page_count(df, 400)) for r in sorted(
            L.page(df, p, 400, L.Sort("o_totalprice", "DESC")).collect(), key=lambda r: r["__row_id"])]
    for top in (rows_module.TOP_ROWS, 300):  # below, and beyond what a top-k may hold
        monkeypatch.setattr(rows_module, "TOP_ROWS", top)
        got = pages()
        assert [r["__row_id"] for r in got] == list(range(len(expected)))
        assert [r.o_orderkey for r in got] == expected


def test_unsorted_pages(spark, folder, monkeypatch):
    df = L.load(spark, folder)
    for top in (rows_module.TOP_ROWS, 5):
        monkeypatch.setattr(rows_module, "TOP_ROWS", top)
        got = [(r["__row_id"], r.n) for p in range(4) for r in L.page(df, p, 20).collect()]
        assert sorted(got) == [(i, i) for i in range(75)]
    numbered = L.with_row_id(df)
    assert sorted(r.n for r in L.numbered_page(numbered, 3, 20).collect()) == list(range(60, 75))
    assert L.page(df, -3, 20).agg(F.max("n")).first()[0] == 19
    assert L.page_count(df.limit(0)) == 0


def test_long_limit_takes_the_distributed_way(spark, monkeypatch):
    from lakelens.plans import spec as spec_module

    monkeypatch.setattr(spec_module, "TOP_ROWS", 100)
    df = L.load(spark, f"{TESTDATA}/orders.parquet")
    spec = L.QuerySpec(sorts=(L.Sort("o_orderkey", "DESC"),), limit=500, columns=("o_orderkey",))
    expected = [r[0] for r in df.select("o_orderkey").orderBy(F.desc("o_orderkey")).limit(500).collect()]
    assert [r[0] for r in L.run_spec(df, spec).collect()] == expected


def test_numbered_limits_without_a_sort(spark, folder, monkeypatch):
    from lakelens.plans import spec as spec_module

    df = L.load(spark, folder)
    for top in (rows_module.TOP_ROWS, 10):
        monkeypatch.setattr(spec_module, "TOP_ROWS", top)
        got = L.run(df, L.QuerySpec(filters=(L.Filter("n", ">=", 3),), limit=50)).df.collect()
        assert sorted((r["__row_id"], r.n) for r in got) == [(i, i + 3) for i in range(50)]


def test_sql_ids_follow_the_query_order(spark, folder):
    df = L.load(spark, folder)
    got = L.run_sql_numbered(spark, 'SELECT "n" FROM data ORDER BY n DESC;', {"data": df})
    assert sorted((r["__row_id"], r.n) for r in got.collect()) == [(i, 74 - i) for i in range(75)]
    assert "__row_id" not in L.run_sql_numbered(spark, "SHOW TABLES").columns
    assert "__row_id" not in L.run_sql_numbered(spark, "DESCRIBE data").columns


def test_natural_sort(spark):
    values = ["f10", "f9", "F1", "é2", "e10", None, "f" + "9" * 30, "f1" + "0" * 30, "f010"]
    df = spark.createDataFrame(list(enumerate(values)), "__row_id bigint, s string")
    up = [r.s for r in natural_sort(df, "s").collect()]
    assert up == ["é2", "e10", "F1", "f9", "f10", "f010", "f" + "9" * 30, "f1" + "0" * 30, None]
    down = [r.s for r in natural_sort(df, "s", "DESC").collect()]
    assert down == ["f1" + "0" * 30, "f" + "9" * 30, "f10", "f010", "f9", "F1", "e10", "é2", None]
    numbers = spark.createDataFrame([(0, 10), (1, 9), (2, None)], "__row_id bigint, s int")
    assert [r.s for r in natural_sort(numbers, "s").collect()] == [9, 10, None]


def test_scan_reads_only_what_is_shown(spark):
    df = L.load(spark, f"{TESTDATA}/lineitem.parquet")
    spec = L.QuerySpec(columns=("l_orderkey",), filters=(L.Filter("l_quantity", ">", 10),), limit=10)
    text = plan(L.run_spec(df, spec))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double" in text  # and the place in the file
    assert "GreaterThan(l_quantity,10.0)" in text
    assert "TakeOrderedAndProject" in plan(L.run_spec(df, L.QuerySpec(sorts=(L.Sort("l_tax"),), limit=1000)))


def test_recent_distinct_limits_before_the_shuffle(spark):
    df = L.load(spark, f"{TESTDATA}/events.parquet")
    text = plan(L.recent_distinct(df, "user_id", "event_type", "ts", 2))
    assert "WindowGroupLimit" in text


def test_sorted_ids_of_short_blocks_get_no_task_each(spark):
    df = spark.range(3000).selectExpr("(id * 997) % 3001 AS v")
    got = L.with_row_id(df, [L.Sort("v")], block_rows=10)
    assert len(got.inputFiles()) <= 8
    rows = sorted((r["__row_id"], r.v) for r in got.collect())
    assert [i for i, _ in rows] == list(range(3000)) and [v for _, v in rows] == sorted(v for _, v in rows)
