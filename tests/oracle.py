"""Run registered queries next to their check SQL and compare whole results.

``python tests/oracle.py [name ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from workload.registry import TABLES  # noqa: E402


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(dtype: pa.DataType) -> str:
    text = str(dtype)
    for long, short in (("large_string", "string"), ("timestamp[us, tz=UTC]", "timestamp[us]"),
                        ("list<element:", "list<item:"), ("list<l:", "list<item:")):
        text = text.replace(long, short)
    return text


def compare(actual: pa.Table, expected: pa.Table) -> str | None:
    """What differs in names, types or rows (as multisets); None if nothing."""
    if sorted(actual.column_names) != sorted(expected.column_names):
        return f"columns {sorted(actual.column_names)} vs {sorted(expected.column_names)}"
    names = sorted(actual.column_names)
    for name in names:
        a, e = _plain(actual.schema.field(name).type), _plain(expected.schema.field(name).type)
        if a != e:
            return f"type of {name}: {a} vs {e}"
    if actual.num_rows != expected.num_rows:
        return f"{actual.num_rows} rows vs {expected.num_rows}"
    key = lambda t: sorted(
        zip(*[t.column(n).to_pylist() for n in names]), key=repr)
    for left, right in zip(key(actual), key(expected)):
        if repr(left) != repr(right):
            return f"row {dict(zip(names, left))} vs {dict(zip(names, right))}"
    return None


def check(spark, con, folder: str, name: str) -> str | None:
    import __spark_entry__ as entry

    actual = entry.queries()[name](spark, folder).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if actual.num_rows > 0 else "no rows"
    return compare(actual, con.sql(sql).to_arrow_table())


def main() -> None:
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    wrong = 0
    for name in sys.argv[1:] or e.queries():
        start = time.perf_counter()
        try:
            problem = check(spark, con, folder, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        wrong += problem is not None
        took = time.perf_counter() - start
        checked = "sql " if name in e.oracle_sql() else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {checked} {took:6.2f}s {name} {problem or ''}",
              flush=True)
    print(f"{wrong} failed")


if __name__ == "__main__":
    main()
