"""Folders that Spark writes from the given tables, with files that do not agree."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import lakelens as L
from lakelens.session import scratch_dir
from lakelens.sources.drift import drift_report, uncast_values
from workload.registry import TABLES, Tables, query


def _folder(t: Tables, name: str, parts: list[DataFrame]) -> str:
    base = f"{scratch_dir(t.spark)}/{name}-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(base)
    return base


def _fits(name: str, kind: str) -> Column:
    """Whether the narrower type holds a value; a null fits any."""
    return F.col(name).isNull() | F.col(name).try_cast(kind).isNotNull()


def _orders(t: Tables) -> str:
    """Orders as longs, as doubles and decimals in other spelling, and without a price.
    Keys too large for the narrow type of a file are longs in a file beside it."""
    third = lambda i: t.orders.where(F.col("o_orderkey") % 3 == i)
    short, small = _fits("o_orderkey", "int"), _fits("o_custkey", "smallint")
    others = [F.col("o_custkey").cast("double"), F.col("o_totalprice").cast("decimal(15,2)").alias("O_TotalPrice"),
              F.col("o_orderdate").cast("date")]
    return _folder(t, "drift", [
        third(0).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"),
        third(1).where(short).select(F.col("o_orderkey").cast("int"), *others),
        third(1).where(~short).select("o_orderkey", *others),
        third(2).where(small).select(F.col("o_custkey").cast("smallint"), "o_orderkey", "o_orderstatus"),
        third(2).where(~small).select("o_custkey", "o_orderkey", "o_orderstatus"),
    ])


@query("""
SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
  CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderdate END AS o_orderdate,
  CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus END AS o_orderstatus FROM orders""")
def drifted_folder(t: Tables) -> DataFrame:
    rows = L.load(t.spark, _orders(t), view=None).drop("__uncast")
    return rows.toDF(*[c.lower() for c in rows.columns])  # the spelling is that of most files


@query("""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT id) AS BIGINT) AS ids, min(id) AS first, max(id) AS last
FROM (SELECT row_number() OVER () - 1 AS id FROM orders)""")
def drifted_folder_numbered(t: Tables) -> DataFrame:
    rows = L.load(t.spark, _orders(t), view=None, row_id=True)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("__row_id").alias("ids"),
                    F.min("__row_id").alias("first"), F.max("__row_id").alias("last"))


@query("""
SELECT name, type, target FROM (VALUES
  ('o_orderkey', 'bigint', 'bigint'), ('o_orderkey', 'int', 'bigint'),
  ('o_custkey', 'bigint', 'double'), ('o_custkey', 'double', 'double'), ('o_custkey', 'smallint', 'double'),
  ('o_totalprice', 'double', 'double'), ('o_totalprice', 'decimal(15,2)', 'double'), ('o_totalprice', NULL, 'double'),
  ('o_orderdate', 'timestamp_ntz', 'timestamp_ntz'), ('o_orderdate', 'date', 'timestamp_ntz'),
  ('o_orderdate', NULL, 'timestamp_ntz'),
  ('o_orderstatus', 'string', 'string'), ('o_orderstatus', NULL, 'string')) AS v(name, type, target)
WHERE (SELECT count(*) FROM orders) > 0""")
def drifted_folder_plan(t: Tables) -> DataFrame:
    return drift_report(t.spark, _orders(t)).select(F.lower("name").alias("name"), "type", "target").distinct()


@query(" UNION ALL ".join(f"SELECT '{name}' AS table_name, 'ok' AS status" for name in TABLES))
def data_audit(t: Tables) -> DataFrame:
    """Every page of every table, read and decoded."""
    audit = L.audit_files(t.spark, [t.path(name) for name in TABLES], deep=True)
    return audit.select(F.regexp_extract("path", r"([^/]+)\.parquet", 1).alias("table_name"), "status").distinct()


#: Keys so large that half of them are no doubles.
_WIDE = "9007199254740992 + o_orderkey"


@query(f"""
SELECT o_orderpriority AS priority, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN o_orderkey % 2 = 1
    AND o_orderstatus = 'O' THEN 1 END) AS BIGINT) AS uncast,
  CAST(sum(CASE WHEN o_orderkey % 2 = 1 AND o_orderstatus = 'O' THEN {_WIDE} END) AS VARCHAR) AS kept
FROM orders GROUP BY o_orderpriority""")
def drifted_values_that_stay_exact(t: Tables) -> DataFrame:
    """Of longs among doubles those that a double cannot hold keep their digits as text."""
    rows = t.orders.select("o_orderpriority", "o_orderstatus", F.expr(_WIDE).alias("wide"))
    folder = _folder(t, "wide", [
        rows.where("o_orderstatus = 'O'").drop("o_orderstatus"),
        rows.where("o_orderstatus <> 'O'").select("o_orderpriority", F.lit(0.5).alias("wide"))])
    loaded = L.load(t.spark, folder, view=None)
    each = loaded.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("wide").isNull()).alias("uncast"))
    lost = loaded.select(F.col("o_orderpriority").alias("priority"), F.inline("__uncast")).groupBy("priority").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("kept"))
    assert uncast_values(loaded).columns == ["name", "value"]
    return each.join(lost, "priority", "left")
