"""What free SQL can express, as DataFrame queries that hold at any group size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import lakelens as L
from lakelens.operators.sets import except_all, intersect_all
from lakelens.operators.windows import (
    Ordered,
    asof,
    neighbours,
    quantiles,
    range_sum,
    range_sums,
    ranks,
    running_sum,
)
from workload.registry import Tables, query

# Forces the block-wise plans that large groups get, on tables of any size.
SPLIT = {"group_rows": 0, "block_rows": 2048}


# ------------------------------------------------------------------- joins


@query("""
SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name""")
def inner_join(t: Tables) -> DataFrame:
    # Summed per customer map-side first: no customer's orders meet in one task.
    spent = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))
    joined = spent.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(
        F.sum("orders").alias("orders"), F.round(F.sum("total"), 2).alias("total"))


@query("""
SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY c_custkey""")
def left_join(t: Tables) -> DataFrame:
    # Orders are counted per customer before the join, not after it.
    counts = t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"))
    return t.customer.join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("""
SELECT p_partkey, p_brand, l_orderkey, l_linenumber FROM lineitem
RIGHT JOIN (SELECT * FROM part WHERE p_size < 10) ON l_partkey = p_partkey AND l_quantity > 49""", as_double=('l_orderkey', 'l_linenumber'))
def right_join(t: Tables) -> DataFrame:
    # Spark can split a hot key on the left of an inner join, not of a right one:
    # matches and lonely parts are found separately.
    lines = t.lineitem.filter("l_quantity > 49")
    parts = t.part.filter("p_size < 10")
    same = F.col("l_partkey") == F.col("p_partkey")
    shown = ["p_partkey", "p_brand", "l_orderkey", "l_linenumber"]
    lonely = parts.join(lines.select("l_partkey").distinct(), same, "left_anti")
    return lines.join(parts, same).select(shown).unionByName(
        lonely.select("p_partkey", "p_brand"), allowMissingColumns=True)


@query("""
SELECT coalesce(c_nationkey, s_nationkey) AS nation, customers, suppliers FROM
  (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1)
  FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal < 0 GROUP BY 1)
  ON c_nationkey = s_nationkey""", as_double=('nation', 'customers', 'suppliers'))
def full_join(t: Tables) -> DataFrame:
    customers = t.customer.filter("c_acctbal > 5000").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("customers"))
    suppliers = t.supplier.filter("s_acctbal < 0").groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("suppliers"))
    return customers.join(suppliers, F.col("c_nationkey") == F.col("s_nationkey"), "full").select(
        F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "customers", "suppliers")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(t: Tables) -> DataFrame:
    buyers = t.orders.select("o_custkey").distinct()
    return t.customer.join(
        buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS
  (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def anti_join(t: Tables) -> DataFrame:
    dear = t.orders.filter("o_totalprice > 300000").select("o_custkey").distinct()
    return t.customer.join(
        dear, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


_RANGE = """
SELECT p.event_id, count(c.event_id) AS clicks,
  CAST(coalesce(sum(CAST(c.value AS DECIMAL(18,2))), 0) AS DOUBLE) AS clicked
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
  ON c.user_id = p.user_id AND c.ts BETWEEN p.ts - INTERVAL 6 HOUR AND p.ts + INTERVAL 1 HOUR
GROUP BY p.event_id"""


def _range_join(t: Tables, **sizes) -> DataFrame:
    purchases = t.events.filter("event_type = 'purchase'")
    clicks = t.events.filter("event_type = 'click'")
    values = {"clicks": F.lit(1).cast("bigint"), "clicked": F.col("value").cast("decimal(18,2)")}
    sums = range_sums(purchases, clicks, "user_id", "ts", "event_id", values, "6 HOURS", "1 HOUR", **sizes)
    return sums.withColumn("clicked", F.col("clicked").cast("double"))


@query(_RANGE)
def range_join_sums(t: Tables) -> DataFrame:
    return _range_join(t)


@query(_RANGE)
def range_join_sums_split(t: Tables) -> DataFrame:
    return _range_join(t, **SPLIT)


_ASOF = """
SELECT p.event_id, p.ts, c.event_id AS click_id, c.ts AS click_ts
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
  ON p.user_id = c.user_id AND p.ts >= c.ts"""


def _asof(t: Tables, **sizes) -> DataFrame:
    purchases = t.events.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    clicks = t.events.filter("event_type = 'click'").select("user_id", "event_id", "ts")
    take = {"ts": "click_ts", "event_id": "click_id"}
    return asof(purchases, clicks, "user_id", "ts", take, **sizes).drop("user_id")


@query(_ASOF, as_double=('click_id',))
def asof_join(t: Tables) -> DataFrame:
    return _asof(t)


@query(_ASOF, as_double=('click_id',))
def asof_join_split(t: Tables) -> DataFrame:
    return _asof(t, **SPLIT)


# -------------------------------------------------------- subqueries, sets

_ABOVE = """
WITH mean AS (SELECT o_custkey AS k, avg(o_totalprice) AS m FROM orders GROUP BY o_custkey)
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
JOIN mean ON k = o_custkey WHERE o_totalprice > 1.5 * m
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)
  AND o_totalprice < (SELECT max(o_totalprice) FROM orders)"""


@query(_ABOVE)
def subqueries(t: Tables) -> DataFrame:
    distinct_lines = _ABOVE.replace(
        "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)",
        "o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25)")
    return L.run_sql(t.spark, distinct_lines, {"orders": t.orders, "lineitem": t.lineitem})


@query(_ABOVE)
def correlated_subqueries(t: Tables) -> DataFrame:
    # Some line exceeds 25 where the largest does: one row per order is enough.
    largest = t.lineitem.groupBy("l_orderkey").agg(F.max("l_quantity").alias("l_quantity"))
    return L.run_sql(t.spark, _ABOVE, {"orders": t.orders, "lineitem": largest})


@query("SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(t: Tables) -> DataFrame:
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


def _nations(t: Tables) -> tuple[DataFrame, DataFrame]:
    left = t.customer.filter("c_acctbal > 0").select(F.col("c_nationkey").alias("nation"))
    right = t.supplier.filter("s_acctbal > 0").select(F.col("s_nationkey").alias("nation"))
    return left, right


_LEFT = "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 0"
_RIGHT = "SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 0"


@query(f"{_LEFT} UNION {_RIGHT}")
def set_union(t: Tables) -> DataFrame:
    left, right = _nations(t)
    return left.union(right).distinct()


@query(f"{_LEFT} UNION ALL {_RIGHT}")
def set_union_all(t: Tables) -> DataFrame:
    left, right = _nations(t)
    return left.union(right)


@query(f"{_LEFT} INTERSECT {_RIGHT}")
def set_intersect(t: Tables) -> DataFrame:
    left, right = _nations(t)
    return left.distinct().intersect(right.distinct())


@query(f"{_LEFT} INTERSECT ALL {_RIGHT}")
def set_intersect_all(t: Tables) -> DataFrame:
    left, right = _nations(t)
    return intersect_all(left, right)


@query(f"{_RIGHT} EXCEPT {_LEFT.replace('> 0', '> 9500')}")
def set_except(t: Tables) -> DataFrame:
    _, right = _nations(t)
    rich = t.customer.filter("c_acctbal > 9500").select(F.col("c_nationkey").alias("nation"))
    return right.distinct().subtract(rich.distinct())


@query(f"{_LEFT} EXCEPT ALL {_RIGHT}")
def set_except_all(t: Tables) -> DataFrame:
    left, right = _nations(t)
    return except_all(left, right)


# ----------------------------------------------------------------- windows

_RANKS = """
SELECT p_partkey, p_brand, p_retailprice,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS row_number,
  rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS rank,
  dense_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS dense_rank,
  percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS percent_rank,
  ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS ntile
FROM (SELECT p_partkey, p_brand, round(p_retailprice, 0) AS p_retailprice FROM part)"""


def _ranks(t: Tables, **sizes) -> DataFrame:
    parts = t.part.select(
        "p_partkey", "p_brand", F.round("p_retailprice", 0).alias("p_retailprice"))
    return ranks(Ordered(parts, ("p_brand",), ("p_retailprice", "p_partkey"), **sizes),
                 "p_retailprice")


@query(_RANKS)
def ranking_windows(t: Tables) -> DataFrame:
    return _ranks(t)


@query(_RANKS)
def ranking_windows_split(t: Tables) -> DataFrame:
    return _ranks(t, **SPLIT)


_NEIGHBOURS = """
SELECT event_id, user_id,
  lag(value) OVER w AS previous, lead(value) OVER w AS next,
  first_value(value) OVER w AS earliest,
  last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


def _neighbours(t: Tables, **sizes) -> DataFrame:
    ordered = Ordered(t.events.select("event_id", "user_id", "ts", "value"),
                      ("user_id",), ("ts", "event_id"), **sizes)
    return neighbours(ordered, "value", "previous", "next", "earliest", "latest").drop("ts", "value")


@query(_NEIGHBOURS)
def analytic_windows(t: Tables) -> DataFrame:
    return _neighbours(t)


@query(_NEIGHBOURS)
def analytic_windows_split(t: Tables) -> DataFrame:
    return _neighbours(t, **SPLIT)


_RUNNING = """
SELECT event_id, user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (
  PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running
FROM events"""


def _running(t: Tables, **sizes) -> DataFrame:
    ordered = Ordered(t.events.select("event_id", "user_id", "ts", "value"),
                      ("user_id",), ("ts", "event_id"), **sizes)
    out = running_sum(ordered, F.col("value").cast("decimal(18,2)"), "running")
    return out.select("event_id", "user_id", F.col("running").cast("double").alias("running"))


@query(_RUNNING)
def running_window(t: Tables) -> DataFrame:
    return _running(t)


@query(_RUNNING)
def running_window_split(t: Tables) -> DataFrame:
    return _running(t, **SPLIT)


_TRAILING = """
SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts
  RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS DOUBLE) AS trailing FROM events"""


def _trailing(t: Tables, **sizes) -> DataFrame:
    out = range_sum(t.events, t.events, "user_id", "ts", "event_id",
                    F.col("value").cast("decimal(18,2)"), "1 DAY", "0 SECONDS", "trailing", **sizes)
    return out.withColumn("trailing", F.col("trailing").cast("double"))


@query(_TRAILING)
def range_frame_window(t: Tables) -> DataFrame:
    return _trailing(t)


@query(_TRAILING)
def range_frame_window_split(t: Tables) -> DataFrame:
    return _trailing(t, **SPLIT)


# -------------------------------------------------------------- aggregates

_SUMS = "count(*) AS n, sum(l_quantity) AS quantity"


@query(f"""
SELECT l_returnflag, l_linestatus, {_SUMS} FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_groups(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query(f"""
SELECT l_returnflag, l_linestatus, l_linenumber, {_SUMS} FROM lineitem
GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)""", as_double=('l_linenumber',))
def cube_groups(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query(f"""
SELECT l_returnflag, l_linenumber, {_SUMS} FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())""", as_double=('l_linenumber',))
def grouping_sets(t: Tables) -> DataFrame:
    return L.run_sql(
        t.spark,
        f"""SELECT l_returnflag, l_linenumber, {_SUMS} FROM data
            GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())""",
        {"data": t.lineitem},
    )


@query("""
SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned,
  count(DISTINCT l_partkey) AS parts, round(stddev_samp(l_quantity), 6) AS spread
FROM lineitem GROUP BY l_suppkey HAVING count(*) > 550""")
def having_filter_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.count_distinct("l_partkey").alias("parts"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("spread"),
    ).filter("n > 550")


_QUANTILES = """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS q2,
  round(quantile_cont(l_extendedprice, 0.9), 4) AS q9
FROM lineitem GROUP BY l_returnflag"""


def _quantiles(t: Tables, **sizes) -> DataFrame:
    lines = t.lineitem.select("l_returnflag", "l_extendedprice")
    ordered = Ordered(lines, ("l_returnflag",), ("l_extendedprice",), **sizes)
    out = quantiles(ordered, "l_extendedprice", {"q1": 0.25, "q2": 0.5, "q9": 0.9})
    return out.select("l_returnflag", *[F.round(q, 4).alias(q) for q in ("q1", "q2", "q9")])


@query(_QUANTILES)
def exact_quantiles(t: Tables) -> DataFrame:
    return _quantiles(t)


@query(_QUANTILES)
def exact_quantiles_split(t: Tables) -> DataFrame:
    return _quantiles(t, **SPLIT)


@query()
def approximate_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("parts"),
        F.percentile_approx("l_extendedprice", 0.5, 10_000).alias("median_price"))


# --------------------------------------------------------- scalar functions


@query(r"""
SELECT p_partkey, upper(p_name) AS loud, substring(p_brand, 7, 2) AS brand_no,
  regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked, split_part(p_name, ' ', 2) AS second_word,
  concat_ws('/', p_brand, p_type, CAST(p_size AS VARCHAR)) AS path,
  CAST(length(p_name) AS INTEGER) AS n, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded,
  CAST(strpos(p_name, 'ring') AS INTEGER) AS ring_at, reverse(p_type) AS backwards
FROM part""")
def string_functions(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.upper("p_name").alias("loud"), F.substring("p_brand", 7, 2).alias("brand_no"),
        F.regexp_replace("p_name", "[aeiou]", "*").alias("masked"),
        F.coalesce(F.get(F.split("p_name", " "), F.lit(1)), F.lit("")).alias("second_word"),
        F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("path"),
        F.length("p_name").alias("n"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        F.instr("p_name", "ring").alias("ring_at"), F.reverse("p_type").alias("backwards"),
    )


@query(r"""
SELECT lang, source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars,
  CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS pieces,
  CAST(sum(length(text) - length(replace(text, 'e', ''))) AS BIGINT) AS es,
  max(md5(text)) AS last_digest
FROM documents GROUP BY lang, source""")
def text_statistics(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.documents.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length(text)).alias("chars"),
        F.sum(F.size(F.split(text, " "))).alias("pieces"),
        F.sum(F.length(text) - F.length(F.replace(text, F.lit("e"), F.lit("")))).alias("es"),
        F.max(F.md5(text.cast("binary"))).alias("last_digest"),
    )


@query("""
SELECT date_trunc('month', o_orderdate) AS month, CAST(extract(dow FROM o_orderdate) AS INTEGER) AS dow,
  count(*) AS n, min(datediff('day', TIMESTAMP '1995-01-01', o_orderdate)) AS first_day,
  CAST(max(CAST(o_orderdate AS DATE) + 30) AS VARCHAR) AS due, max(CAST(extract(year FROM o_orderdate) AS INTEGER)) AS year
FROM orders GROUP BY 1, 2""".replace("min(datediff", "min(CAST(datediff").replace(
    "o_orderdate)) AS first_day", "o_orderdate) AS INTEGER)) AS first_day").replace(
    "date_trunc('month', o_orderdate)", "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)"))
def date_functions(t: Tables) -> DataFrame:
    day = F.col("o_orderdate")
    keyed = t.orders.select(
        "o_orderdate", F.date_trunc("month", day).cast("timestamp_ntz").alias("month"),
        (F.dayofweek(day) - 1).alias("dow"))
    return keyed.groupBy("month", "dow").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.datediff(day, F.lit("1995-01-01").cast("date"))).alias("first_day"),
        F.max(F.date_add(day.cast("date"), 30)).cast("string").alias("due"), F.max(F.year(day)).alias("year"),
    )


@query("""
SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS slot, event_type, count(*) AS n,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM events GROUP BY 1, 2""")
def time_slots(t: Tables) -> DataFrame:
    slot = F.window("ts", "15 minutes")["start"]
    return t.events.groupBy(slot.alias("slot"), "event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net,
  CAST(floor(l_quantity / 10) AS BIGINT) AS tens,
  CASE WHEN l_quantity > 40 THEN 'large' WHEN l_quantity > 20 THEN 'medium' ELSE 'small' END AS size,
  coalesce(nullif(l_linenumber, 1), 0) AS line, abs(l_tax - 0.04) > 0.02 AS odd_tax,
  greatest(l_discount, l_tax) AS larger, CAST(l_orderkey % 7 AS BIGINT) AS weekday
FROM lineitem""")
def math_conditionals(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(net, 4).alias("net"),
        F.floor(q / 10).alias("tens"),
        F.when(q > 40, "large").when(q > 20, "medium").otherwise("small").alias("size"),
        F.coalesce(F.nullif("l_linenumber", F.lit(1)), F.lit(0)).alias("line"),
        (F.abs(F.col("l_tax") - 0.04) > 0.02).alias("odd_tax"),
        F.greatest("l_discount", "l_tax").alias("larger"), (F.col("l_orderkey") % 7).alias("weekday"),
    )


@query("""
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))), 4) AS norm,
  list_min(embedding) AS lowest, list_max(embedding) AS highest,
  CAST(len(list_filter(embedding, lambda v: v > 0)) AS INTEGER) AS positive,
  CAST(len(embedding) AS INTEGER) AS dims, embedding[1] AS head,
  round(list_sum(list_transform(embedding[1:4], lambda v: CAST(v AS DOUBLE))), 5) AS head_sum
FROM embeddings""")
def array_functions(t: Tables) -> DataFrame:
    e = F.col("embedding")
    total = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda a, v: a + f(v.cast("double")))
    return t.embeddings.select(
        "vec_id", F.round(F.sqrt(total(e, lambda v: v * v)), 4).alias("norm"),
        F.array_min(e).alias("lowest"), F.array_max(e).alias("highest"),
        F.size(F.filter(e, lambda v: v > 0)).alias("positive"), F.size(e).alias("dims"),
        F.get(e, F.lit(0)).alias("head"),
        F.round(total(F.slice(e, 1, 4), lambda v: v), 5).alias("head_sum"),
    )


@query("""
SELECT o_orderstatus, CAST(cardinality(m) AS INTEGER) AS priorities, m['5-LOW'] AS low,
  array_to_string(list_sort(map_keys(m)), ',') AS names
FROM (SELECT o_orderstatus, map_from_entries(list((o_orderpriority, n))) AS m
      FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
      GROUP BY o_orderstatus)""")
def map_functions(t: Tables) -> DataFrame:
    # The list holds one entry per distinct priority, counted before.
    counts = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("o_orderstatus").agg(
        F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))
    return maps.select(
        "o_orderstatus", F.size("m").alias("priorities"), F.col("m")["5-LOW"].alias("low"),
        F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"))


@query("""
SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n,
  count(*) FILTER (WHERE json_extract_string(props, '$.missing') IS NULL) AS missing,
  max(json_extract_string(props, '$.k')) AS text
FROM events GROUP BY 1""")
def json_functions(t: Tables) -> DataFrame:
    keyed = t.events.select(
        F.from_json("props", "k int")["k"].alias("k"),
        F.get_json_object("props", "$.missing").alias("missing"),
        F.get_json_object("props", "$.k").alias("text"))
    return keyed.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("missing").isNull()).alias("missing"),
        F.max("text").alias("text"))


# ------------------------------------------------------------------ shapes


@query("""
SELECT pos, count(*) AS n, round(avg(CAST(v AS DOUBLE)), 6) AS mean, min(v) AS lowest FROM (
  SELECT unnest(embedding) AS v, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos FROM embeddings)
GROUP BY pos""")
def unnested_embeddings(t: Tables) -> DataFrame:
    items = t.embeddings.select(F.posexplode("embedding").alias("pos", "v"))
    return items.groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"),
        F.min("v").alias("lowest"))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(
    f"nullif(count(*) FILTER (WHERE event_type = '{k}'), 0) AS \"{k}\"" for k in _TYPES)
    + " FROM events GROUP BY user_id")
def pivoted_events(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").pivot("event_type", list(_TYPES)).agg(F.count(F.lit(1)))


@query("""
SELECT l_suppkey, 'discount' AS measure, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1
UNION ALL SELECT l_suppkey, 'tax', round(avg(l_tax), 6) FROM lineitem GROUP BY 1""")
def unpivoted_measures(t: Tables) -> DataFrame:
    long = t.lineitem.select("l_suppkey", F.col("l_discount").alias("discount"),
                             F.col("l_tax").alias("tax")).unpivot(
        ["l_suppkey"], ["discount", "tax"], "measure", "v")
    return long.groupBy("l_suppkey", "measure").agg(F.round(F.avg("v"), 6).alias("mean"))
