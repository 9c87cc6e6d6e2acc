"""The block-wise plans give what plain windows give, with one very hot group."""

import random

import pytest
from pyspark.sql import functions as F

from lakelens.operators.windows import (
    Ordered,
    asof,
    largest_group,
    last_before,
    neighbours,
    quantiles,
    range_sum,
    ranks,
    running_sum,
)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(600):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        value = None if rng.random() < 0.1 else rng.randrange(5)
        data.append((i, key, rng.randrange(50), value))
    return spark.createDataFrame(data, "i int, k string, t int, v bigint").repartition(5).cache()


def both(rows, fn, order=("t", "i")):
    out = []
    for group_rows in (10_000, 0):
        ordered = Ordered(rows, ("k",), order, group_rows=group_rows, block_rows=37)
        out.append(sorted(map(repr, fn(ordered).collect())))
    return out


def test_group_size_decides(rows):
    assert largest_group(rows, ["k"]) > 300
    assert Ordered(rows, ("k",), ("t",), 300).small() is False
    assert Ordered(rows, ("k",), ("t",), 600).small() is True


@pytest.mark.parametrize("fn", [
    lambda o: running_sum(o, F.col("v"), "x"),
    lambda o: last_before(o, F.col("v"), "x"),
    lambda o: neighbours(o, "v", "a", "b", "c", "d"),
])
def test_split_equals_plain(rows, fn):
    plain, split = both(rows, lambda o: fn(o).select(*sorted(fn(o).columns)))
    assert plain == split and len(plain) == 600


def test_ranks_split_equals_plain(rows):
    plain, split = both(rows, lambda o: ranks(o, "v", tiles=7), order=("v", "i"))
    assert plain == split and len(plain) == 600


def test_quantiles_split_equals_plain(rows):
    known = rows.filter("v IS NOT NULL")
    plain, split = both(known, lambda o: quantiles(o, "v", {"q1": 0.1, "q5": 0.5, "q9": 0.93}),
                        order=("v",))
    assert plain == split and len(plain) == 4


def events(spark, rng, n, keys="abc"):
    data = [(i, rng.choice(keys), rng.randrange(40), rng.randrange(9)) for i in range(n)]
    return data, spark.createDataFrame(data, "id int, k string, s int, v bigint").select(
        "id", "k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "v")


def test_asof_and_range_by_brute_force(spark):
    rng = random.Random(3)
    left_rows, left = events(spark, rng, 80)
    right_rows, right = events(spark, rng, 60)
    for sizes in ({}, {"group_rows": 0, "block_rows": 11}):
        got = asof(left, right, "k", "ts", {"ts": "rts", "v": "rv"}, **sizes).collect()
        for r in got:
            _, k, s, _ = left_rows[r.id]
            older = [(t, v) for _, key, t, v in right_rows if key == k and t <= s]
            assert (r.rv if older else None) == (max(older)[1] if older else None)
        assert len(got) == 80
        sums = range_sum(left, right, "k", "ts", "id", F.col("v"), "5 SECONDS", "2 SECONDS", "n", **sizes)
        found = {r.id: r.n for r in sums.collect()}
        for i, k, s, _ in left_rows:
            assert found[i] == sum(v for _, key, t, v in right_rows if key == k and s - 5 <= t <= s + 2)


def test_multisets(spark):
    from collections import Counter

    from lakelens.operators.sets import except_all, intersect_all

    left = ["a"] * 50 + ["b"] * 3 + [None] * 4 + ["c"]
    right = ["a"] * 20 + ["b"] * 9 + [None]
    dl, dr = (spark.createDataFrame([(v,) for v in x], "v string") for x in (left, right))
    got = lambda df: Counter(r.v for r in df.collect())
    for run in (7, 1000):
        assert got(except_all(dl, dr, run)) == Counter(left) - Counter(right)
        assert got(intersect_all(dl, dr, run)) == Counter(left) & Counter(right)


def test_short_blocks_get_no_task_each(spark):
    """As many ranges as a shuffle has partitions, however many blocks there are."""
    df = spark.range(2000).selectExpr("id % 3 AS k", "(id * 997) % 2003 AS t")
    ordered = Ordered(df, ("k",), ("t",), group_rows=0, block_rows=10)
    assert len(ordered.numbered().inputFiles()) <= 8
    got = {(r.k, r.t): r.n for r in running_sum(ordered, F.lit(1), "n").collect()}
    assert len(got) == 2000 and max(got.values()) == 667
    assert quantiles(ordered, "t", {"q": 0.5}).count() == 3
