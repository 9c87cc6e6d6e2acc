"""Interval joins and sliding frames by brute force, plain and split, with hot places."""

import random

import pytest

from lakelens.operators import intervals
from lakelens.operators.intervals import contains, overlaps, points_in_ranges
from lakelens.operators.sliding import SLIDING_ROWS, _runs_of_blocks, sliding_distinct, sliding_extremes

SPLIT = {"group_rows": 0, "block_rows": 23}
SIZES = ({}, {**SPLIT, "block_points": 4, "hot_ranges": 6})


def spans(rng, n, hot=None):
    out = []
    for i in range(n):
        lo = hot if hot is not None and i % 3 == 0 else rng.randrange(60)
        out.append((i, rng.choice(["a", "a", "b", None]), lo, lo + rng.choice([0, 0, 1, 5, 30, -2])))
    return [*out, (n, "a", None, 5), (n + 1, "a", 5, None), out[0]]


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(11)
    left, right = spans(rng, 90, hot=20), spans(rng, 70)
    frame = lambda rows: spark.createDataFrame(rows, "id int, k string, lo int, hi int").repartition(3)
    return left, right, frame(left), frame(right)


def ids(df, *names):
    return sorted(tuple(r[n].id for n in names) for r in df.collect())


def known(r):
    return r[2] is not None and r[3] is not None and r[2] <= r[3]


@pytest.mark.parametrize("sizes", SIZES)
@pytest.mark.parametrize("closed", [True, False])
def test_overlaps(sides, sizes, closed):
    left, right, dl, dr = sides
    meets = (lambda a, b: a <= b) if closed else (lambda a, b: a < b)
    want = sorted((a[0], b[0]) for a in left for b in right if known(a) and known(b) and a[1] == b[1] and a[1] is not None
                  and meets(a[2], b[3]) and meets(b[2], a[3]))
    assert ids(overlaps(dl, dr, "lo", "hi", ["k"], closed, **sizes), "left", "right") == want
    free = sorted((a[0], b[0]) for a in left for b in right if known(a) and known(b)
                  and meets(a[2], b[3]) and meets(b[2], a[3]))
    assert ids(overlaps(dl, dr, "lo", "hi", (), closed, **sizes), "left", "right") == free


@pytest.mark.parametrize("sizes", SIZES)
def test_contains(sides, sizes):
    left, right, dl, dr = sides
    want = sorted((a[0], b[0]) for a in left for b in right if known(a) and known(b) and a[1] == b[1] and a[1] is not None
                  and a[2] <= b[2] and b[3] <= a[3])
    assert ids(contains(dl, dr, "lo", "hi", ["k"], **sizes), "outer", "inner") == want


@pytest.mark.parametrize("open_lo, open_hi", [(False, False), (True, False), (False, True), (True, True)])
def test_points_in_ranges(sides, open_lo, open_hi):
    left, right, dl, dr = sides
    over = (lambda p, lo: p > lo) if open_lo else (lambda p, lo: p >= lo)
    under = (lambda p, hi: p < hi) if open_hi else (lambda p, hi: p <= hi)
    want = sorted((p[0], r[0]) for p in left for r in right if None not in (p[2], r[2], r[3])
                  and over(p[2], r[2]) and under(p[2], r[3]))
    got = points_in_ranges(dl, dr, "lo", "lo", "hi", open_lo=open_lo, open_hi=open_hi, block_points=3, hot_ranges=5)
    assert ids(got, "point", "range") == want


def test_range_joins_pair_by_equality(sides):
    _, _, dl, dr = sides
    plan = overlaps(dl, dr, "lo", "hi", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    none = dl.limit(0)
    assert overlaps(none, dr, "lo", "hi").count() == overlaps(dl, none, "lo", "hi").count() == 0


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(5)
    rows = []
    for i in range(420):
        at = None if rng.random() < 0.05 else 40 if rng.random() < 0.3 else rng.randrange(120)
        rows.append((i, rng.choice(["hot"] * 6 + ["b", None]), at, None if rng.random() < 0.2 else rng.randrange(-50, 50)))
    return rows, spark.createDataFrame(rows, "id int, k string, t int, v int").repartition(4)


def frame(rows, r, before, after):
    same = [x for x in rows if x[1] == r[1]]
    if r[2] is None:
        return [x[3] for x in same if x[2] is None and x[3] is not None]
    return [x[3] for x in same if x[2] is not None and r[2] - before <= x[2] <= r[2] + after and x[3] is not None]


@pytest.mark.parametrize("sizes", [{}, SPLIT, {"group_rows": 0, "block_rows": 5}])
@pytest.mark.parametrize("before, after", [(7, 3), (0, 200)])
def test_sliding_frames(series, sizes, before, after):
    rows, df = series
    got = {r.id: (r.low, r.high) for r in sliding_extremes(df, ["k"], "t", "v", before, after, **sizes).collect()}
    many = {r.id: r.n for r in sliding_distinct(df, ["k"], "t", "v", before, after, "n", **sizes).collect()}
    assert len(got) == len(many) == len(rows)
    for r in rows:
        held = frame(rows, r, before, after)
        assert got[r[0]] == (min(held, default=None), max(held, default=None))
        assert many[r[0]] == (None if r[2] is None else len(set(held)))


def test_one_sided_and_empty(series):
    _, df = series
    assert sliding_extremes(df, ["k"], "t", "v", 1, 1, low=None, high="h", **SPLIT).columns == [*df.columns, "h"]
    assert sliding_extremes(df.limit(0), ["k"], "t", "v", 1, 1, **SPLIT).count() == 0
    assert sliding_distinct(df.limit(0), ["k"], "t", "v", 1, 1).count() == 0


def test_sliding_extremes_of_a_long_group_stay_in_short_blocks(spark):
    """No window goes over frames of a whole group or of a block as long as asked for."""
    n = 3 * SLIDING_ROWS
    df = spark.range(n).selectExpr("'a' AS k", "id AS t", "(id * 7919) % 10007 AS v")
    for sizes in ({}, {"group_rows": 0, "block_rows": 1 << 20}):
        out = sliding_extremes(df, ["k"], "t", "v", 2000, 900, **sizes)
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "__blk" in text and "windowspecdefinition(k#" not in text
        got = {r.t: (r.low, r.high) for r in out.collect()}
        assert len(got) == n
        for t in (0, 1, 255, 256, 2000, 5000, n - 901, n - 1):
            held = [(i * 7919) % 10007 for i in range(max(0, t - 2000), min(n, t + 901))]
            assert got[t] == (min(held), max(held))
    blocks = spark.range(1024).selectExpr(
        "struct('a') AS __grp", "id AS __blk", "id % 97 AS __val")
    runs = {(r["__level"], r["__blk"]): r["min"] for r in _runs_of_blocks(blocks, ["min"]).collect()}
    assert len(runs) == 11 * 1024
    assert all(low == min(i % 97 for i in range(b, min(1024, b + 2**j))) for (j, b), low in runs.items())


def test_ranges_are_copied_to_few_blocks(spark):
    """Ranges that hold many points meet blocks as long, and parts of a hot block are no smaller."""
    points = spark.range(400).selectExpr("id", "id AS at")
    ranges = spark.range(300).selectExpr("id", "0 AS lo", "399 AS hi")
    met = points_in_ranges(points, ranges, "at", "lo", "hi", block_points=4, hot_ranges=3)
    text = met._jdf.queryExecution().optimizedPlan().toString()
    assert "div 400" in text and "div 4)" not in text
    assert met.distinct().count() == met.count() == 400 * 300


def test_many_pairs_of_few_rows_are_dealt_over_tasks(spark, monkeypatch):
    points = spark.range(400).selectExpr("id", "id AS at")
    ranges = spark.range(300).selectExpr("id", "id AS lo", "id + 40 AS hi")
    monkeypatch.setattr(intervals, "TASK_PAIRS", 1000)
    met = points_in_ranges(points, ranges, "at", "lo", "hi")
    assert "hashpartitioning" in met._jdf.queryExecution().executedPlan().toString()
    assert "RepartitionByExpression" in met._jdf.queryExecution().optimizedPlan().toString()
    assert met.distinct().count() == met.count() == sum(min(399, i + 40) - i + 1 for i in range(300))


def test_pairs_are_written_in_a_fraction_of_a_byte(spark, tmp_path):
    """Pairs that outnumber their rows by far take little disk: stretches of points repeat."""
    points = spark.range(4000).selectExpr("xxhash64(id) AS id", "id AS at").repartition(5)
    ranges = spark.range(2500).selectExpr("xxhash64(-id) AS id", "id AS lo", "id + 900 + pmod(id * 37, 500) AS hi").repartition(5)
    met = points_in_ranges(points, ranges, "at", "lo", "hi")
    met.selectExpr("point.id AS p", "range.id AS r").write.option("compression", "snappy").parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    assert pairs.count() == pairs.distinct().count() == sum(901 + i * 37 % 500 for i in range(2500))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.4 * pairs.count()
    text = met._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize("sizes", SIZES)
def test_pairs_across_tiles_and_runs(sides, sizes, monkeypatch):
    """Ranges that begin, end or lie inside a tile, and runs cut anywhere, lose and repeat no pair."""
    monkeypatch.setattr(intervals, "TILE_POINTS", 3)
    monkeypatch.setattr(intervals, "RUN_RANGES", 2)
    left, right, dl, dr = sides
    want = sorted((a[0], b[0]) for a in left for b in right if known(a) and known(b) and a[2] <= b[3] and b[2] <= a[3])
    assert ids(overlaps(dl, dr, "lo", "hi", **sizes), "left", "right") == want
