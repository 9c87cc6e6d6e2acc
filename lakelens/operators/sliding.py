"""Minimum, maximum and distinct count over sliding RANGE frames, in groups of any size.

A plain window does minimum and maximum while the largest group is short: it goes over a
whole frame for every row. Beyond that, rows get dense ids in order of group and place and
are cut into short blocks, so that no row goes over more than a block. A frame that holds
its own row has up to four parts:

* what lies in the row's own block, by a plain window inside that block;
* the end of the block in which the frame begins, as that block's suffix extreme;
* the start of the block in which it ends, as a prefix extreme;
* the whole blocks between, as extremes of two runs of blocks of a power-of-two length,
  from a table with one short row per block.

Extremes may count a row twice, so the two runs may overlap; sums could not do so, and
running sums could not do extremes, which have no inverse.

A distinct count needs no frames. A value is present from ``after`` before to ``before``
after each of its rows; the places where it comes and goes are one event each, and the
count at a row is a running sum of events.
"""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.operators.ordering import ROW_ID, Sort
from lakelens.operators.rows import BLOCK_ROWS, with_row_id
from lakelens.operators.windows import (
    GROUP_ROWS,
    Ordered,
    _packed,
    largest_group,
    last_before,
    running_sum,
)
from lakelens.session import stage
from lakelens.sources.schema import quoted

SLIDING_ROWS = 4096  # largest group whose extremes are left to a plain window
FRAME_ROWS = 256  # rows of a block, which a frame inside it goes over one by one

_AT = "__at"


def _gap(spark: SparkSession, gap: str | int | float) -> str:
    """A distance as a frame's bound: a literal, and of one type for all units up to days."""
    if not isinstance(gap, str):
        return str(gap)
    if "month" in gap.lower() or "year" in gap.lower():
        return f"INTERVAL {gap}"
    length = spark.sql(f"SELECT CAST(INTERVAL {gap} AS INTERVAL DAY TO SECOND)").first()[0]
    seconds, micros = divmod(length // timedelta(microseconds=1), 10**6)
    return f"INTERVAL '{seconds // 86400} {seconds // 3600 % 24}:{seconds // 60 % 60}:{seconds % 60}.{micros:06d}' DAY TO SECOND"


def _number(gap: str | int | float) -> Column:
    """A distance along the order: a number, or an interval text."""
    return F.expr(f"INTERVAL {gap}") if isinstance(gap, str) else F.lit(gap)


def _extreme(name: str):
    return {"min": F.min, "max": F.max}[name]


def _better(name: str, *columns: Column) -> Column:
    """``least`` and ``greatest`` pass over nulls, as the aggregates do."""
    return F.least(*columns) if name == "min" else F.greatest(*columns)


def sliding_extremes(
    df: DataFrame,
    keys: list[str],
    at: str,
    value: str,
    before: str | int | float,
    after: str | int | float,
    low: str | None = "low",
    high: str | None = "high",
    group_rows: int = GROUP_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` with the least and greatest ``value`` among the rows of its group whose
    ``at`` lies within [at - before, at + after], neither of which may be negative.

    ``before`` and ``after`` are numbers or interval texts. Nulls of ``value`` count for
    nothing. Rows with a null ``at`` are a frame of their own, as in SQL. Groups and
    blocks are no longer than ``SLIDING_ROWS`` and ``FRAME_ROWS``, whatever is asked for.
    """
    wanted = {out: kind for out, kind in ((low, "min"), (high, "max")) if out}
    place, val = F.col(quoted(at)), F.col(quoted(value))
    ordered = Ordered(df, tuple(keys), (at,), min(group_rows, SLIDING_ROWS), block_rows)
    if ordered.small():
        back, ahead = (_gap(df.sparkSession, g) for g in (before, after))
        over = ", ".join(quoted(k) for k in keys)
        frame = (f"PARTITION BY {over} ORDER BY {quoted(at)} ASC NULLS LAST "
                 f"RANGE BETWEEN {back} PRECEDING AND {ahead} FOLLOWING")
        return df.withColumns({out: F.expr(f"{kind}({quoted(value)}) OVER ({frame})") for out, kind in wanted.items()})

    frame_rows = min(block_rows, FRAME_ROWS)
    rows = stage(with_row_id(df.withColumns({_AT: place, "__val": val}), [Sort(c) for c in (*keys, at)], block_rows)
                 .withColumns({"__blk": F.expr(f"{ROW_ID} div {frame_rows}"), "__grp": _packed(keys)}))
    spans = _frame_ids(rows, keys, _number(before), _number(after), group_rows, block_rows)
    spans = spans.withColumns({"__b0": F.expr(f"__l div {frame_rows}"), "__b1": F.expr(f"__r div {frame_rows}")})

    in_block = Window.partitionBy("__blk", "__grp").orderBy(ROW_ID)
    to_end = in_block.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    from_start = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.select(
        ROW_ID,
        *[_extreme(kind)("__val").over(to_end).alias(f"__s_{kind}") for kind in wanted.values()],
        *[_extreme(kind)("__val").over(from_start).alias(f"__p_{kind}") for kind in wanted.values()],
    )
    runs = _runs_of_blocks(rows, list(wanted.values()))

    # frames are the same for all rows of one place: each is looked up once
    found = spans.join(
        ends.select(F.col(ROW_ID).alias("__l"), *[F.col(f"__s_{k}") for k in wanted.values()]), "__l", "left"
    ).join(ends.select(F.col(ROW_ID).alias("__r"), *[F.col(f"__p_{k}") for k in wanted.values()]), "__r", "left")
    between = F.col("__b1") - F.col("__b0") - 1
    found = found.withColumn("__level", F.when(between > 0, F.floor(F.log2(between)).cast("int")))
    first, last = (
        runs.select(F.col("__grp"), F.col("__level"), F.col("__blk").alias(f"__{end}"),
                    *[F.col(k).alias(f"__{end}_{k}") for k in wanted.values()])
        for end in ("head", "tail"))
    found = (
        found.withColumns({"__head": F.col("__b0") + 1,
                           "__tail": F.col("__b1") - F.pow(F.lit(2), F.col("__level")).cast("bigint")})
        .join(first, ["__grp", "__level", "__head"], "left")
        .join(last, ["__grp", "__level", "__tail"], "left")
    )
    outside = {
        kind: _better(kind, *[F.col(f"{part}_{kind}") for part in ("__s", "__p", "__head", "__tail")])
        for kind in wanted.values()
    }
    found = found.select("__grp", _AT, "__b0", "__b1", *[c.alias(f"__out_{k}") for k, c in outside.items()])

    # the part in the own block, by a window that never leaves it
    own = f"(PARTITION BY __blk, __grp ORDER BY {_AT} ASC NULLS LAST " \
          f"RANGE BETWEEN {_gap(df.sparkSession, before)} PRECEDING AND {_gap(df.sparkSession, after)} FOLLOWING)"
    inside = rows.withColumns({f"__in_{k}": F.expr(f"{k}(__val) OVER {own}") for k in wanted.values()})
    # a null place finds no frame, so its rows of other blocks are added by themselves
    joined = inside.join(found, ["__grp", _AT], "left")
    crosses = F.col("__b0") < F.col("__b1")
    out = {name: F.when(crosses, _better(kind, F.col(f"__in_{kind}"), F.col(f"__out_{kind}")))
           .otherwise(F.col(f"__in_{kind}")) for name, kind in wanted.items()}
    nulls = rows.where(F.col(_AT).isNull()).groupBy("__grp").agg(
        *[_extreme(k)("__val").alias(f"__null_{k}") for k in wanted.values()])
    joined = joined.join(nulls, "__grp", "left")
    out = {name: F.when(F.col(_AT).isNull(), F.col(f"__null_{wanted[name]}")).otherwise(c) for name, c in out.items()}
    return joined.select(*[F.col(quoted(c)) for c in df.columns], *[c.alias(n) for n, c in out.items()])


def _frame_ids(rows: DataFrame, keys: list[str], before: Column, after: Column, group_rows: int, block_rows: int) -> DataFrame:
    """(__grp, __at, __l, __r): the first and last row id of each place's frame."""
    places = rows.where(F.col(_AT).isNotNull()).groupBy("__grp", _AT).agg(
        F.count(F.lit(1)).alias("n"))
    start = rows.groupBy("__grp").agg(F.min(ROW_ID).alias("__start"))
    # rows at a place are one event; frame ends are events before and after those
    event = lambda where, kind, n: places.select(
        "__grp", where.alias("__where"), F.lit(kind).alias("__kind"), F.col(_AT), n.alias("n"))
    line = (
        event(F.col(_AT), 1, F.col("n"))
        .union(event(F.col(_AT) - before, 0, F.lit(0).cast("bigint")))
        .union(event(F.col(_AT) + after, 2, F.lit(0).cast("bigint")))
    )
    ordered = Ordered(line, ("__grp",), ("__where", "__kind", _AT), group_rows, block_rows)
    seen = running_sum(ordered, F.col("n"), "__seen").where("__kind <> 1")
    ends = seen.groupBy("__grp", _AT).agg(
        F.max(F.when(F.col("__kind") == 0, F.col("__seen"))).alias("__first"),
        F.max(F.when(F.col("__kind") == 2, F.col("__seen"))).alias("__past"))
    return ends.join(start, "__grp").select(
        "__grp", _AT, (F.col("__start") + F.col("__first")).alias("__l"),
        (F.col("__start") + F.col("__past") - 1).alias("__r"))


def _runs_of_blocks(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """(__grp, __level, __blk, extremes): of the 2**level blocks that begin there.

    One short row per block and level. A run is two runs of the level below, and the
    blocks of a group follow each other without gaps.
    """
    blocks = stage(rows.groupBy("__grp", "__blk").agg(*[_extreme(k)("__val").alias(f"__{k}_0") for k in kinds]))
    most = largest_group(blocks, ["__grp"])
    levels = max(1, math.floor(math.log2(max(1, most))) + 1)
    line = Window.partitionBy("__grp").orderBy("__blk")
    wide = blocks
    for j in range(1, levels):
        wide = wide.withColumns({
            f"__{k}_{j}": _better(k, F.col(f"__{k}_{j - 1}"), F.lead(f"__{k}_{j - 1}", 2 ** (j - 1)).over(line))
            for k in kinds})
    each = [F.struct(F.lit(j).alias("__level"), *[F.col(f"__{k}_{j}").alias(k) for k in kinds]) for j in range(levels)]
    return wide.select("__grp", "__blk", F.inline(F.array(*each)))


def sliding_distinct(
    df: DataFrame,
    keys: list[str],
    at: str,
    value: str,
    before: str | int | float,
    after: str | int | float,
    out: str = "distinct",
    group_rows: int = GROUP_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` with the number of different non-null values among the rows of its group
    whose ``at`` lies within [at - before, at + after]; null where ``at`` is null.
    """
    back, ahead = _number(before), _number(after)
    whole = df.withColumns({_AT: F.col(quoted(at)), "__val": F.col(quoted(value)), "__grp": _packed(keys)})
    known = whole.where(F.col(_AT).isNotNull() & F.col("__val").isNotNull())
    shows = known.groupBy("__grp", "__val", _AT).agg(F.lit(1).alias("n"))  # repeats are one
    per_value = Ordered(shows, ("__grp", "__val"), (_AT,), group_rows, block_rows)
    shows = last_before(per_value, F.col(_AT), "__last")
    # it comes at the first place whose frame reaches it, and goes where the one before did no longer
    comes, gone = F.col(_AT) - ahead, F.col("__last") + back
    fresh = F.col("__last").isNull() | (gone < comes)
    event = lambda rows, where, kind, step: rows.select(
        "__grp", where.alias("__where"), F.lit(kind).alias("__kind"), F.lit(step).alias("__step"))
    final = shows.groupBy("__grp", "__val").agg(F.max(_AT).alias("__last"))
    events = (
        event(shows.where(fresh), comes, 0, 1)
        .union(event(shows.where(F.col("__last").isNotNull() & fresh), gone, 2, -1))
        .union(event(final, gone, 2, -1))
    )
    events = events.groupBy("__grp", "__where", "__kind").agg(F.sum("__step").alias("__step"))
    places = whole.where(F.col(_AT).isNotNull()).select(
        "__grp", F.col(_AT).alias("__where"), F.lit(1).alias("__kind"), F.lit(0).cast("bigint").alias("__step")).distinct()
    line = Ordered(events.union(places), ("__grp",), ("__where", "__kind"), group_rows, block_rows)
    counted = running_sum(line, F.col("__step"), out).where("__kind = 1").select(
        "__grp", F.col("__where").alias(_AT), out)
    return whole.join(counted, ["__grp", _AT], "left").select(*[F.col(quoted(c)) for c in df.columns], out)
