"""Ordered computations per group that survive a group of any size.

A plain window sends a whole group to one task. That is the cheaper plan and is
used while the largest group is small enough (a count says so). Beyond that the
relation gets dense ids in (group, order), is cut into blocks of equal length,
and each block is computed on its own; what a block needs from earlier ones is
one small row per (group, block).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelens.operators.ordering import ROW_ID, Sort
from lakelens.operators.rows import BLOCK_ROWS, with_row_id
from lakelens.sources.schema import quoted

GROUP_ROWS = 4_000_000  # largest group left to a plain window

_BLOCK, _GROUP = "__block", "__group"


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Size of the biggest group: a map-side count, one number back."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n")).first()[0] or 0


@dataclass(frozen=True)
class Ordered:
    """A relation with groups and an order inside them (nulls last)."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    group_rows: int = GROUP_ROWS
    block_rows: int = BLOCK_ROWS

    def small(self) -> bool:
        return largest_group(self.df, list(self.keys)) <= self.group_rows

    def window(self):
        return Window.partitionBy(*self.keys).orderBy(
            *[F.col(quoted(c)).asc_nulls_last() for c in self.order]
        )

    def numbered(self) -> DataFrame:
        sorts = [Sort(c) for c in (*self.keys, *self.order)]
        return with_row_id(self.df, sorts, self.block_rows)


def _packed(keys: list[str]) -> Column:
    """Keys as one struct: never null itself, and equal where its nulls are."""
    return F.struct(*[F.col(quoted(k)) for k in keys])


def _same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    kept = [F.col(quoted(c)) for c in right.columns if c not in keys]
    return (
        left.withColumn(_GROUP, _packed(keys))
        .join(right.select(_packed(keys).alias(_GROUP), *kept), _GROUP, "left")
        .drop(_GROUP)
    )


def _blocks(ordered: Ordered) -> DataFrame:
    numbered = ordered.numbered()
    block = F.expr(f"{ROW_ID} div {ordered.block_rows}")
    return numbered.withColumns({_BLOCK: block, _GROUP: _packed(list(ordered.keys))})


def _block_windows(first: int, last: int):
    """The frame inside a block, and that of the blocks before it."""
    inside = Window.partitionBy(_BLOCK, _GROUP).orderBy(ROW_ID).rowsBetween(first, last)
    earlier = Window.partitionBy(_GROUP).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return inside, earlier


def running_sum(ordered: Ordered, value: Column, out: str) -> DataFrame:
    """Sum of ``value`` from the start of the group to the current row."""
    return running_sums(ordered, {out: value})


def running_sums(ordered: Ordered, sums: dict[str, Column]) -> DataFrame:
    """Several running sums (output name to value) in one order."""
    if ordered.small():
        frame = ordered.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return ordered.df.withColumns({out: F.sum(value).over(frame) for out, value in sums.items()})
    each = list(enumerate(sums))
    rows = _blocks(ordered).withColumns({f"__value{i}": sums[out] for i, out in each})
    inside, earlier = _block_windows(Window.unboundedPreceding, Window.currentRow)
    carry = rows.groupBy(_BLOCK, _GROUP).agg(*[F.sum(f"__value{i}").alias(f"__sum{i}") for i, _ in each]).select(
        _BLOCK, _GROUP, *[F.sum(f"__sum{i}").over(earlier).alias(f"__carry{i}") for i, _ in each])
    local = rows.withColumns({f"__local{i}": F.sum(f"__value{i}").over(inside) for i, _ in each})

    def total(i: int) -> Column:
        before = F.col(f"__carry{i}")
        return F.when(before.isNull(), F.col(f"__local{i}")).otherwise(
            before + F.coalesce(F.col(f"__local{i}"), F.lit(0)))

    own = [f"__{part}{i}" for i, _ in each for part in ("value", "local", "carry")]
    return (
        local.join(carry, [_BLOCK, _GROUP], "left")
        .withColumns({out: total(i) for i, out in each})
        .drop(_BLOCK, _GROUP, ROW_ID, *own)
    )


def last_before(ordered: Ordered, value: Column, out: str) -> DataFrame:
    """Latest non-null ``value`` of the group before the current row."""
    if ordered.small():
        frame = ordered.window().rowsBetween(Window.unboundedPreceding, -1)
        return ordered.df.withColumn(out, F.last(value, ignorenulls=True).over(frame))
    rows = _blocks(ordered).withColumn("__value", value)
    inside, earlier = _block_windows(Window.unboundedPreceding, -1)
    at = F.when(F.col("__value").isNotNull(), F.col(ROW_ID))
    carry = rows.groupBy(_BLOCK, _GROUP).agg(F.max_by("__value", at).alias("__last")).select(
        _BLOCK, _GROUP, F.last("__last", ignorenulls=True).over(earlier).alias("__carry"))
    local = rows.withColumn("__local", F.last("__value", ignorenulls=True).over(inside))
    return (
        local.join(carry, [_BLOCK, _GROUP], "left")
        .withColumn(out, F.coalesce("__local", "__carry"))
        .drop(_BLOCK, _GROUP, "__value", "__local", "__carry", ROW_ID)
    )


def neighbours(ordered: Ordered, value: str, lag: str, lead: str, first: str, last: str) -> DataFrame:
    """Previous, next, first and last ``value`` of the group."""
    keys = list(ordered.keys)
    val = F.col(quoted(value))
    if ordered.small():
        w = ordered.window()
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return ordered.df.select(
            "*",
            F.lag(val).over(w).alias(lag),
            F.lead(val).over(w).alias(lead),
            F.first(val).over(whole).alias(first),
            F.last(val).over(whole).alias(last),
        )
    rows = ordered.numbered()
    ends = rows.groupBy(*keys).agg(
        F.min(ROW_ID).alias("__lo"), F.max(ROW_ID).alias("__hi"),
        F.min_by(val, ROW_ID).alias(first), F.max_by(val, ROW_ID).alias(last),
    )
    # The neighbour of row i is row i - 1 or i + 1: equal ids, no group in sight.
    step = lambda d, name: rows.select(
        (F.col(ROW_ID) + d).alias(ROW_ID), val.alias(name))
    joined = rows.join(step(1, "__prev"), ROW_ID, "left").join(step(-1, "__next"), ROW_ID, "left")
    return (
        _same_keys(joined, ends, keys)
        .withColumn(lag, F.when(F.col(ROW_ID) > F.col("__lo"), F.col("__prev")))
        .withColumn(lead, F.when(F.col(ROW_ID) < F.col("__hi"), F.col("__next")))
        .select(*ordered.df.columns, lag, lead, first, last)
    )


def ranks(ordered: Ordered, value: str, tiles: int = 4) -> DataFrame:
    """row_number, rank, dense_rank, percent_rank and ntile by ``value``.

    ``order`` starts with ``value`` and ends with what breaks its ties.
    """
    keys = list(ordered.keys)
    by_value = Window.partitionBy(*keys).orderBy(F.col(quoted(value)).asc_nulls_last())
    if ordered.small():
        return ordered.df.select(
            "*",
            F.row_number().over(ordered.window()).cast("bigint").alias("row_number"),
            F.rank().over(by_value).cast("bigint").alias("rank"),
            F.dense_rank().over(by_value).cast("bigint").alias("dense_rank"),
            F.percent_rank().over(by_value).alias("percent_rank"),
            F.ntile(tiles).over(ordered.window()).cast("bigint").alias("ntile"),
        )
    rows = ordered.numbered()
    groups = rows.groupBy(*keys).agg(
        F.min(ROW_ID).alias("__lo"), F.count(F.lit(1)).alias("__n"))
    values = rows.groupBy(*keys, value).agg(F.min(ROW_ID).alias("__tie"))
    dense = with_row_id(values, [Sort(c) for c in (*keys, value)], ordered.block_rows)
    dense_lo = dense.groupBy(*keys).agg(F.min(ROW_ID).alias("__dense_lo"))
    tied = _same_keys(dense.withColumnRenamed(ROW_ID, "__dense"), dense_lo, keys)
    out = _same_keys(_same_keys(rows, tied, [*keys, value]), groups, keys)
    number = F.col(ROW_ID) - F.col("__lo") + 1
    rank = F.col("__tie") - F.col("__lo") + 1
    n, k = F.col("__n"), F.lit(tiles)
    small, extra = (n - n % k) / k, n % k
    big = extra * (small + 1)
    tile = F.when(number <= big, F.floor((number - 1) / (small + 1)) + 1).otherwise(
        extra + F.floor((number - 1 - big) / F.greatest(small, F.lit(1))) + 1)
    return out.select(
        *ordered.df.columns,
        number.cast("bigint").alias("row_number"),
        rank.cast("bigint").alias("rank"),
        (F.col("__dense") - F.col("__dense_lo") + 1).alias("dense_rank"),
        F.when(n > 1, (rank - 1) / (n - 1)).otherwise(F.lit(0.0)).alias("percent_rank"),
        tile.cast("bigint").alias("ntile"),
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    key: str,
    ts: str,
    take: dict[str, str],
    group_rows: int = GROUP_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    ``take`` maps right columns to output names. Both sides become one ordered
    relation (right rows first at equal times), so nothing is paired. Among
    right rows of equal time the greatest in ``take`` order wins.
    """
    packed = F.struct(*[F.col(quoted(c)).alias(o) for c, o in take.items()])
    rights = right.select(key, ts, packed.alias("__right"))
    rights = rights.withColumn("__side", F.lit(0)).withColumn("__left", F.lit(None).cast(left.schema))
    lefts = left.select(
        key, ts, F.lit(None).cast(rights.schema["__right"].dataType).alias("__right"),
        F.lit(1).alias("__side"), F.struct(*[F.col(quoted(c)) for c in left.columns]).alias("__left"),
    )
    both = rights.unionByName(lefts)
    ordered = Ordered(both, (key,), (ts, "__side", "__right"), group_rows, block_rows)
    found = last_before(ordered, F.col("__right"), "__found")
    return found.filter(F.col("__side") == 1).select(
        "__left.*", *[F.col("__found")[o].alias(o) for o in take.values()]
    )


def range_sums(
    probes: DataFrame,
    rows: DataFrame,
    key: str,
    ts: str,
    probe_id: str,
    values: dict[str, Column],
    before: str,
    after: str,
    group_rows: int = GROUP_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per probe: sums of ``values`` (output name to value) over rows of its key
    within [ts-before, ts+after].

    ``before`` and ``after`` are interval texts. A sum is the running sum at the end
    of the range less the one at its start; no probe meets its rows, and all sums
    share one order. Values should be of an exact type (integer or decimal).
    """
    moved = lambda sign, gap: F.col(ts) + F.expr(f"INTERVAL {gap}") * sign
    names = {out: f"__v{i}" for i, out in enumerate(values)}
    data = rows.select(
        key, F.col(ts).alias("__at"), F.lit(1).alias("__side"),
        F.lit(None).cast(probes.schema[probe_id].dataType).alias("__probe"),
        *[value.alias(names[out]) for out, value in values.items()],
    )
    none = [F.lit(None).cast(data.schema[v].dataType).alias(v) for v in names.values()]

    def ends(sign: int, gap: str, side: int) -> DataFrame:
        return probes.select(key, moved(sign, gap).alias("__at"), F.lit(side).alias("__side"),
                             F.col(probe_id).alias("__probe"), *none)

    line = data.unionByName(ends(-1, before, 0)).unionByName(ends(1, after, 2))
    ordered = Ordered(line, (key,), ("__at", "__side", "__probe"), group_rows, block_rows)
    summed = running_sums(ordered, {f"__sum{v}": F.col(v) for v in names.values()}).filter(F.col("__side") != 1)
    sign = F.when(F.col("__side") == 2, 1).otherwise(-1)
    return summed.groupBy(F.col("__probe").alias(probe_id)).agg(*[
        F.sum(F.coalesce(F.col(f"__sum{v}"), F.lit(0)) * sign).alias(out) for out, v in names.items()])


def range_sum(
    probes: DataFrame,
    rows: DataFrame,
    key: str,
    ts: str,
    probe_id: str,
    value: Column,
    before: str,
    after: str,
    out: str,
    group_rows: int = GROUP_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``range_sums`` of one value."""
    return range_sums(probes, rows, key, ts, probe_id, {out: value}, before, after, group_rows, block_rows)


def quantiles(ordered: Ordered, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per group, one column each.

    ``order`` starts with ``value``, which must not be null. The two rows around
    each quantile are fetched by id.
    """
    keys = list(ordered.keys)
    val = F.col(quoted(value)).cast("double")
    if ordered.small():
        shares = F.array(*[F.lit(float(p)) for p in probs.values()])
        found = ordered.df.groupBy(*keys).agg(F.percentile(val, shares).alias("__q"))
        return found.select(
            *keys, *[F.col("__q")[i].alias(name) for i, name in enumerate(probs)]
        )
    rows = ordered.numbered()
    groups = rows.groupBy(*keys).agg(
        F.min(ROW_ID).alias("__lo"), F.count(F.lit(1)).alias("__n"))
    wanted = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p"))
                  for n, p in probs.items()])
    )
    spots = groups.select(*keys, "__lo", "__n", wanted.alias("q")).withColumn(
        "at", (F.col("__n") - 1) * F.col("q.p")
    )
    ends = spots.select(
        *keys, F.col("q.name").alias("name"), (F.col("at") - F.floor("at")).alias("share"),
        F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("pos"), "__lo",
    ).distinct()
    found = ends.join(
        rows.select(F.col(ROW_ID).alias("__id"), val.alias("v")),
        F.col("__lo") + F.col("pos") == F.col("__id"),
    )
    between = F.min("v") + (F.max("v") - F.min("v")) * F.first("share")
    one = found.groupBy(*keys, "name").agg(between.alias("v"))
    return one.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in probs]
    )
