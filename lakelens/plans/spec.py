"""The structured query: filters, grouping, sorting, limit, in that order."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lakelens.operators.aggregates import Agg, aggregate
from lakelens.operators.ordering import ROW_ID, Sort, sort_keys
from lakelens.operators.predicates import Filter, where
from lakelens.operators.rows import (
    TOP_ROWS,
    default_columns,
    limited_row_id,
    sample_prefix,
    select_visible,
    with_row_id,
)
from lakelens.sources.schema import quoted

DEFAULT_LIMIT = 1000


@dataclass(frozen=True)
class QuerySpec:
    mode: str = "select"
    columns: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    group_by: tuple[str, ...] = ()
    aggregates: tuple[Agg, ...] = ()
    sorts: tuple[Sort, ...] = ()
    limit: int | None = None
    widen_sums: bool = True
    keep: tuple[str, ...] = field(default=(), compare=False)  # shown although opaque

    def __post_init__(self):
        if self.mode not in ("select", "aggregate"):
            raise ValueError(f"mode is select or aggregate, not {self.mode!r}")
        if self.limit is not None and self.limit < 1:
            raise ValueError("limit is at least 1")


def _shaped(df: DataFrame, spec: QuerySpec) -> DataFrame:
    kept = where(df, spec.filters)
    if spec.mode == "aggregate":
        return aggregate(kept, list(spec.group_by), list(spec.aggregates), spec.widen_sums)
    names = [c for c in df.columns if c in set(default_columns(df)) | set(spec.keep)]
    return kept.select([F.col(quoted(c)) for c in names])


def _in_order(spec: QuerySpec) -> QuerySpec:
    """Groups have no file order: cut without a sort, they are sorted by their keys."""
    if spec.mode == "aggregate" and spec.limit is not None and not spec.sorts and spec.group_by:
        return replace(spec, sorts=tuple(Sort(c) for c in spec.group_by))
    return spec


def run_spec(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """The query's rows. Aggregates may be sorted by their alias.

    A limit without a sort takes the first rows in file order at every length, as
    ``run_spec_numbered`` does; aggregates are then in order of their groups.
    """
    spec = _in_order(spec)
    out = _shaped(df, spec)
    keys = sort_keys(out, spec.sorts)
    if spec.limit is None:
        out = out.orderBy(*keys) if keys else out
    elif spec.limit > TOP_ROWS:
        # A long prefix would be gathered in one place as a limit or top-k.
        ids = with_row_id(out, spec.sorts)
        out = ids.filter(F.col(ROW_ID) < spec.limit).orderBy(ROW_ID).drop(ROW_ID)
    elif keys:
        out = out.orderBy(*keys).limit(spec.limit)
    else:
        out = sample_prefix(out, spec.limit)
    return select_visible(out, list(spec.columns)) if spec.mode == "select" else out


def run_spec_numbered(df: DataFrame, spec: QuerySpec) -> DataFrame:
    """``run_spec`` with ``__row_id`` counting in result order."""
    spec = _in_order(spec)
    out = _shaped(df, spec)
    if spec.limit is not None and spec.sorts:
        numbered = limited_row_id(out, spec.sorts, spec.limit)
    elif spec.limit is not None and spec.limit <= TOP_ROWS:
        numbered = with_row_id(sample_prefix(out, spec.limit))
    else:
        numbered = with_row_id(out, spec.sorts)
        if spec.limit is not None:
            numbered = numbered.filter(F.col(ROW_ID) < spec.limit)
    if spec.mode == "aggregate" or not spec.columns:
        return numbered
    shown = [c for c in out.columns if c in spec.columns or c in spec.keep]
    return numbered.select(ROW_ID, *[F.col(quoted(c)) for c in shown])


def preview(df: DataFrame, n: int = DEFAULT_LIMIT) -> DataFrame:
    """What is shown on load: the first rows, without binary and geometry."""
    return sample_prefix(df.select([F.col(quoted(c)) for c in default_columns(df)]), n)


@dataclass(frozen=True)
class Result:
    """A query result: lazy rows, ordered columns, and timing on demand."""

    df: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def collect_timed(self, max_rows: int = TOP_ROWS) -> tuple[list[Row], int]:
        """(rows, elapsed ms). Refuses to pull more than ``max_rows``."""
        start = time.perf_counter()
        rows = self.df.limit(max_rows + 1).collect()
        if len(rows) > max_rows:
            raise ValueError(f"more than {max_rows} rows: write the result or give a limit")
        return rows, round((time.perf_counter() - start) * 1000)

    def run_timed(self) -> int:
        """Elapsed ms of computing every row where it lives, keeping none."""
        start = time.perf_counter()
        self.df.write.format("noop").mode("overwrite").save()
        return round((time.perf_counter() - start) * 1000)


def run(df: DataFrame, spec: QuerySpec) -> Result:
    return Result(run_spec_numbered(df, spec))
