"""Typed filters."""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.sources.schema import field_of, is_numeric, quoted

_COMPARE = {
    "=": operator.eq,
    "!=": operator.ne,
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
}
NULL_TESTS = ("IS NULL", "IS NOT NULL")
TEXT_TESTS = ("LIKE", "NOT LIKE")
OPERATORS = (*_COMPARE, *TEXT_TESTS, *NULL_TESTS)

_NUMBER = re.compile(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?")


@dataclass(frozen=True)
class Filter:
    col: str
    op: str
    value: object = None

    def active(self) -> bool:
        """Filters without a column, or blank where a value is needed, are off."""
        if not self.col:
            return False
        return self.op in NULL_TESTS or (self.value is not None and str(self.value).strip() != "")


def typed_literal(value: object, dtype: T.DataType, name: str) -> Column:
    """The value as a literal of the column's type.

    A fraction given for an integer column stays a decimal, so ``qty > 2.5``
    keeps its meaning.
    """
    if is_numeric(dtype):
        text = str(value).strip()
        if not _NUMBER.fullmatch(text):
            raise ValueError(f"column {name!r} is numeric, {value!r} is not a number")
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return F.lit(float(text)).cast(dtype)
        if re.fullmatch(r"[-+]?\d+", text) and abs(int(text)) < 2**63:
            return F.lit(int(text))
        return F.lit(Decimal(text))
    if isinstance(dtype, T.StringType):
        return F.lit(str(value))
    return F.lit(value if not isinstance(value, str) else value.strip()).cast(dtype)


def predicate(df: DataFrame, rule: Filter) -> Column:
    if rule.op not in OPERATORS:
        raise ValueError(f"unknown operator {rule.op!r}; known: {OPERATORS}")
    dtype = field_of(df, rule.col).dataType
    col = F.col(quoted(rule.col))
    if rule.op == "IS NULL":
        return col.isNull()
    if rule.op == "IS NOT NULL":
        return col.isNotNull()
    if rule.op in TEXT_TESTS:
        if not isinstance(dtype, T.StringType):
            raise ValueError(f"{rule.op} needs a text column, {rule.col!r} is {dtype.simpleString()}")
        hit = col.like(str(rule.value))
        return ~hit if rule.op == "NOT LIKE" else hit
    return _COMPARE[rule.op](col, typed_literal(rule.value, dtype, rule.col))


def where(df: DataFrame, filters: list[Filter] | tuple[Filter, ...]) -> DataFrame:
    """Keep the rows all active filters accept."""
    active = [predicate(df, f) for f in filters if f.active()]
    return df.filter(reduce(operator.and_, active)) if active else df


def non_empty_list(col: Column, levels: int = 1) -> Column:
    """Guard for list access: the list, and its first list, have elements."""
    guard = F.size(col) > 0
    if levels > 1:
        guard = guard & (F.size(F.get(col, F.lit(0))) > 0)
    return F.coalesce(guard, F.lit(False))
