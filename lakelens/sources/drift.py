"""Folders whose files do not agree on a schema, read as one relation.

Footers are read in tasks and grouped by schema. Each group is read by Spark with its own
schema, pushdown and pruning included; its columns are cast to a common type up a
lattice of widenings, columns it lacks are null, and the groups are united. Names that
differ by case alone are one column, unless one file holds both.

A value that its common type cannot hold exactly (a long beyond 2**53 among doubles, say)
is not cast: the column is null there, and ``UNCAST`` names the column and keeps the
value as text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.operators.ordering import ROW_ID
from lakelens.operators.rows import _FILE, _POS, _offsets, with_position
from lakelens.session import bounded_broadcast
from lakelens.sources.footers import as_list, footers
from lakelens.sources.schema import quoted

UNCAST = "__uncast"
MAX_SCHEMAS = 200  # different schemas of one folder

_UNCAST_TYPE = "array<struct<name: string, value: string>>"

# Digits an integer of each type can have, in order of width.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_WIDTH = {t: i for i, t in enumerate(_DIGITS)}
_FLOATS = (T.FloatType, T.DoubleType)


class Irreconcilable(ValueError):
    """Two types without a common one."""


def _is_int(dtype: T.DataType) -> bool:
    return type(dtype) in _DIGITS


def _decimal(whole: int, scale: int) -> T.DataType:
    """Text beyond 38 digits: nothing narrower holds all values."""
    return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()


def _is_text_like(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.AtomicType) and not isinstance(dtype, (T.BinaryType, T.VariantType))


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type of the lattice that takes both."""
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return _common_struct(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType), a.containsNull or b.containsNull)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, common_type(a.valueType, b.valueType), a.valueContainsNull or b.valueContainsNull)
    if _is_int(a) and _is_int(b):
        return max(a, b, key=lambda t: _WIDTH[type(t)])
    if _is_int(b):
        a, b = b, a
    if _is_int(a) and isinstance(b, T.DecimalType):
        return _decimal(max(b.precision - b.scale, _DIGITS[type(a)]), b.scale)
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        return _decimal(max(a.precision - a.scale, b.precision - b.scale), max(a.scale, b.scale))
    numbers = [isinstance(t, (*_FLOATS, T.DecimalType)) or _is_int(t) for t in (a, b)]
    if all(numbers):
        return T.DoubleType()  # a floating type is among them
    days = [isinstance(t, T.DateType) for t in (a, b)]
    if any(days):
        other = b if days[0] else a
        if isinstance(other, (T.TimestampType, T.TimestampNTZType)):
            return other
    if _is_text_like(a) and _is_text_like(b):
        return T.StringType()
    raise Irreconcilable(f"{a.simpleString()} and {b.simpleString()}")


def _common_struct(a: T.StructType, b: T.StructType) -> T.StructType:
    out = {f.name.lower(): f for f in a.fields}
    for f in b.fields:
        if f.name.lower() in out:
            have = out[f.name.lower()]
            out[f.name.lower()] = T.StructField(have.name, common_type(have.dataType, f.dataType))
        else:
            out[f.name.lower()] = f
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in out.values()])


def converted(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """``value`` as the wider type, inside arrays, maps and structs as well."""
    if source == target:
        return value
    if isinstance(target, T.StructType):
        have = {f.name.lower(): f for f in source.fields}
        fields = [
            (converted(value[have[f.name.lower()].name], have[f.name.lower()].dataType, f.dataType)
             if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in target.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(target, T.ArrayType):
        return F.transform(value, lambda x: converted(x, source.elementType, target.elementType))
    if isinstance(target, T.MapType):
        return F.transform_values(value, lambda k, x: converted(x, source.valueType, target.valueType))
    return value.cast(target)


def loses_digits(value: Column, source: T.DataType, target: T.DataType) -> Column | None:
    """Whether a value does not survive the way to ``target`` and back; None: all do."""
    if not isinstance(target, T.DoubleType):
        return None
    if isinstance(source, T.LongType):
        # 2**63, to which the largest longs round, is no long
        back = F.when(value.cast("double") < 2.0**63, value.cast("double").try_cast(source))
    elif isinstance(source, T.DecimalType):
        back = value.cast("double").try_cast(source)
    else:
        return None
    return value.isNotNull() & ~F.coalesce(back == value, F.lit(False))


@dataclass(frozen=True)
class CastPlan:
    """How files of a folder become one relation."""

    target: T.StructType
    groups: list[tuple[T.StructType, list[str]]] = field(repr=False)

    def report(self, spark: SparkSession) -> DataFrame:
        """(name, type, files, target): how many files hold a column in which type."""
        found: Counter = Counter()
        for schema, files in self.groups:
            held = {f.name.lower() if self.folds() else f.name: f for f in schema.fields}
            for f in self.target.fields:
                mine = held.get(f.name.lower() if self.folds() else f.name)
                kind = mine.dataType.simpleString() if mine else None
                found[f.name, kind, f.dataType.simpleString()] += len(files)
        rows = [(name, kind, n, target) for (name, kind, target), n in found.items()]
        return spark.createDataFrame(rows, "name string, type string, files bigint, target string")

    def folds(self) -> bool:
        return all(len({n.lower() for n in s.names}) == len(s.names) for s, _ in self.groups)


def cast_plan(groups: list[tuple[T.StructType, list[str]]]) -> CastPlan:
    """The common schema of file groups, the group of most files first; its spelling of
    a name counts. Columns that only others hold follow in their order."""
    groups = sorted(groups, key=lambda g: (-len(g[1]), min(g[1])))
    plan = CastPlan(T.StructType([]), groups)
    key = (lambda n: n.lower()) if plan.folds() else (lambda n: n)
    out: dict[str, T.StructField] = {}
    for schema, files in groups:
        for f in schema.fields:
            have = out.get(key(f.name))
            try:
                kind = common_type(have.dataType, f.dataType) if have else f.dataType
            except Irreconcilable as clash:
                raise Irreconcilable(f"column {f.name!r} has no common type: {clash}, in {min(files)}") from None
            out[key(f.name)] = T.StructField(have.name if have else f.name, kind, True)
    return CastPlan(T.StructType(list(out.values())), groups)


def schema_groups(spark: SparkSession, paths: str | list[str]) -> list[list[str]]:
    """Paths of data files, those with equal column names and types together.

    Footers are read in tasks. A folder of one schema brings one path back; only where
    schemas differ are file names needed, since each group is handed to the reader.
    """
    data = footers(spark, paths).where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]"))
    shape = F.array_sort(F.transform("columns", lambda c: F.struct(c["name"], c["type"])))
    shaped = data.select("path", F.coalesce(F.to_json(shape), F.lit("")).alias("shape"))
    counts = shaped.groupBy("shape").agg(F.min("path").alias("path")).limit(MAX_SCHEMAS + 1).collect()
    if len(counts) > MAX_SCHEMAS:
        raise ValueError(f"more than {MAX_SCHEMAS} different schemas below {paths}")
    if len(counts) < 2:
        return [[r.path] for r in counts]
    found: dict[str, list[str]] = {}
    for r in shaped.orderBy("path").toLocalIterator():
        found.setdefault(r["shape"], []).append(r.path)
    unreadable = found.pop("", [])  # left to Spark's reader, which says what is wrong
    groups = sorted(found.values(), key=len, reverse=True)
    return [groups[0] + unreadable, *groups[1:]]


def read_groups(groups: list[list[str]], reader, row_id: bool = False) -> DataFrame:
    """The union of the groups in their common schema, with ``UNCAST`` if a value can be
    lost at all. ``reader(files)`` reads files of one schema. ``row_id`` numbers rows in
    file order, whatever group a file is of."""
    frames = {files[0]: reader(files) for files in groups}
    plan = cast_plan([(frames[files[0]].schema, files) for files in groups])
    parts = [_fitted(frames[files[0]], schema, plan, row_id) for schema, files in plan.groups]
    whole = reduce(DataFrame.unionByName, [p for p, _ in parts])
    whole = whole if any(risky for _, risky in parts) else whole.drop(UNCAST)
    if not row_id:
        return whole
    offsets = bounded_broadcast(_offsets(whole.groupBy(_FILE).agg(F.count(F.lit(1)).alias("n")), [_FILE]))
    kept = [F.col(quoted(c)) for c in whole.columns if c not in (_FILE, _POS)]
    return whole.join(offsets, _FILE).select((F.col("__before") + F.col(_POS)).alias(ROW_ID), *kept)


def _fitted(df: DataFrame, schema: T.StructType, plan: CastPlan, position: bool) -> tuple[DataFrame, bool]:
    place = []
    if position:
        df = with_position(df)  # rows of files keep their file; others are written first
        place = [F.col(_FILE), F.col(_POS)]
    key = (lambda n: n.lower()) if plan.folds() else (lambda n: n)
    held = {key(f.name): f for f in schema.fields}
    out, lost = [], []
    for f in plan.target.fields:
        mine = held.get(key(f.name))
        if mine is None:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        value = F.col(quoted(mine.name))
        bad = loses_digits(value, mine.dataType, f.dataType)
        new = converted(value, mine.dataType, f.dataType)
        if bad is not None:
            lost.append(F.when(bad, F.struct(F.lit(f.name).alias("name"), value.cast("string").alias("value"))))
            new = F.when(~bad, new)
        out.append(new.alias(f.name))
    uncast = F.array_compact(F.array(*lost)) if lost else F.array()
    return df.select(*place, *out, uncast.cast(_UNCAST_TYPE).alias(UNCAST)), bool(lost)


def uncast_values(df: DataFrame) -> DataFrame:
    """(name, value) of every value that kept its digits by not being cast."""
    if UNCAST not in df.columns:
        return df.sparkSession.createDataFrame([], "name string, value string")
    return df.select(F.inline(UNCAST))


def drift_report(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, type, files, target) of every column: what files hold, and what it becomes."""
    groups = schema_groups(spark, as_list(paths))
    if len(groups) == 1:  # a folder of one schema hands one path back
        groups = [[r.path for r in footers(spark, as_list(paths)).select("path").toLocalIterator()]]
    return cast_plan([(spark.read.parquet(files[0]).schema, files) for files in groups]).report(spark)
