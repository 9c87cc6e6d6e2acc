"""The canonical geometry value and expressions over it.

A geometry is ``struct<type, parts>`` where ``parts`` is an array of parts, each
an array of rings, each an array of ``struct<x, y>``. Points and lines have one
part with one ring, polygons one part with many rings, multi-polygons many
parts. A geometry without vertices has no parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERTEX_TYPE = "struct<x: double, y: double>"
PARTS_TYPE = f"array<array<array<{VERTEX_TYPE}>>>"
GEOM_TYPE = f"struct<type: string, parts: {PARTS_TYPE}>"
DECODED_TYPE = f"struct<members: array<{GEOM_TYPE}>, error: string>"

# Geometry types by how many list levels their coordinates have. Fixed values.
DEPTH = {
    "Point": 0,
    "MultiPoint": 1,
    "LineString": 1,
    "MultiLineString": 2,
    "Polygon": 2,
    "MultiPolygon": 3,
}


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def make_geom(kind: Column | str, parts: Column) -> Column:
    """Geometry from a type and parts; parts holding no vertex are dropped."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    filled = F.filter(parts, lambda part: F.exists(part, lambda ring: F.size(ring) > 0))
    return F.struct(kind.alias("type"), filled.alias("parts")).cast(GEOM_TYPE)


def point(x: Column, y: Column) -> Column:
    return F.struct(
        F.lit("Point").alias("type"), F.array(F.array(F.array(vertex(x, y)))).alias("parts")
    )


def rings_of(geom: Column) -> Column:
    return F.flatten(geom["parts"])


def vertices(geom: Column) -> Column:
    """All vertices of a geometry as one array."""
    return F.flatten(rings_of(geom))


def first_ring(geom: Column) -> Column:
    return F.get(F.get(geom["parts"], F.lit(0)), F.lit(0))


def first_vertex(geom: Column) -> Column:
    return F.get(first_ring(geom), F.lit(0))


def map_vertices(parts: Column, fn: Callable[[Column], Column]) -> Column:
    """Apply ``fn`` to every vertex, keeping the nesting."""
    return F.transform(
        parts, lambda part: F.transform(part, lambda ring: F.transform(ring, fn))
    )


def geometry_class(geom: Column) -> Column:
    """point, line or polygon; null for anything else."""
    kind = geom["type"]
    return (
        F.when(kind.isin("Point", "MultiPoint"), "point")
        .when(kind.isin("LineString", "MultiLineString"), "line")
        .when(kind.isin("Polygon", "MultiPolygon"), "polygon")
    )


def representative_point(geom: Column) -> Column:
    """One vertex-like point per geometry.

    Points give themselves, multi-points and lines their middle vertex, the
    rest the mean of their first ring with its closing vertex counted.
    """
    ring = first_ring(geom)
    n = F.size(ring)

    def mean(axis: str) -> Column:
        total = F.aggregate(ring, F.lit(0.0), lambda acc, v: acc + v[axis])
        return total / n.cast("double")

    return (
        F.when(ring.isNull() | (n == 0), F.lit(None).cast(VERTEX_TYPE))
        .when(
            geom["type"].isin("Point", "MultiPoint", "LineString"),
            F.get(ring, F.floor(n / F.lit(2)).cast("int")),
        )
        .otherwise(vertex(mean("x"), mean("y")))
    )


def to_geojson(geom: Column) -> Column:
    """GeoJSON geometry text."""
    pair = lambda v: F.array(v["x"], v["y"])
    parts = map_vertices(geom["parts"], pair)
    part = F.coalesce(F.get(parts, F.lit(0)), F.array().cast("array<array<array<double>>>"))
    ring = F.coalesce(F.get(part, F.lit(0)), F.array().cast("array<array<double>>"))
    spot = F.coalesce(F.get(ring, F.lit(0)), F.array().cast("array<double>"))
    by_depth = {0: spot, 1: ring, 2: part, 3: parts}
    out = F.when(geom.isNull(), F.lit(None).cast("string"))
    for kind, depth in DEPTH.items():
        text = F.to_json(F.struct(F.lit(kind).alias("type"), by_depth[depth].alias("coordinates")))
        out = out.when(geom["type"] == kind, text)
    return out


def bounds_columns(geom: Column) -> dict[str, Column]:
    """Aggregates giving the bounds of every vertex of a geometry column."""
    # NaN is greater than all numbers, and no coordinate
    number = lambda a: F.filter(F.transform(vertices(geom), lambda v: v[a]), lambda c: ~F.isnan(c))
    xs, ys = number("x"), number("y")
    return {
        "min_x": F.min(F.array_min(xs)),
        "min_y": F.min(F.array_min(ys)),
        "max_x": F.max(F.array_max(xs)),
        "max_y": F.max(F.array_max(ys)),
    }


def extent(features: DataFrame, geom: str = "geom", by: str | list[str] | None = None) -> DataFrame:
    """Bounds over all features, or per group of ``by``."""
    aggs = [c.alias(name) for name, c in bounds_columns(F.col(geom)).items()]
    keys = [by] if isinstance(by, str) else list(by or [])
    return features.groupBy(*keys).agg(*aggs) if keys else features.agg(*aggs)
