"""Oblique grids, shifted datums, registries of definition texts, and what detection counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import lakelens as L
from lakelens.functions.crs import ELLIPSOIDS, parse_definition
from lakelens.functions.definitions import registry_from_texts
from lakelens.functions.geometry import first_vertex, point
from lakelens.operators.detect import geometry_census
from workload.registry import Tables, query

SWISS = ("+proj=somerc +lat_0=46.952405555555556 +lon_0=7.439583333333333 +k_0=1 +x_0=2600000 +y_0=1200000 "
         "+ellps=bessel +towgs84=674.374,15.056,405.346 +units=m")
BRITISH = "+proj=longlat +ellps=airy +towgs84=446.448,-125.157,542.06,0.1502,0.247,0.8421,-20.4894"


def _shift_sql(points: str, ellipsoid: str, shift: tuple[float, ...]) -> str:
    """(o_orderkey, lon, lat) in degrees on WGS 84 of points on another ellipsoid, at height 0."""
    a, rf = ELLIPSOIDS[ellipsoid]
    es = (2 - 1 / rf) / rf
    tx, ty, tz, *rest = (*shift, *[0.0] * (7 - len(shift)))
    rx, ry, rz = (math.radians(r / 3600) for r in rest[:3])
    m = 1 + rest[3] * 1e-6
    wa, wrf = ELLIPSOIDS["WGS84"]
    wes, wb = (2 - 1 / wrf) / wrf, wa * (1 - 1 / wrf)
    return f"""
    WITH g AS (SELECT o_orderkey, radians(lon) AS l, radians(lat) AS p FROM ({points})),
    n AS (SELECT *, {a!r} / sqrt(1 - {es!r} * sin(p) * sin(p)) AS nu FROM g),
    c AS (SELECT o_orderkey, nu * cos(p) * cos(l) AS x, nu * cos(p) * sin(l) AS y, nu * (1 - {es!r}) * sin(p) AS z FROM n),
    s AS (SELECT o_orderkey, {tx!r} + {m!r} * (x - {rz!r} * y + {ry!r} * z) AS x,
        {ty!r} + {m!r} * ({rz!r} * x + y - {rx!r} * z) AS y, {tz!r} + {m!r} * ({rx!r} * y - {ry!r} * x + z) AS z FROM c),
    r AS (SELECT *, sqrt(x * x + y * y) AS r, atan2(z * {wa!r}, sqrt(x * x + y * y) * {wb!r}) AS t FROM s)
    SELECT o_orderkey, round(degrees(atan2(y, x)), 7) AS lon,
      round(degrees(atan2(z + {wes / (1 - wes) * wb!r} * pow(sin(t), 3), r - {wes * wa!r} * pow(cos(t), 3))), 7) AS lat FROM r"""


_SWISS_POINTS = """SELECT o_orderkey, 6.0 + (o_orderkey % 400) / 100.0 AS lon, 45.9 + (o_orderkey % 170) / 100.0 AS lat
    FROM orders"""
_ISLES = """SELECT o_orderkey, -7.5 + (o_orderkey % 930) / 100.0 AS lon, 49.9 + (o_orderkey % 1010) / 100.0 AS lat
    FROM orders"""


def _isometric(lat: Column, e: float) -> Column:
    return F.atanh(F.sin(lat)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(lat))


def _somerc_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Bessel degrees to metres of the Swiss grid, by the published forward steps."""
    a, rf = ELLIPSOIDS["bessel"]
    es = (2 - 1 / rf) / rf
    e, p0 = math.sqrt(es), math.radians(46.952405555555556)
    c = math.sqrt(1 + es * math.cos(p0) ** 4 / (1 - es))
    s0 = math.asin(math.sin(p0) / c)
    k = math.atanh(math.sin(s0)) - c * (math.atanh(math.sin(p0)) - e * math.atanh(e * math.sin(p0)))
    radius = a * math.sqrt(1 - es) / (1 - es * math.sin(p0) ** 2)
    ball = F.atan(F.sinh(F.lit(c) * _isometric(F.radians(lat), e) + F.lit(k)))
    turn = F.lit(c) * (F.radians(lon) - F.lit(math.radians(7.439583333333333)))
    up = F.asin(F.lit(math.cos(s0)) * F.sin(ball) - F.lit(math.sin(s0)) * F.cos(ball) * F.cos(turn))
    along = F.asin(F.cos(ball) * F.sin(turn) / F.cos(up))
    return F.lit(2_600_000.0) + F.lit(radius) * along, F.lit(1_200_000.0) + F.lit(radius) * F.atanh(F.sin(up))


def _spots(moved: DataFrame) -> DataFrame:
    spot = first_vertex(F.col("geom"))
    return moved.select("o_orderkey", F.round(spot["x"], 7).alias("lon"), F.round(spot["y"], 7).alias("lat"))


@query(_shift_sql(_SWISS_POINTS, "bessel", (674.374, 15.056, 405.346)))
def reprojected_swiss_grid(t: Tables) -> DataFrame:
    places = t.orders.select("o_orderkey", F.expr("6.0D + (o_orderkey % 400) / 100.0D").alias("lon"),
                             F.expr("45.9D + (o_orderkey % 170) / 100.0D").alias("lat"))
    x, y = _somerc_forward(F.col("lon"), F.col("lat"))
    return _spots(L.reproject(places.select("o_orderkey", point(x, y).alias("geom")), crs=parse_definition(SWISS)))


@query(_shift_sql(_ISLES, "airy", (446.448, -125.157, 542.06, 0.1502, 0.247, 0.8421, -20.4894)))
def reprojected_shifted_datum(t: Tables) -> DataFrame:
    places = t.orders.select("o_orderkey", point(
        F.expr("-7.5D + (o_orderkey % 930) / 100.0D"), F.expr("49.9D + (o_orderkey % 1010) / 100.0D")).alias("geom"))
    return _spots(L.reproject(places, crs=parse_definition(BRITISH)))


# --------------------------------------------------------------- detection

_TEXTS = """CASE o_orderkey % 10 WHEN 0 THEN '{"x": 1.5, "y": 2, "spatialReference": {"wkid": 3857}}'
    WHEN 1 THEN '' WHEN 2 THEN '{"x": 1, "y": 2, "spatialReference": {"latestWkid": 4326}}' WHEN 3 THEN NULL
    WHEN 4 THEN 'no geometry' WHEN 5 THEN 'linestring z(0 0 1, 1 1 1)' ELSE 'POINT (1 2)' END"""


@query("""
WITH k AS (SELECT CASE o_orderkey % 10 WHEN 0 THEN 'esri' WHEN 1 THEN 'empty' WHEN 2 THEN 'esri' WHEN 4 THEN 'other'
    ELSE 'wkt' END AS kind, CASE o_orderkey % 10 WHEN 0 THEN 3857 WHEN 2 THEN 4326 END AS epsg
  FROM orders WHERE o_orderkey % 10 <> 3)
SELECT kind, epsg, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY kind, epsg""", as_double=("epsg",))
def geometry_kinds(t: Tables) -> DataFrame:
    return geometry_census(t.orders.select(F.expr(_TEXTS).alias("shape")), "shape")


@query("""
WITH n AS (SELECT count(*) FILTER (o_orderkey % 10 IN (0, 2)) AS esri, count(*) FILTER (o_orderkey % 10 > 4) AS wkt FROM orders)
SELECT CASE WHEN esri > wkt THEN 'esri' ELSE 'wkt' END AS encoding, esri > 0 AND wkt > 0 AS mixed FROM n""")
def detected_majority(t: Tables) -> DataFrame:
    info = L.detect_geometry(t.orders.select(F.expr(_TEXTS).alias("shape")), check_range=False)
    return t.spark.createDataFrame([(info.encoding, info.mixed)], "encoding string, mixed boolean")


@query("""
SELECT o_orderkey, CAST(32601 + o_orderkey % 61 AS INTEGER) AS epsg,
  CASE WHEN o_orderkey % 61 < 60 THEN 'tmerc' ELSE '' END AS kind,
  CASE WHEN o_orderkey % 61 < 60 THEN CAST(6 * (o_orderkey % 61) - 177 AS DOUBLE) END AS lon0 FROM orders""")
def crs_of_definition_texts(t: Tables) -> DataFrame:
    """A registry parsed from a table of texts; the last code has a text nobody supports."""
    zone = F.col("o_orderkey") % 61
    coded = t.orders.select("o_orderkey", (zone + 32601).cast("int").alias("epsg"), F.when(
        zone < 60, F.concat(F.lit("+proj=utm +datum=WGS84 +zone="), (zone + 1).cast("string"))).otherwise(
        F.lit("+proj=gnom +lat_0=90")).alias("definition"))
    registry = registry_from_texts(coded.select("epsg", "definition").distinct())
    found = L.with_crs(coded, registry)
    return found.select("o_orderkey", "epsg", F.coalesce("crs_params.kind", F.lit("")).alias("kind"),
                        F.round(F.degrees("crs_params.lon0"), 6).alias("lon0"))
