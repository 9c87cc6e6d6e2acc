"""Geometry decoding, CRS, features: inputs are built from the given tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import lakelens as L
from lakelens import GeoInfo, QuerySpec, Sort
from lakelens.functions.crs import builtin_crs, parse_definition, utm
from lakelens.functions.decode import (
    esri_epsg,
    from_esri,
    from_geoarrow,
    from_wkb,
    from_wkt,
    looks_like_esri,
)
from lakelens.functions.geometry import (
    first_vertex,
    geometry_class,
    point,
    representative_point,
    to_geojson,
    vertices,
)
from lakelens.operators.detect import looks_geographic
from lakelens.operators.features import features as build_features
from lakelens.session import spread
from workload.registry import Tables, query

# Degrees spread over the globe by key; halves and quarters are exact doubles.
LON = "(CAST(o_orderkey % 360 AS DOUBLE) - 180 + 0.5)"
LAT = "(CAST(o_orderkey % 160 AS DOUBLE) - 79 + 0.25)"
SHAPES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")
KIND = "CASE o_orderkey % 6 " + " ".join(
    f"WHEN {i} THEN '{name}'" for i, name in enumerate(SHAPES)) + " END"


def placed(t: Tables) -> DataFrame:
    """Orders with a place (x, y) and a geometry type to build."""
    return spread(t.orders).select(
        "*", F.expr(LON).alias("x"), F.expr(LAT).alias("y"), F.expr(KIND).alias("kind"))


_PLACED = f"(SELECT *, {LON} AS x, {LAT} AS y, {KIND} AS kind FROM orders)"


def _text(value: str) -> str:
    return f"CAST(CAST({value} AS DECIMAL(9, 4)) AS STRING)"


def _pair(dx: float, dy: float) -> str:
    return f"{_text(f'x + {dx}')} || ' ' || {_text(f'y + {dy}')}"


# Corners per type, as lists of rings per part: the offsets from (x, y).
SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
HOLE = [(0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (0.25, 0.25)]
CORNERS = {
    "Point": [[[(0, 0)]]],
    "LineString": [[[(0, 0), (1, 0.5), (2, 0)]]],
    "Polygon": [[SQUARE, HOLE]],
    "MultiPoint": [[[(0, 0), (0.5, 0.5)]]],
    "MultiLineString": [[[(0, 0), (1, 1)], [(2, 2), (3, 1), (2, 1)]]],
    "MultiPolygon": [[SQUARE], [[(dx + 2, dy) for dx, dy in SQUARE], [
        (dx + 2, dy) for dx, dy in HOLE]]],
}


# Stored forms as templates: "@" stands for a corner, in the order of CORNERS.


def _wkt_template(kind: str) -> str:
    ring = lambda r: "(" + ", ".join("@" for _ in r) + ")"
    part = lambda p: "(" + ", ".join(map(ring, p)) + ")"
    parts = CORNERS[kind]
    if kind == "MultiPoint":
        body = "(" + ", ".join("(@)" for _ in parts[0][0]) + ")"
    elif kind in ("Point", "LineString"):
        body = ring(parts[0][0])
    elif kind == "MultiPolygon":
        body = "(" + ", ".join(map(part, parts)) + ")"
    else:
        body = part(parts[0])
    return f"{kind.upper()} {body}"


def _wkb_template(kind: str) -> str:
    """Hex of big-endian WKB."""
    head = lambda name: f"00{SHAPES.index(name) + 1:08X}"
    count = lambda items: f"{len(items):08X}"
    ring = lambda r: count(r) + "@" * len(r)
    part = lambda p: count(p) + "".join(map(ring, p))
    parts = CORNERS[kind]
    body = {
        "Point": lambda: "@",
        "LineString": lambda: ring(parts[0][0]),
        "Polygon": lambda: part(parts[0]),
        "MultiPoint": lambda: count(parts[0][0]) + (head("Point") + "@") * len(parts[0][0]),
        "MultiLineString": lambda: count(parts[0]) + "".join(
            head("LineString") + ring(r) for r in parts[0]),
        "MultiPolygon": lambda: count(parts) + "".join(head("Polygon") + part(p) for p in parts),
    }[kind]()
    return head(kind) + body


def _filled(template: str, kind: str, spot) -> Column:
    """A template with its corners written by ``spot``."""
    *prefixes, suffix = template.split("@")
    corners = [p for part in CORNERS[kind] for ring in part for p in ring]
    pieces = F.array(*[
        F.struct(F.lit(prefix).alias("text"), F.lit(float(dx)).alias("dx"), F.lit(float(dy)).alias("dy"))
        for prefix, (dx, dy) in zip(prefixes, corners, strict=True)
    ])
    written = F.transform(pieces, lambda c: F.concat(
        c["text"], spot(F.col("x") + c["dx"], F.col("y") + c["dy"])))
    return F.concat(F.array_join(written, ""), F.lit(suffix))


def _by_kind(build) -> Column:
    return reduce(
        lambda chain, k: chain.when(F.col("kind") == k, build(k)), SHAPES, F.when(F.lit(False), ""))


def _decimal(value: Column) -> Column:
    return value.cast("decimal(9,4)").cast("string")


def _wkt(kind: str) -> Column:
    return _filled(
        _wkt_template(kind), kind, lambda x, y: F.concat(_decimal(x), F.lit(" "), _decimal(y)))


def wkt() -> Column:
    return _by_kind(_wkt)


def _bits(value: Column) -> Column:
    """The 16 hex digits of a double (zero or at least 2^-20 in size)."""
    size = F.abs(value)
    power = F.floor(F.log2(size))
    fraction = ((size / F.pow(F.lit(2.0), power) - 1) * F.lit(float(2**52))).cast("bigint")
    sign = F.when(value < 0, F.lit(-(2**63))).otherwise(F.lit(0).cast("bigint"))
    word = sign.bitwiseOR(F.shiftleft((power + 1023).cast("bigint"), 52)).bitwiseOR(fraction)
    return F.when(value == 0, "0" * 16).otherwise(F.lpad(F.hex(word), 16, "0"))


def _wkb(kind: str) -> Column:
    hex_text = _filled(_wkb_template(kind), kind, lambda x, y: F.concat(_bits(x), _bits(y)))
    return F.unhex(hex_text)


def wkb() -> Column:
    return _by_kind(_wkb).cast("binary")


# ---------------------------------------------------------------- decoding


@query(f"SELECT o_orderkey, {LON} AS x, {LAT} AS y FROM orders")
def wkt_points(t: Tables) -> DataFrame:
    decoded = placed(t).select("o_orderkey", from_wkt(_wkt("Point")).alias("geom"))
    return decoded.select("o_orderkey", first_vertex(F.col("geom"))["x"].alias("x"),
                          first_vertex(F.col("geom"))["y"].alias("y"))


@query(f"SELECT o_orderkey, {LON} AS x, {LAT} AS y FROM orders")
def wkb_points(t: Tables) -> DataFrame:
    decoded = placed(t).select("o_orderkey", from_wkb(_wkb("Point")).alias("geom"))
    return decoded.select("o_orderkey", first_vertex(F.col("geom"))["x"].alias("x"),
                          first_vertex(F.col("geom"))["y"].alias("y"))


def _mean(points) -> tuple[float, float]:
    return tuple(sum(p[i] for p in points) / len(points) for i in (0, 1))


def _centre(kind: str) -> tuple[float, float]:
    ring = CORNERS[kind][0][0]
    if kind in ("Point", "MultiPoint", "LineString"):
        return ring[len(ring) // 2]
    return _mean(ring)


def _corner_list(kind: str) -> list:
    return [p for part in CORNERS[kind] for ring in part for p in ring]


def _per_kind(values: dict[str, object]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_SHAPE_SQL = f"""
SELECT o_orderkey, kind AS type, CAST({_per_kind({k: len(_corner_list(k)) for k in SHAPES})} AS INTEGER)
    AS vertices,
  {_per_kind({k: "'" + c + "'" for k, c in zip(SHAPES, (
      'point', 'line', 'polygon', 'point', 'line', 'polygon'))})} AS class,
  round(x + {_per_kind({k: repr(float(_centre(k)[0])) for k in SHAPES})}, 6) AS centre_x,
  round(y + {_per_kind({k: repr(float(_centre(k)[1])) for k in SHAPES})}, 6) AS centre_y,
  x + {_per_kind({k: repr(float(max(p[0] for p in _corner_list(k)))) for k in SHAPES})} AS max_x,
  round({_per_kind({k: len(_corner_list(k)) for k in SHAPES})} * y
    + {_per_kind({k: repr(float(sum(p[1] for p in _corner_list(k)))) for k in SHAPES})}, 6) AS sum_y
FROM {_PLACED}"""


def _shape_facts(decoded: DataFrame) -> DataFrame:
    geom = F.col("geom")
    rows = decoded.select("o_orderkey", "geom", representative_point(geom).alias("centre"),
                          vertices(geom).alias("v"))
    return rows.select(
        "o_orderkey", F.col("geom.type").alias("type"), F.size("v").alias("vertices"),
        geometry_class(geom).alias("class"),
        F.round("centre.x", 6).alias("centre_x"), F.round("centre.y", 6).alias("centre_y"),
        F.array_max(F.transform("v", lambda p: p["x"])).alias("max_x"),
        F.round(F.aggregate("v", F.lit(0.0), lambda a, p: a + p["y"]), 6).alias("sum_y"),
    )


@query(_SHAPE_SQL)
def wkt_shapes(t: Tables) -> DataFrame:
    return _shape_facts(placed(t).select("o_orderkey", from_wkt(wkt()).alias("geom")))


@query(_SHAPE_SQL)
def wkb_shapes(t: Tables) -> DataFrame:
    return _shape_facts(placed(t).select("o_orderkey", from_wkb(wkb()).alias("geom")))


def _nested(kind: str) -> Column:
    spot = lambda p: F.struct((F.col("x") + p[0]).alias("x"), (F.col("y") + p[1]).alias("y"))
    ring = lambda r: F.array(*map(spot, r))
    parts = CORNERS[kind]
    if kind == "Point":
        return spot(parts[0][0][0])
    if kind == "LineString":
        return ring(parts[0][0])
    part = lambda p: F.array(*map(ring, p))
    return part(parts[0]) if kind == "Polygon" else F.array(*map(part, parts))


_ARROW_KINDS = ("Point", "LineString", "Polygon", "MultiPolygon")


@query(f"SELECT * FROM ({_SHAPE_SQL}) WHERE type IN ('Point', 'LineString', 'Polygon', 'MultiPolygon')")
def geoarrow_shapes(t: Tables) -> DataFrame:
    rows = placed(t)
    frames = []
    for kind in _ARROW_KINDS:
        nested = rows.filter(F.col("kind") == kind).select("o_orderkey", _nested(kind).alias("g"))
        dtype = nested.schema["g"].dataType
        frames.append(nested.select("o_orderkey", from_geoarrow(F.col("g"), dtype).alias("geom")))
    return _shape_facts(reduce(DataFrame.unionByName, frames))


def _esri(kind: str) -> Column:
    """A multi-polygon has no Esri form: its rows carry the polygon's rings."""
    kind = "Polygon" if kind == "MultiPolygon" else kind
    ring = lambda r: "[" + ",".join("@" for _ in r) + "]"
    rings = "[" + ",".join(map(ring, CORNERS[kind][0])) + "]"
    body = {
        "Point": "@", "MultiPoint": '"points":' + ring(CORNERS[kind][0][0]),
        "LineString": f'"paths":{rings}', "MultiLineString": f'"paths":{rings}',
        "Polygon": f'"rings":{rings}',
    }[kind]
    if kind == "Point":
        spot = lambda x, y: F.concat(F.lit('"x":'), _decimal(x), F.lit(',"y":'), _decimal(y))
    else:
        spot = lambda x, y: F.concat(F.lit("["), _decimal(x), F.lit(","), _decimal(y), F.lit("]"))
    code = (F.col("o_orderkey") % 5 + 4322).cast("string")
    return F.concat(_filled("{" + body, kind, spot),
                    F.lit(',"spatialReference":{"wkid":'), code, F.lit("}}"))


def _esri_rows(t: Tables) -> DataFrame:
    """Every other row in the single-quoted form."""
    text = _by_kind(_esri)
    quoted = F.when(F.col("o_orderkey") % 2 == 0, F.translate(text, '"', "'")).otherwise(text)
    return placed(t).select("o_orderkey", quoted.alias("shape"))


@query(_SHAPE_SQL.replace(
    f"FROM {_PLACED}",
    f"FROM (SELECT * REPLACE (CASE kind WHEN 'MultiPolygon' THEN 'Polygon' ELSE kind END AS kind) "
    f"FROM {_PLACED})"))
def esri_shapes(t: Tables) -> DataFrame:
    return _shape_facts(_esri_rows(t).select("o_orderkey", from_esri(F.col("shape")).alias("geom")))


@query("""
SELECT o_orderkey, o_orderkey % 3 < 2 AS esri,
  CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderkey % 5 + 4322 AS INTEGER) END AS epsg FROM orders""", as_double=('epsg',))
def esri_sniffing(t: Tables) -> DataFrame:
    plain = F.when(F.col("o_orderkey") % 3 < 2, F.col("shape")).otherwise(
        F.lit('{"name":"not a shape"}'))
    rows = _esri_rows(t).select("o_orderkey", plain.alias("shape"))
    return rows.select("o_orderkey", looks_like_esri(F.col("shape")).alias("esri"),
                       esri_epsg(F.col("shape")).alias("epsg"))


@query(f"""
SELECT o_orderkey, member_idx, CASE member_idx WHEN 0 THEN 'Point' ELSE 'LineString' END AS type,
  x + member_idx AS first_x
FROM {_PLACED}, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS member_idx)""")
def exploded_collections(t: Tables) -> DataFrame:
    from lakelens.functions.decode import decode_wkt
    from lakelens.operators.features import explode_collections

    text = F.expr(f"""'GEOMETRYCOLLECTION (POINT (' || {_pair(0, 0)} || '), LINESTRING ('
        || {_pair(1, 0)} || ', ' || {_pair(2, 1)} || '))'""")
    decoded = placed(t).select("o_orderkey", decode_wkt(text).alias("__decoded"))
    return explode_collections(decoded).select(
        "o_orderkey", "member_idx", F.col("geom.type").alias("type"),
        first_vertex(F.col("geom"))["x"].alias("first_x"))


@query(f"""
SELECT o_orderkey, '{{"type":"LineString","coordinates":[[' || x || ',' || y || '],[' || (x + 1.0) || ','
  || (y + 0.5) || '],[' || (x + 2.0) || ',' || y || ']]}}' AS geojson
FROM {_PLACED}""")
def geojson_lines(t: Tables) -> DataFrame:
    rows = placed(t).select("o_orderkey", from_wkt(_wkt("LineString")).alias("geom"))
    return rows.select("o_orderkey", to_geojson(F.col("geom")).alias("geojson"))


# ------------------------------------------------------------- range, extent


def _mercator(x: Column, y: Column) -> Column:
    r = F.lit(6378137.0)
    return point(r * F.radians(x), r * F.log(F.tan(F.lit(math.pi / 4) + F.radians(y) / 2)))


@query(f"""
SELECT 'degrees' AS form, bool_and(abs(x) <= 180 AND abs(y) <= 90) AS geographic FROM {_PLACED}
UNION ALL SELECT 'metres', bool_and(abs(x * 111319.49) <= 180) FROM {_PLACED}""")
def degree_range(t: Tables) -> DataFrame:
    rows = placed(t)
    degrees = rows.select(F.struct("x", "y").alias("geometry"))
    metres = rows.select(first_vertex(_mercator(F.col("x"), F.col("y"))).alias("geometry"))
    geo = GeoInfo("geometry", "struct")
    return looks_geographic(degrees, geo, n=None).withColumn("form", F.lit("degrees")).unionByName(
        looks_geographic(metres, geo, n=None).withColumn("form", F.lit("metres")))


_FAR = f"{_per_kind({k: repr(float(max(p[0] for p in _corner_list(k)))) for k in SHAPES})}"
_HIGH = f"{_per_kind({k: repr(float(max(p[1] for p in _corner_list(k)))) for k in SHAPES})}"


@query(f"""
SELECT o_orderpriority, min(x) AS min_x, min(y) AS min_y, max(x + {_FAR}) AS max_x,
  max(y + {_HIGH}) AS max_y
FROM {_PLACED} GROUP BY o_orderpriority""")
def extent_by_group(t: Tables) -> DataFrame:
    rows = placed(t).select("o_orderpriority", from_wkt(wkt()).alias("geom"))
    return L.extent(rows, by="o_orderpriority")


@query(f"""
SELECT min(x) AS min_x, min(y) AS min_y, max(x + {_FAR}) AS max_x, max(y + {_HIGH}) AS max_y
FROM {_PLACED}""")
def extent_of_all(t: Tables) -> DataFrame:
    return L.extent(placed(t).select(from_wkb(wkb()).alias("geom")))


# --------------------------------------------------------------------- CRS

_ZONE = "CAST(floor((x + 180) / 6) + 1 AS INTEGER)"


def _utm_forward(x: Column, y: Column, zone: Column) -> Column:
    """Degrees to UTM metres by the forward series (the inverse is under test)."""
    f = 1 / 298.257223563
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    scale = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    sin = F.sin(F.radians(y))
    away = F.radians(x - (zone * 6 - 183))
    tau = F.sinh(F.atanh(sin) - F.lit(e) * F.atanh(F.lit(e) * sin))
    xi = F.atan2(tau, F.cos(away))
    eta = F.atanh(F.sin(away) / F.sqrt(1 + tau * tau))
    north, east = xi, eta
    for j, a in enumerate(alpha, start=1):
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return point(east * scale + 500000, north * scale + F.when(y < 0, 10000000.0).otherwise(0.0))


@query(f"""
SELECT o_orderkey, CASE WHEN kind LIKE 'Multi%' THEN 3857 WHEN y < 0 THEN 32700 + {_ZONE}
    ELSE 32600 + {_ZONE} END AS epsg,
  round(x, 7) AS lon, round(y, 7) AS lat, '' AS problem
FROM {_PLACED}""")
def reprojected_by_registry(t: Tables) -> DataFrame:
    zone = F.expr(_ZONE)
    multi = F.col("kind").like("Multi%")
    rows = placed(t).select(
        "o_orderkey",
        F.when(multi, F.lit(3857)).otherwise(
            zone + F.when(F.col("y") < 0, F.lit(32700)).otherwise(F.lit(32600))).alias("epsg"),
        F.when(multi, _mercator(F.col("x"), F.col("y"))).otherwise(
            _utm_forward(F.col("x"), F.col("y"), zone)).alias("geom"),
    )
    spot = first_vertex(F.col("geom"))
    return L.reproject(rows).select(
        "o_orderkey", "epsg", F.round(spot["x"], 7).alias("lon"), F.round(spot["y"], 7).alias("lat"),
        F.coalesce("geom_error", F.lit("")).alias("problem"))


@query(f"SELECT o_orderkey, round(x, 7) AS lon, round(y, 7) AS lat FROM {_PLACED}")
def reprojected_mercator(t: Tables) -> DataFrame:
    rows = placed(t).select("o_orderkey", _mercator(F.col("x"), F.col("y")).alias("geom"))
    spot = first_vertex(F.col("geom"))
    return L.reproject(rows, crs=3857).select(
        "o_orderkey", F.round(spot["x"], 7).alias("lon"), F.round(spot["y"], 7).alias("lat"))


@query(f"""
SELECT o_orderkey, round(CAST(o_orderkey % 7 AS DOUBLE) - 114, 7) AS lon, round(y, 7) AS lat
FROM {_PLACED} WHERE y > 0""")
def reprojected_utm_zone(t: Tables) -> DataFrame:
    rows = placed(t).filter("y > 0").withColumn("x", F.expr("CAST(o_orderkey % 7 AS DOUBLE) - 114"))
    moved = rows.select("o_orderkey", _utm_forward(F.col("x"), F.col("y"), F.lit(12)).alias("geom"))
    spot = first_vertex(F.col("geom"))
    return L.reproject(moved, crs=utm(12)).select(
        "o_orderkey", F.round(spot["x"], 7).alias("lon"), F.round(spot["y"], 7).alias("lat"))


def _authalic_q(lat: Column) -> Column:
    """The equal-area function of a latitude in radians, WGS 84."""
    e = math.sqrt(2 / 298.257223563 - 1 / 298.257223563**2)
    sin = F.sin(lat)
    return F.lit(1 - e * e) * (sin / (1 - F.pow(F.lit(e) * sin, F.lit(2.0))) + F.atanh(F.lit(e) * sin) / e)


def _equal_area_check(t: Tables, text: str, forward) -> DataFrame:
    """Points written by a forward formula, then moved back by the engine."""
    rows = placed(t).select("o_orderkey", forward(F.radians("x"), F.radians("y")).alias("geom"))
    spot = first_vertex(F.col("geom"))
    return L.reproject(rows, crs=parse_definition(text)).select(
        "o_orderkey", F.round(spot["x"], 6).alias("lon"), F.round(spot["y"], 6).alias("lat"))


@query(f"SELECT o_orderkey, round(x, 6) AS lon, round(y, 6) AS lat FROM {_PLACED}")
def reprojected_albers(t: Tables) -> DataFrame:
    e2 = 2 / 298.257223563 - 1 / 298.257223563**2
    m2 = lambda p: F.pow(F.cos(p), F.lit(2.0)) / (1 - F.lit(e2) * F.pow(F.sin(p), F.lit(2.0)))

    def forward(lon: Column, lat: Column) -> Column:
        p1, p2 = F.radians(F.lit(20.0)), F.radians(F.lit(50.0))
        cone = (m2(p1) - m2(p2)) / (_authalic_q(p2) - _authalic_q(p1))
        far = lambda q: F.lit(6378137.0) * F.sqrt(m2(p1) + cone * (_authalic_q(p1) - q)) / cone
        turn = cone * lon
        return point(far(_authalic_q(lat)) * F.sin(turn), far(F.lit(0.0)) - far(_authalic_q(lat)) * F.cos(turn))

    return _equal_area_check(t, "+proj=aea +lat_1=20 +lat_2=50 +lat_0=0 +lon_0=0", forward)


@query(f"SELECT o_orderkey, round(x, 6) AS lon, round(y, 6) AS lat FROM {_PLACED}")
def reprojected_azimuthal(t: Tables) -> DataFrame:
    def forward(lon: Column, lat: Column) -> Column:
        away = F.lit(6378137.0) * F.sqrt(_authalic_q(F.lit(math.pi / 2)) - _authalic_q(lat))
        return point(away * F.sin(lon), -away * F.cos(lon))

    return _equal_area_check(t, "+proj=laea +lat_0=90 +lon_0=0", forward)


_REGISTRY_SQL = ", ".join(
    f"({code}, '{name}', '{units}', {box[0]}, {box[1]}, {box[2]}, {box[3]})"
    for code, (name, _, units, box) in builtin_crs().items())
_CODE = "CAST(CASE WHEN o_orderkey % 4 = 0 THEN 32601 + o_orderkey % 60 WHEN o_orderkey % 4 = 1 " \
        "THEN 4326 WHEN o_orderkey % 4 = 2 THEN 3857 ELSE 2000 END AS INTEGER)"


@query(f"""
SELECT o_orderkey, c.code AS epsg, r.name AS crs_name, r.units AS crs_units
FROM (SELECT o_orderkey, {_CODE} AS code FROM orders) c
LEFT JOIN (VALUES {_REGISTRY_SQL}) r(epsg, name, units, x0, y0, x1, y1) ON r.epsg = c.code""")
def crs_lookup(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.expr(_CODE).alias("epsg"))
    return L.with_crs(rows, L.crs_registry(t.spark)).drop("crs_params")


@query(f"""
SELECT o_orderkey, CAST(rank AS INTEGER) AS rank, epsg FROM (
  SELECT o_orderkey, epsg, row_number() OVER (
      PARTITION BY o_orderkey ORDER BY (x1 - x0) * (y1 - y0), epsg) AS rank
  FROM {_PLACED} p
  JOIN (VALUES {_REGISTRY_SQL}) r(epsg, name, units, x0, y0, x1, y1)
    ON p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1) WHERE rank <= 4""")
def crs_suggestions(t: Tables) -> DataFrame:
    points = placed(t).select("o_orderkey", F.col("x").alias("lon"), F.col("y").alias("lat"))
    return L.suggest_crs(points, L.crs_registry(t.spark), k=4).select("o_orderkey", "rank", "epsg")


# ---------------------------------------------------------------- features

_GEO = GeoInfo("geometry", "wkt")
_ALL = QuerySpec(filters=(L.Filter("o_totalprice", ">", 100000),),
                 sorts=(Sort("o_totalprice", "DESC"), Sort("o_orderkey")), limit=None)
_NUMBERED = f"""(SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS __row_id, *
  FROM {_PLACED} WHERE o_totalprice > 100000)"""


def _mapped(t: Tables) -> DataFrame:
    """Orders with a text geometry; one row in eleven has an unreadable one."""
    text = F.when(F.col("o_orderkey") % 11 == 0, F.lit("POINT (nowhere)")).otherwise(wkt())
    return placed(t).select("o_orderkey", "o_orderpriority", "o_totalprice", text.alias("geometry"))


@query(f"""
SELECT __row_id, 0 AS member_idx, kind AS type, x AS first_x, y AS first_y, o_orderkey, o_totalprice
FROM {_NUMBERED} WHERE o_orderkey % 11 <> 0""")
def features_from_query(t: Tables) -> DataFrame:
    feats = L.features(_mapped(t), _GEO, _ALL)
    spot = first_vertex(F.col("geom"))
    return feats.select(
        "__row_id", "member_idx", F.col("geom.type").alias("type"), spot["x"].alias("first_x"),
        spot["y"].alias("first_y"), F.col("properties.o_orderkey"),
        F.col("properties.o_totalprice"))


@query(f"""
SELECT __row_id, round(x, 6) AS lon, round(y, 6) AS lat, o_orderkey FROM (
  SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS __row_id, o_orderkey,
    {LON} AS x, {LAT} AS y FROM orders)""")
def features_from_wkb_mercator(t: Tables) -> DataFrame:
    r = 6378137.0
    rows = placed(t).select(
        "o_orderkey", (F.lit(r) * F.radians("x")).alias("x"),
        (F.lit(r) * F.log(F.tan(F.lit(math.pi / 4) + F.radians("y") / 2))).alias("y"))
    stored = rows.select("o_orderkey", _wkb("Point").alias("geometry"))
    geo = GeoInfo("geometry", "wkb").with_epsg(3857)
    feats = L.features(stored, geo, QuerySpec(sorts=(Sort("o_orderkey"),)))
    spot = first_vertex(F.col("geom"))
    return feats.select("__row_id", F.round(spot["x"], 6).alias("lon"),
                        F.round(spot["y"], 6).alias("lat"), F.col("properties.o_orderkey"))


@query(f"""
SELECT __row_id, o_orderkey, o_totalprice, kind AS type FROM {_NUMBERED} WHERE o_orderkey % 11 <> 0""")
def features_joined_back(t: Tables) -> DataFrame:
    rows = _mapped(t)
    result = L.with_row_id(
        L.where(rows, _ALL.filters).select("o_orderkey", "o_totalprice"), _ALL.sorts)
    joined = L.join_features(result, L.features(rows, _GEO, _ALL))
    return joined.select("__row_id", "o_orderkey", "o_totalprice", F.col("geom.type").alias("type"))


@query(f"""
SELECT __row_id, '{{"type":"Feature","id":' || __row_id || ',"geometry":{{"type":"Point","coordinates":['
  || x || ',' || y || ']}},"properties":{{"o_orderkey":' || o_orderkey || ',"o_orderpriority":'
  || CASE WHEN o_orderpriority = '5-LOW' THEN 'null' ELSE '"' || o_orderpriority || '"' END
  || ',"__row_id":' || __row_id || '}}}}' AS feature
FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS __row_id, * FROM {_PLACED})""")
def feature_texts(t: Tables) -> DataFrame:
    rows = placed(t).select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        F.struct("x", "y").alias("geometry"))
    numbered = L.with_row_id(rows, [Sort("o_orderkey")])
    return L.features_json(build_features(numbered, GeoInfo("geometry", "struct")))


@query(f"""
SELECT __row_id, 'o_orderkey' AS key, CAST(o_orderkey AS VARCHAR) AS value, false AS is_null
FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS __row_id, * FROM {_PLACED})
UNION ALL
SELECT __row_id, 'o_orderpriority', nullif(o_orderpriority, '5-LOW'), o_orderpriority = '5-LOW'
FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS __row_id, * FROM {_PLACED})""")
def feature_attribute_rows(t: Tables) -> DataFrame:
    rows = placed(t).select(
        "o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
        F.struct("x", "y").alias("geometry"))
    numbered = L.with_row_id(rows, [Sort("o_orderkey")])
    return L.feature_attributes(build_features(numbered, GeoInfo("geometry", "struct")))
