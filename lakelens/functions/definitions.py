"""Registries of coordinate systems from tables of definition texts.

A text is a ``+proj`` definition or a PROJJSON object. Rows are parsed in tasks, a batch
at a time, so a registry is a DataFrame from storage like any other; a text that is not
understood gives a row without parameters and says why.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lakelens.functions.crs import REGISTRY_SCHEMA, UNITS, CrsDef, parse_definition
from lakelens.sources.schema import quoted

# PROJJSON method names and the projection each is. Fixed values.
METHODS = {
    "popular visualisation pseudo mercator": "webmerc",
    "mercator (variant a)": "merc",
    "mercator (variant b)": "merc",
    "transverse mercator": "tmerc",
    "lambert conic conformal (1sp)": "lcc",
    "lambert conic conformal (2sp)": "lcc",
    "albers equal area": "aea",
    "lambert azimuthal equal area": "laea",
    "polar stereographic (variant a)": "stere",
    "polar stereographic (variant b)": "stere",
    "oblique stereographic": "sterea",
    "equidistant cylindrical": "eqc",
    "hotine oblique mercator (variant a)": "omerc",
    "hotine oblique mercator (variant b)": "omerc",
    "cassini-soldner": "cass",
    "krovak": "krovak",
    "krovak (north orientated)": "krovak",
}

# PROJJSON parameter names and the field each sets. Fixed values.
PARAMETERS = {
    "latitude of natural origin": "lat0",
    "latitude of false origin": "lat0",
    "latitude of projection centre": "lat0",
    "longitude of natural origin": "lon0",
    "longitude of false origin": "lon0",
    "longitude of projection centre": "lon0",
    "longitude of origin": "lon0",
    "latitude of 1st standard parallel": "lat1",
    "latitude of 2nd standard parallel": "lat2",
    "latitude of standard parallel": "lat_ts",
    "latitude of pseudo standard parallel": "lat1",
    "co-latitude of cone axis": "alpha",
    "scale factor at natural origin": "k0",
    "scale factor at projection centre": "k0",
    "scale factor on pseudo standard parallel": "k0",
    "azimuth at projection centre": "alpha",
    "azimuth of initial line": "alpha",
    "angle from rectified to skew grid": "gamma",
    "false easting": "fe",
    "false northing": "fn",
    "easting at false origin": "fe",
    "northing at false origin": "fn",
    "easting at projection centre": "fe",
    "northing at projection centre": "fn",
}

_TERMS = ("x-axis translation", "y-axis translation", "z-axis translation",
          "x-axis rotation", "y-axis rotation", "z-axis rotation", "scale difference")

_FOOT = {"metre": 1.0, "meter": 1.0, "foot": UNITS["ft"], "us survey foot": UNITS["us-ft"], "degree": 1.0}


def _factor(unit: object) -> float:
    """Metres, or degrees, per unit."""
    if isinstance(unit, dict):
        factor = float(unit.get("conversion_factor", 1.0))
        return factor * 180 / 3.141592653589793 if unit.get("type") == "AngularUnit" else factor
    name = str(unit or "metre").lower()
    if name not in _FOOT:
        raise ValueError(f"unsupported: unit {unit}")
    return _FOOT[name]


def _ellipsoid(crs: dict) -> dict[str, float]:
    base = crs.get("base_crs", crs)
    datum = base.get("datum") or base.get("datum_ensemble") or {}
    shape = datum.get("ellipsoid", {})
    size = lambda v: float(v["value"]) * _factor(v.get("unit")) if isinstance(v, dict) else float(v)
    meridian = datum.get("prime_meridian", {}).get("longitude", 0)
    if size(meridian):
        raise ValueError("unsupported: prime meridian")
    if "radius" in shape:
        return {"a": size(shape["radius"]), "rf": 0.0}
    a = size(shape.get("semi_major_axis", 6378137.0))
    if "semi_minor_axis" in shape:
        b = size(shape["semi_minor_axis"])
        return {"a": a, "rf": a / (a - b) if a != b else 0.0}
    return {"a": a, "rf": float(shape.get("inverse_flattening", 298.257223563))}


def _axes(crs: dict) -> str:
    turn = {"east": "e", "west": "w", "north": "n", "south": "s"}
    axes = crs.get("coordinate_system", {}).get("axis", [])[:2]
    found = "".join(turn.get(str(a.get("direction")).lower(), "?") for a in axes)
    # polar systems name both axes after one direction: their order is east, north
    plain = len(found) < 2 or "?" in found or (found[0] in "ns") == (found[1] in "ns")
    return ("en" if plain else found) + "u"


def _shift(transformation: dict) -> tuple[float, ...]:
    terms = {str(p["name"]).lower(): float(p["value"]) for p in transformation.get("parameters", [])}
    if unknown := set(terms) - set(_TERMS):
        raise ValueError(f"unsupported: {', '.join(sorted(unknown))}")
    side = -1.0 if "coordinate frame" in str(transformation.get("method", {}).get("name", "")).lower() else 1.0
    return tuple(terms.get(t, 0.0) * (side if "rotation" in t else 1.0) for t in _TERMS)


def parse_projjson(crs: dict, shift: tuple[float, ...] = ()) -> CrsDef:
    """A PROJJSON object; anything not supported raises.

    Geographic systems are read as longitude, latitude: that is how stored coordinates
    are ordered, whatever the definition's own order is.
    """
    kind = crs.get("type")
    if kind == "BoundCRS":
        return parse_projjson(crs["source_crs"], _shift(crs.get("transformation", {})))
    if kind in ("GeographicCRS", "GeodeticCRS"):
        return CrsDef("longlat", **_ellipsoid(crs), shift=shift if any(shift) else ())
    if kind != "ProjectedCRS":
        raise ValueError(f"unsupported: {kind}")
    method = str(crs["conversion"]["method"]["name"]).lower()
    if method not in METHODS:
        raise ValueError(f"unsupported: method {method}")
    fields: dict = {}
    for p in crs["conversion"].get("parameters", []):
        name = PARAMETERS.get(str(p["name"]).lower())
        if name is None:
            raise ValueError(f"unsupported: parameter {p['name']}")
        unit = p.get("unit")
        fields[name] = float(p["value"]) * (1.0 if unit in (None, "unity") else _factor(unit))
    projection = METHODS[method]
    sphere = _ellipsoid(crs)
    if method.endswith("conformal (1sp)"):
        fields |= {"lat1": fields.get("lat0", 0.0), "lat2": fields.get("lat0", 0.0)}
    if method == "mercator (variant b)":
        import math

        ts, e2 = math.radians(fields.pop("lat1", fields.pop("lat_ts", 0.0))), (2 - 1 / sphere["rf"]) / sphere["rf"]
        fields["k0"] = math.cos(ts) / math.sqrt(1 - e2 * math.sin(ts) ** 2)
    if projection == "eqc":
        fields["lat_ts"] = fields.pop("lat1", 0.0)
    if method == "polar stereographic (variant b)":
        fields["lat0"] = 90.0 if fields.get("lat_ts", 0.0) > 0 else -90.0
    axes = crs.get("coordinate_system", {}).get("axis", [{}])
    axis = _axes(crs)
    if projection == "krovak" and method == "krovak":
        axis = axis if axis != "enu" else "swu"
    return CrsDef(projection, **sphere, **fields, unit=_factor(axes[0].get("unit")) if axes else 1.0,
                  from_origin=method.endswith("(variant a)") and projection == "omerc",
                  shift=shift if any(shift) else (), axis=axis)


def parse_text(text: str) -> CrsDef:
    """A definition of either form."""
    if text.lstrip().startswith("{"):
        try:
            return parse_projjson(json.loads(text))
        except (KeyError, TypeError, AttributeError, json.JSONDecodeError) as error:
            raise ValueError(f"unsupported: not a PROJJSON definition ({type(error).__name__}: {error})") from None
    return parse_definition(text)


_OUT = f"{REGISTRY_SCHEMA}, error string"


def registry_from_texts(
    texts: DataFrame, epsg: str = "epsg", definition: str = "definition", name: str | None = None,
    area: tuple[str, str, str, str] | None = None,
) -> DataFrame:
    """A registry of ``texts``, with ``error``: why a row has no parameters, else null.

    ``area`` names the columns of the area of use (west, south, east, north); without
    them a system is of use everywhere. Null and blank texts are errors. Rows are kept
    as they are, repeated codes too.
    """
    schema = T.StructType.fromDDL(_OUT)
    arrow = to_arrow_schema(schema)
    world = (-180.0, -90.0, 180.0, 90.0)

    def one(row: dict) -> dict:
        out = {k: row[k] for k in ("epsg", "name", "min_lon", "min_lat", "max_lon", "max_lat")}
        try:
            crs = parse_text(row["definition"] or "")
            return {**out, "params": crs.params(), "units": "degree" if crs.kind == "longlat" else
                    {v: k for k, v in _FOOT.items()}.get(crs.unit, "metre"), "error": None}
        except (ValueError, ZeroDivisionError, TypeError) as error:
            return {**out, "params": None, "units": None, "error": str(error) or type(error).__name__}

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([one(row) for row in batch.to_pylist()], schema=arrow)

    places = [F.col(quoted(c)) for c in area] if area else [F.lit(v) for v in world]
    rows = texts.select(
        F.col(quoted(epsg)).cast("int").alias("epsg"), F.col(quoted(definition)).cast("string").alias("definition"),
        (F.col(quoted(name)) if name else F.lit(None)).cast("string").alias("name"),
        *[p.cast("double").alias(n) for p, n in zip(places, ("min_lon", "min_lat", "max_lon", "max_lat"))])
    return rows.mapInArrow(parsed, schema)
