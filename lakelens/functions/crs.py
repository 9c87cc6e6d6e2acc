"""Coordinate systems: definitions, a registry table, reprojection, suggestions.

Reprojection is Column arithmetic over nested arrays. Transverse Mercator uses
the Krueger series to fourth order in the third flattening; every conformal
projection ends in the same series from conformal to geodetic latitude. Equal-area
projections (Albers, Lambert azimuthal) do so from authalic latitude. Oblique grids
(Swiss, Dutch, Krovak) go from the plane to a conformal sphere first; since that sphere's
isometric latitude is a linear function of the ellipsoid's, no iteration follows. Other
datums are moved to WGS 84 through geocentric coordinates by three or seven terms.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.functions.geometry import GEOM_TYPE, let, map_vertices, vertex, vertices
from lakelens.session import bounded_broadcast

# Ellipsoids as (semi-major axis in m, inverse flattening). Fixed values.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563),
    "GRS80": (6378137.0, 298.257222101),
    "clrk66": (6378206.4, 294.978698214),
    "intl": (6378388.0, 297.0),
    "bessel": (6377397.155, 299.1528128),
    "airy": (6377563.396, 299.3249646),
    "mod_airy": (6377340.189, 299.3249373647),
    "clrk80": (6378249.145, 293.465),
    "krass": (6378245.0, 298.3),
    "evrst30": (6377276.345, 300.8017),
    "aust_SA": (6378160.0, 298.25),
    "GRS67": (6378160.0, 298.247167427),
    "WGS72": (6378135.0, 298.26),
    "sphere": (6370997.0, 0.0),
}

# Metres per unit. Fixed values.
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "us-ft": 1200.0 / 3937.0}

KINDS = ("longlat", "webmerc", "merc", "tmerc", "lcc", "stere", "aea", "laea", "eqc",
         "somerc", "sterea", "omerc", "krovak", "cass")

# Named datums as (ellipsoid, shift to WGS 84). Fixed values.
DATUMS = {
    "WGS84": ("WGS84", ()),
    "NAD83": ("GRS80", ()),
    "OSGB36": ("airy", (446.448, -125.157, 542.06, 0.1502, 0.247, 0.8421, -20.4894)),
    "ch1903": ("bessel", (674.374, 15.056, 405.346)),
    "potsdam": ("bessel", (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)),
    "hermannskogel": ("bessel", (577.326, 90.129, 463.919, 5.137, 1.474, 5.297, 2.4232)),
    "ire65": ("mod_airy", (482.53, -130.596, 564.557, -1.042, -0.214, -0.631, 8.15)),
    "carthage": ("clrk80", (-263.0, 6.0, 431.0)),
}

PARAMS_TYPE = (
    "struct<kind: string, fe: double, fn: double, unit: double, lon0: double, scale: double,"
    " xi0: double, b1: double, b2: double, b3: double,"
    " d1: double, d2: double, d3: double, d4: double,"
    " cone: double, rho0: double, sin0: double, cos0: double, stretch: double, q0: double,"
    " sing: double, cosg: double, ex: double, ey: double, nx: double, ny: double,"
    " ea: double, es: double, tx: double, ty: double, tz: double, rx: double, ry: double, rz: double, ds: double>"
)
REGISTRY_SCHEMA = (
    f"epsg int, name string, params {PARAMS_TYPE}, units string,"
    " min_lon double, min_lat double, max_lon double, max_lat double"
)


@dataclass(frozen=True)
class CrsDef:
    """A projection by its usual parameters (angles in degrees, offsets in m)."""

    kind: str
    a: float = 6378137.0
    rf: float = 298.257223563
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0
    lat_ts: float | None = None
    k0: float = 1.0
    fe: float = 0.0
    fn: float = 0.0
    unit: float = 1.0
    alpha: float | None = None  # azimuth of an oblique line, or co-latitude of a cone's axis
    gamma: float | None = None  # angle from the skewed to the rectified grid
    from_origin: bool = False  # oblique Mercator that counts from its natural origin
    shift: tuple[float, ...] = ()  # to WGS 84: metres, arc seconds (position vector), parts per million
    axis: str = "enu"

    def params(self) -> dict[str, float | str]:
        """Constants of the inverse, worked out once per definition."""
        if self.kind not in KINDS:
            raise ValueError(f"unsupported projection {self.kind!r}; known: {KINDS}")
        f = 0.0 if self.rf == 0 or self.kind == "webmerc" else 1.0 / self.rf
        n = f / (2.0 - f)
        out: dict[str, float | str] = {
            "kind": self.kind, "fe": self.fe, "fn": self.fn, "unit": self.unit,
            "lon0": math.radians(self.lon0), "scale": self.a * self.k0, "xi0": 0.0,
            "b1": n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            "b2": n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            "b3": 17 * n**3 / 480 - 37 * n**4 / 840,
            "d1": 2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
            "d2": 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            "d3": 56 * n**3 / 15 - 136 * n**4 / 35,
            "d4": 4279 * n**4 / 630,
            "cone": 1.0, "rho0": 0.0, "sin0": 0.0, "cos0": 1.0, "stretch": 1.0, "q0": 0.0,
            "sing": 0.0, "cosg": 1.0,
            **dict(zip(("ex", "ey", "nx", "ny"), self._axes())),
            "ea": self.a, "es": f * (2 - f),
            **dict(zip(("tx", "ty", "tz", "rx", "ry", "rz", "ds"), self._shift())),
        }
        if self.kind == "tmerc":
            radius = self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
            out["scale"] = radius * self.k0
            out["xi0"] = _rectifying(math.radians(self.lat0), n, f)
        if self.kind == "lcc":
            e = math.sqrt(f * (2 - f))
            p1, p2, p0 = (math.radians(v) for v in (self.lat1, self.lat2, self.lat0))
            m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
            t = lambda p: math.exp(-_isometric(p, e))
            if abs(p1 - p2) < 1e-12:
                cone = math.sin(p1)
            else:
                cone = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
            af = self.a * self.k0 * m(p1) / (cone * t(p1) ** cone)
            out.update(cone=cone, scale=af, rho0=af * t(p0) ** cone)
        if self.kind in ("aea", "laea"):
            out.update(zip(("d1", "d2", "d3", "d4"), _authalic_series(n)))
            out.update(self._equal_area(math.sqrt(f * (2 - f))))
        if self.kind == "stere":
            out.update(self._stereographic(math.sqrt(f * (2 - f))))
        if self.kind in ("somerc", "sterea", "krovak"):
            out.update(self._conformal_sphere(math.sqrt(f * (2 - f))))
        if self.kind == "omerc":
            out.update(self._oblique(math.sqrt(f * (2 - f))))
        if self.kind == "cass":
            out.update(scale=self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64), xi0=_rectifying(math.radians(self.lat0), n, f))
            out.update(zip(("d1", "d2", "d3", "d4"), _footpoint_series(n)))
        if self.kind == "eqc":
            out.update(d1=0.0, d2=0.0, d3=0.0, d4=0.0, xi0=math.radians(self.lat0),
                       cos0=math.cos(math.radians(self.lat_ts or 0.0)), scale=self.a)
        return {k: v if k == "kind" else float(v) for k, v in out.items()}

    def _shift(self) -> tuple[float, ...]:
        given = (*self.shift, *[0.0] * (7 - len(self.shift)))
        second = math.pi / 180 / 3600
        return (*given[:3], *[r * second for r in given[3:6]], given[6] * 1e-6)

    def _axes(self) -> tuple[float, ...]:
        """How the first and second coordinate make up easting and northing."""
        turn = {"e": (1.0, 0.0), "w": (-1.0, 0.0), "n": (0.0, 1.0), "s": (0.0, -1.0)}
        first, second = (turn[c] for c in self.axis[:2])
        return first[0], second[0], first[1], second[1]

    def _conformal_sphere(self, e: float) -> dict[str, float]:
        """``cone`` times the ellipsoid's isometric latitude plus ``q0`` is the sphere's."""
        p0 = math.radians(self.lat0)
        es = e * e
        c = math.sqrt(1 + es * math.cos(p0) ** 4 / (1 - es))
        s0 = math.asin(math.sin(p0) / c)
        radius = self.a * math.sqrt(1 - es) / (1 - es * math.sin(p0) ** 2)
        out = {"cone": c, "q0": math.atanh(math.sin(s0)) - c * _isometric(p0, e), "scale": radius * self.k0,
               "sin0": math.sin(s0), "cos0": math.cos(s0)}
        if self.kind == "krovak":
            axis, parallel = math.radians(self.alpha), math.radians(self.lat1)
            out |= {"sin0": math.sin(axis), "cos0": math.cos(axis), "stretch": math.sin(parallel),
                    "rho0": radius * self.k0 / math.tan(parallel), "xi0": math.tan(math.pi / 4 + parallel / 2)}
        return out

    def _oblique(self, e: float) -> dict[str, float]:
        p0, es = math.radians(self.lat0), e * e
        alpha = math.radians(self.alpha)
        gamma = math.radians(self.gamma if self.gamma is not None else self.alpha)
        b = math.sqrt(1 + es * math.cos(p0) ** 4 / (1 - es))
        a = self.a * b * self.k0 * math.sqrt(1 - es) / (1 - es * math.sin(p0) ** 2)
        d = max(1.0, b * math.sqrt(1 - es) / (math.cos(p0) * math.sqrt(1 - es * math.sin(p0) ** 2)))
        side = math.copysign(1.0, p0)
        f = d + math.sqrt(d * d - 1) * side
        turn = math.asin(math.sin(alpha) / d)
        lon0 = math.radians(self.lon0) - math.asin((f - 1 / f) / 2 * math.tan(turn)) / b
        if self.from_origin:
            along = 0.0
        elif abs(abs(self.alpha) - 90) < 1e-9:
            along = a * (math.radians(self.lon0) - lon0)
        else:
            along = a / b * math.atan2(math.sqrt(d * d - 1), math.cos(alpha)) * side
        return {"lon0": lon0, "scale": a / b, "cone": b, "q0": math.log(f) - b * _isometric(p0, e), "xi0": along,
                "sin0": math.sin(turn), "cos0": math.cos(turn), "sing": math.sin(gamma), "cosg": math.cos(gamma)}

    def _equal_area(self, e: float) -> dict[str, float]:
        p1, p2, p0 = (math.radians(v) for v in (self.lat1, self.lat2, self.lat0))
        m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
        pole, q0 = _authalic(math.pi / 2, e), _authalic(p0, e)
        if self.kind == "laea":
            beta = math.asin(max(-1.0, min(1.0, q0 / pole)))
            radius = self.a * math.sqrt(pole / 2)
            polar = abs(abs(self.lat0) - 90) < 1e-9
            stretch = 1.0 if polar else self.a * m(p0) / (radius * math.cos(beta))
            return {"scale": radius, "sin0": math.sin(beta), "cos0": 0.0 if polar else math.cos(beta), "stretch": stretch}
        cone = math.sin(p1) if abs(p1 - p2) < 1e-12 else (
            (m(p1) ** 2 - m(p2) ** 2) / (_authalic(p2, e) - _authalic(p1, e)))
        c = m(p1) ** 2 + cone * _authalic(p1, e)
        return {"scale": self.a, "cone": cone, "rho0": self.a * math.sqrt(c - cone * q0) / cone, "q0": c, "stretch": pole}

    def _stereographic(self, e: float) -> dict[str, float]:
        """``scale`` is the distance from the centre at which the half angle's tangent is 1."""
        p0 = math.radians(self.lat0)
        m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
        t = lambda p: math.exp(-_isometric(p, e))
        if abs(abs(self.lat0) - 90) < 1e-9:
            side = math.copysign(1.0, self.lat0)
            if self.lat_ts is not None and abs(abs(self.lat_ts) - 90) > 1e-9:
                true = math.radians(abs(self.lat_ts))
                scale = self.a * m(true) / t(true)
            else:
                scale = 2 * self.a * self.k0 / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
            return {"scale": scale, "sin0": side, "cos0": 0.0}
        chi = math.asin(math.tanh(_isometric(p0, e)))
        return {"scale": 2 * self.a * self.k0 * m(p0) / math.cos(chi), "sin0": math.sin(chi), "cos0": math.cos(chi)}


def _authalic(phi: float, e: float) -> float:
    """The equal-area function q of a latitude."""
    s = math.sin(phi)
    return 2 * s if e == 0 else (1 - e * e) * (s / (1 - (e * s) ** 2) + math.atanh(e * s) / e)


def _authalic_series(n: float) -> tuple[float, float, float, float]:
    """From authalic to geodetic latitude, to fourth order."""
    return (
        4 * n / 3 + 4 * n**2 / 45 - 16 * n**3 / 35 - 2582 * n**4 / 14175,
        46 * n**2 / 45 + 152 * n**3 / 945 - 11966 * n**4 / 14175,
        3044 * n**3 / 2835 + 3802 * n**4 / 14175,
        6059 * n**4 / 4725,
    )


def _footpoint_series(n: float) -> tuple[float, float, float, float]:
    """From rectifying to geodetic latitude, to fourth order."""
    return (3 * n / 2 - 27 * n**3 / 32, 21 * n**2 / 16 - 55 * n**4 / 32, 151 * n**3 / 96, 1097 * n**4 / 512)


def _isometric(phi: float, e: float) -> float:
    s = math.sin(phi)
    return math.atanh(s) - e * math.atanh(e * s)


def _rectifying(phi: float, n: float, f: float) -> float:
    """Northing of a latitude on the central meridian, over the radius."""
    if phi == 0.0:
        return 0.0
    e = math.sqrt(f * (2 - f))
    chi = math.asin(math.tanh(_isometric(phi, e)))
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    return chi + sum(a * math.sin(2 * (j + 1) * chi) for j, a in enumerate(alpha))


def utm(zone: int, south: bool = False, rf: float = 298.257223563) -> CrsDef:
    return CrsDef(
        "tmerc", rf=rf, lon0=6.0 * zone - 183.0, k0=0.9996, fe=500_000.0,
        fn=10_000_000.0 if south else 0.0,
    )


#: Arguments of a definition that are used, or that change no coordinate.
_KNOWN_ARGS = frozenset("""proj datum ellps a b rf units to_meter zone south lon_0 lat_0 lat_1 lat_2 lat_ts
    x_0 y_0 k k_0 alpha gamma lonc no_uoff no_off towgs84 nadgrids axis pm no_defs type wktext over title""".split()) | {""}

#: Prime meridians by name, degrees east of Greenwich: fixed values.
_MERIDIANS = {"greenwich": 0.0, "paris": 2.337229167, "lisbon": -9.131906111, "bogota": -74.080916667,
              "madrid": -3.687938889, "rome": 12.452333333, "bern": 7.439583333, "jakarta": 106.807719444,
              "ferro": -17.666666667, "brussels": 4.367975, "stockholm": 18.058277778, "athens": 23.7163375,
              "oslo": 10.722916667}


def _meridian(text: str) -> float:
    if text.lower() in _MERIDIANS:
        return _MERIDIANS[text.lower()]
    try:
        return float(text)
    except ValueError:
        raise ValueError(f"unsupported: prime meridian {text}") from None


def parse_definition(text: str) -> CrsDef:
    """A ``+proj=...`` definition text; anything not supported raises."""
    args = {}
    for token in text.split():
        key, _, value = token.lstrip("+").partition("=")
        args[key] = value
    if unknown := set(args) - _KNOWN_ARGS:
        raise ValueError(f"unsupported: {', '.join(sorted(unknown))}")
    axis = args.get("axis", "enu")
    if not re.fullmatch("[ew][ns]u|[ns][ew]u", axis):
        raise ValueError(f"unsupported: axis {axis}")
    proj = args.get("proj", "")
    number = lambda key, default=0.0: float(args.get(key) or default)
    if args.get("nadgrids", "@null") != "@null":
        raise ValueError("unsupported: grid shift")
    datum = args.get("datum")
    if datum and datum not in DATUMS:
        raise ValueError(f"unsupported: datum {datum}")
    ellipsoid, shift = DATUMS[datum] if datum else (args.get("ellps") or "WGS84", ())
    if ellipsoid not in ELLIPSOIDS:
        raise ValueError(f"unsupported: ellipsoid {ellipsoid}")
    if args.get("towgs84"):
        shift = tuple(float(v) for v in args["towgs84"].split(","))
        if len(shift) not in (3, 7):
            raise ValueError("unsupported: datum shift of other than 3 or 7 terms")
    shift = shift if any(shift) else ()
    a, rf = ELLIPSOIDS[ellipsoid]
    if "a" in args:
        a = number("a")
        rf = number("rf") or (a / (a - number("b")) if "b" in args and number("b") != a else 0.0)
    unit = number("to_meter") or UNITS.get(args.get("units", "m"), 0.0)
    if not unit:
        raise ValueError(f"unsupported: units {args.get('units')}")
    common = dict(a=a, rf=rf, unit=unit, shift=shift, axis=axis)
    pm = _meridian(args.get("pm", "0"))
    if pm and proj in ("longlat", "latlong", "utm"):
        raise ValueError(f"unsupported: {proj} from another prime meridian")
    if proj in ("longlat", "latlong"):
        return CrsDef("longlat", a=a, rf=rf, shift=shift, axis=axis)
    if proj == "utm":
        base = utm(int(args["zone"]), "south" in args)
        return CrsDef(base.kind, **common, lon0=base.lon0, k0=base.k0, fe=base.fe, fn=base.fn)
    lat1 = number("lat_1", number("lat_0"))
    place = dict(
        lon0=number("lon_0") + pm, lat0=number("lat_0"), fe=number("x_0"), fn=number("y_0"),
        k0=number("k_0", number("k", 1.0)),
    )
    if proj == "merc":
        if number("lat_ts"):
            e2 = 0.0 if rf == 0 else (2 - 1 / rf) / rf
            ts = math.radians(number("lat_ts"))
            place["k0"] = math.cos(ts) / math.sqrt(1 - e2 * math.sin(ts) ** 2)
        return CrsDef("webmerc" if rf == 0 else "merc", **common, **place)
    if proj in ("tmerc", "aea", "laea", "stere", "eqc"):
        place |= dict(lat1=lat1, lat2=number("lat_2", lat1)) if proj == "aea" else {}
        place |= dict(lat_ts=number("lat_ts")) if "lat_ts" in args else {}
        return CrsDef(proj, **common, **place)
    if proj in ("somerc", "sterea", "cass"):
        return CrsDef(proj, **common, **place)
    if proj == "omerc":
        if "alpha" not in args or number("lat_0") == 0:
            raise ValueError("unsupported: oblique Mercator by two points or at the equator")
        place |= dict(lon0=number("lonc", number("lon_0")) + pm, alpha=number("alpha"))
        place |= dict(gamma=number("gamma")) if "gamma" in args else {}
        return CrsDef(proj, **common, **place, from_origin="no_uoff" in args or "no_off" in args)
    if proj == "krovak":
        place |= dict(lat0=number("lat_0", 49.5), lon0=number("lon_0", 24 + 5 / 6) + pm,
                      k0=number("k_0", number("k", 0.9999)))
        return CrsDef(proj, **common, **place, lat1=78.5, alpha=number("alpha", 30 + 17 / 60 + 17.3031 / 3600))
    if proj == "lcc":
        return CrsDef("lcc", **common, **place, lat1=lat1, lat2=number("lat_2", lat1))
    raise ValueError(f"unsupported: projection {proj!r}")


def builtin_crs() -> dict[int, tuple[str, CrsDef, str, tuple[float, float, float, float]]]:
    """EPSG code to (name, definition, units, area of use), all by rule."""
    world = (-180.0, -90.0, 180.0, 90.0)
    mercator = (-180.0, -85.06, 180.0, 85.06)
    out = {4326: ("WGS 84", CrsDef("longlat"), "degree", world)}
    for code in (3857, 102100, 900913):
        out[code] = ("WGS 84 / Pseudo-Mercator", CrsDef("webmerc"), "metre", mercator)
    out[3395] = ("WGS 84 / World Mercator", CrsDef("merc"), "metre", (-180.0, -80.0, 180.0, 84.0))
    for zone in range(1, 61):
        west = 6.0 * zone - 186.0
        out[32600 + zone] = (f"WGS 84 / UTM zone {zone}N", utm(zone), "metre",
                             (west, 0.0, west + 6.0, 84.0))
        out[32700 + zone] = (f"WGS 84 / UTM zone {zone}S", utm(zone, True), "metre",
                             (west, -80.0, west + 6.0, 0.0))
        if zone <= 23:  # NAD83 is taken as equal to WGS 84
            out[26900 + zone] = (f"NAD83 / UTM zone {zone}N", utm(zone, rf=298.257222101), "metre",
                                 (west, 14.0, west + 6.0, 84.0))
    return out


def registry_row(epsg: int, name: str, crs: CrsDef, units: str, area) -> tuple:
    return (epsg, name, crs.params(), units, *map(float, area))


def crs_registry(spark: SparkSession, extra: list[tuple] | None = None) -> DataFrame:
    """The registry table: built-in rows plus ``extra`` (see ``registry_row``)."""
    rows = [registry_row(code, *entry) for code, entry in builtin_crs().items()]
    return spark.createDataFrame(rows + list(extra or []), REGISTRY_SCHEMA)


def with_crs(df: DataFrame, registry: DataFrame, epsg: str = "epsg") -> DataFrame:
    """Look up the CRS of each row; unknown codes keep the row with null fields."""
    looked_up = registry.select(
        F.col("epsg").alias("__crs_code"),
        F.col("name").alias("crs_name"),
        F.col("params").alias("crs_params"),
        F.col("units").alias("crs_units"),
    )
    return df.join(
        bounded_broadcast(looked_up), F.col(epsg) == F.col("__crs_code"), "left"
    ).drop("__crs_code")


# ------------------------------------------------------------ reprojection


def _params_column(crs: CrsDef) -> Column:
    values = crs.params()
    return F.struct(*[F.lit(v).alias(k) for k, v in values.items()]).cast(PARAMS_TYPE)


def _conformal_tmerc(parts: Column, p: Column) -> Column:
    """Transverse Mercator metres to conformal latitude and longitude."""
    bs = [p["b1"], p["b2"], p["b3"]]  # the fourth is worth a micrometre
    ring = map_vertices(
        parts,
        lambda v: F.struct(
            ((v["y"] * p["unit"] - p["fn"]) / p["scale"] + p["xi0"]).alias("x"),
            ((v["x"] * p["unit"] - p["fe"]) / p["scale"]).alias("y"),
        ),
    )

    def bend(v: Column) -> Column:
        xi, eta = v["x"], v["y"]
        for j, b in enumerate(bs, start=1):
            k = F.lit(2.0 * j)
            xi = xi - b * F.sin(k * v["x"]) * F.cosh(k * v["y"])
            eta = eta - b * F.cos(k * v["x"]) * F.sinh(k * v["y"])
        return F.struct(xi.alias("x"), eta.alias("y"))

    return map_vertices(
        map_vertices(ring, bend),
        lambda v: F.struct(
            (p["lon0"] + F.atan2(F.sinh(v["y"]), F.cos(v["x"]))).alias("x"),
            F.asin(F.sin(v["x"]) / F.cosh(v["y"])).alias("y"),
        ),
    )


def _conformal_merc(parts: Column, p: Column) -> Column:
    return map_vertices(
        parts,
        lambda v: F.struct(
            (p["lon0"] + (v["x"] * p["unit"] - p["fe"]) / p["scale"]).alias("x"),
            F.atan(F.sinh((v["y"] * p["unit"] - p["fn"]) / p["scale"])).alias("y"),
        ),
    )


def _conformal_lcc(parts: Column, p: Column) -> Column:
    polar = map_vertices(
        parts,
        lambda v: F.struct(
            (F.signum(p["cone"]) * (v["x"] * p["unit"] - p["fe"])).alias("x"),
            (F.signum(p["cone"]) * (p["rho0"] - (v["y"] * p["unit"] - p["fn"]))).alias("y"),
        ),
    )
    return map_vertices(
        polar,
        lambda v: F.struct(
            (p["lon0"] + F.atan2(v["x"], v["y"]) / p["cone"]).alias("x"),
            (
                F.lit(math.pi / 2)
                - F.lit(2.0) * F.atan(F.pow(F.hypot(v["x"], v["y"]) / F.abs(p["scale"]),
                                            F.lit(1.0) / p["cone"]))
            ).alias("y"),
        ),
    )


def _centred(parts: Column, p: Column, half_angle) -> Column:
    """Azimuthal metres to auxiliary radians around the centre (sin0, cos0).

    ``half_angle`` of the distance is half the angle at the sphere's centre.
    """
    ring = map_vertices(parts, lambda v: F.struct(
        ((v["x"] * p["unit"] - p["fe"]) / p["stretch"]).alias("x"),
        ((v["y"] * p["unit"] - p["fn"]) * p["stretch"]).alias("y"),
    ))
    polar = map_vertices(ring, lambda v: F.struct(
        v["x"].alias("x"), v["y"].alias("y"), F.hypot(v["x"], v["y"]).alias("r"),
        (F.lit(2.0) * half_angle(F.hypot(v["x"], v["y"]) / p["scale"])).alias("c"),
    ))
    return map_vertices(polar, lambda v: F.struct(
        F.when(v["r"] == 0, p["lon0"]).otherwise(p["lon0"] + F.atan2(
            v["x"] * F.sin(v["c"]),
            v["r"] * p["cos0"] * F.cos(v["c"]) - v["y"] * p["sin0"] * F.sin(v["c"]))).alias("x"),
        F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(v["c"]) * p["sin0"] + F.when(
            v["r"] == 0, 0.0).otherwise(v["y"] * F.sin(v["c"]) * p["cos0"] / v["r"])))).alias("y"),
    ))


def _conformal_stere(parts: Column, p: Column) -> Column:
    return _centred(parts, p, F.atan)


def _authalic_laea(parts: Column, p: Column) -> Column:
    return _centred(parts, p, lambda r: F.asin(F.least(F.lit(1.0), r / F.lit(2.0))))


def _authalic_aea(parts: Column, p: Column) -> Column:
    side = F.signum(p["cone"])
    polar = map_vertices(parts, lambda v: F.struct(
        (side * (v["x"] * p["unit"] - p["fe"])).alias("x"),
        (side * (p["rho0"] - (v["y"] * p["unit"] - p["fn"]))).alias("y"),
    ))
    q = lambda v: (p["q0"] - F.pow(F.hypot(v["x"], v["y"]) * p["cone"] / p["scale"], F.lit(2.0))) / p["cone"]
    return map_vertices(polar, lambda v: F.struct(
        (p["lon0"] + F.atan2(v["x"], v["y"]) / p["cone"]).alias("x"),
        F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q(v) / p["stretch"]))).alias("y"),
    ))


def _from_sphere(sphere: Column, p: Column) -> Column:
    """Longitude and latitude on the conformal sphere to conformal ones on the ellipsoid."""
    return map_vertices(sphere, lambda v: F.struct(
        (p["lon0"] + v["x"] / p["cone"]).alias("x"),
        F.atan(F.sinh((F.atanh(F.sin(v["y"])) - p["q0"]) / p["cone"])).alias("y"),
    ))


def _metres(parts: Column, p: Column) -> Column:
    return map_vertices(parts, lambda v: F.struct(
        (v["x"] * p["unit"] - p["fe"]).alias("x"), (v["y"] * p["unit"] - p["fn"]).alias("y")))


def _sphere_somerc(parts: Column, p: Column) -> Column:
    turned = map_vertices(_metres(parts, p), lambda v: F.struct(
        (v["x"] / p["scale"]).alias("x"), F.atan(F.sinh(v["y"] / p["scale"])).alias("y")))
    return _from_sphere(map_vertices(turned, lambda v: F.struct(
        F.atan2(F.cos(v["y"]) * F.sin(v["x"]),
                p["cos0"] * F.cos(v["y"]) * F.cos(v["x"]) - p["sin0"] * F.sin(v["y"])).alias("x"),
        F.asin(p["cos0"] * F.sin(v["y"]) + p["sin0"] * F.cos(v["y"]) * F.cos(v["x"])).alias("y"),
    )), p)


def _sphere_sterea(parts: Column, p: Column) -> Column:
    polar = map_vertices(_metres(parts, p), lambda v: F.struct(
        v["x"].alias("x"), v["y"].alias("y"), F.hypot(v["x"], v["y"]).alias("r"),
        (F.lit(2.0) * F.atan(F.hypot(v["x"], v["y"]) / (F.lit(2.0) * p["scale"]))).alias("c")))
    return _from_sphere(map_vertices(polar, lambda v: F.struct(
        F.atan2(v["x"] * F.sin(v["c"]),
                v["r"] * p["cos0"] * F.cos(v["c"]) - v["y"] * p["sin0"] * F.sin(v["c"])).alias("x"),
        F.asin(F.cos(v["c"]) * p["sin0"] + F.when(v["r"] == 0, 0.0).otherwise(
            v["y"] * F.sin(v["c"]) * p["cos0"] / v["r"])).alias("y"),
    )), p)


def _sphere_krovak(parts: Column, p: Column) -> Column:
    # southing and westing count from the cone's apex
    polar = map_vertices(_metres(parts, p), lambda v: F.struct(
        (F.atan2(-v["x"], -v["y"]) / p["stretch"]).alias("x"),
        (F.lit(2.0) * F.atan(F.pow(p["rho0"] / F.hypot(v["x"], v["y"]), F.lit(1.0) / p["stretch"]) * p["xi0"])
         - F.lit(math.pi / 2)).alias("y"),
    ))
    return _from_sphere(map_vertices(polar, lambda v: F.struct(
        F.atan2(-F.cos(v["y"]) * F.sin(v["x"]),
                p["cos0"] * F.cos(v["y"]) * F.cos(v["x"]) + p["sin0"] * F.sin(v["y"])).alias("x"),
        F.asin(p["cos0"] * F.sin(v["y"]) - p["sin0"] * F.cos(v["y"]) * F.cos(v["x"])).alias("y"),
    )), p)


def _conformal_omerc(parts: Column, p: Column) -> Column:
    skewed = map_vertices(_metres(parts, p), lambda v: F.struct(
        ((v["y"] * p["cosg"] + v["x"] * p["sing"] + p["xi0"]) / p["scale"]).alias("u"),
        ((v["x"] * p["cosg"] - v["y"] * p["sing"]) / p["scale"]).alias("v"),
    ))
    # sinh and cosh of -v are half the difference and sum of exp(-v) and its inverse
    return map_vertices(skewed, lambda v: F.struct(
        (p["lon0"] - F.atan2(F.sinh(-v["v"]) * p["cos0"] - F.sin(v["u"]) * p["sin0"], F.cos(v["u"])) / p["cone"]).alias("x"),
        F.atan(F.sinh((F.atanh((F.sin(v["u"]) * p["cos0"] + F.sinh(-v["v"]) * p["sin0"]) / F.cosh(v["v"])) - p["q0"])
                      / p["cone"])).alias("y"),
    ))


def _geodetic_cass(parts: Column, p: Column) -> Column:
    """Degrees, from the latitude at which the meridian's foot lies."""
    foot = map_vertices(_metres(parts, p), lambda v: F.struct(
        v["x"].alias("x"), (p["xi0"] + v["y"] / p["scale"]).alias("y")))

    def at_foot(v: Column) -> Column:
        lat = v["y"]
        for j in range(1, 5):
            lat = lat + p[f"d{j}"] * F.sin(F.lit(2.0 * j) * v["y"])
        return F.struct(v["x"].alias("x"), lat.alias("y"))

    def bent(v: Column) -> Column:
        s2, t = F.pow(F.sin(v["y"]), F.lit(2.0)), F.pow(F.tan(v["y"]), F.lit(2.0))
        w = F.lit(1.0) - p["es"] * s2
        d = v["x"] * F.sqrt(w) / p["ea"]
        d2 = d * d
        lat = v["y"] - w / (F.lit(1.0) - p["es"]) * F.tan(v["y"]) * d2 * (
            F.lit(0.5) - (F.lit(1.0) + F.lit(3.0) * t) * d2 / F.lit(24.0))
        lon = d * (F.lit(1.0) - t * d2 * (F.lit(1 / 3.0) - (F.lit(1.0) + F.lit(3.0) * t) * d2 / F.lit(15.0))) / F.cos(v["y"])
        return vertex(F.degrees(p["lon0"] + lon), F.degrees(lat))

    return map_vertices(map_vertices(foot, at_foot), bent)


_WGS_A, _WGS_F = ELLIPSOIDS["WGS84"][0], 1 / ELLIPSOIDS["WGS84"][1]
_WGS_B, _WGS_ES = _WGS_A * (1 - _WGS_F), _WGS_F * (2 - _WGS_F)


def _shifted(parts: Column, p: Column) -> Column:
    """Degrees on the source's ellipsoid, height 0, to degrees on WGS 84.

    The way back from geocentric coordinates is closed (one step from the reduced
    latitude): near the ground it is right to a micrometre.
    """
    def geocentric(v: Column) -> Column:
        lon, lat = F.radians(v["x"]), F.radians(v["y"])
        nu = p["ea"] / F.sqrt(F.lit(1.0) - p["es"] * F.pow(F.sin(lat), F.lit(2.0)))
        return F.struct((nu * F.cos(lat) * F.cos(lon)).alias("x"), (nu * F.cos(lat) * F.sin(lon)).alias("y"),
                        (nu * (F.lit(1.0) - p["es"]) * F.sin(lat)).alias("z"))

    def moved(v: Column) -> Column:
        m = F.lit(1.0) + p["ds"]
        x = m * (v["x"] - p["rz"] * v["y"] + p["ry"] * v["z"]) + p["tx"]
        y = m * (p["rz"] * v["x"] + v["y"] - p["rx"] * v["z"]) + p["ty"]
        z = m * (p["rx"] * v["y"] - p["ry"] * v["x"] + v["z"]) + p["tz"]
        return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))

    def reduced(v: Column) -> Column:
        r = F.hypot(v["x"], v["y"])
        return F.struct(v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"), r.alias("r"),
                        F.atan2(v["z"] * F.lit(_WGS_A), r * F.lit(_WGS_B)).alias("t"))

    def geodetic(v: Column) -> Column:
        cube = lambda c: c * c * c
        lat = F.atan2(v["z"] + F.lit(_WGS_ES / (1 - _WGS_ES) * _WGS_B) * cube(F.sin(v["t"])),
                      v["r"] - F.lit(_WGS_ES * _WGS_A) * cube(F.cos(v["t"])))
        return vertex(F.degrees(F.atan2(v["y"], v["x"])), F.degrees(lat))

    for step in (geocentric, moved, reduced, geodetic):
        parts = map_vertices(parts, step)
    return parts


def _plate_carree(parts: Column, p: Column) -> Column:
    return map_vertices(parts, lambda v: F.struct(
        (p["lon0"] + (v["x"] * p["unit"] - p["fe"]) / (p["scale"] * p["cos0"])).alias("x"),
        (p["xi0"] + (v["y"] * p["unit"] - p["fn"]) / p["scale"]).alias("y"),
    ))


def _geodetic(parts: Column, p: Column) -> Column:
    """Auxiliary (conformal or authalic) radians to longitude and latitude in degrees."""

    def unbend(v: Column) -> Column:
        lat = v["y"]
        for j in range(1, 5):
            lat = lat + p[f"d{j}"] * F.sin(F.lit(2.0 * j) * v["y"])
        lon = F.degrees(v["x"])
        wrapped = lon - F.lit(360.0) * F.floor((lon + F.lit(180.0)) / F.lit(360.0))
        return vertex(F.when(F.abs(lon) <= 180.0, lon).otherwise(wrapped), F.degrees(lat))

    return map_vertices(parts, unbend)


_TO_AUXILIARY = {
    "webmerc": _conformal_merc,
    "merc": _conformal_merc,
    "tmerc": _conformal_tmerc,
    "lcc": _conformal_lcc,
    "stere": _conformal_stere,
    "laea": _authalic_laea,
    "aea": _authalic_aea,
    "eqc": _plate_carree,
    "somerc": _sphere_somerc,
    "sterea": _sphere_sterea,
    "krovak": _sphere_krovak,
    "omerc": _conformal_omerc,
}


def to_wgs84(geom: Column, params: Column, crs: CrsDef | None = None) -> Column:
    """Every vertex to WGS 84; null where a result is not a finite coordinate.

    With ``crs``, the one that ``params`` are of, steps it does not take are left out.
    """
    kinds = (crs.kind,) if crs else KINDS
    given = geom["parts"]
    if crs is None or crs.axis != "enu":
        plain = (params["ex"] == 1.0) & (params["ny"] == 1.0)
        given = F.when(plain, given).otherwise(map_vertices(given, lambda v: vertex(
            params["ex"] * v["x"] + params["ey"] * v["y"], params["nx"] * v["x"] + params["ny"] * v["y"])))
    parts = F.when(params["kind"] == "longlat", given)
    for kind in kinds:
        if kind in _TO_AUXILIARY:
            parts = parts.when(params["kind"] == kind, _geodetic(_TO_AUXILIARY[kind](given, params), params))
    if "cass" in kinds:
        parts = parts.when(params["kind"] == "cass", _geodetic_cass(given, params))
    if crs is None or crs.shift:
        terms = [F.abs(params[c]) for c in ("tx", "ty", "tz", "rx", "ry", "rz", "ds")]
        parts = let(parts, lambda here: F.when(F.greatest(*terms) > 0, _shifted(here, params)).otherwise(here))
    moved = F.struct(geom["type"].alias("type"), parts.alias("parts")).cast(GEOM_TYPE)
    finite = F.forall(
        vertices(moved), lambda v: (F.abs(v["x"]) <= 1e6) & (F.abs(v["y"]) <= 90.0 + 1e-9)
    )
    return F.when(finite, moved)


def reproject(
    df: DataFrame,
    geom: str = "geom",
    crs: CrsDef | int | None = None,
    registry: DataFrame | None = None,
    epsg: str = "epsg",
) -> DataFrame:
    """Replace ``geom`` by its WGS 84 form and say why in ``geom_error`` if not.

    With ``crs`` one definition (or built-in EPSG code) holds for the dataset and
    its constants fold into the expression; otherwise each row's ``epsg`` column
    is looked up in the registry.
    """
    if crs is not None:
        if isinstance(crs, int):
            known = builtin_crs()
            if crs not in known:
                raise ValueError(f"unsupported EPSG code {crs}: give its definition")
            crs = known[crs][1]
        if crs.kind == "longlat" and not crs.shift and crs.axis == "enu":
            return _with_error(df, F.lit(None).cast("string"))
        moved = df.withColumn("__moved", to_wgs84(F.col(geom), _params_column(crs), crs))
        unknown = F.lit(False)
    else:
        registry = registry if registry is not None else crs_registry(df.sparkSession)
        joined = with_crs(df, registry, epsg).drop("crs_name", "crs_units")
        moved = joined.withColumn("__moved", to_wgs84(F.col(geom), F.col("crs_params")))
        unknown = F.col("crs_params").isNull()
    error = F.when(
        F.col(geom).isNotNull() & F.col("__moved").isNull(),
        F.when(unknown, "unsupported CRS").otherwise("reprojection failed"),
    )
    out = _with_error(moved, error).withColumn(geom, F.col("__moved"))
    return out.drop("__moved", "crs_params")


def _with_error(df: DataFrame, error: Column) -> DataFrame:
    if "geom_error" in df.columns:
        error = F.coalesce(F.col("geom_error"), error)
    return df.withColumn("geom_error", error)


# ------------------------------------------------------------- suggestions

CELL_LON, CELL_LAT = 6.0, 10.0


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("int")


def suggest_crs(
    points: DataFrame,
    registry: DataFrame,
    k: int = 12,
    lon: str = "lon",
    lat: str = "lat",
) -> DataFrame:
    """The ``k`` systems with the smallest area of use around each point.

    The registry is laid on a grid: each cell holds its candidates in order, a
    point finds its cell by an equi-join and filters that list exactly. No point
    is shuffled and no point-by-registry product is formed. An area of use that
    crosses the 180th meridian (``min_lon > max_lon``) is laid out as two.
    """
    crosses = F.col("min_lon") > F.col("max_lon")
    width = F.when(crosses, F.lit(360.0)).otherwise(F.lit(0.0)) + F.col("max_lon") - F.col("min_lon")
    boxes = F.when(crosses, F.array(
        F.struct(F.col("min_lon").alias("lo"), F.lit(180.0).alias("hi")),
        F.struct(F.lit(-180.0).alias("lo"), F.col("max_lon").alias("hi")),
    )).otherwise(F.array(F.struct(F.col("min_lon").alias("lo"), F.col("max_lon").alias("hi"))))
    registry = (
        registry.withColumn("area", width * (F.col("max_lat") - F.col("min_lat")))
        .select("*", F.explode(boxes).alias("box"))
        .withColumns({"min_lon": F.col("box.lo"), "max_lon": F.col("box.hi")}).drop("box")
    )
    cells = (
        registry.withColumn("cx", F.explode(F.sequence(_cell(F.col("min_lon"), CELL_LON),
                                               _cell(F.col("max_lon"), CELL_LON))))
        .withColumn("cy", F.explode(F.sequence(_cell(F.col("min_lat"), CELL_LAT),
                                               _cell(F.col("max_lat"), CELL_LAT))))
        .groupBy("cx", "cy")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("area", "epsg", "name", "units",
                             "min_lon", "min_lat", "max_lon", "max_lat")
                )
            ).alias("candidates")
        )
    )
    inside = lambda c: (
        (F.col(lon) >= c["min_lon"]) & (F.col(lon) <= c["max_lon"])
        & (F.col(lat) >= c["min_lat"]) & (F.col(lat) <= c["max_lat"])
    )
    placed = points.withColumn("cx", _cell(F.col(lon), CELL_LON)).withColumn(
        "cy", _cell(F.col(lat), CELL_LAT)
    )
    best = F.slice(F.filter("candidates", inside), 1, k)
    return (
        placed.join(bounded_broadcast(cells), ["cx", "cy"], "left")
        .select(*points.columns, F.posexplode(best).alias("__pos", "c"))
        .select(
            *points.columns,
            (F.col("__pos") + 1).alias("rank"),
            F.col("c.epsg").alias("epsg"),
            F.col("c.name").alias("crs_name"),
            F.col("c.units").alias("units"),
            F.col("c.area").alias("area"),
        )
    )
