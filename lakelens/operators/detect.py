"""Which column holds geometry, how it is encoded, and in which CRS."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions.crs import CrsDef, builtin_crs, to_wgs84, _params_column
from lakelens.functions.decode import decode_column, esri_epsg, list_depth, looks_like_esri
from lakelens.functions.geometry import first_vertex, make_geom, vertex
from lakelens.operators.rows import sample_prefix
from lakelens.sources.footers import kv_metadata
from lakelens.sources.schema import field_of, is_native_geometry, quoted

# Names and name parts that point to geometry. Fixed values.
GEOMETRY_NAMES = ("geometry", "geom", "wkb_geometry", "shape")
TEXT_NAMES = ("wkt",)
NAME_PARTS = ("geo", "geom", "wkb")
ESRI_FIELDS = ("rings", "paths", "points")
GEOGRAPHIC_CODES = (4326,)

# GeoParquet's native encodings and the geometry type of each. Fixed values.
NATIVE_ENCODINGS = {
    "point": "Point",
    "linestring": "LineString",
    "polygon": "Polygon",
    "multipoint": "MultiPoint",
    "multilinestring": "MultiLineString",
    "multipolygon": "MultiPolygon",
}

RANGE_ROWS = None  # rows whose first vertices are looked at; None: all


@dataclass(frozen=True)
class GeoInfo:
    column: str
    encoding: str  # wkb, wkt, struct, esri or native
    kind: str | None = None  # geometry type, where the metadata fixes it
    crs_string: str | None = None
    is_wgs84: bool = True
    bbox: tuple[float, float, float, float] | None = None
    epsg: int | None = None
    definition: CrsDef | None = None
    #: Whether rows or files disagree; the other fields are then the majority's.
    mixed: bool = field(default=False, compare=False)
    #: What was counted: (encoding or geometry column, CRS, rows or files), most first.
    found: tuple[tuple, ...] = field(default=(), compare=False)

    def with_epsg(self, epsg: int | None, definition: CrsDef | None = None) -> GeoInfo:
        """Override the CRS; built-in codes bring their own definition."""
        if definition is None and epsg in builtin_crs():
            definition = builtin_crs()[epsg][1]
        return replace(
            self, epsg=epsg, definition=definition,
            is_wgs84=epsg is None or epsg in GEOGRAPHIC_CODES,
        )

    def source_crs(self) -> CrsDef | None:
        """The definition to reproject from, if one is known."""
        if self.definition is not None:
            return self.definition
        known = builtin_crs()
        return known[self.epsg][1] if self.epsg in known else None


# ------------------------------------------------------- footer metadata


def _crs_code(crs: object) -> tuple[int | None, bool]:
    """(EPSG code, geographic WGS 84?) of a PROJJSON object."""
    if not isinstance(crs, dict):
        return None, True
    ident = crs.get("id")
    if not isinstance(ident, dict):
        parts = crs.get("components")
        ident = parts[0].get("id") if isinstance(parts, list) and parts and isinstance(
            parts[0], dict) else None
    code = ident.get("code") if isinstance(ident, dict) else None
    if code is None:
        return None, True
    if str(code).upper().endswith("CRS84"):
        return 4326, True
    try:
        number = int(code)
    except (TypeError, ValueError):
        return None, False
    return number, number in GEOGRAPHIC_CODES


def _bbox(value: object) -> tuple[float, float, float, float] | None:
    if not isinstance(value, list) or len(value) != 4:
        return None
    try:
        box = tuple(float(v) for v in value)
    except (TypeError, ValueError):
        return None
    return box if all(math.isfinite(v) for v in box) else None


def parse_geo_metadata(text: str) -> GeoInfo | None:
    """GeoInfo from one footer's ``geo`` value; None if it says nothing usable."""
    try:
        meta = json.loads(text)
        columns = meta.get("columns") or {}
        column = meta.get("primary_column") or next(iter(columns), None)
        if not column:
            return None
        about = columns.get(column) or {}
        encoding = str(about.get("encoding") or "WKB").lower()
    except (ValueError, AttributeError):
        return None
    kind = NATIVE_ENCODINGS.get(encoding)
    crs = about.get("crs")
    epsg, wgs84 = _crs_code(crs)
    return GeoInfo(
        column,
        "struct" if kind else "wkt" if encoding == "wkt" else "wkb",
        kind=kind,
        crs_string=json.dumps(crs) if crs else None,
        is_wgs84=wgs84,
        bbox=_bbox(about.get("bbox")),
        epsg=epsg,
    )


FOUND_ROWS = 50  # kinds of rows or files that a GeoInfo lists


def footer_census(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(geo_column, encoding, crs, files, boxed, b0..b3, value): one row per kind of file.

    Counted over every footer with a ``geo`` entry. Files of one dataset differ in bbox
    and other details; the boxes of those that agree are united.
    """
    entries = kv_metadata(spark, paths, "geo")
    column = F.coalesce(
        F.get_json_object("value", "$.primary_column"),
        F.get(F.json_object_keys(F.get_json_object("value", "$.columns")), F.lit(0)),
    )
    about = F.concat(F.lit("$.columns['"), F.col("geo_column"), F.lit("']"))
    detail = lambda key: F.call_function(
        "get_json_object", F.col("value"), F.concat(about, F.lit(f".{key}")))
    box = F.from_json(detail("bbox"), "array<double>")
    usable = F.when((F.size(box) == 4) & F.forall(box, lambda v: v.isNotNull() & ~F.isnan(v)), box)
    files = entries.withColumn("geo_column", column).select(
        "path", "value", "geo_column", F.lower(F.coalesce(detail("encoding"), F.lit("wkb"))).alias("encoding"),
        detail("crs").alias("crs"), usable.alias("box"))
    return files.groupBy("geo_column", "encoding", "crs").agg(
        F.count(F.lit(1)).alias("files"), F.min("path").alias("path"), F.min_by("value", "path").alias("value"),
        F.bool_and(F.col("box").isNotNull()).alias("boxed"),
        *[F.min(F.get("box", F.lit(i))).alias(f"b{i}") for i in (0, 1)],
        *[F.max(F.get("box", F.lit(i))).alias(f"b{i}") for i in (2, 3)],
    )


def _from_footers(spark: SparkSession, paths: str | list[str], columns: list[str]) -> GeoInfo | None:
    """What most files say of a column the dataset has; ties go to the first path."""
    kinds = footer_census(spark, paths).orderBy(F.desc("files"), "path").limit(FOUND_ROWS).collect()
    told = [(r, info) for r in kinds if (info := parse_geo_metadata(r["value"])) and info.column in columns]
    if not told:
        return None
    row, info = told[0]
    box = tuple(row[f"b{i}"] for i in range(4)) if row["boxed"] else None
    found = tuple((r["geo_column"], r["crs"], r["files"]) for r in kinds)
    return replace(info, bbox=box, mixed=len(told) > 1, found=found)


# ------------------------------------------------------------ name and type


def is_esri_struct(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StructType) and any(
        f.name.lower() in ESRI_FIELDS for f in dtype.fields
    )


def _is_nested(dtype: T.DataType) -> bool:
    return isinstance(list_depth(dtype)[1], T.StructType)


def _hinted(name: str) -> bool:
    return any(part in name for part in NAME_PARTS)


# A text that begins as well-known text does. Fixed value.
_WKT = (r"(?i)^\s*(POINT|LINESTRING|POLYGON|MULTIPOINT|MULTILINESTRING|MULTIPOLYGON|GEOMETRYCOLLECTION)"
        r"\s*(Z|M|ZM)?\s*(\(|EMPTY)")


def text_kind(col: Column) -> Column:
    """esri, wkt, empty or other; null for a null."""
    return (
        F.when(col.isNull(), F.lit(None).cast("string"))
        .when(F.trim(col) == "", "empty")
        .when(looks_like_esri(col), "esri")
        .when(col.rlike(_WKT), "wkt")
        .otherwise("other")
    )


def geometry_census(df: DataFrame, column: str, rows: int | None = None) -> DataFrame:
    """(kind, epsg, n): how many values of a text or Esri column are of which kind.

    One aggregate that merges: every row is classified by itself and counted map-side.
    ``epsg`` is what an Esri value says, else null. Looks at the first ``rows`` non-null
    values only if asked to.
    """
    dtype = field_of(df, column).dataType
    values = df.where(F.col(quoted(column)).isNotNull()).select(F.col(quoted(column)).alias("v"))
    values = values if rows is None else sample_prefix(values, rows)
    kind = text_kind(F.col("v")) if isinstance(dtype, T.StringType) else F.lit("esri")
    epsg = F.when(kind == "esri", esri_epsg(F.col("v"), dtype)).cast("int")
    return values.groupBy(kind.alias("kind"), epsg.alias("epsg")).agg(F.count(F.lit(1)).alias("n"))


def _counted(df: DataFrame, field: T.StructField, rows: int | None) -> GeoInfo:
    """The kind and CRS most values have; ``mixed`` if others have another."""
    found = [tuple(r) for r in geometry_census(df, field.name, rows).orderBy(
        F.desc("n"), F.col("kind"), F.col("epsg")).limit(FOUND_ROWS).collect()]
    sums: dict[str, int] = {}
    for kind, _, n in found:
        if kind in ("esri", "wkt"):
            sums[kind] = sums.get(kind, 0) + n
    encoding = max(sums, key=sums.get) if sums else "esri" if not isinstance(field.dataType, T.StringType) else "wkt"
    codes = [(epsg, n) for kind, epsg, n in found if kind == "esri" and epsg is not None]
    epsg = codes[0][0] if encoding == "esri" and codes else None
    return GeoInfo(
        field.name, encoding, epsg=epsg, is_wgs84=epsg is None or epsg in GEOGRAPHIC_CODES,
        mixed=len(sums) > 1 or (encoding == "esri" and len(codes) > 1), found=tuple(found))


def _nested_info(df: DataFrame, field: T.StructField, rows: int | None) -> GeoInfo:
    return _counted(df, field, rows) if is_esri_struct(field.dataType) else GeoInfo(field.name, "struct")


def _known(df: DataFrame, field: T.StructField, rows: int | None) -> GeoInfo | None:
    name, dtype = field.name.lower(), field.dataType
    if is_native_geometry(dtype) and (name in GEOMETRY_NAMES or _hinted(name)):
        return GeoInfo(field.name, "native")
    if _is_nested(dtype) and (name in GEOMETRY_NAMES or _hinted(name)):
        return _nested_info(df, field, rows)
    if isinstance(dtype, T.StringType) and name in (*GEOMETRY_NAMES, *TEXT_NAMES):
        return _counted(df, field, rows)
    if isinstance(dtype, T.BinaryType) and name in GEOMETRY_NAMES:
        return GeoInfo(field.name, "wkb")
    return None


def _hinted_binary(df: DataFrame, field: T.StructField, rows: int | None) -> GeoInfo | None:
    if isinstance(field.dataType, T.BinaryType) and _hinted(field.name.lower()):
        return GeoInfo(field.name, "wkb")
    return None


def _named(df: DataFrame, field: T.StructField, rows: int | None) -> GeoInfo | None:
    """A known name is enough, whatever the type."""
    if field.name.lower() not in GEOMETRY_NAMES:
        return None
    return GeoInfo(field.name, "wkb")


def _from_schema(df: DataFrame, rows: int | None = None) -> GeoInfo | None:
    for rule in (_known, _hinted_binary, _named):
        for field in df.schema.fields:
            info = rule(df, field, rows)
            if info is not None:
                return info
    return None


def resolve_encoding(df: DataFrame, info: GeoInfo, rows: int | None = None) -> GeoInfo:
    """Let the column's own type decide where it is a native or nested one."""
    dtype = field_of(df, info.column).dataType
    if is_native_geometry(dtype):
        return replace(info, encoding="native")
    if info.encoding in ("wkb", "wkt") and _is_nested(dtype):
        nested = _nested_info(df, field_of(df, info.column), rows)
        return replace(nested, mixed=nested.mixed or info.mixed, found=nested.found or info.found)
    return info


# ---------------------------------------------------------- coordinate range


def in_degree_range(spot: Column) -> Column:
    """Null for a vertex that is no number: an empty point says nothing."""
    finite = ~F.isnan(spot["x"]) & ~F.isnan(spot["y"])
    return F.when(finite, (F.abs(spot["x"]) <= 180) & (F.abs(spot["y"]) <= 90))


def looks_geographic(
    df: DataFrame, geo: GeoInfo, n: int | None = RANGE_ROWS
) -> DataFrame:
    """One row, ``geographic``: do first vertices lie in the degree range?

    Looks at the first ``n`` non-null rows, or at all of them with ``n=None``.
    """
    field = field_of(df, geo.column)
    col = F.col(quoted(geo.column))
    rows = df.filter(col.isNotNull()).select(col.alias("v"))
    if n is not None:
        rows = sample_prefix(rows, n)
    value = decode_column(F.col("v"), geo.encoding, field.dataType, geo.kind)
    spot = rows.select(first_vertex(F.get(value["members"], F.lit(0))).alias("spot"))
    return spot.agg(
        F.coalesce(F.bool_and(in_degree_range(F.col("spot"))), F.lit(True)).alias("geographic")
    )


def detect_geometry(
    df: DataFrame,
    paths: str | list[str] | None = None,
    check_range: bool = True,
    range_rows: int | None = RANGE_ROWS,
    sniff_rows: int | None = None,
) -> GeoInfo | None:
    """Footer metadata first, then column types and names.

    Every footer counts, and every value of a text or Esri column, unless ``sniff_rows``
    says how many; the majority decides, and ``mixed`` and ``found`` tell of the others.
    Whether coordinates are degrees is asked of all rows, or of ``range_rows``.
    """
    info = _from_footers(df.sparkSession, paths, df.columns) if paths else None
    info = info or _from_schema(df, sniff_rows)
    if info is None:
        return None
    info = resolve_encoding(df, info, sniff_rows)
    if check_range and info.is_wgs84 and info.encoding != "esri" and _decodable(df, info):
        if not looks_geographic(df, info, range_rows).first()[0]:
            info = replace(info, is_wgs84=False)
    return info


def _decodable(df: DataFrame, info: GeoInfo) -> bool:
    dtype = field_of(df, info.column).dataType
    wanted = {"wkb": T.BinaryType, "wkt": T.StringType}.get(info.encoding)
    return wanted is None or isinstance(dtype, wanted)


def bbox_wgs84(spark: SparkSession, geo: GeoInfo) -> tuple[float, float, float, float] | None:
    """The metadata bbox with its corners moved to WGS 84."""
    if geo.bbox is None or geo.is_wgs84:
        return geo.bbox
    crs = geo.source_crs()
    if crs is None:
        return None
    x0, y0, x1, y1 = (F.lit(v) for v in geo.bbox)
    corners = F.array(vertex(x0, y0), vertex(x0, y1), vertex(x1, y0), vertex(x1, y1))
    moved = to_wgs84(make_geom("MultiPoint", F.array(F.array(corners))), _params_column(crs))
    ring = F.flatten(F.flatten(moved["parts"]))
    axis = lambda a: F.transform(ring, lambda v: v[a])
    row = spark.range(1).select(
        F.array_min(axis("x")), F.array_min(axis("y")),
        F.array_max(axis("x")), F.array_max(axis("y")),
    ).first()
    return tuple(row) if row[0] is not None else None
