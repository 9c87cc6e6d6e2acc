"""Decoders from the stored encodings to the canonical geometry.

Each decoder returns ``struct<members, error>``: one member for a plain
geometry, several for a collection (one level), null members and a reason where
the value cannot be read, and null for a null value. Everything but WKB is a
Column expression; WKB bytes are walked in an Arrow function.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelens.functions import wkb
from lakelens.functions.geometry import (
    DECODED_TYPE,
    GEOM_TYPE,
    PARTS_TYPE,
    let,
    make_geom,
    map_vertices,
    point,
    vertex,
    vertices,
)

_MEMBERS = f"array<{GEOM_TYPE}>"

WKT_NAMES = {name.upper(): name for name in wkb.NAMES.values()}

_WKT_SHAPE = (
    rf"(?i:(?:{'|'.join(WKT_NAMES)}) *(?:ZM|Z|M)? *(?:EMPTY|\([-+0-9.E, ()]*\)))"
)


def decoded(members: Column, error: Column) -> Column:
    return F.struct(members.alias("members"), error.alias("error")).cast(DECODED_TYPE)


def _alone(geom: Column, reason: str) -> Column:
    """A single member, or the reason there is none."""
    return let(
        geom,
        lambda g: F.when(g.isNotNull(), decoded(F.array(g), F.lit(None).cast("string"))).otherwise(
            decoded(F.lit(None).cast(_MEMBERS), F.lit(reason))),
    )


def only_member(value: Column) -> Column:
    """The geometry of a decoded value that is not a collection of several."""
    return let(
        value["members"], lambda m: F.when(F.size(m) == 1, F.get(m, F.lit(0)))
    )


# --------------------------------------------------------------------- WKT


def _ring(text: Column) -> Column:
    """``x y, x y, ...`` to vertices; a null vertex where one is malformed."""

    def spot(words: Column) -> Column:
        x = F.get(words, F.lit(0)).try_cast("double")
        y = F.get(words, F.lit(1)).try_cast("double")
        return F.when(F.size(words).between(2, 4), vertex(x, y))

    return F.transform(F.split(text, ","), lambda pair: let(F.split(pair, " "), spot))


def _part(text: Column) -> Column:
    return F.transform(F.split(F.replace(text, F.lit("),("), F.lit(";")), ";"), _ring)


def _parts(word: Column, body: Column) -> Column:
    """Vertices of a coordinate list without needless spaces.

    Splitting is by single characters, which Spark does without a pattern.

    What is left of the list without its numbers shows whether the brackets are
    nested as the type wants them; it is folded level by level, since a pattern
    repeating a group would recurse once per ring.
    """
    bare = F.translate(body, "()", "")
    inner = F.substring(body, F.lit(2), F.length(body) - 2)
    frame = F.replace(F.regexp_replace(body, "[^()]+", ""), F.lit("()"), F.lit("o"))
    rings = frame.rlike(r"^\(o+\)$")
    polygons = F.regexp_replace(frame, r"\(o+\)", "p").rlike(r"^\(p+\)$")
    rings_text = F.substring(body, F.lit(3), F.length(body) - 4)
    parts_text = F.substring(body, F.lit(4), F.length(body) - 6)
    return (
        F.when(word.isin("POINT", "LINESTRING"), F.when(frame == "o", F.array(F.array(_ring(inner)))))
        .when(word == "MULTIPOINT", F.when(rings | (frame == "o"), F.array(F.array(_ring(bare)))))
        .when(word.isin("POLYGON", "MULTILINESTRING"), F.when(rings, F.array(_part(rings_text))))
        .when(word == "MULTIPOLYGON",
              F.when(polygons, F.transform(
                  F.split(F.replace(parts_text, F.lit(")),(("), F.lit(":")), ":"), _part)))
    )


def _wkt_shape(text: Column) -> Column:
    """One non-collection WKT text to a geometry; null if malformed."""
    names = F.create_map(*[F.lit(v) for pair in WKT_NAMES.items() for v in pair])
    split = F.struct(
        F.upper(F.regexp_extract(text, r"^([A-Za-z]+?)(?: ?[ZMzm]{1,2})? ?(?:\(|(?i:EMPTY)$)", 1))
        .alias("word"),
        F.regexp_extract(text, r"(\(.*\))$", 1).alias("body"),
    )

    def whole(part: Column) -> Column:
        return F.forall(part, lambda ring: F.forall(
            ring, lambda v: v["x"].isNotNull() & v["y"].isNotNull()))

    def build(s: Column) -> Column:
        parts = F.when(s["body"] == "", F.array().cast(PARTS_TYPE)).otherwise(
            _parts(s["word"], s["body"]))
        one = (s["word"] != "POINT") | (s["body"] == "") | ~s["body"].contains(",")
        return let(
            parts,
            lambda p: F.when(
                one & F.forall(p, whole),
                F.struct(F.element_at(names, s["word"]).alias("type"), p.alias("parts")),
            ),
        )

    return F.when(text.rlike(rf"^{_WKT_SHAPE}$"), let(split, build))


def _wkt_value(text: Column) -> Column:
    """A plain shape, or the shapes of a collection."""
    head = r"^(?i)GEOMETRYCOLLECTION ?(?:ZM|Z|M)? ?"
    bad = decoded(F.lit(None).cast(_MEMBERS), F.lit("malformed WKT"))
    none = F.lit(None).cast("string")

    def collection(inner: Column) -> Column:
        shapes = F.regexp_extract_all(inner, F.lit(_WKT_SHAPE), F.lit(0))
        rest = F.regexp_replace(inner, _WKT_SHAPE, "")
        return (
            F.when(inner.rlike("(?i)GEOMETRYCOLLECTION"),
                   decoded(F.lit(None).cast(_MEMBERS), F.lit("nested collection")))
            .when((inner == "") | rest.rlike(r"[^\s,]"), bad)
            .otherwise(let(
                F.transform(shapes, lambda t: _wkt_shape(F.trim(t))),
                lambda m: F.when(F.exists(m, lambda g: g.isNull()), bad).otherwise(decoded(m, none)),
            ))
        )

    return (
        F.when(
            ~text.rlike("^(?i)GEOMETRYC"),
            let(_wkt_shape(text),
                lambda g: F.when(g.isNull(), bad).otherwise(decoded(F.array(g), none))),
        )
        .when(text.rlike(rf"{head}EMPTY$"), decoded(F.array().cast(_MEMBERS), none))
        .otherwise(let(F.regexp_extract(text, rf"{head}\((.*)\)$", 1), collection))
    )


def decode_wkt(col: Column) -> Column:
    text = F.trim(F.when(col.startswith("SRID="), F.regexp_extract(col, r"(?s);(.*)$", 1)).otherwise(col))
    # No space next to a bracket or comma, one between numbers.
    compact = F.regexp_replace(text, r"\s*([(),])\s*|\s(?=\s)", "$1")
    compact = F.when(compact.rlike(r"[\t\r\n]"), F.translate(compact, "\t\r\n", "   ")).otherwise(
        compact)
    # Empty members of a list add nothing to it.
    compact = F.when(compact.rlike("(?i)[(,]EMPTY"), F.regexp_replace(
        F.regexp_replace(compact, r"(?i),EMPTY(?=[,)])", ""), r"(?i)(?<=\()EMPTY,", "")).otherwise(compact)
    return F.when(col.isNotNull(), let(compact, _wkt_value))


# ---------------------------------------------------------------- GeoArrow


def _checked(geom: Column) -> Column:
    """The geometry, or null if a coordinate is null or NaN."""
    return let(
        geom,
        lambda g: F.when(
            F.forall(vertices(g), lambda v: v["x"].isNotNull() & v["y"].isNotNull()
                     & ~F.isnan(v["x"]) & ~F.isnan(v["y"])), g),
    )


def list_depth(dtype: T.DataType) -> tuple[int, T.DataType]:
    depth = 0
    while isinstance(dtype, T.ArrayType):
        depth, dtype = depth + 1, dtype.elementType
    return depth, dtype


def decode_geoarrow(col: Column, dtype: T.DataType, kind: str | None = None) -> Column:
    """Nested x/y structs; the type follows from the list depth unless given."""
    depth, leaf = list_depth(dtype)
    if depth > 3 or not isinstance(leaf, T.StructType) or not {"x", "y"} <= set(leaf.names):
        raise ValueError(f"not a GeoArrow column: {dtype.simpleString()}")
    kind = kind or ("Point", "LineString", "Polygon", "MultiPolygon")[depth]
    if kind == "MultiLineString":
        parts = F.array(col)
    else:
        parts = col
        for _ in range(3 - depth):
            parts = F.array(parts)
    xy = map_vertices(parts, lambda v: vertex(v["x"], v["y"]))
    shape = _checked(make_geom(kind, xy))
    if kind == "Point":  # an empty point is written as NaN
        hollow = F.isnan(col["x"]) & F.isnan(col["y"])
        shape = F.when(hollow, make_geom(kind, F.array().cast(PARTS_TYPE))).otherwise(shape)
    return F.when(col.isNotNull(), _alone(shape, "null or NaN coordinate"))


# --------------------------------------------------------------- Esri JSON

ESRI_SCHEMA = (
    "rings array<array<array<double>>>, paths array<array<array<double>>>, "
    "points array<array<double>>, x double, y double, "
    "spatialReference struct<wkid: int, latestWkid: int>"
)


def esri_struct(col: Column, dtype: T.DataType) -> Column:
    """The Esri fields of a text or struct column."""
    text = col if isinstance(dtype, T.StringType) else F.to_json(col)
    return F.from_json(text, ESRI_SCHEMA)


def decode_esri(col: Column, dtype: T.DataType | None = None) -> Column:
    """Rings, paths, points or x/y, whichever comes first in that order."""
    value = esri_struct(col, dtype or T.StringType())
    return F.when(
        col.isNotNull(),
        _alone(let(value, lambda e: _checked(_esri_shape(e))), "no Esri geometry"),
    )


def _esri_shape(e: Column) -> Column:
    xy = lambda ring: F.transform(
        ring, lambda c: vertex(F.get(c, F.lit(0)), F.get(c, F.lit(1))))
    rings = lambda rs: F.array(F.transform(rs, xy))
    return (
        F.when(e["rings"].isNotNull(), make_geom("Polygon", rings(e["rings"])))
        .when(F.size(e["paths"]) == 1, make_geom("LineString", rings(e["paths"])))
        .when(e["paths"].isNotNull(), make_geom("MultiLineString", rings(e["paths"])))
        .when(e["points"].isNotNull(), make_geom("MultiPoint", F.array(F.array(xy(e["points"])))))
        .when(e["x"].isNotNull() & e["y"].isNotNull(), point(e["x"], e["y"]))
    )


def looks_like_esri(col: Column) -> Column:
    """Whether a text starts like an Esri geometry object (either quote)."""
    text = F.trim(col)
    has = lambda key: text.contains(f"'{key}'") | text.contains(f'"{key}"')
    return F.coalesce(
        text.startswith("{")
        & (has("rings") | has("paths") | has("points") | (has("x") & has("spatialReference"))),
        F.lit(False),
    )


def esri_epsg(col: Column, dtype: T.DataType | None = None) -> Column:
    ref = esri_struct(col, dtype or T.StringType())["spatialReference"]
    return F.coalesce(ref["wkid"], ref["latestWkid"])


# --------------------------------------------------------------------- WKB


_XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_GEOM = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("parts", T.ArrayType(T.ArrayType(T.ArrayType(_XY)))),
    ]
)
_DECODED = T.StructType(
    [T.StructField("members", T.ArrayType(_GEOM)), T.StructField("error", T.StringType())]
)


@F.arrow_udf(_DECODED)
def _decode_wkb(values: pa.Array) -> pa.Array:
    return wkb.decode_batch(values)


def decode_wkb(col: Column) -> Column:
    return _decode_wkb(col)


def decode_native(col: Column) -> Column:
    """Spark's own GEOMETRY type (``spark.sql.geospatial.enabled``)."""
    return _decode_wkb(F.call_function("st_asbinary", col))


def decode_column(col: Column, encoding: str, dtype: T.DataType, kind: str | None = None) -> Column:
    """Decode by encoding name: wkb, wkt, struct, esri or native."""
    if encoding == "wkb":
        return decode_wkb(col)
    if encoding == "wkt":
        return decode_wkt(col)
    if encoding == "struct":
        return decode_geoarrow(col, dtype, kind)
    if encoding == "esri":
        return decode_esri(col, dtype)
    if encoding == "native":
        return decode_native(col)
    raise ValueError(f"unknown geometry encoding {encoding!r}")


def from_wkb(col: Column) -> Column:
    return only_member(decode_wkb(col))


def from_wkt(col: Column) -> Column:
    return only_member(decode_wkt(col))


def from_geoarrow(col: Column, dtype: T.DataType, kind: str | None = None) -> Column:
    return only_member(decode_geoarrow(col, dtype, kind))


def from_esri(col: Column, dtype: T.DataType | None = None) -> Column:
    return only_member(decode_esri(col, dtype))


def from_native(col: Column) -> Column:
    return only_member(decode_native(col))
