"""Pages from a manifest, and registries from definition texts."""

import json
import random

import pytest
from pyspark.sql import functions as F

import lakelens as L
from lakelens import Sort
from lakelens.functions.crs import CrsDef, builtin_crs, parse_definition, utm
from lakelens.functions.definitions import parse_projjson, parse_text, registry_from_texts
from lakelens.functions.geometry import point
from lakelens.operators.pageindex import build_page_index


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(i, None if i % 50 == 0 else 7 if i % 3 == 0 else rng.randrange(90), f"r{i}") for i in range(1200)]
    return spark.createDataFrame(data, "i int, k int, t string").repartition(4)


@pytest.mark.parametrize("direction", ["ASC", "DESC"])
def test_pages_are_those_of_the_sorted_relation(spark, rows, tmp_path, direction):
    sorts = [Sort("k", direction), Sort("i")]
    index = build_page_index(rows, sorts, str(tmp_path / direction), file_rows=64)
    want = [tuple(r) for r in L.with_row_id(rows, sorts).orderBy("__row_id").collect()]
    assert index.rows() == 1200 and index.manifest.agg(F.max("rows")).first()[0] == 64
    for page, size in ((0, 10), (3, 100), (-1, 5), (11, 100), (12, 100), (0, 5000)):
        start = max(0, page) * size
        assert [tuple(r) for r in index.page(page, size).collect()] == want[start:start + size]
    read = index.page(5, 32)._jdf.queryExecution().executedPlan().toString()
    assert read.count("FileScan parquet") == 1 and "1 paths" in read
    keys = [r[2] for r in want]
    for value in (0, 7, 8, 89, 500, -5):
        past = (lambda k: k is None or k <= value) if direction == "DESC" else (lambda k: k is None or k >= value)
        first = next((n for n, k in enumerate(keys) if past(k)), len(keys))
        assert index.seek(value) == first
        assert [tuple(r) for r in index.page_from(value, 20).collect()] == want[first:first + 20]


def test_pages_of_nothing(spark, rows, tmp_path):
    index = build_page_index(rows.limit(0), [Sort("k")], str(tmp_path / "none"))
    assert index.rows() == 0


PLACE = {"type": "GeodeticReferenceFrame", "name": "x",
         "ellipsoid": {"name": "Bessel", "semi_major_axis": 6377397.155, "inverse_flattening": 299.1528128}}


def projected(method, axes=("east", "north"), unit="metre", **parameters):
    return {"type": "ProjectedCRS", "name": "n", "base_crs": {"type": "GeographicCRS", "datum": PLACE},
            "conversion": {"name": "c", "method": {"name": method}, "parameters": [
                {"name": k.replace("_", " "), "value": v} for k, v in parameters.items()]},
            "coordinate_system": {"subtype": "Cartesian", "axis": [
                {"name": a, "direction": a, "unit": unit} for a in axes]}}


def test_projjson():
    bessel = {"a": 6377397.155, "rf": 299.1528128}
    dutch = projected("Oblique Stereographic", Latitude_of_natural_origin=52.15616, Longitude_of_natural_origin=5.3876,
                      Scale_factor_at_natural_origin=0.9999079, False_easting=155000, False_northing=463000)
    want = CrsDef("sterea", **bessel, lat0=52.15616, lon0=5.3876, k0=0.9999079, fe=155000.0, fn=463000.0)
    assert parse_projjson(dutch) == want
    bound = {"type": "BoundCRS", "source_crs": dutch, "transformation": {
        "method": {"name": "Coordinate Frame rotation (geog2D domain)"}, "parameters": [
            {"name": "X-axis translation", "value": 565.0}, {"name": "Z-axis rotation", "value": 2.0}]}}
    assert parse_projjson(bound).shift == (565.0, 0.0, 0.0, -0.0, -0.0, -2.0, 0.0)
    south = projected("Krovak", ("south", "west"), Latitude_of_projection_centre=49.5, Longitude_of_origin=24.83333,
                      **{"Co-latitude_of_cone_axis": 30.288, "Latitude_of_pseudo_standard_parallel": 78.5,
                         "Scale_factor_on_pseudo_standard_parallel": 0.9999})
    assert parse_projjson(south).axis == "swu" and parse_projjson(south).kind == "krovak"
    assert parse_projjson({"type": "GeographicCRS", "datum": PLACE}) == CrsDef("longlat", **bessel)
    for bad in (projected("Bonne"), projected("Transverse Mercator", Odd=1), {"type": "VerticalCRS"},
                projected("Transverse Mercator", unit="furlong")):
        with pytest.raises(ValueError, match="unsupported"):
            parse_projjson(bad)
    for text in ("{", '{"type": "ProjectedCRS"}'):
        with pytest.raises(ValueError, match="unsupported"):
            parse_text(text)


def test_registry_of_many_texts(spark):
    texts = [(code, d, f"+proj=utm +zone={code % 100} +datum=WGS84 +units=m" + (" +south" if code > 32700 else ""), *area)
             for code, (d, _, _, area) in builtin_crs().items() if 32600 < code < 32800]
    swiss = "+proj=somerc +lat_0=46.952405555555556 +lon_0=7.439583333333333 +x_0=2600000 +y_0=1200000 +ellps=bessel"
    dutch = json.dumps(projected("Transverse Mercator", Longitude_of_natural_origin=9, Scale_factor_at_natural_origin=1))
    texts += [(2056, "grid", swiss, 5.9, 45.8, 10.5, 47.9), (31467, "zone", dutch, 7.5, 47.0, 10.5, 55.0),
              (1, "bad", "+proj=gnom", 0.0, 0.0, 1.0, 1.0), (2, None, None, 0.0, 0.0, 1.0, 1.0), (3, "b", " ", 0.0, 0.0, 1.0, 1.0)]
    table = spark.createDataFrame(texts, "epsg int, name string, definition string, w double, s double, e double, n double")
    registry = registry_from_texts(table.repartition(3), name="name", area=("w", "s", "e", "n"))
    told = {r.epsg: (r.params, r.error) for r in registry.collect()}
    assert len(told) == 125
    assert {k for k, (p, _) in told.items() if p is None} == {k for k, (_, e) in told.items() if e is not None} == {1, 2, 3}
    assert told[32633][0].asDict() == utm(33).params() and told[2056][0].asDict() == parse_definition(swiss).params()
    places = spark.createDataFrame([(2056, 2679520.05, 1212273.44), (1, 1.0, 1.0)], "epsg int, x double, y double").withColumn(
        "geom", point(F.col("x"), F.col("y")))
    got = {r.epsg: (r.geom, r.geom_error) for r in L.reproject(places, registry=registry).collect()}
    spot = got[2056][0].parts[0][0][0]
    assert (spot.x, spot.y) == pytest.approx((8.486419, 47.058043), abs=1e-6) and got[1] == (None, "unsupported CRS")
    spots = spark.createDataFrame([(8.5, 47.1)], "lon double, lat double")
    assert [r.epsg for r in L.suggest_crs(spots, registry.where("params IS NOT NULL"), k=2).orderBy("rank").collect()] == [2056, 31467]
