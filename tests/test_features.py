import json
import warnings

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import lakelens as L
from lakelens import GeoInfo, QuerySpec, Sort
from lakelens.functions.crs import utm
from lakelens.operators.detect import bbox_wgs84, is_esri_struct, parse_geo_metadata
from test_geometry import plain, wkb

POINT = [[[(10.0, 20.0)]]]
FAR = [[[(500000.0, 4400000.0)]]]
SQUARE = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]]]


def crs(code, authority="EPSG"):
    return {"id": {"authority": authority, "code": code}}


def save(path, columns, geo=None, **options):
    table = pa.table(columns)
    if geo is not None:
        table = table.replace_schema_metadata({"geo": geo if isinstance(geo, str) else json.dumps(geo)})
    pq.write_table(table, str(path), **options)
    return str(path)


def meta(encoding="WKB", **about):
    return {"version": "1.0.0", "primary_column": "geometry",
            "columns": {"geometry": {"encoding": encoding, **about}}}


def detect(spark, path):
    return L.detect_geometry(L.load(spark, path, view=None), path)


def test_metadata_tier(spark, tmp_path):
    blob = {"id": [1], "geometry": [wkb("Point", FAR)]}
    info = detect(spark, save(tmp_path / "a.parquet", blob, meta(crs=crs(26912), bbox=[1, 2, 3, 4])))
    assert (info.column, info.encoding, info.epsg, info.is_wgs84) == ("geometry", "wkb", 26912, False)
    assert info.bbox == (1.0, 2.0, 3.0, 4.0) and "26912" in info.crs_string
    near = {"id": [1], "geometry": [wkb("Point", POINT)]}
    info = detect(spark, save(tmp_path / "b.parquet", near, meta(crs=crs("CRS84", "OGC"))))
    assert info.is_wgs84 and info.epsg == 4326
    info = detect(spark, save(tmp_path / "c.parquet", near, meta(bbox=[1, 2, 0, 3, 4, 0])))
    assert info.bbox is None and info.is_wgs84 and info.epsg is None
    compound = meta(crs={"components": [crs(32612), crs(5703)]})
    assert parse_geo_metadata(json.dumps(compound)).epsg == 32612
    # no CRS in the metadata, but metres in the rows
    assert not detect(spark, save(tmp_path / "d.parquet", blob, meta())).is_wgs84
    # unreadable metadata: names and types decide
    info = detect(spark, save(tmp_path / "e.parquet", near, "not json"))
    assert (info.column, info.encoding) == ("geometry", "wkb")
    first_key = {"columns": {"geometry": {}}}
    assert parse_geo_metadata(json.dumps(first_key)).column == "geometry"
    assert parse_geo_metadata(json.dumps({"columns": {}})) is None


def test_native_encodings(spark, tmp_path):
    xy = pa.array([{"x": 1.0, "y": 2.0}])
    info = detect(spark, save(tmp_path / "p.parquet", {"geometry": xy}, meta("point")))
    assert (info.encoding, info.kind) == ("struct", "Point")
    lines = pa.array([[[{"x": 1.0, "y": 2.0}, {"x": 2.0, "y": 3.0}]]])
    path = save(tmp_path / "m.parquet", {"geometry": lines}, meta("multilinestring"))
    feats = L.features(L.load(spark, path, view=None), detect(spark, path)).collect()
    assert plain(feats[0].geom) == ("MultiLineString", [[[(1.0, 2.0), (2.0, 3.0)]]])


def test_boxes_of_many_files_are_united(spark, tmp_path):
    for i in range(3):
        save(tmp_path / f"{i}.parquet", {"geometry": [wkb("Point", FAR)]},
             meta(crs=crs(32612), geometry_types=["Point"] * (i + 1), bbox=[500000 + i, 4400000 - i, 500010 + i, 4400010]))
    no_primary = meta(crs=crs(32612), bbox=[0, 0, 1, 1])
    del no_primary["primary_column"]
    lone = detect(spark, save(tmp_path.parent / f"{tmp_path.name}.parquet", {
        "geometry": [wkb("Point", FAR)]}, no_primary))
    assert lone.bbox == (0.0, 0.0, 1.0, 1.0)
    info = detect(spark, str(tmp_path))
    assert info.bbox == (500000.0, 4399998.0, 500012.0, 4400010.0)
    moved = bbox_wgs84(spark, info)
    assert -111.01 < moved[0] <= moved[2] < -110.99 and 39.7 < moved[1] < moved[3] < 39.8
    assert bbox_wgs84(spark, GeoInfo("g", "wkb", bbox=(1, 2, 3, 4))) == (1, 2, 3, 4)


CASES = [
    ({"geom": [wkb("Point", POINT)]}, ("geom", "wkb")),
    ({"my_wkb_col": [wkb("Point", POINT)]}, ("my_wkb_col", "wkb")),
    ({"wkt": ["POINT(1 2)"]}, ("wkt", "wkt")),
    ({"shape": ['{"x":1,"y":2,"spatialReference":{"wkid":26912}}']}, ("shape", "esri")),
    ({"shape": [None, "POINT(1 2)"]}, ("shape", "wkt")),
    ({"geometry": pa.array([{"x": 1.0, "y": 2.0}])}, ("geometry", "struct")),
    ({"geo_path": pa.array([[{"x": 1.0, "y": 2.0}]])}, ("geo_path", "struct")),
    ({"geometry": pa.array([{"rings": [[[1.0, 2.0]]], "spatialReference": {"wkid": 3857}}])},
     ("geometry", "esri")),
    ({"geometry": pa.array([{"viewpoints": 1, "x": 1.0, "y": 2.0}])}, ("geometry", "struct")),
    ({"shape": [3]}, ("shape", "wkb")),
    ({"payload": [b"x"], "geom": [wkb("Point", POINT)]}, ("geom", "wkb")),
    ({"id": [1], "name": ["x"]}, None),
]


@pytest.mark.parametrize("columns,expected", CASES, ids=range(len(CASES)))
def test_name_and_type_tier(spark, tmp_path, columns, expected):
    info = detect(spark, save(tmp_path / "x.parquet", columns))
    assert (None if info is None else (info.column, info.encoding)) == expected
    if expected and expected[1] == "esri":
        assert info.epsg in (26912, 3857) and not info.is_wgs84


def test_esri_fields_are_matched_whole(spark):
    df = spark.sql("SELECT struct(1 AS viewpoints) AS a, struct(1 AS Paths) AS b")
    assert not is_esri_struct(df.schema["a"].dataType) and is_esri_struct(df.schema["b"].dataType)


ESRI = '{"x": 1, "y": 2, "spatialReference": {"wkid": %d}}'


def test_every_value_counts(spark):
    """One Esri text before nine WKT ones, or an empty one before many, does not decide."""
    shapes = lambda texts: spark.createDataFrame([(t,) for t in texts], "shape string")
    info = L.detect_geometry(shapes([ESRI % 3857] + ["POINT (1 2)"] * 9))
    assert (info.encoding, info.epsg, info.mixed) == ("wkt", None, True)
    assert info.found == (("wkt", None, 9), ("esri", 3857, 1))
    info = L.detect_geometry(shapes(["", None, "{"] + [ESRI % 2056] * 3 + [ESRI % 4326]))
    assert (info.encoding, info.epsg, info.is_wgs84, info.mixed) == ("esri", 2056, False, True)
    assert L.detect_geometry(shapes([None, " "])).encoding == "wkt"
    plain = L.detect_geometry(shapes(["linestring m empty"] * 2))
    assert (plain.encoding, plain.mixed, plain.found) == ("wkt", False, (("wkt", None, 2),))
    first = L.detect_geometry(shapes([ESRI % 3857] + ["POINT (1 2)"] * 9), sniff_rows=1)
    assert (first.encoding, first.mixed) == ("esri", False)


def test_every_footer_counts(spark, tmp_path):
    """Two of three files name one CRS; the first by path names another."""
    for name, code in (("a", 32633), ("b", 32612), ("c", 32612)):
        save(tmp_path / f"{name}.parquet", {"geometry": [wkb("Point", FAR)]}, meta(crs=crs(code)))
    info = detect(spark, str(tmp_path))
    assert (info.epsg, info.mixed, [f[2] for f in info.found]) == (32612, True, [2, 1])


@pytest.mark.parametrize("depth", range(4))
def test_range_check_at_every_depth(spark, tmp_path, depth):
    for x, geographic in ((100.0, True), (1000.0, False)):
        value = {"x": x, "y": 2.0}
        for _ in range(depth):
            value = [value]
        path = save(tmp_path / f"{depth}{geographic}.parquet", {"geometry": pa.array([None, value])})
        assert detect(spark, path).is_wgs84 is geographic


def test_override(spark):
    info = GeoInfo("g", "wkb", is_wgs84=False)
    assert info.source_crs() is None
    assert info.with_epsg(26912).source_crs().kind == "tmerc" and not info.with_epsg(26912).is_wgs84
    assert info.with_epsg(4326).is_wgs84 and info.with_epsg(None).is_wgs84
    assert info.with_epsg(9999, utm(5)).source_crs() == utm(5)


@pytest.fixture
def places(spark):
    rows = [(i, f"p{i}", f"POINT ({i} {i})" if i % 4 else None) for i in range(20)]
    return spark.createDataFrame(rows, "i int, name string, geometry string").repartition(3)


def test_ids_match_the_result_table(places):
    """The default result leaves nothing out of step: filter, order and limit hold."""
    spec = QuerySpec(filters=(L.Filter("i", ">=", 5),), sorts=(Sort("i", "DESC"),), limit=6)
    geo = GeoInfo("geometry", "wkt")
    result = L.run(places, spec).df.drop("geometry")
    feats = L.features(places, geo, spec)
    got = {r["__row_id"]: (r.properties.i, r.geom.parts[0][0][0].x) for r in feats.collect()}
    assert got == {i: (19 - i, 19.0 - i) for i in range(6) if (19 - i) % 4}
    joined = L.join_features(result, feats).collect()
    assert sorted((r["__row_id"], r.i) for r in joined) == [(k, v[0]) for k, v in sorted(got.items())]
    shown = L.features(places, geo, QuerySpec(columns=("name",), sorts=(Sort("i"),), limit=3))
    assert shown.schema["properties"].dataType.names == ["name"]
    assert sorted(r["__row_id"] for r in shown.collect()) == [1, 2]


def test_empty_result_maps_nothing(places):
    spec = QuerySpec(filters=(L.Filter("i", ">", 99),), sorts=(Sort("i"),))
    assert L.features(places, GeoInfo("geometry", "wkt"), spec).count() == 0


def test_errors_can_be_kept(spark):
    df = spark.createDataFrame([(0, "POINT(1 2)"), (1, "nonsense"), (2, None)], "i int, wkt string")
    spec = QuerySpec(sorts=(Sort("i"),))
    geo = GeoInfo("wkt", "wkt")
    kept = L.features(df, geo, spec, keep_errors=True).orderBy("__row_id").collect()
    assert [(r["__row_id"], r.geom is None, r.geom_error) for r in kept] == [
        (0, False, None), (1, True, "malformed WKT"), (2, True, None)]
    assert L.features(df, geo, spec).count() == 1


def test_unknown_projection_is_held_back(spark):
    df = spark.createDataFrame([(0, wkb("Point", FAR))], "i int, geometry binary")
    geo = GeoInfo("geometry", "wkb", is_wgs84=False)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert L.features(df, geo).count() == 0
    assert "CRS is not known" in str(caught[0].message)
    with pytest.raises(ValueError, match="CRS is not known"):
        L.features(df, geo, strict=True)
    spot = L.features(df, geo.with_epsg(32612)).first().geom.parts[0][0][0]
    assert spot.x == pytest.approx(-111) and spot.y == pytest.approx(39.75, abs=0.01)


def test_collections_share_the_row_id(spark, tmp_path):
    text = "GEOMETRYCOLLECTION(POINT(1 2), POLYGON((0 0,4 0,4 4,0 0)))"
    df = spark.createDataFrame([(0, text), (1, "POINT(5 6)")], "i int, wkt string")
    feats = L.features(df, GeoInfo("wkt", "wkt"), QuerySpec(sorts=(Sort("i"),)))
    got = sorted((r["__row_id"], r.member_idx, *plain(r.geom)) for r in feats.collect())
    assert got == [(0, 0, "Point", [[[(1.0, 2.0)]]]), (0, 1, "Polygon", SQUARE),
                   (1, 0, "Point", [[[(5.0, 6.0)]]])]
    out = str(tmp_path / "out")
    L.write_geojson(feats, out)
    lines = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert sorted((f["id"], f["geometry"]["type"]) for f in lines) == [
        (0, "Point"), (0, "Polygon"), (1, "Point")]
    assert all(f["type"] == "Feature" and f["properties"]["__row_id"] == f["id"] for f in lines)


def test_attributes(spark):
    df = spark.createDataFrame([(7, None, "POINT(1 2)")], "i int, n string, wkt string")
    feats = L.features(df, GeoInfo("wkt", "wkt"), QuerySpec(sorts=(Sort("i"),)))
    rows = L.feature_attributes(feats, 0).orderBy("key").collect()
    assert [(r.key, r.value, r.is_null) for r in rows] == [("i", "7", False), ("n", None, True)]
    assert L.feature_attributes(feats, 5).count() == 0


def test_only_wkb_leaves_the_jvm(spark):
    """No row-at-a-time Python anywhere; WKB alone goes through Arrow."""
    df = spark.createDataFrame([(0, b"", "")], "i int, geometry binary, wkt string")
    text = lambda geo: L.features(df, geo, QuerySpec(sorts=(Sort("i"),)))._jdf.queryExecution(
        ).executedPlan().toString()
    assert "Python" not in text(GeoInfo("wkt", "wkt")) and "BatchEval" not in text(GeoInfo("wkt", "wkt"))
    assert "ArrowEvalPython" in text(GeoInfo("geometry", "wkb"))
    assert "BatchEvalPython" not in text(GeoInfo("geometry", "wkb"))
