"""Results mean the same at any size, and errors stay the user's own."""

import math

import pytest
from pyspark.errors import AnalysisException, ArithmeticException, NumberFormatException
from pyspark.sql import functions as F

import lakelens as L
from lakelens import Agg, QuerySpec, Sort
from lakelens.functions.crs import CrsDef, parse_definition, registry_row, suggest_crs
from lakelens.functions.decode import decode_geoarrow, decode_wkt
from lakelens.functions.format import fmt_number
from lakelens.operators import rows as rows_module
from lakelens.plans import spec as spec_module


def files(spark, path, sizes=(50, 3, 400)):
    start = 0
    for size in sizes:
        spark.range(start, start + size).coalesce(1).selectExpr("id", "'x' AS tied").write.mode("append").parquet(str(path))
        start += size
    return spark.read.parquet(str(path))


def test_errors_after_a_preview(spark, tmp_path):
    df = files(spark, tmp_path / "t")
    L.preview(df, 3).collect()
    L.with_row_id(df.groupBy("tied").count()).collect()
    with pytest.raises(AnalysisException):
        df.select("nothing")
    with pytest.raises(NumberFormatException):
        df.select(F.col("tied").cast("int")).collect()
    with pytest.raises(ArithmeticException):
        df.select(F.lit(1) / (F.col("id") * 0)).collect()


@pytest.mark.parametrize("top", [200_000, 20])
def test_unsorted_limit_is_file_order(spark, tmp_path, monkeypatch, top):
    df = files(spark, tmp_path / "t")
    monkeypatch.setattr(rows_module, "TOP_ROWS", top)
    monkeypatch.setattr(spec_module, "TOP_ROWS", top)
    first = [r.id for r in L.preview(df, 453).collect()]
    for limit in (5, 60, 300):
        spec = QuerySpec(limit=limit)
        assert [r.id for r in L.run(df, spec).df.orderBy("__row_id").collect()] == first[:limit]
        assert sorted(r.id for r in L.run_spec(df, spec).collect()) == sorted(first[:limit])


def test_no_limit_of_its_own(spark):
    df = spark.range(5000).withColumn("k", F.col("id") % 2500)
    spec = QuerySpec(mode="aggregate", group_by=("k",), aggregates=(Agg("COUNT", "*", "n"),))
    assert L.run_spec(df, spec).count() == L.run(df, spec).df.count() == 2500
    cut = QuerySpec(mode="aggregate", group_by=("k",), aggregates=(Agg("COUNT", "*", "n"),), limit=7)
    assert [r.k for r in L.run_spec(df, cut).collect()] == list(range(7))


def test_pages_of_a_derived_relation_with_ties(spark):
    df = spark.range(1000).repartition(7).groupBy("id").agg(F.lit(1).alias("tied"))
    got = [r.id for p in range(10) for r in L.page(df, p, 100, Sort("tied")).collect()]
    assert sorted(got) == list(range(1000))


def test_profile_reads_all_rows(spark):
    assert L.profile(spark.range(20_001)).first().total == 20_001


def test_nan_points(spark):
    data = [(1.0, 2.0), (math.nan, math.nan), (3.0, 4.0)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(data)], "i int, geometry struct<x: double, y: double>")
    geo = L.detect_geometry(df)
    assert geo.is_wgs84
    feats = L.features(df, geo)
    assert feats.count() == 3
    box = L.extent(feats).first()
    assert tuple(box) == (1.0, 2.0, 3.0, 4.0)
    texts = [r.feature for r in L.features_json(feats).collect()]
    assert not any("NaN" in t for t in texts) and sum('"coordinates":[]' in t for t in texts) == 1
    line = spark.createDataFrame([([(1.0, 2.0), (math.nan, 1.0)],)], "g array<struct<x: double, y: double>>")
    value = line.select(decode_geoarrow(F.col("g"), line.schema["g"].dataType).alias("d")).first().d
    assert value.members is None and "NaN" in value.error


def test_empty_members_of_wkt(spark):
    texts = ["POLYGON ((0 0, 1 0, 1 1, 0 0), EMPTY)", "MULTIPOINT (EMPTY, 1 2)", "MULTIPOLYGON (EMPTY, ((0 0,1 0,1 1,0 0)))",
             "POLYGON EMPTY"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(decode_wkt(F.col("t")).alias("d"))
    got = [r.d for r in df.collect()]
    assert all(d.members is not None for d in got)
    assert [len(d.members[0].parts) for d in got] == [1, 1, 1, 0]


def test_definitions_that_would_be_misread():
    assert parse_definition("+proj=lcc +lat_1=49 +lat_2=44 +lat_0=46.5 +lon_0=0 +pm=paris").lon0 == pytest.approx(2.337229167)
    for text in ("+proj=tmerc +axis=wnd", "+proj=tmerc +axis=eeu", "+proj=merc +what=1", "+proj=longlat +pm=paris", "+proj=lcc +pm=nowhere"):
        with pytest.raises(ValueError, match="unsupported"):
            parse_definition(text)
    assert parse_definition("+proj=tmerc +axis=wsu").axis == "wsu"  # read, not passed over
    assert parse_definition("+proj=merc +axis=enu +no_defs +type=crs").kind == "merc"


def test_areas_across_the_180th_meridian(spark):
    registry = L.crs_registry(spark, [registry_row(3460, "Fiji", CrsDef("tmerc"), "metre", (176.8, -20.9, -178.1, -12.4))])
    points = spark.createDataFrame([(1, 178.0, -18.0), (2, -179.0, -17.0), (3, 0.0, -17.0)], "i int, lon double, lat double")
    best = {(r.i, r.crs_name): r.area for r in suggest_crs(points, registry).collect()}
    assert best[1, "Fiji"] == best[2, "Fiji"] == pytest.approx(5.1 * 8.5)
    assert (3, "Fiji") not in best


def test_ties_round_away_from_zero(spark):
    row = spark.sql("SELECT 0.0005D a, 2.5005D b, -1.2345D c, CAST(7 AS INT) d").select(
        *[fmt_number(F.col(c)).alias(c) for c in "abcd"]).first()
    assert tuple(row) == ("0.001", "2.501", "-1.235", "7")


# Worked examples of the published guidance on coordinate conversions.
EXAMPLES = [
    ("+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80", 3962799.45, 2999718.85, 5.0, 50.0),
    ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=clrk66", 1885472.7, 1535925.0, -75.0, 35.0),
    ("+proj=stere +lat_0=90 +lon_0=0 +k=0.994 +x_0=2000000 +y_0=2000000", 3320416.75, 632668.43, 44.0, 73.0),
    ("+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000", 7255380.79, 7053389.56, 120.0, -75.0),
    ("+proj=eqc +lat_ts=60 +lon_0=10", 20037508.342789244 / 18 / 2, 10018754.171394622 / 3, 20.0, 30.0),
    ("+proj=laea +lat_0=90 +lon_0=0", 0.0, 0.0, 0.0, 90.0),
]


@pytest.mark.parametrize("text, x, y, lon, lat", EXAMPLES)
def test_published_points(spark, text, x, y, lon, lat):
    from lakelens.functions.crs import reproject
    from lakelens.functions.geometry import first_vertex, point

    df = spark.range(1).select(point(F.lit(x), F.lit(y)).alias("geom"))
    spot = reproject(df, "geom", parse_definition(text)).select(first_vertex(F.col("geom")).alias("v")).first().v
    assert (spot.x, spot.y) == (pytest.approx(lon, abs=2e-6), pytest.approx(lat, abs=2e-6))


def test_oblique_stereographic_by_its_forward_formula(spark):
    from lakelens.functions.crs import _isometric, reproject
    from lakelens.functions.geometry import first_vertex, point

    a, e = 6378137.0, math.sqrt(2 / 298.257223563 - 1 / 298.257223563**2)
    chi = lambda p: math.asin(math.tanh(_isometric(math.radians(p), e)))
    lat0, lon0, lat, lon = 46.0, 25.0, 44.5, 28.0
    c0, c, dl = chi(lat0), chi(lat), math.radians(lon - lon0)
    m0 = math.cos(math.radians(lat0)) / math.sqrt(1 - (e * math.sin(math.radians(lat0))) ** 2)
    k = 2 * a * 0.9998 * m0 / (math.cos(c0) * (1 + math.sin(c0) * math.sin(c) + math.cos(c0) * math.cos(c) * math.cos(dl)))
    x = k * math.cos(c) * math.sin(dl)
    y = k * (math.cos(c0) * math.sin(c) - math.sin(c0) * math.cos(c) * math.cos(dl))
    df = spark.range(1).select(point(F.lit(x), F.lit(y)).alias("geom"))
    crs = parse_definition(f"+proj=stere +lat_0={lat0} +lon_0={lon0} +k=0.9998")
    spot = reproject(df, "geom", crs).select(first_vertex(F.col("geom")).alias("v")).first().v
    assert (spot.x, spot.y) == (pytest.approx(lon, abs=1e-9), pytest.approx(lat, abs=1e-9))


def test_staged_tables_are_released(spark):
    from pathlib import Path

    from lakelens.session import scratch_dir, stage

    L.release(spark)
    kept = stage(spark.range(3))
    folder = Path(scratch_dir(spark).removeprefix("file:"))
    tables = set(folder.glob("lakelens-*"))
    assert kept.count() == 3 and L.release(spark) == 1
    assert len(tables - set(folder.glob("lakelens-*"))) == 1 and L.release(spark) == 0
