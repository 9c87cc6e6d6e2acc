"""Writers: recompressed Parquet and GeoJSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelens.functions.geometry import to_geojson
from lakelens.sources.load import hadoop_uri, load


def recompress(spark: SparkSession, src: str, dst: str, codec: str = "snappy") -> None:
    """Rewrite Parquet with another codec; rows and columns stay as ``load`` reads them."""
    df = load(spark, src, view=None)
    df.write.option("compression", codec).parquet(hadoop_uri(dst))


def features_json(features: DataFrame) -> DataFrame:
    """One GeoJSON Feature text per feature with a usable geometry."""
    properties = F.struct("properties.*", F.col("__row_id").alias("__row_id"))
    feature = F.concat(
        F.lit('{"type":"Feature","id":'),
        F.col("__row_id").cast("string"),
        F.lit(',"geometry":'),
        to_geojson(F.col("geom")),
        F.lit(',"properties":'),
        F.to_json(properties, {"ignoreNullFields": "false"}),
        F.lit("}"),
    )
    return features.filter(F.col("geom").isNotNull()).select("__row_id", feature.alias("feature"))


def write_geojson(features: DataFrame, path: str) -> None:
    """GeoJSON text, one Feature per line, as many part files as tasks."""
    features_json(features).select("feature").write.text(hadoop_uri(path))
