"""From query results to map features and back."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.functions.crs import reproject
from lakelens.functions.decode import decode_column
from lakelens.functions.geometry import GEOM_TYPE
from lakelens.operators.detect import GeoInfo
from lakelens.operators.ordering import ROW_ID
from lakelens.operators.rows import with_row_id
from lakelens.plans.spec import QuerySpec, run_spec_numbered
from lakelens.sources.schema import field_of, quoted


def property_columns(df: DataFrame, geom: str) -> list[str]:
    """Everything but the geometry, the row id and binary columns."""
    return [
        f.name
        for f in df.schema.fields
        if f.name not in (geom, ROW_ID) and f.dataType.typeName() != "binary"
    ]


def properties(df: DataFrame, geom: str):
    """The property columns as one struct."""
    return F.struct(*[F.col(quoted(c)) for c in property_columns(df, geom)])


def explode_collections(decoded: DataFrame, value: str = "__decoded") -> DataFrame:
    """One row per collection member; plain and unreadable values keep one row."""
    members = F.posexplode_outer(F.col(value)["members"]).alias("member_idx", "geom")
    kept = [F.col(quoted(c)) for c in decoded.columns if c != value]
    return decoded.select(*kept, F.col(value)["error"].alias("geom_error"), members)


def features(
    df: DataFrame,
    geo: GeoInfo,
    spec: QuerySpec | None = None,
    strict: bool = False,
    keep_errors: bool = False,
) -> DataFrame:
    """(__row_id, member_idx, geom, properties, geom_error) in WGS 84.

    The geometry stays with the rows through filters and limits, so ids are
    those of ``run_spec_numbered`` for the same query. Rows without a usable
    geometry are skipped but keep their id; ``keep_errors`` shows them.
    """
    if not geo.is_wgs84 and geo.source_crs() is None:
        reason = f"column {geo.column!r} is projected and its CRS is not known"
        if strict:
            raise ValueError(reason)
        warnings.warn(reason, stacklevel=2)
        df = df.filter(F.lit(False))
    if spec is not None:
        numbered = run_spec_numbered(
            df, QuerySpec(**{**spec.__dict__, "keep": (*spec.keep, geo.column)})
        )
    else:
        numbered = df if ROW_ID in df.columns else with_row_id(df)
    dtype = field_of(numbered, geo.column).dataType
    value = decode_column(F.col(quoted(geo.column)), geo.encoding, dtype, geo.kind)
    decoded = numbered.select(
        ROW_ID, value.alias("__decoded"), properties(numbered, geo.column).alias("properties")
    )
    out = explode_collections(decoded)
    crs = geo.source_crs()
    if crs is not None and not geo.is_wgs84:
        out = reproject(out, "geom", crs)
    if not keep_errors:
        out = out.filter(F.col("geom").isNotNull())
    return out.select(
        ROW_ID,
        F.coalesce("member_idx", F.lit(0)).alias("member_idx"),
        F.col("geom").cast(GEOM_TYPE).alias("geom"),
        "properties",
        "geom_error",
    )


def join_features(result: DataFrame, feats: DataFrame) -> DataFrame:
    """Result rows with their features, matched on the row id."""
    return result.join(feats.drop("properties"), ROW_ID)


def feature_attributes(feats: DataFrame, row_id: int | None = None) -> DataFrame:
    """(key, value) per property of a feature (of all features without an id)."""
    chosen = feats if row_id is None else feats.filter(F.col(ROW_ID) == row_id)
    names = chosen.schema["properties"].dataType.names
    first = chosen.filter(F.col("member_idx") == 0)
    pairs = F.array(
        *[
            F.struct(
                F.lit(n).alias("key"),
                F.col("properties").getField(n).cast("string").alias("value"),
            )
            for n in names
            if n != ROW_ID
        ]
    )
    return first.select(ROW_ID, F.inline(pairs)).withColumn(
        "is_null", F.col("value").isNull()
    )
