"""Profiling, querying and mapping Parquet and GeoParquet data on Spark."""

import sys

from pyspark import cloudpickle

from lakelens.functions.crs import (
    CrsDef,
    crs_registry,
    parse_definition,
    reproject,
    suggest_crs,
    with_crs,
)
from lakelens.functions.definitions import registry_from_texts
from lakelens.functions.geometry import extent, representative_point, to_geojson
from lakelens.operators.aggregates import Agg, recent_distinct
from lakelens.operators.detect import GeoInfo, detect_geometry, geometry_census, looks_geographic
from lakelens.operators.features import feature_attributes, features, join_features
from lakelens.operators.intervals import contains, overlaps, points_in_ranges, range_pairs
from lakelens.operators.ordering import Sort, natural_sort
from lakelens.operators.pageindex import PageIndex, build_page_index
from lakelens.operators.predicates import Filter, where
from lakelens.operators.profile import profile
from lakelens.operators.rows import (
    numbered_page,
    page,
    page_count,
    row_lookup,
    sample_prefix,
    select_visible,
    with_row_id,
)
from lakelens.operators.sliding import sliding_distinct, sliding_extremes
from lakelens.plans.spec import QuerySpec, Result, preview, run, run_spec
from lakelens.plans.sqlapi import run_sql, run_sql_numbered
from lakelens.session import configure, release
from lakelens.sources.drift import drift_report, uncast_values
from lakelens.sources.footers import audit_files, file_stats, footers, kv_metadata, schema_drift
from lakelens.sources.load import load, normalize_uris
from lakelens.sources.schema import describe
from lakelens.sources.sinks import features_json, recompress, write_geojson

# The Arrow functions travel with their code: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [name for name in dir() if not name.startswith("_")]
