"""Registered queries: scans, filters, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from bathyspark.functions import filters as P
from bathyspark.operators import ordering as O
from bathyspark.operators.filtered import query_floats, query_profiles
from bathyspark.operators.shape import project_parameters
from bathyspark.plans.oracle import FLOAT_COLS_SQL, PROFILE_COLS_SQL, sql
from bathyspark.schemas import FLOAT_COLUMNS, PROFILE_COLUMNS, REGION_BOUNDS
from bathyspark.sources import bindings as B

ONE_FLOAT = "F_001378"


def _p(spark, sf_dir):
    return B.profiles(spark, sf_dir)


def _pl(spark, sf_dir):
    return B.profile_levels(spark, sf_dir)


def _f(spark, sf_dir):
    return B.floats(spark, sf_dir)


def region_rows(spark, sf_dir):
    """P12 batch form: level counts and bounds per named region.

    The region table is the fixed five-row list (a proven size), broadcast
    into a range join against the levels; partial aggregation per region.
    """
    regions = spark.createDataFrame(
        [(n, *b) for n, b in REGION_BOUNDS.items()],
        "region string, min_lat double, max_lat double, min_lon double, max_lon double")
    lv = _p(spark, sf_dir)
    j = lv.join(F.broadcast(regions),
                F.col("latitude").between(F.col("min_lat"), F.col("max_lat"))
                & F.col("longitude").between(F.col("min_lon"), F.col("max_lon")))
    return j.groupBy("region").agg(F.count(F.lit(1)).alias("n_rows"),
                                   F.count_distinct("float_id").alias("n_floats"),
                                   F.min("timestamp").alias("first_time"),
                                   F.max("timestamp").alias("last_time"))


def _region_values_sql():
    return ", ".join(f"('{n}', {b[0]}, {b[1]}, {b[2]}, {b[3]})" for n, b in REGION_BOUNDS.items())


FLOAT_FILTERS = {"status": "active", "institution": "NATION_7", "lat_range": (-25, 25), "lon_range": (30, 110)}
PROFILE_FILTERS = {"date_range": ("1995-06-01", "1996-12-31"), "lat_range": (-20, 25), "lon_range": (30, 100),
                   "depth_range": (100, 1500), "parameter": "oxygen", "min_value": 60, "max_value": 220}


QUERIES = {
    "query_floats": lambda s, d: query_floats(_f(s, d), FLOAT_FILTERS),
    "query_profiles": lambda s, d: query_profiles(_pl(s, d), PROFILE_FILTERS).select(PROFILE_COLUMNS),
    "query_profiles_all": lambda s, d: query_profiles(
        _pl(s, d), {**PROFILE_FILTERS, "float_id": ONE_FLOAT, "parameter": "no_such_parameter"}, limit=None).select(PROFILE_COLUMNS),
    "scan_floats": lambda s, d: _f(s, d).select(FLOAT_COLUMNS),
    "scan_profiles": lambda s, d: _p(s, d).select(PROFILE_COLUMNS),
    "floats_by_status": lambda s, d: _f(s, d).where(P.status_is("active")),
    "floats_by_institution": lambda s, d: _f(s, d).where(P.institution_is("NATION_7")),
    "floats_bbox": lambda s, d: _f(s, d).where(P.lat_between(-10, 10) & P.lon_between(40, 90)),
    "profiles_bbox": lambda s, d: _p(s, d).where(P.lat_between(0, 10) & P.lon_between(60, 80)),
    "profiles_by_float": lambda s, d: _p(s, d).where(P.float_is(ONE_FLOAT)),
    "profiles_date_range": lambda s, d: _p(s, d).where(P.timestamp_between("1996-01-01", "1996-01-31")),
    "profiles_date_inclusive": lambda s, d: _p(s, d).where(P.date_between_inclusive("1996-01-01", "1996-01-31")),
    "profiles_depth_range": lambda s, d: _p(s, d).where(P.depth_between(100, 500)),
    "profiles_param_range": lambda s, d: (lambda df: df.where(P.parameter_range(df, "oxygen", 100, 150)))(_p(s, d)),
    "profiles_params_present": lambda s, d: _p(s, d).where(
        P.parameters_present(["temperature", "salinity", "oxygen"])),
    "profiles_point_box": lambda s, d: _p(s, d).where(P.point_box(10.5, 70.25)),
    "profiles_by_region": lambda s, d: _p(s, d).where(P.region_box("equator")),
    "region_antimeridian": lambda s, d: _p(s, d).where(P.region_box("pacific", wrap=True)),
    "region_counts": region_rows,
    "range_normalise": lambda s, d: (lambda f: f.select(
        "float_id", *[c.alias(n) for c, n in zip(
            P.ordered_range(F.col("max_pressure"), F.col("cycle_time") * 200), ["lo", "hi"])]))(_f(s, d)),
    "profiles_last_n_days": lambda s, d: _p(s, d).where(P.last_n_days("1996-06-30", 180)),
    "latest_row": lambda s, d: O.latest_row(_pl(s, d)).select(PROFILE_COLUMNS),
    "latest_date": lambda s, d: O.latest_date(_p(s, d)),
    "recent_rows": lambda s, d: O.recent_rows(_pl(s, d)),
    "profiles_limit": lambda s, d: O.limited(_pl(s, d).where(P.depth_between(0, 400)), 1000).select(PROFILE_COLUMNS),
    "project_parameters": lambda s, d: project_parameters(
        _p(s, d).where(P.timestamp_between("1997-01-01", "1997-03-31")), ["salinity", "bogus", "oxygen"]),
    "export_preview": lambda s, d: O.preview(
        _pl(s, d).where(P.timestamp_between("1996-01-01", "1996-12-31") & P.lat_between(-30, 30)
                        & P.lon_between(20, 120)), 10).select(
        "profile_id", "float_id", "timestamp", "latitude", "longitude", "depth", "temperature", "salinity"),
}

_ORDER_TIES = "profile_id, depth, level_no, part_no, supp_no, ext_price"

_PROFILE_FILTER_SQL = ("timestamp BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '1996-12-31' AND latitude BETWEEN -20.0 AND 25.0 "
                       "AND longitude BETWEEN 30.0 AND 100.0 AND depth BETWEEN 100.0 AND 1500.0")

ORACLE = {
    "query_floats": sql(f"SELECT {FLOAT_COLS_SQL} FROM floats WHERE status = 'active' AND institution = 'NATION_7' "
                        "AND latitude BETWEEN -25.0 AND 25.0 AND longitude BETWEEN 30.0 AND 110.0"),
    "query_profiles": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles WHERE {_PROFILE_FILTER_SQL} "
                          f"AND oxygen >= 60.0 AND oxygen <= 220.0 ORDER BY {_ORDER_TIES} LIMIT 1000"),
    "query_profiles_all": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles WHERE {_PROFILE_FILTER_SQL} AND float_id = '{ONE_FLOAT}'"),
    "scan_floats": sql(f"SELECT {FLOAT_COLS_SQL} FROM floats"),
    "scan_profiles": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles"),
    "floats_by_status": sql(f"SELECT {FLOAT_COLS_SQL} FROM floats WHERE status = 'active'"),
    "floats_by_institution": sql(f"SELECT {FLOAT_COLS_SQL} FROM floats WHERE institution = 'NATION_7'"),
    "floats_bbox": sql(f"SELECT {FLOAT_COLS_SQL} FROM floats WHERE latitude BETWEEN -10.0 AND 10.0 "
                       "AND longitude BETWEEN 40.0 AND 90.0"),
    "profiles_bbox": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles WHERE latitude BETWEEN 0.0 AND 10.0 "
                         "AND longitude BETWEEN 60.0 AND 80.0"),
    "profiles_by_float": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles WHERE float_id = '{ONE_FLOAT}'"),
    "profiles_date_range": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles "
                               "WHERE timestamp BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-01-31'"),
    "profiles_date_inclusive": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles "
                                   "WHERE CAST(timestamp AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-01-31'"),
    "profiles_depth_range": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles WHERE depth BETWEEN 100.0 AND 500.0"),
    "profiles_param_range": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles WHERE oxygen >= 100.0 AND oxygen <= 150.0"),
    "profiles_params_present": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles WHERE temperature IS NOT NULL "
                                   "AND salinity IS NOT NULL AND oxygen IS NOT NULL"),
    "profiles_point_box": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles WHERE latitude BETWEEN 9.5 AND 11.5 "
                              "AND longitude BETWEEN 69.25 AND 71.25"),
    "profiles_by_region": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles WHERE latitude BETWEEN -5.0 AND 5.0 "
                              "AND longitude BETWEEN -180.0 AND 180.0"),
    "region_antimeridian": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles WHERE latitude BETWEEN -60.0 AND 60.0 "
                               "AND (longitude >= 120.0 OR longitude <= -60.0)"),
    "region_counts": sql(
        "SELECT region, count(*) AS n_rows, count(DISTINCT float_id) AS n_floats, "
        "min(timestamp) AS first_time, max(timestamp) AS last_time FROM profiles "
        f"JOIN (VALUES {_region_values_sql()}) r(region, min_lat, max_lat, min_lon, max_lon) "
        "ON latitude BETWEEN min_lat AND max_lat AND longitude BETWEEN min_lon AND max_lon GROUP BY region"),
    "range_normalise": sql("SELECT float_id, least(max_pressure, cycle_time * 200) AS lo, "
                           "greatest(max_pressure, cycle_time * 200) AS hi FROM floats"),
    "profiles_last_n_days": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles WHERE timestamp >= "
                                "TIMESTAMP '1996-06-30' - INTERVAL 180 DAY AND timestamp <= TIMESTAMP '1996-06-30'"),
    "latest_row": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles ORDER BY timestamp DESC, {_ORDER_TIES} LIMIT 1"),
    "latest_date": sql("SELECT strftime(max(timestamp), '%Y-%m-%d') AS latest_data FROM profiles"),
    "recent_rows": sql("SELECT profile_id, float_id, timestamp, latitude, longitude, depth, temperature, salinity "
                       f"FROM profiles ORDER BY timestamp DESC, {_ORDER_TIES} LIMIT 100"),
    "profiles_limit": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles WHERE depth BETWEEN 0.0 AND 400.0 "
                          f"ORDER BY {_ORDER_TIES} LIMIT 1000"),
    "project_parameters": sql("SELECT profile_id, float_id, timestamp, latitude, longitude, depth, salinity, oxygen "
                              "FROM profiles WHERE timestamp BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'"),
    "export_preview": sql(
        "SELECT profile_id, float_id, timestamp, latitude, longitude, depth, temperature, salinity FROM profiles "
        "WHERE timestamp BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' "
        "AND latitude BETWEEN -30.0 AND 30.0 AND longitude BETWEEN 20.0 AND 120.0 "
        f"ORDER BY {_ORDER_TIES} LIMIT 10"),
}
