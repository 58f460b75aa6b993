"""Registered queries: summaries, distributions, series."""

from __future__ import annotations

from pyspark.sql import functions as F

from bathyspark.functions import filters as P
from bathyspark.operators import kept_stats as K
from bathyspark.operators import series as S
from bathyspark.operators import stats as A
from bathyspark.plans import answer
from bathyspark.plans.oracle import mean, sql
from bathyspark.plans.q_questions import CURRENT_YEAR, FLAGSHIP_QUESTION
from bathyspark.schemas import FLOAT_COLUMNS
from bathyspark.sources import bindings as B
from bathyspark.sources.io import scratch_dir

ONE_FLOAT = "F_001378"

# the rows of the flagship question, as SQL
FLAGSHIP_ROWS_SQL = (
    "SELECT * FROM profiles WHERE temperature IS NOT NULL "
    "AND latitude BETWEEN -5.0 AND 5.0 AND longitude BETWEEN -180.0 AND 180.0 "
    "AND timestamp BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-31' AND depth <= 1000.0")
# the Profile Analysis page rows: depth 0-1000 m, calendar year 1996 inclusive
ANALYSIS_ROWS_SQL = (
    "SELECT * FROM profiles WHERE depth BETWEEN 0.0 AND 1000.0 "
    "AND timestamp >= TIMESTAMP '1996-01-01' AND timestamp < TIMESTAMP '1997-01-01'")


SUMMARY_SQL = (
    "count(DISTINCT profile_id) AS total_profiles, count(*) AS total_measurements, "
    "min(depth) AS depth_min, max(depth) AS depth_max, "
    f"min(temperature) AS temperature_min, max(temperature) AS temperature_max, {mean('temperature')} AS temperature_mean, "
    f"min(salinity) AS salinity_min, max(salinity) AS salinity_max, {mean('salinity')} AS salinity_mean")


def _p(s, d):
    return B.profiles(s, d)


def _f(s, d):
    return B.floats(s, d)


def flagship_rows(s, d):
    return answer.question_rows(B.profile_levels(s, d), FLAGSHIP_QUESTION, CURRENT_YEAR)


def analysis_rows(s, d):
    return S.analysis_rows(B.profile_levels(s, d), 0, 1000, "1996-01-01", "1996-12-31")


def float_summary_join(s, d):
    """Every float with its profile summary (null when it has none)."""
    summ = A.summary_by_float(_p(s, d))
    return _f(s, d).join(summ, "float_id", "left")


def _hist_sql(params: list[str], rows_sql: str) -> str:
    union = " UNION ALL ".join(
        f"SELECT '{p}' AS parameter, cast({p} AS double) AS value FROM rws WHERE {p} IS NOT NULL" for p in params)
    return sql(
        f", rws AS ({rows_sql}), v AS ({union}), "
        "r AS (SELECT parameter, min(value) AS lo, max(value) AS hi FROM v GROUP BY parameter) "
        "SELECT parameter, bin, lo + bin * (hi - lo) / 30 AS bin_start, lo + (bin + 1) * (hi - lo) / 30 AS bin_end, "
        "count(*) AS n FROM (SELECT v.parameter, lo, hi, CASE WHEN hi = lo THEN 0 ELSE "
        "cast(least(floor((value - lo) / ((hi - lo) / 30)), 29) AS integer) END AS bin "
        "FROM v JOIN r ON v.parameter = r.parameter) GROUP BY parameter, lo, hi, bin")


def _kept(s, d):
    """A store of statistics that three batches of levels were added to; profiles go on from one batch to the next."""
    lv, path = B.profile_levels(s, d), scratch_dir(s, "kept-stats")
    for batch, part in enumerate((F.col("level_no") <= 2, (F.col("level_no") > 2) & (F.col("depth") < 1000), (F.col("level_no") > 2) & (F.col("depth") >= 1000))):
        K.add_batch(s, path, lv.where(part), batch)
    return path


QUERIES = {
    "summary_by_float_kept": lambda s, d: K.summary_by_float(s, _kept(s, d)),
    "summary_global_kept": lambda s, d: K.profile_summary(s, _kept(s, d)),
    "dataset_summary_kept": lambda s, d: K.dataset_summary(s, _kept(s, d), _f(s, d)),
    "summary_global": lambda s, d: A.profile_summary(_p(s, d)),
    "summary_one_float": lambda s, d: A.profile_summary(_p(s, d), ONE_FLOAT),
    "summary_missing_float": lambda s, d: A.profile_summary(_p(s, d), "F_NONE"),
    "summary_by_float": lambda s, d: A.summary_by_float(_p(s, d)),
    "float_summary_join": float_summary_join,
    "system_stats": lambda s, d: A.system_stats(_f(s, d), _p(s, d)),
    "context_stats": lambda s, d: A.context_stats(flagship_rows(s, d), ["temperature"]),
    "geo_bounds": lambda s, d: A.geo_bounds(flagship_rows(s, d)),
    "dataset_summary": lambda s, d: A.dataset_summary(_f(s, d), _p(s, d)),
    "parameters_found": lambda s, d: A.parameters_found(flagship_rows(s, d)),
    "institutions": lambda s, d: A.institutions(_f(s, d)),
    "histogram_30": lambda s, d: A.histogram(_p(s, d), "temperature"),
    "parameter_comparison": lambda s, d: A.histograms(analysis_rows(s, d), ["temperature", "salinity"]),
    "map_count": lambda s, d: A.float_count(_f(s, d), P.status_is("active") & P.institution_is("NATION_3")),
    "depth_axis": lambda s, d: A.depth_axis(flagship_rows(s, d)),
    "depth_series": lambda s, d: S.depth_series(analysis_rows(s, d), "temperature"),
    "profile_analysis": lambda s, d: S.profile_analysis(
        B.profile_levels(s, d), "salinity", 1000, 0, "1996-01-01", "1996-12-31")[0],
    "analysis_comparison": lambda s, d: S.profile_analysis(
        B.profile_levels(s, d), "salinity", 1000, 0, "1996-01-01", "1996-12-31")[1],
    "float_lines": lambda s, d: S.float_lines(flagship_rows(s, d), ["temperature"]),
}

ORACLE = {
    "summary_global": sql(f"SELECT {SUMMARY_SQL} FROM profiles HAVING count(*) > 0"),
    "summary_one_float": sql(f"SELECT {SUMMARY_SQL} FROM profiles WHERE float_id = '{ONE_FLOAT}' HAVING count(*) > 0"),
    "summary_missing_float": sql(f"SELECT {SUMMARY_SQL} FROM profiles WHERE float_id = 'F_NONE' HAVING count(*) > 0"),
    "summary_by_float": sql(f"SELECT float_id, {SUMMARY_SQL} FROM profiles GROUP BY float_id"),
    "float_summary_join": sql(
        f", s AS (SELECT float_id, {SUMMARY_SQL} FROM profiles GROUP BY float_id) "
        f"SELECT {', '.join('f.' + c for c in FLOAT_COLUMNS)}, s.* EXCLUDE (float_id) "
        "FROM floats f LEFT JOIN s ON f.float_id = s.float_id"),
    "system_stats": sql(
        "SELECT (SELECT count(*) FROM floats) AS total_floats, count(*) AS total_rows, "
        "count(DISTINCT profile_id) AS total_profiles, "
        "(SELECT count(*) FROM floats WHERE status = 'active') AS active_floats, "
        "strftime(max(timestamp), '%Y-%m-%d') AS latest_data FROM profiles"),
    "context_stats": sql(
        f", r AS ({FLAGSHIP_ROWS_SQL}) SELECT count(*) AS n_rows, min(temperature) AS temperature_min, "
        f"max(temperature) AS temperature_max, {mean('temperature')} AS temperature_mean, "
        "min(latitude) AS lat_min, max(latitude) AS lat_max, min(longitude) AS lon_min, max(longitude) AS lon_max, "
        "min(timestamp) AS time_min, max(timestamp) AS time_max FROM r"),
    "geo_bounds": sql(
        f", r AS ({FLAGSHIP_ROWS_SQL}) SELECT min(latitude) AS min_lat, max(latitude) AS max_lat, "
        "min(longitude) AS min_lon, max(longitude) AS max_lon FROM r"),
    "dataset_summary": sql(
        "SELECT (SELECT count(*) FROM floats) AS total_floats, count(DISTINCT profile_id) AS total_profiles, "
        "min(timestamp) AS date_start, max(timestamp) AS date_end, min(latitude) AS min_lat, "
        "max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon, "
        "'temperature,salinity,pressure,oxygen,nitrate,chlorophyll,backscatter,downwelling_irradiance' AS parameters "
        "FROM profiles"),
    "parameters_found": sql(
        f", r AS ({FLAGSHIP_ROWS_SQL}), c AS (SELECT "
        + ", ".join(f"count({p}) AS {p}" for p in
                    ["temperature", "salinity", "pressure", "oxygen", "nitrate", "chlorophyll", "backscatter"])
        + " FROM r) SELECT parameter, n_values FROM (UNPIVOT c ON "
        "temperature, salinity, pressure, oxygen, nitrate, chlorophyll, backscatter "
        "INTO NAME parameter VALUE n_values) WHERE n_values > 0"),
    "institutions": sql("SELECT DISTINCT institution FROM floats"),
    "histogram_30": _hist_sql(["temperature"], "SELECT * FROM profiles"),
    "parameter_comparison": _hist_sql(["temperature", "salinity"], ANALYSIS_ROWS_SQL),
    "map_count": sql("SELECT count(*) AS n_floats FROM floats WHERE status = 'active' AND institution = 'NATION_3'"),
    "depth_axis": sql(f", r AS ({FLAGSHIP_ROWS_SQL}) SELECT DISTINCT depth FROM r WHERE depth IS NOT NULL"),
    "depth_series": sql(
        f", r AS ({ANALYSIS_ROWS_SQL}), firsts AS (SELECT profile_id FROM r GROUP BY profile_id "
        "ORDER BY min(timestamp), profile_id LIMIT 10) "
        "SELECT profile_id, depth, cast(temperature AS double) AS value FROM r "
        "WHERE profile_id IN (SELECT profile_id FROM firsts) AND temperature IS NOT NULL"),
    "profile_analysis": sql(
        f", r AS ({ANALYSIS_ROWS_SQL}), firsts AS (SELECT profile_id FROM r GROUP BY profile_id "
        "ORDER BY min(timestamp), profile_id LIMIT 10) "
        "SELECT profile_id, depth, cast(salinity AS double) AS value FROM r "
        "WHERE profile_id IN (SELECT profile_id FROM firsts) AND salinity IS NOT NULL"),
    "analysis_comparison": _hist_sql(["temperature", "salinity"], ANALYSIS_ROWS_SQL),
    "float_lines": sql(
        f", r AS ({FLAGSHIP_ROWS_SQL}) SELECT 'temperature' AS parameter, float_id, depth, "
        "cast(temperature AS double) AS value FROM r"),
}

ORACLE |= {f"{name}_kept": ORACLE[name] for name in ("summary_by_float", "summary_global", "dataset_summary")}
