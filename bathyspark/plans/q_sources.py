"""Registered queries: CSV round trip, exports, raw SQL, readiness."""

from __future__ import annotations

from bathyspark.functions import filters as P
from bathyspark.operators.shape import project_parameters, split_parameters
from bathyspark.plans.oracle import FLOAT_COLS_SQL, PROFILE_COLS_SQL, sql
from bathyspark.schemas import BASE_COLUMNS, FLOAT_COLUMNS, PROFILE_COLUMNS
from bathyspark.sources import bindings as B
from bathyspark.sources import io

RAW_SQL = ("SELECT float_id, count(*) AS n_levels, max(depth) AS max_depth "
           "FROM argo_profiles WHERE depth > :min_depth GROUP BY float_id")


def csv_roundtrip(s, d):
    """S3 + S4: write the float table as CSV with a header, read it back."""
    path = io.scratch_dir(s, "floats-csv")
    io.write_csv(B.floats(s, d).select(FLOAT_COLUMNS), path)
    return io.read_floats_csv(s, path)


def levels_csv_roundtrip(s, d):
    """Write the flattened profile levels as CSV with a header, read them back."""
    path = io.scratch_dir(s, "levels-csv")
    io.write_csv(B.profiles(s, d), path)
    return io.read_profiles_csv(s, path)


def _export_rows(s, d):
    rows = B.profiles(s, d).where(P.timestamp_between("1997-06-01", "1997-06-30"))
    return project_parameters(rows, split_parameters("temperature, salinity ,oxygen"))


def stored_profiles_date_range(s, d):
    """S2 + P6 on the stored, month-partitioned level table (partition pruning)."""
    path = io.scratch_dir(s, "levels-by-month")
    io.write_levels_table(B.profiles(s, d), path)
    stored = io.read_levels_table(s, path)
    return stored.where(P.timestamp_between("1996-01-01", "1996-01-31")
                        & io.month_pruning("1996-01-01", "1996-01-31")).select(PROFILE_COLUMNS)


def stored_profiles_point_box(s, d):
    """S2 + P11 on the stored, place-clustered level table (row groups pruned by key ranges)."""
    path = io.scratch_dir(s, "levels-by-place")
    io.write_levels_by_place(B.profiles(s, d), path)
    return s.read.parquet(path).where(P.point_box(10.0, 70.0) & io.place_pruning(9.0, 11.0, 69.0, 71.0)).select(PROFILE_COLUMNS)


def raw_sql(s, d):
    io.register_tables(B.floats(s, d), B.profiles(s, d))
    return io.execute_sql(s, RAW_SQL, {"min_depth": 1000.0})


QUERIES = {
    "csv_roundtrip": csv_roundtrip,
    "levels_csv_roundtrip": levels_csv_roundtrip,
    "export_csv_rows": lambda s, d: io.csv_lines(_export_rows(s, d)),
    "export_json_rows": lambda s, d: io.json_records(_export_rows(s, d)),
    "raw_sql": raw_sql,
    "stored_profiles_date_range": stored_profiles_date_range,
    "stored_profiles_point_box": stored_profiles_point_box,
    "readiness": lambda s, d: io.readiness(s, floats=B.floats(s, d), profiles=B.profiles(s, d)).select(
        "table_name", "present", "n_rows"),
}

_EXPORT_COLUMNS = BASE_COLUMNS + ["temperature", "salinity", "oxygen"]
_EXPORT_SQL = "FROM profiles WHERE timestamp BETWEEN TIMESTAMP '1997-06-01' AND TIMESTAMP '1997-06-30'"


def _csv_field(c: str) -> str:
    if c == "timestamp":
        return "strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f')"
    return c if c.endswith("_id") else f"coalesce(upper(cast({c} AS varchar)), '')"


def _json_field(c: str) -> str:
    value = f"coalesce(upper(cast({c} AS varchar)), 'null')"
    if c == "timestamp":
        value = "'\"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%g') || '\"'"
    elif c.endswith("_id"):
        value = f"'\"' || {c} || '\"'"
    return f"'\"{c}\":' || {value}"


ORACLE = {
    "levels_csv_roundtrip": sql(f"SELECT {PROFILE_COLS_SQL} FROM profiles"),
    "export_csv_rows": sql("SELECT " + " || ',' || ".join(map(_csv_field, _EXPORT_COLUMNS)) + f" AS line {_EXPORT_SQL}"),
    "export_json_rows": sql("SELECT '{' || " + " || ',' || ".join(map(_json_field, _EXPORT_COLUMNS)) + f" || '}}' AS record {_EXPORT_SQL}"),
    "csv_roundtrip": sql(f"SELECT {FLOAT_COLS_SQL} FROM floats"),
    "stored_profiles_date_range": sql(
        f"SELECT {PROFILE_COLS_SQL} FROM profiles "
        "WHERE timestamp BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-01-31'"),
    "stored_profiles_point_box": sql(
        f"SELECT {PROFILE_COLS_SQL} FROM profiles WHERE latitude BETWEEN 9.0 AND 11.0 AND longitude BETWEEN 69.0 AND 71.0"),
    "raw_sql": sql("SELECT float_id, count(*) AS n_levels, max(depth) AS max_depth FROM profiles "
                   "WHERE depth > 1000.0 GROUP BY float_id"),
    "readiness": sql("SELECT 'argo_floats' AS table_name, true AS present, count(*) AS n_rows FROM floats "
                     "UNION ALL SELECT 'argo_profiles', true, count(*) FROM profiles"),
}

