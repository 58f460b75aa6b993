"""Helpers to write DuckDB oracle SQL over the same bindings."""

from __future__ import annotations

from bathyspark.sources.bindings import sql_views

VIEWS = sql_views("duckdb")


def sql(body: str) -> str:
    """Prefix a query body with the floats / profiles / questions views."""
    return VIEWS + body




def mean(x: str) -> str:
    """Mean of doubles summed with twelve decimals of their shortest form, so that the order of rows is of no effect."""
    return f"cast(sum({exact(x)}) AS double) / count({x})"


def exact(x: str) -> str:
    return f"cast(cast({x} AS varchar) AS decimal(38,12))"


def fixed(x: str, decimals: int) -> str:
    """``x`` as text with so many decimals: the shortest decimal form of the double, halves away from zero."""
    exact = f"cast(cast({x} AS varchar) AS decimal(38,20))"
    rounded = f"cast({exact} AS decimal(18,{decimals}))"
    return f"(CASE WHEN {exact} < 0 AND {rounded} = 0 THEN '-' ELSE '' END || cast({rounded} AS varchar))"


PROFILE_COLS_SQL = (
    "profile_id, float_id, timestamp, latitude, longitude, depth, temperature, salinity, "
    "pressure, oxygen, nitrate, chlorophyll, backscatter, downwelling_irradiance"
)
FLOAT_COLS_SQL = (
    "float_id, platform_type, deployment_date, latitude, longitude, status, max_pressure, "
    "cycle_time, institution"
)
