"""Depth series for charts.

Series are returned in long form, one row per point, globally ordered by
(series, depth).  The order is produced by a range-partitioned sort, which
splits a float or profile holding a third of all rows over many tasks; no
series is gathered into one array or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bathyspark.functions import filters as P
from bathyspark.operators.ordering import first_profiles
from bathyspark.operators.stats import histograms
from bathyspark.schemas import SERIES_PROFILES

TIES = ["level_no", "part_no", "supp_no", "ext_price"]


def depth_series(rows: DataFrame, parameter: str, n_profiles: int = SERIES_PROFILES) -> DataFrame:
    """Depth profile of one parameter for up to ``n_profiles`` profiles.

    Profiles are taken in order of appearance (time, then id); null values
    are dropped, so an all-null profile yields no points.  An unknown
    parameter gives an empty result with the same schema.
    """
    if parameter not in rows.columns:
        return rows.sparkSession.createDataFrame([], "profile_id string, depth double, value double")
    chosen = first_profiles(rows, n_profiles)
    ties = [c for c in TIES if c in rows.columns]
    return (chosen.where(F.col(parameter).isNotNull())
            .select("profile_id", "depth", F.col(parameter).cast("double").alias("value"), *ties)
            .orderBy("profile_id", "depth", *ties)
            .select("profile_id", "depth", "value"))


def analysis_rows(profiles: DataFrame, depth_lo: float, depth_hi: float, start, end) -> DataFrame:
    """D2 filter: depth range then the inclusive calendar-date range."""
    lo, hi = min(depth_lo, depth_hi), max(depth_lo, depth_hi)
    return profiles.where(P.depth_between(lo, hi) & P.date_between_inclusive(start, end))


def profile_analysis(profiles: DataFrame, parameter: str, depth_lo: float, depth_hi: float,
                     start, end, comparison: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The depth series and the side-by-side histograms of the same rows.

    The filtered rows feed two outputs; persist them when both are taken.
    """
    rows = analysis_rows(profiles, depth_lo, depth_hi, start, end)
    return depth_series(rows, parameter), histograms(rows, comparison or ["temperature", "salinity"])


def float_lines(rows: DataFrame, parameters: list[str]) -> DataFrame:
    """Q8: per requested parameter and float, values in depth order.

    Nulls are kept (a chart gap), as in the reference's series.  Output is
    (parameter, float_id, depth, value), ordered by parameter, float, depth.
    """
    params = [p for p in parameters if p in rows.columns]
    if not params:
        return rows.sparkSession.createDataFrame([], "parameter string, float_id string, depth double, value double")
    ties = [c for c in ["profile_id"] + TIES if c in rows.columns]
    long = rows.select("float_id", "depth", *ties, F.explode(F.array(*[
        F.struct(F.lit(p).alias("parameter"), F.col(p).cast("double").alias("value")) for p in params
    ])).alias("x"))
    return (long.select("x.parameter", "float_id", "depth", "x.value", *ties)
            .orderBy("parameter", "float_id", "depth", *ties)
            .select("parameter", "float_id", "depth", "value"))
