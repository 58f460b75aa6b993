"""Row queries with a set of optional filters, all ANDed (P1-P9 in one call, then O3).

``filters`` is a dictionary; a missing or null entry filters nothing.  Floats:
``status``, ``institution``, ``lat_range``, ``lon_range``.  Profiles:
``float_id``, ``date_range``, ``lat_range``, ``lon_range``, ``depth_range``,
``parameter`` with ``min_value`` and ``max_value``.  An unknown parameter is
ignored and unknown entries raise ``ValueError``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bathyspark.functions import filters as P
from bathyspark.operators.ordering import limited
from bathyspark.schemas import DEFAULT_ROW_LIMIT, PARAMETERS
from bathyspark.sources.io import PARTITION_COLUMN, month_pruning

FLOAT_FILTERS = ("status", "institution", "lat_range", "lon_range")
PROFILE_FILTERS = ("float_id", "date_range", "lat_range", "lon_range", "depth_range", "parameter", "min_value", "max_value")


def _given(filters: dict | None, known: tuple[str, ...]) -> dict:
    unknown = set(filters or {}) - set(known)
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
    return {k: v for k, v in (filters or {}).items() if v is not None}


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def query_floats(floats: DataFrame, filters: dict | None = None, wrap: bool = False) -> DataFrame:
    """The floats that pass every given filter."""
    f = _given(filters, FLOAT_FILTERS)
    made = {"status": lambda v: P.status_is(v), "institution": lambda v: P.institution_is(v),
            "lat_range": lambda v: P.lat_between(*v), "lon_range": lambda v: P.lon_between(*v, wrap=wrap)}
    return floats.where(_all([made[k](v) for k, v in f.items()]))


def query_profiles(profiles: DataFrame, filters: dict | None = None, limit: int | None = DEFAULT_ROW_LIMIT,
                   wrap: bool = False) -> DataFrame:
    """The profile levels that pass every given filter, capped at ``limit`` rows in profile order (None: all rows).

    On the stored table a date range also prunes its month partitions.
    """
    f = _given(filters, PROFILE_FILTERS)
    made = {"float_id": lambda v: P.float_is(v), "date_range": lambda v: P.timestamp_between(*v),
            "lat_range": lambda v: P.lat_between(*v), "lon_range": lambda v: P.lon_between(*v, wrap=wrap),
            "depth_range": lambda v: P.depth_between(*v)}
    conditions = [make(f[k]) for k, make in made.items() if k in f]
    if f.get("parameter") in PARAMETERS:
        conditions.append(P.parameter_range(profiles, f["parameter"], f.get("min_value"), f.get("max_value")))
    if "date_range" in f and PARTITION_COLUMN in profiles.columns:
        conditions.append(month_pruning(*f["date_range"]))
    rows = profiles.where(_all(conditions))
    return rows if limit is None else limited(rows, limit)
