"""Filter predicates as Columns.

All filters are ANDed by the caller.  ``between`` is inclusive at both ends
and a null value never passes.  Bounds are literals, so Catalyst pushes them
into the Parquet scan (``PushedFilters``) whenever the column is stored.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bathyspark.schemas import PARAMETERS, REGION_BOUNDS


def _ts(value) -> Column:
    """A TIMESTAMP_NTZ literal from a date, datetime or 'YYYY-MM-DD' text.

    Bad text raises ``ValueError`` before any plan is built.
    """
    if isinstance(value, str):
        value = dt.datetime.strptime(value.strip()[:10], "%Y-%m-%d")
    elif isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return ntz_literal(value)


def ntz_literal(value: dt.datetime) -> Column:
    """TIMESTAMP_NTZ literal from a naive datetime, built from text so no
    session or process time zone is involved."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def status_is(status: str | None) -> Column:
    """Float status; None or 'All' means no filter."""
    if status is None or status == "All":
        return F.lit(True)
    return F.col("status") == status


def institution_is(institution: str | None) -> Column:
    """Float institution; None or 'All' means no filter."""
    if institution is None or institution == "All":
        return F.lit(True)
    return F.col("institution") == institution


def lat_between(lo: float, hi: float) -> Column:
    """P3."""
    return F.col("latitude").between(F.lit(float(lo)), F.lit(float(hi)))


def lon_between(lo: float, hi: float, wrap: bool = False) -> Column:
    """P4.  With ``wrap`` a box whose west edge exceeds its east edge crosses
    the antimeridian (P13 corrected); without it such a box is empty."""
    if wrap and lo > hi:
        return (F.col("longitude") >= F.lit(float(lo))) | (F.col("longitude") <= F.lit(float(hi)))
    return F.col("longitude").between(F.lit(float(lo)), F.lit(float(hi)))


def float_is(float_id: str) -> Column:
    """P5."""
    return F.col("float_id") == float_id


def timestamp_between(start, end) -> Column:
    """Timestamp form; the end is midnight at the start of the end day."""
    return F.col("timestamp").between(_ts(start), _ts(end))


def date_between_inclusive(start, end) -> Column:
    """Calendar-date form; the whole end day is included.

    Written as ``ts >= start and ts < end + 1 day`` so it pushes down.
    """
    s = _ts(start)
    e = _ts(end) + F.expr("INTERVAL 1 DAY")
    return (F.col("timestamp") >= s) & (F.col("timestamp") < e)


def depth_between(lo: float, hi: float) -> Column:
    """P8."""
    return F.col("depth").between(F.lit(float(lo)), F.lit(float(hi)))


def parameter_range(df: DataFrame, parameter: str | None, min_value=None, max_value=None) -> Column:
    """An unknown parameter is ignored; no bounds filters nothing."""
    if not parameter or parameter not in df.columns:
        return F.lit(True)
    cond = F.lit(True)
    if min_value is not None:
        cond = cond & (F.col(parameter) >= F.lit(float(min_value)))
    if max_value is not None:
        cond = cond & (F.col(parameter) <= F.lit(float(max_value)))
    return cond


def parameters_present(parameters: Iterable[str]) -> Column:
    """P10: all requested parameters non-null."""
    conds = [F.col(p).isNotNull() for p in parameters]
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def point_box(lat: float, lon: float, radius: float = 1.0) -> Column:
    """Box of half-side ``radius`` degrees around a point."""
    return (F.col("latitude").between(F.lit(lat - radius), F.lit(lat + radius))
            & F.col("longitude").between(F.lit(lon - radius), F.lit(lon + radius)))


def region_box(region: str | None, wrap: bool = False) -> Column:
    """Named region; an unknown or unbounded region filters nothing."""
    bounds = REGION_BOUNDS.get((region or "").lower())
    if bounds is None:
        return F.lit(True)
    la0, la1, lo0, lo1 = bounds
    return lat_between(la0, la1) & lon_between(lo0, lo1, wrap=wrap)


def max_depth(limit: float = 1000.0) -> Column:
    """P14."""
    return F.col("depth") <= F.lit(float(limit))


def non_null(parameter: str) -> Column:
    """P15."""
    return F.col(parameter).isNotNull()


def ordered_range(a: Column, b: Column) -> tuple[Column, Column]:
    """(least, greatest) of two handles; null if either is null."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.least(a, b)), F.when(both, F.greatest(a, b))


def last_n_days(end, days: int = 180) -> Column:
    """Rows from ``end - days`` up to ``end``; ``end`` is an argument."""
    e = _ts(end)
    return (F.col("timestamp") >= e - F.make_dt_interval(F.lit(int(days)))) & (F.col("timestamp") <= e)


def known_parameters(df: DataFrame) -> list[str]:
    return [p for p in PARAMETERS if p in df.columns]
