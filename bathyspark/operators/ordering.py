"""Sort, limit and top-k.

Every limit is taken after a total order, so results are reproducible; Spark
plans ``orderBy(...).limit(n)`` as ``TakeOrderedAndProject`` (per-partition
top-n, then a merge of n rows per partition), never as a full sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bathyspark.schemas import RECENT_COLUMNS, RECENT_ROWS, SERIES_PROFILES

LEVEL_TIES = ["profile_id", "depth", "level_no", "part_no", "supp_no", "ext_price"]


def _ties(df: DataFrame) -> list[Column]:
    return [F.col(c).asc() for c in LEVEL_TIES if c in df.columns]


def latest_row(profiles: DataFrame) -> DataFrame:
    """O1: the most recent level (ties broken by profile id, depth, level)."""
    return profiles.orderBy(F.col("timestamp").desc(), *_ties(profiles)).limit(1)


def latest_date(profiles: DataFrame) -> DataFrame:
    """O1, date form: one aggregate, no sort."""
    return profiles.agg(F.date_format(F.max("timestamp"), "yyyy-MM-dd").alias("latest_data"))


def recent_rows(profiles: DataFrame, n: int = RECENT_ROWS, columns: list[str] = RECENT_COLUMNS) -> DataFrame:
    """O2 + F5: the n most recent levels in the fixed 8-column projection."""
    return profiles.orderBy(F.col("timestamp").desc(), *_ties(profiles)).limit(n).select(columns)


def limited(rows: DataFrame, n: int = 1000, order: list[Column] | None = None) -> DataFrame:
    """O3: row cap, with a stated order so the cut is reproducible."""
    order = order or [F.col("profile_id").asc(), *_ties(rows)]
    return rows.orderBy(*order).limit(n)


def first_profiles(rows: DataFrame, n: int = SERIES_PROFILES,
                   order: list[str] | None = None) -> DataFrame:
    """The first n distinct profiles in a stated order of appearance.

    Each profile is reduced to its first sort key (map-side combined), the
    top n keys are taken with a bounded top-k, and those n ids select the
    rows by a broadcast semi join of exactly n rows.
    """
    order = order or ["timestamp", "profile_id"]
    firsts = rows.groupBy("profile_id").agg(*[F.min(c).alias(f"_first_{c}") for c in order if c != "profile_id"])
    keys = [F.col(f"_first_{c}") if c != "profile_id" else F.col("profile_id") for c in order]
    top = firsts.orderBy(*keys, "profile_id").limit(n).select("profile_id")
    return rows.join(F.broadcast(top), "profile_id", "left_semi")


def preview(rows: DataFrame, n: int = 10, order: list[Column] | None = None) -> DataFrame:
    """First n rows of an export, after a stated order."""
    return limited(rows, n, order)
