"""Flatten, nest, projection and cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bathyspark.schemas import BASE_COLUMNS, PARAMETERS, RANGES

PROFILE_KEY = ["profile_id", "float_id", "timestamp", "latitude", "longitude"]


def flatten_profiles(nested: DataFrame) -> DataFrame:
    """one row per depth index; each parameter array read at that index.

    A parameter missing from the map, or an array shorter than ``depths``,
    gives null, never an error (``try_element_at``).
    """
    exploded = nested.select(*PROFILE_KEY, "parameters",
                             F.posexplode("depths").alias("pos", "depth"))
    params = [F.try_element_at(F.try_element_at("parameters", F.lit(p)), F.col("pos") + 1).alias(p)
              for p in PARAMETERS]
    return exploded.select(*PROFILE_KEY, "depth", *params)


def nest_profiles(levels: DataFrame, order: list[str] | None = None) -> DataFrame:
    """the nested record of each profile, levels in depth order.

    One group is one instrument cast, a bounded number of levels, so the
    per-profile array is bounded; partial aggregation runs before the shuffle.
    """
    order = order or ["depth"]
    fields = [F.col(c) for c in order] + [F.col(p) for p in PARAMETERS if p not in order]
    if "depth" not in order:
        fields.append(F.col("depth"))
    grouped = levels.groupBy(*PROFILE_KEY).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("lv"))
    def field(name: str):
        return F.transform("lv", lambda e: e[name])

    params = F.create_map(*[x for p in PARAMETERS for x in (F.lit(p), field(p))])
    return grouped.select(*PROFILE_KEY, F.transform("lv", lambda e: e["depth"]).alias("depths"),
                          params.alias("parameters"))


def project_parameters(rows: DataFrame, parameters: list[str]) -> DataFrame:
    """base columns then requested parameters; unknown names dropped."""
    wanted = BASE_COLUMNS + [p for p in parameters if p not in BASE_COLUMNS]
    return rows.select([c for c in wanted if c in rows.columns])


def split_parameters(text: str) -> list[str]:
    """F4 for a literal: comma-separated names, blanks trimmed."""
    return [p.strip() for p in text.split(",")]


def split_parameters_col(col: Column) -> Column:
    """F4 for a column: array of trimmed names."""
    return F.transform(F.split(col, ","), lambda s: F.trim(s))


def clip_ranges(rows: DataFrame) -> DataFrame:
    """clip each measurement to its physical range (nulls stay null)."""
    out = []
    for c in rows.columns:
        if c in RANGES:
            lo, hi = RANGES[c]
            out.append(F.when(F.col(c).isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c)))).alias(c))
        else:
            out.append(F.col(c))
    return rows.select(out)


def clip_report(rows: DataFrame) -> DataFrame:
    """F6 quality report: values below / above each range."""
    aggs = []
    for p in PARAMETERS:
        if p in rows.columns:
            lo, hi = RANGES[p]
            aggs += [F.count_if(F.col(p) < lo).alias(f"{p}_below"), F.count_if(F.col(p) > hi).alias(f"{p}_above")]
    return rows.agg(*aggs)


def cycle_calendar(floats: DataFrame, end) -> DataFrame:
    """expected profile times from deployment to ``end`` (inclusive),
    every ``cycle_time`` days, with ids ``<float>_<4-digit cycle>``."""
    end_ts = F.lit(end).cast("timestamp_ntz")
    seq = F.sequence(F.col("deployment_date"), end_ts, F.make_dt_interval(F.col("cycle_time")))
    valid = F.col("deployment_date") <= end_ts
    return (floats.where(valid & (F.col("cycle_time") > 0))
            .select("float_id", F.posexplode(seq).alias("cycle_no", "expected_time"))
            .select("float_id", "cycle_no", "expected_time",
                    F.format_string("%s_%04d", F.col("float_id"), F.col("cycle_no")).alias("profile_id")))


def depth_grid(floats: DataFrame, n_levels: Column) -> DataFrame:
    """F8: ``n`` evenly spaced depths from 0 to ``max_pressure`` inclusive (one: 0; none: no row)."""
    n = n_levels.cast("int")
    step = F.col("max_pressure").cast("double") / (n - 1).cast("double")
    grid = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i == 0, F.lit(0.0))
                       .when(i == n - 1, F.col("max_pressure").cast("double")).otherwise(i * step))
    return floats.where(n > 0).select("float_id", F.posexplode(grid).alias("level", "depth"))


def map_markers(floats: DataFrame, popup: bool = True) -> DataFrame:
    """floats with both coordinates, coloured by status, with popup text."""
    out = floats.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "float_id", "latitude", "longitude", "status", "platform_type", "institution",
        F.when(F.col("status") == "active", "green").otherwise("red").alias("color"))
    if popup:
        out = out.withColumn("popup", F.format_string(
            "%s | Status: %s | Platform: %s | Institution: %s | Location: %.2f°N, %.2f°E",
            "float_id", "status", "platform_type", "institution", "latitude", "longitude"))
    return out
