"""Summaries and distributions.

All aggregations run as partial (map-side) plus final hash aggregation, so a
float holding a third of all levels is combined inside each input task before
the shuffle.  The one distinct count (profiles per float) is planned by Spark
as an aggregation on (float_id, profile_id) first, which spreads a hot float
over its many profiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bathyspark.functions.aggs import exact_mean, one_row
from bathyspark.schemas import HISTOGRAM_BINS, QUESTION_PARAMETERS
from bathyspark.session import cut_lineage


def _summary_aggs() -> list[Column]:
    return [
        F.count_distinct("profile_id").alias("total_profiles"),
        F.count(F.lit(1)).alias("total_measurements"),
        F.min("depth").alias("depth_min"),
        F.max("depth").alias("depth_max"),
        F.min("temperature").alias("temperature_min"),
        F.max("temperature").alias("temperature_max"),
        exact_mean("temperature").alias("temperature_mean"),
        F.min("salinity").alias("salinity_min"),
        F.max("salinity").alias("salinity_max"),
        exact_mean("salinity").alias("salinity_mean"),
    ]


def profile_summary(profiles: DataFrame, float_id: str | None = None) -> DataFrame:
    """A1: global or one-float summary; no matching rows gives no row."""
    src = profiles if float_id is None else profiles.where(F.col("float_id") == float_id)
    return src.agg(*_summary_aggs()).where(F.col("total_measurements") > 0)


def summary_by_float(profiles: DataFrame) -> DataFrame:
    """A2: the A1 summary for every float in one aggregation."""
    return profiles.groupBy("float_id").agg(*_summary_aggs())


def summary_struct(prefix: str = "") -> Column:
    """A1 as the nested record (depth_range, temperature_stats, salinity_stats)."""
    c = lambda n: F.col(prefix + n)
    return F.struct(
        c("total_profiles").alias("total_profiles"),
        c("total_measurements").alias("total_measurements"),
        F.struct(c("depth_min").alias("min"), c("depth_max").alias("max")).alias("depth_range"),
        F.struct(c("temperature_min").alias("min"), c("temperature_max").alias("max"),
                 c("temperature_mean").alias("mean")).alias("temperature_stats"),
        F.struct(c("salinity_min").alias("min"), c("salinity_max").alias("max"),
                 c("salinity_mean").alias("mean")).alias("salinity_stats"),
    )


def system_stats(floats: DataFrame, profiles: DataFrame) -> DataFrame:
    """A3: floats, profile rows, distinct profiles, active floats, latest date."""
    f = floats.agg(F.count(F.lit(1)).alias("total_floats"),
                   F.count_if(F.col("status") == "active").alias("active_floats"))
    p = profiles.agg(F.count(F.lit(1)).alias("total_rows"),
                     F.count_distinct("profile_id").alias("total_profiles"),
                     F.date_format(F.max("timestamp"), "yyyy-MM-dd").alias("latest_data"))
    return one_row(f, p).select("total_floats", "total_rows", "total_profiles", "active_floats", "latest_data")


def context_stats(rows: DataFrame, parameters: list[str]) -> DataFrame:
    """A4: count, min/max/mean per requested parameter, place and time ranges."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for p in parameters:
        if p in rows.columns:
            aggs += [F.min(p).alias(f"{p}_min"), F.max(p).alias(f"{p}_max"), exact_mean(p).alias(f"{p}_mean")]
    aggs += [F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"),
             F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max"),
             F.min("timestamp").alias("time_min"), F.max("timestamp").alias("time_max")]
    return rows.agg(*aggs)


def geo_bounds(rows: DataFrame) -> DataFrame:
    """A5: bounds of a result; null bounds when it is empty."""
    return rows.agg(F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
                    F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"))


def dataset_summary(floats: DataFrame, profiles: DataFrame) -> DataFrame:
    """Floats, profiles, date range, bounds, parameter list."""
    from bathyspark.schemas import PARAMETERS
    f = floats.agg(F.count(F.lit(1)).alias("total_floats"))
    p = profiles.agg(
        F.count_distinct("profile_id").alias("total_profiles"),
        F.min("timestamp").alias("date_start"), F.max("timestamp").alias("date_end"),
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"))
    out = one_row(f, p)
    return out.withColumn("parameters", F.lit(",".join(PARAMETERS)))


def parameters_found(rows: DataFrame) -> DataFrame:
    """A7 in data form: per known parameter, whether the result has a value."""
    present = [p for p in QUESTION_PARAMETERS if p in rows.columns]
    agg = rows.agg(*[F.count(p).alias(p) for p in present])
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("parameter"), F.col(p).alias("n_values")) for p in present])).alias("x")
    ).select("x.parameter", "x.n_values").where(F.col("n_values") > 0)


def institutions(floats: DataFrame) -> DataFrame:
    """Distinct institutions, sorted."""
    return floats.select("institution").distinct().orderBy("institution")


def histogram(rows: DataFrame, parameter: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram of a parameter, nulls dropped.

    The rows are read once and counted by value (with map-side combine;
    measurements have few decimals, so values repeat); range and bins come from these counts.
    """
    return histograms(rows, [parameter], bins)


def histograms(rows: DataFrame, parameters: list[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """A10: histograms of several parameters side by side (unpivot, then A9)."""
    params = [p for p in parameters if p in rows.columns]
    long = rows.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("parameter"), F.col(p).cast("double").alias("value")) for p in params
    ])).alias("x")).select("x.parameter", "x.value").where(F.col("value").isNotNull())
    counts = cut_lineage(long.groupBy("parameter", "value").agg(F.count(F.lit(1)).alias("n")))
    return fold_histograms(counts, bins)


def fold_histograms(counts: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins from (parameter, value, n), which merges over any parts of the rows by adding ``n``."""
    rng = counts.groupBy("parameter").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # one row per parameter: bounded by the parameter list, safe to broadcast
    j = counts.join(F.broadcast(rng), "parameter")
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    return (j.withColumn("bin", b)
            .groupBy("parameter", "lo", "hi", "bin")
            .agg(F.sum("n").alias("n"))
            .select("parameter", "bin",
                    (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.lit(bins)).alias("bin_start"),
                    (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / F.lit(bins)).alias("bin_end"),
                    "n"))


def float_count(floats: DataFrame, predicate: Column) -> DataFrame:
    """Filtered float count."""
    return floats.where(predicate).agg(F.count(F.lit(1)).alias("n_floats"))


def depth_axis(rows: DataFrame) -> DataFrame:
    """Distinct depth levels in ascending order, as rows.

    Kept as a sorted distinct relation rather than one collected array so a
    result with many levels is never gathered into a single task.
    """
    return rows.select("depth").where(F.col("depth").isNotNull()).distinct().orderBy("depth")
