"""Summaries kept up to date (A1, A2, A6): every ingested batch adds partial statistics, old levels aren't read again.

A store has two tables, each with a folder for every batch:

* ``partials``: counts, minima, maxima and sums per (float, month), which merge exactly;
* ``profiles``: the (float, profile) pairs that no earlier batch had, and
  whether the profile was new to the whole table, so that distinct profiles are counted by adding.

A batch's folders are overwritten when it runs again, so a retry changes nothing.
Batches have numbers and are added in their order; each row of a batch counts, so
pass what ingest has accepted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bathyspark.functions.aggs import exact_value, far_value, mean_of
from bathyspark.schemas import PARAMETERS
from bathyspark.session import cut_lineage

VALUES = ["temperature", "salinity"]
_SUMS = ["n", *(f"{v}_{s}" for v in VALUES for s in ("n", "sum", "far"))]
_RANGES = ["depth", *VALUES, "timestamp", "latitude", "longitude"]


def _partials(levels: DataFrame) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    for v in VALUES:
        aggs += [F.count(v).alias(f"{v}_n"), F.sum(exact_value(F.col(v))).alias(f"{v}_sum"), F.sum(far_value(F.col(v))).alias(f"{v}_far")]
    for c in _RANGES:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return levels.groupBy("float_id", F.trunc("timestamp", "month").alias("month")).agg(*aggs)


def _tables(path: str) -> tuple[str, str]:
    return f"{path}/partials", f"{path}/profiles"


def add_batch(spark: SparkSession, path: str, levels: DataFrame, batch: int) -> None:
    """Add a batch of accepted levels; batches are numbered from 0 on and added in that order."""
    partials, profiles = _tables(path)
    pairs = cut_lineage(levels.where("profile_id is not null").select("float_id", "profile_id").distinct())
    # within the batch one pair of each profile stands for it
    marked = pairs.join(pairs.groupBy("profile_id").agg(F.min(F.struct("float_id")).alias("least")), "profile_id").select(
        "float_id", "profile_id", F.col("float_id").eqNullSafe(F.col("least.float_id")).alias("is_first"))
    if batch:
        before = spark.read.parquet(profiles).where(F.col("batch") < batch)
        a, b = marked.alias("a"), before.alias("b")
        fresh = a.join(b, F.col("a.float_id").eqNullSafe(F.col("b.float_id")) & (F.col("a.profile_id") == F.col("b.profile_id")), "left_anti")
        seen = before.select("profile_id").distinct().withColumn("is_seen", F.lit(True))
        marked = fresh.join(seen, "profile_id", "left").select("float_id", "profile_id", (F.col("is_first") & F.col("is_seen").isNull()).alias("is_first"))
    marked.write.mode("overwrite").parquet(f"{profiles}/batch={batch}")
    _partials(levels).write.mode("overwrite").parquet(f"{partials}/batch={batch}")


def _merged(spark: SparkSession, path: str, profile: str, *keys: str) -> DataFrame:
    """Statistics merged by ``keys``; ``profile`` says which rows of the profile table count."""
    partials, profiles = (spark.read.parquet(t) for t in _tables(path))
    both = partials.withColumn("profiles", F.lit(0)).unionByName(
        profiles.select("float_id", F.expr(profile).cast("int").alias("profiles")), allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.sum("profiles").alias("profiles"), *[F.sum(c).alias(c) for c in _SUMS],
                                   *[f(f"{c}_{s}").alias(f"{c}_{s}") for c in _RANGES for s, f in (("min", F.min), ("max", F.max))])


def _summary(merged: DataFrame, *keys: str) -> DataFrame:
    out = [F.col("profiles").alias("total_profiles"), F.col("n").alias("total_measurements"), F.col("depth_min"), F.col("depth_max")]
    for v in VALUES:
        out += [F.col(f"{v}_min"), F.col(f"{v}_max"), mean_of(F.col(f"{v}_sum"), F.col(f"{v}_far"), F.col(f"{v}_n")).alias(f"{v}_mean")]
    return merged.where("n > 0").select(*keys, *out)


def summary_by_float(spark: SparkSession, path: str) -> DataFrame:
    """A2 from the store."""
    return _summary(_merged(spark, path, "true", "float_id"), "float_id")


def profile_summary(spark: SparkSession, path: str) -> DataFrame:
    """A1 (global) from the store; no levels give no row."""
    return _summary(_merged(spark, path, "is_first"))


def dataset_summary(spark: SparkSession, path: str, floats: DataFrame) -> DataFrame:
    """A6 from the store, and the float table."""
    from bathyspark.functions.aggs import one_row
    levels = _merged(spark, path, "is_first").select(
        F.col("profiles").alias("total_profiles"), F.col("timestamp_min").alias("date_start"), F.col("timestamp_max").alias("date_end"),
        F.col("latitude_min").alias("min_lat"), F.col("latitude_max").alias("max_lat"), F.col("longitude_min").alias("min_lon"), F.col("longitude_max").alias("max_lon"))
    return one_row(floats.agg(F.count(F.lit(1)).alias("total_floats")), levels).withColumn("parameters", F.lit(",".join(PARAMETERS)))
