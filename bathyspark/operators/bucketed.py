"""Level table bucketed by (float, profile): summaries, nesting and the float join without a shuffle of the levels.

The buckets hash both keys and not the float alone, so a float with a third of
all levels lies in all buckets; a profile is one instrument cast and stays
whole.  Grouping by (float, profile), or by more, needs no exchange.  What
goes on by float alone shuffles one row per float and bucket (summaries) or
one row per profile (the float join).

Cases: rows with a null float or profile have buckets like any other; repeated
rows stay; an empty table gives no row; further columns are stored as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bathyspark.operators.stats import summary_by_float

BUCKET_KEYS = ["float_id", "profile_id"]


def write_bucketed(levels: DataFrame, path: str, buckets: int = 64, table: str | None = None, mode: str = "overwrite") -> str:
    """Store levels at ``path`` as a bucketed Parquet table and return its name.

    ``buckets`` should give a bucket of a few hundred MB; the rows are dealt
    with the buckets' own hash, so each bucket is written by one task as one
    file.  With ``mode="append"`` (``table`` given) every bucket gets one more.
    """
    table = table or f"levels_{uuid.uuid4().hex}"
    (levels.repartition(buckets, *BUCKET_KEYS).write.mode(mode).format("parquet").option("path", path)
     .bucketBy(buckets, *BUCKET_KEYS).sortBy(*BUCKET_KEYS, "depth").saveAsTable(table))
    return table


def open_bucketed(spark: SparkSession, path: str, buckets: int, table: str | None = None) -> DataFrame:
    """The table that another session wrote at ``path``, registered here with its buckets."""
    table = table or f"levels_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    keys = ", ".join(BUCKET_KEYS)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}, depth) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def levels_with_floats(levels: DataFrame, floats: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """Every level of the bucketed table with ``columns`` of its float (null where there is none).

    Only levels without a profile meet the floats directly.  ``floats`` holds a float once.
    """
    meta = floats.select("float_id", *columns)
    without = levels.where(F.col("profile_id").isNull()).join(meta, "float_id", "left")
    return by_profile(levels, meta, buckets).unionByName(without).select(*levels.columns, *columns)


def by_profile(levels: DataFrame, meta: DataFrame, buckets: int) -> DataFrame:
    """The levels that have a profile, left joined to ``meta`` (one row per float).

    The profiles, one row each, meet ``meta`` and are dealt like the buckets;
    the levels stay where they are, however many floats there are.
    """
    named = levels.where(F.col("profile_id").isNotNull())
    profiles = named.select(*BUCKET_KEYS).distinct().join(meta, "float_id").repartition(buckets, *BUCKET_KEYS)
    # a merge join keeps the buckets; a broadcast of one row per profile would have no bound
    return named.join(profiles.hint("merge"), BUCKET_KEYS, "left")


def float_summaries(levels: DataFrame, floats: DataFrame) -> DataFrame:
    """J1 over the bucketed table: every float with its summary; only partial summaries are shuffled."""
    return floats.join(summary_by_float(levels), "float_id", "left")
