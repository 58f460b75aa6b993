"""Idempotent ingest.

Floats: a batch is accepted whole or not at all.  It is rejected when a
``float_id`` repeats inside the batch or already exists in the table.

Profile levels: within the batch the first row of each key (by a stated
input order) wins; keys already stored are skipped.  The first row per key
is picked with ``min_by`` in a grouped aggregation, which combines map-side,
so a key repeated across a third of the batch never lands in one task.
Stored keys are removed with a ``left_anti`` join.  Running the same batch
twice adds nothing the second time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bathyspark.session import cut_lineage
from bathyspark.sources.io import PARTITION_COLUMN, read_levels_table, write_levels_table

DEFAULT_LEVEL_KEY = ["profile_id", "depth"]


def float_conflicts(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Ids repeated in the batch or already stored, with the reason."""
    dup = (batch.groupBy("float_id").agg(F.count(F.lit(1)).alias("n"))
           .where(F.col("n") > 1).select("float_id", F.lit("duplicate in batch").alias("reason")))
    clash = (batch.select("float_id").distinct()
             .join(existing.select("float_id"), "float_id", "left_semi")
             .select("float_id", F.lit("already stored").alias("reason")))
    return dup.unionByName(clash)


@dataclass
class FloatAppend:
    accepted: bool
    conflicts: DataFrame
    table: DataFrame  # the table content after the append


def append_floats(existing: DataFrame, batch: DataFrame) -> FloatAppend:
    """I1 + I2: all-or-nothing append of float rows."""
    conflicts = float_conflicts(existing, batch)
    accepted = conflicts.isEmpty()
    table = existing.unionByName(batch.select(existing.columns)) if accepted else existing
    return FloatAppend(accepted, conflicts, table)


def _order_struct(order: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def first_per_key(batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in input order (map-side combined)."""
    cols = batch.columns
    picked = batch.groupBy(*key).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), _order_struct(order)).alias("r"))
    return picked.select("r.*")


INPUT_ORDER = "_input_order"


def _in_order(batch: DataFrame, order: list[str] | None) -> tuple[DataFrame, list[str]]:
    """The batch and the columns of its input order; without any, rows are numbered as they are read, once."""
    if order:
        return batch, order
    return cut_lineage(batch.withColumn(INPUT_ORDER, F.monotonically_increasing_id())), [INPUT_ORDER]


def new_levels(existing: DataFrame, batch: DataFrame, key: list[str] | None = None,
               order: list[str] | None = None) -> DataFrame:
    """I3 (I4 with ``key=['profile_id']``): rows of the batch to insert."""
    key = key or DEFAULT_LEVEL_KEY
    columns = batch.columns
    batch, order = _in_order(batch, order)
    fresh = batch.join(existing.select(*key), key, "left_anti")
    return first_per_key(fresh, key, order).select(columns)


def skipped_levels(existing: DataFrame, batch: DataFrame, key: list[str] | None = None,
                   order: list[str] | None = None) -> DataFrame:
    """Every batch row not inserted, with the reason."""
    key = key or DEFAULT_LEVEL_KEY
    batch, order = _in_order(batch, order)
    columns = batch.columns
    # one row for each key, of the key and its first row's order alone, map-side combined; whole rows are shuffled once
    firsts = batch.groupBy(*key).agg(F.min(_order_struct(order)).alias("_first"))
    stored = existing.select(*key).distinct().withColumn("_stored", F.lit(True))
    is_stored = F.coalesce(F.col("_stored"), F.lit(False))
    return (batch.join(firsts.join(stored, key, "left"), key).where(is_stored | (_order_struct(order) != F.col("_first")))
            .select(*columns, F.when(is_stored, "key already stored").otherwise("repeated in batch").alias("reason")).drop(INPUT_ORDER))


def ingest_report(existing: DataFrame, batch: DataFrame, key: list[str] | None = None) -> DataFrame:
    """I5 counts: input rows, inserted rows, skipped rows (one row); the batch is read once, reduced to its keys."""
    key = key or DEFAULT_LEVEL_KEY
    keys = batch.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
    stored = existing.select(*key).distinct().withColumn("is_stored", F.lit(True))
    # one row for each key; which of its rows is inserted doesn't matter here
    return keys.join(stored, key, "left").agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("input_rows"), F.count_if(F.col("is_stored").isNull()).alias("inserted_rows")).select(
        "input_rows", "inserted_rows", (F.col("input_rows") - F.col("inserted_rows")).alias("skipped_rows"))


def append_levels(path: str, batch: DataFrame, key: list[str] | None = None,
                  order: list[str] | None = None, partition_by: list[str] | None = None,
                  staging_name: str | None = None) -> int:
    """Write the new levels of ``batch`` to the Parquet table at ``path``.

    The new rows are first written to a staging folder beside the table (on
    the same shared storage, so lineage is cut by files that survive a lost
    executor), then appended.  Re-running the same batch adds nothing, which
    makes the append idempotent for streaming retries.  Returns the number
    of rows appended.
    """
    import uuid

    spark = batch.sparkSession
    key = key or DEFAULT_LEVEL_KEY
    try:
        existing = spark.read.parquet(path)
    except AnalysisException as exc:  # the first write creates the table; anything else is an error
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        existing = None
    if existing is None:
        numbered, by = _in_order(batch, order)
        fresh = first_per_key(numbered, key, by).select(batch.columns)
    else:
        fresh = new_levels(existing, batch, key, order)
    staging = path.rstrip("/") + "__staging/" + (staging_name or uuid.uuid4().hex)
    fresh.write.mode("overwrite").parquet(staging)
    staged = spark.read.parquet(staging)
    n = staged.count()
    if n:
        writer = staged.write.mode("append")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return n


# ------------------------------------------------------------ month-partitioned table with a profile directory
def _parts(path: str) -> tuple[str, str]:
    return f"{path}/levels", f"{path}/directory"


def _months_of(levels: DataFrame) -> DataFrame:
    return levels.select("profile_id", F.trunc(F.col("timestamp"), "month").alias(PARTITION_COLUMN)).distinct()


def create_level_store(path: str, levels: DataFrame) -> None:
    """A month-partitioned level table and its directory: which months hold rows of which profile."""
    table, directory = _parts(path)
    _months_of(levels).write.mode("overwrite").parquet(f"{directory}/batch=first")
    write_levels_table(levels, table)


def stored_for(spark, path: str, batch: DataFrame) -> DataFrame:
    """The stored levels that rows of ``batch`` can share a key with, for keys that hold the profile.

    The directory, one row for each profile and month, says which months hold
    the batch's profiles (whatever months the batch names itself); only their
    partitions are read.  To the driver come these months, at most one row for
    each calendar month of the table.
    """
    table, directory = _parts(path)
    known = spark.read.parquet(directory).join(batch.select("profile_id").distinct(), "profile_id", "left_semi")
    months = [r[0] for r in known.select(PARTITION_COLUMN).distinct().collect()]
    wanted = F.col(PARTITION_COLUMN).isin([m for m in months if m is not None])
    if None in months:
        wanted = wanted | F.col(PARTITION_COLUMN).isNull()
    return read_levels_table(spark, table).where(wanted)


def append_to_store(spark, path: str, batch: DataFrame, name: str, key: list[str] | None = None, order: list[str] | None = None) -> int:
    """I3 on a level store: writes the new levels of ``batch`` and returns their number.

    The directory is written first, as the folder of the batch's ``name``: after a
    failure between the two writes it names months in vain, which a retry
    overwrites, and never lacks one.
    """
    table, directory = _parts(path)
    columns = [c for c in read_levels_table(spark, table).columns if c != PARTITION_COLUMN]
    fresh = cut_lineage(new_levels(stored_for(spark, path, batch), batch, key, order).select(columns))
    _months_of(fresh).write.mode("overwrite").parquet(f"{directory}/batch={name}")
    n = fresh.count()
    if n:
        write_levels_table(fresh, table, mode="append")
    return n
