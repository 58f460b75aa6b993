"""Registered queries: ingest.

Stored vs new batches come from the data itself: levels with
``level_no <= 3`` are the stored table and all levels are the new batch;
floats deployed before 1996 are stored and later ones are the batch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bathyspark.operators import ingest as I
from bathyspark.plans.oracle import FLOAT_COLS_SQL, PROFILE_COLS_SQL, sql
from bathyspark.schemas import FLOAT_COLUMNS, PROFILE_COLUMNS
from bathyspark.sources import bindings as B
from bathyspark.sources.io import scratch_dir

ORDER = ["level_no", "part_no", "supp_no", "ext_price"]
KEY = ["profile_id", "depth"]


def _stored_and_batch(s, d):
    lv = B.profile_levels(s, d)
    return lv.where(F.col("level_no") <= 3), lv


def ingest_dedupe(s, d):
    stored, batch = _stored_and_batch(s, d)
    return I.new_levels(stored, batch, KEY, ORDER).select(PROFILE_COLUMNS)


def ingest_skipped(s, d):
    stored, batch = _stored_and_batch(s, d)
    return I.skipped_levels(stored, batch, KEY, ORDER).select(*PROFILE_COLUMNS, "reason")


def ingest_report(s, d):
    stored, batch = _stored_and_batch(s, d)
    return I.ingest_report(stored, batch, KEY)


def ingest_pruned(s, d):
    """I3 with a level store: of the stored levels only the months that hold the batch's profiles are read."""
    lv = B.profile_levels(s, d)
    path = scratch_dir(s, "level-store")
    I.create_level_store(path, lv.where(F.col("level_no") <= 3).select(PROFILE_COLUMNS))
    batch = lv.where(F.col("timestamp").between(F.lit("1996-03-01").cast("timestamp_ntz"), F.lit("1996-04-30").cast("timestamp_ntz")))
    return I.new_levels(I.stored_for(s, path, batch), batch, KEY, ORDER).select(PROFILE_COLUMNS)


def ingest_first_level(s, d):
    lv = B.profile_levels(s, d)
    stored = lv.where(F.col("timestamp") < F.lit("1996-01-01").cast("timestamp_ntz"))
    return I.new_levels(stored, lv, ["profile_id"], ["depth"] + ORDER).select(PROFILE_COLUMNS)


def ingest_floats(s, d):
    f = B.floats(s, d)
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    res = I.append_floats(f.where(F.col("deployment_date") < cut), f.where(F.col("deployment_date") >= cut))
    return res.table.select(FLOAT_COLUMNS)


def ingest_float_conflicts(s, d):
    f = B.floats(s, d)
    stored = f.where(F.col("deployment_date") < F.lit("1996-01-01").cast("timestamp_ntz"))
    batch = f.where(F.col("deployment_date") >= F.lit("1995-10-01").cast("timestamp_ntz"))
    return I.float_conflicts(stored, batch)


QUERIES = {
    "ingest_dedupe": ingest_dedupe,
    "ingest_skipped": ingest_skipped,
    "ingest_report": ingest_report,
    "ingest_pruned": ingest_pruned,
    "ingest_first_level": ingest_first_level,
    "ingest_floats": ingest_floats,
    "ingest_float_conflicts": ingest_float_conflicts,
}

_RANKED = (", b AS (SELECT *, row_number() OVER (PARTITION BY profile_id, depth "
           "ORDER BY level_no, part_no, supp_no, ext_price) AS rn FROM profiles) ")
_STORED = "EXISTS (SELECT 1 FROM profiles e WHERE e.level_no <= 3 AND e.profile_id = b.profile_id AND e.depth = b.depth)"

ORACLE = {
    "ingest_dedupe": sql(_RANKED + f"SELECT {PROFILE_COLS_SQL} FROM b WHERE rn = 1 AND NOT {_STORED}"),
    "ingest_pruned": sql(_RANKED + f"SELECT {PROFILE_COLS_SQL} FROM b WHERE rn = 1 AND NOT {_STORED} "
                         "AND timestamp BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-04-30'"),
    "ingest_skipped": sql(
        ", fresh AS (SELECT *, row_number() OVER (PARTITION BY profile_id, depth "
        "ORDER BY level_no, part_no, supp_no, ext_price) AS rn FROM profiles b WHERE NOT " + _STORED + ") "
        f"SELECT {PROFILE_COLS_SQL}, 'key already stored' AS reason FROM profiles b WHERE {_STORED} "
        f"UNION ALL SELECT {PROFILE_COLS_SQL}, 'repeated in batch' AS reason FROM fresh WHERE rn > 1"),
    "ingest_report": sql(
        _RANKED + "SELECT count(*) AS input_rows, cast(count_if(rn = 1 AND NOT " + _STORED + ") AS bigint) "
        "AS inserted_rows, cast(count(*) - count_if(rn = 1 AND NOT " + _STORED + ") AS bigint) AS skipped_rows FROM b"),
    "ingest_first_level": sql(
        ", b AS (SELECT *, row_number() OVER (PARTITION BY profile_id "
        "ORDER BY depth, level_no, part_no, supp_no, ext_price) AS rn FROM profiles) "
        f"SELECT {PROFILE_COLS_SQL} FROM b WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM profiles e "
        "WHERE e.timestamp < TIMESTAMP '1996-01-01' AND e.profile_id = b.profile_id)"),
    "ingest_floats": sql(f"SELECT {FLOAT_COLS_SQL} FROM floats"),
    "ingest_float_conflicts": sql(
        "SELECT float_id, 'already stored' AS reason FROM floats "
        "WHERE deployment_date >= TIMESTAMP '1995-10-01' AND deployment_date < TIMESTAMP '1996-01-01'"),
}
