"""Sources and sinks (S1-S9): CSV, JSON, raw SQL, stored tables, readiness.

Writers always write partitioned output through Spark (one file per task),
never through the driver.  Scratch output goes under the shared folder named
by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bathyspark.schemas import FLOATS, PROFILES
from bathyspark.session import cut_lineage, scratch_path

TABLE_FLOATS = "argo_floats"
TABLE_PROFILES = "argo_profiles"

JSON_OPTIONS = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS"}
CSV_OPTIONS = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}


def read_floats_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: float CSV with a header row, read against the fixed schema."""
    return spark.read.schema(FLOATS).options(**CSV_OPTIONS).csv(path)


def read_profiles_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILES).options(**CSV_OPTIONS).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, no index column."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON records, nulls kept."""
    df.write.mode(mode).options(**JSON_OPTIONS).json(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """S5 in row form: one CSV text line per row."""
    return df.select(F.to_csv(F.struct(*df.columns), CSV_OPTIONS).alias("line"))


def json_records(df: DataFrame) -> DataFrame:
    """S6 in row form: one JSON record per row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), JSON_OPTIONS).alias("record"))


def export(df: DataFrame, fmt: str, path: str) -> None:
    """Export: ``csv`` writes CSV; any other format writes JSON records."""
    if fmt.lower() == "csv":
        write_csv(df, path)
    else:
        write_json(df, path)


def register_tables(floats: DataFrame, profiles: DataFrame) -> None:
    floats.createOrReplaceTempView(TABLE_FLOATS)
    profiles.createOrReplaceTempView(TABLE_PROFILES)


def execute_sql(spark: SparkSession, text: str, args: dict | None = None,
                on_error: str = "raise") -> DataFrame:
    """Run SQL over the registered tables.

    Errors raise by default; ``on_error='empty'`` returns an empty frame.  For
    that the result is computed here, as a checkpoint in the shared folder, so
    that errors of its rows count as well.
    Values are passed as named parameters (``:name``), never pasted in.
    """
    if on_error != "empty":
        return spark.sql(text, args=args or None)
    try:
        return cut_lineage(spark.sql(text, args=args or None))
    except PySparkException:
        return spark.createDataFrame([], "result string")


def readiness(spark: SparkSession, floats_path: str | None = None, profiles_path: str | None = None,
              floats: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """(table_name, present, n_rows, reason) for both tables in one job.

    A path that isn't there is an answer; any other error is raised.
    """
    rows = []
    for name, path, df in ((TABLE_FLOATS, floats_path, floats), (TABLE_PROFILES, profiles_path, profiles)):
        if df is None:
            try:
                df = spark.read.parquet(path)
            except AnalysisException as exc:
                if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
                rows.append(spark.createDataFrame(
                    [(name, False, None, f"missing: {type(exc).__name__}")],
                    "table_name string, present boolean, n_rows bigint, reason string"))
                continue
        rows.append(df.agg(F.lit(name).alias("table_name"), F.lit(True).alias("present"),
                           F.count(F.lit(1)).alias("n_rows"), F.lit(None).cast("string").alias("reason")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


# ------------------------------------------------------------ stored level table
PARTITION_COLUMN = "month"


def write_levels_table(levels: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store profile levels as Parquet partitioned by month of ``timestamp``.

    Rows are range-partitioned on (month, profile_id) before the write: each
    task writes files for one or two months, and a month holding a third of
    all rows is split over many tasks instead of landing in one.  Date
    filters on the stored table then skip whole partitions.
    """
    month = F.trunc(F.col("timestamp"), "month")
    (levels.withColumn(PARTITION_COLUMN, month)
     .repartitionByRange(PARTITION_COLUMN, "profile_id").sortWithinPartitions(PARTITION_COLUMN, "profile_id", "depth")
     .write.mode(mode).partitionBy(PARTITION_COLUMN).parquet(path))


def read_levels_table(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.sql.types import DateType, StructField, StructType
    schema = StructType(list(PROFILES.fields) + [StructField(PARTITION_COLUMN, DateType(), True)])
    return spark.read.schema(schema).parquet(path)


def month_pruning(start, end) -> Column:
    """Partition predicate matching a timestamp range [start, end].

    ANDed with the row filter it lets Spark list only the months involved
    (``PartitionFilters`` in the plan).
    """
    from bathyspark.functions.filters import _ts
    return F.col(PARTITION_COLUMN).between(F.trunc(_ts(start), "month"), F.trunc(_ts(end), "month"))


# ------------------------------------------------------------ place-clustered level table
PLACE_COLUMN = "place"
PLACE_BITS = 8  # cells of 180 / 2**8 degrees of latitude and 360 / 2**8 of longitude


def _place_cells(lat, lon):
    """Cell numbers of a place, the outermost ones for values beyond the globe."""
    top = (1 << PLACE_BITS) - 1
    cell = lambda x, low, width: F.greatest(F.lit(0), F.least(F.lit(top), F.floor((x - low) / width * (top + 1)))).cast("int")
    return cell(lat, -90.0, 180.0), cell(lon, -180.0, 360.0)


def place_key(lat: Column, lon: Column) -> Column:
    """The bits of both cell numbers in turn: places near each other mostly have near keys (null without a place)."""
    a, b = _place_cells(lat, lon)
    out = F.when(lat.isNotNull() & lon.isNotNull(), F.lit(0))
    for i in range(PLACE_BITS):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(a, i).bitwiseAND(1), 2 * i + 1)).bitwiseOR(F.shiftleft(F.shiftright(b, i).bitwiseAND(1), 2 * i))
    return out


def place_ranges(lat_lo: float, lat_hi: float, lon_lo: float, lon_hi: float, most: int = 48) -> list[tuple[int, int]]:
    """Key ranges that together hold every cell that the box touches, ``most`` at most (then with some other cells)."""
    n = 1 << PLACE_BITS
    cell = lambda x, low, width: max(0, min(n - 1, int((x - low) // (width / n))))
    box = (cell(lat_lo, -90.0, 180.0), cell(lat_hi, -90.0, 180.0), cell(lon_lo, -180.0, 360.0), cell(lon_hi, -180.0, 360.0))

    def cover(finest: int):
        out: list[tuple[int, int]] = []

        def walk(a, b, size, key):
            if a > box[1] or a + size - 1 < box[0] or b > box[3] or b + size - 1 < box[2]:
                return
            if size <= finest or (box[0] <= a and a + size - 1 <= box[1] and box[2] <= b and b + size - 1 <= box[3]):
                if out and out[-1][1] == key - 1:
                    out[-1] = (out[-1][0], key + size * size - 1)
                else:
                    out.append((key, key + size * size - 1))
                return
            half = size // 2
            for i, (da, db) in enumerate(((0, 0), (0, half), (half, 0), (half, half))):
                walk(a + da, b + db, half, key + i * half * half)

        walk(0, 0, n, 0)
        return out

    finest = 1
    while len(found := cover(finest)) > most:
        finest *= 2
    return found


def write_levels_by_place(levels: DataFrame, path: str, mode: str = "overwrite", row_group_bytes: int = 128 << 20) -> None:
    """Store levels sorted by place: range-partitioned on (place key, profile), which also splits a crowded place."""
    (levels.withColumn(PLACE_COLUMN, place_key(F.col("latitude"), F.col("longitude")))
     .repartitionByRange(PLACE_COLUMN, "profile_id", "depth").sortWithinPartitions(PLACE_COLUMN, "profile_id", "depth")
     .write.mode(mode).option("parquet.block.size", row_group_bytes).parquet(path))


def place_pruning(lat_lo: float, lat_hi: float, lon_lo: float, lon_hi: float) -> Column:
    """A box as key ranges, to be ANDed with the row filter: files and row groups without such keys aren't read."""
    out = F.lit(False)
    for low, high in place_ranges(lat_lo, lat_hi, lon_lo, lon_hi):
        out = out | F.col(PLACE_COLUMN).between(low, high)
    return out


# ------------------------------------------------------------ relational source
def read_jdbc_table(spark: SparkSession, url: str, table: str, properties: dict | None = None,
                    id_column: str = "id", num_partitions: int = 64) -> DataFrame:
    """S1/S2 from a relational store: one table read in parallel slices.

    The float and profile tables carry an integer surrogate key; its range
    (one small bounds query) splits the read into ``num_partitions`` JDBC
    queries, so no single connection streams the whole table.  The selected
    columns are those of the fixed schema; filters on the result are pushed
    into the database by Spark's JDBC source.
    """
    props = dict(properties or {})
    bounds = (spark.read.jdbc(url, f"(SELECT min({id_column}) AS lo, max({id_column}) AS hi FROM {table}) b",
                              properties=props).first())
    if bounds is None or bounds["lo"] is None:
        return spark.read.jdbc(url, table, properties=props)
    df = spark.read.jdbc(url, table, column=id_column, lowerBound=int(bounds["lo"]),
                         upperBound=int(bounds["hi"]) + 1, numPartitions=num_partitions, properties=props)
    cols = FLOATS.fieldNames() if table == TABLE_FLOATS else PROFILES.fieldNames()
    return df.select([c for c in cols if c in df.columns])
