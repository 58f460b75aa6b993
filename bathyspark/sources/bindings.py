"""Bindings of the driver tables to the float data model.

``floats``    <- customer join nation (one row per float)
``profiles``  <- lineitem join orders (one row per profile level)
``questions`` <- a question template over customer, plus user turns of
                 conversations

The expressions are kept as SQL text so the DuckDB oracle can build the very
same views (see ``bathyspark.plans.oracle``); only the date arithmetic differs
between dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bathyspark.schemas import FLOAT_COLUMNS, PROFILE_COLUMNS

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Extra per-level columns that make a total order over profile levels.
TIE_COLUMNS = ["level_no", "part_no", "supp_no", "ext_price"]
LEVEL_ORDER = ["profile_id", "depth"] + TIE_COLUMNS


def _pad(expr: str, width: int) -> str:
    """Zero-padded decimal text of a non-negative key; never truncates."""
    return (f"CASE WHEN {expr} < {10 ** width} THEN lpad(cast({expr} AS string), {width}, '0') "
            f"ELSE cast({expr} AS string) END")


def _float_exprs(key: str, dialect: str) -> dict[str, str]:
    if dialect == "spark":
        deployed = f"cast(date_add(date'1995-01-01', cast({key} % 700 as int)) as timestamp_ntz)"
    else:
        deployed = f"cast(date '1995-01-01' + cast({key} % 700 as int) as timestamp)"
    return {
        "float_id": f"concat('F_', {_pad(key, 6)})",
        "platform_type": "c_mktsegment",
        "deployment_date": deployed,
        "latitude": f"cast((({key}*7919) % 6001) as double)/100 - 30",
        "longitude": f"cast((({key}*104729) % 10001) as double)/100 + 20",
        "status": (f"case when {key}%10<7 then 'active' when {key}%10<9 "
                   "then 'inactive' else 'maintenance' end"),
        "max_pressure": f"cast(1000 + {key}%1001 as int)",
        "cycle_time": f"cast(5 + {key}%6 as int)",
        "institution": "n_name",
    }


def _profile_exprs() -> dict[str, str]:
    lat = "cast(((o_custkey*7919) % 6001) as double)/100 - 30"
    lon = "cast(((o_custkey*104729) % 10001) as double)/100 + 20"
    return {
        "profile_id": f"concat('F_', {_pad('o_custkey', 6)}, '_', {_pad('o_orderkey', 7)})",
        "float_id": f"concat('F_', {_pad('o_custkey', 6)})",
        "timestamp": "o_orderdate",
        "latitude": f"{lat} + cast(o_orderkey%101 as double)/100 - 0.5e0",
        "longitude": f"{lon} + cast((o_orderkey*31)%101 as double)/100 - 0.5e0",
        "depth": "l_quantity*40",
        "temperature": "case when l_linenumber=7 then null else 30 - l_quantity*0.6e0 + l_discount end",
        "salinity": "case when l_partkey%11=0 then null else 32 + l_tax*50 end",
        "pressure": "l_quantity*40",
        "oxygen": "case when l_partkey%5=0 then null else l_extendedprice/350 end",
        "nitrate": "l_quantity",
        "chlorophyll": "l_discount*50",
        "backscatter": "l_tax",
        "downwelling_irradiance": "1000 - l_quantity*20",
        "level_no": "l_linenumber",
        "part_no": "l_partkey",
        "supp_no": "l_suppkey",
        "ext_price": "l_extendedprice",
    }


# Question template over customer: every row yields one question, mixing the
# parameter, place, region, month and year forms the parser understands.
QUESTION_TEMPLATE = (
    "concat("
    "case c_custkey % 4 when 0 then 'Show me ' when 1 then 'Compare ' "
    "when 2 then 'What is the ' else 'Plot vertical ' end, "
    "case c_custkey % 3 when 0 then 'temperature' when 1 then 'salinity' else 'oxygen' end, "
    "case c_custkey % 5 "
    "when 0 then concat(' near ', cast(c_custkey % 50 - 25 as string), ', ', cast(20 + c_custkey % 90 as string)) "
    "when 1 then ' near the equator' when 2 then ' in the indian ocean' "
    "when 3 then ' in the tropical atlantic' else '' end, "
    "case c_custkey % 7 "
    "when 0 then concat(' in march ', cast(1995 + c_custkey % 6 as string)) "
    "when 1 then concat(' in july ', cast(1995 + c_custkey % 6 as string)) "
    "when 2 then concat(' during ', cast(1995 + c_custkey % 6 as string)) "
    "when 3 then ' in april' else '' end, "
    "case c_custkey % 11 when 0 then ' profiles' when 1 then ' versus depth' else '' end, "
    "case c_custkey % 13 when 0 then ' and june' else '' end)"
)


def sql_views(dialect: str = "duckdb") -> str:
    """``WITH`` clause defining floats, profiles and questions over the raw tables."""
    fl = ", ".join(f"{e} AS {n}" for n, e in _float_exprs("c_custkey", dialect).items())
    pr = ", ".join(f"{e} AS {n}" for n, e in _profile_exprs().items())
    return (
        "WITH floats AS (SELECT " + fl + " FROM customer JOIN nation ON c_nationkey = n_nationkey), "
        "profiles AS (SELECT " + pr + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
        "questions AS (SELECT c_custkey AS question_id, " + QUESTION_TEMPLATE + " AS question FROM customer "
        "UNION ALL SELECT 100000000000 + conv_id * 1000 + turn AS question_id, text AS question "
        "FROM conversations WHERE role = 'user') "
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.select([F.expr(e).alias(n) for n, e in _float_exprs("c_custkey", "spark").items()])


def profile_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile levels with the tie-break columns that give a total order."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = li.join(orders, li.l_orderkey == orders.o_orderkey)
    return joined.select([F.expr(e).alias(n) for n, e in _profile_exprs().items()])


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_levels(spark, sf_dir).select(PROFILE_COLUMNS)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, question) for every customer row and every user turn."""
    templ = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("question_id"), F.expr(QUESTION_TEMPLATE).alias("question"))
    conv = (table(spark, sf_dir, "conversations").where(F.col("role") == "user")
            .select((F.lit(100000000000) + F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
                    F.col("text").alias("question")))
    return templ.unionByName(conv)


__all__ = ["TABLES", "TIE_COLUMNS", "LEVEL_ORDER", "FLOAT_COLUMNS", "PROFILE_COLUMNS",
           "sql_views", "table", "floats", "profile_levels", "profiles", "questions"]
