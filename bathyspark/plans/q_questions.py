"""Registered queries: question parsing and answering.

Questions come from the ``questions`` binding: a question template over every
customer row plus the user turns of ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from bathyspark.functions import questions as T
from bathyspark.plans import answer
from bathyspark.plans.oracle import PROFILE_COLS_SQL, exact, sql
from bathyspark.schemas import (
    COMPARISON_WORDS, DEFAULT_ROW_LIMIT, LOCATION_PATTERN, MONTHS, PROFILE_WORDS, QUESTION_PARAMETERS, REGION_BOUNDS,
    REGION_WORDS, YEAR_PATTERN,
)
from bathyspark.sources import bindings as B

FLAGSHIP_QUESTION = "Show me temperature profiles near the equator in March 1996"
NEWEST_QUESTION = "What is the salinity in the indian ocean during 1996"  # no profile request: newest rows first (O5)
CURRENT_YEAR = 1996  # the parser's "current year", fixed so results are reproducible


def _questions(s, d):
    return B.questions(s, d)


def q_question_rows(spark, sf_dir):
    return answer.question_rows(B.profile_levels(spark, sf_dir), FLAGSHIP_QUESTION, CURRENT_YEAR)


def _parsed(s, d):
    return answer.parse_table(_questions(s, d), CURRENT_YEAR)


def parse_questions(s, d):
    p = _parsed(s, d)
    return p.select(
        "question_id", F.col("p.intent").alias("intent"),
        F.array_join("p.parameters", ",").alias("parameters"),
        F.col("p.location.lat").alias("lat"), F.col("p.location.lon").alias("lon"),
        F.col("p.region").alias("region"),
        F.col("p.time_range.start").alias("time_start"), F.col("p.time_range.end").alias("time_end"),
        F.col("p.comparison").alias("comparison"), F.col("p.profile_request").alias("profile_request"),
        F.col("p.error").alias("error"))


def _batch(s, d, mode="default"):
    return answer.question_batch(B.profile_levels(s, d), _questions(s, d), CURRENT_YEAR, mode=mode)


QUERIES = {
    "question_rows": q_question_rows,
    "q_parameters": lambda s, d: _questions(s, d).select(
        "question_id", F.array_join(T.q_parameters(F.col("question")), ",").alias("parameters")),
    "q_location": lambda s, d: _questions(s, d).select(
        "question_id", T.q_location(F.col("question"))["lat"].alias("lat"),
        T.q_location(F.col("question"))["lon"].alias("lon")),
    "q_region": lambda s, d: _questions(s, d).select("question_id", T.q_region(F.col("question")).alias("region")),
    "q_time": lambda s, d: _questions(s, d).select(
        "question_id", T.q_time(F.col("question"), CURRENT_YEAR)["start"].alias("time_start"),
        T.q_time(F.col("question"), CURRENT_YEAR)["end"].alias("time_end")),
    "q_flags": lambda s, d: _questions(s, d).select(
        "question_id", T.q_comparison(F.col("question")).alias("comparison"),
        T.q_profile_request(F.col("question")).alias("profile_request")),
    "q_intent": lambda s, d: _parsed(s, d).select("question_id", F.col("p.intent").alias("intent")),
    "parse_questions": parse_questions,
    "question_filters": lambda s, d: _parsed(s, d).select("question_id", "b.*"),
    "question_errors": lambda s, d: _parsed(s, d).where(F.col("p.error").isNotNull()).select(
        "question_id", F.col("p.error").alias("error"),
        F.concat(F.lit("Error processing query: "), F.col("p.error")).alias("response"),
        F.lit(0).cast("long").alias("total_records")),
    "question_batch": lambda s, d: _batch(s, d).select(
        "question_id", "total_records", "min_lat", "max_lat", "min_lon", "max_lon", "time_min", "time_max",
        "temperature_mean", "salinity_mean", "oxygen_mean"),
    "question_counts": lambda s, d: _batch(s, d, "literal").select("question_id", "question", "total_records"),
    "answer_summary": lambda s, d: answer.answer_summary(_batch(s, d)).withColumn(
        "parameters_found", F.array_join("parameters_found", ",")),
    "question_rows_newest": lambda s, d: answer.question_rows(
        B.profile_levels(s, d), NEWEST_QUESTION, CURRENT_YEAR).limit(DEFAULT_ROW_LIMIT),
}

# ------------------------------------------------------------------ DuckDB SQL
_PAT = LOCATION_PATTERN


def _contains_any(words):
    return "(" + " OR ".join(f"contains(ql, '{w}')" for w in words) + ")"


def _first_match(words, value=None):
    return "CASE " + " ".join(f"WHEN contains(ql, '{w}') THEN '{w}'" for w in words) + " END"


_MONTH_SQL = "CASE " + " ".join(
    f"WHEN contains(ql, '{m}') THEN {i}" for i, m in reversed(list(enumerate(MONTHS, start=1)))) + " END"
_SHORT_SQL = _contains_any([MONTHS[m - 1] for m in T.SHORT_MONTHS])

PARSED_CTE = (
    ", q0 AS (SELECT question_id, question, lower(question) AS ql FROM questions), "
    "q1 AS (SELECT *, "
    f"regexp_matches(ql, '{_PAT}') AS has_loc, "
    f"regexp_extract(ql, '{_PAT}', 2) AS lat_txt, regexp_extract(ql, '{_PAT}', 3) AS lon_txt, "
    f"CASE WHEN regexp_extract(question, '{YEAR_PATTERN}', 1) <> '' THEN "
    f"try_cast(regexp_extract(question, '{YEAR_PATTERN}', 1) AS integer) END AS yr, "
    f"{_MONTH_SQL} AS mo, {_SHORT_SQL} AS short_mo FROM q0), "
    "parsed AS (SELECT question_id, question, "
    "concat_ws(',', " + ", ".join(f"CASE WHEN contains(ql, '{p}') THEN '{p}' END" for p in QUESTION_PARAMETERS)
    + ") AS parameters, "
    "CASE WHEN has_loc AND try_cast(lat_txt AS double) IS NOT NULL AND try_cast(lon_txt AS double) IS NOT NULL "
    "THEN try_cast(lat_txt AS double) END AS lat, "
    "CASE WHEN has_loc AND try_cast(lat_txt AS double) IS NOT NULL AND try_cast(lon_txt AS double) IS NOT NULL "
    "THEN try_cast(lon_txt AS double) END AS lon, "
    f"{_first_match(REGION_WORDS)} AS region, "
    "CASE WHEN yr >= 1 THEN make_timestamp(yr, coalesce(mo, 1), 1, 0, 0, 0) "
    f"WHEN mo IS NOT NULL THEN make_timestamp({CURRENT_YEAR}, mo, 1, 0, 0, 0) END AS time_start, "
    "CASE WHEN yr >= 1 THEN (CASE WHEN mo IS NULL THEN make_timestamp(yr, 12, 31, 0, 0, 0) "
    "ELSE cast(last_day(make_date(yr, mo, 1)) AS timestamp) END) "
    f"WHEN mo IS NOT NULL THEN make_timestamp({CURRENT_YEAR}, mo, 28, 0, 0, 0) END AS time_end, "
    f"{_contains_any(COMPARISON_WORDS)} AS comparison, {_contains_any(PROFILE_WORDS)} AS profile_request, "
    "CASE WHEN has_loc AND try_cast(lat_txt AS double) IS NULL THEN 'could not convert string to float: ''' || lat_txt || '''' "
    "WHEN has_loc AND try_cast(lon_txt AS double) IS NULL THEN 'could not convert string to float: ''' || lon_txt || '''' "
    "WHEN yr IS NOT NULL AND yr < 1 THEN 'year ' || cast(yr AS varchar) || ' is out of range' "
    "WHEN yr IS NOT NULL AND short_mo THEN 'day is out of range for month' END AS error FROM q1), "
    "parsed2 AS (SELECT *, CASE WHEN (lat IS NOT NULL OR region IS NOT NULL) AND parameters <> '' THEN 'parameter_query' "
    "WHEN lat IS NOT NULL OR region IS NOT NULL THEN 'location_query' WHEN parameters <> '' THEN 'parameter_query' "
    "WHEN comparison THEN 'comparison_query' ELSE 'general_query' END AS intent FROM parsed) "
)


def _region_case(idx: int) -> str:
    return "CASE region " + " ".join(f"WHEN '{n}' THEN {float(b[idx])}" for n, b in REGION_BOUNDS.items()) + " END"


BOUNDS_CTE = (
    ", bounds AS (SELECT question_id, question, error, parameters, "
    f"CASE WHEN lat IS NOT NULL THEN lat - 1.0 ELSE {_region_case(0)} END AS lat_lo, "
    f"CASE WHEN lat IS NOT NULL THEN lat + 1.0 ELSE {_region_case(1)} END AS lat_hi, "
    f"CASE WHEN lat IS NOT NULL THEN lon - 1.0 ELSE {_region_case(2)} END AS lon_lo, "
    f"CASE WHEN lat IS NOT NULL THEN lon + 1.0 ELSE {_region_case(3)} END AS lon_hi, "
    "time_start AS ts_lo, time_end AS ts_hi, CASE WHEN profile_request THEN cast(1000 AS double) END AS depth_hi, "
    + ", ".join(f"contains(',' || parameters || ',', ',{p},') AS need_{p}" for p in QUESTION_PARAMETERS)
    + " FROM parsed2) "
)

MATCH_COND = (
    " AND ".join(f"(NOT q.need_{p} OR r.{p} IS NOT NULL)" for p in QUESTION_PARAMETERS)
    + " AND (q.lat_lo IS NULL OR r.latitude BETWEEN q.lat_lo AND q.lat_hi)"
    + " AND (q.lon_lo IS NULL OR r.longitude BETWEEN q.lon_lo AND q.lon_hi)"
    + " AND (q.ts_lo IS NULL OR r.timestamp BETWEEN q.ts_lo AND q.ts_hi)"
    + " AND (q.depth_hi IS NULL OR r.depth <= q.depth_hi)"
)


# levels with each parameter's exact value, cast once and not once a matching question
EXACT_CTE = (", exact_levels AS MATERIALIZED (SELECT *, "
             + ", ".join(f"{exact(p)} AS {p}_exact" for p in QUESTION_PARAMETERS) + " FROM profiles) ")


def exact_mean_sql(p: str) -> str:
    return f"cast(sum(r.{p}_exact) AS double) / count(r.{p})"


ORACLE = {
    "question_rows": sql(
        f"SELECT {PROFILE_COLS_SQL} FROM profiles WHERE temperature IS NOT NULL "
        "AND latitude BETWEEN -5.0 AND 5.0 AND longitude BETWEEN -180.0 AND 180.0 "
        "AND timestamp BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-31' "
        "AND depth <= 1000.0"),
    "question_rows_newest": sql(
        f"SELECT {PROFILE_COLS_SQL} FROM profiles WHERE salinity IS NOT NULL "
        "AND latitude BETWEEN -30.0 AND 30.0 AND longitude BETWEEN 20.0 AND 120.0 "
        "AND timestamp BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' "
        f"ORDER BY timestamp DESC, profile_id, depth, level_no, part_no, supp_no, ext_price LIMIT {DEFAULT_ROW_LIMIT}"),
    "q_parameters": sql(PARSED_CTE + "SELECT question_id, parameters FROM parsed2"),
    "q_location": sql(PARSED_CTE + "SELECT question_id, lat, lon FROM parsed2"),
    "q_region": sql(PARSED_CTE + "SELECT question_id, region FROM parsed2"),
    "q_time": sql(PARSED_CTE + "SELECT question_id, time_start, time_end FROM parsed2"),
    "q_flags": sql(PARSED_CTE + "SELECT question_id, comparison, profile_request FROM parsed2"),
    "q_intent": sql(PARSED_CTE + "SELECT question_id, intent FROM parsed2"),
    "parse_questions": sql(PARSED_CTE + "SELECT question_id, intent, parameters, lat, lon, region, time_start, "
                           "time_end, comparison, profile_request, error FROM parsed2"),
    "question_filters": sql(PARSED_CTE + BOUNDS_CTE + "SELECT question_id, lat_lo, lat_hi, lon_lo, lon_hi, ts_lo, "
                            "ts_hi, depth_hi, " + ", ".join(f"need_{p}" for p in QUESTION_PARAMETERS)
                            + " FROM bounds"),
    "question_errors": sql(PARSED_CTE + "SELECT question_id, error, 'Error processing query: ' || error AS response, "
                           "cast(0 AS bigint) AS total_records FROM parsed2 WHERE error IS NOT NULL"),
    "question_batch": sql(
        EXACT_CTE + PARSED_CTE + BOUNDS_CTE + "SELECT q.question_id, count(r.profile_id) AS total_records, "
        "min(r.latitude) AS min_lat, max(r.latitude) AS max_lat, min(r.longitude) AS min_lon, "
        "max(r.longitude) AS max_lon, min(r.timestamp) AS time_min, max(r.timestamp) AS time_max, "
        f"{exact_mean_sql('temperature')} AS temperature_mean, {exact_mean_sql('salinity')} AS salinity_mean, "
        f"{exact_mean_sql('oxygen')} AS oxygen_mean "
        f"FROM bounds q LEFT JOIN exact_levels r ON {MATCH_COND} GROUP BY q.question_id"),
    "question_counts": sql(
        PARSED_CTE + BOUNDS_CTE + "SELECT q.question_id, q.question, CASE WHEN q.error IS NOT NULL THEN 0 "
        "ELSE count(r.profile_id) END AS total_records "
        f"FROM bounds q LEFT JOIN profiles r ON {MATCH_COND} GROUP BY q.question_id, q.question, q.error"),
    "answer_summary": sql(
        PARSED_CTE + BOUNDS_CTE + ", agg AS (SELECT q.question_id, count(r.profile_id) AS total_records, "
        + ", ".join(f"count(r.{p}) AS n_{p}" for p in QUESTION_PARAMETERS)
        + ", min(r.latitude) AS min_lat, max(r.latitude) AS max_lat, min(r.longitude) AS min_lon, "
        f"max(r.longitude) AS max_lon FROM bounds q LEFT JOIN profiles r ON {MATCH_COND} GROUP BY q.question_id) "
        "SELECT question_id, total_records, concat_ws(',', "
        + ", ".join(f"CASE WHEN n_{p} > 0 THEN '{p}' END" for p in QUESTION_PARAMETERS)
        + ") AS parameters_found, min_lat, max_lat, min_lon, max_lon FROM agg"),
}
