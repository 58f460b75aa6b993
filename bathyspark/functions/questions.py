"""Rule-based question parsing as Column expressions.

Every rule is a built-in expression over the lower-cased question, so a table
of a billion questions parses in one projection, inside whole-stage codegen.
No UDF, no driver loop.

Two readings are computed side by side:

* the corrected reading (fields of ``parse_question``), which is what the
  answer operators use by default;
* ``error``: the message the literal rules would fail with (unparsable
  coordinates, a short month with a year, year 0).  Literal mode turns such a
  question into a failure record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from bathyspark.schemas import (
    COMPARISON_WORDS, LOCATION_PATTERN, MONTHS, PROFILE_WORDS, QUESTION_PARAMETERS,
    REGION_WORDS, YEAR_PATTERN,
)

SHORT_MONTHS = [2, 4, 6, 9, 11]  # months without a 31st day


def _has(lower: Column, word: str) -> Column:
    return F.instr(lower, word) > 0


def _any(lower: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [_has(lower, w) for w in words])


def q_parameters(question: Column) -> Column:
    """Known parameters named in the question, in fixed order."""
    lower = F.lower(question)
    names = F.array(*[F.lit(p) for p in QUESTION_PARAMETERS])
    return F.filter(names, lambda p: F.instr(lower, p) > 0)


def q_location(question: Column) -> Column:
    """First ``near|around|close to|at|in <lat>, <lon>`` as a struct.

    Null when absent or when a number does not parse (``try_cast``).
    """
    lower = F.lower(question)
    lat = F.regexp_extract(lower, LOCATION_PATTERN, 2).try_cast("double")
    lon = F.regexp_extract(lower, LOCATION_PATTERN, 3).try_cast("double")
    ok = lower.rlike(LOCATION_PATTERN) & lat.isNotNull() & lon.isNotNull()
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon")))


def q_location_error(question: Column) -> Column:
    lower = F.lower(question)
    lat_txt = F.regexp_extract(lower, LOCATION_PATTERN, 2)
    lon_txt = F.regexp_extract(lower, LOCATION_PATTERN, 3)
    bad = F.when(lat_txt.try_cast("double").isNull(), lat_txt).when(
        lon_txt.try_cast("double").isNull(), lon_txt)
    return F.when(lower.rlike(LOCATION_PATTERN) & bad.isNotNull(),
                  F.concat(F.lit("could not convert string to float: '"), bad, F.lit("'")))


def q_region(question: Column) -> Column:
    """First region word in fixed order (T4); 'antarctic' yields 'arctic'."""
    lower = F.lower(question)
    out = F.lit(None).cast("string")
    for word in reversed(REGION_WORDS):
        out = F.when(_has(lower, word), F.lit(word)).otherwise(out)
    return out


def _year(question: Column) -> Column:
    txt = F.regexp_extract(question, YEAR_PATTERN, 1)
    return F.when(txt != "", txt.try_cast("int"))


def _last_month(lower: Column) -> Column:
    out = F.lit(None).cast("int")
    for num, name in enumerate(MONTHS, start=1):
        out = F.when(_has(lower, name), F.lit(num)).otherwise(out)
    return out


def _short_month_named(lower: Column) -> Column:
    return _any(lower, [MONTHS[m - 1] for m in SHORT_MONTHS])


def q_time(question: Column, current_year: int) -> Column:
    """Time range struct<start, end> of TIMESTAMP_NTZ.

    A year gives Jan 1 to Dec 31.  A month name (the latest in calendar order
    wins) narrows it to that month: with a year, day 1 to the month's last
    day; without one, day 1 to 28 of ``current_year`` (passed in, never read
    from the clock).
    """
    lower = F.lower(question)
    year = _year(question)
    month = _last_month(lower)
    year_ok = year.isNotNull() & (year >= 1)
    y_start = F.make_timestamp_ntz(year, F.coalesce(month, F.lit(1)), F.lit(1),
                                   F.lit(0), F.lit(0), F.lit(0))
    y_end = F.when(month.isNull(), F.make_timestamp_ntz(year, F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0))
                   ).otherwise(F.last_day(y_start).cast("timestamp_ntz"))
    cy = F.lit(int(current_year))
    m_start = F.make_timestamp_ntz(cy, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    m_end = F.make_timestamp_ntz(cy, month, F.lit(28), F.lit(0), F.lit(0), F.lit(0))
    start = F.when(year_ok, y_start).when(month.isNotNull(), m_start)
    end = F.when(year_ok, y_end).when(month.isNotNull(), m_end)
    return F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def q_time_error(question: Column) -> Column:
    lower = F.lower(question)
    year = _year(question)
    return (F.when(year.isNotNull() & (year < 1), F.concat(F.lit("year "), year.cast("string"),
                                                           F.lit(" is out of range")))
            .when(year.isNotNull() & _short_month_named(lower), F.lit("day is out of range for month")))


def q_comparison(question: Column) -> Column:
    return _any(F.lower(question), COMPARISON_WORDS)


def q_profile_request(question: Column) -> Column:
    return _any(F.lower(question), PROFILE_WORDS)


def q_intent(parameters: Column, location: Column, region: Column, comparison: Column) -> Column:
    placed = location.isNotNull() | region.isNotNull()
    has_params = F.size(parameters) > 0
    return (F.when(placed & has_params, "parameter_query")
            .when(placed, "location_query")
            .when(has_params, "parameter_query")
            .when(comparison, "comparison_query")
            .otherwise("general_query"))


def parse_question(question: Column, current_year: int) -> Column:
    """Whole parse as one struct."""
    params = q_parameters(question)
    loc = q_location(question)
    region = q_region(question)
    comp = q_comparison(question)
    return F.struct(
        question.alias("original_query"),
        q_intent(params, loc, region, comp).alias("intent"),
        params.alias("parameters"),
        loc.alias("location"),
        q_time(question, current_year).alias("time_range"),
        region.alias("region"),
        comp.alias("comparison"),
        q_profile_request(question).alias("profile_request"),
        F.coalesce(q_location_error(question), q_time_error(question)).alias("error"),
    )


def parse_frame(df, text_col: str, current_year: int, out: str = "p", bounds=None, bounds_out: str = "b"):
    """T10 over a DataFrame, in staged projections.

    Each shared piece (lower-cased text, regex groups, year, month) is a
    column of its own, computed once per row, so the generated code stays
    small and every stage stays inside whole-stage codegen.  ``bounds``, a
    function of the flat parse columns, adds the filter bounds as a struct
    built from those columns (never from fields of the parse struct, which
    would re-inline the whole parse per field).
    """
    q = F.col(text_col)
    s1 = df.select("*", F.lower(q).alias("_ql"), F.regexp_extract(q, YEAR_PATTERN, 1).alias("_ytxt"))
    ql = F.col("_ql")

    def found(words: list[str]) -> Column:
        return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.instr(ql, w) > 0)

    def any_of(words: list[str]) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.instr(ql, w) > 0)

    # latest month in calendar order, first region word in fixed order
    months = F.array(*[F.lit(m) for m in MONTHS])
    month = F.array_max(F.transform(months, lambda m, i: F.when(F.instr(ql, m) > 0, i + 1)))
    s2 = s1.select(
        "*", ql.rlike(LOCATION_PATTERN).alias("_has_loc"),
        F.regexp_extract(ql, LOCATION_PATTERN, 2).alias("_lat_txt"),
        F.regexp_extract(ql, LOCATION_PATTERN, 3).alias("_lon_txt"),
        F.when(F.col("_ytxt") != "", F.col("_ytxt").try_cast("int")).alias("_yr"),
        month.alias("_mo"), any_of([MONTHS[m - 1] for m in SHORT_MONTHS]).alias("_short"),
        found(QUESTION_PARAMETERS).alias("_params"),
        F.try_element_at(found(REGION_WORDS), F.lit(1)).alias("_region"),
        any_of(COMPARISON_WORDS).alias("_cmp"), any_of(PROFILE_WORDS).alias("_prof"))
    s3 = s2.select("*", F.col("_lat_txt").try_cast("double").alias("_lat"),
                   F.col("_lon_txt").try_cast("double").alias("_lon"))
    yr, mo = F.col("_yr"), F.col("_mo")
    year_ok = yr.isNotNull() & (yr >= 1)
    zero = F.lit(0)
    y_start = F.make_timestamp_ntz(yr, F.coalesce(mo, F.lit(1)), F.lit(1), zero, zero, zero)
    y_end = F.when(mo.isNull(), F.make_timestamp_ntz(yr, F.lit(12), F.lit(31), zero, zero, zero)).otherwise(
        F.last_day(F.make_date(yr, mo, F.lit(1))).cast("timestamp_ntz"))
    cy = F.lit(int(current_year))
    start = F.when(year_ok, y_start).when(mo.isNotNull(), F.make_timestamp_ntz(cy, mo, F.lit(1), zero, zero, zero))
    end = F.when(year_ok, y_end).when(mo.isNotNull(), F.make_timestamp_ntz(cy, mo, F.lit(28), zero, zero, zero))
    loc_ok = F.col("_has_loc") & F.col("_lat").isNotNull() & F.col("_lon").isNotNull()
    s4 = s3.select("*", loc_ok.alias("_loc_ok"), start.alias("_start"), end.alias("_end"))
    loc = F.when(F.col("_loc_ok"), F.struct(F.col("_lat").alias("lat"), F.col("_lon").alias("lon")))
    time = F.when(F.col("_start").isNotNull(), F.struct(F.col("_start").alias("start"), F.col("_end").alias("end")))
    bad_txt = F.when(F.col("_lat").isNull(), F.col("_lat_txt")).when(F.col("_lon").isNull(), F.col("_lon_txt"))
    error = (F.when(F.col("_has_loc") & bad_txt.isNotNull(),
                    F.concat(F.lit("could not convert string to float: '"), bad_txt, F.lit("'")))
             .when(yr.isNotNull() & (yr < 1), F.concat(F.lit("year "), yr.cast("string"), F.lit(" is out of range")))
             .when(yr.isNotNull() & F.col("_short"), F.lit("day is out of range for month")))
    placed = F.col("_loc_ok") | F.col("_region").isNotNull()
    has_params = F.size(F.col("_params")) > 0
    intent = (F.when(placed & has_params, "parameter_query").when(placed, "location_query")
              .when(has_params, "parameter_query").when(F.col("_cmp"), "comparison_query")
              .otherwise("general_query"))
    parsed = F.struct(
        q.alias("original_query"), intent.alias("intent"),
        F.col("_params").alias("parameters"), loc.alias("location"), time.alias("time_range"),
        F.col("_region").alias("region"), F.col("_cmp").alias("comparison"), F.col("_prof").alias("profile_request"),
        error.alias("error"))
    cols = [F.col(c) for c in df.columns] + [parsed.alias(out)]
    if bounds is not None:
        cols.append(bounds(F.col("_loc_ok"), F.col("_lat"), F.col("_lon"), F.col("_region"), F.col("_start"),
                           F.col("_end"), F.col("_prof"), F.col("_params")).alias(bounds_out))
    return s4.select(*cols)
