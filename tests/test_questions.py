"""Golden parse cases (FIXTURES.md section 2) and literal-mode failures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bathyspark.functions.questions import parse_frame
from bathyspark.plans.answer import parse_table

Y = 2030  # the "current year" argument

CASES = [
    # question, parameters, location, region, (start, end), comparison, profile, intent, error?
    ("Show me temperature profiles near the equator in March 2023", "temperature", None, "equator",
     ("2023-03-01", "2023-03-31"), False, True, "parameter_query", False),
    ("Compare salinity in the Arabian Sea for the last 6 months", "salinity", None, None, None, True, False,
     "parameter_query", False),
    ("What are the nearest ARGO floats to 10°N, 70°E?", "", None, None, None, False, False, "general_query", False),
    ("Show me oxygen data from active floats", "oxygen", None, None, None, False, False, "parameter_query", False),
    ("Show me temperature profiles near the equator", "temperature", None, "equator", None, False, True,
     "parameter_query", False),
    ("What ARGO floats are active in the Indian Ocean?", "", None, "indian ocean", None, False, False,
     "location_query", False),
    ("Compare salinity data from different regions", "salinity", None, None, None, True, False,
     "parameter_query", False),
    ("Show me oxygen profiles from the last 6 months", "oxygen", None, None, None, False, True,
     "parameter_query", False),
    ("Show me temperature data", "temperature", None, None, None, False, False, "parameter_query", False),
    ("What is ARGO data?", "", None, None, None, False, False, "general_query", False),
    ("What is ARGO data and how does it work?", "", None, None, None, False, False, "general_query", False),
    ("Tell me about ocean salinity", "salinity", None, None, None, False, False, "parameter_query", False),
    ("floats near 10.5, 70.25", "", (10.5, 70.25), None, None, False, False, "location_query", False),
    ("oxygen around -5, 60 in the tropical zone", "oxygen", (-5.0, 60.0), "tropical", None, False, False,
     "parameter_query", False),
    ("antarctic nitrate", "nitrate", None, "arctic", None, False, False, "parameter_query", False),
    ("compare floats", "", None, None, None, True, False, "comparison_query", False),
    ("temperature in July 2024 and May 2024", "temperature", None, None, ("2024-07-01", "2024-07-31"), False,
     False, "parameter_query", False),
    ("salinity in February 2023", "salinity", None, None, ("2023-02-01", "2023-02-28"), False, False,
     "parameter_query", True),
    ("temperature below 1000 m", "temperature", None, None, ("1000-01-01", "1000-12-31"), False, False,
     "parameter_query", False),
    ("pressure in march", "pressure", None, None, (f"{Y}-03-01", f"{Y}-03-28"), False, False,
     "parameter_query", False),
    ("floats near 1.2.3, 4", "", None, None, None, False, False, "general_query", True),
    ("Pacific chlorophyll vertical", "chlorophyll", None, "pacific", None, False, True, "parameter_query", False),
]


def _ts(s):
    return dt.datetime.strptime(s, "%Y-%m-%d")


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "question_id long, question string")
    rows = parse_frame(df, "question", Y).orderBy("question_id").collect()
    return {r.question_id: r.p for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_golden_parse(parsed, i):
    q, params, loc, region, time, cmp_, prof, intent, err = CASES[i]
    p = parsed[i]
    assert ",".join(p.parameters) == params, q
    assert (None if p.location is None else (p.location.lat, p.location.lon)) == loc, q
    assert p.region == region, q
    got = None if p.time_range is None else (p.time_range.start, p.time_range.end)
    assert got == (None if time is None else (_ts(time[0]), _ts(time[1]))), q
    assert p.comparison == cmp_ and p.profile_request == prof, q
    assert p.intent == intent, q
    assert (p.error is not None) == err, q


def test_literal_errors_messages(parsed):
    assert parsed[17].error == "day is out of range for month"
    assert parsed[20].error == "could not convert string to float: '1.2.3'"


def test_bounds_location_wins_and_unbounded_regions(spark):
    df = spark.createDataFrame([(1, "oxygen around -5, 60 in the tropical zone"), (2, "antarctic nitrate"),
                                (3, "Pacific chlorophyll")], "question_id long, question string")
    b = {r.question_id: r.b for r in parse_table(df, Y).collect()}
    assert (b[1].lat_lo, b[1].lat_hi, b[1].lon_lo, b[1].lon_hi) == (-6.0, -4.0, 59.0, 61.0)
    assert b[2].lat_lo is None and b[2].need_nitrate
    assert (b[3].lon_lo, b[3].lon_hi) == (120.0, -60.0)


def test_question_batch_literal_mode_fails_bad_questions(spark):
    from bathyspark.plans.answer import question_batch
    from bathyspark.sources import bindings as B
    from tests.conftest import SF_SMALL
    qs = spark.createDataFrame([(1, "salinity in February 1996"), (2, "salinity in 1996")],
                               "question_id long, question string")
    lv = B.profile_levels(spark, SF_SMALL)
    lit = {r.question_id: r for r in question_batch(lv, qs, Y, mode="literal").collect()}
    dfl = {r.question_id: r for r in question_batch(lv, qs, Y).collect()}
    assert lit[1].failed and lit[1].total_records == 0
    assert not dfl[1].failed and dfl[1].total_records > 0
    assert dfl[2].total_records >= dfl[1].total_records
    _ = F
