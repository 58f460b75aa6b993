"""Fixed schemas and the fixed values the operators must agree on."""

from __future__ import annotations

import re

from pyspark.sql import types as T

FLOATS_DDL = (
    "float_id STRING, platform_type STRING, deployment_date TIMESTAMP_NTZ, "
    "latitude DOUBLE, longitude DOUBLE, status STRING, max_pressure INT, "
    "cycle_time INT, institution STRING"
)

PROFILES_DDL = (
    "profile_id STRING, float_id STRING, timestamp TIMESTAMP_NTZ, latitude DOUBLE, "
    "longitude DOUBLE, depth DOUBLE, temperature DOUBLE, salinity DOUBLE, "
    "pressure DOUBLE, oxygen DOUBLE, nitrate DOUBLE, chlorophyll DOUBLE, "
    "backscatter DOUBLE, downwelling_irradiance DOUBLE"
)

NESTED_DDL = (
    "profile_id STRING, float_id STRING, timestamp TIMESTAMP_NTZ, latitude DOUBLE, "
    "longitude DOUBLE, depths ARRAY<DOUBLE>, parameters MAP<STRING, ARRAY<DOUBLE>>"
)

_TYPES = {
    "STRING": T.StringType(), "DOUBLE": T.DoubleType(), "INT": T.IntegerType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "ARRAY<DOUBLE>": T.ArrayType(T.DoubleType()),
    "MAP<STRING, ARRAY<DOUBLE>>": T.MapType(T.StringType(), T.ArrayType(T.DoubleType())),
}


def _struct(ddl: str) -> T.StructType:
    fields = []
    for part in re.split(r",\s(?=[a-z_]+\s)", ddl):
        name, typ = part.strip().split(" ", 1)
        fields.append(T.StructField(name, _TYPES[typ.strip()], True))
    return T.StructType(fields)


FLOATS = _struct(FLOATS_DDL)
PROFILES = _struct(PROFILES_DDL)
NESTED = _struct(NESTED_DDL)

FLOAT_COLUMNS = [f.name for f in FLOATS.fields]
PROFILE_COLUMNS = [f.name for f in PROFILES.fields]

# Base columns kept by every parameter projection (export, API rows).
BASE_COLUMNS = ["profile_id", "float_id", "timestamp", "latitude", "longitude", "depth"]

# --- fixed values (must equal the reference's) --------------------------------
# Measurement parameters stored per level, in table order.
PARAMETERS = [
    "temperature", "salinity", "pressure", "oxygen", "nitrate",
    "chlorophyll", "backscatter", "downwelling_irradiance",
]

# Parameters the question parser recognises, in match order.
QUESTION_PARAMETERS = [
    "temperature", "salinity", "pressure", "oxygen", "nitrate",
    "chlorophyll", "backscatter",
]

# Physical range of each parameter: (low, high).
RANGES = {
    "temperature": (0.0, 30.0),
    "salinity": (32.0, 37.0),
    "pressure": (0.0, 2000.0),
    "oxygen": (0.0, 300.0),
    "nitrate": (0.0, 50.0),
    "chlorophyll": (0.0, 5.0),
    "backscatter": (0.0, 0.1),
    "downwelling_irradiance": (0.0, 1000.0),
}

# Region words in match order; the first one found in a question wins.
REGION_WORDS = [
    "equator", "poles", "tropical", "arctic", "antarctic",
    "indian ocean", "pacific", "atlantic",
]

# Region bounding boxes: (min_lat, max_lat, min_lon, max_lon).
# Regions without an entry (poles, arctic, antarctic) filter nothing.
REGION_BOUNDS = {
    "equator": (-5.0, 5.0, -180.0, 180.0),
    "tropical": (-23.5, 23.5, -180.0, 180.0),
    "indian ocean": (-30.0, 30.0, 20.0, 120.0),
    "pacific": (-60.0, 60.0, 120.0, -60.0),
    "atlantic": (-60.0, 60.0, -80.0, 20.0),
}

MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]

COMPARISON_WORDS = ["compare", "comparison", "vs", "versus", "difference"]
PROFILE_WORDS = ["profile", "profiles", "depth", "vertical"]

# Coordinates after a place word: "near 10.5, 70.25".
LOCATION_PATTERN = r"(near|around|close to|at|in)\s+([\d.-]+)\s*,\s*([\d.-]+)"
YEAR_PATTERN = r"(\d{4})"

POINT_RADIUS_DEG = 1.0      # half side of the box around a question's point
PROFILE_MAX_DEPTH = 1000.0  # depth cap when a profile is asked for
DEFAULT_ROW_LIMIT = 1000    # API row cap
DEFAULT_K = 5               # neighbours returned by a vector search
CONTEXT_NEIGHBOURS = 3      # neighbours quoted in the answer context
SERIES_PROFILES = 10        # profiles drawn in a depth chart
HISTOGRAM_BINS = 30
RECENT_ROWS = 100
RECENT_COLUMNS = [
    "profile_id", "float_id", "timestamp", "latitude", "longitude",
    "depth", "temperature", "salinity",
]
STATUSES = ["active", "inactive", "maintenance"]

# English stop words left out of text vectors (Spark's own list, so that SQL can state it too).
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below to from up down in out on
off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't
mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()
