"""bathyspark: profiling-float analytics as Spark DataFrame operators.

Data model: a float table (one row per float), a profile-level table (one row
per profile and depth level) and an embedding table (one vector per float).
Every operator is a function from DataFrame(s) to a DataFrame or a Column.
"""

from bathyspark.schemas import FLOAT_COLUMNS, PROFILE_COLUMNS, PARAMETERS  # noqa: F401

__version__ = "0.1.0"
