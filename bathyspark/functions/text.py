"""Text built from columns: float summaries (T1) and answer context (Q5).

Numbers are formatted with ``format_string``; a part whose values are null is
left out (``concat_ws`` skips nulls) instead of failing the whole summary.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's output text) ---------------------
SUMMARY_SEPARATOR = " | "
FLOAT_PREFIX = "ARGO float "
NEIGHBOURS_HEADER = "Relevant ARGO floats:"
PARAMETER_LINE = "- %s: %.2f to %.2f (mean: %.2f)"
FAILURE_PREFIX = "Error processing query: "


def _part(fmt: str, *cols: Column) -> Column:
    ok = None
    for c in cols:
        ok = c.isNotNull() if ok is None else ok & c.isNotNull()
    return F.when(ok, F.format_string(fmt, *cols))


def float_text(prefix: str = "") -> Column:
    """Six float parts, plus four profile-summary parts when present.

    Expects float columns and, optionally, the A1 summary columns
    (total_profiles, depth_min, depth_max, temperature_min, ...).
    """
    c = lambda n: F.col(prefix + n)
    base = [
        F.concat(F.lit(FLOAT_PREFIX), c("float_id")),
        F.concat(F.lit("Platform: "), c("platform_type")),
        F.concat(F.lit("Status: "), c("status")),
        _part("Location: %.2f°N, %.2f°E", c("latitude"), c("longitude")),
        F.concat(F.lit("Deployed: "), F.date_format(c("deployment_date"), "yyyy-MM-dd")),
        F.concat(F.lit("Institution: "), c("institution")),
    ]
    has_summary = c("total_measurements").isNotNull() & (c("total_measurements") > 0)
    extra = [
        F.when(has_summary, F.format_string("Total profiles: %d", c("total_profiles"))),
        F.when(has_summary, _part("Depth range: %.0f-%.0fm", c("depth_min"), c("depth_max"))),
        F.when(has_summary, _part("Temperature range: %.1f-%.1f°C", c("temperature_min"), c("temperature_max"))),
        F.when(has_summary, _part("Salinity range: %.1f-%.1f PSU", c("salinity_min"), c("salinity_max"))),
    ]
    return F.concat_ws(SUMMARY_SEPARATOR, *base, *extra)


def context_text(n_rows: Column, param_lines: Column, lat_min: Column, lat_max: Column,
                 lon_min: Column, lon_max: Column, t_min: Column, t_max: Column,
                 neighbour_lines: Column) -> Column:
    """Q5: the answer context, lines joined by newlines.

    ``param_lines`` and ``neighbour_lines`` are arrays of ready lines.
    """
    has_rows = n_rows > 0
    head = F.when(has_rows, F.format_string("Found %d data points:", n_rows))
    geo = F.when(has_rows, _part("- Geographic range: %.2f°N to %.2f°N, %.2f°E to %.2f°E",
                                 lat_min, lat_max, lon_min, lon_max))
    ts = F.when(has_rows, F.concat(F.lit("- Time range: "), F.date_format(t_min, "yyyy-MM-dd HH:mm:ss"),
                                   F.lit(" to "), F.date_format(t_max, "yyyy-MM-dd HH:mm:ss")))
    lines = F.concat(
        F.array(head), F.when(has_rows, param_lines).otherwise(F.array().cast("array<string>")),
        F.array(geo, ts),
        F.when(F.size(neighbour_lines) > 0, F.concat(F.array(F.lit(NEIGHBOURS_HEADER)), neighbour_lines))
        .otherwise(F.array().cast("array<string>")))
    return F.array_join(lines, "\n")
