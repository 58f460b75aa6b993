"""Aggregate expressions shared by the summary operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_mean(col: str | Column) -> Column:
    """Mean over non-nulls as decimal sum / count.

    Values are summed with twelve decimals, which measurements never exceed,
    so the result does not depend on summation order (partition layout,
    engine).  Values that no such decimal holds (1e26 and up, NaN, infinities)
    are summed as doubles beside it; a null mean means no value.
    """
    c = F.col(col) if isinstance(col, str) else col
    return mean_of(F.sum(exact_value(c)), F.sum(far_value(c)), F.count(c))


def exact_value(c: Column) -> Column:
    """The value as a decimal of twelve places, null where it is too large for one."""
    return c.try_cast("decimal(38,12)")


def far_value(c: Column) -> Column:
    """The value where ``exact_value`` is null."""
    return F.when(exact_value(c).isNull(), c.cast("double"))


def mean_of(exact_sum: Column, far_sum: Column, n: Column) -> Column:
    """Mean from the two sums and the count, also of merged partial ones."""
    total = F.coalesce(exact_sum.cast("double"), F.lit(0.0)) + F.coalesce(far_sum, F.lit(0.0))
    return F.when(n > 0, total / n)


def one_row(*frames: DataFrame) -> DataFrame:
    """Combine one-row aggregates with disjoint columns into one row.

    Each frame is padded with typed nulls, the frames are unioned and folded
    with ``max`` (one non-null per column), so no join is planned.
    """
    cols = []
    for f in frames:
        cols += [(c, f.schema[c].dataType) for c in f.columns]
    padded = []
    for f in frames:
        padded.append(f.select([F.col(c) if c in f.columns else F.lit(None).cast(t).alias(c) for c, t in cols]))
    union = padded[0]
    for p in padded[1:]:
        union = union.unionByName(p)
    return union.agg(*[F.max(c).alias(c) for c, _ in cols])
