"""Question answering: parsed question -> filter -> rows -> summaries (Q1-Q10).

Single question: the parse runs in Spark on a one-row frame, the bounds come
back as one row and become literal predicates, so the time bound reaches the
Parquet scan and the lat/lon bounds are evaluated before the join.

Many questions (Q10): questions are reduced to distinct bound signatures;
levels are rolled up to (box, calendar node), where a box is a named region or a
distinct box of the signatures that they meet by 1-degree cells; signatures
meet these in an equi-join, are aggregated with map-side partial
aggregation, and joined back to the questions on the signature key.  No question text is turned into SQL text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from bathyspark.functions.aggs import exact_value, far_value, mean_of
from bathyspark.functions.filters import ntz_literal
from bathyspark.functions.questions import parse_frame
from bathyspark.functions.text import FAILURE_PREFIX, PARAMETER_LINE, context_text
from bathyspark.session import cut_lineage
from bathyspark.schemas import (
    CONTEXT_NEIGHBOURS, POINT_RADIUS_DEG, PROFILE_COLUMNS, PROFILE_MAX_DEPTH, QUESTION_PARAMETERS, REGION_BOUNDS,
)

BOUND_FIELDS = ["lat_lo", "lat_hi", "lon_lo", "lon_hi", "ts_lo", "ts_hi", "depth_hi"] + [
    f"need_{p}" for p in QUESTION_PARAMETERS]


def _region_map(field: int) -> Column:
    kv = []
    for name, bounds in REGION_BOUNDS.items():
        kv += [F.lit(name), F.lit(float(bounds[field]))]
    return F.create_map(*kv)


def bounds_from(loc_ok: Column, lat: Column, lon: Column, region: Column, start: Column, end: Column,
                profile_request: Column, parameters: Column, radius: float = POINT_RADIUS_DEG) -> Column:
    """Q1: typed bounds of a parsed question; a null bound means 'any'.

    A point location wins over a region; a region without a box (poles,
    arctic, antarctic) bounds nothing.
    """
    def pick(loc_value: Column, field: int) -> Column:
        return F.when(loc_ok, loc_value).otherwise(F.element_at(_region_map(field), region))

    fields = [
        pick(lat - F.lit(radius), 0).alias("lat_lo"),
        pick(lat + F.lit(radius), 1).alias("lat_hi"),
        pick(lon - F.lit(radius), 2).alias("lon_lo"),
        pick(lon + F.lit(radius), 3).alias("lon_hi"),
        start.alias("ts_lo"),
        end.alias("ts_hi"),
        F.when(profile_request, F.lit(PROFILE_MAX_DEPTH)).alias("depth_hi"),
    ] + [F.array_contains(parameters, p).alias(f"need_{p}") for p in QUESTION_PARAMETERS]
    return F.struct(*fields)


def question_bounds(parsed: Column, radius: float = POINT_RADIUS_DEG) -> Column:
    """Q1 from a parse struct (for a few rows; tables use ``parse_table``)."""
    loc = parsed["location"]
    return bounds_from(loc.isNotNull(), loc["lat"], loc["lon"], parsed["region"], parsed["time_range"]["start"],
                       parsed["time_range"]["end"], parsed["profile_request"], parsed["parameters"], radius)


def _lon_test(lo, hi, wrap: bool) -> Column:
    lon = F.col("longitude")
    if not wrap:
        return lon.between(lo, hi)
    return F.when(lo <= hi, lon.between(lo, hi)).otherwise((lon >= lo) | (lon <= hi))


def bounds_predicate(b: Row | dict, wrap: bool = False) -> Column:
    """Literal predicate for one question's bounds (pushes down)."""
    b = b.asDict() if isinstance(b, Row) else dict(b)
    conds = [F.col(p).isNotNull() for p in QUESTION_PARAMETERS if b.get(f"need_{p}")]
    if b.get("lat_lo") is not None:
        conds.append(F.col("latitude").between(F.lit(b["lat_lo"]), F.lit(b["lat_hi"])))
        conds.append(_lon_test(F.lit(b["lon_lo"]), F.lit(b["lon_hi"]), wrap) if wrap and b["lon_lo"] > b["lon_hi"]
                     else F.col("longitude").between(F.lit(b["lon_lo"]), F.lit(b["lon_hi"])))
    if b.get("ts_lo") is not None:
        conds.append(F.col("timestamp").between(ntz_literal(b["ts_lo"]), ntz_literal(b["ts_hi"])))
    if b.get("depth_hi") is not None:
        conds.append(F.col("depth") <= F.lit(b["depth_hi"]))
    return reduce(lambda x, y: x & y, conds, F.lit(True))


def parse_one(spark, question: str, current_year: int) -> Row:
    """Parse one question in Spark and return (parsed, bounds) as one row."""
    q = spark.createDataFrame([(question,)], "question string")
    return parse_table(q, current_year).select("p", "b").first()


def row_order(parsed_profile_request: bool, columns: list[str]) -> list[Column]:
    """O4 for a profile request, O5 otherwise, then a total tie-break."""
    ties = [c for c in ["profile_id", "depth", "level_no", "part_no", "supp_no", "ext_price"] if c in columns]
    if parsed_profile_request:
        head = ["float_id", "timestamp", "depth"]
        return [F.col(c).asc() for c in head] + [F.col(c).asc() for c in ties if c not in head]
    return [F.col("timestamp").desc()] + [F.col(c).asc() for c in ties]


def question_rows(profiles: DataFrame, question: str, current_year: int,
                  mode: str = "default", wrap: bool = False) -> DataFrame:
    """Q2: the profile rows answering one question, in the answer's order.

    ``mode='literal'`` returns no rows for a question the literal rules fail on.
    """
    row = parse_one(profiles.sparkSession, question, current_year)
    if mode == "literal" and row["p"]["error"] is not None:
        return profiles.where(F.lit(False)).select(PROFILE_COLUMNS)
    out = profiles.where(bounds_predicate(row["b"], wrap=wrap))
    return out.orderBy(*row_order(bool(row["p"]["profile_request"]), out.columns)).select(PROFILE_COLUMNS)


# ----------------------------------------------------------------- many questions
STAT_PARAMS = QUESTION_PARAMETERS


def parse_table(questions: DataFrame, current_year: int, text_col: str = "question") -> DataFrame:
    """T10 + Q1 over a table of questions: adds struct columns ``p`` and ``b``."""
    return parse_frame(questions, text_col, current_year, "p", bounds=bounds_from, bounds_out="b")


def spread(questions: DataFrame) -> DataFrame:
    """Questions dealt to all cores: parsing a question takes much longer than reading it, and a small file is one task's."""
    return questions.repartition(4 * questions.sparkSession.sparkContext.defaultParallelism, "question_id")


def parse_once(questions: DataFrame, current_year: int) -> DataFrame:
    """``parse_table`` of the questions, on all cores, as a checkpoint in the shared folder: for all that is asked of one set of questions."""
    return cut_lineage(parse_table(spread(questions), current_year))


def _month_key(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts) - 1


FLAG_COLUMNS = ["shallow"] + [f"has_{p}" for p in STAT_PARAMS]


def _partials(value_params: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Names of the partial statistics: (summed, minimised, maximised).

    Counts are kept for every parameter (they say which parameters a result
    has); minima, maxima and sums only for ``value_params``.
    """
    sums = ["n"] + [f"{p}_n" for p in STAT_PARAMS] + [f"{p}_{s}" for p in value_params for s in ("sum", "far")]
    mins = ["lat_min", "lon_min", "t_min"] + [f"{p}_min" for p in value_params]
    maxs = ["lat_max", "lon_max", "t_max"] + [f"{p}_max" for p in value_params]
    return sums, mins, maxs


def _merge_partials(value_params: list[str]) -> list[Column]:
    sums, mins, maxs = _partials(value_params)
    return ([F.sum(c).alias(c) for c in sums] + [F.min(c).alias(c) for c in mins]
            + [F.max(c).alias(c) for c in maxs])


def level_groups(profiles: DataFrame, value_params: list[str] | None = None) -> DataFrame:
    """Levels pre-aggregated on every column a question can filter on.

    Key: (latitude, longitude, timestamp, shallow, has_<param>...) where
    ``shallow`` is ``depth <= PROFILE_MAX_DEPTH``.  Values are partial
    statistics (counts, minima, maxima, decimal sums), which merge exactly,
    so statistics over matched groups equal statistics over matched levels.
    Levels of one profile share place and time, so each profile collapses
    to a few rows before the shuffle.
    """
    value_params = STAT_PARAMS if value_params is None else value_params
    keys = [F.col("latitude"), F.col("longitude"), F.col("timestamp"),
            F.coalesce(F.col("depth") <= F.lit(PROFILE_MAX_DEPTH), F.lit(False)).alias("shallow")] + [
        F.col(p).isNotNull().alias(f"has_{p}") for p in STAT_PARAMS]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.count(p).alias(f"{p}_n") for p in STAT_PARAMS]
    for p in value_params:
        aggs += [F.min(p).alias(f"{p}_min"), F.max(p).alias(f"{p}_max"),
                 F.sum(exact_value(F.col(p))).alias(f"{p}_sum"), F.sum(far_value(F.col(p))).alias(f"{p}_far")]
    g = profiles.groupBy(*keys).agg(*aggs)
    return g.select("*", F.col("latitude").alias("lat_min"), F.col("latitude").alias("lat_max"),
                    F.col("longitude").alias("lon_min"), F.col("longitude").alias("lon_max"),
                    F.col("timestamp").alias("t_min"), F.col("timestamp").alias("t_max"))


def level_partials(levels: DataFrame, value_params: list[str] | None = None) -> DataFrame:
    """Each level as the partial statistics of itself, beside its own columns: nothing is shuffled before a roll-up."""
    value_params = STAT_PARAMS if value_params is None else value_params
    flags = [F.coalesce(F.col("depth") <= F.lit(PROFILE_MAX_DEPTH), F.lit(False)).alias("shallow")] + [F.col(p).isNotNull().alias(f"has_{p}") for p in STAT_PARAMS]
    values = [F.lit(1).cast("long").alias("n")] + [F.col(p).isNotNull().cast("long").alias(f"{p}_n") for p in STAT_PARAMS]
    for p in value_params:
        values += [F.col(p).alias(f"{p}_min"), F.col(p).alias(f"{p}_max"), exact_value(F.col(p)).alias(f"{p}_sum"), far_value(F.col(p)).alias(f"{p}_far")]
    ends = [F.col(c).alias(f"{short}_{end}") for c, short in (("latitude", "lat"), ("longitude", "lon"), ("timestamp", "t")) for end in ("min", "max")]
    return levels.select("*", *flags, *values, *ends)


def _flag_condition(b: str) -> Column:
    c = lambda name: F.col(f"{b}.{name}")
    conds = [(~c(f"need_{p}")) | F.col(f"has_{p}") for p in STAT_PARAMS]
    conds.append(c("depth_hi").isNull() | F.col("shallow"))
    return reduce(lambda x, y: x & y, conds)


def _group_condition(b: str, wrap: bool) -> Column:
    """Group-vs-bounds predicate; null bounds mean 'any'."""
    c = lambda name: F.col(f"{b}.{name}")
    return (_flag_condition(b)
            & (c("lat_lo").isNull() | F.col("latitude").between(c("lat_lo"), c("lat_hi")))
            & (c("lon_lo").isNull() | _lon_test(c("lon_lo"), c("lon_hi"), wrap))
            & (c("ts_lo").isNull() | F.col("timestamp").between(c("ts_lo"), c("ts_hi"))))


CELL_DEG = 1.0


REGION_BOXES = [tuple(map(float, b)) for b in REGION_BOUNDS.values()]
ANYWHERE = -1


def _box_of() -> Column:
    """What box a signature has: the number of a named region, ANYWHERE without bounds, null for any other box."""
    out = F.when(F.col("lat_lo").isNull(), F.lit(ANYWHERE))
    for i, bounds in enumerate(REGION_BOXES):
        same = [F.col(c) == F.lit(v) for c, v in zip(BOUND_FIELDS, bounds)]
        out = out.when(reduce(lambda x, y: x & y, same), F.lit(i))
    return out


def _cell(value: Column) -> Column:
    """Cell of a latitude or longitude; values far outside the globe share the outermost cells, so no cast overflows."""
    return F.floor(F.greatest(F.lit(-400.0), F.least(F.lit(400.0), value)) / CELL_DEG).cast("int")


# ----------------------------------------------------------------- calendar nodes
ALL_TIME, YEAR, MONTH, DAY, MIDNIGHT = range(5)


def _node(kind: int, number: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), number.cast("int").alias("number"))


def _is_midnight(ts: Column) -> Column:
    return ts == F.date_trunc("day", ts).cast("timestamp_ntz")


def calendar_nodes(daily: DataFrame, value_params: list[str]) -> DataFrame:
    """Partial statistics per (flags, box, node) from those per (flags, box, day, midnight).

    Nodes are all time, a year, a month, a day, and the midnight that begins a
    day (ranges end at the midnight of their last day).  A day adds to five at most.
    """
    day = F.col("day")
    nodes = F.array_compact(F.array(
        _node(ALL_TIME, F.lit(0)), F.when(day.isNotNull(), _node(YEAR, F.year(day))), F.when(day.isNotNull(), _node(MONTH, _month_key(day))),
        F.when(day.isNotNull(), _node(DAY, F.unix_date(day))), F.when(F.col("midnight"), _node(MIDNIGHT, F.unix_date(day)))))
    return (daily.withColumn("node", F.explode(nodes)).groupBy(*FLAG_COLUMNS, "box", F.col("node.kind").alias("kind"), F.col("node.number").alias("number"))
            .agg(*_merge_partials(value_params)))


def _numbers(kind: int, first: Column, end: Column) -> Column:
    """Nodes ``first`` up to, without, ``end``."""
    some = F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(some, lambda n: _node(kind, n))


def calendar_cover(lo: Column, hi: Column) -> Column:
    """The nodes whose union is the range of timestamps [lo, hi] between two midnights: years, then months, then days, then a midnight.

    Two ends of at most 30 days and 11 months beside the years between.
    """
    day = lambda ts: F.unix_date(ts.cast("date"))
    first_day = lambda month: F.unix_date(F.make_date(F.floor(month / 12).cast("int"), F.pmod(month, F.lit(12)) + 1, F.lit(1)))
    m1 = F.when(F.dayofmonth(lo) == 1, _month_key(lo)).otherwise(_month_key(lo) + 1)
    m2 = _month_key(hi)
    y1, y2 = F.ceil(m1 / 12).cast("int"), F.floor(m2 / 12).cast("int")
    months = F.when(y1 < y2, F.concat(_numbers(YEAR, y1, y2), _numbers(MONTH, m1, y1 * 12), _numbers(MONTH, y2 * 12, m2))).otherwise(_numbers(MONTH, m1, m2))
    whole = F.when(m1 < m2, F.concat(months, _numbers(DAY, day(lo), first_day(m1)), _numbers(DAY, first_day(m2), day(hi)))).otherwise(
        _numbers(DAY, day(lo), day(hi)))
    return F.concat(whole, F.array(_node(MIDNIGHT, day(hi))))


BROADCAST_CELLS = 100_000  # cells of boxes, each a short row, that are broadcast


def _box_name() -> Column:
    """A signature's box as text: its number, or its bounds."""
    return F.coalesce(_box_of().cast("string"), F.concat_ws(",", *BOUND_FIELDS[:4]))


def _daily_regions(groups: DataFrame, wrap: bool, value_params: list[str]) -> DataFrame:
    """Partial statistics per (flags, box, day, midnight) of the named regions and of anywhere.

    Rows are merged once, by the set of regions that they lie in.
    """
    lat, lon, ts = F.col("latitude"), F.col("longitude"), F.col("timestamp")
    inside = [F.coalesce(lat.between(F.lit(la0), F.lit(la1)) & _lon_test(F.lit(lo0), F.lit(lo1), wrap), F.lit(False)) for la0, la1, lo0, lo1 in REGION_BOXES]
    regions = reduce(lambda x, y: x + y, [F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(inside)])
    daily = (groups.groupBy(*FLAG_COLUMNS, regions.alias("regions"), ts.cast("date").alias("day"), F.coalesce(_is_midnight(ts), F.lit(False)).alias("midnight"))
             .agg(*_merge_partials(value_params)))
    boxes = [F.when(F.col("regions").bitwiseAND(F.lit(1 << i)) != 0, F.lit(str(i))) for i in range(len(REGION_BOXES))]
    return daily.withColumn("box", F.explode(F.array_compact(F.array(F.lit(str(ANYWHERE)), *boxes)))).drop("regions")


def _box_cells(sigs: DataFrame) -> DataFrame:
    """The 1-degree cells that each distinct other box of the signatures touches."""
    span = lambda a, b: F.when(F.col(a) <= F.col(b), F.sequence(_cell(F.col(a)), _cell(F.col(b))))
    return (sigs.where(_box_of().isNull()).select(_box_name().alias("box"), *BOUND_FIELDS[:4]).distinct()
            .withColumn("cell_lat", F.explode(span("lat_lo", "lat_hi"))).withColumn("cell_lon", F.explode(span("lon_lo", "lon_hi"))))


def _daily_boxes(groups: DataFrame, cells: DataFrame, wrap: bool, value_params: list[str], partials: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Partial statistics per (flags, box, day, midnight) of the boxes with these cells: each row meets a box once, however many signatures have it."""
    ts, nowhere = F.col("timestamp"), F.lit(-9999)
    placed = groups.withColumns({"cell_lat": F.coalesce(_cell(F.col("latitude")), nowhere), "cell_lon": F.coalesce(_cell(F.col("longitude")), nowhere)})
    inside = F.col("latitude").between(F.col("lat_lo"), F.col("lat_hi")) & _lon_test(F.col("lon_lo"), F.col("lon_hi"), wrap)
    # no null test is inferred from this condition, so that the levels are read as for the regions, once for both
    met = placed.join(cells, ["cell_lat", "cell_lon"]).where(F.coalesce(inside, F.lit(False))).drop("cell_lat", "cell_lon", *BOUND_FIELDS[:4])
    met = met.repartition(F.xxhash64(*met.columns))  # the few rows that lie in a box, dealt evenly; joined and summed in one stage they took four times as long
    return (partials(met).groupBy(*FLAG_COLUMNS, "box", ts.cast("date").alias("day"), F.coalesce(_is_midnight(ts), F.lit(False)).alias("midnight"))
            .agg(*_merge_partials(value_params)))


def _by_calendar(groups: DataFrame, sigs: DataFrame, wrap: bool, value_params: list[str], partials: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Signatures between midnights or at any time: equi-joins on (box, calendar node).

    Named regions and anywhere are a fixed number of boxes.  Of other boxes the
    distinct ones meet the rows of their cells.
    """
    daily = _daily_regions(partials(groups), wrap, value_params)
    cells = _box_cells(sigs)
    if n_cells := cells.count():
        daily = daily.unionByName(_daily_boxes(groups, F.broadcast(cells) if n_cells <= BROADCAST_CELLS else cells, wrap, value_params, partials))
    nodes = calendar_nodes(daily, value_params)
    cover = F.when(F.col("ts_lo").isNull(), F.array(_node(ALL_TIME, F.lit(0)))).when(F.col("ts_lo") <= F.col("ts_hi"), calendar_cover(F.col("ts_lo"), F.col("ts_hi")))
    asked = sigs.withColumn("b_box", _box_name()).withColumn("b_node", F.explode(cover))
    return nodes.join(asked.alias("b"), (F.col("box") == F.col("b.b_box")) & (F.col("kind") == F.col("b.b_node.kind"))
                      & (F.col("number") == F.col("b.b_node.number")) & _flag_condition("b"))


def _by_probe(groups: DataFrame, sigs: DataFrame, wrap: bool) -> DataFrame:
    """Signatures of a time with an end between midnights, on the groups themselves.

    One with a narrow box meets the groups of its months in the 1-degree cells that
    the box touches; one of a region meets those of its months.
    """
    lo, hi = F.col("ts_lo"), F.col("ts_hi")
    months = F.when(lo.isNull(), F.array(F.lit(None).cast("int"))).when(lo <= hi, F.sequence(_month_key(lo), _month_key(hi)))
    span = lambda a, b: F.when(F.col(a) <= F.col(b), F.sequence(_cell(F.col(a)), _cell(F.col(b))))
    narrow = _box_of().isNull()
    asked = (sigs.withColumn("b_month", F.explode(months))
             .withColumn("b_lat", F.explode(F.when(narrow, span("lat_lo", "lat_hi")).otherwise(F.array(F.lit(None).cast("int")))))
             .withColumn("b_lon", F.explode(F.when(narrow, span("lon_lo", "lon_hi")).otherwise(F.array(F.lit(None).cast("int"))))))
    key = lambda *parts: F.concat_ws(",", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    month, lat, lon, none = _month_key(F.col("timestamp")), _cell(F.col("latitude")), _cell(F.col("longitude")), F.lit(None).cast("int")
    probes = groups.withColumn("probe", F.explode(F.array_distinct(F.array(key(none, lat, lon), key(month, lat, lon), key(month, none, none)))))
    return probes.join(asked.withColumn("b_probe", key(F.col("b_month"), F.col("b_lat"), F.col("b_lon"))).alias("b"),
                       (F.col("probe") == F.col("b.b_probe")) & _group_condition("b", wrap))


def _match(groups: DataFrame, sigs: DataFrame, wrap: bool, value_params: list[str], partials: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Partial statistics matched to each signature; every (group, signature) pair is counted once.

    Signatures between midnights or at any time, which is all that questions
    ask, meet statistics rolled up to boxes and calendar nodes; others meet the groups
    of their cells and months.  ``partials`` makes the partial statistics of rows
    that have none yet, after the joins that drop rows.
    """
    rolled = F.coalesce(F.col("ts_lo").isNull() | (_is_midnight(F.col("ts_lo")) & _is_midnight(F.col("ts_hi"))), F.lit(False))
    keep = [F.col(f"b.{c}").alias(c) for c in BOUND_FIELDS] + [F.col(c) for part in _partials(value_params) for c in part]
    met = _by_calendar(groups, sigs.where(rolled), wrap, value_params, partials).select(keep)
    others = sigs.where(~rolled)
    return met if others.isEmpty() else met.unionByName(_by_probe(partials(groups), others, wrap).select(keep))


def _signature_stats(value_params: list[str]) -> list[Column]:
    aggs = [F.sum("n").alias("total_records"),
            F.min("lat_min").alias("min_lat"), F.max("lat_max").alias("max_lat"),
            F.min("lon_min").alias("min_lon"), F.max("lon_max").alias("max_lon"),
            F.min("t_min").alias("time_min"), F.max("t_max").alias("time_max")]
    for p in STAT_PARAMS:
        aggs.append(F.sum(f"{p}_n").alias(f"{p}_n"))
        if p in value_params:
            aggs += [F.min(f"{p}_min").alias(f"{p}_min"), F.max(f"{p}_max").alias(f"{p}_max"),
                     mean_of(F.sum(f"{p}_sum"), F.sum(f"{p}_far"), F.sum(f"{p}_n")).alias(f"{p}_mean")]
        else:  # not asked by any question: statistics left empty
            aggs += [F.lit(None).cast("double").alias(f"{p}_{s}") for s in ("min", "max", "mean")]
    return aggs


def signature_stats(profiles: DataFrame, parsed: DataFrame, wrap: bool = False, value_params: list[str] | None = None) -> DataFrame:
    """Per distinct bound signature: matched-row statistics (Q10 core).

    Values are summarised for ``value_params`` (default: every parameter),
    whatever the questions ask and however many there are.  Signatures are
    computed once, as a checkpoint in the shared folder; levels are rolled up as
    they are read.  The depth bound is either absent or the fixed profile cap.
    """
    value_params = list(STAT_PARAMS) if value_params is None else value_params
    sigs = cut_lineage(parsed.select("b.*").distinct())
    levels = profiles.select("latitude", "longitude", "timestamp", "depth", *STAT_PARAMS)
    return _match(levels, sigs, wrap, value_params, lambda rows: level_partials(rows, value_params)).groupBy(*BOUND_FIELDS).agg(*_signature_stats(value_params))


def question_batch(profiles: DataFrame, questions: DataFrame, current_year: int, mode: str = "default",
                   wrap: bool = False, parsed: DataFrame | None = None) -> DataFrame:
    """Q10: every question answered against the levels in one plan.

    ``parsed`` is what ``parse_once`` made of the questions, if that is there already.
    Output: the question columns, ``p`` (parse), ``b`` (bounds) and the
    statistics of its rows (``total_records`` is 0 when nothing matched).
    In literal mode a question the literal rules fail on gets no statistics.
    """
    parsed = parse_once(questions, current_year) if parsed is None else parsed
    stats = signature_stats(profiles, parsed, wrap)
    flat = parsed.select("*", *[F.col(f"b.{c}").alias(f"_k_{c}") for c in BOUND_FIELDS])
    on = [F.col(f"_k_{c}").eqNullSafe(F.col(f"s.{c}")) for c in BOUND_FIELDS]
    j = flat.join(stats.alias("s"), reduce(lambda a, b: a & b, on), "left")
    stat_cols = [c for c in stats.columns if c not in BOUND_FIELDS]
    failed = F.lit(mode == "literal") & F.col("p.error").isNotNull()
    out = [F.col(c) for c in questions.columns] + [F.col("p"), F.col("b")]
    for c in stat_cols:
        v = F.col(f"s.{c}")
        if c == "total_records" or c.endswith("_n"):
            out.append(F.when(failed, F.lit(0).cast("long")).otherwise(F.coalesce(v, F.lit(0).cast("long"))).alias(c))
        else:
            out.append(F.when(~failed, v).alias(c))
    out.append(failed.alias("failed"))
    return j.select(out)


def _parameters_found() -> Column:
    return F.filter(F.array(*[F.when(F.col(f"{p}_n") > 0, F.lit(p)) for p in STAT_PARAMS]), lambda x: x.isNotNull())


def answer_summary(batch: DataFrame) -> DataFrame:
    """Q4: count, parameters found (an array), bounds (null when nothing matched)."""
    has = F.col("total_records") > 0
    return batch.select(
        "question_id", "total_records", _parameters_found().alias("parameters_found"),
        *[F.when(has, F.col(c)).alias(c) for c in ["min_lat", "max_lat", "min_lon", "max_lon"]])


NEIGHBOUR_INTENTS = ["general_query", "location_query"]


def question_neighbours(index: DataFrame, model, parsed: DataFrame, k: int = 5) -> DataFrame:
    """Q3: the k nearest floats for general and location questions only."""
    from bathyspark.operators.index import search_index
    asked = parsed.where(F.col("p.intent").isin(NEIGHBOUR_INTENTS)).select("question_id", "question")
    return search_index(index, model, asked, "question_id", "question", k)


def _with_neighbours(batch: DataFrame, neighbours: DataFrame | None) -> DataFrame:
    """The batch with its neighbours as an array by rank (``nb``, at most k a question; empty without any)."""
    if neighbours is None:
        return batch.withColumn("nb", F.array())
    nb = neighbours.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "float_id", "distance", "text_summary", "metadata"))).alias("nb"))
    return batch.join(nb, "question_id", "left").withColumn("nb", F.coalesce("nb", F.array()))


def _context(neighbours: bool, n_quoted: int) -> Column:
    """Q5 (+ O8): the context text of a batch row with its ``nb``."""
    stats = F.create_map(*[x for p in STAT_PARAMS for x in (
        F.lit(p), F.struct(F.col(f"{p}_n").alias("n"), F.col(f"{p}_min").alias("lo"),
                           F.col(f"{p}_max").alias("hi"), F.col(f"{p}_mean").alias("mean")))])
    named = F.filter(F.transform(F.col("p.parameters"), lambda name: F.when(
        F.element_at(stats, name)["n"] > 0,
        F.format_string(PARAMETER_LINE, name, F.element_at(stats, name)["lo"],
                        F.element_at(stats, name)["hi"], F.element_at(stats, name)["mean"]))),
        lambda x: x.isNotNull())
    lines = F.array().cast("array<string>")
    if neighbours:
        lines = F.transform(F.filter("nb", lambda x: x["rank"] <= n_quoted), lambda x: F.concat(
            F.lit("- "), x["float_id"], F.lit(": "), x["text_summary"]))
    return context_text(F.col("total_records"), named, F.col("min_lat"), F.col("max_lat"), F.col("min_lon"),
                        F.col("max_lon"), F.col("time_min"), F.col("time_max"), lines)


def answer_context(batch: DataFrame, neighbours: DataFrame | None = None, n_quoted: int = CONTEXT_NEIGHBOURS) -> DataFrame:
    """Q5 (+ O8): context text per question from its statistics and neighbours."""
    return _with_neighbours(batch, neighbours).select(
        "question_id", "question", "total_records", _context(neighbours is not None, n_quoted).alias("context"))


def answer_records(batch: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """Q7: query, response, data summary and neighbours per question, in one pass over the batch.

    The matching rows stay a DataFrame keyed by question (``question_rows``
    for one question); they are not gathered into the record.  A failed
    question (literal mode) gets the failure record of Q6; an answer without
    rows has no parameters and null bounds.
    """
    ok = ~F.col("failed")
    return _with_neighbours(batch, neighbours).select(
        "question_id", F.col("question").alias("query"),
        F.when(ok, _context(neighbours is not None, CONTEXT_NEIGHBOURS))
        .otherwise(F.concat(F.lit(FAILURE_PREFIX), F.col("p.error"))).alias("response"),
        F.struct(F.col("total_records"),
                 F.when(ok, _parameters_found()).otherwise(F.array().cast("array<string>")).alias("parameters_found"),
                 F.when((F.col("total_records") > 0) & ok, F.struct("min_lat", "max_lat", "min_lon", "max_lon"))
                 .alias("geographic_bounds")).alias("data_summary"),
        F.when(ok, F.col("nb")).otherwise(F.array()).alias("vector_results"))
