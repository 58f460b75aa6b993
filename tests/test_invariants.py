"""Invariants and edge cases on small literal frames and the smallest tables."""

import datetime as dt
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from bathyspark.functions import filters as P
from bathyspark.operators import ingest as I
from bathyspark.operators import shape as SH
from bathyspark.operators import stats as A
from bathyspark.operators import vectors as V
from bathyspark.schemas import PROFILE_COLUMNS, PROFILES
from bathyspark.sources import bindings as B
from tests.conftest import SF_SMALL


def _levels(spark, rows):
    base = dict(profile_id="P1", float_id="F1", timestamp=dt.datetime(2020, 1, 1), latitude=0.0, longitude=0.0,
                depth=0.0, temperature=None, salinity=None, pressure=None, oxygen=None, nitrate=None,
                chlorophyll=None, backscatter=None, downwelling_irradiance=None)
    return spark.createDataFrame([{**base, **r} for r in rows], PROFILES)


def test_dedupe_is_idempotent(spark):
    lv = B.profile_levels(spark, SF_SMALL)
    stored = lv.where(F.col("level_no") <= 3)
    order = ["level_no", "part_no", "supp_no", "ext_price"]
    new = I.new_levels(stored, lv, order=order)
    again = I.new_levels(stored.unionByName(new), lv, order=order)
    assert new.count() > 0 and again.count() == 0


def test_first_row_in_input_order_wins(spark):
    batch = _levels(spark, [dict(depth=10.0, temperature=1.0), dict(depth=10.0, temperature=2.0)])
    batch = batch.withColumn("seq", F.when(F.col("temperature") == 2.0, 0).otherwise(1))
    out = I.new_levels(batch.limit(0), batch, order=["seq"]).collect()
    assert len(out) == 1 and out[0].temperature == 2.0


def test_float_batch_rejected_whole(spark):
    f = B.floats(spark, SF_SMALL)
    res = I.append_floats(f.limit(10), f.limit(20))
    assert not res.accepted and res.table.count() == 10
    ok = I.append_floats(f.limit(0), f)
    assert ok.accepted and ok.table.count() == f.count()


def test_append_levels_twice_adds_nothing(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="lv-"), "levels")
    lv = B.profiles(spark, SF_SMALL)
    n1 = I.append_levels(path, lv)
    n2 = I.append_levels(path, lv)
    assert n1 == lv.select("profile_id", "depth").distinct().count() and n2 == 0


def test_streaming_ingest(spark):
    from bathyspark.streaming.ingest_stream import start_level_ingest
    root = tempfile.mkdtemp(prefix="stream-")
    landing, table, ckpt = (os.path.join(root, x) for x in ("landing", "table", "ckpt"))
    lv = B.profiles(spark, SF_SMALL)
    lv.where(F.col("timestamp") < F.lit("1997-01-01").cast("timestamp_ntz")).write.parquet(landing + "/a")
    lv.write.parquet(landing + "/b")  # overlaps the first file completely
    q = start_level_ingest(spark, landing + "/*", table, ckpt, available_now=True)
    q.awaitTermination(300)
    got = spark.read.parquet(table)
    assert got.count() == lv.select("profile_id", "depth").distinct().count()


def test_flatten_after_nest_is_identity(spark):
    lv = B.profiles(spark, SF_SMALL)
    back = SH.flatten_profiles(SH.nest_profiles(lv)).select(PROFILE_COLUMNS)
    assert back.exceptAll(lv).count() == 0 and lv.exceptAll(back).count() == 0


def test_flatten_missing_parameter_is_null(spark):
    nested = spark.createDataFrame(
        [("P", "F", dt.datetime(2020, 1, 1), 1.0, 2.0, [0.0, 10.0], {"temperature": [5.0]})],
        "profile_id string, float_id string, timestamp timestamp_ntz, latitude double, longitude double, "
        "depths array<double>, parameters map<string, array<double>>")
    rows = SH.flatten_profiles(nested).orderBy("depth").collect()
    assert [r.temperature for r in rows] == [5.0, None] and rows[0].salinity is None


def test_histogram_counts_sum_to_non_nulls(spark):
    lv = B.profiles(spark, SF_SMALL)
    h = A.histogram(lv, "temperature")
    assert h.agg(F.sum("n")).first()[0] == lv.where(F.col("temperature").isNotNull()).count()
    assert h.agg(F.max("bin")).first()[0] <= 29


def test_clip_keeps_nulls_and_clips(spark):
    df = _levels(spark, [dict(temperature=40.0, salinity=None, oxygen=-3.0)])
    r = SH.clip_ranges(df).first()
    assert (r.temperature, r.salinity, r.oxygen) == (30.0, None, 0.0)


def test_pacific_literal_empty_and_wrap(spark):
    df = _levels(spark, [dict(latitude=0.0, longitude=150.0), dict(latitude=0.0, longitude=-70.0),
                         dict(latitude=0.0, longitude=0.0)])
    assert df.where(P.region_box("pacific")).count() == 0
    assert df.where(P.region_box("pacific", wrap=True)).count() == 2


def test_date_forms(spark):
    df = _levels(spark, [dict(timestamp=dt.datetime(2020, 1, 31, 12)), dict(timestamp=dt.datetime(2020, 1, 31))])
    assert df.where(P.timestamp_between("2020-01-01", "2020-01-31")).count() == 1
    assert df.where(P.date_between_inclusive("2020-01-01", "2020-01-31")).count() == 2


def test_summary_of_empty_is_empty(spark):
    df = _levels(spark, [dict(depth=1.0)]).limit(0)
    assert A.profile_summary(df).count() == 0


def test_knn_self_is_nearest_and_small_corpus(spark):
    e = B.table(spark, SF_SMALL, "embeddings")
    hits = V.knn_l2(e, e, 3, query_id="vec_id", corpus_id="vec_id")
    first = hits.where(F.col("rank") == 1)
    assert first.where(F.col("query_id") == F.col("neighbour_id")).count() == e.count()
    assert first.agg(F.max("distance")).first()[0] == 0.0
    small = e.limit(2)
    assert V.knn_l2(e.limit(4), small, 5, query_id="vec_id", corpus_id="vec_id").count() == 8
    empty = V.knn_l2(e.limit(4), e.limit(0), 5, query_id="vec_id", corpus_id="vec_id")
    assert empty.count() == 0


def test_knn_blocks_equal_single_block(spark):
    e = B.table(spark, SF_SMALL, "embeddings")
    one = V.knn_l2(e, e, 5, query_id="vec_id", corpus_id="vec_id")
    many = V.knn_l2(e, e, 5, query_id="vec_id", corpus_id="vec_id", block_bytes=64 * 8 * 40)
    assert one.exceptAll(many).count() == 0 and many.count() == one.count()


def test_knn_pivots_skip_blocks(spark):
    """Clustered vectors: the triangle inequality leaves most blocks unread, and the result is that of one block."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 20
    x = np.concatenate([c + rng.normal(size=(60, 8)) for c in centres] + [np.tile(centres[:1], (50, 1))])
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    options = dict(query_id="id", corpus_id="id")
    one, many = (V.knn_l2(e, e, 5, block_bytes=size, **options) for size in (1 << 20, 8 * 8 * 25))
    assert one.exceptAll(many).count() == 0 and many.count() == one.count() == 5 * len(x)
    _, pairs, parts = V._near_rows(e, e, 5, "id", "embedding", "id", "embedding", 8 * 8 * 25, None)
    blocks = sum(map(len, parts.rings))
    assert blocks >= 20 and pairs.count() < 0.35 * blocks * len(x)
    few = V.knn_l2(e, e.limit(3), 5, block_bytes=64, **options)
    assert few.count() == 3 * len(x)


def test_sparse_top_k_equals_dense_search(spark):
    """Inverted lists with bounds: equal to the exact search, for empty vectors, ties and queries that share no term."""
    rng = np.random.default_rng(8)

    def vector(terms):
        w = rng.random(len(terms)) + .1
        return (sorted(int(t) for t in terms), (w / np.sqrt((w * w).sum())).tolist())

    groups = [rng.choice(60, 6, replace=False) for _ in range(15)]
    docs = [vector(rng.choice(groups[i % 15], int(rng.integers(1, 6)), replace=False)) for i in range(900)] + [([], [])] * 3 + [([59], [1.0])] * 20
    asked = [vector(rng.choice(60, int(rng.integers(1, 5)), replace=False)) for _ in range(60)] * 2 + [([], [])] * 2 + [([70], [1.0])]
    kind = "id string, embedding struct<indices: array<int>, values: array<double>>"
    corpus = spark.createDataFrame([(f"d{i:04}", v) for i, v in enumerate(docs)] + [(None, ([1], [1.0]))], kind)
    queries = spark.createDataFrame([(f"q{i:03}", v) for i, v in enumerate(asked)] + [(None, ([1], [1.0]))], kind)
    options = dict(query_id="id", corpus_id="id")
    want = V.knn_l2(queries, corpus, 7, dim=80, **options)
    got = V.knn_sparse(queries, corpus, 7, block_docs=16, **options)
    assert got.count() == want.count() == 7 * len(asked) and got.exceptAll(want).count() == 0
    assert V.knn_sparse(queries, corpus, 2000, **options).exceptAll(V.knn_l2(queries, corpus, 2000, dim=80, **options)).count() == 0
    assert V.knn_sparse(queries, corpus.where("false"), 7, **options).count() == 0
    assert V.knn_sparse(queries.where("false"), corpus, 7, **options).count() == 0


def test_additions_to_the_index_are_idempotent(spark, tmp_path):
    from bathyspark.operators import index as X
    floats, levels, path = B.floats(spark, SF_SMALL), B.profiles(spark, SF_SMALL), str(tmp_path / "index")
    old, new = floats.where("float_id < 'F_000100'"), floats.where("float_id >= 'F_000095'").withColumn("status", F.lit("changed"))
    idx, model = X.build_index(old, levels)
    X.save_index(idx, path, model)
    for _ in range(2):  # the second run stands for a retry
        X.add_to_index(spark, path, new, levels, 1)
        got = X.load_index(spark, path)
        assert got.count() == floats.count() and got.where("metadata.status = 'changed'").count() == new.count()
    held = X.load_model(spark, path)
    assert held.vocab.exceptAll(model.vocab).count() == 0 and held.max_features == model.max_features
    X.compact_index(spark, path, str(tmp_path / "compact"))
    again = X.load_index(spark, str(tmp_path / "compact"))
    assert again.select("float_id", "text_summary", "embedding").exceptAll(got.select("float_id", "text_summary", "embedding")).count() == 0


def test_grid_radius_join_equals_brute_force(spark):
    f = B.floats(spark, SF_SMALL)
    from bathyspark.operators.geo import floats_near_batch
    pts = f.select(F.col("float_id").alias("point_id"), F.col("latitude").alias("lat"),
                   F.col("longitude").alias("lon"))
    got = floats_near_batch(pts, f, 5.0)
    a, b = f.alias("a"), f.alias("b")
    d = F.sqrt((F.col("a.latitude") - F.col("b.latitude")) ** 2 + (F.col("a.longitude") - F.col("b.longitude")) ** 2)
    brute = a.crossJoin(b).where(d <= 5.0).select(F.col("a.float_id").alias("point_id"),
                                                  F.col("b.float_id").alias("float_id"))
    assert got.select("point_id", "float_id").exceptAll(brute).count() == 0
    assert brute.exceptAll(got.select("point_id", "float_id")).count() == 0


def test_grid_radius_join_keeps_distances_rounded_to_the_radius(spark):
    from bathyspark.operators.geo import floats_near_batch
    below = 1.9999999999999998  # 4.0 - below is 2.0 in double precision, though they are more than a cell apart
    pts = spark.createDataFrame([("P1", below, 0.0), ("P2", 0.0, below), ("P3", -4.0, 0.0)], "point_id string, lat double, lon double")
    f = spark.createDataFrame([("F1", 4.0, 0.0), ("F2", 0.0, 4.0), ("F3", -below, 0.0), ("F4", 0.0, -4.0)],
                              "float_id string, latitude double, longitude double")
    d = F.sqrt((F.col("lat") - F.col("latitude")) ** 2 + (F.col("lon") - F.col("longitude")) ** 2)
    brute = {(x.point_id, x.float_id) for x in pts.crossJoin(f).where(d <= 2.0).collect()}
    got = floats_near_batch(pts, f, 2.0).select("point_id", "float_id").collect()
    assert len(got) == len(brute) and {tuple(x) for x in got} == brute >= {("P1", "F1"), ("P2", "F2"), ("P3", "F3")}


def test_crowded_cell_is_many_bounded_blocks(spark):
    """40 floats in one place, a null, a NaN and an infinite coordinate; blocks of at most 3 rows."""
    from bathyspark.operators import geo
    spots = [(f"F{i:02d}", 0.5 + i % 4 / 8, 0.5) for i in range(40)] + [("F90", 3.0, 0.5), ("F91", -1.2, 0.1)]
    odd = [("F95", None, 0.5), ("F96", float("nan"), 0.5), ("F97", 0.5, float("inf"))]
    f = spark.createDataFrame(spots + odd, "float_id string, latitude double, longitude double")
    pts = f.select(F.col("float_id").alias("point_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    cells = geo._cells(f, "latitude", "longitude", 1.0, "fi", "fj")
    blocks = geo._blocks(cells, "fi", "fj", "f_block", "fs", ["longitude", "latitude", "float_id"], 3)
    held = [(x.fi, x.fj, x.f_block, len(x.fs)) for x in blocks.collect()]
    assert max(x[3] for x in held) == 3 and sum(x[3] for x in held) == 42
    numbers = [tuple(x) for x in geo._block_numbers(cells, "fi", "fj", "f_block", 3).collect()]
    assert sorted(numbers) == sorted(x[:3] for x in held)
    want = sorted((a, b, ((c - e) ** 2 + (d - g) ** 2) ** 0.5) for a, c, d in spots for b, e, g in spots
                  if ((c - e) ** 2 + (d - g) ** 2) ** 0.5 <= 2.0)
    assert sorted(tuple(x) for x in geo.floats_near_batch(pts, f, 2.0, block_rows=3).collect()) == want


def test_crowded_radius_join_shuffles_rows_by_their_number(spark):
    """Rows in one place, and four and sixteen times as many: each is copied as often, however many pairs it is in."""
    from bathyspark.operators import geo
    copies = []
    for n in (500, 2000, 8000):
        f = spark.range(n).select(F.format_string("F%05d", "id").alias("float_id"), (F.col("id") % 97 / 97).alias("latitude"),
                                  (F.col("id") % 89 / 89).alias("longitude"))
        pts = f.select(F.col("float_id").alias("point_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
        ps, fs = geo._sides(pts, f, 2.0, 16, 8)
        rows = [side.select(F.sum(F.size(c)), F.count_distinct(*geo.PART), F.max(F.size(c))).first() for side, c in ((ps, "ps"), (fs, "fs"))]
        assert rows[0][1] >= 16 and max(rows[0][2], rows[1][2]) <= 8  # spread over the tasks, in blocks
        copies.append((rows[0][0] / n, rows[1][0] / n))
    assert max(p for p, _ in copies) <= 5 and max(f for _, f in copies) <= 4 + 4


def test_radius_join_in_parts_equals_brute_force(spark):
    """A crowded place beside lone floats, some exactly a radius apart, some below zero; also for a radius of 0."""
    from bathyspark.operators import geo
    f = spark.range(300).select(F.format_string("F%03d", "id").alias("float_id"),
                                F.expr("case when id < 200 then id % 7 / 8 else (id % 20 - 10) * 1.0 end").cast("double").alias("latitude"),
                                F.expr("case when id < 200 then id % 5 / 8 else id div 20 - 12.0 end").cast("double").alias("longitude"))
    pts = f.select(F.col("float_id").alias("point_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    spots = [tuple(x) for x in f.collect()]
    for r in (2.0, 0.0):
        want = sorted((a, b, ((c - e) ** 2 + (d - g) ** 2) ** 0.5) for a, c, d in spots for b, e, g in spots
                      if ((c - e) ** 2 + (d - g) ** 2) ** 0.5 <= r)
        assert sorted(tuple(x) for x in geo.floats_near_batch(pts, f, r, block_rows=4).collect()) == want


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == PROFILE_COLUMNS


def _signatures(spark, rows):
    from bathyspark.plans import answer
    kinds = "lat_lo double, lat_hi double, lon_lo double, lon_hi double, ts_lo timestamp_ntz, ts_hi timestamp_ntz, depth_hi double"
    none = dict.fromkeys(answer.BOUND_FIELDS)
    needs = {f"need_{p}": False for p in answer.QUESTION_PARAMETERS}
    data = [tuple({**none, **needs, **r}[c] for c in answer.BOUND_FIELDS) for r in rows]
    return spark.createDataFrame(data, kinds + "".join(f", need_{p} boolean" for p in answer.QUESTION_PARAMETERS))


def test_calendar_matches_brute_force(spark):
    """Any range, box and flag meets the levels it bounds, once each; also levels without time or place."""
    import datetime as dt
    import random
    from bathyspark.plans import answer
    from bathyspark.schemas import REGION_BOUNDS
    rng, at = random.Random(5), dt.datetime(1995, 11, 20)
    levels = [dict(latitude=rng.choice([None, rng.uniform(-40, 40)]) if i % 50 == 0 else rng.uniform(-40, 40), longitude=None if i % 75 == 0 else rng.uniform(20, 130),
                   timestamp=None if i % 40 == 0 else at + dt.timedelta(hours=12 * rng.randrange(2000)), depth=rng.choice([10.0, 1000.0, 1500.0, None]),
                   temperature=rng.choice([None, 1.5]), salinity=2.5) for i in range(1500)]
    lv = _levels(spark, levels)
    asked = []
    for k in range(160):
        lo = at + dt.timedelta(days=rng.randrange(900))
        hi = lo + dt.timedelta(days=rng.choice([-3, 0, 1, 20, 31, 45, 300, 366, 800]), hours=rng.choice([0, 0, 0, 7]))
        when = {} if k % 4 == 0 else dict(ts_lo=lo, ts_hi=hi)
        la, lg = rng.uniform(-40, 40), rng.uniform(20, 130)
        box = [(None,) * 4, tuple(map(float, rng.choice(list(REGION_BOUNDS.values())))), (la - 1, la + 1, lg - 1, lg + 1), (la - 9, la + 9, lg - 9, lg + 9)][k % 3 if k < 120 else 3]
        asked.append(dict(zip(("lat_lo", "lat_hi", "lon_lo", "lon_hi"), box)) | when | dict(need_temperature=k % 5 == 0, depth_hi=1000.0 if k % 7 == 0 else None))
    for y in (1995, 1996):  # the ranges that questions ask for
        asked += [dict(ts_lo=dt.datetime(y, 1, 1), ts_hi=dt.datetime(y, 12, 31))] + [dict(ts_lo=dt.datetime(y, m, 1), ts_hi=dt.datetime(y, m, 28)) for m in range(1, 13)]
    sigs = _signatures(spark, asked).distinct()
    for wrap in (False, True):
        got = answer._match(answer.level_groups(lv), sigs, wrap, answer.STAT_PARAMS).groupBy(*answer.BOUND_FIELDS).agg(F.sum("n").alias("n"), F.min("t_min").alias("t"))
        got = {tuple(r)[:-2]: (r.n, r.t) for r in got.collect()}
        want = {}
        for r in sigs.collect():
            n, t = lv.where(answer.bounds_predicate(r, wrap=wrap)).agg(F.count("*"), F.min("timestamp")).first()
            if n:
                want[tuple(r)] = (n, t)
        assert got == want and len(want) > 60


def test_calendar_bounds_the_rows_that_meet(spark):
    """A busy month: many groups and many questions about it meet in a few nodes each, not group by question."""
    import datetime as dt
    from bathyspark.plans import answer
    lv = _levels(spark, [dict(latitude=i % 60 - 30.0, longitude=20.0 + i % 90, timestamp=dt.datetime(1996, 3, 1 + i % 31, i % 24), depth=float(i), temperature=1.0) for i in range(4000)])
    sigs = _signatures(spark, [dict(ts_lo=dt.datetime(1996, 3, a), ts_hi=dt.datetime(1996, 3, b)) for a in range(1, 31) for b in range(a, 32)]
                       + [dict(ts_lo=dt.datetime(1995, 6, 9), ts_hi=dt.datetime(y, 5, 7)) for y in range(1996, 2020)])
    groups = answer.level_groups(lv)
    flags = groups.select(answer.FLAG_COLUMNS).distinct().count()
    met = answer._match(groups, sigs, False, answer.STAT_PARAMS)
    assert groups.count() > 3000 and met.count() <= sigs.count() * flags * (2 * 30 + 2 * 11 + 24 + 1)
    assert met.groupBy(*answer.BOUND_FIELDS).count().agg(F.max("count")).first()[0] <= flags * 84


def test_raw_sql_errors_raise_or_empty(spark):
    import pytest
    from bathyspark.sources import io
    io.register_tables(B.floats(spark, SF_SMALL), B.profiles(spark, SF_SMALL))
    with pytest.raises(Exception):
        io.execute_sql(spark, "SELECT no_such_column FROM argo_profiles")
    assert io.execute_sql(spark, "SELECT no_such_column FROM argo_profiles", on_error="empty").count() == 0
    failing = "SELECT raise_error(float_id) AS x FROM argo_floats"  # analysed without an error, fails on its rows
    assert io.execute_sql(spark, failing, on_error="empty").count() == 0
    n = io.execute_sql(spark, "SELECT count(*) AS n FROM argo_floats WHERE status = :s", {"s": "active"}).first().n
    assert n == B.floats(spark, SF_SMALL).where(F.col("status") == "active").count()


def test_readiness_reports_missing_table(spark):
    from bathyspark.sources import io
    rows = {r.table_name: r for r in io.readiness(spark, floats=B.floats(spark, SF_SMALL),
                                                   profiles_path="/nonexistent/levels").collect()}
    assert rows["argo_floats"].present and rows["argo_floats"].n_rows > 0
    assert not rows["argo_profiles"].present and rows["argo_profiles"].reason.startswith("missing")


def test_export_formats(spark):
    from bathyspark.sources import io
    rows = B.profiles(spark, SF_SMALL).limit(5)
    path = tempfile.mkdtemp(prefix="exp-")
    io.export(rows, "csv", path + "/csv")
    io.export(rows, "xml", path + "/json")  # any other format writes JSON
    assert spark.read.option("header", True).csv(path + "/csv").count() == 5
    back = spark.read.json(path + "/json")
    assert back.count() == 5 and "salinity" in back.columns


def test_float_text_skips_missing_statistics(spark):
    from bathyspark.functions.text import float_text
    row = dict(float_id="F_1", platform_type="APEX", status="active", latitude=10.0, longitude=70.0,
               deployment_date=dt.datetime(2023, 1, 1), institution="X", total_profiles=2,
               total_measurements=5, depth_min=0.0, depth_max=1000.0, temperature_min=None,
               temperature_max=None, salinity_min=34.0, salinity_max=35.0)
    schema = ("float_id string, platform_type string, status string, latitude double, longitude double, "
              "deployment_date timestamp_ntz, institution string, total_profiles long, total_measurements long, "
              "depth_min double, depth_max double, temperature_min double, temperature_max double, "
              "salinity_min double, salinity_max double")
    text = spark.createDataFrame([row], schema).select(float_text().alias("t")).first().t
    assert "Temperature range" not in text and "Salinity range: 34.0-35.0 PSU" in text
    assert text.startswith("ARGO float F_1 | Platform: APEX | Status: active | Location: 10.00°N, 70.00°E")
    no_summary = spark.createDataFrame([{**row, "total_measurements": None}], schema)
    assert no_summary.select(float_text().alias("t")).first().t.endswith("Institution: X")


def test_tfidf_matches_brute_force(spark):
    import math
    import re
    from pyspark.ml.feature import StopWordsRemover
    texts = {1: "Warm water near the surface and cold water at depth",
             2: "Salinity rises with depth in the warm tropical ocean",
             3: "The float drifts and the float profiles the ocean water column",
             4: "Cold deep water water water"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = V.tfidf_fit(docs, "doc_id", "text", max_features=8)
    got = {(r.doc, r.term_index): r.weight for r in V.tfidf_transform(model, docs, "doc_id", "text").collect()}
    vocab = {r.term: r.term_index for r in model.vocab.collect()}
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    toks = {d: [t for t in re.findall(r"\b\w\w+\b", s.lower()) if t not in stop] for d, s in texts.items()}
    total, dfreq = {}, {}
    for ts in toks.values():
        for t in ts:
            total[t] = total.get(t, 0) + 1
        for t in set(ts):
            dfreq[t] = dfreq.get(t, 0) + 1
    top = sorted(total, key=lambda t: (-total[t], t))[:8]
    assert set(vocab) == set(top)
    n = len(texts)
    for d, ts in toks.items():
        w = {t: ts.count(t) * (math.log((1 + n) / (1 + dfreq[t])) + 1) for t in set(ts) if t in vocab}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            assert abs(got[(d, vocab[t])] - v / norm) < 1e-12


def test_index_search_matches_brute_force(spark):
    import numpy as np
    from bathyspark.operators import index as X
    idx, model = X.build_index(B.floats(spark, SF_SMALL), B.profiles(spark, SF_SMALL), max_features=50)
    qs = spark.createDataFrame([(1, "active float with temperature range"), (2, "platform status inactive")],
                               "qid long, text string")
    hits = X.search_index(idx, model, qs, "qid", "text", k=3).orderBy("qid", "rank").collect()
    corpus = idx.select("doc", "float_id", "embedding").collect()
    qv = {r.qid: r.embedding for r in X.embed_texts(model, qs, "qid", "text").collect()}

    def dense(e):
        v = np.zeros(50)
        v[list(e.indices)] = list(e.values)
        return v

    for qid, e in qv.items():
        q = dense(e)
        d = sorted((round(float(((q - dense(c.embedding)) ** 2).sum()), 6), c.doc, c.float_id) for c in corpus)[:3]
        mine = [(h.distance, h.float_id) for h in hits if h.qid == qid]
        assert [x[0] for x in d] == [m[0] for m in mine]


def test_means_keep_small_and_large_values(spark):
    """Eight decimals count, and one outlier spoils neither the others nor the aggregate."""
    small = _levels(spark, [dict(temperature=0.00000012), dict(temperature=0.00000034), dict(temperature=None)])
    assert abs(A.profile_summary(small).first().temperature_mean - 0.00000023) < 1e-18
    far = _levels(spark, [dict(temperature=1e30), dict(temperature=2.0)])
    assert A.profile_summary(far).first().temperature_mean == 5e29
    none = _levels(spark, [dict(temperature=None)])
    assert A.profile_summary(none).first().temperature_mean is None


def test_question_batch_in_parts_equals_whole(spark):
    """A question's answer depends on no other question, in any column."""
    from bathyspark.plans.answer import question_batch
    lv, qs = B.profile_levels(spark, SF_SMALL), B.questions(spark, SF_SMALL)
    whole = question_batch(lv, qs, 1996)
    values = [c for c in whole.columns if c not in ("p", "b")]
    few = question_batch(lv, qs.where("question_id % 7 = 3"), 1996)
    rows = {r.question_id: r for r in whole.select(values).collect()}
    got = few.select(values).collect()
    assert got and all(rows[r.question_id] == r for r in got)


def test_one_bad_question_leaves_the_others(spark):
    from bathyspark.plans.answer import answer_records, question_batch
    qs = spark.createDataFrame([(1, "temperature near 00009999999999, 5"), (2, "temperature near the equator"), (3, "oxygen in march 0000")],
                               "question_id long, question string")
    rec = {r.question_id: r for r in answer_records(question_batch(B.profile_levels(spark, SF_SMALL), qs, 1996)).collect()}
    assert rec[1].data_summary.total_records == 0 and rec[1].data_summary.parameters_found == []
    assert rec[1].data_summary.geographic_bounds is None and rec[2].data_summary.total_records > 0
    assert "temperature" in rec[2].data_summary.parameters_found and len(rec) == 3


def test_knn_with_stock_settings_and_text_ids(spark):
    key = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(key)
    kind = "id string, embedding struct<indices: array<int>, values: array<double>>"
    corpus = spark.createDataFrame([("b", ([0], [1.0])), ("a", ([1], [1.0])), ("c", ([], [])), (None, ([], []))], kind)
    queries = spark.createDataFrame([(7, ([0], [1.0])), (8, ([], []))], kind.replace("id string", "query_id long"))
    try:
        for value in ("true", "false"):
            spark.conf.set(key, value)
            got = [(r.query_id, r.neighbour_id, r["rank"], r.distance) for r in V.knn_l2(queries, corpus, 2, dim=3).orderBy("query_id", "rank").collect()]
            assert got == [(7, "b", 1, 0.0), (7, "c", 2, 1.0), (8, "c", 1, 0.0), (8, "a", 2, 1.0)]
    finally:
        spark.conf.set(key, before)


def test_filters_are_optional_and_checked(spark):
    import pytest
    from bathyspark.operators.filtered import query_floats, query_profiles
    from bathyspark.sources import io
    lv, f = B.profiles(spark, SF_SMALL), B.floats(spark, SF_SMALL)
    assert query_floats(f).count() == f.count() and query_profiles(lv).count() == 1000
    assert query_profiles(lv, limit=None).count() == lv.count()
    with pytest.raises(ValueError):
        query_profiles(lv, {"depth": 3})
    path = io.scratch_dir(spark, "levels")
    io.write_levels_table(lv, path)
    wanted = {"date_range": ("1996-01-01", "1996-02-20"), "depth_range": (0, 800)}
    stored = query_profiles(io.read_levels_table(spark, path), wanted, limit=None).select(PROFILE_COLUMNS)
    direct = query_profiles(lv, wanted, limit=None)
    assert stored.count() > 0 and stored.exceptAll(direct).count() == 0 and direct.exceptAll(stored).count() == 0


def test_depth_grid_of_few_levels(spark):
    rows = spark.createDataFrame([("a", 100, 0), ("b", 100, 1), ("c", 100, 3), ("d", 100, None), ("e", 100, -2)], "float_id string, max_pressure int, n int")
    got = sorted((r.float_id, r.level, r.depth) for r in SH.depth_grid(rows, F.col("n")).collect())
    assert got == [("b", 0, 0.0), ("c", 0, 0.0), ("c", 1, 50.0), ("c", 2, 100.0)]


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(90, 5)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0] * 5)], "id long, embedding array<double>")
    d = np.round(((x[:, None, :] - x[None, :, :]) ** 2).sum(2), 6)
    want = {(i, r + 1, int(j)) for i in range(90) for r, j in enumerate(np.lexsort((np.arange(90), d[i]))[:4])}
    for size in (1 << 20, 5 * 8 * 7):  # one block of queries, then blocks of seven
        got = V.knn_l2(df, df, 4, query_id="id", block_bytes=size)
        assert {(r.query_id, r["rank"], r.neighbour_id) for r in got.collect()} == want


def test_store_reads_only_the_months_of_the_batch(spark, tmp_path):
    """The stored side is pruned, a profile stored in another month than the batch names is found, a retry adds nothing."""
    import io as text
    from contextlib import redirect_stdout
    month = lambda m, day=3: dt.datetime(1996, m, day)
    old = _levels(spark, [dict(profile_id=f"P{m}", depth=float(d), timestamp=month(m)) for m in range(1, 11) for d in range(5)] + [dict(profile_id="PN", timestamp=None)])
    batch = _levels(spark, [dict(profile_id="P3", depth=2.0, timestamp=month(3)), dict(profile_id="P3", depth=9.0, timestamp=month(3)),
                            dict(profile_id="P5", depth=1.0, timestamp=month(3)), dict(profile_id="new", depth=1.0, timestamp=month(3)), dict(profile_id="PN", depth=0.0, timestamp=month(4))])
    path = str(tmp_path / "store")
    I.create_level_store(path, old)
    stored = I.stored_for(spark, path, batch)
    shown = text.StringIO()
    with redirect_stdout(shown):
        stored.explain()
    assert "PartitionFilters: [(month" in shown.getvalue() and stored.count() == 11
    order = ["timestamp"]
    want = I.new_levels(old, batch, order=order).select("profile_id", "depth")
    assert I.new_levels(stored, batch, order=order).select("profile_id", "depth").exceptAll(want).count() == 0 and want.count() == 2
    assert I.append_to_store(spark, path, batch, "b1", order=order) == 2
    assert I.append_to_store(spark, path, batch, "b2", order=order) == 0
    assert I.stored_for(spark, path, batch).where("profile_id = 'new'").count() == 1


def test_report_equals_skipped_rows(spark):
    lv = B.profile_levels(spark, SF_SMALL)
    stored, order = lv.where("level_no <= 3"), ["level_no", "part_no", "supp_no", "ext_price"]
    got = I.ingest_report(stored, lv).first()
    assert got.skipped_rows == I.skipped_levels(stored, lv, order=order).count() and got.inserted_rows == I.new_levels(stored, lv, order=order).count()
    nothing = I.ingest_report(stored, lv.where("false")).first()
    assert (nothing.input_rows, nothing.inserted_rows, nothing.skipped_rows) == (0, 0, 0)


def test_kept_summaries_equal_recomputed_ones(spark, tmp_path):
    """Profiles and floats that go on over batches, nulls, a retried batch."""
    from bathyspark.operators import kept_stats as K
    rows = [dict(profile_id=f"P{i % 40}" if i % 17 else None, float_id=f"F{i % 7}" if i % 23 else None, depth=float(i % 90), temperature=None if i % 5 == 0 else i / 7, salinity=30.0 + i / 100,
                 timestamp=dt.datetime(1996, 1 + i % 9, 1 + i % 28), latitude=i / 10) for i in range(600)]
    rows.append(dict(profile_id="P1", float_id="other", temperature=1e30))
    path, parts = str(tmp_path / "kept"), [rows[:200], rows[200:210], rows[210:]]
    for batch, part in enumerate(parts):
        for _ in range(2 if batch == 1 else 1):
            K.add_batch(spark, path, _levels(spark, part), batch)
    every = _levels(spark, rows)
    want = {r.float_id: r for r in A.summary_by_float(every).collect()}
    got = {r.float_id: r for r in K.summary_by_float(spark, path).select(*A.summary_by_float(every).columns).collect()}
    assert got == want and len(want) == 9
    assert K.profile_summary(spark, path).collect() == A.profile_summary(every).collect()


def test_place_ranges_hold_the_box_and_skip_row_groups(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq
    from bathyspark.functions.filters import point_box
    from bathyspark.sources import io
    rng = np.random.default_rng(2)
    lat, lon = rng.uniform(-89, 89, 40_000), rng.uniform(-179, 179, 40_000)
    lv = _levels(spark, [dict(profile_id=f"P{i}", latitude=float(a), longitude=float(b)) for i, (a, b) in enumerate(zip(lat, lon))] + [dict(latitude=None), dict(latitude=90.0, longitude=-180.0)])
    path = str(tmp_path / "places")
    io.write_levels_by_place(lv, path, row_group_bytes=1 << 15)
    for box in ((9.0, 11.0, 69.0, 71.0), (-90.0, -80.0, -180.0, 180.0), (-1.0, 1.0, -1.0, 1.0), (89.0, 95.0, -190.0, -170.0)):
        inside = F.col("latitude").between(box[0], box[1]) & F.col("longitude").between(box[2], box[3])
        got = spark.read.parquet(path).where(inside & io.place_pruning(*box))
        assert got.select("profile_id").exceptAll(lv.where(inside).select("profile_id")).count() == 0 and got.count() == lv.where(inside).count()
    ranges, met, groups = io.place_ranges(9.0, 11.0, 69.0, 71.0), 0, 0
    for name in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        at = meta.schema.to_arrow_schema().get_field_index("place")
        for g in range(meta.num_row_groups):
            stat, groups = meta.row_group(g).column(at).statistics, groups + 1
            met += any(stat.min <= high and stat.max >= low for low, high in ranges)
    assert groups >= 20 and met <= 0.2 * groups and len(ranges) <= 48
    assert spark.read.parquet(path).where(point_box(10.0, 70.0) & io.place_pruning(9.0, 11.0, 69.0, 71.0)).count() > 0


def _shuffled(df):
    """The columns of every shuffle in the plan, as Spark's own ``Exchange`` nodes print them."""
    import io as text
    import re
    from contextlib import redirect_stdout
    shown = text.StringIO()
    with redirect_stdout(shown):
        df.explain("formatted")
    return [p for p in shown.getvalue().split("\n\n") if re.match(r"\(\d+\) Exchange", p.strip())]


def test_bucketed_levels_need_no_shuffle_of_levels(spark, tmp_path):
    """A hot float, nulls, repeated rows; a second session's view and an appended batch."""
    from bathyspark.operators import bucketed as BK
    rows = [dict(profile_id=None if i % 31 == 0 else f"P{i // 5}", float_id=None if i % 37 == 0 else "hot" if i % 3 == 0 else f"F{i % 40}",
                 depth=float(i % 9), temperature=i / 7, salinity=30.0 + i / 100, timestamp=dt.datetime(1996, 1, 1), latitude=1.0, longitude=2.0) for i in range(3000)]
    lv = _levels(spark, rows + rows[:3])
    floats = spark.createDataFrame([("hot", "active"), ("F1", None), ("unused", "lost")], "float_id string, status string")
    path = str(tmp_path / "bucketed")
    name = BK.write_bucketed(lv, path, 8)
    again = BK.open_bucketed(spark, path, 8)
    same = lambda a, b: a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    want = lv.join(floats, "float_id", "left").select(*lv.columns, "status")
    for stored in (spark.table(name), again):
        by_float, nested, joined = A.summary_by_float(stored), SH.nest_profiles(stored), BK.levels_with_floats(stored, floats, ["status"], 8)
        assert not _shuffled(nested)
        assert len(_shuffled(by_float)) == 1 and "temperature#" not in _shuffled(by_float)[0].split("Arguments")[1]
        with_profile = BK.by_profile(stored, floats, 8)
        assert _shuffled(with_profile) and not any("depth#" in p for p in _shuffled(with_profile))
        assert same(by_float, A.summary_by_float(lv)) and same(joined, want)
        pick = ["profile_id", "float_id", "depths"]
        assert same(nested.select(pick), SH.nest_profiles(lv).select(pick))
    assert same(BK.float_summaries(again, floats), floats.join(A.summary_by_float(lv), "float_id", "left"))
    sizes = [r["n"] for r in spark.read.parquet(path).where("float_id = 'hot'").groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 0.3 * sum(sizes)
    BK.write_bucketed(lv.where("float_id = 'F1'"), path, 8, table=name, mode="append")
    more = lv.unionByName(lv.where("float_id = 'F1'"))
    spark.catalog.refreshTable(name)
    assert same(A.summary_by_float(spark.table(name)), A.summary_by_float(more)) and not _shuffled(SH.nest_profiles(spark.table(name)))
    empty = spark.table(BK.write_bucketed(lv.where("false"), str(tmp_path / "none"), 8))
    assert BK.levels_with_floats(empty, floats, ["status"], 8).count() == 0 and A.summary_by_float(empty).count() == 0


def test_knn_computes_few_distances(monkeypatch):
    """The matrix product leaves few pairs whose distance is computed; ties, far-off values and lame rows included, the result is that of brute force."""
    rng = np.random.default_rng(4)
    computed = []
    plain = V._distances
    monkeypatch.setattr(V, "_distances", lambda q, c, row, col: computed.append(len(row)) or plain(q, c, row, col))
    for n, m, dim, k, off, decimals in ((300, 5000, 16, 5, 0, 9), (40, 2500, 3, 7, 1000, 1), (50, 3, 4, 5, 0, 1), (7, 0, 3, 2, 0, 1)):
        q, c = (np.round(rng.normal(size=(x, dim)), decimals) + off for x in (n, m))
        q[3], c[-1:] = np.nan, np.inf
        ids, reach = rng.permutation(m), np.full(n, 1.5)
        d = np.nan_to_num(np.round(((q[:, None] - c[None]) ** 2).sum(2), 6), nan=np.inf)
        for most in (None, reach):
            computed.clear()
            row, col, got = V._nearest(q, ids, c, k, most, cells=1 << 12, width=512)
            want = [(i, int(ids[j]), d[i, j]) for i in range(n) for j in np.lexsort((ids, d[i]))[:k] if d[i, j] <= (1e9 if most is None else 1.5)]
            assert [(int(i), int(ids[j]), x) for i, j, x in zip(row, col, got)] == want
            assert dim != 16 or sum(computed) < 0.02 * n * m


def test_knn_leaves_out_lame_vectors(spark):
    e = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0])], "id long, embedding array<double>")
    for size in (1 << 20, 16):
        got = sorted((r.query_id, r.neighbour_id, r.distance) for r in V.knn_l2(e, e, 3, query_id="id", block_bytes=size).collect())
        assert got == [(1, 1, 0.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 0.0)]


def test_knn_sends_a_query_to_a_small_corpus_once(spark):
    """A few corpus vectors make one block, however many cores there are; the queries are parted instead."""
    e = B.table(spark, SF_SMALL, "embeddings")
    found, _, parts = V._near_rows(e, e.limit(9), 20, "vec_id", "embedding", "vec_id", "embedding", V.DEFAULT_BLOCK_BYTES, None)
    assert parts.single and found.count() == 9 * e.count()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") == 1  # the corpus is copied for the blocks of queries, no query for parts of the corpus


def test_questions_of_one_place_meet_its_levels_once(spark):
    """Levels are rolled up for the distinct boxes and not for each question of a place and time; no level is shuffled by its own place."""
    import datetime as dt
    from bathyspark.plans import answer
    lv = _levels(spark, [dict(latitude=10 + i % 97 / 100, longitude=50.0 + i % 89 / 100, timestamp=dt.datetime(1996, 3, 1 + i % 31), depth=float(i % 40), temperature=float(i)) for i in range(3000)])
    sigs = _signatures(spark, [dict(lat_lo=9.5, lat_hi=11.5, lon_lo=49.5, lon_hi=51.5, depth_hi=d, ts_lo=dt.datetime(1996, 3, a), ts_hi=dt.datetime(1996, 3, 31))
                               for a in range(1, 20) for d in (None, 1000.0)]).distinct()
    met = answer._match(lv, sigs, False, ["temperature"], lambda rows: answer.level_partials(rows, ["temperature"]))
    assert met.count() <= sigs.count() * 32  # days, not the 3,000 levels of each question
    sums = {tuple(r)[:-2]: (r.n, r.s) for r in met.groupBy(*answer.BOUND_FIELDS).agg(F.sum("n").alias("n"), F.sum("temperature_sum").cast("double").alias("s")).collect()}
    for r in sigs.collect():
        want = lv.where(answer.bounds_predicate(r)).agg(F.count("*"), F.sum("temperature")).first()
        assert sums[tuple(r)] == tuple(want)


def test_skipped_levels_shuffle_whole_rows_once(spark):
    rows = [dict(profile_id=f"p{i % 7}", depth=float(i % 5), temperature=float(i)) for i in range(60)]
    batch = _levels(spark, rows)
    skipped = I.skipped_levels(batch.where("depth < 2").limit(4), batch, order=["temperature"])
    plan = skipped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # with the keys' first rows, and of these with the stored keys
    assert skipped.where("reason = 'key already stored'").count() > 0 and skipped.where("reason = 'repeated in batch'").count() > 0


def test_answers_parse_each_question_once(spark, monkeypatch):
    """Statistics and neighbours take the questions as parsed once, on all cores; no later plan reads them from their tables."""
    from bathyspark.plans import answer, q_vectors
    plain, parsed = answer.parse_table, []
    monkeypatch.setattr(answer, "parse_table", lambda questions, *more: parsed.append(questions.rdd.getNumPartitions()) or plain(questions, *more))
    for query in (q_vectors.answer_context, q_vectors.answer_records, q_vectors.question_neighbours):
        parsed.clear()
        plan = query(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert len(parsed) == 1 and parsed[0] >= spark.sparkContext.defaultParallelism
        assert "c_custkey" not in plan and "conv_id" not in plan


def test_levels_are_summarised_once_for_an_index_that_is_added_to(spark, monkeypatch):
    """The build and both additions take the summaries of the same levels, which are read once."""
    from bathyspark.operators import index as X
    from bathyspark.plans import q_vectors
    plain, seen = A.summary_by_float, []
    for module in (X, q_vectors):
        monkeypatch.setattr(module, "summary_by_float", lambda levels: seen.append(1) or plain(levels), raising=False)
    got = q_vectors.index_added(spark, SF_SMALL)
    assert len(seen) == 1 and got.count() == B.floats(spark, SF_SMALL).count()
