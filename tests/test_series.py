"""Row order, NULLs, gaps and long series: hand-computed cases and both plans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flowpanel.functions import calendar, hurdle, ids
from flowpanel.operators import behaviour, enrich, features, stats, windows
from flowpanel.plans import ordered
from flowpanel.sources import panel as panel_source

T0 = dt.datetime(2024, 1, 1)


def at(step):
    return T0 + dt.timedelta(minutes=15 * step)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


PANEL = ("series_id string, meter_id string, date_time timestamp_ntz, usage double, temp_c double, "
         "precip_mm double, snow_cm double, lat double, lon double")


def panel(spark, steps, series="a", missing=(), seed=1):
    rng = random.Random(seed)
    rows = [
        (series, series, at(s), float(rng.choice([0, 0, 0, 1, 2])), None if s in missing else rng.uniform(0, 20),
         rng.uniform(0, 1), rng.choice([0.0, 0.0, 0.5]), 40.0, -105.0)
        for s in steps
    ]
    return frame(spark, rows, PANEL)


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("series_id", "date_time").collect()]


def test_rolling_null_and_partial_frames(spark):
    rows = [("a", "a", at(k), 0.0, t, p, 0.0, 0.0, 0.0) for k, (t, p) in enumerate(
        [(11.0, 1.0), (12.0, None), (None, 3.0), (9.0, 4.0), (14.0, 5.0)])]
    df = features.rolling_sums(frame(spark, rows, PANEL), {"precip_3d": 2, "snow_24h": 2, "gdd_7d": 3})
    got = values(df, "precip_3d", "snow_24h", "gdd_7d")
    assert got == [(1.0, 0.0, 1.0), (None, 0.0, 3.0), (None, 0.0, None), (7.0, 0.0, None), (9.0, 0.0, None)]


def test_rolling_equals_sliding_frame(spark):
    from pyspark.sql import Window

    df = panel(spark, range(900), missing={100, 101, 500})
    w = Window.partitionBy("series_id").orderBy("date_time").rowsBetween(-671, 0)
    g = features.gdd_base()
    want = df.withColumn("want", F.when(F.count(g).over(w) == F.count(F.lit(1)).over(w), F.sum(g).over(w)))
    both = features.rolling_sums(want)
    bad = both.where(~F.col("gdd_7d").eqNullSafe(F.col("want")) & ~(F.abs(F.col("gdd_7d") - F.col("want")) < 1e-6))
    assert bad.count() == 0
    assert both.where("(gdd_7d is null) != (want is null)").count() == 0
    assert both.where("gdd_7d is null").count() == 900 - 100  # frames from row 100 on hold a missing value


def test_nan_is_missing_and_stays_local(spark):
    rows = [("a", "a", at(k), 0.0, 11.0, p, 0.0, 0.0, 0.0) for k, p in enumerate([1.0, float("nan"), 3.0, 4.0])]
    df = features.rolling_sums(frame(spark, rows, PANEL), {"precip_3d": 2})
    assert [v for v, in values(df, "precip_3d")] == [1.0, None, None, 7.0]


def test_flags_keep_null(spark):
    df = spark.createDataFrame([(None, None), (0.0, 5.0), (0.2, 12.0)], "snow_cm double, temp_c double")
    got = df.select(features.snow_flag().alias("f"), features.gdd_base().alias("g")).collect()
    assert [tuple(r) for r in got] == [(None, None), (0.0, 0.0), (1.0, 2.0)]


def test_lags_count_rows_across_a_gap(spark):
    df = features.lag_usage(panel(spark, [*range(100), *range(104, 204)]))
    rows = values(df, "date_time", "usage", "usage_24h")
    assert rows[95][2] is None
    assert rows[120][2] == rows[24][1]
    assert rows[120][0] - rows[24][0] == dt.timedelta(hours=25)


def test_window_blocks_do_not_realign(spark):
    df = panel(spark, [*range(100), *range(104, 300)]).drop("temp_c")
    got = windows.day_windows(df, c_in=[], c_out=[]).orderBy("window_idx").collect()
    assert [(r["window_idx"], r["window_start"], len(r["x"])) for r in got] == [(0, at(0), 96), (2, at(196), 96)]


def test_two_series_of_one_meter_stay_apart(spark):
    a, b = panel(spark, range(96), "0000000001A"), panel(spark, range(96), "0000000001B", seed=2)
    both = a.unionByName(b).withColumn("meter_id", ids.id_prefix("series_id"))
    assert both.select("meter_id").distinct().count() == 1
    assert windows.day_windows(both, c_in=[], c_out=[]).count() == 2
    places = spark.createDataFrame(
        [("0000000001", 1.0, 2.0), ("0000000001", 3.0, 4.0), ("x", None, 1.0)], "meter_id string, lat double, lon double")
    assert enrich.join_locations(both.drop("lat", "lon"), places).count() == 2 * 2 * 96


def test_matrices_are_feature_major(spark):
    df = features.add_calendar(panel(spark, range(96)))
    row = windows.day_windows(df, c_in=["usage", "hour_sin"], c_out=["precip_mm"]).first()
    assert row["x"] == row["c_in"][0] and len(row["c_in"]) == 2 and len(row["c_in"][1]) == 96
    assert row["c_in"][1][24] == pytest.approx(1.0)


def test_sliding_stride(spark):
    df = panel(spark, range(200))
    got = windows.sliding_windows(df, 1, c_in=[], c_out=[])
    assert got.count() == 105
    rows = {r["window_idx"]: r["x"] for r in got.collect()}
    assert rows[0][1:] == rows[1][:-1]


@pytest.mark.parametrize("bucket_rows", [1, 700, 1000])
def test_long_series_give_the_same_features(spark, bucket_rows):
    gappy = [s for s in range(3000) if s % 500 not in range(7)]
    df = panel(spark, gappy, "long", missing={50, 2000}).unionByName(panel(spark, range(900), "short", seed=3))
    hot = ordered.hot_series(df, max_rows=1000)
    assert [r[0] for r in hot.collect()] == ["long"]
    plain = features.build_features(df, complete_only=False)
    split = features.build_features(df, complete_only=False, hot=hot, bucket_rows=bucket_rows)
    assert plain.columns == split.columns
    doubles = [c for c, t in plain.dtypes if t == "double"]

    def rounded(x):
        return x.withColumns({c: F.round(c, 6) for c in doubles})

    assert rounded(plain).exceptAll(rounded(split)).count() == 0
    assert rounded(split).exceptAll(rounded(plain)).count() == 0


def test_long_series_give_the_same_windows_and_events(spark):
    df = panel(spark, [s for s in range(2000) if s % 300 != 5], "long").unionByName(panel(spark, range(300), "short"))
    hot = ordered.hot_series(df, max_rows=1000)
    for make in (
        lambda h: windows.day_windows(df, c_in=[], c_out=["temp_c"], hot=h),
        lambda h: windows.sliding_windows(df, 10, c_in=[], c_out=[], hot=h),
    ):
        assert make(None).exceptAll(make(hot)).count() == 0 and make(None).count() == make(hot).count() > 0
    for make in (
        lambda h, **s: behaviour.burst_stats(df, h, **s),
        lambda h, **s: behaviour.interarrival(df, h, **s),
        lambda h, **s: behaviour.autocorrelation(df, 3, h, **s).withColumn("autocorr", F.round("autocorr", 9)),
    ):
        a, b = make(None), make(hot, bucket_rows=50)
        assert a.exceptAll(b).count() == 0 and a.count() == b.count() > 0


def test_long_series_keep_rows_without_a_time(spark):
    df = panel(spark, range(300))
    none = df.limit(1).withColumn("date_time", F.lit(None).cast("timestamp_ntz")).withColumn("usage", F.lit(7.0))
    df = df.unionByName(none).unionByName(none)
    hot = df.select("series_id").distinct()
    for add in (features.lag_usage, features.lag_temp):
        short, long = add(df, hot=None), add(df, hot=hot, bucket_rows=100)
        assert short.count() == long.count() == 302
        key = "usage_15m" if add is features.lag_usage else "temp_1h"
        assert values(short.where("date_time is not null"), "date_time", key) == values(long.where("date_time is not null"), "date_time", key)


def test_cache_key_of_whole_and_fractional_places(spark):
    df = spark.createDataFrame([(40.0, -105.0), (40.5, -104.99999), (39.12345, 0.0)], "lat double, lon double")
    got = [r[0] for r in df.select(enrich.grid_key_text()).collect()]
    assert got == ["lat_40_lon_-105", "lat_40p5_lon_-105", "lat_39p1235_lon_0"]


def test_no_long_series_means_one_shuffle(spark):
    df = panel(spark, range(100))
    assert ordered.hot_series(df) is None
    plan = features.build_features(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_asof_equals_brute_force(spark):
    rng = random.Random(5)
    usage = [(c, at(rng.randrange(400))) for c in "ab" for _ in range(80)]
    weather = [(c, at(rng.randrange(40, 360)), rng.choice([None, 1.0, 2.0])) for c in "ab" for _ in range(12)]
    weather = list({(c, t): (c, t, v) for c, t, v in weather}.values())
    u = spark.createDataFrame(usage, "cell string, date_time timestamp_ntz")
    w = spark.createDataFrame([(*x, 0.0, 0.0) for x in weather],
                              "cell string, wx_time timestamp_ntz, temp_c double, precip_mm double, snow_cm double")
    want = []
    for c, t in usage:
        before = [x for x in weather if x[0] == c and x[1] <= t]
        if before:
            want.append((c, t, max(before, key=lambda x: x[1])[2]))
    def key(r):
        return (r[0], r[1], r[2] is None, r[2] or 0)

    for limit in (10**6, 0):  # broadcast and shuffled
        from flowpanel.plans.asof import asof_backward

        got = asof_backward(u, w, ["cell"], "date_time", "wx_time", ["temp_c"], broadcast_rows=limit)
        rows = [tuple(r) for r in got.select("cell", "date_time", "temp_c").collect()]
        assert sorted(rows, key=key) == sorted(want, key=key)


def test_asof_null_measure_equal_time_and_first_rows(spark):
    u = spark.createDataFrame([("a", at(k)) for k in (0, 4, 6, 8, 9)], "cell string, date_time timestamp_ntz")
    w = spark.createDataFrame([("a", at(4), 1.0), ("a", at(6), None), ("a", at(8), 3.0)],
                              "cell string, wx_time timestamp_ntz, temp_c double")
    got = enrich.asof_weather(u, w, ["cell"], measures=["temp_c"]).orderBy("date_time").collect()
    assert [(r["date_time"], r["temp_c"]) for r in got] == [(at(4), 1.0), (at(6), None), (at(8), 3.0), (at(9), 3.0)]


def test_asof_with_an_empty_side(spark):
    u = spark.createDataFrame([("a", at(0))], "cell string, date_time timestamp_ntz")
    w = spark.createDataFrame([("a", at(0), 1.0)], "cell string, wx_time timestamp_ntz, temp_c double")
    for left, right in ((u.limit(0), w), (u, w.limit(0)), (u, w.where("wx_time > timestamp_ntz '2025-01-01'"))):
        assert enrich.asof_weather(left, right, ["cell"], measures=["temp_c"]).count() == 0


def test_zoned_time_counts_elapsed_minutes(spark):
    """In Denver the local hour from 1:00 repeats on 2024-11-03; instants do not care."""
    start = dt.datetime(2024, 11, 3, 6, tzinfo=dt.timezone.utc)  # local midnight
    rows = [("a", start + dt.timedelta(minutes=15 * k), 1.0) for k in range(96)]
    df = spark.createDataFrame(rows, "series_id string, date_time timestamp, usage double")
    assert windows.day_windows(df, c_in=[], c_out=[]).count() == 1
    hours = features.add_calendar(df).select(F.hour("date_time")).collect()
    assert [h[0] for h in hours].count(1) == 8
    spring = dt.datetime(2024, 3, 10, 7, tzinfo=dt.timezone.utc)
    short = [("a", spring + dt.timedelta(minutes=15 * k), 1.0) for k in range(97) if k != 30]
    gap = spark.createDataFrame(short, "series_id string, date_time timestamp, usage double")
    assert windows.day_windows(gap, c_in=[], c_out=[]).count() == 0
    late = spark.createDataFrame([(start,)], "t timestamp")
    assert late.select(calendar.elapsed_seconds(late, "t", F.col("t"), F.col("t"))).first()[0] == 0


def test_zoned_asof_and_weather_json(spark):
    from flowpanel.sources.weather import flatten_weather_json

    utc = dt.timezone.utc
    first = dt.datetime(2024, 11, 3, 6, tzinfo=utc)
    times = [int((first + dt.timedelta(hours=h)).timestamp()) for h in range(4)]
    body = '{"hourly":{"time":%s,"temperature_2m":[1.5,null,"x",4],"precipitation":[0,0,0,0.1],"snowfall":[0,0,0,0]}}' % times
    raw = spark.createDataFrame([("p", body), ("p", '{"hourly":{"time":[]}}'), ("p", "{}"), ("p", None)], "place string, body string")
    weather = flatten_weather_json(raw, keep=("place",)).withColumnRenamed("date_time", "wx_time")
    assert weather.count() == 4
    usage = spark.createDataFrame([("p", first + dt.timedelta(minutes=15 * k)) for k in range(-1, 20)], "place string, date_time timestamp")
    got = enrich.asof_weather(usage, weather, ["place"]).orderBy("date_time").collect()
    assert [r["temp_c"] for r in got] == [1.5] * 4 + [None] * 8 + [4.0] * 8
    assert got[-1]["precip_mm"] == 0.1


def test_access_lists_and_tables_agree(spark):
    from flowpanel.operators import access

    df = panel(spark, range(300), "a").unionByName(panel(spark, range(300), "b")).unionByName(panel(spark, range(300), "c"))
    start, end = "2024-01-01 12:00:00", "2024-01-02 12:00:00"
    ids_ = spark.createDataFrame([("a",), ("c",)], "meter_id string")
    short = access.get_panel_subset(df, ["a", "c"], start, end)
    assert short.count() == 2 * 97
    assert short.exceptAll(access.get_panel_subset(df, ids_, start, end)).count() == 0
    long = access.get_panel_subset(df, ["a", "c", *map(str, range(2000))], at(48), at(144))
    assert short.exceptAll(long).count() == 0 and long.count() == short.count()
    assert access.filter_years(df, 2023, 2023).count() == 0 and access.filter_years(df).count() == 900
    assert access.get_time_range(df, start, end).count() == 3 * 97


def test_filters_reach_the_scan(spark, tmp_path):
    from flowpanel.operators import access

    panel_source.write_panel(panel(spark, range(500)), str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    plan = access.filter_years(df).select("usage")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date_time" in plan and "ReadSchema: struct<date_time:timestamp_ntz,usage:double>" in plan


def test_ids(spark):
    df = spark.createDataFrame([("123",), ("0123456789",), ("012345678901",)], "id string")
    got = [tuple(r) for r in df.select(ids.id_pad("id"), ids.id_strip_zeros("id")).collect()]
    assert got == [("0000000123", "123"), ("0123456789", "123456789"), ("012345678901", "12345678901")]
    path = spark.createDataFrame([("x/window_meter_0042.parquet",), ("climate_summary.parquet",)], "p string")
    assert [r[0] for r in path.select(ids.id_from_path("p")).collect()] == ["0042", None]


STATS = {"log_mean": 0.4, "log_std": 0.9, "temp_c_mean": 10.0, "temp_c_std": 2.0}


def test_hurdle_round_trip(spark):
    df = spark.createDataFrame([([-0.5, 0.0, 1e-9, 5.0, 900.0],)], "x array<double>")
    enc = df.select(hurdle.encode_window(F.col("x"), STATS).alias("e"))
    row = enc.select("e", hurdle.decode_window(F.col("e"), STATS).alias("d")).first()
    assert row["e"][0] == [0.0, 0.0, 1.0, 1.0, 1.0] and row["e"][1][:2] == [0.0, 0.0]
    assert row["d"][0] == row["d"][1] == 0.0
    for got, want in zip(row["d"][2:], (1e-9, 5.0, 900.0)):
        assert got == pytest.approx(want, rel=2e-5, abs=1e-6)


def test_unmasked_lag_of_zero_and_flag_scaling(spark):
    row = spark.range(1).select(
        hurdle.magnitude(F.lit(0.0), 0.4, 0.9, masked=False).alias("z"),
        hurdle.scale_weather(F.lit(1.0), "snow_flag", STATS).alias("raw"),
        hurdle.scale_weather(F.lit(1.0), "snow_flag", STATS, True).alias("scaled"),
    ).first()
    assert row["z"] == pytest.approx(-0.4 / (0.9 + 1e-6))
    assert row["raw"] == 1.0 and row["scaled"] == pytest.approx(1 / (1 + 1e-6))


def test_finite_windows_and_defaults(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], [[1.0, 1.0]]), ([1.0, float("nan")], [[1.0, 1.0]]), ([1.0, 2.0], [[float("inf"), 1.0]]),
         ([1.0, None], [[1.0, 1.0]])], "x array<double>, c_in array<array<double>>")
    assert windows.finite_windows(df).count() == 1
    empty = panel(spark, range(3)).limit(0)
    row = stats.norm_stats(features.build_features(empty)).first()
    assert row["log_mean"] == 0.0 and row["gdd_7d_std"] == 1.0


def test_empty_panel_schema(spark):
    part = panel(spark, range(2)).drop("snow_cm")
    whole = panel_source.with_empty_schema(part)
    assert whole.count() == 2 and whole.where("snow_cm is null").count() == 2
    assert panel_source.empty_panel(spark).columns == panel(spark, [0]).columns
