"""Windows cut without interpreted slices; lists and calendars only for those who ask."""

from __future__ import annotations

import datetime as dt

from flowpanel.operators import features, windows

T0 = dt.datetime(2024, 1, 31, 23, 30)
STEP = dt.timedelta(minutes=15)


def test_windows_are_cut_in_generated_code(spark):
    # A gap after the 7th row, a series too short for a window, a series without a time in its first row.
    rows = [("a", T0 + (t + (t >= 7)) * STEP, float(t), None if t == 3 else 10.0 * t, -1.0 * t) for t in range(15)]
    rows += [("b", T0 + t * STEP, 1.0, 1.0, 1.0) for t in range(3)] + [("c", T0 + t * STEP if t else None, float(t), 0.0, 0.0) for t in range(6)]
    df = spark.createDataFrame(rows, "series_id string, date_time timestamp_ntz, usage double, p double, q double")
    for x in ("usage", ["usage", "p"]):
        cut = windows.sliding_windows(df, x=x, c_in=["p", "q"], c_out=["q"], size=4, hot=None)
        want = []
        for s in ("a", "b", "c"):
            own = sorted((r[1:] for r in rows if r[0] == s), key=lambda r: r[0] or dt.datetime.min)
            for k in range(len(own) - 3):
                part = own[k:k + 4]
                if part[0][0] and part[3][0] - part[0][0] == 3 * STEP:
                    usage, p, q = ([r[i] for r in part] for i in (1, 2, 3))
                    want.append((s, k, part[0][0], usage if x == "usage" else [usage, p], [p, q], [q]))
        assert sorted(map(tuple, cut.collect()), key=lambda r: r[:2]) == want and len(want) == 11
        # A slice inside a lambda is interpreted; a row with all lists is made for windows with a gap only if they are filtered later.
        plan = cut._jdf.queryExecution().executedPlan().toString()
        assert "lambdafunction(slice(" not in plan and "Filter" not in plan.split("Generate")[0]


def test_only_lists_asked_for_are_gathered(spark):
    rows = [("a", T0 + t * STEP, float(t), 10.0 * t, -1.0 * t) for t in range(8)]
    df = spark.createDataFrame(rows, "series_id string, date_time timestamp_ntz, usage double, p double, q double")
    cut = windows.day_windows(df, c_in=["p", "q"], c_out=["q"], size=4, hot=None)
    plan = cut.select("window_idx", "x")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 2
    got = cut.select("window_idx", "x", "c_in", "c_out").orderBy("window_idx").collect()
    assert [tuple(r) for r in got] == [
        (k, [v + 4 * k for v in (0.0, 1.0, 2.0, 3.0)], [[10 * (v + 4 * k) for v in range(4)], [-(v + 4 * k) for v in range(4)]],
         [[-(v + 4 * k) for v in range(4)]]) for k in range(2)]


def test_no_calendar_for_rows_that_go_or_columns_not_asked_for(spark):
    n = 192 + 3
    rows = [("a", T0 + t * STEP if t else None, 1.0, 15.0, 0.0, None if t == n - 1 else 0.0) for t in range(n)]
    panel = spark.createDataFrame(rows, "series_id string, date_time timestamp_ntz, usage double, temp_c double, precip_mm double, snow_cm double")
    done = features.build_features(panel, hot=None)
    plan = done.select("usage", "gdd_7d")._jdf.queryExecution().optimizedPlan()
    assert "SIN(" not in plan.toString() and "COS(" not in plan.toString()
    # Two rows have all lags; the last one lacks snow. The row without a time is dropped, or kept without a calendar.
    assert [r["date_time"] for r in done.collect()] == [T0 + t * STEP for t in (192, 193)]
    every = features.build_features(panel, hot=None, complete_only=False).where("month_sin is null").collect()
    assert len(every) == 1 and every[0]["date_time"] is None
