"""Warping in blocks of pairs side by side, rounding without decimals, inputs built once."""

import datetime as dt
import math
import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from flowpanel.catalog import QUERIES, registry
from flowpanel.functions import kernels
from flowpanel.operators import dtw, windows
from flowpanel.schemas import C_IN, C_OUT


def test_paths_of_a_block_keep_their_moves_once():
    rng = np.random.default_rng(5)
    x, y = rng.random((60, 300)), rng.random((60, 300))
    kernels.dtw_paths(x[:1], y[:1], None)
    tracemalloc.start()
    try:
        kernels.dtw_paths(x, y, None)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.3 * 599 * 300 * 60


def test_pairs_of_similar_lengths_are_warped_together(monkeypatch):
    rng = np.random.default_rng(6)
    lefts, rights = ([rng.random(n) for n in rng.integers(180, 192, 300)] for _ in range(2))
    calls, warp = [], kernels._warp
    monkeypatch.setattr(kernels, "_warp", lambda *a, **k: calls.append(1) or warp(*a, **k))
    together = kernels.dtw_distances(lefts, rights, 8)
    assert len(calls) <= 4
    alone = [kernels.dtw_distances([a], [b], 8)[0] for a, b in zip(lefts, rights)]
    assert np.array_equal(together, alone, equal_nan=True) and np.isnan(together).any()


def test_histories_of_many_pairs_are_warped_together(spark):
    rng = np.random.default_rng(7)
    homes = {(s, str(h)): rng.random(40 + h).round(2) for s in ("Real", "Synthetic") for h in range(12)}
    blocks = [(s, h, k // 16, v[k : k + 16].tolist()) for (s, h), v in homes.items() for k in range(0, len(v), 16)]
    histories = spark.createDataFrame(blocks, "source string, home_id string, block bigint, seq array<double>")
    rows = [(a * 12 + b, "Real", str(a), "Synthetic", str(b)) for a in range(12) for b in range(12)]
    rows += [(None, "Real", "3", "Synthetic", "4"), (999, "Real", "none", "Synthetic", "4")]
    pairs = spark.createDataFrame(rows, "pair_id bigint, source_a string, home_id_a string, source_b string, home_id_b string")
    found = dtw.history_distances(pairs, histories)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    got = {r["pair_id"]: r["distance"] for r in found.collect()}
    assert len(got) == len(rows) and got.pop(999) is None
    for i, _, a, _, b in rows[:-1]:
        want = kernels.dtw_distances([homes["Real", a]], [homes["Synthetic", b]], dtw.BAND)[0]
        assert got[i] == want or (got[i] is None and np.isnan(want))


def test_a_history_longer_than_a_batch(spark):
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(conf)
    values = np.random.default_rng(8).random((3, 50))
    blocks = [("x", str(h), k, values[h, k * 5 : k * 5 + 5].tolist()) for h in range(3) for k in range(10)]
    histories = spark.createDataFrame(blocks, "source string, home_id string, block bigint, seq array<double>")
    pairs = spark.createDataFrame([(f"{a}{b}", "x", str(a), "x", str(b)) for a in range(3) for b in range(3)],
                                  "pair_id string, source_a string, home_id_a string, source_b string, home_id_b string")
    try:
        spark.conf.set(conf, 3)
        got = {r["pair_id"]: r["distance"] for r in dtw.history_distances(pairs, histories).collect()}
    finally:
        spark.conf.set(conf, kept)
    assert got == {f"{a}{b}": kernels.dtw_distances([values[a]], [values[b]], dtw.BAND)[0] for a in range(3) for b in range(3)}


def test_fast_rounding_equals_round(spark):
    rng = random.Random(9)
    values = [None, 0.0, -0.0, 1e-9, -1e-9, float("nan"), float("inf"), -float("inf"), 1e11, -1e12, 1e300, 5e-324, 123456789.1234565]
    values += [(rng.randint(-10**8, 10**8) + 0.5) / 10**6 for _ in range(2000)]
    values += [math.nextafter((rng.randint(-10**7, 10**7) + 0.5) / 10**6, rng.choice([-9e9, 9e9])) for _ in range(2000)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 14) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (5, 6, 9):
        both = df.select("v", F.round("v", digits).alias("a"), registry.round_half_up(F.col("v"), digits).alias("b"))
        bad = both.where(~F.col("a").cast("string").eqNullSafe(F.col("b").cast("string")))
        assert bad.take(1) == []


def test_many_rounded_columns_are_no_single_method(spark):
    df = spark.range(3).select(*[(F.col("id") / (k + 3)).alias(f"c{k}") for k in range(20)])
    got = registry.rounded(df)
    plan = got._jdf.queryExecution().executedPlan()
    assert plan.toString().count("round(") >= 20 and not plan.getClass().getSimpleName().startswith("WholeStage")
    want = df.select(*[F.round(F.col(c) + 1e-9, 6).alias(c) for c in df.columns])
    assert got.collect() == want.collect()


def test_encoded_rows_cut_to_the_same_tensors_as_encoded_windows(spark):
    rng = random.Random(11)
    odd = [None, float("nan"), float("inf"), -float("inf")]
    start = dt.datetime(2024, 3, 1)
    columns = ["usage", *C_IN, *C_OUT]
    rows = []
    for s in range(12):
        for k in range(96 * 2 + 5):
            values = [max(0.0, rng.uniform(-1, 2)) for _ in columns]
            if s and k == 7 * s + 20:
                values[(5 * s) % len(columns)] = odd[s % 4]
            rows.append((f"s{s:02d}", start + dt.timedelta(minutes=15 * (k + (s == 11 and k > 150))), *values))
    schema = "series_id string, date_time timestamp_ntz, " + ", ".join(f"{c} double" for c in columns)
    features = spark.createDataFrame(rows, schema)
    stats = {f"{c}_{s}": 0.5 + 0.1 * n for n, c in enumerate(["log", *C_OUT]) for s in ("mean", "std")}
    got = windows.training_tensors(features, stats, None)
    assert "forall" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = windows.finite_windows(windows.encode_windows(windows.day_windows(features, hot=None), stats))
    key = lambda r: (r["series_id"], r["window_idx"])
    got, want = (sorted(d.collect(), key=key) for d in (got, want))
    assert len(want) < 24 and got == want


def test_windows_whose_rows_all_meet_a_condition(spark):
    start = dt.datetime(2024, 3, 1)
    ok = [k not in (6, 17) if k != 18 else None for k in range(30)]
    rows = [("a", start + dt.timedelta(minutes=15 * k), float(k), ok[k]) for k in range(30)]
    df = spark.createDataFrame(rows, "series_id string, date_time timestamp_ntz, usage double, ok boolean")
    for stride in (4, 1):
        cut = windows.day_windows(df, c_in=[], c_out=[], size=4, stride=stride, hot=None, require="ok")
        assert cut.columns == ["series_id", "window_idx", "window_start", "x"]
        want = [[float(v) for v in range(k, k + 4)] for k in range(0, 27, stride) if all(ok[k : k + 4])]
        assert sorted(r["x"] for r in cut.collect()) == want


def _tables(spark, folder) -> str:
    """Six users with events on three days, and their locations."""
    start = dt.datetime(2024, 1, 1, 0, 5)
    kinds = ["click", "purchase", "error"]
    events = [(k, start + dt.timedelta(minutes=47 * (k // 6)), k % 6, kinds[k % 3], float(k % 11)) for k in range(540)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double") \
        .write.parquet(f"{folder}/events.parquet")
    places = [(k, f"c{k}", k % 3, "BUILDING") for k in range(1, 6)]
    spark.createDataFrame(places, "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string") \
        .write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_predictors_are_made_once(spark, monkeypatch, tmp_path):
    from flowpanel.catalog import evaluation_queries

    calls, kept = [], evaluation_queries.materialize
    monkeypatch.setattr(evaluation_queries, "materialize", lambda df, name: calls.append(name) or kept(df, name))
    result = QUERIES["normalize_predictors"](spark, _tables(spark, tmp_path))
    assert calls == ["predictors", "predictor-split"]
    assert result.count() == 6 and "readings" not in result._jdf.queryExecution().optimizedPlan().toString()


def test_summary_is_made_from_the_written_panel(spark, monkeypatch, tmp_path):
    from flowpanel.catalog import panel_queries

    seen, kept = [], panel_queries.stats.panel_summary
    monkeypatch.setattr(panel_queries.stats, "panel_summary", lambda df: seen.extend(df.inputFiles()) or kept(df))
    assert QUERIES["scan_panel_dir"](spark, _tables(spark, tmp_path)).count() > 0
    assert seen and all("panel-dir" in f for f in seen)
