"""Sliding windows from blocks, time lags, changed files, archetypes as tables, histories, density, wide tables."""

import datetime as dt
import math
import os
import random
import tempfile

import numpy as np
import pytest
from flowpanel import schemas
from flowpanel.functions import kernels
from flowpanel.operators import compare, dtw, features, sampling, windows
from flowpanel.sources import panel, readings
from flowpanel.streaming.ingest import incremental_ingest, manifest
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)
STEP = dt.timedelta(minutes=15)


def series(spark, lengths, gap=None):
    """Series s0, s1, ... of so many rows; the steps in `gap` are missing."""
    rows = [(f"s{k}", T0 + i * STEP, float(i * (k + 1) % 17)) for k, n in enumerate(lengths) for i in range(n) if not gap or i not in gap]
    return spark.createDataFrame(rows, "series_id string, date_time timestamp_ntz, usage double")


@pytest.mark.parametrize("size, stride", [(8, 1), (8, 3), (8, 5), (8, 8), (8, 11), (5, 2)])
def test_windows_are_slices_of_blocks(spark, size, stride):
    df = series(spark, [40, 7, 8, 9, 0, 33], gap={13, 14})
    want = set()
    by = {}
    for r in sorted(df.collect(), key=lambda r: (r["series_id"], r["date_time"])):
        by.setdefault(r["series_id"], []).append((r["date_time"], r["usage"]))
    for s, rows in by.items():
        for p in range(0, len(rows) - size + 1, stride):
            cut = rows[p : p + size]
            if cut[-1][0] - cut[0][0] == (size - 1) * STEP:
                want.add((s, p // stride, cut[0][0], tuple(v for _, v in cut), tuple(-v for _, v in cut)))
    df = df.withColumn("minus", -F.col("usage"))
    hot = df.select("series_id").distinct().where("series_id in ('s0', 's3')")
    for plan in (None, hot):
        got = windows.day_windows(df, c_in=["minus"], c_out=[], size=size, stride=stride, hot=plan).collect()
        assert {(r["series_id"], r["window_idx"], r["window_start"], tuple(r["x"]), tuple(r["c_in"][0])) for r in got} == want and len(got) == len(want)


def test_sliding_windows_move_no_row_per_window(spark):
    df = series(spark, [50])
    plan = windows.sliding_windows(df, c_in=[], c_out=[], size=8, hot=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_time_lags_leave_gaps_empty(spark):
    df = series(spark, [60], gap=set(range(20, 26))).withColumnRenamed("usage", "v")
    df = df.union(df.limit(1).withColumn("v", F.lit(99.0))).union(spark.createDataFrame([("s0", None, 1.0), ("s9", T0, None)], df.schema))
    got = features.add_time_lags(df, "v", {"back_1": 1, "back_24": 24})
    assert got.columns == ["series_id", "date_time", "v", "back_1", "back_24"] and got.count() == df.count()
    seen = {r["date_time"]: r for r in got.where("series_id = 's0' and v < 99").collect()}
    step = lambda i: seen[T0 + i * STEP]
    assert step(26)["back_1"] is None and step(27)["back_1"] == float(26 % 17)
    assert step(44)["back_24"] is None and step(50)["back_24"] == float(26 % 17)
    assert step(1)["back_1"] == 99.0  # the larger value of a repeated instant
    assert step(19)["back_24"] is None and seen[None]["back_1"] is None
    by_row = {r["date_time"]: r["usage_15m"] for r in features.lag_usage(series(spark, [60], gap=set(range(20, 26))), hot=None).collect()}
    assert by_row[T0 + 26 * STEP] == float(19 % 17)


def land(spark, path, k, usage):
    """One file, moved into its place."""
    rows = [(f"s{k}", f"s{k}", T0, u, None, None, None, 1.0, 2.0) for u in usage]
    scratch = f"{tempfile.mkdtemp()}/one"
    spark.createDataFrame(rows, schemas.panel()).coalesce(1).write.parquet(scratch)
    os.replace(next(os.path.join(scratch, f) for f in os.listdir(scratch) if f.endswith(".parquet")), path)


def test_ingest_follows_changed_and_removed_files(spark, tmp_path):
    where, schema = tmp_path / "in here+%", schemas.panel()
    where.mkdir()

    def take(**options):
        df = incremental_ingest(spark, str(where), str(tmp_path / "out"), str(tmp_path / "state"), schema, **options)
        return sorted((r["series_id"], r["usage"]) for r in df.collect())

    assert take() == []
    for k in range(3):
        land(spark, where / f"f{k}.parquet", k, [float(k)])
    land(spark, where / "summary_of_all.parquet", 9, [9.0])
    assert take() == [("s0", 0.0), ("s1", 1.0), ("s2", 2.0)] == take(files_per_trigger=1)
    land(spark, where / "f1.parquet", 1, [1.5, 1.75])  # written anew under its name
    (where / "f2.parquet").unlink()
    (where / "deep").mkdir()
    land(spark, where / "deep" / "any name.parquet", 3, [3.0])
    assert take() == [("s0", 0.0), ("s1", 1.5), ("s1", 1.75), ("s3", 3.0)] == take()
    land(spark, where / "f2.parquet", 2, [2.25])  # comes back under its old name
    land(spark, where / "f0.parquet", 0, [])  # has no rows any more
    assert take() == [("s1", 1.5), ("s1", 1.75), ("s2", 2.25), ("s3", 3.0)] == take()
    assert manifest(spark, str(tmp_path / "state")).count() == 4
    (where / "f1.parquet").unlink()
    assert take() == [("s2", 2.25), ("s3", 3.0)]


def test_panel_scan_takes_all_names_but_summaries(spark, tmp_path):
    for k, name in enumerate(["m0", "meter_1", "x.parquet", "summary", "daily_summary.parquet"]):
        land(spark, tmp_path / (name if name.endswith("parquet") else f"{name}.parquet"), k, [float(k)])
    found = panel.scan_panel_dir(spark, str(tmp_path), schemas.panel())
    assert sorted(r["usage"] for r in found.collect()) == [0.0, 1.0, 2.0]
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        panel.scan_panel_dir(spark, str(tmp_path / "none"))


def test_count_comes_from_the_footers(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "n"))
    counted = panel.footer_count(spark, str(tmp_path / "n"))
    assert "PushedAggregation: [COUNT(*)]" in counted._jdf.queryExecution().executedPlan().toString().replace("PushedAggregation: [COUNT(1)]", "PushedAggregation: [COUNT(*)]")
    assert counted.first()[0] == 1000
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_unpivot_in_groups(spark, tmp_path):
    wide = spark.range(4).select(
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id * 15)").alias("date_time"),
        *[F.when((F.col("id") + k) % 3 > 0, (F.col("id") * 1000 + k).cast("double")).alias(f"c.{k:010d}") for k in range(130)])
    wide.write.parquet(str(tmp_path / "w"))
    want = sorted(map(tuple, readings.unpivot_readings(wide).collect()))
    got = readings.unpivot_in_groups(spark, str(tmp_path / "w"), str(tmp_path / "long"), columns=50)
    assert sorted(map(tuple, got.collect())) == want and got.columns == ["series_id", "meter_id", "date_time", "usage"]
    assert readings.unpivot_in_groups(spark, str(tmp_path / "w"), str(tmp_path / "none"), series=[]).count() == 0


def plain_barycenter(seqs, start, rounds, tolerance):
    centroid = list(start)
    for k in range(rounds):
        total, count = kernels.barycenter_sums(seqs, centroid, None)
        new = [t / n if n else c for t, n, c in zip(total, count, centroid)]
        moved = max(abs(a - b) for a, b in zip(new, centroid))
        centroid = new
        if moved < tolerance:
            return centroid, k + 1
    return centroid, rounds


def test_archetypes_of_many_keys_at_once(spark):
    rnd = random.Random(2)
    rows = []
    for month in (1, 2, 3):
        for source in ("Real", "Synthetic"):
            for h in range(9):
                seq = [float(rnd.choice([0, 0, 1, 2, 5])) for _ in range(12)] if h % 3 else [0.0] * 12  # a third are equal
                rows.append((month, source, f"h{h}", seq))
    df = spark.createDataFrame(rows, "month int, source string, home_id string, seq array<double>")
    keys = ("month", "source")
    start = {(r["month"], r["source"]): [] for r in df.collect()}
    for r in dtw.dba_archetype(df, keys, iterations=0).orderBy("step").collect():
        start[r["month"], r["source"]].append(r["value"])
    found = {}
    for r in dtw.dba_archetype(df, keys, iterations=6).orderBy("step").collect():
        found.setdefault((r["month"], r["source"]), []).append((r["value"], r["rounds"]))
    for key, values in found.items():
        want, rounds = plain_barycenter([s for m, x, _, s in rows if (m, x) == key], start[key], 6, 1e-3)
        assert np.allclose([v for v, _ in values], want) and {n for _, n in values} == {rounds}
    assert len(found) == 6


def test_weights_count_as_equal_sequences():
    seqs = [[0.0, 1.0, 4.0, 0.0], [0.0, 0.0, 2.0, 1.0]]
    many = kernels.barycenter_sums([seqs[0]] * 3 + [seqs[1]], seqs[1], None)
    once = kernels.barycenter_sums(seqs, seqs[1], None, [3, 1])
    assert np.allclose(many[0], once[0]) and (many[1] == once[1]).all()


def test_histories_meet_in_the_kernel(spark):
    rnd = random.Random(1)
    rows = [(s, h, T0 + i * STEP, float(rnd.choice([0, 1, 3]))) for s in ("Real", "Synthetic") for h in "ab" for i in range(500)]
    traces = spark.createDataFrame(rows, "source string, home_id string, time timestamp_ntz, usage double")
    histories = dtw.to_histories(traces, steps=64)
    assert histories.agg(F.max(F.size("seq"))).first()[0] == 64 and histories.count() == 4 * 8
    pairs = spark.createDataFrame([(1, "Real", "a", "Synthetic", "a"), (2, "Real", "b", "Synthetic", "a"), (3, "Real", "a", "Real", "a")],
                                  "pair_id int, source_a string, home_id_a string, source_b string, home_id_b string")
    seqs = {(s, h): [v for x, y, _, v in rows if (x, y) == (s, h)] for s in ("Real", "Synthetic") for h in "ab"}
    got = {r["pair_id"]: r["distance"] for r in dtw.history_distances(pairs, histories).collect()}
    want = kernels.dtw_distances([seqs["Real", "a"], seqs["Real", "b"], seqs["Real", "a"]], [seqs["Synthetic", "a"]] * 2 + [seqs["Real", "a"]], dtw.BAND)
    assert np.allclose([got[k] for k in (1, 2, 3)], want) and got[3] == 0


def test_match_by_part(spark):
    columns = spark.createDataFrame([("0012", 0, 5.0), ("a12b", 1, 6.0), ("0340", 2, 7.0), ("34", 3, 8.0), (None, 4, 9.0)], "name string, position int, peak double")
    homes = spark.createDataFrame([("012",), ("2",), ("34",), ("b",), ("77",), (None,), ("34",)], "home_id string")
    got = sorted((str(r["home_id"]), r["real_peak"]) for r in sampling.match_by_part(homes, columns).collect())
    assert got == [("012", 5.0), ("2", 5.0), ("34", 7.0), ("34", 7.0), ("77", 10.0), ("None", 10.0), ("b", 6.0)]
    exact = {r["home_id"]: r["real_peak"] for r in sampling.match_by_part(homes, columns, strip_zeros=False, fallback=None).collect()}
    assert exact["012"] == 5.0 and exact["77"] is None
    plan = sampling.match_by_part(homes, columns)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_density_is_a_density(spark):
    rnd = random.Random(7)
    rows = [("Real", math.exp(rnd.gauss(0, 1))) for _ in range(800)] + [("Synthetic", math.exp(rnd.gauss(1, 0.5))) for _ in range(300)] + [("Real", 0.0), ("Real", None)]
    got = compare.magnitude_density(spark.createDataFrame(rows, "source string, usage double"), 256)
    curves = {}
    for r in got.orderBy("point").collect():
        curves.setdefault(r["source"], []).append((r["x"], r["density"]))
    for source, curve in curves.items():
        x, y = map(np.array, zip(*curve))
        assert len(curve) == 256 and 0.9 < np.trapezoid(y, x) < 1.01
        v = np.log10([u for s, u in rows if s == source and u])
        bw = 0.9 * min(np.std(v, ddof=1), (np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.34) * len(v) ** -0.2
        at = x[100]
        assert abs(y[100] - np.mean(np.exp(-(((at - v) / bw) ** 2) / 2)) / bw / math.sqrt(2 * math.pi)) < 2e-3
    one = compare.magnitude_density(spark.createDataFrame([("Real", 10.0)], "source string, usage double"), 16).collect()
    assert len(one) == 16 and all(math.isfinite(r["density"]) for r in one)
    assert compare.magnitude_density(spark.createDataFrame([], "source string, usage double")).count() == 0
