"""Distances, ranks, sampling, classifiers and generation against simple references."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowpanel import schemas
from flowpanel.functions import hashing, kernels
from flowpanel.operators import adversarial, compare, dtw, generative, sampling, stats
from flowpanel.plans import ranks
from flowpanel.session import spread
from flowpanel.sources import files, panel, readings
from flowpanel.streaming.ingest import incremental_ingest

T0 = dt.datetime(2024, 1, 1)


def naive_dtw(x, y, band=None):
    n, m = len(x), len(y)
    g = np.full((n, m), np.inf)
    for i in range(n):
        for j in range(m):
            if band is not None and abs(i - j) > band:
                continue
            d = abs(x[i] - y[j])
            if i == j == 0:
                g[i, j] = d
                continue
            best = np.inf
            if i and j:
                best = min(best, g[i - 1, j - 1] + 2 * d)
            if j:
                best = min(best, g[i, j - 1] + d)
            if i:
                best = min(best, g[i - 1, j] + d)
            g[i, j] = best
    return g[-1, -1]


floats = st.lists(st.floats(0, 10, allow_nan=False), min_size=1, max_size=12)


@settings(max_examples=150, deadline=None)
@given(floats, floats, st.one_of(st.none(), st.integers(0, 6)))
def test_warp_equals_naive(x, y, band):
    got = kernels.dtw_distances([x], [y], band)[0]
    want = naive_dtw(x, y, band)
    assert (math.isnan(got) and math.isinf(want)) or got == pytest.approx(want)


@settings(max_examples=60, deadline=None)
@given(floats, floats)
def test_path_is_monotone_and_costs_its_distance(x, y):
    cost, cells = kernels.dtw_paths(np.array([x]), np.array([y]), None)
    path = [(int(i[0]), int(j[0])) for i, j, _ in reversed(cells)]
    assert path[0] == (0, 0) and path[-1] == (len(x) - 1, len(y) - 1)
    total = abs(x[0] - y[0])
    for (a, b), (c, d) in itertools.pairwise(path):
        assert (c - a, d - b) in ((1, 1), (0, 1), (1, 0))
        total += abs(x[c] - y[d]) * (2 if (c - a, d - b) == (1, 1) else 1)
    assert total == pytest.approx(cost[0])


def test_warp_in_blocks_equals_one_block(monkeypatch):
    rng = np.random.default_rng(1)
    seqs = [rng.random(30) for _ in range(100)]
    whole = kernels.dtw_distances(seqs, seqs[::-1], 4)
    total, count = kernels.barycenter_sums(seqs, seqs[0], None)
    monkeypatch.setattr(kernels, "BLOCK_CELLS", 1)
    assert np.allclose(kernels.dtw_distances(seqs, seqs[::-1], 4), whole)
    again = kernels.barycenter_sums(seqs, seqs[0], None)
    assert np.allclose(again[0], total) and (again[1] == count).all()


def test_dtw_column(spark):
    shifted, impulse = [0.0] * 20, [0.0] * 20
    impulse[8], shifted[9] = 5.0, 5.0
    df = spark.createDataFrame([(impulse, impulse), (impulse, shifted), ([1.0] * 30, [1.0] * 5), (impulse, None)],
                               "a array<double>, b array<double>")
    got = [r[0] for r in df.select(dtw.dtw_distance("a", "b", 8)).collect()]
    assert got == [0.0, 0.0, None, None]


def traces(spark, homes=12, steps=20, seed=3):
    rng = random.Random(seed)
    rows = []
    for source in ("Real", "Synthetic"):
        for h in range(homes):
            for s in range(steps):
                usage = float(rng.choice([0, 0, 1, 2, 5])) * (1.5 if source == "Synthetic" else 1)
                rows.append((f"{h:03d}", T0 + dt.timedelta(minutes=15 * s), usage, source))
    return spark.createDataFrame(rows, "home_id string, time timestamp_ntz, usage double, source string")


def test_dba_of_equal_sequences_is_the_sequence(spark):
    df = spark.createDataFrame([("Real", str(k), [1.0, 2.0, 7.0, 2.0]) for k in range(5)], "source string, home_id string, seq array<double>")
    got = dtw.dba_archetype(df).orderBy("step").collect()
    assert [r["value"] for r in got] == [1.0, 2.0, 7.0, 2.0]


def test_equal_sequences_are_spread_after_their_grouping(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 2).alias("source"), F.array(F.col("id") % 200).alias("seq"))
    equal = rows.groupBy("source", "seq").agg(F.count(F.lit(1)).alias("weight"))
    spread(equal, "source", "seq").write.parquet(str(tmp_path / "spread"))
    files = spark.read.parquet(str(tmp_path / "spread")).groupBy(F.input_file_name()).count().collect()
    assert len(files) == 4 and sum(r["count"] for r in files) == 200


def test_dba_deals_its_sequences_to_several_tasks(spark, monkeypatch):
    kept, materialize = {}, dtw.materialize

    def noted(df, name):
        back = materialize(df, name)
        if name == "dba-sequences":
            kept["files"] = back.select(F.input_file_name().alias("f")).distinct().count()
            kept["rows"] = back.count()
        return back

    monkeypatch.setattr(dtw, "materialize", noted)
    seqs = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, "Real").otherwise("Synthetic").alias("source"), F.col("id").cast("string").alias("home_id"),
        F.sequence(F.col("id"), F.col("id") + 95).alias("seq"))
    got = dtw.dba_archetype(seqs, iterations=1).collect()
    assert len(got) == 192 and kept["rows"] == 3000 and kept["files"] > 1


def test_dba_is_independent_of_partitions_and_equals_one_round_by_hand(spark):
    seqs = dtw.to_sequences(traces(spark))
    a = dtw.dba_archetype(seqs.repartition(1)).orderBy("source", "step").collect()
    b = dtw.dba_archetype(seqs.repartition(7)).orderBy("source", "step").collect()
    assert [(r["source"], r["step"], round(r["value"], 9)) for r in a] == [(r["source"], r["step"], round(r["value"], 9)) for r in b]
    # One round by hand: each value joins the steps of the centroid that its path visits.
    start = [r["value"] for r in dtw.dba_archetype(seqs, iterations=0).where("source = 'Real'").orderBy("step").collect()]
    once = [r["value"] for r in dtw.dba_archetype(seqs, iterations=1).where("source = 'Real'").orderBy("step").collect()]
    members = [[] for _ in start]
    for r in seqs.where("source = 'Real'").collect():
        _, cells = kernels.dtw_paths(np.array([start]), np.array([r["seq"]]), None)
        for i, j, _ in cells:
            members[int(i[0])].append(r["seq"][int(j[0])])
    assert np.allclose(once, [np.mean(m) for m in members])


def test_alignment_and_segments(spark):
    rows = [("Real", k, v) for k, v in enumerate([0.0, 4.0, 0.0])] + [("Synthetic", k, v) for k, v in enumerate([0.0, 0.0, 4.0])]
    arch = spark.createDataFrame(rows, "source string, step int, value double")
    path = dtw.dtw_alignment_path(arch)
    cells = [(r["index1"], r["index2"]) for r in path.orderBy("pos").collect()]
    assert cells[0] == (1, 1) and cells[-1] == (3, 3) and (2, 3) in cells
    seg = dtw.mapping_segments(path, arch).orderBy("pos").collect()
    assert seg[0]["y_start"] == 0.0 and seg[0]["y_end"] == 6.0
    assert dtw.thin_rows(path).count() == len(cells) // 2


def test_pairs_and_monthly(spark):
    t = traces(spark)
    sampled = dtw.sample_sequences(t, n_sample=5)
    assert {r["n"] for r in sampled.groupBy("source").agg(F.count("*").alias("n")).collect()} == {5}
    pairs = dtw.sample_pairs(sampled, n_pairs=50)
    again = dtw.sample_pairs(dtw.sample_sequences(t.repartition(9), n_sample=5), n_pairs=50)
    cols = ["comparison", "pair_id", "id_a", "id_b"]
    assert pairs.count() == 150 and pairs.select(cols).exceptAll(again.select(cols)).count() == 0
    got = {r["comparison"]: r for r in dtw.monthly_dtw(t, n_pairs=40).collect()}
    assert set(got) == set(dtw.COMPARISONS) and all(r["month"] == 1 and r["mean_distance"] >= 0 for r in got.values())


def test_monthly_archetypes_and_alignment(spark):
    """Equal homes within a month: the archetype is the home, and its alignment that of the two curves."""
    curves = {(1, "Real"): [0.0, 0.0, 4.0], (1, "Synthetic"): [0.0, 4.0, 4.0],
              (2, "Real"): [1.0, 2.0, 3.0, 9.0], (2, "Synthetic"): [1.0, 2.0, 3.0, 9.0]}
    rows = [(f"h{k}", T0 + dt.timedelta(days=31 * (month - 1), minutes=15 * i), v, source, month)
            for (month, source), curve in curves.items() for k in range(4) for i, v in enumerate(curve)]
    t = spark.createDataFrame(rows, "home_id string, time timestamp_ntz, usage double, source string, month int")
    arch = dtw.monthly_archetypes(t)
    got = {}
    for r in arch.orderBy("step").collect():
        got.setdefault((r["month"], r["source"]), []).append(r["value"])
    assert got == curves
    path = dtw.dtw_alignment_path(arch, ("month",)).orderBy("month", "pos").collect()
    cells = {m: [(r["index1"], r["index2"]) for r in path if r["month"] == m] for m in (1, 2)}
    assert cells[2] == [(1, 1), (2, 2), (3, 3), (4, 4)] and cells[1][0] == (1, 1) and cells[1][-1] == (3, 3) and (3, 2) in cells[1]
    assert {r["distance"] for r in path} == {0.0}
    assert dtw.mapping_segments(dtw.dtw_alignment_path(arch, ("month",)), arch, ("month",)).count() == len(path)


def test_infinity_has_a_place_in_the_order(spark):
    from flowpanel.plans import ranks

    inf = float("inf")
    df = spark.createDataFrame([("a", v) for v in (-inf, -1e308, 0.0, 1e308, inf)], "g string, v double")
    buckets = [r[0] for r in df.orderBy("v").select(ranks.value_bucket("v")).collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) == 5
    assert ranks.exact_quantile(df, ["g"], "v", 0.5, "q").collect()[0]["q"] == 0.0


def test_path_blocks_are_bounded_for_a_month_of_steps():
    from flowpanel.functions import kernels

    for n in (2976, 300):
        size = max(map(len, kernels._blocks(list(range(2000)), n, n, None, keep_steps=True)))
        assert size * 2 * n * n <= kernels.BLOCK_MOVES
    x = [np.arange(40.0) % 7 for _ in range(30)]
    whole = kernels.barycenter_sums(x, x[0], None)
    old, kernels.BLOCK_MOVES = kernels.BLOCK_MOVES, 1
    try:
        one = kernels.barycenter_sums(x, x[0], None)
    finally:
        kernels.BLOCK_MOVES = old
    assert np.allclose(whole[0], one[0]) and (whole[1] == one[1]).all()


def test_sample_homes(spark):
    t = traces(spark)
    a = sampling.sample_homes(t, 4)
    assert a.count() == 8 and a.distinct().count() == 8
    assert a.exceptAll(sampling.sample_homes(t.repartition(11), 4)).count() == 0
    assert sampling.sample_homes(t, 100).count() == 24


def w1(a, b):
    a, b = np.sort(a), np.sort(b)
    xs = np.sort(np.concatenate([a, b]))
    fa = np.searchsorted(a, xs[:-1], side="right") / len(a)
    fb = np.searchsorted(b, xs[:-1], side="right") / len(b)
    return float(np.sum(np.abs(fa - fb) * np.diff(xs)))


def test_wasserstein(spark):
    def distance(a, b):
        rows = [(float(v), "Real") for v in a] + [(float(v), "Synthetic") for v in b]
        return compare.wasserstein_1d(spark.createDataFrame(rows, "usage double, source string")).first()[0]

    # {0, 1} against {0, 1, 1}, moved by one because zeros are left out of the comparison.
    assert distance([1, 2], [1, 2, 2]) == pytest.approx(1 / 6)
    assert distance([1, 2, 0, 0], [1, 2]) == 0.0
    rng = np.random.default_rng(2)
    a, b = rng.lognormal(0, 2, 300), rng.lognormal(0.5, 1, 211)
    assert distance(a, b) == pytest.approx(w1(a, b)) == pytest.approx(distance(b, a))


def test_exact_quantile_and_ranks(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([0.0, 0.0, rng.lognormvariate(0, 3), -rng.random()])) for g in "abc" for _ in range(137)]
    rows += [("one", 5.0), ("nan", float("nan")), ("nan", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["q"] for r in ranks.exact_quantile(df, ["g"], "v", 0.9, "q").collect()}
    for g in "abc":
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g], 0.9))
    assert got["one"] == 5.0 and got["nan"] == 2.0


def test_dense_position_split_equals_single(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("a"), F.concat(F.lit("h"), F.col("id")).alias("b"))
    one = ranks.dense_position(df, ["a", "b"], "k")
    many = ranks.dense_position(df, ["a", "b"], "k", single_task_rows=10)
    assert one.exceptAll(many).count() == 0 and many.agg(F.max("k")).first()[0] == 5000


def test_best_of_n_first_wins_ties(spark):
    cand = spark.createDataFrame([("h", 0, [1.0, 4.0]), ("h", 1, [6.0, 0.0]), ("h", 2, [3.0, 1.0])], "home_id string, candidate_id int, x array<double>")
    target = spark.createDataFrame([("h", 5.0)], "home_id string, real_peak double")
    best = sampling.best_of_n(cand, target).first()
    assert (best["candidate_id"], best["diff"]) == (0, 1.0)
    homes = spark.createDataFrame([("0042",), ("7",)], "home_id string")
    peaks = spark.createDataFrame([("42", 3.5)], "real_id string, peak double")
    assert {r["home_id"]: r["real_peak"] for r in sampling.match_real_peak(homes, peaks).collect()} == {"0042": 3.5, "7": 10.0}


def test_split_folds_and_auc(spark):
    t = traces(spark, homes=50)
    feats = adversarial.labelled(stats.adversarial_features(t))
    split = adversarial.stratified_split(feats)
    assert {(r[0], r[1]): r[2] for r in split.groupBy("source", "is_train").count().collect()} == {
        ("Real", True): 40, ("Real", False): 10, ("Synthetic", True): 40, ("Synthetic", False): 10}
    folds = adversarial.stratified_kfold(feats, 10).groupBy("source", "fold").count().collect()
    assert len(folds) == 20 and {r["count"] for r in folds} == {5}
    same = adversarial.stratified_split(feats.repartition(13)).where("is_train").select("source", "home_id")
    assert same.exceptAll(split.where("is_train").select("source", "home_id")).count() == 0
    train, test = adversarial.split_and_fold(stats.adversarial_features(t), 2)
    rf = adversarial.adversarial_rf(train, test, trees=10, folds=2, subsets=("2",), min_rows=(1,), depth=4)
    gbt = adversarial.adversarial_gbt(train, test, rounds=3, folds=2, depths=(2,), rates=(0.1,))
    metrics = {(r["model"], r["metric"]): r["estimate"] for r in adversarial.adversarial_metrics([rf, gbt]).collect()}
    from pyspark.ml.functions import vector_to_array

    scored = rf.predictions.select("label", vector_to_array("probability")[1].alias("p")).collect()
    pos, neg = [r["p"] for r in scored if r["label"]], [r["p"] for r in scored if not r["label"]]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert metrics["random_forest", "roc_auc"] == pytest.approx(auc)
    weights = adversarial.feature_importance([rf, gbt]).collect()
    assert [r["feature"] for r in weights] == adversarial.PREDICTORS
    assert sum(r["importance"] for r in weights) == pytest.approx(1.0)


def test_hashed_noise_moments_and_partitions(spark):
    df = spark.range(40000)
    row = df.select(hashing.normal(1, "id").alias("z"), hashing.uniform(1, "id").alias("u")).agg(
        F.avg("z"), F.stddev("z"), F.avg("u"), F.stddev("u"), F.kurtosis("z")).first()
    assert row[0] == pytest.approx(0, abs=0.02) and row[1] == pytest.approx(1, abs=0.02)
    assert row[2] == pytest.approx(0.5, abs=0.01) and row[3] == pytest.approx(12**-0.5, abs=0.01)
    assert row[4] == pytest.approx(0, abs=0.1)


def tensors(spark, n=60):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(n):
        z = rng.normal(1.0, 0.5, 8)
        mask = (rng.random(8) < 0.5).astype(float)
        rows.append((f"s{k}", 0, 1, [mask.tolist(), z.tolist()]))
    return spark.createDataFrame(rows, "series_id string, window_idx bigint, stratum int, x array<array<double>>")


def test_schedule_and_forward_noise(spark):
    sched = [r for r in generative.noise_schedule(spark).orderBy("t").collect()]
    betas = np.linspace(1e-4, 0.02, 1000)
    assert len(sched) == 1000 and np.allclose([r["alpha_hat"] for r in sched], np.cumprod(1 - betas))
    t = tensors(spark)
    noised = generative.forward_noise(t, generative.noise_schedule(spark))
    rows = {r["series_id"]: r for r in noised.collect()}
    again = {r["series_id"]: r for r in generative.forward_noise(t.repartition(9), generative.noise_schedule(spark)).collect()}
    assert rows == again
    eps = np.array([r["eps"] for r in rows.values()]).ravel()
    assert abs(eps.mean()) < 0.1 and abs(eps.std() - 1) < 0.1
    r = rows["s3"]
    a = r["alpha_hat"]
    want = math.sqrt(a) * np.array(r["x"]) + math.sqrt(1 - a) * np.array(r["eps"])
    assert np.allclose(r["x_t"], want) and 0 <= r["t"] < 1000


def test_reverse_sampling_matches_its_prior(spark):
    t = tensors(spark)
    fitted = generative.fit_gaussian(t, ["stratum"])
    arrays = generative.gaussian_arrays(fitted, ["stratum"])
    scenarios = spark.range(400).select(F.col("id").alias("sample_id"), F.lit(1).alias("stratum")).join(arrays, "stratum")
    a = generative.reverse_sample(scenarios, temperature=1.0, steps=300, last=0.06, partitions=3)
    b = generative.reverse_sample(scenarios.repartition(2), temperature=1.0, steps=300, last=0.06, partitions=5)
    left = {r["sample_id"]: r["x"] for r in a.collect()}
    right = {r["sample_id"]: r["x"] for r in b.collect()}
    assert left.keys() == right.keys() and all(np.allclose(left[k], right[k]) for k in left)
    x = np.array(list(left.values()))
    prior = arrays.first()
    assert np.allclose(x.mean(axis=0), prior["mu"], atol=0.15)
    assert np.allclose(x.var(axis=0), prior["var"], atol=0.15)

    def zero(x, t, alpha_hat, batch):
        return x * 0

    assert generative.reverse_sample(scenarios, steps=5, predictor=zero).count() == 400


def test_gaussian_noise_column_equals_kernel(spark):
    rng = np.random.default_rng(1)
    x, mu, var = rng.normal(size=4), rng.normal(size=4), rng.random(4)
    df = spark.createDataFrame([(x.tolist(), mu.tolist(), var.tolist())], "x array<double>, mu array<double>, var array<double>")
    got = df.select(generative.gaussian_noise(F.col("x"), F.lit(0.3), F.col("mu"), F.col("var"))).first()[0]
    assert np.allclose(got, kernels.gaussian_noise_estimate(x, 0, 0.3, {"mu": mu, "var": var}))


def test_baseline_moments(spark):
    homes = spark.range(400).select(F.col("id").cast("string").alias("home_id"))
    profile = spark.range(96).select(F.col("id").cast("int").alias("interval"), F.lit(30.0).alias("temp_c"))
    got = generative.synthetic_baseline(homes, profile)
    row = got.agg(F.avg(F.when(F.col("usage") == 0, 1).otherwise(0)), F.avg(F.when(F.col("usage") > 0, F.log("usage"))), F.count("*")).first()
    assert row[0] == pytest.approx(0.6, abs=0.01) and row[1] == pytest.approx(-0.5, abs=0.03) and row[2] == 400 * 96
    assert got.exceptAll(generative.synthetic_baseline(homes.repartition(7), profile)).count() == 0


def test_scenario_defaults(spark):
    stats_ = {"log_mean": 0.5, "log_std": 1.0, "temp_c_mean": 10.0, "temp_c_std": 5.0}
    df = spark.createDataFrame([(1, 2, 0.0, 0.3)], "month int, dow int, temp_c double, snow_cm double")
    row = generative.scenario_encode(df, stats_).first()
    assert len(row["c_in"]) == 12 and len(row["c_out"]) == 10 and {len(v) for v in [*row["c_in"], *row["c_out"]]} == {96}
    assert row["c_out"][0][0] == pytest.approx(-2.0, abs=1e-5) and row["c_out"][6][0] == 1.0
    assert row["c_in"][4][24] == pytest.approx(1.0)


def test_labels_follow_first_appearance(spark):
    rows = [("002", T0, 1.0, "Real"), ("001", T0 + dt.timedelta(hours=1), 1.0, "Real"), ("3", T0, 1.0, "Synthetic"), ("2", T0, 1.0, "Synthetic")]
    df = spark.createDataFrame(rows, "home_id string, time timestamp_ntz, usage double, source string")
    assert {r["home_id"]: r["label"] for r in compare.home_labels(df).collect()} == {"2": "Home 1", "1": "Home 2", "3": "Home 3"}


def test_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.scan_by_extension(spark, str(tmp_path))
    wide = spark.createDataFrame([(T0, 1.0, None), (T0 + dt.timedelta(minutes=15), 2.0, 3.0)], "date_time timestamp_ntz, `01` double, `a.b` double")
    files.write_samples_csv(wide, str(tmp_path / "csv"))
    back = files.read_trace_csv(spark, str(tmp_path / "csv"))
    assert back.schema == wide.schema and back.exceptAll(wide).count() == 0
    assert files.scan_by_extension(spark, str(tmp_path / "csv")).count() == 2
    assert sorted(r[0] for r in files.read_trace_csv(spark, str(tmp_path / "csv"), "01").select("usage").collect()) == [1.0, 2.0]
    long = readings.unpivot_readings(wide)
    assert sorted(tuple(r)[0] for r in long.collect()) == ["01", "01", "a.b"]
    assert compare.pivot_longer_traces(wide).count() == 4
    assert [r[0] for r in readings.list_series_ids(wide).collect()] == ["01", "a.b"]


def test_hot_series_spans_files_and_shards(spark, tmp_path):
    rows = spark.range(20000).select(
        F.when(F.col("id") < 15000, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("series_id"),
        F.col("id").alias("window_idx"), (F.lit(T0) + F.make_dt_interval(secs=F.col("id"))).alias("date_time"))
    panel.write_panel(rows, str(tmp_path / "p"), files=4)
    sizes = spark.read.parquet(str(tmp_path / "p")).groupBy(F.col("_metadata.file_name")).count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 8000
    panel.shard_export(rows, str(tmp_path / "s"), 4)
    shards = spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().collect()
    assert len(shards) == 4 and max(r["count"] for r in shards) < 6000
    panel.shard_export(rows, str(tmp_path / "t"), 2, files_per_shard=3)
    parts = spark.read.parquet(str(tmp_path / "t")).groupBy("shard").agg(F.count_distinct("_metadata.file_name").alias("f")).collect()
    assert len(parts) == 2 and all(r["f"] >= 2 for r in parts)


def test_ingest_takes_each_file_once(spark, tmp_path):
    schema = schemas.panel()
    def land(k):
        spark.createDataFrame([(f"s{k}", f"s{k}", T0, 1.0, None, None, None, 1.0, 2.0)], schema).write.parquet(str(tmp_path / "in" / f"m{k}"))
        return incremental_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), schema).count()

    assert [land(0), land(1), land(2)] == [1, 2, 3]
