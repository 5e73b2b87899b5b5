"""Readings hashed by series, and what is derived from them without moving a row per step."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from flowpanel.catalog import QUERIES
from flowpanel.catalog.inputs import Inputs
from flowpanel.operators import dtw, enrich
from flowpanel.sources import panel

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Twelve days of two users, one without a located meter, one event without a user and one without a time."""
    root = str(tmp_path_factory.mktemp("tables"))
    kinds = ["click", "purchase", "error"]
    rows = [(k, T0 + dt.timedelta(minutes=7 * k), 1 + k % 2, kinds[k % 3], float(k % 5) - 1) for k in range(2400)]
    rows += [(9001, T0 + dt.timedelta(hours=2), None, "click", 3.0), (9002, None, 1, "click", 4.0), (9003, T0, 1, "click", None)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    spark.createDataFrame(rows, schema).write.parquet(f"{root}/events.parquet")
    spark.createDataFrame([(1, 3), (17, 4)], "c_custkey bigint, c_nationkey int").write.parquet(f"{root}/customer.parquet")
    return root


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def moves(df) -> bool:
    return "Exchange hashpartitioning(series_id" in plan(df)


def test_readings_are_the_whole_grid(spark, tables):
    events = spark.read.parquet(f"{tables}/events.parquet").collect()
    want = {}
    for user in (1, 2, None):
        name = None if user is None else f"{user:010d}A"
        for k in range(12 * 96):
            t = T0 + dt.timedelta(minutes=15 * k)
            gap = t.hour == 5 and (user is None or (user * 31 + t.day) % 11 == 0)
            if not gap:
                want[name, t] = 0
    for e in events:
        if e["user_id"] is not None and e["ts"] is not None and (e["value"] or -1) >= 0:
            slot = e["ts"].replace(minute=e["ts"].minute // 15 * 15, second=0)
            key = (f"{e['user_id']:010d}A", slot)
            if key in want:
                want[key] += round(e["value"] * 100)
    rows = Inputs(spark, tables).readings().collect()
    assert len(rows) == len(want)
    assert {(r["series_id"], r["date_time"]): r["usage"] for r in rows} == {k: v / 100 for k, v in want.items()}


def test_windows_and_statistics_move_no_readings(spark, tables):
    i = Inputs(spark, tables)
    assert not moves(i.features())
    assert not moves(i.windows())
    assert "window_idx" not in "".join(line for line in plan(QUERIES["thin_rows"](spark, tables)).split("\n") if "Join" in line)


def test_locations_beyond_the_bound_give_the_same_rows(spark, tables):
    i = Inputs(spark, tables)
    many = i.locations().where("lat IS NOT NULL").unionByName(spark.range(50).select(
        F.concat(F.lit("x"), "id").alias("meter_id"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.lit(0).cast("bigint").alias("cell")))
    whole = enrich.join_locations(i.readings(), many)
    few = enrich.join_locations(i.readings(), many, broadcast_rows=5)
    none = enrich.join_locations(i.readings(), many, broadcast_rows=0)
    assert "BroadcastHashJoin" in plan(few)
    assert sorted(whole.collect()) == sorted(few.collect()) == sorted(none.collect()) != []


def test_a_meter_is_written_as_one_file(spark, tables):
    seen = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/by-meter-*"))
    assert QUERIES["id_from_path"](spark, tables).count() == 3
    (path,) = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/by-meter-*")) - seen
    assert len(glob.glob(f"{path}/d=meter_0000000001/*.parquet")) == 1


def test_shards_are_written_from_where_the_rows_are(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("series_id"), F.col("id").alias("window_idx")).coalesce(1)
    panel.shard_export(rows, str(tmp_path / "s"), 2)
    assert [len(glob.glob(f"{tmp_path}/s/shard={k}/*.parquet")) for k in range(2)] == [1, 1]
    assert spark.read.parquet(str(tmp_path / "s")).select("window_idx").distinct().count() == 1000


def test_histories_are_put_together_from_days(spark):
    times = [None, None, *[T0 + dt.timedelta(hours=k // 2) for k in range(100)]]
    rows = [("Real", home, t, float((k * 7) % 11)) for home in ("a", None) for k, t in enumerate(times)]
    traces = spark.createDataFrame(rows, "source string, home_id string, time timestamp_ntz, usage double")
    histories = dtw.to_histories(traces, steps=7)
    assert "Join" not in plan(histories)
    got = {}
    for r in sorted(histories.collect(), key=lambda r: r["block"]):
        assert len(r["seq"]) <= 7
        got.setdefault(r["home_id"], []).extend(r["seq"])
    own = [(t or dt.datetime.min, v) for _, home, t, v in rows if home == "a"]
    assert got == {home: [v for _, v in sorted(own)] for home in ("a", None)}
