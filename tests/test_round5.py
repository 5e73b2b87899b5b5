"""Ingest by file, wide readings in blocks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from flowpanel.operators import compare
from flowpanel.sources import readings
from flowpanel.streaming import ingest

T0 = dt.datetime(2024, 1, 31, 23, 30)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_paths_are_hashed_once_per_file(spark, tmp_path):
    for name, n in (("a b+c", 3), ("summary_x", 5), ("other", 2)):
        spark.range(n).write.parquet(str(tmp_path / "in" / name))
    rows = ingest._tagged(spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "in")))
    files = ingest.materialize(ingest._files(rows), "files")
    parted = ingest._parted(rows, files.where("path not like '%summary%'"))
    assert "md5" not in plan(parted) and "url_decode" not in plan(parted)
    assert parted.columns == ["id", ingest.FILE] and parted.count() == 5
    got = {r[0] for r in parted.join(files, ingest.FILE).select(F.regexp_extract("path", "/in/([^/]+)", 1)).distinct().collect()}
    assert got == {"a b+c", "other"}


def test_wide_readings_in_blocks_hold_the_same_rows(spark, tmp_path, monkeypatch):
    step = dt.timedelta(minutes=15)
    ids = [*[f"{k:010d}A" for k in range(7)], None]
    # Every series lacks another time, all but one the last; one reading comes twice, one is empty.
    rows = [(s, T0 + t * step, float(10 * k + t)) for k, s in enumerate(ids) for t in range(6) if t != k % 6 and (t < 5 or k == 0)]
    rows += [(ids[0], T0 + 2 * step, 99.0), (ids[1], T0 + 9 * step, None)]
    long = spark.createDataFrame(rows, "series_id string, date_time timestamp_ntz, usage double")
    want = {}
    for s, t, v in rows:
        key = (s or "null", t)
        want[key] = v if want.get(key) is None else max(want[key], v)
    names = readings.name_columns(long, columns=3)
    assert sorted(r["slot"] for r in names.where("block < 2").collect()) == [0, 0, 1, 1, 2, 2]
    readings.to_wide(long, names).write.parquet(str(tmp_path / "w"))
    wide = spark.read.parquet(str(tmp_path / "w"))
    assert wide.columns == ["date_time", "block", "s0", "s1", "s2"]
    times = {t for _, t, _ in rows}
    assert wide.count() == 3 * len(times)
    full = sorted((r["series_id"], r["meter_id"], r["date_time"], r["usage"]) for r in readings.unpivot_readings(wide, names=names).collect())
    assert full == sorted((s, s[:10], t, v) for (s, t), v in want.items() if v is not None)
    for columns in (1, 2):
        parts = readings.unpivot_in_groups(spark, str(tmp_path / "w"), str(tmp_path / f"g{columns}"), columns=columns, names=names)
        assert sorted(map(tuple, parts.collect())) == full
    one = readings.unpivot_in_groups(spark, str(tmp_path / "w"), str(tmp_path / "one"), series=[ids[3]], columns=2, names=names)
    assert sorted(map(tuple, one.collect())) == [r for r in full if r[0] == ids[3]]
    assert {r[0] for r in readings.list_series_ids(wide, names=names).collect()} == {s or "null" for s in ids}
    pairs = compare.pivot_longer_traces(wide, names=names).collect()
    assert len(pairs) == len(ids) * len(times)
    assert all(r["usage"] == want.get((r["home_id"], r["date_time"])) for r in pairs)
    executed = readings.longer_blocks(wide, names)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in executed and "BuildRight" in executed
    monkeypatch.setattr(readings, "BROADCAST_NAMES", 2)
    sorted_by_block = readings.unpivot_readings(wide, names=names)
    assert "SortMergeJoin" in sorted_by_block._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["series_id"], r["meter_id"], r["date_time"], r["usage"]) for r in sorted_by_block.collect()) == full
