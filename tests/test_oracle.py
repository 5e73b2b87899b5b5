"""Every registered query against its SQL at the smallest scale."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry
from flowpanel.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in entry.oracle_sql():
        assert difference(df, con, entry.oracle_sql()[name]) is None
    else:
        assert df.count() > 0


ORDERED = ["lag_temp", "lag_usage", "rolling_sums", "build_features", "day_windows", "sliding_windows",
           "training_tensors", "autocorrelation", "burst_stats", "interarrival"]


@pytest.mark.parametrize("name", ORDERED)
def test_long_series_plan_gives_the_same(spark, con, name, monkeypatch):
    """Every second series counts as too long for one task and is cut into buckets of 1,000 rows."""
    from flowpanel.catalog import Inputs
    from flowpanel.plans import ordered

    monkeypatch.setattr(ordered, "BUCKET_ROWS", 1000)
    ids = Inputs(spark, SF).readings().select("series_id").distinct()
    hot = ids.where("cast(substring(series_id, 1, 10) as int) % 2 = 0")
    monkeypatch.setattr(Inputs, "hot", lambda self: hot)
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 343 * 96


def test_names():
    """The names of the training-data queries are not used by the library itself."""
    assert not [n for n in QUERIES if "pipeline" in n or n.startswith("op")]
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
