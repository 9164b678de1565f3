"""Exact medians by rank, and hot groups in the outlier test, against plain computations."""

import random
import statistics

import pytest

from inspectra.operators import anomaly


def _rows(seed):
    rng = random.Random(seed)
    out = [(1, rng.gauss(0, 1)) for _ in range(5000)] + [(1, None)] * 50  # large, all different
    out += [(2, float(rng.choice([1, 1, 1, 2]))) for _ in range(4001)]  # large, ties over the middle
    out += [(3, 0.0)] * 1500 + [(3, 10.0)] * 1500  # the middle lies between two values
    out += [(4, 2.0 ** rng.randint(-60, 60) * rng.choice([-1, 1])) for _ in range(3000)]  # very uneven
    out += [(5, 7.5), (6, None), (7, 1.0), (7, 4.0), (8, 3.0), (8, 1.0), (8, 2.0), (None, 5.0)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_median_by_rank(spark, accuracy):
    rows = _rows(accuracy)
    df = spark.createDataFrame(rows, "k int, x double").repartition(7)
    got = {r.k: (r.med, r.n) for r in anomaly.median_by_rank(df, "x", ["k"], accuracy).collect()}
    # An unknown key is in no group, as in the joins of all tests.
    want = {k: (statistics.median(v), len(v)) for k in range(1, 9) if (v := [x for j, x in rows if j == k and x is not None])}
    assert got == want
    assert anomaly.median_by_rank(df.limit(0), "x", ["k"], accuracy).count() == 0


def test_hot_groups_change_nothing(spark):
    df = spark.createDataFrame([(k % 4, float((k * 7919) % 101) + (5000 if k % 97 == 0 else 0)) for k in range(3000)] + [(9, 1.0)] * 20, "g int, x double")
    assert anomaly.hot_groups(df, ["g"]) is None
    hot = anomaly.hot_groups(df, ["g"], 100)
    assert hot.count() == 4
    plain, split = (sorted(map(tuple, anomaly.outliers(df, "x", ["g"], hot=h).collect())) for h in (None, hot))
    assert plain == split and len(plain) == 4


def test_rows_meet_few_bounds_without_being_dealt(spark):
    """Up to `few` groups the bounds are broadcast; beyond, rows and bounds are dealt by group, with the same medians."""
    df = spark.createDataFrame(_rows(7), "k int, x double").repartition(7)
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        found = [anomaly.median_by_rank(df, "x", ["k"], 100, few=n) for n in (500_000, 2)]
        plans = [f._jdf.queryExecution().executedPlan().toString() for f in found]
        assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]
        one, two = (sorted(map(tuple, f.collect())) for f in found)
    finally:
        spark.conf.set(limit, before)
    assert one == two and len(one) == 7
