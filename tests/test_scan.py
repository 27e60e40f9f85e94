"""Folds of keys that are cut into pieces: equal to loops, and to the same fold of whole keys; medians from counts."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tideway.operators import scan, series, state
from tideway.plans.storage import keeper


@pytest.fixture
def keep(spark):
    """Pieces stay apart, as those of large tables would."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield keeper(spark)
    spark.conf.set(name, before)


def times(rng, hot=400):
    """One key with most of the rows, a null key, and small ones."""
    return [("hot", rng.randrange(100_000)) for _ in range(hot)] + [(None, rng.randrange(500)) for _ in range(20)] + [(f"k{i % 9}", rng.randrange(5_000)) for i in range(60)] + [("once", 5)]


def test_what_came_before_a_piece(spark, keep):
    rng = random.Random(1)
    rows = [(k, t, i) for i, (k, t) in enumerate(times(rng))]
    cut = scan.Pieces(spark.createDataFrame(rows, "k string, t long, n long"), ["k"], ["t", "n"], keep, 7)
    sizes = [r["count"] for r in cut.rows.groupBy("_piece").count().collect()]
    assert len(sizes) == 7 and max(sizes) < len(rows) / 3
    assert cut.rows.where("k = 'hot'").select("_piece").distinct().count() > 3
    got = cut.carried(top=(F.max("t"), F.max), n_before=(F.count("*"), F.sum), last_n=(F.max_by("n", F.struct("t", "n")), scan.last)).collect()
    for r in got:
        before = [x for x in got if x.k == r.k and x._piece < r._piece]
        want = (max(x.t for x in before), len(before), max(before, key=lambda x: (x.t, x.n)).n) if before else (None, None, None)
        assert (r.top, r.n_before, r.last_n) == want
    assert len(got) == len(rows)
    found = sorted((r.k or "", r.t, r.n, r.b) for r in cut.with_before("t", "b").collect())
    order = sorted((k or "", t, n) for k, t, n in rows)
    assert found == [(*x, order[i - 1][1] if i and order[i - 1][0] == x[0] else None) for i, x in enumerate(order)]


def test_key_that_is_small_is_one_piece(spark, keep, monkeypatch):
    frame = spark.createDataFrame([("a", 1), ("a", 2)], "k string, t long")
    assert scan.Pieces(frame, ["k"], ["t"], keep).one
    monkeypatch.setattr(scan, "MOST", 1)
    assert not scan.Pieces(frame, ["k"], ["t"], keep).one


def test_averages_and_cadence_in_pieces(spark, keep):
    rows = times(random.Random(2))
    frame = spark.createDataFrame(rows, "k string, t long")
    mean, middle = {}, {}
    for k in {k for k, _ in rows}:
        at = sorted(t for q, t in rows if q == k)
        gaps = [b - a for a, b in zip(at, at[1:], strict=False)]
        m = None
        for g in (g for g in gaps if g >= 30):
            m = float(g) if m is None else m + 0.3 * (g - m)
        mean[k] = (m, sum(g >= 30 for g in gaps))
        if any(gaps):
            middle[k] = statistics.median_high([g for g in gaps if g > 0])
    for pieces in (None, 6):
        got = {r.k: (r.ewma, r.n_gaps) for r in series.ewma(frame.where("k is not null"), "k", "t", keep=keep, pieces=pieces).collect()}
        assert got == {k: (None if m is None else pytest.approx(m), n) for k, (m, n) in mean.items() if k is not None}
        assert {r.k: r.cadence for r in series.cadence(frame, "k", "t", keep, pieces).collect()} == middle


def test_as_of_in_pieces(spark, keep):
    rng = random.Random(3)
    left, right = [(i, k, t) for i, (k, t) in enumerate(times(rng))], [(k, t, i) for i, (k, t) in enumerate(times(rng, 100)) if i % 2]
    want = {}
    for i, k, t in left:
        earlier = [(u, v) for q, u, v in right if q == k and u < t]
        want[i] = max(earlier, default=(None, None))
    l, r = spark.createDataFrame(left, "i long, k string, t long"), spark.createDataFrame(right, "k string, t long, v long")
    for pieces in (None, 6):
        assert {x.i: (x.as_of_t, x.as_of_v) for x in series.as_of(l, r, ["k"], "t", "t", ["v"], keep, pieces).collect()} == want


def test_health_in_pieces(spark, keep):
    rng = random.Random(4)
    rows = [("hot" if i % 5 else f"s{i % 3}", rng.randrange(9_000), i, rng.random() < 0.1) for i in range(500)]
    sources, want = [("hot", 200), ("s0", 50), ("s1", 900), ("s2", 1)], {}
    for s, every in sources:
        ok = None
        for _, t, i, good in sorted((r for r in rows if r[0] == s), key=lambda r: r[1:3]):
            ok = t if good else ok
            want[i] = "OK" if good else "STALE" if ok is not None and t - ok <= 3 * every else "UNAVAILABLE"
    frame = spark.createDataFrame(rows, "source_id string, sampled_at long, seq long, ok boolean")
    for pieces in (None, 6):
        got = state.source_health(frame, spark.createDataFrame(sources, "source_id string, poll_seconds long"), keep, pieces)
        assert {r.seq: r.status for r in got.collect()} == want and "_piece" not in got.columns


def test_status_runs_of_a_hot_road(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(3_000), i, rng.choice([1, 2, 2, 2, 2, 2, 3])) for i in range(400)] + [("c", 7, 900, 1)]
    want = {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3])
        differed = max((r[1] for r in own if r[3] != own[-1][3]), default=None)
        want[k] = (own[-1][3], min((r[1] for r in own if differed is None or r[1] > differed), default=None), differed is None)
    frame = spark.createDataFrame(rows, "road string, sampled_at long, seq long, status int")
    assert {r.road: (r.status, r.since, r.at_start) for r in series.status_run(frame, "road").collect()} == want
    plan = series.status_run(frame, "road")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_middles_equal_sorted_lists(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), 1, rng.choice([None, rng.randrange(-20_000, 20_000), 4_095, 4_096, 5])) for _ in range(500)] + [("one", 2, -1), ("two", 2, 8_000), ("two", 2, -8_000), ("none", 3, None)]
    got = {(r.k, r.g): (r.n, r.low, r.high) for r in scan.middles(spark.createDataFrame(rows, "k string, g int, v long"), ["k", "g"], "v").collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        own = [r[2] for r in rows if r[:2] == key and r[2] is not None]
        if own:
            want[key] = (len(own), statistics.median_low(own), statistics.median_high(own))
    assert got == want
    plan = scan.middles(spark.createDataFrame(rows, "k string, g int, v long"), ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
