"""State functions, folds, paging and geometry on small tables with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideway.functions import classify, geo, text, times
from tideway.operators import mesh, paging, series, state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_pages_join_up(spark):
    """23 events in five pages; the pages in a row are the whole order."""
    rows = spark.createDataFrame([(f"usgs:q{i:02d}", i % 5, 60 * (i % 7)) for i in range(23)], "id string, severity int, observed_at long").cache()
    order = [("severity", True), ("observed_at", True), ("id", False)]
    seen, last = [], None
    while True:
        got = [r.asDict() for r in paging.page(rows, order, 5, last).collect()]
        seen += [r["id"] for r in got[:5]]
        if len(got) <= 5:
            break
        last = paging.read_token(paging.token(got[4]))
    whole = sorted(((-(i % 5), -60 * (i % 7), f"usgs:q{i:02d}") for i in range(23)))
    assert seen == [x[2] for x in whole]


def test_one_row_at_least_fits_a_budget(spark):
    rows = spark.createDataFrame([(1, 50), (2, 10), (3, 10)], "id int, size int")
    assert [r.id for r in paging.within_budget(rows, [("id", False)], F.col("size"), 20).collect()] == [1]
    assert sorted(r.id for r in paging.within_budget(rows, [("id", False)], F.col("size"), 60).collect()) == [1, 2]


def test_revision_gate_arrival_order_wins(spark):
    rows = spark.createDataFrame([("a", 1, 5, "x"), ("a", 2, 9, "x"), ("a", 3, 7, "y"), ("a", 4, 8, None), ("a", 5, 8, None), ("b", 6, 1, "x")], "id string, seq int, at int, state string")
    got = state.revision_gate(rows, "id", ["seq"], ["state"]).orderBy("seq").collect()
    assert [(r.seq, r.revision) for r in got] == [(1, 1), (3, 2), (4, 3), (6, 1)]


def test_sweep_policies_and_supersession(spark):
    rows = spark.createDataFrame([("a", 10, None, None), ("b", 10, 50, None), ("c", 10, None, 90), ("d", 10, None, None)], "id string, observed_at long, expires long, last_seen long")
    polled = spark.createDataFrame([("d",)], "id string")
    said = lambda p, now: {r.id: r.next_status for r in state.sweep(rows, polled, F.lit(now), F.lit(20), F.lit(p)).collect()}
    assert said("resolve", 100) == {"a": "RESOLVED", "b": "RESOLVED", "c": "RESOLVED"}
    assert said("expire", 40)["b"] is None and said("expire", 50)["b"] == "EXPIRED" and said("expire", 50)["a"] is None
    assert said("grace", 100) == {"a": "RESOLVED", "b": "RESOLVED", "c": None}
    by = state.supersede(rows.select("id"), spark.createDataFrame([("a", "z"), ("a", "y"), ("q", "x")], "id string, successor string")).collect()
    assert [(r.id, r.successor, r.next_status) for r in by] == [("a", "y", "RESOLVED")]


def test_touch_set_difference_rename_and_clocks(spark):
    rows = spark.createDataFrame([("a", 5), ("b", 95), ("c", None)], "id string, last_seen long")
    seen = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {r.id: r.last_seen for r in state.touch(rows, seen, F.lit(100), F.lit(90)).collect()} == {"a": 100, "b": 95, "c": 100}
    stored, wanted = spark.createDataFrame([("e", "p"), ("e", "q")], "id string, place string"), spark.createDataFrame([("e", "q"), ("e", "r")], "id string, place string")
    assert {(r.place, r.change) for r in state.replace_set(stored, wanted, ["id", "place"]).collect()} == {("p", "delete"), ("r", "insert")}
    keyed = spark.createDataFrame([("old", 1, "o"), ("old", 2, "o"), ("new", 1, "n")], "pubkey string, at int, v string")
    assert sorted((r.pubkey, r["at"], r.v) for r in state.rename_key(keyed, "pubkey", "old", "new", ["at"]).collect()) == [("new", 1, "n"), ("new", 2, "o")]
    merged = state.max_merge(spark.createDataFrame([("AA", 5, None)], "k string, x int, y int"), spark.createDataFrame([("aa", 3, 7)], "k string, x int, y int"), "k", ["x", "y"])
    assert [tuple(r) for r in merged.collect()] == [("aa", 5, 7)]


def test_refresh_keeps_what_a_null_would_erase(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 6), ("b", 1, None)], "id string, seq int, g int")
    assert sorted((r.id, r.seq, r.g) for r in state.refreshed(rows, "id", ["seq"], ["g"]).collect()) == [("a", 1, 5), ("a", 2, 5), ("a", 3, 6), ("b", 1, None)]


def test_links_from_rollup_and_tail(spark):
    """Day 1 rolled up, day 2 in the tail: one link of two observations over two days; a narrower window has one."""
    day = 86400
    obs = spark.createDataFrame([(1, "aa", 10, -5, ["bb"]), (2, "aa", day + 10, -3, ["bb"])], "obs_id long, pubkey string, heard_at long, snr int, path_nodes array<string>")
    e = mesh.edges(obs)
    empty = spark.createDataFrame([], "a string, b string, day long, n long, best_snr int, first_at long, last_at long")
    rollup = state.compact(empty, e.where("obs_id = 1"))
    got = mesh.links(rollup, e.where("obs_id = 2"), 0).collect()
    assert [(r.a, r.b, r.observations, r.days, r.best_snr) for r in got] == [("aa", "bb", 2, 2, -3)]
    assert [(r.observations, r.days) for r in mesh.links(rollup, e.where("obs_id = 2"), day).collect()] == [(1, 1)]


def test_blank_relay_breaks_the_chain(spark):
    obs = spark.createDataFrame([(1, "a", 0, 0, ["b", "", "c", "c", "d"])], "obs_id long, pubkey string, heard_at long, snr int, path_nodes array<string>")
    assert {(r.a, r.b) for r in mesh.edges(obs).collect()} == {("a", "b"), ("c", "d")}


def test_unique_prefixes(spark):
    keys, prefixes = spark.createDataFrame([("abcdef",), ("abxxxx",), ("cdefgh",)], "key string"), spark.createDataFrame([("ab",), ("cd",), ("abcd",), ("zz",)], "prefix string")
    assert {(r.prefix, r.key) for r in mesh.unique_prefix(prefixes, keys).collect()} == {("cd", "cdefgh"), ("abcd", "abcdef")}


def test_road_status_run(spark):
    rows = spark.createDataFrame([("r", 900 * i, i, s) for i, s in enumerate([1, 1, 3, 3, 3])] + [("q", 0, 9, 1)], "road string, sampled_at long, seq int, status int")
    got = {r.road: (r.status, r.since, r.at_start) for r in series.status_run(rows, "road").collect()}
    assert got == {"r": (3, 1800, False), "q": (1, 0, True)}


def test_typical_minutes(spark):
    """Four Fridays at 17:00 Pacific give 33; with four more at noon all hours give 25; too few give none."""
    friday = 1704502800  # Friday 17:00 Pacific
    rows = [("r", friday + 7 * 86400 * i, 1, m) for i, m in enumerate((30, 32, 34, 60))] + [("r", friday - 5 * 3600 + 7 * 86400 * i, 1, 20) for i in range(4)] + [("r", friday, 3, 200), ("few", friday, 1, 9)]
    frame = spark.createDataFrame(rows, "road string, sampled_at long, status int, minutes int")
    assert [tuple(r) for r in series.typical_minutes(frame, "road", friday + 28 * 86400).collect()] == [("r", 33, "HOUR_OF_WEEK")]
    assert [tuple(r) for r in series.typical_minutes(frame, "road", friday + 3600).collect()] == [("r", 25, "ALL_HOURS")]


def test_folds_equal_loops(spark):
    rng = random.Random(7)
    rows = [(k, rng.randrange(5_000)) for k in range(5) for _ in range(60)]
    frame = spark.createDataFrame(rows, "k int, t long")
    want_kept, want_mean = [], {}
    for k in range(5):
        last, mean, before, n = None, None, None, 0
        for t in sorted(t for q, t in rows if q == k):
            if last is None or t - last >= 100:
                want_kept.append((k, t))
                last = t
            if before is not None and t - before >= 30:
                mean, n = (float(t - before) if mean is None else mean + 0.3 * (t - before - mean)), n + 1
            before = t
        want_mean[k] = (mean, n)
    assert sorted((r.k, r.t) for r in series.kept_apart(frame, ["k"], "t", 100).collect()) == sorted(want_kept)
    got = {r.k: (r.ewma, r.n_gaps) for r in series.ewma(frame, "k", "t").collect()}
    assert all(got[k] == (pytest.approx(want_mean[k][0]), want_mean[k][1]) for k in got) and len(got) == 5


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([(1, "u", 10), (2, "u", 20), (3, "w", 5)], "n int, u string, t long")
    right = spark.createDataFrame([("u", 10, "a"), ("u", 12, "b")], "u string, t long, v string")
    assert {r.n: (r.as_of_t, r.as_of_v) for r in series.as_of(left, right, ["u"], "t", "t", ["v"]).collect()} == {1: (None, None), 2: (12, "b"), 3: (None, None)}


def test_hours_of_an_interval(spark):
    rows = spark.createDataFrame([("a", 3600, 10_800), ("b", 5_000, 5_100), ("c", 5, 5)], "id string, s long, e long")
    assert sorted((r.id, r.hour) for r in series.hourly(rows, "s", "e", ["id"]).collect()) == [("a", 3600), ("a", 7200), ("b", 3600)]


@pytest.mark.parametrize("acres,contained,rank", [(5, 0, 3), (9.5, 60, 2), (1200, 35, 4), (5000, 55, 3), (150, 80, 3), (150, 100, 1)])
def test_wildfire_severity(spark, acres, contained, rank):
    assert one(spark, classify.from_wildfire(F.lit(float(acres)), F.lit(contained))) == rank


@pytest.mark.parametrize("customers,planned,rank", [(0, True, 1), (1, False, 0), (10, False, 1), (10, True, 0), (100, False, 2), (1000, False, 3), (1000, True, 2)])
def test_outage_severity(spark, customers, planned, rank):
    assert one(spark, classify.from_power_outage(F.lit(customers), F.lit(planned))) == rank


@pytest.mark.parametrize("said,level", [("Evacuation Order Lifted", None), ("Evacuation Order", "ORDER"), ("", None), ("Shelter in Place", "SHELTER_IN_PLACE"), ("voluntary", "ADVISORY"), ("Get ready", "WARNING"), ("No Evac", None)])
def test_evacuation_levels(spark, said, level):
    assert one(spark, classify.evacuation_level(F.lit(said))) == level


@pytest.mark.parametrize(
    "facility,kind,lanes,total,rank",
    [("Mainline", "Full", "", 2, 3), ("On Ramp", "Full", "", 1, 2), ("Mainline", "Alternating Lanes", "1, 2", 2, 2), ("Mainline", "Lane", "1, RShoulder", 2, 2), ("Mainline", "Lane", "1, 2", 2, 3), ("Mainline", "Lane", "All", 0, 3), ("Mainline", "Lane", "RShoulder", 2, 1), ("Mainline", "Traffic Break", "", 2, 1), ("Mainline", "?", "", 2, 2)],
)
def test_lane_closures(spark, facility, kind, lanes, total, rank):
    assert one(spark, classify.from_lane_closure(F.lit(facility), F.lit(kind), F.lit(lanes), F.lit(total))) == rank


@pytest.mark.parametrize(
    "levels,top,fire,weather,dark,any_dark,mode",
    [(["ORDER"], 0, 0, "normal", False, False, "ACTIVE"), (["ADVISORY"], 0, 0, "normal", False, False, "WATCH"), ([], 4, 0, "normal", False, False, "ACTIVE"), ([], 3, 3, "normal", False, False, "ACTIVE"), ([], 3, 0, "normal", False, False, "WATCH"), ([], 0, 0, "red-flag", False, False, "WATCH"), ([], 0, 0, "normal", True, True, "WATCH"), ([], 2, 0, "normal", False, True, "WATCH"), ([], 1, 0, "normal", False, True, "QUIET")],
)
def test_place_mode(spark, levels, top, fire, weather, dark, any_dark, mode):
    assert one(spark, classify.place_mode(F.lit(levels).cast("array<string>"), F.lit(top), F.lit(fire), F.lit(weather), F.lit(dark), F.lit(any_dark))) == mode


def test_text(spark):
    assert one(spark, text.normalized(F.lit("Hwy 4  NB: incident at 12:55pm on 7/4/2026!"))) == "highway 4 northbound inc at  on"
    assert one(spark, text.slug(F.lit("  Bear's Creek / 4 "))) == "bear-s-creek-4"
    assert one(spark, text.html_text(F.lit("<p>a &amp; b</p><br>c"))) == "a & b c"
    assert one(spark, text.br_segments(F.lit("one<br/>  <b>two</b> <BR> "))) == ["one", "two"]
    assert [one(spark, text.names_fire(F.lit(t), F.lit("Bear Creek"))) for t in ("near the Bear Creek Fire", "Bear Creek Fire Station", "Bear Creek Fire Stationed", "bear creek road")] == [True, False, True, False]
    assert one(spark, text.lag_text(F.lit(-7200), "it began")) == "2 h before it began" and one(spark, text.lag_text(F.lit(0), "it began")) == "as it began"


def test_times(spark):
    assert one(spark, times.hour_of_week(F.lit(1704502800))) == 5 * 24 + 17
    assert one(spark, times.rfc3339(F.lit(0))) == "" and one(spark, times.rfc3339(F.lit(86400))) == "1970-01-02T00:00:00Z"
    assert one(spark, F.unix_timestamp(times.local_or_rfc(F.lit("2026-07-04T12:00:00")))) - one(spark, F.unix_timestamp(times.local_or_rfc(F.lit("2026-07-04T12:00:00Z")))) == 7 * 3600
    assert one(spark, times.flexible_number(F.lit('{"a":"4.5"}'), "$.a")) == 4.5 and one(spark, times.flexible_number(F.lit('{"a":"x"}'), "$.a")) is None


def test_polygons(spark):
    square = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0], [1.0, 1.0]]]
    concave = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [2.0, 1.0], [0.0, 4.0]]]
    inside = lambda rings, lat, lng: one(spark, geo.in_polygon(F.lit(rings).cast(geo.RINGS), F.lit(lat), F.lit(lng)))
    assert [inside(square, *p) for p in ((0.5, 0.5), (2.0, 2.0), (5.0, 2.0), (0.0, 2.0), (4.0, 2.0), (2.0, 0.0), (2.0, 4.0))] == [True, False, False, True, False, True, False]
    assert inside(concave, 3.0, 2.0) is False and inside(concave, 0.5, 2.0) is True
    assert inside([[[0.0, 0.0], [1.0, 1.0]]], 0.5, 0.5) is False


def test_distances(spark):
    assert one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(6371000 * math.pi / 180)
    box = lambda *v: tuple(map(F.lit, v))
    assert one(spark, geo.box_gap_km(box(0.0, 0.0, 1.0, 1.0), box(0.5, 0.5, 2.0, 2.0))) == 0
    assert one(spark, geo.box_gap_km(box(0.0, 0.0, 1.0, 1.0), box(2.0, 0.0, 3.0, 1.0))) == pytest.approx(111.32)
    line = F.lit([[0.0, 0.0], [0.0, 1.0]]).cast("array<array<double>>")
    assert one(spark, geo.line_metres(F.lit(0.5), F.lit(0.0), line)) == pytest.approx(0) and one(spark, geo.line_metres(F.lit(2.0), F.lit(0.0), line)) == pytest.approx(111320)
