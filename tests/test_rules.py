"""Rules on small tables with known answers: relations, stories, normalizers, roads, radio, requests, and exact shapes against samples."""

import json
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideway.functions import kernel, text
from tideway.operators import air, maps, paging, radio, related, roads, serving, timeline
from tideway.sources import feeds, normalize

DAY, HOUR = 86400, 3600


def event(**fields):
    return {n: fields.get(n) for n in normalize.EVENT} | {k: v for k, v in fields.items() if k not in normalize.EVENT}


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in normalize.EVENT.items()) + more)


def point(lat, lng):
    return json.dumps({"type": "Point", "coordinates": [lng, lat]})


def square(x, y, w=1.0, h=None):
    h = w if h is None else h
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]


def polygon(*rings):
    return json.dumps({"type": "Polygon", "coordinates": list(rings)})


def test_relations_by_name_near_and_yielding(spark):
    """The nearest fire takes a zone unless the zone's notes name another; a zone named after a fire station is not named."""
    t = 1_700_000_000
    rows = [
        event(id="f1", layer="WILDFIRE", category="wildfire", headline="Ross Fire — 10 ac", status="ACTIVE", effective=t, observed_at=t, geojson=point(38.0, -120.0)),
        event(id="f2", layer="WILDFIRE", category="wildfire", headline="BEAR CREEK — 9 ac", status="ACTIVE", effective=t, observed_at=t, geojson=point(38.05, -120.0)),
        event(id="z1", layer="EVACUATION", headline="Zone 1", description="Ross Fire near Canyon Ct", status="ACTIVE", observed_at=t + HOUR, geojson=point(38.05, -120.0)),
        event(id="z2", layer="EVACUATION", headline="Zone 2", description="meet at Ross Fire Station", status="ACTIVE", observed_at=t + HOUR, geojson=point(38.04, -120.0)),
        event(id="z3", layer="EVACUATION", headline="Zone 3", description="", status="ACTIVE", observed_at=t + 4 * DAY, geojson=point(38.0, -120.0)),
        event(id="p1", layer="POWER", category="psps", status="ACTIVE", effective=t - 2 * HOUR, observed_at=t, geojson=point(38.1, -120.0), headline="x"),
        event(id="r1", layer="ROAD_INCIDENT", category="incident", headline="Smoke", description="bear creek fire crossing", status="ACTIVE", observed_at=t, geojson=point(38.2, -120.0)),
    ]
    got = {(r.a, r.b): r for r in related.pairs(frame(spark, [r | {"first_ingested": r["observed_at"]} for r in rows], ", first_ingested bigint"), t + 10 * DAY).collect()}
    assert {k: r.rule for k, r in got.items()} == {
        ("f1", "z1"): "fire-evacuation-named", ("f2", "z2"): "fire-evacuation-near", ("f1", "p1"): "fire-shutoff-near", ("f2", "p1"): "fire-shutoff-near", ("f2", "r1"): "fire-road-named",
    }
    assert got["f2", "z2"].reason == "Issued 1 h after the fire started, 1.1 km from the fire"
    assert got["f1", "p1"].reason.startswith("PG&E shutoff starting 2 h before the fire started")
    one = related.of_event(spark.createDataFrame([(k[0], k[1], r.rule, r.confidence, r.reason) for k, r in got.items()], "a string, b string, rule string, confidence int, reason string"), "f2").collect()
    assert [r.event for r in one] == ["r1", "z2", "p1"]


def test_no_rule_caps_its_candidates(spark):
    t = 1_700_000_000
    rows = [event(id="f", layer="WILDFIRE", headline="Long Fire — 1 ac", status="ACTIVE", effective=t, observed_at=t, geojson=point(38.0, -120.0))]
    rows += [event(id=f"p{i}", layer="POWER", category="psps", status="ACTIVE", effective=t, observed_at=t, geojson=point(38.0, -120.0)) for i in range(2_500)]
    assert related.pairs(frame(spark, [r | {"first_ingested": t} for r in rows], ", first_ingested bigint"), t + DAY).count() == 2_500


def test_timeline_of_a_closure_a_shutoff_and_a_node(spark):
    t = 1_700_000_000
    closure = {"window_id": "w", "closure_type": "Full", "work_type": "", "lanes": "", "total_lanes": 0, "planned_start": t, "planned_end": t + 50, "set_up_at": None}
    rows = [
        event(id="c", layer="ROAD_INCIDENT", severity=1, status="ACTIVE", observed_at=t, road={"log_number": None, "log": [{"number": 2, "stamp": "Nov 14 2023 10:13PM", "text": "Units"}], "closure": closure}, source_name="Caltrans"),
        event(id="p", layer="POWER", severity=1, status="SCHEDULED", observed_at=t, power={"outage_id": None, "cause": None, "customers": 1200, "event_id": "e", "stage": "", "starts": t + 5, "ends": None, "all_clear": t + 9, "restoration": t + 7}, source_name="PG&E"),
        event(id="m", layer="MESH", severity=0, status="ACTIVE", observed_at=t, mesh={k: None for k in ("public_key", "node_type", "name", "snr", "gateways", "last_relayed_at", "last_advert_at", "reachability")} | {"last_heard_at": t, "last_success_at": t + 1, "last_attempt_at": t + 2, "reporter": "r"}),
    ]
    log = [r | {"revision": 1, "ingested_at": t + 100} for r in rows]
    later = dict(log[1], revision=2, ingested_at=t + 200, status="ACTIVE", severity=3)
    gap = dict(log[1], revision=4, ingested_at=t + 400, status="RESOLVED", severity=3)
    more = ", revision int, ingested_at bigint"
    told = timeline.timeline(frame(spark, [rows[0] | {"revision": 1}, rows[1] | {"revision": 4}, rows[2] | {"revision": 1}], ", revision int"), frame(spark, [*log, later, gap], more)).orderBy("event_id", "position").collect()
    story = {e: [(r["at"] - t, r.clock, r.kind, r.label) for r in told if r.event_id == e] for e in "cpm"}
    assert story["c"] == [(-20, "SOURCE", "LOG", "Units"), (0, "SOURCE", "PLANNED_START", "Planned start"), (50, "SOURCE", "PLANNED_END", "Planned end"), (100, "OWN", "FIRST_RECORDED", "First recorded")]
    assert story["p"] == [
        (5, "SOURCE", "PLANNED_START", "De-energization starts"), (7, "SOURCE", "ESTIMATE", "Estimated restoration"), (9, "SOURCE", "ALL_CLEAR", "All clear"), (100, "OWN", "FIRST_RECORDED", "First recorded"), (200, "OWN", "CHANGED", "Severity Severe"), (200, "OWN", "STATUS", "Now in effect"),
    ]
    assert story["m"] == [(0, "SOURCE", "ACTIVITY", "Last heard"), (1, "SOURCE", "ACTIVITY", "Monitor last reached it"), (2, "SOURCE", "ACTIVITY", "Monitor last tried"), (100, "OWN", "FIRST_RECORDED", "First recorded")]


def test_map_properties_leave_out_what_was_not_read(spark):
    node = {"public_key": "ab", "node_type": "repeater", "name": "n", "snr": None, "gateways": [], "last_heard_at": 0, "last_relayed_at": None, "last_advert_at": None, "last_success_at": None, "last_attempt_at": None, "reporter": None, "reachability": "UNKNOWN"}
    rows = [
        event(id="m", layer="MESH", severity=0, status="ACTIVE", mesh=node, geojson="{", observed_at=5), event(id="q", layer="EARTHQUAKE", severity=1, status="ACTIVE", effective=7, observed_at=7, url="javascript:x", earthquake={"magnitude": 3.0, "depth_km": 1.0, "felt": 0}, geojson=point(1, 2)),
        event(id="b", layer="BURN_STATUS", severity=0, status="ACTIVE"),
    ]
    got = {r.id: json.loads(r.body) for r in maps.features(frame(spark, rows)).collect()}
    assert set(got) == {"m", "q"}
    assert got["m"]["geometry"] is None and not {"snr", "reachability", "last_heard_at"} & set(got["m"]["properties"]["mesh"])
    assert "updated_at" not in got["q"]["properties"] and "url" not in got["q"]["properties"]["source"] and got["q"]["geometry"]["coordinates"] == [2, 1]


def test_fires_keep_their_shape_when_perimeters_fail(spark):
    fire = spark.createDataFrame([("calfire:1", "Ross Fire", 100.0, 10, 38.0, -120.0, 5, 6, "", "", "Placer")], "id string, name string, acres double, contained int, lat double, lng double, started long, updated long, url string, location string, county string")
    shape = polygon(square(-120, 38))
    prior = frame(spark, [event(id="calfire:1", geojson=shape, wildfire={"acres": 1.0, "contained": 0, "county": "", "has_perimeter": True})])
    none = spark.createDataFrame([], "object_id bigint, norm string, name string, acres double, current_at bigint, geojson string")
    box = (30.0, -130.0, 45.0, -110.0)
    kept = normalize.wildfires(fire, none, prior, box, 10, DAY, usable=False).first()
    assert kept.geojson == shape and kept.wildfire.has_perimeter and kept.headline == "Ross Fire — 100 ac, 10% contained"
    lost = normalize.wildfires(fire, none, prior, box, 10, DAY).first()
    assert json.loads(lost.geojson)["type"] == "Point" and not lost.wildfire.has_perimeter
    two = spark.createDataFrame([(1, "ross", "ROSS", 5.0, 9, shape), (2, "ross", "ROSS", 6.0, 9, shape), (3, "old", "OLD", 6.0, -2 * DAY, shape), (4, "known", "KNOWN", 1234.5, -2 * DAY, shape)], none.schema)
    stored = frame(spark, [event(id="firis:known", status="ACTIVE")])
    got = {r.id: (r.status, r.headline) for r in normalize.wildfires(fire, two, stored, box, 10, DAY).collect()}
    assert got == {"calfire:1": ("ACTIVE", "Ross Fire — 100 ac, 10% contained"), "firis:ross": ("ACTIVE", "ROSS — 5 ac"), "firis:ross-2": ("ACTIVE", "ROSS — 6 ac"), "firis:known": ("EXPIRED", "KNOWN — 1,235 ac")}


def test_perimeters_over_several_polygons(spark):
    shape = {"type": "MultiPolygon", "coordinates": [[square(-120, 38)], [square(-118, 40)]]}
    body = json.dumps({"features": [{"properties": {"OBJECTID": 7, "incident_name": "Ross", "displayStatus": "Active"}, "geometry": shape}, {"properties": {"OBJECTID": 8, "displayStatus": "Inactive"}, "geometry": shape}]})
    rows = feeds.perimeters(spark.createDataFrame([(body,)], "body string"), (39.5, -118.5, 41.0, -116.0)).collect()
    assert [(r.object_id, r.min_lat, r.max_lat, r.min_lng, r.max_lng) for r in rows] == [(7, 38, 41, -120, -117)] and json.loads(rows[0].geojson) == shape


def test_evacuations_that_share_an_id(spark):
    zones = [("Z1", "North", "Warning"), ("Z1", "North", "Order"), ("Z1", "South", " "), ("Z2", "", "Order Lifted"), ("Z3", "", "Set")]
    body = json.dumps({"features": [{"properties": {"ZONE_ID": z, "ZONE_NAME": n, "COUNTY": "C", "STATUS": s}, "geometry": None} for z, n, s in zones]})
    got = {r.id: (r.evacuation.level, r.headline) for r in normalize.evacuations(feeds.evacuations(spark.createDataFrame([(body,)], "body string"))).collect()}
    assert got == {"caloes:Z1": ("ORDER", "Evacuation Order — North (Z1)"), "caloes:Z1-2": ("WARNING", "Evacuation Warning — South (Z1)"), "caloes:Z3": ("WARNING", "Evacuation Warning — Z3")}


def test_exact_overlap_against_samples():
    rng = np.random.default_rng(3)

    def blob(cx, cy):
        angle = np.sort(rng.uniform(0, 2 * math.pi, 9))
        far = rng.uniform(0.3, 1.0, 9)
        ring = [[cx + r * math.cos(a), cy + r * math.sin(a)] for a, r in zip(angle, far, strict=True)]
        return [*ring, ring[0]]

    for _ in range(12):
        hole = square(-0.1, -0.1, 0.2)
        a, b = (kernel.shape(json.dumps({"type": "MultiPolygon", "coordinates": [[blob(0, 0), hole], [square(3, 3, 0.5)]]})), kernel.shape(json.dumps({"type": "Polygon", "coordinates": [blob(*rng.uniform(-0.6, 0.6, 2))]})))
        p = rng.uniform(-2, 4, (200_000, 2))
        ina, inb = kernel.inside(p, a), kernel.inside(p, b)
        assert kernel.common_area(a, b) == pytest.approx(36 * (ina & inb).mean(), abs=0.03)
        assert kernel.common_area(a, a) == pytest.approx(36 * ina.mean(), abs=0.05)
    s = kernel.shape
    assert kernel.overlap_fraction(s(polygon(square(0, 0))), s(polygon(square(0.5, 0)))) == pytest.approx(0.5) and kernel.overlap_fraction(s(polygon(square(0, 0))), s(polygon(square(1, 0)))) == 0
    assert kernel.overlap_fraction(s(polygon(square(0, 0, 10), square(1, 1, 2))), s(polygon(square(1, 1)))) == 0


def plain_crossings(ring):
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    n, bad = len(ring) - 1, set()
    for i in range(n):
        for j in range(i + 2, n if i else n - 1):
            a, b, c, d = ring[i], ring[i + 1], ring[j], ring[j + 1]
            boxes = all(min(a[k], b[k]) <= max(c[k], d[k]) and min(c[k], d[k]) <= max(a[k], b[k]) for k in (0, 1))
            if boxes and turn(a, b, c) * turn(a, b, d) <= 0 and turn(c, d, a) * turn(c, d, b) <= 0:
                bad |= {i, j}
    return sorted(bad)


def area(ring):
    x, y = ring[:-1].T
    return abs(float((x * np.roll(y, -1) - y * np.roll(x, -1)).sum())) / 2


def wavy(rng, n, strip=False):
    """A simple ring: a star about a centre, or a narrow strip whose sides swing together."""
    if strip:
        x = np.linspace(0, 1, n)
        y = 0.02 * np.sin(x * rng.integers(5, 40)) + rng.normal(0, 0.0005, n)
        return np.concatenate([np.stack([x, y], 1), np.stack([x, y + 0.003], 1)[::-1], [[x[0], y[0]]]])
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    ring = (np.stack([np.cos(turn), np.sin(turn)]) * (1 + rng.normal(0, 0.05, n))).T
    return np.concatenate([ring, ring[:1]])


def test_crossing_edges_equal_all_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    for k in range(40):
        ring = rng.integers(0, 6 if k % 2 else 40, (12, 2)).astype(float)
        ring = np.concatenate([ring, ring[:1]])
        monkeypatch.setattr(kernel, "PAIRS", 5 if k % 3 else 1 << 20)
        assert kernel.crossing_edges(ring).tolist() == plain_crossings(ring)


def test_simplified_rings_are_simple():
    """Narrow strips cross when points are left out; what comes back is few points, no crossing, and about the same area."""
    rng, crossed = np.random.default_rng(2), 0
    for k in range(60):
        ring = wavy(rng, 300, strip=k % 2 == 0)
        assert not plain_crossings(ring) if k < 4 else True
        tolerance = 0.004 if k % 2 == 0 else 0.02
        got = kernel.valid_ring(ring, tolerance)
        crossed += bool(len(kernel.crossing_edges(ring[kernel.kept_corners(ring, tolerance)])))
        assert not len(kernel.crossing_edges(got)) and (got[0] == got[-1]).all() and len(got) < len(ring)
        if k % 2:
            assert abs(area(got) / area(ring) - 1) < 0.14
    assert crossed


def test_a_bump_in_a_strip_comes_back():
    ring = np.array([(0.45, 0), (0.5, 0.006), (0.55, 0), (1, 0), (1, 0.005), (0.56, 0.005), (0.56, 0.0085), (0.44, 0.0085), (0.44, 0.005), (0, 0.005), (0, 0), (0.45, 0)])
    assert len(kernel.crossing_edges(ring[kernel.kept_corners(ring, 0.005)]))
    got = kernel.valid_ring(ring, 0.005)
    assert not len(kernel.crossing_edges(got)) and len(got) < len(ring) and (got[0] == got[-1]).all()
    bow = np.array([(0, 0), (1, 1), (1, 0), (0, 1), (0, 0.0)])
    assert (kernel.valid_ring(bow, 0.1) == bow).all() and kernel.valid_shape((), 0.1) is None
    assert kernel.valid_shape(((np.array([(0, 0), (0, 0), (0, 0.0)]),),), 0.1) is None


def test_a_long_ring_takes_no_quadratic_time():
    ring = wavy(np.random.default_rng(3), 120_000)
    began = time.process_time()
    assert len(kernel.valid_ring(ring, 0.001)) > 4
    assert time.process_time() - began < 30


def test_positions_that_stand_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(f"n{i % 4}", i, 38 + rng.random() / 300, -120 + rng.random() / 300) for i in range(300)]
    held, want = {}, {}
    for k, at, lat, lng in rows:
        now = held.get(k)
        if now is None or math.hypot((now[1] - lng) * 111_320 * math.cos(math.radians((now[0] + lat) / 2)), (now[0] - lat) * 111_320) > 150:
            held[k] = round(lat, 4), round(lng, 4)
        want[k, at] = held[k]
    got = {(r.key, r["at"]): (r.lat, r.lng) for r in radio.stable_positions(spark.createDataFrame(rows, "key string, at long, lat double, lng double")).collect()}
    assert got == want and len(set(want.values())) > 20


def test_requests_are_read_or_refused():
    assert paging.layers(["wildfire, mesh_node", "NETWORK"]) == ["WILDFIRE", "MESH"] and paging.statuses([]) == ["ACTIVE", "SCHEDULED"]
    assert (paging.severity(""), paging.severity("severe"), paging.page_size(0), paging.page_size(999)) == (0, 3, 50, 200)
    assert paging.moment("2024-01-01T00:00:00-08:00") == 1704096000 and paging.moment("") is None and paging.place_kind("town") == "TOWN" and paging.place_kind("") is None
    for call in (lambda: paging.layers(["UNSPECIFIED"]), lambda: paging.statuses(["gone"]), lambda: paging.moment("2024-01-01T00:00:00"), lambda: paging.moment("2024-01-01"), lambda: paging.page_size(-1), lambda: paging.severity("worst")):
        with pytest.raises(ValueError):
            call()


def test_condition_spans_and_names(spark):
    said = [("Is closed from the Mt. Reba turnoff (Alpine Co) to 4.9 mi west of SR 89 - for the winter", "CLOSURE", "the Mt. Reba turnoff", "4.9 mi west of SR 89"), ("Closed", "CLOSURE", "", ""), ("Open", "INFO", "", "")]
    rows = spark.createDataFrame(said, "t string, k string, a string, b string")
    for r in rows.withColumn("s", text.condition_span(F.col("t"), F.col("k"))).collect():
        assert (r.s["from"], r.s["to"]) == (r.a, r.b)
    names = spark.createDataFrame([("12/25", [None]), ("2.2 acres", [""])], "t string, m array<string>")
    assert names.select(text.mission_fire(F.col("m")[0])).count() == 2


def test_seasonal_closures_and_nothing_else(spark):
    base, full = "Is closed from 0.5 mi east of the Jct of SR 207 /Mt Reba Turnoff/ to the Jct of SR 89 /Ebbetts Pass/", "Is closed from the Jct of SR 207 /Mt Reba Turnoff/ to the Jct of SR 89 /Ebbetts Pass/"
    yes = [base, base.upper(), full + " (Alpine Co) - For the winter", base + " (Alpine Co)- Due to snow", base + " (Alpine Co) -due to snow -Motorists are advised to use an alternate route.", base + " (Alpine Co) 24 hrs a day - Due to snow and ice - For the season - Motorists are advised to use an alternate route", base.replace("Is ", "Is  ") + ".", "Closed from Jct of SR 207 to Ebbetts Pass"]
    no = [base + t for t in (" - Due to snow - Also closed at Black Springs", " 24 hrs a day and at Cottage Springs - Due to snow", " from 0600 hrs to 1800 hrs", " - Due to snow at Dorrington", " and Hells Kitchen (Alpine Co)", " (Alpine Co) (Cottage Springs Co)", " Rd", " to the Nevada State Line")]
    no += ["Chains are required - " + base, base.replace("the Jct of SR 89 /Ebbetts Pass/", "Lake Alpine"), base.replace("to the", "to 7.2 mi west of the"), base.replace("0.5 mi east", "0.5 mi west"), base.replace("0.5 mi east", "2.1 mi east"), base.replace("0.5 mi east", "just east"), "Is closed from Dorrington /Mt Reba Turnoff/ to Ebbetts Pass", "Is closed at the Jct of SR 207", "Is closed from the to the", "", None]
    names = {"start": ["Mt Reba Turnoff", "Jct of SR 207"], "end": ["Ebbetts Pass", "Jct of SR 89", " "]}
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string")
    told = lambda kind, **more: [r[0] for r in rows.select(text.seasonal_closure(F.col("t"), F.lit(kind), **names, **more)).collect()]
    assert told("CLOSURE", direction="East", most_miles=2.0) == [True] * len(yes) + [False] * len(no)
    assert told("CLOSURE")[: len(yes)] == [t in (yes[2], yes[7]) for t in yes] and not any(told("CHAIN", direction="East", most_miles=2.0))
    assert {r[0] for r in rows.select(text.seasonal_closure(F.col("t"), F.lit("CLOSURE"), [], names["end"]).alias("x")).collect()} == {False}


def test_what_a_cache_serves(spark):
    """Named cases, then a loop over random requests."""
    told = lambda rows, **more: [tuple(r)[3:] for r in serving.served(spark.createDataFrame(rows, "key string, at long, seq long, outcome string, n long"), 100, **more).orderBy("key", "at", "seq").collect()]
    assert told([("a", 0, 0, "error", 9), ("a", 10, 1, "clean", 0), ("a", 20, 2, "error", 5), ("a", 110, 3, "error", 5)]) == [("UNAVAILABLE", 0, None, True), ("OK", 0, None, True), ("OK", 0, None, False), ("UNAVAILABLE", 0, None, True)]
    assert told([("a", 0, 0, "partial", 3), ("a", 99, 1, "clean", 5), ("a", 100, 2, "clean", 5), ("a", 300, 3, "error", 1), ("b", 301, 4, "partial", 0), ("b", 302, 5, "error", 0)]) == [
        ("STALE", 3, 0, True), ("STALE", 3, 0, False), ("OK", 5, None, True), ("STALE", 5, 100, True), ("STALE", 0, 301, True), ("UNAVAILABLE", 0, None, True)]
    assert told([("a", 0, 0, "clean", 0), ("a", 5, 1, "clean", 2)], keep_empty=False) == [("OK", 0, None, True), ("OK", 2, None, True)]
    rng = random.Random(8)
    rows = [(rng.choice([None, "a", "b"]), rng.randrange(4_000), i, rng.choice(["clean", "partial", "error"]), rng.choice([None, 0, 1, 7])) for i in range(300)]
    kept, want = {}, []
    for k, at, i, outcome, n in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        n, held = n or 0, kept.get(k)
        if held and at - held["at"] < 100:
            want.append(("STALE", held["n"], held["at"], False) if held["partial"] else ("OK", held["n"], None, False))
            continue
        if outcome == "error":
            want.append(("STALE", held["n"], held["at"], True) if held and held["n"] else ("UNAVAILABLE", 0, None, True))
        else:
            want.append(("OK", n, None, True) if outcome == "clean" else ("STALE", n, at, True))
            if n or outcome == "clean":
                kept[k] = {"n": n, "at": at, "partial": outcome == "partial"}
    assert told(rows) == want and {w[0] for w in want} == {"OK", "STALE", "UNAVAILABLE"}


def test_camera_directory_states(spark):
    cams = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (3, 0, "c")], "district int, position int, id string")
    told = lambda rows: (lambda d, s: (sorted((r.id, r.district) for r in d.collect()), tuple(s.first())))(*air.camera_directory(cams, spark.createDataFrame(rows, "district int, fetched_at long, failed boolean")))
    assert told([(1, 10, False), (2, 20, False), (3, 30, False)]) == ([("a", 1), ("b", 1), ("c", 3)], ("OK", None))
    assert told([(1, 10, True), (2, 20, False), (3, None, False)]) == ([("a", 1), ("b", 1)], ("STALE", 10))
    assert told([(1, None, True)]) == ([], ("UNAVAILABLE", None))


def test_roads_without_alerts_are_open(spark):
    routes = spark.createDataFrame([(1, "Hwy 4", [[-120.0, 38.0], [-120.0, 39.0]]), (2, "Hwy 5", [[-121.0, 38.0]])], "route_id bigint, name string, line array<array<double>>")
    none = spark.createDataFrame([], "route_id bigint, ord bigint, status string, details string, chain string")
    signs = spark.createDataFrame([(9, "SR-4", 38.01, -120.0, False, False), (8, "SR-4", 38.0, -120.0, True, False), (7, "SR-5", 38.0, -121.0, False, True)], "sign_id bigint, highway string, lat double, lng double, unrecognized boolean, closed boolean")
    got = {r.route_id: (r.status, r.explanation, r.chain, r.causes) for r in roads.folded(routes, none, roads.nearest_control(routes, signs)).collect()}
    assert got == {1: ("OPEN", "", "REQUIRED", 0), 2: ("OPEN", "", "NONE", 0)}
    alerts = spark.createDataFrame([(1, point(38.5, -120.0005)), (2, point(38.0, -121.03)), (3, point(30.0, -100.0))], "alert_id bigint, geojson string")
    assert Counter((r.alert_id, r.route_id, r["class"]) for r in roads.classified(alerts, routes).collect()) == Counter([(1, 1, "ON_ROUTE"), (2, 2, "NEARBY")])


def test_orphans_of_rows_in_another_order(spark):
    """A plan may be computed twice with its rows in another order: each perimeter keeps its own fire."""
    t = 1_700_000_000
    fires = [event(id=f"calfire:{i}", headline=f"F{i} — 10 ac", observed_at=t, geojson=point(38.0, -120.0), wildfire=(10.0, 95, "x", False)) for i in range(40)]
    rows = spark.createDataFrame([(i, text_key, point(38.0, -120.0)) for i, text_key in enumerate(f"F{i}" for i in range(40))], "object_id int, name string, geojson string").coalesce(1)
    told = rows.select("object_id", text.fire_key(F.col("name")).alias("norm"), "geojson")
    mixed = told.mapInPandas(lambda frames: (f.sample(frac=1.0, random_state=time.time_ns() % 2**32) for f in frames), told.schema)
    got = normalize.orphans(mixed, frame(spark, fires), t).collect()
    assert {r.object_id: r.orphan for r in got} == {i: f"calfire:{i}" for i in range(40)}


def test_signs_of_both_sources_against_all_pairs(spark):
    """Crowds of signs are the same ones that all pairs find, across edges of cells and up to the last metre; 40,000 at one place do not meet each other."""
    rng = random.Random(5)
    metre = 1 / 111_194.93
    said = lambda: rng.choice(["Eastbound", "westbound", "", None])
    at = lambda: (38.1 + rng.uniform(-900, 900) * metre, -120.0 + rng.uniform(-900, 900) * metre)
    a, b = ([(i, said(), *at()) for i in range(n, n + 60)] for n in (0, 100))
    a += [(60, "", 38.3 - 1e-7, -120.0), (61, "", math.nan, -120.0), (62, "", None, -120.0)]
    b += [(160, "", 38.3 - 1e-7 + 199.9 * metre, -120.0), (161, "", math.nan, -120.0), (162, "", None, -120.0)]
    schema = "sign_id bigint, direction string, lat double, lng double"
    got = {r.sign_id for r in roads._same_sign(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}

    def metres(p, q):
        h = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[3] - p[3]) / 2) ** 2
        return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    agree = lambda p, q: not p[1] or not q[1] or p[1].lower() == q[1].lower()
    assert got == {p[0] for p in a[:61] if any(agree(p, q) and metres(p, q) <= 200 for q in b[:61])}
    assert 60 in got and 10 < len(got) < 61
    crowd = spark.range(40_000).select(F.col("id").alias("sign_id"), F.lit("").alias("direction"), F.lit(38.0).alias("lat"), F.lit(-120.0).alias("lng"))
    assert roads._same_sign(crowd, crowd).count() == 40_000


@pytest.mark.parametrize(("at", "off"), [(100, 55), (1500, 61), (3207, 90)])
def test_fires_equally_near_to_either_side(spark, at, off):
    """Gaps are reckoned from middles and half extents, not from edges as they were rounded for the shape."""
    t, lat = 1_700_000_000, lambda n: 35 + n / 1000.0
    box = lambda y: polygon(square(-120.05, round(y - 0.05, 5), 0.1, 0.1)).replace(str(round(y - 0.05, 5) + 0.1), str(round(y + 0.05, 5)))
    fires = {f"f{i}": lat(at + side * off) for i, side in enumerate((-1, 1))}
    rows = [event(id=n, layer="WILDFIRE", category="wildfire", headline=f"{n} Fire — 1 ac", status="ACTIVE", effective=t, observed_at=t, geojson=box(y)) for n, y in fires.items()]
    rows.append(event(id="z", layer="EVACUATION", headline="Zone", description="", status="ACTIVE", observed_at=t + HOUR, geojson=point(lat(at), -120.0)))
    gap = {n: max(0.0, y - 0.05 - lat(at), lat(at) - y - 0.05) for n, y in fires.items()}
    got = related.pairs(frame(spark, [r | {"first_ingested": r["observed_at"]} for r in rows], ", first_ingested bigint"), t + 10 * DAY).collect()
    assert [(r.a, r.rule) for r in got] == [(min(gap, key=lambda n: (gap[n], n)), "fire-evacuation-near")]


def test_the_strongest_rule_of_a_pair_is_told_where_the_pair_is(spark):
    """Rules of the same layers: a pair counts under its strongest, and no pair is shuffled to find that out; alerts hold what their shape holds, short or long."""
    t = 1_700_000_000
    rules = (related.Rule("far", "WILDFIRE", "POWER", HOUR, 0, related.LOW, lambda: F.lit("x"), km=50), related.Rule("best", "WILDFIRE", "POWER", HOUR, 0, related.MEDIUM, lambda: F.lit("x"), km=20, exclusive=True), related.Rule("close", "WILDFIRE", "POWER", HOUR, 0, related.HIGH, lambda: F.lit("x"), km=5, keep_b=related.category("planned")))
    at = {"f1": 38.0, "f2": 38.3, "p1": 38.02, "p2": 38.12, "p3": 38.6, "p4": 38.02}
    rows = [event(id=i, layer="WILDFIRE" if i[0] == "f" else "POWER", category="psps" if i == "p4" else "planned", headline="Ross Fire", status="ACTIVE", effective=t, observed_at=t, geojson=point(y, -120.0), first_ingested=t) for i, y in at.items()]
    got = related.pairs(frame(spark, rows, ", first_ingested bigint"), t + DAY, rules)
    assert {(r.a, r.b): r.rule for r in got.collect()} == {("f1", "p1"): "close", ("f2", "p1"): "far", ("f1", "p2"): "best", ("f2", "p2"): "far", ("f2", "p3"): "far", ("f1", "p4"): "best", ("f2", "p4"): "far"}
    shapes = {"box": polygon(square(-120, 38)), "half": polygon([[-120, 38], [-119, 38], [-119, 39], [-120, 38]]), "bent": polygon([[-120, 38], [-119, 38], [-119, 39], [-120, 39], [-119.5, 38.5]])}
    rows = [event(id=f"{n}{days}", layer="WEATHER_ALERT", category="Flood Watch", headline="x", status="ACTIVE", effective=t, observed_at=t, expires=t + days * DAY + 60, geojson=g, first_ingested=t) for n, g in shapes.items() for days in (0, 30)]
    spots = {"low": (38.2, -119.5, 0), "high": (38.8, -119.5, 0), "edge": (38.0, -120.0, 0), "top": (39.0, -119.5, 0), "left": (38.5, -119.8, 0), "late": (38.2, -119.5, 29)}
    rows += [event(id=n, layer="ROAD_INCIDENT", category="incident", headline="x", status="ACTIVE", effective=t + days * DAY, observed_at=t, geojson=point(y, x), first_ingested=t) for n, (y, x, days) in spots.items()]
    got = related.pairs(frame(spark, rows, ", first_ingested bigint"), t + 40 * DAY)
    held = {"box": {"low", "high", "edge", "left"}, "half": {"low", "edge"}, "bent": {"low", "high", "edge"}}
    assert {(r.a, r.b) for r in got.collect()} == {(f"{n}{d}", b) for n, bs in held.items() for d in (0, 30) for b in bs} | {(f"{n}30", "late") for n in held}
    assert "Aggregate [a" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_words_before_fire_are_a_key_of_what_names_fire_finds(spark):
    """Whatever names_fire finds has its last word among those of the text, blank for a name that ends otherwise."""
    from tideway.functions import text

    said = ["Near the ROSS Fire", "bear  creek\tfire, ross fire", "North (2) fire", "fire fire fire", "no blaze", "", "Ross Fire Station", "x_ross fire"]
    names = ["Ross", "Bear  Creek", "North (2)", "fire", "eek", "ear  creek", "O'Ross"]
    rows = spark.createDataFrame([(s, n) for s in said for n in names], "s string, n string")
    got = rows.select(text.names_fire(F.col("s"), F.col("n")).alias("found"), F.array_contains(text.words_before_fire(F.col("s")), text.last_word(F.col("n"))).alias("met"), "s", "n").collect()
    assert all(r.met for r in got if r.found) and {(r.s, r.n) for r in got if r.found} == {(said[0], "Ross"), (said[1], "Ross"), (said[1], "Bear  Creek"), (said[2], "North (2)"), (said[3], "fire")}
    assert sum(not r.met for r in got) > 20
