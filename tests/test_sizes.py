"""Work that must not grow faster than its input: counted on small tables whose rows crowd, with the results held against loops."""

import json

from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from tideway.functions import kernel
from tideway.operators import air, graph, roads, spatial, state
from tideway.plans import queries
from tideway.plans.adapters import Views
from tideway.plans.registry import QUERIES
from tideway.sources import feeds


def test_names_near_many_points_of_one_place(spark, monkeypatch):
    """Names by tiers and distances against a loop; rows of one place are one candidate."""
    spot = lambda i: (38 + i % 37 / 40, -120 + i % 41 / 40)
    points = [(i, *((38.5, -119.5) if i < 200 else spot(i * i))) for i in range(300)] + [(300, None, None), (301, 50.0, -100.0)]
    measured = [(f"{'Town' if i % 2 else 'TOWN'} {i % 5}", *((38.52, -119.52) if i < 200 else spot(i * 7))) for i in range(260)] + [("Far", 38.9, -119.9)]
    keywords = [(f"town {i % 9}", *((38.51, -119.49) if i < 200 else spot(i * 3))) for i in range(230)]
    met = spark.sparkContext.accumulator(0)
    flat = lambda a, b, c, d: 111_320.0 * ((a - c) ** 2 + (b - d) ** 2) ** 0.5

    @F.udf("double")
    def counted(a, b, c, d):
        met.add(1)
        return flat(a, b, c, d)

    monkeypatch.setattr(air.geo, "haversine", counted)
    frame = lambda rows, first: spark.createDataFrame(rows, f"{first}, lat double, lng double")
    areas = spark.createDataFrame([("Area", 49.0, -101.0, 51.0, -99.0)], "name string, min_lat double, min_lng double, max_lat double, max_lng double")
    found = air.nearby_names(frame(points, "point_id long"), frame(measured, "name string"), frame(keywords, "name string"), areas, 40_000, 6, lambda rows: rows.localCheckpoint())
    got = {r.point_id: r.names for r in found.collect()}
    for n, lat, lng in points:
        best = {}
        for tier, rows in enumerate((measured, keywords)):
            for name, y, x in rows:
                if lat is not None and flat(lat, lng, y, x) <= 40_000:
                    b = (tier, flat(lat, lng, y, x), name)
                    best[name.lower()] = min(best.get(name.lower(), b), b)
        assert got[n] == ([b[2] for b in sorted(best.values())][:6] or (["Area"] if n == 301 else []))
    assert met.value < 60_000


def test_related_pairs_look_far_only_without_close_ones(spark, tmp_path, monkeypatch):
    """Pairs of two rules against a loop; candidates are those of the close rule, and a few more."""
    spot = lambda i: (35.05 + i % 19 / 20, -120.95 + i * 7 % 17 / 18)
    rows = [(f"a{i:03d}", 1, 100_000 + i, *spot(i)) for i in range(250)] + [(f"b{i:03d}", 2, 100_500 + i, *spot(i * 3)) for i in range(250)]
    rows += [("b900", 2, 100_500, 35.5, -119.6), ("b901", 2, 100_500, 36.4, -120.5), ("b902", 2, 400_000, 35.5, -120.5)]
    met = spark.sparkContext.accumulator(0)
    flat = lambda p, q: 111.32 * ((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5

    @F.udf("double")
    def counted(y, x, v, u):
        met.add(1)
        return flat((y, x), (v, u))

    monkeypatch.setattr(queries.geo, "box_gap_km", lambda p, q: counted(p[0], p[1], q[0], q[1]))
    views = Views(spark, str(tmp_path))
    views.current = spark.createDataFrame(rows, "id string, layer int, observed_at long, lat double, lng double")
    got = {(r.a, r.b): (r.lag, r.confidence) for r in queries.q6_related(views).collect()}
    want = {}
    for b in rows[250:]:
        near = sorted((flat(a[3:], b[3:]), a[0], b[2] - a[2]) for a in rows[:250] if -3600 <= b[2] - a[2] <= 259_200)
        near = [x for x in near if x[0] <= 60]
        want |= {(a, b[0]): (lag, "HIGH" if gap <= 10 else "MEDIUM") for n, (gap, a, lag) in enumerate(near) if n == 0 or gap <= 10}
    assert got == want
    assert {"b900", "b901"} <= {b for _, b in got} and met.value < 45_000


def test_tasks_of_a_shuffle_follow_the_rows(spark, sf, monkeypatch):
    """More rows are more partitions, none of which grows; the rows stay the same."""
    plain = {name: sorted(map(repr, QUERIES[name](spark, sf).collect())) for name in ("n4_timeline", "w16_link_rollup")}
    monkeypatch.setattr(Views, "TASK_ROWS", 50)
    monkeypatch.setattr(Views, "FEW", 100)
    rows = Views(spark, sf).observed.count()
    for name, want in plain.items():
        got = QUERIES[name](spark, sf)
        assert got.rdd.getNumPartitions() >= rows // 50 > 10
        assert sorted(map(repr, got.collect())) == want


def test_signs_of_one_place_meet_others_as_one(spark, monkeypatch):
    """Groups of signs with and without an extent, many at one place, against a plain union-find; few pairs are reckoned."""
    keep, n = (lambda rows: rows.localCheckpoint()), 120
    spots = [(38.0, -120.0), (38.1, -120.0), (38.4, -120.0), (38.8, -120.0), (39.2, -120.0)]
    signs = [(i + 1, "R1" if i % 7 else "R2", *spots[i % 5], float(10 * i) if i % 5 == 4 or i % 11 == 0 else None) for i in range(n)]
    rows = spark.createDataFrame([(i, "Highway 4", level, "Eastbound", at, lat, lng) for i, level, lat, lng, at in signs], "sign_id long, highway string, level string, direction string, milepost double, lat double, lng double")
    met = spark.sparkContext.accumulator(0)
    flat = lambda a, b, c, d: 111_320.0 * ((a - c) ** 2 + (b - d) ** 2) ** 0.5

    @F.udf("double")
    def counted(a, b, c, d):
        met.add(1)
        return flat(a, b, c, d)

    monkeypatch.setattr(roads.geo, "haversine", counted)
    got = {r.sign_id: r.stretch for r in roads.stretches(rows, rows.limit(0), keep).collect()}
    marks = sorted(at for *_, at in signs if at is not None)
    ends = {at: ([x for x in marks if x > at] or [at])[0] for at in marks}
    root = {i: i for i, *_ in signs}
    before = None
    while before != root:
        before = dict(root)
        for i, level, y, x, at in signs:
            for j, other, v, u, to in signs:
                touch = at <= ends[to] + roads.TOUCH_MILES and to <= ends[at] + roads.TOUCH_MILES if at is not None and to is not None else flat(y, x, v, u) <= roads.JOIN_METRES
                if level == other and touch:
                    root[i] = root[j] = min(root[i], root[j])
    assert got == root
    assert met.value < 500


def test_components_read_edges_in_few_rounds(spark):
    """A long path, a star and a clique; after each round only edges between groups are left."""
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2000 + j) for i in range(9) for j in range(9)] + [(5, 5)]
    sizes = []

    def keep(rows):
        rows = rows.localCheckpoint()
        if rows.columns == ["a", "b"]:
            sizes.append(rows.count())
        return rows

    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), keep).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(50)} | {2000 + i: 2000 for i in range(9)}
    assert sizes == [300 + 49 + 36, 0]


def test_perimeters_read_a_geometry_once(spark):
    """Conditions on a shape's box do not multiply the reads of its text; every kind of geometry gives its box."""
    square = [[[-121, 37], [-120.5, 37], [-120.5, 37.5], [-121, 37]]]
    shapes = [
        ("Polygon", square), ("MultiPolygon", [square, [[[-125, 30], [-124, 30], [-124, 31, 9], [-125, 30]]]]), ("Point", [-121.5, 37.5, 4]), ("MultiPoint", [[-121, 36], [-122, 39]]), ("LineString", [[-121, 36], [-122, 37]]), ("MultiLineString", [[[-121, 36], [-122, 37]], [[-123, 38]]]),
        ("Polygon", []), ("Polygon", "x"), ("Circle", [1, 2]), ("Point", [-100, 50]), (None, None),
    ]
    items = [{"properties": {"OBJECTID": i, "incident_name": "A", "displayStatus": None if i % 2 else "Active"}, "geometry": kind and {"type": kind, "coordinates": said}} for i, (kind, said) in enumerate(shapes)]
    rows = feeds.perimeters(spark.createDataFrame([(json.dumps({"features": items}),)], "body string"), (36.0, -123.0, 38.0, -120.0))
    got = {r.object_id: (r.min_lat, r.min_lng, r.max_lat, r.max_lng) for r in rows.collect()}
    assert got == {0: (37.0, -121.0, 37.5, -120.5), 1: (30.0, -125.0, 37.5, -120.5), 2: (37.5, -121.5, 37.5, -121.5), 3: (36.0, -122.0, 39.0, -121.0), 4: (36.0, -122.0, 37.0, -121.0), 5: (36.0, -123.0, 38.0, -121.0)}
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("get_json_object(") < 20


def test_boxes_of_shapes_need_no_python(spark, sf):
    """A task of a join of shapes has one Python worker, for the exact test, which runs once; boxes equal the kernel's."""
    for name in ("j9_shape_places", "j11_cameras_near"):
        assert QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    ring = [[-121, 37], [-120.5, 37.25], [-120.7, 38.1], [-121, 37]]
    shapes = [("Polygon", [ring]), ("Polygon", [ring, [[-130, 20, 7], [-129, 20, 7], [-129, 21, 7]]]), ("MultiPolygon", [[ring], [[[0.1, 0.2], [1, 1], [1, 0]], []]]), ("MultiPolygon", []), ("Polygon", [[]]), ("Point", [1, 2]), ("LineString", [[1, 2], [3, 4]])]
    texts = [json.dumps({"type": k, "coordinates": c}) for k, c in shapes] + [None, "", "[", "{}"]
    got = {r.i: (r.min_lng, r.min_lat, r.max_lng, r.max_lat) for r in spatial.bounded(spark.createDataFrame(list(enumerate(texts)), "i int, geojson string")).collect()}
    assert got == {i: b for i, x in enumerate(texts) if (b := kernel.bounds(kernel.shape(x))) is not None} and len(got) == 3


def test_newest_events_read_the_revisions_once(spark, sf):
    """The events are scanned once and only the newest rows become events; the rows are those of the whole log."""
    views = Views(spark, sf)
    plan = views.events_now._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    first = views.event_log.where("revision = 1").select("id", F.col("ingested_at").alias("first_ingested"))
    want = state.latest(views.event_log, "id", ["revision"]).join(first, "id")
    shown = lambda rows: sorted(repr(tuple(r[c] for c in sorted(want.columns))) for r in rows.collect())
    assert sorted(views.events_now.columns) == sorted(want.columns) and shown(views.events_now) == shown(want)
