"""Geometry kernel, spatial joins, components and the telemetry fold against plain versions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideway.functions import kernel
from tideway.operators import graph, grouped, spatial


def square(x, y, w=1.0, h=None):
    h = w if h is None else h
    return json.dumps({"type": "Polygon", "coordinates": [[[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]]})


def test_intersections():
    s = kernel.shape
    assert kernel.intersects(s(square(0, 0)), s(square(0.5, 0.5))) and kernel.intersects(s(square(0, 0)), s(square(1, 0)))
    assert not kernel.intersects(s(square(0, 0)), s(square(1.1, 0)))
    assert kernel.intersects(s(square(0, 1, 3, 1)), s(square(1, 0, 1, 3)))  # a cross: no vertex inside
    assert kernel.intersects(s(square(0, 0, 9)), s(square(3, 3)))
    assert s("{") == s(None) == s('{"type":"Point","coordinates":[1,2]}') == () and not kernel.intersects((), s(square(0, 0)))


def test_overlap_fraction():
    s = kernel.shape
    assert kernel.overlap_fraction(s(square(0, 0)), s(square(0.5, 0))) == pytest.approx(0.5, abs=0.02)
    assert kernel.overlap_fraction(s(square(0, 0, 10)), s(square(1, 1))) == 1.0
    assert kernel.overlap_fraction(s(square(0, 0)), s(square(1, 0))) == 0.0
    assert kernel.overlap_fraction(s(square(0, 0)), s(square(0.998, 0))) < 0.02


def test_distances():
    s = kernel.shape
    assert kernel.metres_apart(s(square(0, 0)), s(square(0, 2))) == pytest.approx(kernel.DEGREE_M)
    assert kernel.metres_apart(s(square(0, 0)), s(square(0.2, 0.2))) == 0.0 and kernel.metres_apart((), s(square(0, 0))) == float("inf")
    assert kernel.point_metres(0.5, 0.5, s(square(0, 0))) == 0.0 and kernel.point_metres(2.0, 0.5, s(square(0, 0))) == pytest.approx(kernel.DEGREE_M)


def test_lines():
    assert kernel.decoded("_p~iF~ps|U_ulLnnqC_mqNvxq`@") == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    line = np.array([[0, 0], [1, 0.001], [2, 0], [3, 1], [4, 0]], float)
    assert kernel.simplified(line, 0.01).tolist() == [[0, 0], [2, 0], [3, 1], [4, 0]]
    assert len(kernel.simplified_shape(kernel.shape(square(0, 0)), 0.01)[0][0]) == 5 and kernel.simplified_shape(kernel.shape(square(0, 0, 1e-4)), 0.01) == []


def test_spatial_joins_equal_all_pairs(spark):
    rng = random.Random(1)
    a = [(i, square(rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(0.1, 1.2))) for i in range(25)]
    b = [(i, square(rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(0.1, 0.6))) for i in range(25)] + [(99, None)]
    fa, fb = (spatial.bounded(spark.createDataFrame(x, "id long, geojson string")) for x in (a, b))
    s = kernel.shape
    pairs = lambda df: {(r.a.id, r.b.id) for r in df.collect()}
    got = spatial.shapes_meet(fa, fb).collect()
    assert len(got) == len({(r.a.id, r.b.id) for r in got}) and {(r.a.id, r.b.id) for r in got} == {(i, j) for i, p in a for j, q in b if kernel.intersects(s(p), s(q))}
    assert pairs(spatial.shapes_meet(fa, fb, 0.3)) == {(i, j) for i, p in a for j, q in b if kernel.overlap_fraction(s(p), s(q)) >= 0.3}
    assert pairs(spatial.shapes_near(fa, fb, 20_000)) == {(i, j) for i, p in a for j, q in b if kernel.metres_apart(s(p), s(q)) <= 20_000}
    points = [(i, rng.uniform(0, 4), rng.uniform(0, 4)) for i in range(40)]
    near = pairs(spatial.points_near(spark.createDataFrame(points, "id long, lat double, lng double"), fb, 15_000))
    assert near == {(i, j) for i, y, x in points for j, q in b if kernel.point_metres(y, x, s(q)) <= 15_000} and near


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(1, 3), (2, 3), (50, 51), (60, 50), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), lambda df: df.checkpoint()).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 51: 50, 60: 50}


@pytest.mark.parametrize("seed", range(4))
def test_telemetry_fold_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", "", "c"]), rng.choice("xy"), rng.randrange(0, 12), rng.choice([None, 1.0, 2.0, 3.0]), rng.randrange(0, 3), rng.randrange(2), rng.randrange(2)) for i in range(150)]
    kept = []
    for r in rows:
        _, key, who, at, ok, up, sent, recv = r
        if not key or not at:
            continue
        before = max((k for k in kept if k[1] == key and k[2] == who and k[3] < at), key=lambda k: k[3], default=None)
        if before and (ok is not None and ok == before[4] or up > 0 and (up, sent, recv) == before[5:]):
            continue
        if any(k[1] == key and k[3] == at for k in kept):
            continue
        kept.append(r)
    frame = spark.createDataFrame(rows, "seq long, pubkey string, reporter string, reported_at long, last_success double, uptime long, sent long, recv long")
    assert sorted(r.seq for r in grouped.telemetry_kept(frame).collect()) == sorted(k[0] for k in kept)


def test_numbered_ids(spark):
    rows = spark.createDataFrame([("x", 2), ("x", 1), ("y", 5)], "base string, n int")
    got = grouped.numbered_groups(rows, ["base"], ["n"], "base").collect()
    assert {(r.n, r.numbered) for r in got} == {(1, "x"), (2, "x:2"), (5, "y")}


def test_box_polygon(spark):
    g = spark.range(1).select(spatial.box_polygon(*map(F.lit, (0.0, 1.0, 2.0, 3.0))).alias("g")).first().g
    assert kernel.bounds(kernel.shape(g)) == (1.0, 0.0, 3.0, 2.0)


def test_perimeter_clusters(spark):
    rows = [
        (1, "gann", "A1", 38.0, -120.0, 10, True, 1, 5.0), (2, "gann", "A1", 39.0, -121.0, 20, True, 1, 6.0), (3, "gann", "", 38.1, -120.0, 30, False, 1, 7.0),
        (4, "gann", "B2", 40.0, -120.0, 5, True, 1, 8.0), (5, "bear", "", 38.0, -120.0, 5, True, 1, 8.0), (6, "bear", "", 38.0, -120.0, 5, True, 0, 1.0),
    ]
    frame = spark.createDataFrame(rows, "seq long, norm string, incident string, lat double, lng double, at long, active boolean, rank int, acres double")
    assert {r.seq for r in grouped.perimeters_deduped(frame).collect()} == {3, 4, 6}


def test_continued_ids(spark):
    winners = spark.createDataFrame([("z", 1, "c", 1.0, 1.0), ("z", 2, "c", 1.1, 1.0), ("z", 3, "d", 0.0, 0.0), ("y", 1, "c", 0.0, 0.0)], "base string, n long, county string, lat double, lng double")
    prior = spark.createDataFrame([("z", "z", "c", 5.0, 5.0), ("z", "z-2", "c", 1.0, 1.0)], "base string, id string, county string, lat double, lng double")
    assert {(r.base, r.n): r.id for r in grouped.continued_ids(winners, prior).collect()} == {("z", 1): "z-2", ("z", 2): "z", ("z", 3): "z-3", ("y", 1): "y"}


def test_continued_ids_of_winners_alone(spark):
    """A base of one winner is settled without Python, by the same rules; a county that is not known fits nothing."""
    rng = random.Random(5)
    winners, prior = [], []
    for i in range(60):
        base = f"b{i}"
        winners += [(base, n, rng.choice(["a", "b", None]), rng.randint(0, 3) / 10, rng.randint(0, 3) / 10) for n in range(1 if i % 3 else rng.randint(1, 4))]
        prior += [(base, x, rng.choice(["a", "b", None]), rng.randint(0, 3) / 10, rng.randint(0, 3) / 10) for x in rng.sample([base, *(f"{base}-{n}" for n in (1, 2, 3, 5, "03", "x"))], rng.randint(0, 7))]
    want = {}
    for base in {w[0] for w in winners}:
        old = sorted((p for p in prior if p[0] == base), key=lambda p: p[1])
        used, names, later = set(), {p[1] for p in old}, []
        for _, n, county, y, x in sorted(w for w in winners if w[0] == base):
            fits = [p for p in old if p[1] not in used and county is not None and p[2] == county]
            if fits:
                want[base, n] = min(fits, key=lambda p: (p[3] - y) ** 2 + (p[4] - x) ** 2)[1]
                used.add(want[base, n])
            else:
                later.append(n)
        for n in later:
            want[base, n] = next(m for k in range(1, 99) if (m := base if k == 1 else f"{base}-{k}") not in names)
            names.add(want[base, n])
    columns = "base string, {} , county string, lat double, lng double"
    got = grouped.continued_ids(spark.createDataFrame(winners, columns.format("n long")), spark.createDataFrame(prior, columns.format("id string")))
    assert {(r.base, r.n): r.id for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1
