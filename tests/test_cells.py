"""Cells that split where points crowd: leaves of boxes, pairs equal to all pairs, and rows that stay spread."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideway.operators import cells, placing, roads, spatial


def crowd(rng, n):
    """Half the points at one place, most others within metres of it, a few far away."""
    here = (38.123, -120.777)
    return [here if i % 2 else (here[0] + rng.gauss(0, 0.002), here[1] + rng.gauss(0, 0.002)) if i % 8 else (rng.uniform(37, 39), rng.uniform(-122, -119)) for i in range(n)]


@pytest.fixture
def dense():
    at = np.array(crowd(random.Random(1), 400))
    return cells.Tree.of(at[:, 0], at[:, 1], 0.5, 20)


def test_a_tree_of_a_crowd(dense):
    assert dense.salts and max(dense.salts.values()) >= 10 and len(dense.split) < 40
    assert not cells.Tree.of(np.zeros(5), np.zeros(5), 0.5, 20).split


def test_leaves_cover_a_box_once(dense):
    rng = random.Random(2)
    for _ in range(200):
        lat, lng, h = rng.uniform(37.9, 38.3), rng.uniform(-121, -120.5), rng.choice([0, 1e-4, 0.01, 0.7])
        found = dense.leaves(lat - h, lat + h, lng - h, lng + h)
        assert len(set(found)) == len(found)
        inside = [(level, y, x) for level, y, x, _ in found]
        for _ in range(5):
            p, q = rng.uniform(lat - h, lat + h), rng.uniform(lng - h, lng + h)
            of = [n for n in inside if math.floor(p / 0.5 * 2 ** n[0]) == n[1] and math.floor(q / 0.5 * 2 ** n[0]) == n[2]]
            assert len(of) == 1 and of[0] not in dense.split
    assert dense.leaves(math.nan, 1, 1, 1) == []


def test_points_and_shapes_equal_all_pairs(spark, dense):
    rng = random.Random(3)
    points = [(i, *p) for i, p in enumerate(crowd(rng, 160))] + [(900, None, None)]
    boxes = [(k, *(c for c in (a - h, o - h, a + h, o + h))) for k in range(30) for a, o, h in [(38.123 + rng.gauss(0, 0.004), -120.777 + rng.gauss(0, 0.004), rng.choice([0.0005, 0.003, 0.6]))]]
    p = spark.createDataFrame(points, "i long, lat double, lng double")
    shapes = spatial.bounded(spark.createDataFrame(boxes, "k long, y0 double, x0 double, y1 double, x1 double").select("k", spatial.box_polygon(*map(F.col, ("y0", "x0", "y1", "x1"))).alias("geojson")))
    inside = {(i, k) for i, a, o in points if a is not None for k, y0, x0, y1, x1 in boxes if y0 <= a <= y1 and x0 <= o <= x1}
    got = [(r.a.i, r.b.k) for r in spatial.points_near(p, shapes, 0.0, dense).collect()]
    assert len(got) == len(set(got)) and set(got) == inside
    meet = {(j, k) for j, *b in boxes for k, *c in boxes if b[0] <= c[2] and c[0] <= b[2] and b[1] <= c[3] and c[1] <= b[3]}
    got = [(r.a.k, r.b.k) for r in spatial.shapes_meet(shapes, shapes, 0.0, dense).collect()]
    assert len(got) == len(set(got)) and set(got) == meet
    places = shapes.select(F.concat(F.lit("p"), "k").alias("place_id"), F.lit("AREA").alias("kind"), F.lit("n").alias("name"), "geojson")
    got = [(r.point_id, int(r.place_id[1:])) for r in placing.point_in_places(p.withColumnRenamed("i", "point_id"), places, 100.0, dense).collect()]
    assert len(got) == len(set(got)) and set(got) == inside
    lines = [("r1", [[-120.8, 38.1], [-120.7, 38.15], [-120.7, 38.3]]), ("r2", [[-121.5, 37.2], [-119.5, 38.9]]), ("r3", [[-120.777, 38.124]])]
    routes = spark.createDataFrame(lines, "route_id string, line array<array<double>>")
    q = p.withColumnRenamed("i", "point_id")
    for near in (lambda t: roads.distances(q, routes, 3_000.0, t).select("point_id", "route_id", F.round("metres", 6)), lambda t: roads.near_routes(q, routes, 3_000.0, t).select("point_id")):
        one, two = sorted(map(tuple, near(dense).collect())), sorted(map(tuple, near(None).collect()))
        assert one == two and one


def test_a_crowd_stays_spread(spark, dense):
    """Points at one place are dealt to many keys, and a box about them is under every one of these."""
    p = spark.createDataFrame(crowd(random.Random(4), 4_000), "lat double, lng double").repartition(6)
    c = F.col
    dealt = dense.keyed(p, c("lat"), c("lat"), c("lng"), c("lng"), True)
    sizes = dealt.groupBy("_cell").count()
    assert dealt.count() == 4_000 and sizes.agg(F.max("count")).first()[0] < 600
    box = dense.keyed(p.limit(1), F.lit(38.0), F.lit(38.2), F.lit(-121.0), F.lit(-120.5), False)
    assert sizes.join(box, "_cell", "left_anti").where((F.col("_cell.level") == cells.LEVELS)).isEmpty()


def test_trees_of_tables(spark, monkeypatch):
    p = spark.createDataFrame(crowd(random.Random(5), 3_000), "lat double, lng double")
    assert not cells.tree(p, 0.5).split
    made = cells.tree(p, 0.5, most=300, sample=1_000)
    assert made.split and made.salts


def test_a_finer_tree_has_the_same_deep_leaves(dense):
    """Halving the grid changes no leaf below it; leaves of the old grid fall to their halves."""
    rng, fine = random.Random(4), dense.finer(1)
    assert fine.size == 0.25 and fine.salts
    for _ in range(100):
        lat, lng, h = rng.uniform(37.9, 38.3), rng.uniform(-121, -120.5), rng.choice([0, 0.01, 0.7])
        box = (lat - h, lat + h, lng - h, lng + h)
        got, want = set(fine.leaves(*box)), {(level - 1, y, x, n) for level, y, x, n in dense.leaves(*box) if level}
        assert want <= got and {(y // 2, x // 2) for level, y, x, _ in got - want} == {(y, x) for level, y, x, _ in dense.leaves(*box) if not level}
