"""Geometry as columns: points are (lat, lng) doubles, rings arrays of [lng, lat]."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M, DEGREE_KM, DEGREE_M = 6_371_000.0, 111.32, 111_320.0
RINGS = "array<array<array<double>>>"


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres, in the form with atan2."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def metres_between(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Local flat metres about the mean latitude."""
    x = (lng1 - lng2) * DEGREE_M * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(x, (lat1 - lat2) * DEGREE_M)


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Boxes (min_lat, min_lng, max_lat, max_lng), edges included."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def box_gap_km(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """How far apart two boxes are, 0 where they meet; infinite where one is missing."""
    d_lat = F.greatest(F.lit(0.0), b[0] - a[2], a[0] - b[2]) * DEGREE_KM
    middle = F.radians((a[0] + a[2] + b[0] + b[2]) / 4)
    d_lng = F.greatest(F.lit(0.0), b[1] - a[3], a[1] - b[3]) * DEGREE_KM * F.cos(middle)
    return F.coalesce(F.hypot(d_lat, d_lng), F.lit(float("inf")))


def middle_and_reach(b: tuple[Column, ...]) -> tuple[Column, ...]:
    """A box by its middle and half its extents (lat, lng, half_lat, half_lng), to nine decimals: what its edges lost or won when they were written is not in it."""
    nine = lambda v: F.round(v, 9)
    return nine((b[0] + b[2]) / 2), nine((b[1] + b[3]) / 2), nine((b[2] - b[0]) / 2), nine((b[3] - b[1]) / 2)


def reach_gap_km(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """box_gap_km of boxes as middle_and_reach gives them."""
    apart = lambda i: F.greatest(F.lit(0.0), a[i] - a[i + 2] - b[i] - b[i + 2], b[i] - a[i] - a[i + 2] - b[i + 2])
    x = apart(1) * F.cos(F.radians((2 * a[0] + 2 * b[0]) / 4))
    return F.coalesce(DEGREE_KM * F.sqrt(F.pow(apart(0), 2) + F.pow(x, 2)), F.lit(float("inf")))


def crossings(ring: Column, lat: Column, lng: Column) -> Column:
    """How many edges of a ring, closed by itself, an eastward ray crosses."""
    after = F.concat(F.slice(ring, F.size(ring), F.lit(1)), F.slice(ring, F.lit(1), F.size(ring) - 1))  # the vertex before each

    def crosses(p: Column, q: Column) -> Column:
        straddles = (p[1] > lat) != (q[1] > lat)
        return F.when(straddles, (lng < (q[0] - p[0]) * (lat - p[1]) / F.nullif(q[1] - p[1], F.lit(0.0)) + p[0]).cast("int")).otherwise(0)

    return F.when(F.size(ring) < 3, 0).otherwise(F.aggregate(F.zip_with(ring, after, crosses), F.lit(0), lambda s, x: s + x))


def in_polygon(rings: Column, lat: Column, lng: Column) -> Column:
    """Even-odd over all rings, so holes are outside; lower edges count inside, upper ones outside."""
    return F.aggregate(F.transform(rings, lambda r: crossings(r, lat, lng)), F.lit(0), lambda s, x: s + x) % 2 == 1


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is reckoned once, however often f names it and wherever the plan puts it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _said(geojson: Column) -> Column:
    """kind and said, the coordinates' text, of a geometry."""
    return F.struct(F.get_json_object(geojson, "$.type").alias("kind"), F.get_json_object(geojson, "$.coordinates").alias("said"))


def _listed(r: Column, **kinds: str) -> Column:
    """Coordinates of the listed types by their schema, as the widest of them; null for other types and for text that does not read."""
    (one, narrow), (many, wide) = kinds.items()
    return F.when(r["kind"] == one, F.array(F.from_json(r["said"], narrow))).when(r["kind"] == many, F.from_json(r["said"], wide))


def _read(geojson: Column, **kinds: str) -> Column:
    return let(geojson, lambda g: let(_said(g), lambda r: _listed(r, **kinds)))


POLYGONS = {"Polygon": RINGS, "MultiPolygon": f"array<{RINGS}>"}
LINES = {"LineString": "array<array<double>>", "MultiLineString": RINGS}
POINTS = {"Point": "array<double>", "MultiPoint": "array<array<double>>"}


def polygon_rings(geojson: Column) -> Column:
    """Rings of a GeoJSON Polygon or MultiPolygon, all polygons' in a row; null for other types."""
    return F.flatten(polygons(geojson))


def polygons(geojson: Column) -> Column:
    """Polygons of rings of [lng, lat] points."""
    return _read(geojson, **POLYGONS)


def lines(geojson: Column) -> Column:
    return _read(geojson, **LINES)


def points(geojson: Column) -> Column:
    return _read(geojson, **POINTS)


def vertices(geojson: Column) -> Column:
    """All [lng, lat] points of any GeoJSON geometry without their heights; null where there is none."""
    every = lambda r: F.coalesce(_listed(r, **POINTS), F.flatten(_listed(r, **LINES)), F.flatten(F.flatten(_listed(r, **POLYGONS))))
    found = let(geojson, lambda g: let(_said(g), every))
    flat = F.transform(F.filter(found, lambda p: F.size(p) >= 2), lambda p: F.slice(p, 1, 2))
    return let(flat, lambda v: F.when(F.size(v) > 0, v))


def box(geojson: Column) -> tuple[Column, Column, Column, Column]:
    """min_lat, min_lng, max_lat, max_lng of any GeoJSON geometry."""
    found = vertices(geojson)
    lats, lngs = F.transform(found, lambda p: p[1]), F.transform(found, lambda p: p[0])
    return F.array_min(lats), F.array_min(lngs), F.array_max(lats), F.array_max(lngs)


BOX = ("min_lat", "min_lng", "max_lat", "max_lng")


def with_box(rows: DataFrame, geojson: str = "geojson") -> DataFrame:
    """rows with the columns of BOX; the geometry is read once for the four, and a condition on them does not read it again."""
    return rows.drop(*BOX).select("*", F.inline(F.array(extent(vertices(F.col(geojson))))))


def extent(found: Column) -> Column:
    """The columns of BOX, of [lng, lat] points; nulls where there is none."""
    axis = lambda v, i: F.transform(v, lambda p: p[i])
    ends = lambda v: (F.array_min(axis(v, 1)), F.array_min(axis(v, 0)), F.array_max(axis(v, 1)), F.array_max(axis(v, 0)))
    return let(found, lambda v: F.struct(*(c.alias(n) for c, n in zip(ends(v), BOX, strict=True))))


def corners(geojson: Column) -> Column:
    """The [lng, lat] points of an areal geometry."""
    within = lambda v: F.flatten(F.filter(v, lambda x: x.isNotNull()))
    return F.filter(within(within(polygons(geojson))), lambda p: F.size(p) >= 2)


def centre(b: tuple[Column, ...]) -> tuple[Column, Column]:
    """lat, lng of a box's middle, which stands for a shape's centroid."""
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def padded(b: tuple[Column, ...], degrees: float = 1e-4) -> tuple[Column, ...]:
    """A box without height or width is widened to either side, so that a point has an extent."""
    thin = lambda lo, hi: F.when(b[lo] == b[hi], degrees).otherwise(0.0)
    return b[0] - thin(0, 2), b[1] - thin(1, 3), b[2] + thin(0, 2), b[3] + thin(1, 3)


def multi_polygon_json(many: Column) -> Column:
    """GeoJSON of polygons; null for none."""
    return F.when(F.size(many) > 0, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), many.alias("coordinates"))))


def line_json(line: Column) -> Column:
    """GeoJSON of a line of [lng, lat] points, to five places."""
    trimmed = F.transform(line, lambda p: F.transform(p, lambda v: F.round(v, 5)))
    return F.to_json(F.struct(F.lit("LineString").alias("type"), trimmed.alias("coordinates")))


def box_json(b: tuple[Column, ...]) -> Column:
    """GeoJSON polygon of a box, to five places."""
    y0, x0, y1, x1 = (F.round(v, 5) for v in b)
    ring = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def ring_box(rings: Column) -> tuple[Column, Column, Column, Column]:
    """min_lat, min_lng, max_lat, max_lng."""
    points = F.flatten(rings)
    lats, lngs = F.transform(points, lambda p: p[1]), F.transform(points, lambda p: p[0])
    return F.array_min(lats), F.array_min(lngs), F.array_max(lats), F.array_max(lngs)


def point_json(lat: Column, lng: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.round(lng, 5), F.round(lat, 5)).alias("coordinates")))


def cell(v: Column, size: float) -> Column:
    """The grid cell of a coordinate, for joins on equal or neighbouring cells."""
    return F.floor(v / size)


def segment_metres(lat: Column, lng: Column, a: Column, b: Column) -> Column:
    """Local flat metres from a point to a segment between two [lng, lat] points."""
    kx = DEGREE_M * F.cos(F.radians(lat))
    px, py, ax, ay, bx, by = lng * kx, lat * DEGREE_M, a[0] * kx, a[1] * DEGREE_M, b[0] * kx, b[1] * DEGREE_M
    length = F.pow(bx - ax, 2) + F.pow(by - ay, 2)
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(length, F.lit(0.0)))))
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def line_metres(lat: Column, lng: Column, line: Column) -> Column:
    """From a point to the nearest segment of a line of [lng, lat] points."""
    ends = F.slice(line, F.lit(2), F.size(line) - 1)
    starts = F.slice(line, F.lit(1), F.size(line) - 1)
    return F.array_min(F.zip_with(starts, ends, lambda a, b: segment_metres(lat, lng, a, b)))


def in_shape(geojson: Column, lat: Column, lng: Column) -> Column:
    """Whether one of a shape's polygons holds a point."""
    return in_polygons(polygons(geojson), lat, lng)


def in_polygons(many: Column, lat: Column, lng: Column) -> Column:
    """Whether one of several polygons holds a point."""
    return F.coalesce(F.exists(many, lambda rings: in_polygon(rings, lat, lng)), F.lit(False))


def is_box(many: Column, b: tuple[Column, ...]) -> Column:
    """Whether polygons are one ring about the four corners of their box, so that they hold what the box holds."""
    ring = F.get(F.get(many, 0), 0)
    corner = lambda p: (F.size(p) == 2) & p[0].isin(b[1], b[3]) & p[1].isin(b[0], b[2])
    straight = F.zip_with(F.slice(ring, 1, 4), F.slice(ring, 2, 4), lambda p, q: (p[0] == q[0]) != (p[1] == q[1]))
    once = (F.size(many) == 1) & (F.size(F.get(many, 0)) == 1) & (F.size(ring) == 5) & (F.size(F.array_distinct(ring)) == 4) & (F.get(ring, 0) == F.get(ring, 4))
    return F.coalesce(once & F.forall(ring, corner) & F.forall(straight, lambda x: x), F.lit(False))


def nearest_vertex(lat: Column, lng: Column, line: Column) -> Column:
    """Great-circle metres to the nearest point of a line of [lng, lat] points."""
    return F.array_min(F.transform(line, lambda p: haversine(lat, lng, p[1], p[0])))


def near_line(lat: Column, lng: Column, line: Column, metres: float) -> Column:
    """Whether a point lies within so many metres of a segment of a line of [lng, lat] points."""
    return F.coalesce(line_metres(lat, lng, line) <= metres, F.lit(False))
