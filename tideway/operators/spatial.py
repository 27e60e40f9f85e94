"""Joins of shapes: cells, of a tree where points crowd, give the candidates, bounds narrow them, the exact test runs on pairs that are left."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import geo, kernel
from tideway.operators.cells import Tree

CELL = 0.5


def bounded(shapes: DataFrame, geojson: str = "geojson") -> DataFrame:
    """shapes with min_lat, min_lng, max_lat, max_lng of their GeoJSON; rows without an areal shape go."""

    return shapes.drop(*geo.BOX).select("*", F.inline(F.array(geo.extent(geo.corners(F.col(geojson)))))).where("min_lat IS NOT NULL")


def _pairs(a: DataFrame, b: DataFrame, pad: float, tree: Tree | None) -> DataFrame:
    """Pairs of boxes that meet, each once: in the cell of the pair's lower corner."""
    names, tree = ("min_lat", "min_lng", "max_lat", "max_lng"), tree or Tree(CELL)
    c = F.col
    left = tree.keyed(a, c("min_lat") - pad, c("max_lat") + pad, c("min_lng") - pad, c("max_lng") + pad, True).select("_cell", F.struct(*a.columns).alias("a"))
    right = tree.keyed(b, c("min_lat"), c("max_lat"), c("min_lng"), c("max_lng"), False).select("_cell", F.struct(*b.columns).alias("b"))
    box_a = tuple(F.col(f"a.{n}") + s * pad for n, s in zip(names, (-1, -1, 1, 1), strict=True))
    box_b = tuple(F.col(f"b.{n}") for n in names)
    own = tree.holds(F.greatest(box_a[0], box_b[0]), F.greatest(box_a[1], box_b[1]))
    return left.join(right, "_cell").where(geo.boxes_meet(box_a, box_b) & own)


def shapes_meet(a: DataFrame, b: DataFrame, least_overlap: float = 0.0, tree: Tree | None = None) -> DataFrame:
    """Pairs (a, b) of bounded shapes that intersect, or overlap by at least a share of the smaller."""

    @F.pandas_udf("boolean")
    def meet(x: pd.Series, y: pd.Series) -> pd.Series:
        test = (lambda p, q: kernel.overlap_fraction(p, q) >= least_overlap) if least_overlap else kernel.intersects
        return pd.Series([bool(test(kernel.shape(p), kernel.shape(q))) for p, q in zip(x, y, strict=True)])

    return _pairs(a, b, 0.0, tree).where(meet(F.col("a.geojson"), F.col("b.geojson"))).select("a", "b")


def shapes_near(a: DataFrame, b: DataFrame, metres: float, tree: Tree | None = None) -> DataFrame:
    """Pairs (a, b, metres) of bounded shapes at most so far apart, below 60 degrees of latitude.

    Here and below the distance is marked as not deterministic only so that the
    plan does not reckon it twice, for the condition and for the column.
    """

    @F.pandas_udf("double")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([kernel.metres_apart(kernel.shape(p), kernel.shape(q)) for p, q in zip(x, y, strict=True)])

    pad = 2 * metres / kernel.DEGREE_M
    return _pairs(a, b, pad, tree).withColumn("metres", apart.asNondeterministic()(F.col("a.geojson"), F.col("b.geojson"))).where(F.col("metres") <= metres).select("a", "b", "metres")


def points_near(points: DataFrame, shapes: DataFrame, metres: float, tree: Tree | None = None) -> DataFrame:
    """Pairs (a, b, metres) of points (lat, lng) and bounded shapes; 0 inside."""

    @F.pandas_udf("double")
    def apart(lat: pd.Series, lng: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([kernel.point_metres(p, q, kernel.shape(s)) for p, q, s in zip(lat, lng, g, strict=True)])

    boxed = points.withColumns({"min_lat": F.col("lat"), "max_lat": F.col("lat"), "min_lng": F.col("lng"), "max_lng": F.col("lng")})
    pairs = _pairs(boxed, shapes, 2 * metres / kernel.DEGREE_M, tree)
    return pairs.withColumn("metres", apart.asNondeterministic()(F.col("a.lat"), F.col("a.lng"), F.col("b.geojson"))).where(F.col("metres") <= metres).select("a", "b", "metres")


def mutual_matches(a: DataFrame, b: DataFrame, keys: list[str], degrees: float) -> DataFrame:
    """Pairs (a, b) of points (lat, lng) with equal keys, nearer than so many degrees, where either has no other match."""
    cells = lambda d: d.withColumns({"_y": geo.cell(F.col("lat"), degrees), "_x": geo.cell(F.col("lng"), degrees), "_id": F.monotonically_increasing_id()})
    about = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    left = cells(a).select(*keys, about("_y").alias("_y"), "_x", F.col("_id").alias("_a"), F.struct(*a.columns).alias("a")).withColumn("_x", about("_x"))
    right = cells(b).select(*keys, "_y", "_x", F.col("_id").alias("_b"), F.struct(*b.columns).alias("b"))
    near = F.sqrt(F.pow(F.col("a.lat") - F.col("b.lat"), 2) + F.pow(F.col("a.lng") - F.col("b.lng"), 2)) < degrees
    pairs = left.join(right, [*keys, "_y", "_x"]).where(near)
    one = lambda c: F.count("*").over(Window.partitionBy(c)) == 1
    return pairs.select("a", "b", one("_a").alias("_1"), one("_b").alias("_2")).where("_1 AND _2").select("a", "b")


def box_polygon(*corners: Column) -> Column:
    """GeoJSON of the box min_lat, min_lng, max_lat, max_lng."""
    y0, x0, y1, x1 = corners
    ring = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1), F.array(x0, y0))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
