"""Which places an event is at, and which places a point is in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import classify, geo
from tideway.operators import spatial
from tideway.operators.cells import Tree

CELL = 0.5
#: Metres to a corridor, about a town, and about a fire; and the least overlap of an alert's area.
NEAR_LINE, TOWN_RADIUS, FIRE_BUFFER, ALERT_OVERLAP = 1_500.0, 3_000.0, 20_000.0, 0.02


def sorted_union(*lists: Column) -> Column:
    """The distinct values of lists of ids that are not blank, in order."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.filter(F.concat(*(F.coalesce(x, none) for x in lists)), lambda v: F.trim(v) != "")))


def boxed(shapes: DataFrame) -> DataFrame:
    """shapes (geojson) with min_lat, min_lng, max_lat, max_lng; those without a geometry go."""
    return geo.with_box(shapes).where("min_lat IS NOT NULL")


def point_in_places(points: DataFrame, places: DataFrame, town_metres: float = TOWN_RADIUS, tree: Tree | None = None) -> DataFrame:
    """point_id, place_id, kind, name, metres (to a town's point, else 0): places (place_id, kind, name, geojson) that hold a point (point_id, lat, lng), are a corridor near it, or a town about it."""
    tree, pad, c = tree or Tree(CELL), max(town_metres, NEAR_LINE) / geo.DEGREE_M, F.col
    p = tree.keyed(boxed(places), c("min_lat") - pad, c("max_lat") + pad, c("min_lng") - 2 * pad, c("max_lng") + 2 * pad, False).select("place_id", "kind", "name", "geojson", "_cell")
    here = tree.keyed(points.select("point_id", "lat", "lng"), c("lat"), c("lat"), c("lng"), c("lng"), True)
    lat, lng, g = F.col("lat"), F.col("lng"), F.col("geojson")
    town = F.get(geo.points(g), 0)
    metres = geo.haversine(lat, lng, town[1], town[0])
    on_line = F.exists(geo.lines(g), lambda line: geo.near_line(lat, lng, line, NEAR_LINE))
    hit = geo.in_shape(g, lat, lng) | F.coalesce(on_line, F.lit(False)) | F.coalesce(metres <= town_metres, F.lit(False))
    return here.join(p, "_cell").where(hit).select("point_id", "place_id", "kind", "name", F.coalesce(metres, F.lit(0.0)).alias("metres"))


def resolved(points: DataFrame, places: DataFrame, town_metres: float = TOWN_RADIUS, tree: Tree | None = None) -> DataFrame:
    """point_in_places with ``position``: the most specific place first (town, area, corridor, county), then the nearest town, then by name."""
    rank = classify.ladder((F.col("kind") == "TOWN", 0), (F.col("kind") == "AREA", 1), (F.col("kind") == "CORRIDOR", 2), otherwise=3)
    w = Window.partitionBy("point_id").orderBy(rank, "metres", "name")
    return point_in_places(points, places, town_metres, tree).withColumn("position", F.row_number().over(w))


def matched(events: DataFrame, places: DataFrame, fire_metres: float = FIRE_BUFFER, keep=None, tree: Tree | None = None) -> DataFrame:
    """id, place_ids for events (id, layer, geojson, place_ids) and places (place_id, kind, name, geojson), by the shape of the event.

    A point is where point_in_places says. A line is where its middle is. An
    area is at the places it overlaps (an alert by ALERT_OVERLAP at least), and
    at those that hold its middle or whose middle it holds. A fire is also at
    areas and towns within fire_metres. Places that were set before stay. The
    rules each read the events; ``keep`` may store them first.
    """
    if keep:
        events, places = keep(events), keep(places)
    b = boxed(events.select("id", "layer", "geojson"))
    lat, lng = geo.centre(tuple(F.col(n) for n in ("min_lat", "min_lng", "max_lat", "max_lng")))
    kind = F.get_json_object("geojson", "$.type")
    areal = kind.isin("Polygon", "MultiPolygon")
    middles = b.select(F.col("id").alias("point_id"), "layer", areal.alias("areal"), kind.alias("g"), lat.alias("lat"), lng.alias("lng"))
    shapes = spatial.bounded(b.where(areal).select("id", "layer", "geojson"))
    zones = spatial.bounded(places.select("place_id", "kind", "geojson"))
    found = [point_in_places(middles.where("NOT areal AND g NOT LIKE '%Line%'").drop("areal", "g", "layer"), places, tree=tree).select(F.col("point_id").alias("id"), "place_id")]
    areas = places.where(F.get_json_object("geojson", "$.type").isin("Polygon", "MultiPolygon"))
    found.append(point_in_places(middles.where("(areal AND layer <> 'WEATHER_ALERT') OR g LIKE '%Line%'").drop("areal", "g", "layer"), areas, tree=tree).select(F.col("point_id").alias("id"), "place_id"))
    meet = lambda rows, least: spatial.shapes_meet(rows, zones, least, tree).select("a.id", "b.place_id")
    found += [meet(shapes.where("layer = 'WEATHER_ALERT'"), ALERT_OVERLAP), meet(shapes.where("layer <> 'WEATHER_ALERT'"), 1e-9)]
    centres = boxed(places).select("place_id", lat.alias("lat"), lng.alias("lng"))
    held = spatial.points_near(centres, shapes.where("layer <> 'WEATHER_ALERT'"), 0.0, tree).select("b.id", "a.place_id")
    near = zones.where("kind IN ('AREA', 'TOWN')")
    about = spatial.shapes_near(shapes.where("layer = 'WILDFIRE'"), near, fire_metres, tree).select("a.id", "b.place_id")
    spots = spatial.points_near(middles.where("NOT areal AND layer = 'WILDFIRE'").select(F.col("point_id").alias("id"), "lat", "lng"), near, fire_metres, tree).select("a.id", "b.place_id")
    towns = spatial.points_near(centres.join(places.where("kind = 'TOWN'").select("place_id"), "place_id", "left_semi"), shapes.where("layer = 'WILDFIRE'"), fire_metres, tree).select("b.id", "a.place_id")
    every = reduce(DataFrame.unionByName, [*found, held, about, spots, towns]).groupBy("id").agg(F.collect_set("place_id").alias("_found"))
    return events.select("id", "place_ids").join(every, "id", "left").select("id", sorted_union(F.col("place_ids"), F.col("_found")).alias("place_ids"))
