"""Weather and live conditions about places: forecasts by the hour, fire weather, cameras, names near by, condition layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import classify, geo, text, times
from tideway.operators import spatial

#: The forecast's variables that hold at each hour, and those that are amounts over hours.
HELD = ("temperature", "apparentTemperature", "relativeHumidity", "windSpeed", "windGust", "windDirection", "skyCover", "probabilityOfPrecipitation", "snowLevel")
AMOUNTS = ("quantitativePrecipitation", "snowfallAmount")


def forecast(bodies: DataFrame, variables: tuple[str, ...] = HELD, amounts: tuple[str, ...] = AMOUNTS) -> DataFrame:
    """place, hour and one column for each variable, of gridpoint bodies (place, body), in one reading.

    A value coded for several hours holds at each of them, the later one in
    the list counts, and units become metric; an amount is spread over its
    hours, and one for less than an hour is left out. Only hours with wind and
    humidity are told.
    """
    series = "struct<uom:string,values:array<struct<validTime:string,value:double>>>"
    names = (*variables, *amounts)
    p = bodies.select("place", F.from_json(F.get_json_object("body", "$.properties"), ", ".join(f"{n} {series}" for n in names)).alias("p"))
    listed = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(n in amounts).alias("spread"), F.col(f"p.{n}.uom").alias("uom"), F.col(f"p.{n}.values").alias("values")) for n in names))
    each = p.select("place", F.explode(listed).alias("s")).select("place", "s.name", "s.spread", "s.uom", F.posexplode("s.values").alias("n", "v")).where("v.value IS NOT NULL")
    parts = F.split("v.validTime", "/")
    span = lambda unit: F.coalesce(F.nullif(F.regexp_extract(parts[1], rf"(\d+){unit}", 1), F.lit("")).cast("bigint"), F.lit(0))
    hours, start = span("D") * 24 + span("H"), F.unix_timestamp(F.try_to_timestamp(parts[0]))
    value = times.converted(F.coalesce("uom", F.lit("")), F.col("v.value"))
    rows = each.withColumns({"hours": hours, "start": start - start % 3600, "value": value}).where("hours > 0")
    rows = rows.select("place", "name", "n", F.explode(F.sequence(F.col("start"), F.col("start") + (F.col("hours") - 1) * 3600, F.lit(3600).cast("bigint"))).alias("hour"), F.when(F.col("spread"), F.col("value") / F.col("hours")).otherwise(F.col("value")).alias("value"))
    later = lambda n: F.max_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.col("n"))).alias(n)
    return rows.groupBy("place", "hour").agg(*(later(n) for n in names)).where("windSpeed IS NOT NULL AND relativeHumidity IS NOT NULL")


def peaks(hours: DataFrame) -> DataFrame:
    """place, peak_gust, peak_at (the first hour of it), least_humidity."""
    gust = F.col("windGust")
    return hours.groupBy("place").agg(F.max(gust).alias("peak_gust"), F.max_by("hour", F.when(gust.isNotNull(), F.struct(gust, -F.col("hour")))).alias("peak_at"), F.min("relativeHumidity").alias("least_humidity"))


def fire_weather(alerts: DataFrame, zones: DataFrame, now: Column) -> DataFrame:
    """place, state, alert_id for places with zones (place, zone): a red flag in effect before one to come before a watch; the first in the feed among equals; NORMAL for none.

    alerts: (seq, id, event, zones, starts, expires). An alert without zones counts everywhere, as does any for a place whose zone is null.
    """
    name, begun = F.lower("event"), F.coalesce(F.col("starts") <= now, F.lit(True)) & F.coalesce(F.col("expires") > now, F.lit(True))
    rank = F.when(name.contains("red flag") & begun, 0).when(name.contains("red flag") & (F.col("starts") > now), 1).when(name.contains("fire weather watch"), 2)
    told = alerts.select("seq", "id", rank.alias("rank"), F.explode_outer("zones").alias("zone")).where("rank IS NOT NULL")
    best = lambda rows, key: rows.groupBy(*key).agg(F.min(F.struct("rank", "seq", "id")).alias("b"))
    by_zone = best(told.where("zone IS NOT NULL"), ["zone"])
    everywhere = best(told.where("zone IS NULL"), [])  # one row
    any_zone = best(told, [])  # one row
    rows = zones.join(by_zone, "zone", "left").crossJoin(F.broadcast(everywhere.withColumnRenamed("b", "e"))).crossJoin(F.broadcast(any_zone.withColumnRenamed("b", "o")))
    found = F.when(F.col("zone").isNull(), F.col("o")).otherwise(F.least("b", "e"))
    by = rows.groupBy("place").agg(F.min(found).alias("f"))
    state = classify.ladder((F.col("f.rank") == 0, "RED_FLAG"), (F.col("f.rank") == 1, "RED_FLAG_PENDING"), (F.col("f.rank") == 2, "WATCH"), otherwise="NORMAL")
    return by.select("place", state.alias("state"), F.col("f.id").alias("alert_id"))


def zones_match(own: Column, other: Column) -> Column:
    """Whether lists of zones share one; an empty or missing list matches, so that nothing is withheld for want of zones."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce(own, none), F.coalesce(other, none)
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def alerts_for(alerts: DataFrame, zones: Column) -> DataFrame:
    """Alerts (source, zones …) for an area's zones: those of other senders always, the weather service's by a shared zone."""
    return alerts.where((F.col("source") != "NWS") | zones_match(F.col("zones"), zones))


def union_bounds(areas: DataFrame, margin: float = 0.0) -> DataFrame:
    """One row: the box about all areas (min_lat …), wider by a margin; none for no areas."""
    edge = lambda f, c, by: (f(c) + by).alias(c)
    by = areas.agg(edge(F.min, "min_lat", -margin), edge(F.min, "min_lng", -margin), edge(F.max, "max_lat", margin), edge(F.max, "max_lng", margin))
    return by.where("min_lat IS NOT NULL")


def rollup_events(events: DataFrame) -> DataFrame:
    """Events that count in a place's rollup: no radio nodes, no burn status, no power notes below MINOR, no roadwork that is only planned."""
    out = F.col("layer").isin("MESH", "BURN_STATUS") | ((F.col("layer") == "POWER") & (F.col("severity") == 0)) | ((F.col("layer") == "ROAD_INCIDENT") & (F.col("status") == "SCHEDULED"))
    return events.where(~out)


def zone_shapes(alerts: DataFrame, zones: DataFrame) -> DataFrame:
    """alerts (id, zones …) with ``geojson``: the MultiPolygon of its zones (zone, geojson) that are known, in order of zone; null for none."""
    parts = zones.select("zone", geo.polygons(F.col("geojson")).alias("parts")).where("parts IS NOT NULL")
    each = alerts.select("id", F.explode(F.array_distinct("zones")).alias("zone")).join(parts, "zone")
    by = each.groupBy("id").agg(geo.multi_polygon_json(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("zone", "parts"))), lambda x: x["parts"]))).alias("geojson"))
    return alerts.join(by, "id", "left")


def weather_at(weather: DataFrame, locations: DataFrame, places: DataFrame) -> DataFrame:
    """place_id and the current weather (location_id …) of locations (location_id, lat, lng) in each place's box; a place without height or width is widened."""
    box = geo.padded(tuple(F.col(n) for n in ("min_lat", "min_lng", "max_lat", "max_lng")))
    p = places.select("place_id", *(v.alias(n) for v, n in zip(box, ("y0", "x0", "y1", "x1"), strict=True)))
    p = p.select("*", F.explode(F.sequence(geo.cell(F.col("y0"), 1.0), geo.cell(F.col("y1"), 1.0))).alias("y"), F.sequence(geo.cell(F.col("x0"), 1.0), geo.cell(F.col("x1"), 1.0)).alias("xs")).select("*", F.explode("xs").alias("x"))
    here = weather.join(locations, "location_id").withColumns({"y": geo.cell(F.col("lat"), 1.0), "x": geo.cell(F.col("lng"), 1.0)})
    inside = F.col("lat").between(F.col("y0"), F.col("y1")) & F.col("lng").between(F.col("x0"), F.col("x1"))
    return here.join(p, ["y", "x"]).where(inside).drop("y", "x", "y0", "x0", "y1", "x1", "xs")


def conditions(placed: DataFrame, alerts: DataFrame, now: Column, ttl: int) -> DataFrame:
    """place_id, readings, celsius (mean, to a tenth), wind (highest), staleness of the oldest reading, alerts (how many apply)."""
    by = placed.groupBy("place_id").agg(F.count("*").alias("readings"), times.tenth(F.avg("celsius")).alias("celsius"), F.max("wind_kmh").alias("wind"), times.freshness(now - F.min("at_seconds"), ttl).alias("staleness"))
    told = alerts.groupBy("place_id").agg(F.countDistinct("id").alias("alerts"))
    return by.join(told, "place_id", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))


def one_call_alerts(bodies: DataFrame) -> DataFrame:
    """location_id, event, sender, starts, expires, description, tags of the alerts in weather answers (location_id, body)."""
    r = bodies.select("location_id", F.explode(F.from_json("body", "alerts array<struct<sender_name:string,event:string,start:bigint,end:bigint,description:string,tags:array<string>>>")["alerts"]).alias("a"))
    return r.select("location_id", "a.event", F.col("a.sender_name").alias("sender"), F.col("a.start").alias("starts"), F.col("a.end").alias("expires"), "a.description", "a.tags")


#: Fixed value: nested distances in which names are looked for, each four times the one before.
CLOSER = 3


def _names_within(spots: DataFrame, named: DataFrame, metres: float) -> DataFrame:
    """lat, lng, b (tier, d, name): the best of each name within so many metres of a spot."""
    cell = metres / geo.DEGREE_M
    pad = F.lit(2 * cell)
    about = named.select("key", "name", "tier", F.col("lat").alias("nlat"), F.col("lng").alias("nlng"), F.explode(F.sequence(geo.cell(F.col("lat") - pad, cell), geo.cell(F.col("lat") + pad, cell))).alias("y"), F.sequence(geo.cell(F.col("lng") - pad, cell), geo.cell(F.col("lng") + pad, cell)).alias("xs"))
    here = spots.select("lat", "lng", geo.cell(F.col("lat"), cell).alias("y"), geo.cell(F.col("lng"), cell).alias("x"))
    near = here.join(about.withColumn("x", F.explode("xs")).drop("xs"), ["y", "x"]).withColumn("d", geo.haversine(F.col("lat"), F.col("lng"), F.col("nlat"), F.col("nlng"))).where(F.col("d") <= metres)
    return near.groupBy("lat", "lng", "key").agg(F.min(F.struct("tier", "d", "name")).alias("b"))


def nearby_names(points: DataFrame, measured: DataFrame, keywords: DataFrame, areas: DataFrame, metres: float = 15_000.0, most: int = 8, keep=None) -> DataFrame:
    """point_id, names: what lies within so many metres (name, lat, lng), measured places before keywords, the nearest first, each name once whatever its case, at most so many; else the area (name, box) about the point.

    Points of one place are looked up as one, so are equal names of one place. A
    spot that has its names among the measured places close by is settled;
    others ask again farther off. ``keep`` stores what a later step reads again.
    """
    keep = keep or (lambda rows: rows)
    named = measured.withColumn("tier", F.lit(0)).unionByName(keywords.withColumn("tier", F.lit(1)))
    named = named.select(text.trim_state(F.trim("name")).alias("name"), "tier", "lat", "lng").where("name <> ''")
    named = keep(named.groupBy(F.lower("name").alias("key"), "tier", "lat", "lng").agg(F.min("name").alias("name")))
    spots = keep(points.where("lat IS NOT NULL AND lng IS NOT NULL").select("lat", "lng").distinct())
    rest, found = spots, []
    for k in range(CLOSER - 1, 0, -1):
        best = _names_within(rest, named.where("tier = 0"), metres / 4**k)
        at = F.row_number().over(Window.partitionBy("lat", "lng").orderBy("b"))
        first = keep(best.withColumn("n", at).where(F.col("n") <= most).groupBy("lat", "lng").agg(F.collect_list("b").alias("bs")).where(F.size("bs") >= most))
        found.append(first)
        rest = keep(rest.join(first, ["lat", "lng"], "left_anti"))
    at = F.row_number().over(Window.partitionBy("lat", "lng").orderBy("b"))
    found.append(_names_within(rest, named, metres).withColumn("n", at).where(F.col("n") <= most).groupBy("lat", "lng").agg(F.collect_list("b").alias("bs")))
    names = reduce(DataFrame.unionByName, found).select("lat", "lng", F.transform(F.array_sort("bs"), lambda x: x["name"]).alias("names"))
    boxes = areas.select(F.trim("name").alias("area"), "min_lat", "min_lng", "max_lat", "max_lng", F.explode(F.sequence(geo.cell(F.col("min_lat"), 1.0), geo.cell(F.col("max_lat"), 1.0))).alias("y"), F.sequence(geo.cell(F.col("min_lng"), 1.0), geo.cell(F.col("max_lng"), 1.0)).alias("xs")).where("area <> ''").select("*", F.explode("xs").alias("x"))
    inside = F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lng").between(F.col("min_lng"), F.col("max_lng"))
    held = spots.select("lat", "lng", geo.cell(F.col("lat"), 1.0).alias("y"), geo.cell(F.col("lng"), 1.0).alias("x")).join(boxes, ["y", "x"]).where(inside).groupBy("lat", "lng").agg(F.min("area").alias("area"))
    told = spots.join(names, ["lat", "lng"], "left").join(held, ["lat", "lng"], "left")
    both = points.select("point_id", "lat", "lng").join(told, ["lat", "lng"], "left")
    return both.select("point_id", F.coalesce("names", F.when(F.col("area").isNotNull(), F.array("area")), F.array().cast("array<string>")).alias("names"))


def camera_directory(cameras: DataFrame, districts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cameras (district, position, id …), the first of each id by district and position, of districts ever fetched; and one row of how far that can be relied on.

    districts: (district, fetched_at, failed). UNAVAILABLE when none was ever
    fetched, STALE when one failed or is missing, else OK; a directory that is
    not OK tells its oldest fetch.
    """
    served = cameras.join(districts.where("fetched_at IS NOT NULL").select("district"), "district", "left_semi")
    n = F.row_number().over(Window.partitionBy("id").orderBy("district", "position"))
    first = served.withColumn("_n", n).where("_n = 1").drop("_n")
    some, bad = F.count("fetched_at") > 0, F.bool_or(F.col("failed") | F.col("fetched_at").isNull())
    status = F.when(~some, "UNAVAILABLE").when(bad, "STALE").otherwise("OK")
    return first, districts.agg(status.alias("status"), F.when(some & bad, F.min("fetched_at")).alias("last_update"))


def cameras_near(cameras: DataFrame, coverage: DataFrame, places: DataFrame, metres: float) -> DataFrame:
    """place_id, id, metres, position: cameras (id, lat, lng) near the covered area and near a place, by distance and id. Shapes are bounded (geojson with its box)."""
    covered = spatial.points_near(cameras, coverage, metres).select(F.col("a.id").alias("id")).distinct()
    near = spatial.points_near(cameras.join(covered, "id", "left_semi"), places, metres).select("b.place_id", "a.id", "metres")
    return near.withColumn("position", F.row_number().over(Window.partitionBy("place_id").orderBy("metres", "id")))


#: Fixed value: where a scanner feed is heard.
LISTEN = "https://www.broadcastify.com/listen/feed/"


def scanners(places: DataFrame, feeds: DataFrame) -> DataFrame:
    """place_id, feed_id, label, agency, url, position of the configured scanner feeds (area, feed_id, label, agency, ord) of each place (place_id, slug, kind).

    An area that is configured has its own feeds, in their order; any other
    place has those of all areas, a feed once, where it is told first. Feeds
    are configuration, so all of them beside each such place is no large join.
    """
    told = feeds.select(F.struct("ord", "feed_id", "label", "agency").alias("f"), "area")
    first = told.groupBy(F.col("f.feed_id").alias("_id")).agg(F.min("f").alias("f")).select("f")
    configured = feeds.select(F.col("area").alias("slug")).distinct().withColumn("own", F.lit(True))
    of = places.select("place_id", "slug", "kind").join(configured, "slug", "left").withColumn("own", (F.col("kind") == "AREA") & F.coalesce("own", F.lit(False)))
    own = of.where("own").join(told.withColumnRenamed("area", "slug"), "slug").select("place_id", "f")
    every = of.where("NOT own").select("place_id").crossJoin(F.broadcast(first))
    w = Window.partitionBy("place_id").orderBy("f.ord", "f.feed_id")
    return own.unionByName(every).select("place_id", "f.feed_id", "f.label", "f.agency", F.concat(F.lit(LISTEN), "f.feed_id").alias("url"), F.row_number().over(w).alias("position"))


def condition_features(controls: DataFrame, roads: DataFrame, fire: DataFrame, signs: DataFrame) -> DataFrame:
    """layer, id, headline, severity, geojson of the four live condition layers: chain controls, road segments, fire weather and message signs that show something."""
    c = F.col
    point = F.when(c("lat").isNotNull() & c("lng").isNotNull(), geo.point_json(c("lat"), c("lng")))
    made = [
        controls.select(F.lit("CHAIN_CONTROL").alias("layer"), F.concat(F.lit("chain:"), "sign_id").alias("id"), F.concat_ws(" ", "highway", F.lit("chain control"), "level").alias("headline"), classify.from_chain_level(F.when(c("closed"), "CLOSED").otherwise(c("level"))).alias("severity"), point.alias("geojson")),
        roads.select(F.lit("ROAD_SEGMENT").alias("layer"), F.concat(F.lit("road:"), "route_id").alias("id"), F.concat(c("name"), F.lit(" — "), F.lower("status")).alias("headline"), classify.from_road(c("status"), c("congestion")).alias("severity"), geo.line_json(c("line")).alias("geojson")),
        fire.where("state <> 'NORMAL'").select(F.lit("FIRE_WEATHER").alias("layer"), F.concat(F.lit("fire-weather:"), "place").alias("id"), F.when(c("state") == "WATCH", "Fire Weather Watch").otherwise("Red Flag Warning").alias("headline"), F.when(c("state") == "WATCH", classify.MODERATE).otherwise(classify.SEVERE).alias("severity"), F.lit(None).cast("string").alias("geojson")),
        signs.where("in_service AND display IN ('ONE_PAGE', 'TWO_PAGES')").select(F.lit("MESSAGE_SIGN").alias("layer"), F.concat(F.lit("sign:"), "id").alias("id"), c("lines").alias("headline"), F.lit(classify.INFO).alias("severity"), point.alias("geojson")),
    ]
    return reduce(DataFrame.unionByName, made)
