"""Roads: chain controls of two sources, alerts by their distance to routes, conditions told in words, and what they make of a road.

Distances are joined on cells of a grid: a route is cut into its segments, each
in the cells about it, so no alert meets a route that is far away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import classify, geo, text
from tideway.operators import graph
from tideway.operators.cells import Tree

CELL = 0.1
ON_ROUTE, NEARBY, SAME_SIGN = 100.0, 5_000.0, 200.0
#: Degrees of a cell whose corners are less than SAME_SIGN apart.
SIGN_CELL = 0.7 * SAME_SIGN / geo.DEGREE_M
#: Chain signs of one control touch within so many miles, or lie within so many metres where they have no mileposts.
TOUCH_MILES, JOIN_METRES = 1.5, 15_000.0


def _about(tree: Tree, rows: DataFrame, lat_lo: Column, lat_hi: Column, lng_lo: Column, lng_hi: Column, metres: float) -> DataFrame:
    """rows in each cell that a box and so many metres about it meet, below 60 degrees of latitude."""
    pad = 1.01 * metres / geo.DEGREE_M  # a degree is 111,195 great-circle metres
    return tree.keyed(rows, lat_lo - pad, lat_hi + pad, lng_lo - 2 * pad, lng_hi + 2 * pad, False)


def _here(tree: Tree, points: DataFrame) -> DataFrame:
    lat, lng = F.col("lat"), F.col("lng")
    return tree.keyed(points, lat, lat, lng, lng, True)


def segments(routes: DataFrame, metres: float, tree: Tree) -> DataFrame:
    """route_id, p, q, _cell: each segment of routes (route_id, line of [lng, lat]) in every cell within so many metres of it."""
    ends = F.slice("line", F.lit(2), F.greatest(F.size("line") - 1, F.lit(1)))
    pairs = F.when(F.size("line") > 1, F.zip_with(F.slice("line", F.lit(1), F.size("line") - 1), ends, lambda p, q: F.struct(p.alias("p"), q.alias("q")))).otherwise(F.transform("line", lambda p: F.struct(p.alias("p"), p.alias("q"))))
    each = routes.select("route_id", F.explode(pairs).alias("s")).select("route_id", "s.p", "s.q")
    p, q = F.col("p"), F.col("q")
    return _about(tree, each, F.least(p[1], q[1]), F.greatest(p[1], q[1]), F.least(p[0], q[0]), F.greatest(p[0], q[0]), metres)


def distances(points: DataFrame, routes: DataFrame, metres: float, tree: Tree | None = None) -> DataFrame:
    """point_id, route_id, metres: points (point_id, lat, lng; several rows of an id are its vertices) within so many metres of a route, by the nearest."""
    tree = tree or Tree(CELL)
    both = _here(tree, points.select("point_id", "lat", "lng")).join(segments(routes, metres, tree), "_cell")
    off = geo.segment_metres(F.col("lat"), F.col("lng"), F.col("p"), F.col("q"))
    return both.groupBy("point_id", "route_id").agg(F.min(off).alias("metres")).where(F.col("metres") <= metres)


def classified(alerts: DataFrame, routes: DataFrame, tree: Tree | None = None) -> DataFrame:
    """alert_id, route_id, metres, class of alerts (alert_id, geojson) on or near a route; a line counts by its nearest corner, what is farther is left out."""
    corners = alerts.select(F.col("alert_id").alias("point_id"), F.explode(geo.vertices(F.col("geojson"))).alias("v")).select("point_id", F.col("v")[1].alias("lat"), F.col("v")[0].alias("lng"))
    near = distances(corners, routes, NEARBY, tree)
    return near.select(F.col("point_id").alias("alert_id"), "route_id", "metres", F.when(F.col("metres") <= ON_ROUTE, "ON_ROUTE").otherwise("NEARBY").alias("class"))


def nearby_suppressed(classes: DataFrame) -> DataFrame:
    """classes without the NEARBY rows of alerts that are on a route somewhere."""
    on = F.bool_or(F.col("class") == "ON_ROUTE").over(Window.partitionBy("alert_id"))
    return classes.withColumn("_on", on).where("class = 'ON_ROUTE' OR NOT _on").drop("_on")


def near_routes(points: DataFrame, routes: DataFrame, metres: float, tree: Tree | None = None) -> DataFrame:
    """Points (point_id, lat, lng …) within so many great-circle metres of a route's corner."""
    corners = routes.select(F.explode("line").alias("v")).distinct()
    lat, lng = F.col("v")[1], F.col("v")[0]
    tree = tree or Tree(CELL)
    about = _about(tree, corners, lat, lat, lng, lng, metres)
    hit = _here(tree, points.select("point_id", "lat", "lng")).join(about, "_cell").where(geo.haversine(F.col("lat"), F.col("lng"), lat, lng) <= metres).select("point_id").distinct()
    return points.join(hit, "point_id", "left_semi")


#: How the sign feed tells direction, level, closures and times in names and markup.
SIGN_DIRECTION, SIGN_LEVEL, SIGN_HIGHWAY, BARE_HIGHWAY = r"(?i)^(Eastbound|Westbound|Northbound|Southbound)\s+", r"(?i)R-?([123])", r"(?i)^(.+?)\s+(?:Chain\s+Control|Road\s+Closed)", r"(?i)^(?:Highway|Interstate|US|SR|I-)\s*\d+[A-Z]?$"
SIGN_CLOSED, EFFECTIVE, UPDATED, DISTRICT = r"(?i)\bRoad\s+Closed\b|\bClosed\s+to\s+traffic\b", r"(?i)effective from:\s*(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2})", r"(?i)Last updated:\s*(\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}[ap]m)", r"District:\s*(\d+)\s+Message ID:\s*(\d+)"


def signs(placemarks: DataFrame) -> DataFrame:
    """What chain-control placemarks (name, description, text, styleUrl, lat, lng) say: direction, highway, level, closed, place, and when they took effect and were last told, in seconds."""
    c = F.col
    name = F.trim(F.coalesce("name", F.lit("")))
    bare = F.regexp_replace(name, SIGN_DIRECTION, "")
    blank = lambda v: F.nullif(v, F.lit(""))
    closed = (F.lower(F.trim(F.coalesce("styleUrl", F.lit("")))) == "#full-closure") | name.rlike(SIGN_CLOSED) | F.coalesce(c("text").rlike(SIGN_CLOSED), F.lit(False))
    level = F.coalesce(blank(F.regexp_extract(bare, SIGN_LEVEL, 1)), F.when(~closed, blank(F.regexp_extract(F.coalesce("text", F.lit("")), r"(?i)Chain Control level R-?([123])\b", 1))))
    highway = F.coalesce(blank(F.trim(F.regexp_extract(bare, SIGN_HIGHWAY, 1))), F.when(bare.rlike(BARE_HIGHWAY), F.trim(bare)), F.lit(""))
    local = lambda said, how: F.unix_timestamp(F.to_utc_timestamp(F.try_to_timestamp(F.upper(blank(said)), F.lit(how)), "America/Los_Angeles"))
    markup = F.coalesce("description", F.lit(""))
    paragraphs = F.transform(F.regexp_extract_all(markup, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), 1), text.html_text)
    located = F.regexp_replace(F.coalesce(F.get(F.filter(paragraphs, lambda p: p.startswith("Location:")), 0), F.get(paragraphs, 0), F.lit("")), r"^Location:\s*", "")
    return placemarks.select(
        F.regexp_extract(name, SIGN_DIRECTION, 1).alias("direction"), highway.alias("highway"), F.when(level.isNotNull(), F.concat(F.lit("R"), level)).alias("level"), closed.alias("closed"), located.alias("place"), local(F.regexp_extract("text", EFFECTIVE, 1), "M/d/yyyy H:mm").alias("effective"),
        local(F.regexp_extract("text", UPDATED, 1), "M/d/yyyy h:mma").alias("updated"), blank(F.regexp_extract("text", DISTRICT, 1)).alias("district"), blank(F.regexp_extract("text", DISTRICT, 2)).alias("message_id"), "lat", "lng",
    )


def _same_sign(a: DataFrame, b: DataFrame) -> DataFrame:
    """sign_id of the signs of a that b has too: one at most SAME_SIGN metres off that is not said to face another way.

    Signs of one place and direction are looked up as one. Cells are so small
    that all signs of one are near enough, so only signs that have none that
    agrees in their own cell are compared with those of the cells about it.
    """
    lat, lng, said = F.col("lat"), F.col("lng"), F.lower(F.coalesce("direction", F.lit("")))
    finite, tree = "abs(lat) < double('Infinity') AND abs(lng) < double('Infinity')", Tree(SIGN_CELL)
    spots = lambda d: d.where(finite).select(said.alias("d"), "lat", "lng").distinct()
    own, there = _here(tree, spots(a)), _here(tree, spots(b))
    faces = F.when(F.col("d") == "", F.array(F.lit("*"))).otherwise(F.array(F.lit("="), F.concat(F.lit("="), "d")))
    told = there.select("_cell", F.explode(F.array(F.lit("*"), F.concat(F.lit("="), "d"))).alias("face")).distinct()
    found = own.withColumn("face", F.explode(faces)).join(told, ["_cell", "face"], "left_semi").select("d", "lat", "lng").distinct()
    rest = _about(tree, own.drop("_cell").join(found, ["d", "lat", "lng"], "left_anti"), lat, lat, lng, lng, SAME_SIGN)
    agree = (F.col("d") == "") | (F.col("bd") == "") | (F.col("d") == F.col("bd"))
    close = rest.join(there.withColumnsRenamed({"d": "bd", "lat": "blat", "lng": "blng"}), "_cell").where(agree & (geo.haversine(lat, lng, F.col("blat"), F.col("blng")) <= SAME_SIGN))
    both = found.unionByName(close.select("d", "lat", "lng").distinct())
    return a.select("sign_id", said.alias("d"), "lat", "lng").join(both, ["d", "lat", "lng"], "left_semi").select("sign_id").distinct()


def merged_controls(checkpoints: DataFrame, quiet: DataFrame, told: DataFrame) -> DataFrame:
    """Chain controls of both sources: rows (sign_id, direction, lat, lng, unrecognized, supplement …) of the checkpoints in force and of the told signs.

    A told sign is left out where a checkpoint that could be read says the same,
    unless it tells what checkpoints cannot (``supplement``). A checkpoint that
    could not be read is left out where a told sign that stays explains it. A
    told sign at a checkpoint that is quiet is marked ``uncorroborated``.
    """
    plain = told.where("NOT supplement")
    known = _same_sign(plain, checkpoints.where("NOT unrecognized"))
    stays = told.join(known, "sign_id", "left_anti")
    doubtful = _same_sign(stays.where("NOT supplement"), quiet).withColumn("uncorroborated", F.lit(True))
    stays = stays.join(doubtful, "sign_id", "left").withColumn("uncorroborated", F.coalesce("uncorroborated", F.lit(False)))
    explained = _same_sign(checkpoints.where("unrecognized"), stays)
    return checkpoints.join(explained, "sign_id", "left_anti").withColumn("uncorroborated", F.lit(False)).unionByName(stays)


def stretches(active: DataFrame, quiet: DataFrame, keep) -> DataFrame:
    """sign_id, stretch (the smallest sign_id of its group): signs of one highway and level whose extents touch.

    A sign with a milepost holds from it to the next sign, in force or quiet,
    in its direction of travel, or to the end of what is signed; extents within
    TOUCH_MILES touch. Signs without one join within JOIN_METRES.
    """
    c = F.col
    rising = F.when(F.lower(F.trim("direction")).isin("eastbound", "northbound"), True).when(F.lower(F.trim("direction")).isin("westbound", "southbound"), False)
    marks = active.select("sign_id", "highway", "direction", "milepost").unionByName(quiet.select(F.lit(None).cast("bigint").alias("sign_id"), "highway", "direction", "milepost"))
    marks = marks.withColumns({"road": text.highway_key(c("highway")), "rising": rising}).where("milepost IS NOT NULL AND rising IS NOT NULL AND highway <> ''")
    order = Window.partitionBy("road", "rising").orderBy("milepost", F.col("sign_id").asc_nulls_last())
    road = Window.partitionBy("road")
    lo = F.when(c("rising"), c("milepost")).otherwise(F.coalesce(F.lag("milepost").over(order), F.min("milepost").over(road)))
    hi = F.when(c("rising"), F.coalesce(F.lead("milepost").over(order), F.max("milepost").over(road))).otherwise(c("milepost"))
    spans = marks.select("sign_id", lo.alias("lo"), hi.alias("hi")).where("sign_id IS NOT NULL")
    rows = keep(active.where("highway <> ''").select("sign_id", text.highway_key(c("highway")).alias("road"), "level", "lat", "lng").join(spans, "sign_id", "left"))
    # Extents are sorted along the road: one touches what came before it exactly when it touches the farthest end so far.
    signed = rows.where("lo IS NOT NULL")
    along = Window.partitionBy("road", "level").orderBy("lo", "sign_id")
    reach = F.max_by("sign_id", F.struct("hi", "sign_id")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    end = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
    touching = signed.select("sign_id", "lo", reach.alias("b"), end.alias("end")).where(c("lo") <= c("end") + TOUCH_MILES).select(c("sign_id").alias("a"), "b")
    pad = 2 * JOIN_METRES / geo.DEGREE_M
    cell = lambda d: (geo.cell(c(f"{d}lat"), pad), geo.cell(c(f"{d}lng"), pad))
    # Signs of one place meet others as one. Those without an extent are one group there; those with one are if something near joins them.
    spot = F.min("sign_id").over(Window.partitionBy("road", "level", "lat", "lng", "s"))
    placed = rows.where("lat IS NOT NULL AND lng IS NOT NULL AND road IS NOT NULL AND level IS NOT NULL").withColumn("s", c("lo").isNotNull()).select("sign_id", "road", "level", "lat", "lng", "s", spot.alias("spot"))
    placed = keep(placed)
    spots = placed.where("sign_id = spot")
    left = spots.select(c("spot").alias("a"), "road", "level", "lat", "lng", c("s").alias("sa"), *(v.alias(n) for v, n in zip(cell(""), ("y", "x"), strict=True)))
    about = spots.select(c("spot").alias("b"), "road", "level", c("lat").alias("blat"), c("lng").alias("blng"), c("s").alias("sb"), F.explode(F.sequence(cell("")[0] - 1, cell("")[0] + 1)).alias("y"), cell("")[1].alias("x0"))
    about = about.select("*", F.explode(F.sequence(c("x0") - 1, c("x0") + 1)).alias("x")).drop("x0")
    close = keep(left.join(about, ["road", "level", "y", "x"]).where((c("a") < c("b")) & ~(c("sa") & c("sb")) & (geo.haversine(c("lat"), c("lng"), c("blat"), c("blng")) <= JOIN_METRES)).select("a", "b"))
    joined = close.select(c("a").alias("spot")).unionByName(close.select(c("b").alias("spot"))).distinct()
    others = placed.where("sign_id <> spot")
    members = others.where("NOT s").unionByName(others.where("s").join(joined, "spot", "left_semi").select(*others.columns))
    close = close.unionByName(members.select(c("spot").alias("a"), c("sign_id").alias("b")))
    roots = graph.components(touching.unionByName(close), keep)
    return active.select("sign_id").join(roots, active.sign_id == roots.node, "left").select("sign_id", F.coalesce("root", "sign_id").alias("stretch"))


def nearest_control(routes: DataFrame, controls: DataFrame, metres: float = 5_000.0) -> DataFrame:
    """route_id, sign_id, metres: the control of a route's own highway nearest to one of its corners, below so many metres; closures and what could not be read do not count."""
    c = F.col
    usable = controls.where("NOT unrecognized AND NOT closed AND lat IS NOT NULL AND lng IS NOT NULL").select("sign_id", text.highway_number(c("highway")).alias("number"), "lat", "lng").where("number IS NOT NULL")
    lines = routes.select("route_id", text.highway_number(c("name")).alias("number"), "line").where("number IS NOT NULL")
    near = lines.join(usable, "number").select("route_id", "sign_id", geo.nearest_vertex(c("lat"), c("lng"), c("line")).alias("metres")).where(c("metres") < metres)
    return near.groupBy("route_id").agg(F.min_by("sign_id", F.struct("metres", "sign_id")).alias("sign_id"), F.min("metres").alias("metres"))


def matched_conditions(conditions: DataFrame, sections: DataFrame) -> DataFrame:
    """condition_id, section_id: conditions (condition_id, highway, text) of a section's highway whose text names one of its places or keywords."""
    words = F.array_distinct(F.transform(F.concat(text.section_places(F.col("section")), F.coalesce("keywords", F.array().cast("array<string>"))), lambda w: F.lower(w)))
    s = sections.select("section_id", "highway", words.alias("words"))
    both = conditions.select("condition_id", "highway", F.lower("text").alias("said")).join(s, "highway")
    return both.where(F.exists("words", lambda w: (w != "") & F.contains(F.col("said"), w))).select("condition_id", "section_id")


def folded(routes: DataFrame, causes: DataFrame, controls: DataFrame) -> DataFrame:
    """A row for each route: status, explanation, chain, causes.

    causes (route_id, ord, status, details, chain) come in order: the last
    closure that explains itself explains a closed road, the first restriction
    a restricted one. Chains are REQUIRED at R1 or R2 or with a control on the
    route, ADVISED where a report says no more than that they are. An open road
    has no causes.
    """
    c = F.col
    told = F.coalesce(F.nullif(F.trim("details"), F.lit("")))
    closed, limited = c("status") == "closed", c("status") == "restricted"
    first_limit = F.min_by(F.when(limited & told.isNotNull(), told), F.when(limited & told.isNotNull(), c("ord")))
    by = causes.groupBy("route_id").agg(
        F.bool_or(closed).alias("shut"), F.bool_or(limited).alias("limited"), F.max_by(F.when(closed, told), F.when(closed & told.isNotNull(), c("ord"))).alias("why_shut"), first_limit.alias("why_limited"),
        F.bool_or(c("chain").isin("r1", "r2")).alias("required"), F.bool_or(c("chain") == "active_unspecified").alias("advised"), F.count_if(closed | limited).alias("n"),
    )
    rows = routes.select("route_id").join(by, "route_id", "left").join(controls.select("route_id", "sign_id"), "route_id", "left")
    shut, slow = F.coalesce("shut", F.lit(False)), F.coalesce("limited", F.lit(False))
    status = F.when(shut, "CLOSED").when(slow, "RESTRICTED").otherwise("OPEN")
    why = F.when(shut, F.coalesce("why_shut", "why_limited", F.lit(""))).when(slow, F.coalesce("why_limited", F.lit(""))).otherwise("")
    chain = F.when(F.col("sign_id").isNotNull() | F.coalesce("required", F.lit(False)), "REQUIRED").when(F.coalesce("advised", F.lit(False)), "ADVISED").otherwise("NONE")
    return rows.select("route_id", status.alias("status"), why.alias("explanation"), chain.alias("chain"), F.when(status == "OPEN", 0).otherwise(c("n")).cast("bigint").alias("causes"))


def traffic(bodies: DataFrame) -> DataFrame:
    """road_id, minutes, usual_minutes, kilometres, delay, congestion, polyline of answers of a routing service (road_id, body); the first route counts."""
    r = bodies.select("road_id", F.from_json("body", "routes array<struct<distanceMeters:bigint,duration:string,staticDuration:string,polyline:struct<encodedPolyline:string>>>")["routes"][0].alias("r"))
    seconds = lambda n: F.regexp_extract(F.col(f"r.{n}"), r"^(\d+)(?:\.\d+)?s$", 1).try_cast("bigint")
    minutes, usual = F.floor(seconds("duration") / 60), F.floor(seconds("staticDuration") / 60)
    delay = F.greatest(F.lit(0), F.floor((seconds("duration") - seconds("staticDuration")) / 60))
    return r.where("r IS NOT NULL").select("road_id", minutes.cast("int").alias("minutes"), usual.cast("int").alias("usual_minutes"), F.floor(F.col("r.distanceMeters") / 1000).cast("int").alias("kilometres"), delay.cast("int").alias("delay"), classify.congestion(delay).alias("congestion"), F.col("r.polyline.encodedPolyline").alias("polyline"))


def samples(roads: DataFrame, at: int) -> DataFrame:
    """road, sampled_at, status, minutes: one sample of each road, to be added to those that are stored."""
    number = F.when(F.col("status") == "OPEN", 1).when(F.col("status") == "RESTRICTED", 2).otherwise(3)
    return roads.where("road IS NOT NULL").select("road", F.lit(at).cast("bigint").alias("sampled_at"), number.alias("status"), "minutes")
