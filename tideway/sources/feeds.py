"""Parsers of the feeds: a DataFrame with one raw body a row (column ``body``) becomes rows.

Bodies come from files (``spark.read.text(.., wholetext=True)``), a landing
table or a stream; nothing here fetches. Rules that reject a whole body (an
error envelope, a truncated answer, an empty table) are columns of
``envelope``, so that a caller commits nothing from a body that failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions import classify, geo, text, times

POINT = "geometry struct<type:string,coordinates:array<double>>"
PLACE = "location:struct<district:string,locationName:string,nearbyPlace:string,longitude:string,latitude:string,elevation:string,direction:string,county:string,route:string,postmile:string,milepost:string>"
STAMP = "recordTimestamp:struct<recordDate:string,recordTime:string>"


def _rows(bodies: DataFrame, schema: str, path: str) -> DataFrame:
    return bodies.select(F.explode(F.from_json("body", schema)[path] if path else F.from_json("body", schema)).alias("r"))


def envelope(bodies: DataFrame, list_name: str = "features") -> DataFrame:
    """Each body with why it must not be used: an error answer, a truncated one, or one without rows; null when it may."""
    said = lambda path: F.get_json_object("body", path)
    n = F.coalesce(F.json_array_length(said(f"$.{list_name}")), F.lit(-1))
    cut = F.coalesce(said("$.exceededTransferLimit"), said("$.properties.exceededTransferLimit")) == "true"
    why = F.when(said("$.error").isNotNull(), "error").when(cut, "truncated").when(n < 0, "unreadable").when(n == 0, "empty")
    return bodies.withColumn("rejected", why)


def fresh(rows: DataFrame, stamp: str, now: Column, stale_seconds: int) -> DataFrame:
    """One row: whether a file's newest stamp is recent. Rows without any readable stamp are not."""
    newest = F.max(stamp)
    return rows.agg(F.count("*").alias("rows"), newest.alias("newest"), F.coalesce(now - newest <= stale_seconds, F.lit(False)).alias("is_fresh"))


def fires(bodies: DataFrame) -> DataFrame:
    """Fire incidents; unknown numbers are 0, stamps without an offset are local."""
    r = _rows(bodies, "array<struct<UniqueId:string,Name:string,County:string,Location:string,AcresBurned:double,PercentContained:double,Latitude:double,Longitude:double,Started:string,Updated:string,Url:string,IsActive:boolean>>", "")
    number = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0.0))
    return r.select(
        F.concat(F.lit("calfire:"), "r.UniqueId").alias("id"), F.col("r.Name").alias("name"), F.col("r.County").alias("county"), F.col("r.Location").alias("location"), F.col("r.Url").alias("url"), number("AcresBurned").alias("acres"), number("PercentContained").cast("int").alias("contained"), number("Latitude").alias("lat"), number("Longitude").alias("lng"),
        F.unix_timestamp(times.local_or_rfc(F.col("r.Started"))).alias("started"), F.unix_timestamp(times.local_or_rfc(F.col("r.Updated"))).alias("updated"), F.col("r.IsActive").alias("active"),
    )


def quakes(bodies: DataFrame, least: float = 2.5) -> DataFrame:
    """Earthquakes of at least a magnitude."""
    r = _rows(bodies, f"features array<struct<id:string,properties:struct<mag:double,place:string,time:bigint,updated:bigint,felt:int,url:string>,{POINT.replace(' ', ':', 1)}>>", "features")
    p = r.select("r.id", "r.properties.*", F.col("r.geometry.coordinates").alias("c")).where(F.col("mag") >= least)
    return p.select(F.concat(F.lit("usgs:"), "id").alias("id"), "mag", "place", F.floor(F.col("time") / 1000).alias("at_seconds"), F.floor(F.nullif("updated", F.lit(0)) / 1000).alias("updated"), "url", F.col("c")[1].alias("lat"), F.col("c")[0].alias("lng"), F.col("c")[2].alias("depth_km"), F.coalesce("felt", F.lit(0)).alias("felt"), classify.from_magnitude(F.col("mag")).alias("severity"))


def shapes(bodies: DataFrame, properties: str) -> DataFrame:
    """``seq`` (the order in the bodies), the properties and ``geojson`` (any geometry, as the source wrote it) of each feature of a collection."""
    each = bodies.select(F.struct(F.monotonically_increasing_id().alias("m"), F.lit(0).alias("n")).alias("at"), F.posexplode(F.from_json("body", "features array<string>")["features"]).alias("n", "f"))
    p = F.from_json(F.get_json_object("f", "$.properties"), properties)
    g = F.get_json_object("f", "$.geometry")
    read = F.struct(p.alias("p"), geo.let(g, lambda t: F.when(geo.vertices(t).isNotNull(), t)).alias("geojson"))
    return each.select((F.col("at.m") * 1_000_000 + F.col("n")).alias("seq"), F.inline(F.array(read))).select("seq", "p.*", "geojson")  # conditions on what was read do not read again


def evacuations(bodies: DataFrame, area: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Evacuation zones that are in force, with their coded level and shape, those that meet an area where one is given. A zone whose status is blank is listed, so it counts as a WARNING."""
    r = shapes(bodies, "ZONE_ID string, ZONE_NAME string, COUNTY string, STATUS string, EVENT_TYPE string, PUBLIC_INFO string, NOTES string, STATEWIDE_LAST_UPDATED bigint")
    level = F.coalesce(classify.evacuation_level(F.col("STATUS")), F.when(~classify.evacuation_inactive(F.col("STATUS")), "WARNING"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    rows = r.select(
        F.concat(F.lit("caloes:"), "ZONE_ID").alias("id"), "seq", blank("ZONE_NAME").alias("name"), blank("COUNTY").alias("county"), level.alias("level"), F.col("EVENT_TYPE").alias("event_type"), F.col("PUBLIC_INFO").alias("info"),
        F.floor(F.col("STATEWIDE_LAST_UPDATED") / 1000).alias("updated"), "geojson",
    )
    rows = rows.where("level is not null").withColumn("severity", classify.from_evacuation_level(F.col("level")))
    return rows.where(geo.boxes_meet(geo.box(F.col("geojson")), tuple(map(F.lit, area)))) if area else rows


def outages(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Outage points and areas of one id as one row; the first point of an id counts (in the order of ``block`` where the bodies have that column), areas without a point stay, and an id's areas are one MultiPolygon."""
    schema = "features array<struct<properties:struct<OUTAGE_ID:string,OUTAGE_CAUSE:string,EST_CUSTOMERS:int,OUTAGE_START:bigint,LAST_UPDATE:bigint>,geometry:struct<type:string,coordinates:array<double>>>>"
    block = F.col("block") if "block" in points.columns else F.lit(0)
    p = points.select(block.alias("block"), F.posexplode(F.from_json("body", schema)["features"]).alias("n", "r")).where("r.properties.OUTAGE_ID <> ''")
    first = p.groupBy(F.col("r.properties.OUTAGE_ID").alias("id")).agg(F.min_by("r", F.struct("block", "n")).alias("r"))
    q = shapes(polygons, "OUTAGE_ID string").where("OUTAGE_ID <> '' AND geojson IS NOT NULL").withColumn("parts", geo.polygons(F.col("geojson")))
    q = q.where("parts IS NOT NULL").groupBy(F.col("OUTAGE_ID").alias("id")).agg(F.sum(F.size("parts")).cast("int").alias("areas"), geo.multi_polygon_json(F.flatten(F.array_sort(F.collect_list("parts")))).alias("geojson"))
    both = first.join(q, "id", "full")
    customers = F.coalesce("r.properties.EST_CUSTOMERS", F.lit(0))
    cause = F.coalesce("r.properties.OUTAGE_CAUSE", F.lit(""))
    seconds = lambda c: F.floor(F.nullif(F.col(f"r.properties.{c}"), F.lit(0)) / 1000)
    return both.select(
        "id", customers.alias("customers"), cause.alias("cause"), F.col("r.geometry.coordinates")[1].alias("lat"), F.col("r.geometry.coordinates")[0].alias("lng"), F.coalesce("areas", F.lit(0)).alias("areas"), "geojson", seconds("OUTAGE_START").alias("started"), seconds("LAST_UPDATE").alias("updated"),
        classify.from_power_outage(customers, F.lower(cause).contains("planned")).alias("severity"),
    )


def shutoffs(bodies: DataFrame) -> DataFrame:
    """Shutoff areas grouped by event and period: the most severe stage, the earliest start, customers as text or 0, all areas as one MultiPolygon."""
    r = shapes(bodies, "EventID string, TimePeriod string, Stage string, TotCustAff string, DeEngStart string")
    n = F.coalesce(F.trim("TotCustAff").try_cast("int"), F.lit(0))
    rows = r.select(F.concat_ws(":", F.lit("psps"), "EventID", "TimePeriod").alias("id"), F.col("Stage").alias("stage"), n.alias("customers"), F.unix_timestamp(F.try_to_timestamp("DeEngStart")).alias("starts"), classify.from_psps_stage(F.col("Stage")).alias("severity"), geo.polygons(F.col("geojson")).alias("parts"))
    return rows.groupBy("id").agg(
        F.max_by("stage", F.struct("severity", F.col("stage"))).alias("stage"), F.sum("customers").alias("customers"), F.min("starts").alias("starts"), F.max("severity").alias("severity"), geo.multi_polygon_json(F.flatten(F.array_sort(F.collect_list("parts")))).alias("geojson"),
    )


def weather_alerts(bodies: DataFrame, zones: str = "") -> DataFrame:
    """Alerts of the wanted zones (all, when none is wanted or an alert names none), with whom they replace."""
    schema = "features array<struct<properties:struct<id:string,event:string,severity:string,certainty:string,urgency:string,headline:string,description:string,instruction:string,senderName:string,parameters:map<string,array<string>>,effective:string,onset:string,expires:string,messageType:string,replacedBy:string,geocode:struct<UGC:array<string>>,references:array<struct<identifier:string>>>>>"
    r = _rows(bodies, schema, "features").select("r.properties.*")
    wanted = F.array_distinct(F.transform(text.list_of(F.upper(F.lit(zones))), lambda z: F.trim(z)))
    own = F.coalesce("geocode.UGC", F.array().cast("array<string>"))
    rows = r.where((F.size(wanted) == 0) | (F.size(own) == 0) | F.arrays_overlap(wanted, own))
    starts = F.coalesce(F.try_to_timestamp("onset"), F.try_to_timestamp("effective"))
    line = F.coalesce(F.get(F.col("parameters")["NWSheadline"], 0), F.lit(""))
    return rows.select("id", "event", F.col("severity").alias("said"), "certainty", "urgency", line.alias("headline"), "description", "instruction", F.col("senderName").alias("sender"), classify.from_nws_severity(F.col("severity")).alias("severity"), own.alias("zones"), F.unix_timestamp(starts).alias("starts"), F.unix_timestamp(F.try_to_timestamp("expires")).alias("expires"), F.col("messageType").alias("kind"), F.transform(F.coalesce("references", F.array()), lambda x: x["identifier"]).alias("replaces"), F.element_at(F.split("replacedBy", "/"), -1).alias("replaced_by"))


def standing_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts that no other listed one replaces and that are no cancellation."""
    gone = alerts.select(F.explode("replaces").alias("id")).distinct()
    return alerts.where("kind <> 'Cancel'").join(gone, "id", "left_anti")


def _located(p: str) -> list[Column]:
    number = lambda c: F.trim(F.col(f"{p}.location.{c}")).try_cast("double")
    return [F.trim(F.col(f"{p}.location.route")).alias("route"), F.trim(F.col(f"{p}.location.county")).alias("county"), number("latitude").alias("lat"), number("longitude").alias("lng")]


def _local(date: str, time: str) -> Column:
    stamp = F.concat_ws(" ", F.trim(F.col(date)), F.trim(F.col(time)))
    at = F.to_utc_timestamp(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")), "America/Los_Angeles")
    return F.when(F.year(at) >= 2000, F.unix_timestamp(at))


def chain_controls(bodies: DataFrame) -> DataFrame:
    """Chain checkpoints; a status that is no level from R-0 to R-3 is UNKNOWN."""
    r = _rows(bodies, f"data array<struct<cc:struct<index:string,{STAMP},{PLACE},inService:string,statusData:struct<status:string,statusDescription:string>>>>", "data")
    level = F.regexp_extract(F.trim("r.cc.statusData.status"), r"^(?i)R-?([0-3])$", 1)
    return r.select(F.trim("r.cc.index").alias("id"), *_located("r.cc"), _local("r.cc.recordTimestamp.recordDate", "r.cc.recordTimestamp.recordTime").alias("recorded_at"), (F.lower(F.trim("r.cc.inService")) == "true").alias("in_service"), F.when(level == "", "UNKNOWN").otherwise(F.concat(F.lit("R"), level)).alias("level"))


def message_signs(bodies: DataFrame) -> DataFrame:
    """Message signs with the lines of up to two phases."""
    phase = lambda n: f"phase{n}:struct<phase{n}Line1:string,phase{n}Line2:string,phase{n}Line3:string>"
    r = _rows(bodies, f"data array<struct<cms:struct<index:string,{STAMP},{PLACE},inService:string,message:struct<display:string,{phase(1)},{phase(2)}>>>>", "data")
    said = lambda n: F.filter(F.transform(F.array(*(F.col(f"r.cms.message.phase{n}.phase{n}Line{k}") for k in (1, 2, 3))), lambda s: F.trim(F.coalesce(s, F.lit("")))), lambda s: (s != "") & (F.lower(s) != "not reported"))
    shown = F.lower(F.trim("r.cms.message.display"))
    one, two = said(1), said(2)
    kind = F.when(shown.contains("blank"), "BLANK").when((F.size(one) > 0) & (F.size(two) > 0), "TWO_PAGES").when((F.size(one) > 0) | (F.size(two) > 0), "ONE_PAGE").otherwise("UNKNOWN")
    return r.select(F.trim("r.cms.index").alias("id"), *_located("r.cms"), _local("r.cms.recordTimestamp.recordDate", "r.cms.recordTimestamp.recordTime").alias("recorded_at"), kind.alias("display"), F.array_join(F.concat(one, two), " / ").alias("lines"))


def cameras(bodies: DataFrame, district: int) -> DataFrame:
    """Cameras in service that have a position and an https image."""
    r = _rows(bodies, f"data array<struct<cctv:struct<index:string,{STAMP},{PLACE},inService:string,imageData:struct<imageDescription:string,static:struct<currentImageUpdateFrequency:string,currentImageURL:string>>>>>", "data")
    every = F.trim("r.cctv.imageData.static.currentImageUpdateFrequency").try_cast("int")
    url = F.trim("r.cctv.imageData.static.currentImageURL")
    rows = r.select(F.concat(F.lit(f"d{district}-"), F.trim("r.cctv.index")).alias("id"), F.trim("r.cctv.location.locationName").alias("name"), *_located("r.cctv"), F.greatest(F.coalesce(every, F.lit(0)), F.lit(0)).alias("minutes"), F.when(url.rlike("^https://[^/]+"), url).alias("image"), (F.lower(F.trim("r.cctv.inService")) == "true").alias("in_service"))
    return rows.where("in_service AND image IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL AND NOT (lat = 0 AND lng = 0)").drop("in_service")


def lane_closures(bodies: DataFrame) -> DataFrame:
    """Lane closures, their window from epochs or local stamps, their severity and what is not understood."""
    stamp = lambda k: f"{k}Date:string,{k}Time:string,{k}Epoch:string"
    r = _rows(
        bodies,
        f"data array<struct<lcs:struct<index:string,location:struct<travelFlowDirection:string,begin:map<string,string>,end:map<string,string>>,closure:struct<closureID:string,logNumber:string,closureTimestamp:struct<{stamp('closureStart')},{stamp('closureEnd')},isClosureEndIndefinite:string>,facility:string,typeOfClosure:string,typeOfWork:string,estimatedDelay:string,lanesClosed:string,totalExistingLanes:string,code1097:struct<isCode1097:string>,code1098:struct<isCode1098:string>,code1022:struct<isCode1022:string>>>>>",
        "data",
    )
    c, t = "r.lcs.closure", "r.lcs.closure.closureTimestamp"
    when = lambda k: F.coalesce(F.trim(F.col(f"{t}.{k}Epoch")).try_cast("bigint"), _local(f"{t}.{k}Date", f"{t}.{k}Time"))
    flag = lambda path: F.lower(F.trim(F.col(path)))
    codes = [f"{c}.code{n}.isCode{n}" for n in (1097, 1098, 1022)]
    lat, lng = F.col("r.lcs.location.begin")["beginLatitude"].try_cast("double"), F.col("r.lcs.location.begin")["beginLongitude"].try_cast("double")
    why = F.when(lat.isNull() | lng.isNull(), "position").when(F.exists(F.array(*(flag(p) for p in codes)), lambda x: ~x.isin("true", "false")), "flag")
    total = F.coalesce(F.trim(F.col(f"{c}.totalExistingLanes")).try_cast("int"), F.lit(0))
    place = lambda end, k: F.col(f"r.lcs.location.{end}")[f"{end}{k}"]
    end_lat, end_lng = (place("end", k).try_cast("double") for k in ("Latitude", "Longitude"))
    return r.select(
        F.monotonically_increasing_id().alias("seq"), F.trim("r.lcs.location.travelFlowDirection").alias("direction"), F.trim(F.col(f"{c}.facility")).alias("facility"), F.trim(F.col(f"{c}.typeOfClosure")).alias("closure_type"), F.trim(F.col(f"{c}.typeOfWork")).alias("work_type"), F.col(f"{c}.lanesClosed").alias("lanes"),
        total.alias("total_lanes"), F.trim(F.col(f"{c}.estimatedDelay")).try_cast("int").alias("delay"), end_lat.alias("end_lat"), end_lng.alias("end_lng"), place("begin", "LocationName").alias("from_name"), place("end", "LocationName").alias("to_name"), place("begin", "NearbyPlace").alias("near"),
        F.coalesce(F.trim(F.col(f"{t}.closureStartEpoch")).try_cast("bigint")).alias("recorded_at"),
        F.concat_ws("-", F.trim(f"{c}.closureID"), F.trim(f"{c}.logNumber")).alias("id"), F.upper(F.trim(F.col("r.lcs.location.begin")["beginRoute"])).alias("route"), lat.alias("lat"), lng.alias("lng"), when("closureStart").alias("starts"), F.when(flag(f"{t}.isClosureEndIndefinite") != "true", when("closureEnd")).alias("ends"),
        *(F.coalesce(flag(p) == "true", F.lit(False)).alias(n) for p, n in zip(codes, ("in_place", "picked_up", "cancelled"), strict=True)),
        classify.from_lane_closure(F.col(f"{c}.facility"), F.col(f"{c}.typeOfClosure"), F.col(f"{c}.lanesClosed"), total).alias("severity"), why.alias("unrecognized"),
    )


def closure_phase(rows: DataFrame, now: Column, grace: int = 12 * 3600) -> DataFrame:
    """CANCELLED, COMPLETED, ACTIVE (with a grace after the planned end) or SCHEDULED."""
    over = F.col("ends").isNotNull() & (now >= F.col("ends") + F.when(F.col("in_place"), grace).otherwise(0))
    return rows.withColumn("phase", F.when(F.col("cancelled"), "CANCELLED").when(F.col("picked_up") | over, "COMPLETED").when(F.col("in_place"), "ACTIVE").otherwise("SCHEDULED"))


def tagged(html: Column, tag: str) -> Column:
    """The elements of one tag, none inside another, as structs of their attributes and what they hold."""
    parts = F.split(html, f"(?i)</{tag}\\s*>")
    opened = rf"(?is)<{tag}(\s[^>]*)?>(.*)$"
    found = F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.rlike(x, F.lit(opened)))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, opened, 1).alias("attributes"), F.regexp_extract(x, opened, 2).alias("body")))


def classed(html: Column, tag: str, *marks: str) -> Column:
    """What the elements of a tag hold whose attributes have one of the marks."""
    return F.transform(F.filter(tagged(html, tag), lambda e: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(e["attributes"], m))), lambda e: e["body"])


PLACEMARK = "name string, description string, styleUrl string, Point struct<coordinates:string>, LineString struct<coordinates:string>"


def placemarks(bodies: DataFrame) -> DataFrame:
    """Placemarks of KML bodies that have a place; a blank name comes from the markup's title."""
    each = bodies.select(F.explode(tagged(F.col("body"), "Placemark")).alias("e"))
    p = each.select(F.from_xml(F.concat(F.lit("<Placemark>"), "e.body", F.lit("</Placemark>")), PLACEMARK).alias("p")).select("p.*")
    where = F.coalesce("Point.coordinates", "LineString.coordinates")
    first = F.split(F.element_at(F.split(F.trim(where), r"\s+"), 1), ",")
    title = text.html_text(F.coalesce(F.get(classed(F.col("description"), "h2", "iw-title"), 0), F.lit("")))
    rows = p.where(F.trim(where) != "").select(F.when(F.trim("name") != "", F.trim("name")).otherwise(title).alias("name"), "description", text.html_text(F.col("description")).alias("text"), "styleUrl", first[1].try_cast("double").alias("lat"), first[0].try_cast("double").alias("lng"))
    return rows


#: How the dispatch writes an incident's own number, and its stamps.
LOG_NUMBER, LOG_STAMP = "[0-9]{6}[A-Z]{2}[0-9]{4}", "MMM d yyyy h:mma"


def labelled(said: Column, label: str) -> Column:
    """The word after a label; null where there is none."""
    return F.nullif(F.regexp_extract(said, rf"(?i)\b{label}:?\s*(\w+)", 1), F.lit(""))


def incident_details(rows: DataFrame) -> DataFrame:
    """Log lines, title, place and ids read from an incident's markup (column ``description``)."""
    said = text.html_text(F.col("description"))
    paragraphs = classed(F.col("description"), "p", "iw-text", 'align="left"')
    lines = text.br_segments(F.element_at(paragraphs, 1))
    log = F.flatten(F.transform(F.slice(paragraphs, F.lit(2), F.greatest(F.size(paragraphs) - 1, F.lit(0))), text.br_segments))
    # A line is its stamp, its number in brackets, and what was logged.
    cut = F.transform(log, lambda x: F.split(x, r"\s*[\[\]]\s*", 3))
    at = lambda x: F.try_to_timestamp(F.upper(F.regexp_replace(x[0], r"\s+", " ")), F.lit(LOG_STAMP))
    real = F.filter(cut, lambda x: (F.size(x) == 3) & F.get(x, 1).rlike("^[0-9]+$") & (F.get(x, 2) != "") & at(x).isNotNull())
    entry = lambda x: F.struct(x[1].cast("int").alias("number"), x[0].alias("stamp"), x[2].alias("text"))
    plain = F.nullif(F.regexp_extract(said, f"({LOG_NUMBER})", 1), F.lit(""))
    return rows.select(
        "*", F.coalesce(labelled(said, "Log Number"), plain, labelled(said, "CHP Incident")).alias("log_number"), labelled(said, "Closure ID").alias("closure_id"), F.get(lines, 0).alias("first_line"), F.get(lines, 1).alias("second_line"), F.array_sort(F.transform(real, entry)).alias("log"),
    )


#: An incident's code before its type, and what its short words mean.
TYPE_CODE = r"^(?:[0-9]+|[A-Z]{2,})-"
SHORT_WORDS = {"Trfc": "Traffic", "Unkn": "Unknown", "Inj": "Injury", "Vehs": "Vehicles", "Veh": "Vehicle"}


def incident_type(label: Column) -> Column:
    """An incident's type without its code, spelled out."""
    return F.trim(text.swap(F.regexp_replace(label, TYPE_CODE, ""), *((rf"(?i)\b{short}\b", whole) for short, whole in SHORT_WORDS.items())))


def road_conditions(bodies: DataFrame, highway: str) -> DataFrame:
    """The condition paragraphs of a highway's section, by area, with their kind."""
    # A page is cut at its headings; a section ends at a rule.
    sections = bodies.select(F.explode(F.slice(F.split("body", "(?i)<h3[^>]*>"), 2, 100_000)).alias("s")).select(F.split("s", "(?i)</h3>", 2).alias("s")).where(F.size("s") == 2)
    own = sections.where(F.upper(text.html_text(F.col("s")[0])) == f"SR {highway}".upper()).select(F.split(F.col("s")[1], "(?i)<hr")[0].alias("html"))
    p = own.select(F.explode(tagged(F.col("html"), "p")).alias("p")).select(text.html_text(F.col("p.body")).alias("said"))
    bracket = F.split(F.regexp_replace("said", r"^\[", ""), r"\]\s*", 2)
    named = F.col("said").startswith("[") & (F.size(bracket) == 2)
    rows = p.select(F.when(named, bracket[0]).otherwise("").alias("area"), F.when(named, F.get(bracket, 1)).otherwise(F.col("said")).alias("text"))
    return rows.where("text <> ''").withColumn("kind", condition_kind(F.col("text")))


#: What tells that chains are required, where "no chains required" tells the opposite.
CHAINS_REQUIRED = r"(?<!no )\bchains(?: or (?:snow tires|traction devices))? (?:are )?required\b"


def condition_kind(said: Column) -> Column:
    """Closure before chain control before restriction before chain information."""
    t = F.lower(said)
    return F.when(t.contains("closed"), "CLOSURE").when(t.rlike(CHAINS_REQUIRED), "CHAIN_CONTROL").when(t.contains("one-way") | t.contains("restricted") | t.contains("not advised"), "RESTRICTION").when(t.contains("chain"), "CHAIN_INFO").otherwise("INFO")


def burn_table(bodies: DataFrame) -> DataFrame:
    """County burn status; the last row of a county counts."""
    rows = bodies.select(F.posexplode(tagged(F.col("body"), "tr")).alias("n", "tr"))
    cells = F.transform(tagged(F.col("tr.body"), "td"), lambda c: text.html_text(c["body"]))
    r = rows.select("n", cells.alias("c")).where(F.size("c") >= 2).select("n", F.trim(F.regexp_replace(F.col("c")[0], r"\s*County\s*$", "")).alias("county"), F.col("c")[1].alias("said"))
    low = F.lower("said")
    status = F.when(low.contains("suspen"), "SUSPENDED").when(low.contains("no permit") | low.contains("not required"), "OPEN").when(low.contains("permit"), "PERMIT").otherwise("UNKNOWN")
    return r.where("county <> ''").groupBy(F.lower("county").alias("county")).agg(F.max_by(status, "n").alias("status"))


def forecast_hours(bodies: DataFrame, variable: str, columns: str = "value double") -> DataFrame:
    """Interval-coded values as hourly rows (hour, value); of two intervals for an hour the later one counts, in the order of ``block`` where the bodies have that column."""
    block = F.col("block") if "block" in bodies.columns else F.lit(0)
    v = bodies.select(block.alias("block"), F.posexplode(F.from_json(F.get_json_object("body", f"$.properties.{variable}.values"), "array<struct<validTime:string,value:double>>")).alias("n", "v")).withColumn("n", F.struct("block", "n"))
    parts = F.split("v.validTime", "/")
    span = lambda unit: F.coalesce(F.nullif(F.regexp_extract(parts[1], rf"(\d+){unit}", 1), F.lit("")).cast("bigint"), F.lit(0))
    start = F.unix_timestamp(F.try_to_timestamp(parts[0]))
    hours = span("D") * 24 + span("H")
    each = v.where(hours > 0).select("n", "v.value", F.explode(F.sequence(start - start % 3600, start - start % 3600 + (hours - 1) * 3600, F.lit(3600).cast("bigint"))).alias("hour"), hours.alias("hours"))
    return each.groupBy("hour").agg(F.max_by("value", "n").alias("value"), F.max_by("hours", "n").alias("hours")).withColumn("share", F.col("value") / F.col("hours")).drop("hours")


def packets(bodies: DataFrame) -> DataFrame:
    """Radio packet envelopes, whose numbers may be quoted; an envelope without raw bytes is malformed."""
    number = lambda path: times.flexible_number(F.col("body"), path)
    raw = F.get_json_object("body", "$.raw")
    header = F.conv(F.substring(raw, 1, 2), 16, 10).cast("int")
    ok = F.coalesce(raw.rlike("^(?:[0-9A-Fa-f]{2})+$"), F.lit(False))
    return bodies.select(
        F.lower(F.get_json_object("body", "$.origin_id")).alias("origin"), number("$.packet_type").cast("int").alias("packet_type"), number("$.SNR").alias("snr"), number("$.RSSI").cast("int").alias("rssi"), F.get_json_object("body", "$.hash").alias("hash"),
        F.when(ok, F.shiftright(header, 2).bitwiseAND(F.lit(15))).alias("payload_type"), F.when(ok, header.bitwiseAND(F.lit(3))).alias("route_type"), F.when(ok, "OK").otherwise("MALFORMED").alias("outcome"),
    )


def point(lat: Column, lng: Column) -> Column:
    return geo.point_json(lat, lng)


def perimeters(bodies: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Active fire perimeters, Polygon or MultiPolygon, with their shape; those in a box (min_lat, min_lng, max_lat, max_lng) where one is given. A fire without a name takes the one in its mission."""
    r = shapes(bodies, "OBJECTID bigint, incident_name string, incident_number string, mission string, displayStatus string, area_acres double, poly_DateCurrent bigint")
    name = F.coalesce(F.nullif(F.trim("incident_name"), F.lit("")), text.mission_fire(F.coalesce("mission", F.lit(""))))
    rows = geo.with_box(r).where("displayStatus = 'Active' OR displayStatus IS NULL OR displayStatus = ''").select(
        F.col("OBJECTID").alias("object_id"), name.alias("name"), text.fire_key(name).alias("norm"), F.col("incident_number").alias("incident"), F.coalesce("area_acres", F.lit(0.0)).alias("acres"), F.floor(F.col("poly_DateCurrent") / 1000).alias("current_at"), "geojson", *geo.BOX,
    )
    return rows.where(geo.boxes_meet(tuple(map(F.lit, box)), tuple(F.col(n) for n in geo.BOX))) if box else rows


def newest_stamp(bodies: DataFrame) -> DataFrame:
    """The latest readable stamp of a load log, in seconds; rows that do not read are skipped."""
    r = _rows(bodies, "features array<struct<attributes:struct<LAST_UPDATE:string>>>", "features")
    return r.agg(F.max(F.unix_timestamp(F.try_to_timestamp("r.attributes.LAST_UPDATE", F.lit("yyyy-MM-dd HH:mm:ss")))).alias("newest"))


def edited(bodies: DataFrame, before: int) -> DataFrame:
    """One row: when a layer was last edited, in seconds, and whether that is after the edit that was read before."""
    at = F.max(F.floor(F.get_json_object("body", "$.editingInfo.dataLastEditDate").try_cast("bigint") / 1000))
    return bodies.agg(at.alias("newest"), F.coalesce(at > before, F.lit(True)).alias("changed"))


def weather_now(bodies: DataFrame) -> DataFrame:
    """Current weather as whole numbers: degrees cut towards zero, wind in km/h, sight in km."""
    r = bodies.select(F.from_json("body", "id string, dt bigint, main struct<temp:double,feels_like:double,humidity:int>, wind struct<speed:double,deg:int>, visibility int").alias("r")).select("r.*")
    return r.select("id", F.col("dt").alias("at_seconds"), F.col("main.temp").cast("int").alias("celsius"), F.col("main.humidity").alias("humidity"), (F.col("wind.speed") * 3.6).cast("int").alias("wind_kmh"), (F.coalesce("visibility", F.lit(0)) / 1000).cast("int").alias("sight_km"))


#: The gauges and counters of a monitor's node row.
GAUGES = {
    "battery_voltage": "double", "battery_percent": "double", "battery_percent_source": "string", "temperature_c": "double", "humidity": "double", "pressure": "double", "uptime_s": "bigint", "airtime_ms": "bigint", "rx_airtime_ms": "bigint", "noise_floor_dbm": "int", "last_rssi_dbm": "int", "last_snr_db": "double", "tx_queue_len": "int",
    "nb_sent": "bigint", "nb_recv": "bigint", "sent_flood": "bigint", "sent_direct": "bigint", "recv_flood": "bigint", "recv_direct": "bigint", "direct_dups": "bigint", "flood_dups": "bigint", "full_evts": "bigint", "recv_errors": "bigint", "online": "boolean",
}
GAUGE_NAMES = {"battery_voltage": "battery", "uptime_s": "uptime"}


def repeater_reports(bodies: DataFrame, now: Column) -> DataFrame:
    """A monitor's node rows: valid ids, the first of each, stamps of the future held at now. Absent gauges stay null. Of a reporter told in several bodies the first, by ``block``, counts."""
    gauges = ", ".join(f"{n}:{t}" for n, t in GAUGES.items())
    schema = f"reporter string, repeaters array<struct<id:string,name:string,last_attempt:bigint,last_success:bigint,{gauges}>>"
    block = F.col("block") if "block" in bodies.columns else F.lit(0)
    r = bodies.select(block.alias("block"), F.from_json("body", schema).alias("b")).select("block", "b.reporter", F.posexplode("b.repeaters").alias("n", "r"))
    valid = r.withColumn("node", text.hex_id(F.col("r.id"))).where("node IS NOT NULL")
    first = valid.groupBy("reporter", "node").agg(F.min_by("r", F.struct("block", "n")).alias("r"))
    return first.select("reporter", "node", F.col("r.name").alias("name"), F.least("r.last_attempt", now).alias("last_attempt"), F.least("r.last_success", now).alias("last_success"), *(F.col(f"r.{n}").alias(GAUGE_NAMES.get(n, n)) for n in GAUGES))


def burn_readings(bodies: DataFrame, lines: list[str], now: Column) -> DataFrame:
    """Readings of known lines with a colour, a confidence and a stamp; the first of a line in a body counts."""
    r = bodies.select(F.posexplode(F.from_json("body", "readings array<struct<line_id:string,status:string,confidence:int,observed_at:string>>")["readings"]).alias("n", "r"), F.monotonically_increasing_id().alias("m"))
    at = F.unix_timestamp(F.try_to_timestamp("r.observed_at"))
    ok = F.col("r.line_id").isin(lines) & F.lower("r.status").isin("green", "red", "orange") & F.col("r.confidence").between(0, 100) & at.isNotNull()
    first = r.where(ok).groupBy("m", F.col("r.line_id").alias("line")).agg(F.min_by(F.struct(F.lower("r.status").alias("status"), F.least(at, now).alias("observed_at")), "n").alias("x"))
    return first.select("line", "x.*")


def place_seed(areas: DataFrame, towns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Areas (name, box) and towns (name, lat, lng) as one directory with slugs and the area each town is in, and slugs used twice."""
    a = areas.select(F.concat(F.lit("area:"), text.slug(F.col("name"))).alias("place_id"), text.slug(F.col("name")).alias("slug"), "name", F.lit("AREA").alias("kind"), "min_lat", "min_lng", "max_lat", "max_lng")
    t = towns.select(F.concat(F.lit("town:"), text.slug(F.col("name"))).alias("place_id"), text.slug(F.col("name")).alias("slug"), "name", F.lit("TOWN").alias("kind"), F.col("lat").alias("min_lat"), F.col("lng").alias("min_lng"), F.col("lat").alias("max_lat"), F.col("lng").alias("max_lng"))
    cell = lambda d, lat, lng: d.withColumns({"_y": lat, "_x": lng})
    wide = a.select(F.col("place_id").alias("parent"), *(F.col(c).alias(f"p_{c}") for c in ("min_lat", "min_lng", "max_lat", "max_lng")), F.explode(F.sequence(F.floor("min_lat"), F.floor("max_lat"))).alias("_y")).select("*", F.explode(F.sequence(F.floor("p_min_lng"), F.floor("p_max_lng"))).alias("_x"))
    inside = (F.col("min_lat") >= F.col("p_min_lat")) & (F.col("min_lat") < F.col("p_max_lat")) & (F.col("min_lng") >= F.col("p_min_lng")) & (F.col("min_lng") < F.col("p_max_lng"))
    held = cell(t, F.floor("min_lat"), F.floor("min_lng")).join(wide, ["_y", "_x"]).where(inside).groupBy("place_id").agg(F.min("parent").alias("parent"))
    every = a.withColumn("parent", F.lit(None).cast("string")).unionByName(t.join(held, "place_id", "left"))
    return every, every.groupBy("slug").count().where("count > 1").select("slug")
