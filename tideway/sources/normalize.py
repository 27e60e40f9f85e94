"""Feed rows become events: one row for each event, with one detail struct for its layer.

Each function takes the rows of a parser (``feeds``) and, where its rules need
them, the events that stand so far (``prior``), and returns rows of EVENT.
Nothing here fetches, and a feed that failed is not passed as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import classify, geo, text
from tideway.operators import grouped
from tideway.sources import feeds

EVENT = {
    "id": "string", "layer": "string", "category": "string", "severity": "int", "status": "string", "headline": "string", "description": "string", "summary": "string", "area_label": "string", "url": "string",
    "effective": "bigint", "expires": "bigint", "observed_at": "bigint", "source_id": "string", "source_name": "string", "attribution": "string", "geojson": "string", "place_ids": "array<string>",
    "wildfire": "struct<acres:double,contained:int,county:string,has_perimeter:boolean>",
    "evacuation": "struct<zone_id:string,level:string,event_type:string,county:string>",
    "weather": "struct<zones:array<string>,nws_severity:string,certainty:string,urgency:string,instruction:string>",
    "earthquake": "struct<magnitude:double,depth_km:double,felt:int>",
    "road": "struct<log_number:string,log:array<struct<number:int,stamp:string,text:string>>,closure:struct<window_id:string,closure_type:string,work_type:string,lanes:string,total_lanes:int,planned_start:bigint,planned_end:bigint,set_up_at:bigint>>",
    "power": "struct<outage_id:string,cause:string,customers:int,event_id:string,stage:string,starts:bigint,ends:bigint,all_clear:bigint,restoration:bigint>",
    "mesh": "struct<public_key:string,node_type:string,name:string,snr:double,gateways:array<string>,last_heard_at:bigint,last_relayed_at:bigint,last_advert_at:bigint,last_success_at:bigint,last_attempt_at:bigint,reporter:string,reachability:string>",
    "burn": "struct<county:string,day:string,calfire:string,permission:string>",
}
ACTIVE, SCHEDULED, EXPIRED = "ACTIVE", "SCHEDULED", "EXPIRED"


def events(rows: DataFrame, keep: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """rows as EVENT, with the columns to keep beside; what is not given is null."""
    return rows.select(*(columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in EVENT.items()), *keep)


def filled(*options: Column) -> Column:
    """The first option that is not blank; empty when all are."""
    return F.coalesce(*(F.nullif(F.trim(o), F.lit("")) for o in options), F.lit(""))


def safe_url(url: Column) -> Column:
    """An http or https address; anything else is left out."""
    return F.when(F.trim(url).rlike("^https?://"), F.trim(url))


def earthquakes(quakes: DataFrame) -> DataFrame:
    """An event for each earthquake, last observed when its record was revised, else when it happened."""
    c = F.col
    return events(
        quakes, id=c("id"), layer=F.lit("EARTHQUAKE"), category=F.lit("earthquake"), severity=c("severity"), status=F.lit(ACTIVE), headline=F.format_string("M%.1f — %s", c("mag"), c("place")), area_label=c("place"), url=safe_url(c("url")),
        effective=c("at_seconds"), observed_at=F.coalesce("updated", "at_seconds"), source_id=F.lit("usgs"), source_name=F.lit("USGS"), attribution=F.lit("U.S. Geological Survey"), geojson=geo.point_json(c("lat"), c("lng")),
        earthquake=F.struct(c("mag").alias("magnitude"), "depth_km", "felt"),
    )


def adopted(fires: DataFrame, perimeters: DataFrame) -> DataFrame:
    """fires with the perimeter (geojson) of their plain name, where exactly one perimeter has it."""
    one = perimeters.groupBy("norm").agg(F.count("*").alias("_n"), F.first("geojson").alias("perimeter")).where("_n = 1").drop("_n")
    return fires.withColumn("norm", text.fire_key(F.col("name"))).join(one, "norm", "left")


def wildfires(fires: DataFrame, perimeters: DataFrame, prior: DataFrame, scope: tuple[float, float, float, float], now: int, grace: int, usable: bool = True) -> DataFrame:
    """Fire incidents, and perimeters that belong to none of them.

    An incident takes the perimeter of its name when only one has it. With
    ``usable`` false (the perimeter feed failed or is empty) it keeps the
    perimeter it had, so an outage shrinks no fire. Its point or its shape's
    box must meet the scope. Perimeters without an incident stand alone; one
    not updated for longer than grace ends if it is known and is left out if
    not.
    """
    c = F.col
    had = prior.where("wildfire.has_perimeter AND geojson IS NOT NULL").select("id", F.col("geojson").alias("kept"))
    rows = adopted(fires.where("NOT (lat = 0 AND lng = 0)"), perimeters if usable else perimeters.limit(0)).join(had, "id", "left")
    shape = F.coalesce("perimeter", *(["kept"] if not usable else []))
    rows = rows.withColumns({"has": shape.isNotNull(), "geojson": F.coalesce(shape, geo.point_json(c("lat"), c("lng")))})
    at = (c("lat"), c("lng"), c("lat"), c("lng"))
    whole = tuple(map(F.lit, scope))
    rows = geo.with_box(rows).where(geo.boxes_meet(at, whole) | F.coalesce(geo.boxes_meet(tuple(map(c, geo.BOX)), whole), F.lit(False)))
    incidents = events(
        rows, id=c("id"), layer=F.lit("WILDFIRE"), category=F.lit("wildfire"), severity=classify.from_wildfire(c("acres"), c("contained")), status=F.lit(ACTIVE),
        headline=F.concat(c("name"), F.lit(" — "), text.commas(c("acres")), F.lit(" ac, "), c("contained"), F.lit("% contained")), area_label=filled(c("location"), c("county")), url=safe_url(c("url")), effective=c("started"), observed_at=c("updated"),
        source_id=F.lit("calfire"), source_name=F.lit("CAL FIRE"), attribution=F.lit("CAL FIRE / FIRIS"), geojson=c("geojson"), wildfire=F.struct("acres", "contained", "county", c("has").alias("has_perimeter")),
    )
    if not usable:
        return incidents
    taken = rows.where("has").select("norm").distinct()
    alone = grouped.numbered_groups(perimeters.join(taken, "norm", "left_anti").withColumn("base", F.concat(F.lit("firis:"), "norm")), ["base"], ["object_id"], "base", "-")
    return incidents.unionByName(standalone(alone, prior, now, grace))


def standalone(perimeters: DataFrame, prior: DataFrame, now: int, grace: int) -> DataFrame:
    """Events of perimeters (numbered, name, acres, current_at, geojson) on their own; old ones end where they are known."""
    c = F.col
    old = F.lit(now) - c("current_at") > grace
    rows = perimeters.join(prior.select(c("id").alias("numbered"), F.lit(True).alias("known")), "numbered", "left").where(~F.coalesce(old, F.lit(False)) | c("known"))
    return events(
        rows, id=c("numbered"), layer=F.lit("WILDFIRE"), category=F.lit("wildfire"), severity=classify.from_wildfire(c("acres"), F.lit(0)), status=F.when(old, EXPIRED).otherwise(ACTIVE), headline=F.concat(c("name"), F.lit(" — "), text.commas(c("acres")), F.lit(" ac")),
        observed_at=c("current_at"), source_id=F.lit("firis"), source_name=F.lit("CAL FIRE / FIRIS"), attribution=F.lit("CAL FIRE / FIRIS / NIFC"), geojson=c("geojson"), wildfire=F.struct("acres", F.lit(0).alias("contained"), F.lit("").alias("county"), F.lit(True).alias("has_perimeter")),
    )


def orphans(perimeters: DataFrame, ended: DataFrame, now: int, window: int = 30 * 86400, least_contained: int = 90, most_metres: float = 10_000.0) -> DataFrame:
    """perimeters (norm, geojson …) with ``orphan``: the id of an ended fire of their name, nearly contained, recent and near; null where there is none.

    Several such fires: the smallest id. The join is on the name; distances are
    between the middles of boxes. What is found goes back by name and middle,
    which a row has whenever it is computed; a number given to it may differ.
    """
    middle = geo.centre(tuple(map(F.col, geo.BOX)))
    fires = ended.where((F.col("wildfire.contained") >= least_contained) & (F.col("observed_at") >= now - window))
    fires = geo.with_box(fires).select(text.fire_key(F.split("headline", " — ")[0]).alias("norm"), F.col("id").alias("_id"), *(v.alias(n) for v, n in zip(middle, ("_lat", "_lng"), strict=True)))
    rows = geo.with_box(perimeters).select(*perimeters.columns, *(v.alias(n) for v, n in zip(middle, ("_mid_lat", "_mid_lng"), strict=True)))
    here = rows.select("norm", "_mid_lat", "_mid_lng").distinct()
    near = geo.metres_between(F.col("_mid_lat"), F.col("_mid_lng"), F.col("_lat"), F.col("_lng")) <= most_metres
    hit = here.join(fires, "norm").where(near).groupBy("norm", "_mid_lat", "_mid_lng").agg(F.min("_id").alias("orphan"))
    return rows.join(hit, ["norm", "_mid_lat", "_mid_lng"], "left").select(*perimeters.columns, "orphan")


def evacuations(zones: DataFrame) -> DataFrame:
    """Zones in force. Rows of one id and zone are one event of their highest level, the first in the feed among equals; other zones of that id are events of their own."""
    c = F.col
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in classify.EVACUATION_RANK.items() for x in p)), c("level")), F.lit(0))
    one = zones.groupBy("id", "name", "county").agg(F.max_by(F.struct(*[x for x in zones.columns if x not in ("id", "name", "county")]), F.struct(rank, -c("seq"))).alias("z"), F.min("seq").alias("first"))
    rows = grouped.numbered_groups(one, ["id"], ["first"], "id", "-")
    zone = F.regexp_replace("id", "^caloes:", "")
    what = F.when((c("name") != "") & (zone != "") & (F.instr("name", zone) == 0), F.concat(c("name"), F.lit(" ("), zone, F.lit(")"))).otherwise(filled(c("name"), zone, c("county"), F.lit("zone not identified by source")))
    return events(
        rows.select("*", "z.*"), id=c("numbered"), layer=F.lit("EVACUATION"), category=F.lit("evacuation"), severity=c("severity"), status=F.lit(ACTIVE), headline=F.concat(F.lit("Evacuation "), F.initcap(F.lower(F.replace("level", F.lit("_"), F.lit(" ")))), F.lit(" — "), what),
        description=c("info"), area_label=filled(c("name"), c("county")), observed_at=c("updated"), source_id=F.lit("caloes"), source_name=F.lit("Cal OES"), attribution=F.lit("Cal OES — reference only"), geojson=c("geojson"),
        evacuation=F.struct(zone.alias("zone_id"), "level", "event_type", "county"),
    )


def weather_alerts(alerts: DataFrame, areas: DataFrame, now: Column) -> DataFrame:
    """Alerts that no other listed one replaces; SCHEDULED before they begin; attached to the areas (area_id, zones) whose zones they share, or to all where either names none."""
    c = F.col
    rows = feeds.standing_alerts(alerts)
    zoned = areas.select("area_id", F.explode_outer("zones").alias("zone"))
    everywhere = zoned.where("zone IS NULL").select("area_id")
    named = rows.select("id", F.explode("zones").alias("zone")).join(zoned.where("zone IS NOT NULL"), "zone").select("id", "area_id")
    open_ended = rows.where(F.size("zones") == 0).select("id").crossJoin(F.broadcast(areas.select("area_id")))  # areas are configuration
    every = rows.select("id").crossJoin(F.broadcast(everywhere))
    at = named.unionByName(open_ended).unionByName(every).groupBy("id").agg(F.array_sort(F.collect_set(F.concat(F.lit("area:"), "area_id"))).alias("place_ids"))
    rows = rows.join(at, "id", "left")
    return events(
        rows, id=F.concat(F.lit("wx:"), "id"), layer=F.lit("WEATHER_ALERT"), category=c("event"), severity=c("severity"), status=F.when(c("starts") > now, SCHEDULED).otherwise(ACTIVE), headline=text.short_headline(c("event"), c("headline")), description=c("description"),
        effective=c("starts"), expires=c("expires"), source_id=F.lit("nws"), source_name=filled(c("sender"), F.lit("National Weather Service")), attribution=F.lit("National Weather Service"), place_ids=F.coalesce("place_ids", F.array().cast("array<string>")),
        weather=F.struct("zones", c("said").alias("nws_severity"), "certainty", "urgency", "instruction"),
    )


def road_incidents(incidents: DataFrame, order: str | None = None) -> DataFrame:
    """Incidents that have a place, the south-west one of each id, then by name, then by the column ``order``; ``kind`` is their type in words."""
    c = F.col
    rows = incidents.where("lat IS NOT NULL AND lng IS NOT NULL").withColumns({"key": text.incident_id(c("log_number"), c("closure_id"), c("name"), c("text")), "kind": feeds.incident_type(F.coalesce("first_line", "name"))})
    first = rows.groupBy("key").agg(F.min_by(F.struct(*rows.drop("key").columns), F.struct("lat", "lng", "name", *filter(None, [order]))).alias("i")).select("key", "i.*")
    return events(
        first, id=c("key"), layer=F.lit("ROAD_INCIDENT"), category=F.lit("incident"), severity=classify.from_incident(c("kind"), c("text")), status=F.lit(ACTIVE), headline=c("kind"), description=c("text"), area_label=c("second_line"), source_id=F.lit("chp"), source_name=F.lit("CHP"),
        attribution=F.lit("quickmap.dot.ca.gov"), geojson=geo.point_json(c("lat"), c("lng")), road=F.struct("log_number", "log", F.lit(None).cast("struct<window_id:string,closure_type:string,work_type:string,lanes:string,total_lanes:int,planned_start:bigint,planned_end:bigint,set_up_at:bigint>").alias("closure")),
    )


def lane_closures(closures: DataFrame, now: Column, grace: int = 12 * 3600) -> DataFrame:
    """Closures on the road (ACTIVE) or to come (SCHEDULED), the first of each window; rows that could not be read are left to the caller."""
    c = F.col
    rows = feeds.closure_phase(closures.where("unrecognized IS NULL"), now, grace).where("phase IN ('ACTIVE', 'SCHEDULED')")
    first = rows.groupBy("id").agg(F.min_by(F.struct(*rows.drop("id").columns), "seq").alias("w")).select("id", "w.*")
    phrase = text.closure_phrase(c("closure_type"), c("lanes"), c("facility"))
    said = F.concat_ws(" ", text.route_label(c("route")), F.nullif(text.direction_label(c("direction")), F.lit("")), phrase)
    headline = text.capital(F.concat(said, F.when(F.coalesce(c("work_type"), F.lit("")) != "", F.concat(F.lit(" ("), c("work_type"), F.lit(")"))).otherwise("")))
    end = F.struct(c("end_lat"), c("end_lng"))
    line = F.array(F.array("lng", "lat"), F.array("end_lng", "end_lat"))
    shape = F.when(end["end_lat"].isNull() | end["end_lng"].isNull() | ((c("lat") == c("end_lat")) & (c("lng") == c("end_lng"))), geo.point_json(c("lat"), c("lng"))).otherwise(geo.line_json(line))
    return events(
        first, id=F.concat(F.lit("caltrans:"), "id"), layer=F.lit("ROAD_INCIDENT"), category=F.lit("closure"), severity=c("severity"), status=c("phase"), headline=headline, description=text.closure_description(c("lanes"), c("total_lanes"), c("delay")),
        area_label=text.closure_area(c("route"), c("from_name"), c("to_name"), c("near")), effective=c("starts"), expires=c("ends"), observed_at=c("recorded_at"), source_id=F.lit("caltrans"), source_name=F.lit("Caltrans"), attribution=F.lit("cwwp2.dot.ca.gov"), geojson=shape,
        road=F.struct(F.lit(None).cast("string").alias("log_number"), F.lit(None).cast("array<struct<number:int,stamp:string,text:string>>").alias("log"), F.struct(c("id").alias("window_id"), "closure_type", "work_type", "lanes", "total_lanes", c("starts").alias("planned_start"), c("ends").alias("planned_end"), F.when(c("in_place"), c("recorded_at")).alias("set_up_at")).alias("closure")),
    )


def outages(rows: DataFrame, prior: DataFrame, areas_blank: bool = False) -> DataFrame:
    """Outages by their area where there is one, else their point; with the area layer blank a known area is kept."""
    c = F.col
    planned = F.lower(c("cause")).rlike("planned|plnnd")
    had = prior.where("source_id = 'pge' AND get_json_object(geojson, '$.type') <> 'Point'").select(F.regexp_replace("id", "^pge:", "").alias("id"), c("geojson").alias("kept"))
    both = rows.join(had, "id", "left") if areas_blank else rows.withColumn("kept", F.lit(None).cast("string"))
    shape = F.coalesce("geojson", "kept", F.when(c("lat").isNotNull() & c("lng").isNotNull(), geo.point_json(c("lat"), c("lng"))))
    return events(
        both, id=F.concat(F.lit("pge:"), "id"), layer=F.lit("POWER"), category=F.when(planned, "planned").otherwise("unplanned"), severity=classify.from_power_outage(c("customers"), planned), status=F.lit(ACTIVE), headline=text.power_headline(c("customers"), planned, c("cause")),
        effective=c("started"), observed_at=F.coalesce("updated", "started"), source_id=F.lit("pge"), source_name=F.lit("PG&E"), attribution=F.lit("Pacific Gas and Electric"), geojson=shape,
        power=F.struct(c("id").alias("outage_id"), "cause", "customers", *(F.lit(None).alias(n) for n in ("event_id", "stage", "starts", "ends", "all_clear", "restoration"))),
    )


def shutoffs(rows: DataFrame, now: Column) -> DataFrame:
    """Shutoffs, SCHEDULED until power is to go off."""
    c = F.col
    return events(
        rows, id=c("id"), layer=F.lit("POWER"), category=F.lit("psps"), severity=c("severity"), status=F.when(c("starts") > now, SCHEDULED).otherwise(ACTIVE), headline=F.concat(F.lit("PSPS "), filled(c("stage"), F.lit("Notice")), F.lit(" — "), text.customers(c("customers"))), effective=c("starts"),
        source_id=F.lit("psps"), source_name=F.lit("PG&E PSPS"), attribution=F.lit("Pacific Gas and Electric"), geojson=c("geojson"),
        power=F.struct(F.lit(None).alias("outage_id"), F.lit(None).alias("cause"), "customers", c("id").alias("event_id"), "stage", "starts", *(F.lit(None).alias(n) for n in ("ends", "all_clear", "restoration"))),
    )


def burn_status(counties: DataFrame, readings: DataFrame, lines: DataFrame, now: Column, stale: int = 36 * 3600) -> DataFrame:
    """A county's burn status: the day its lines give (county, line), readings older than ``stale`` left out, and the state's permit status."""
    c = F.col
    fresh = readings.where(now - c("observed_at") <= stale)
    both = lines.join(fresh, "line", "left").groupBy("county").agg(classify.burn_day(c("status")).alias("day"), F.max("observed_at").alias("heard"))
    rows = counties.select("county", c("status").alias("calfire")).join(both, "county", "full").withColumns({"day": F.coalesce("day", F.lit("UNKNOWN")), "calfire": F.coalesce("calfire", F.lit("UNKNOWN"))})
    allowed = classify.burn_permission(c("day"), c("calfire"))
    return events(
        rows, id=F.concat(F.lit("burn:"), "county"), layer=F.lit("BURN_STATUS"), category=F.lit("burn_status"), severity=F.lit(0), status=F.lit(ACTIVE), headline=classify.burn_headline(c("day"), c("calfire")), area_label=F.concat(F.initcap("county"), F.lit(" County")), observed_at=c("heard"),
        source_id=F.lit("burnline"), source_name=F.lit("Burn line"), burn=F.struct("county", "day", "calfire", allowed.alias("permission")),
    )


def mesh_nodes(nodes: DataFrame) -> DataFrame:
    """Radio nodes (public_key, name, node_type, lat, lng, clocks, reachability …) as events; a node no monitor reaches is MINOR."""
    c = F.col
    return events(
        nodes, id=F.concat(F.lit("mesh:"), "public_key"), layer=F.lit("MESH"), category=F.lower(c("node_type")), severity=F.when(c("reachability") == "UNREACHABLE", classify.MINOR).otherwise(classify.INFO), status=F.lit(ACTIVE),
        headline=F.concat(filled(c("name"), F.substring("public_key", 1, 8)), F.when(c("reachability") == "UNREACHABLE", F.lit(" — unreachable")).otherwise(F.lit(" — heard"))), observed_at=F.greatest("last_heard_at", "last_relayed_at", "last_success_at"),
        source_id=F.lit("meshcore"), source_name=F.lit("MeshCore Mesh"), attribution=F.lit("MeshCore community mesh"), geojson=F.when(c("lat").isNotNull() & c("lng").isNotNull(), geo.point_json(c("lat"), c("lng"))),
        mesh=F.struct("public_key", "node_type", "name", "snr", "gateways", "last_heard_at", "last_relayed_at", F.lit(None).alias("last_advert_at"), "last_success_at", "last_attempt_at", "reporter", "reachability"),
    )
