"""Map layers: events as GeoJSON features with the properties of their layer, collections, and what vouches for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideway.functions import classify, geo, text, times

#: What a layer's features are called, and the sources whose health decides its status.
KINDS = {"WILDFIRE": "Wildfire", "EVACUATION": "Evacuation", "WEATHER_ALERT": "Weather alert", "EARTHQUAKE": "Earthquake", "ROAD_INCIDENT": "Road incident", "MESH": "Mesh node", "POWER": "Power outage"}
LAYER_SOURCES = {
    "WILDFIRE": ("calfire", "firis"), "EVACUATION": ("caloes",), "WEATHER_ALERT": ("nws",), "EARTHQUAKE": ("usgs",), "ROAD_INCIDENT": ("chp", "caltrans"), "MESH": ("meshcore",), "POWER": ("pge", "psps"), "BURN_STATUS": ("burnline", "calfire-burn"),
    "CHAIN_CONTROL": ("caltrans",), "FIRE_WEATHER": ("nws",), "ROAD_SEGMENT": ("caltrans",), "MESH_LINK": ("meshcore",), "MESSAGE_SIGN": ("caltrans",),
}


def _source(layer: Column) -> Column:
    """The block that credits a feature: by layer, or by the event's own source where a layer has several."""
    c, url = F.col, F.when(F.trim("url").rlike("^https?://"), F.trim("url"))
    s = lambda id, name, credit, link=None: F.struct(F.lit(id).alias("id"), F.lit(name).alias("name"), (link if link is not None else F.lit(None).cast("string")).alias("url"), F.lit(credit).alias("attribution"))
    return (
        F.when((layer == "WILDFIRE") & (c("source_id") == "firis"), s("firis", "CAL FIRE / FIRIS", "CAL FIRE / FIRIS / NIFC")).when(layer == "WILDFIRE", s("calfire", "CAL FIRE", "CAL FIRE / FIRIS", url)).when(layer == "EVACUATION", s("caloes", "Cal OES", "Cal OES — reference only", url))
        .when(layer == "WEATHER_ALERT", F.struct(F.lit("nws").alias("id"), c("source_name").alias("name"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("attribution"))).when(layer == "EARTHQUAKE", s("usgs", "USGS", "U.S. Geological Survey", url))
        .when((layer == "ROAD_INCIDENT") & (c("source_id") == "caltrans"), F.struct(F.lit("caltrans").alias("id"), F.lit("Caltrans").alias("name"), F.lit(None).cast("string").alias("url"), F.coalesce("attribution", F.lit("quickmap.dot.ca.gov")).alias("attribution")))
        .when(layer == "ROAD_INCIDENT", s("chp", "CHP / Caltrans", "quickmap.dot.ca.gov")).when(layer == "MESH", s("meshcore", "MeshCore Mesh", "MeshCore community mesh", url)).when((layer == "POWER") & (c("category") == "psps"), s("psps", "PG&E PSPS", "Pacific Gas and Electric", url))
        .when(layer == "POWER", s("pge", "PG&E", "Pacific Gas and Electric", url))
    )


def properties() -> Column:
    """A feature's properties; what a layer or an event does not have is null, which JSON leaves out. A gauge that was not read is left out, never 0."""
    c, layer = F.col, F.col("layer")
    stamp = lambda v: F.nullif(times.rfc3339(v), F.lit(""))
    only = lambda name, value: F.when(layer == name, value)
    kind = F.when((layer == "POWER") & (c("category") == "psps"), "Public Safety Power Shutoff").otherwise(text.lookup(KINDS, layer))
    # A closure's text is made of its fields; of an incident only the readable summary is shown.
    told = F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.when(c("road.closure").isNotNull(), c("description")))
    described = F.when(layer.isin("EVACUATION", "WEATHER_ALERT"), c("description")).when(layer == "ROAD_INCIDENT", told)
    revised = F.when(layer == "WEATHER_ALERT", None).when((layer == "EARTHQUAKE") & c("observed_at").eqNullSafe(c("effective")), None).otherwise(c("observed_at"))
    window = F.when(c("road.closure").isNotNull(), F.struct("road.closure.window_id", "road.closure.closure_type", "road.closure.work_type", "road.closure.lanes", "road.closure.total_lanes", *(stamp(c(f"road.closure.{n}")).alias(n) for n in ("planned_start", "planned_end", "set_up_at"))))
    return F.struct(
        "id", "layer", kind.alias("kind"), "category", classify.severity_name(c("severity")).alias("severity"), c("severity").alias("severity_rank"), F.when(layer == "EVACUATION", c("evacuation.level")).otherwise(c("status")).alias("status"), "headline", "area_label", F.nullif("summary", F.lit("")).alias("summary"),
        described.alias("description"), stamp(F.when(layer != "EVACUATION", c("effective"))).alias("effective"), stamp(F.when(layer == "WEATHER_ALERT", c("expires"))).alias("expires"), stamp(revised).alias("updated_at"), _source(layer).alias("source"),
        only("WILDFIRE", c("wildfire")).alias("wildfire"), only("EVACUATION", c("evacuation")).alias("evacuation"), only("WEATHER_ALERT", F.struct(c("category").alias("event"), F.lit("NWS").alias("source"), "weather.*")).alias("weather"), only("EARTHQUAKE", c("earthquake")).alias("earthquake"),
        only("ROAD_INCIDENT", F.struct("road.log_number", window.alias("closure"))).alias("incident"),
        only("POWER", F.struct("power.outage_id", "power.cause", "power.customers", "power.event_id", "power.stage", *(stamp(c(f"power.{n}")).alias(n) for n in ("starts", "ends", "all_clear", "restoration")))).alias("power"),
        only("MESH", F.struct("mesh.public_key", "mesh.node_type", "mesh.name", "mesh.snr", "mesh.gateways", *(stamp(c(f"mesh.{n}")).alias(n) for n in ("last_heard_at", "last_relayed_at", "last_success_at")), F.when(c("mesh.reachability").isin("REACHABLE", "UNREACHABLE"), c("mesh.reachability")).alias("reachability"))).alias("mesh"),
    )


def features(events: DataFrame, layer: str | None = None) -> DataFrame:
    """id, layer, geometry (as the source wrote it, null for none), properties (a struct) and body (the feature's JSON) of a layer's events, or of every layer that maps show."""
    rows = events.where(F.col("layer").isin(list(KINDS)) if layer is None else F.col("layer") == layer)
    rows = rows.select("id", "layer", F.when(F.get_json_object("geojson", "$.type").isNotNull(), F.col("geojson")).alias("geometry"), properties().alias("properties"))
    body = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce("geometry", F.lit("null")), F.lit(',"properties":'), F.to_json("properties"), F.lit("}"))
    return rows.withColumn("body", body)


def collections(placed: DataFrame, keys: list[str], metadata: Column) -> DataFrame:
    """keys, body, tag: one FeatureCollection for each key, features by id; the tag leaves out when it was made."""
    w = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "body"))), lambda x: x["body"]), ",")
    by = placed.groupBy(*keys).agg(w.alias("features"))
    said = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("features"), F.lit('],"metadata":'), F.to_json(metadata), F.lit("}"))
    return by.select(*keys, said.alias("body"), F.sha2("features", 256).alias("tag"))


def layer_status(sources: DataFrame, layers: DataFrame) -> DataFrame:
    """layer, status, last_update for layers (layer, source_id) from source health (source_id, status, last_success).

    OK when all are, UNAVAILABLE when none is up (a source without a row, or
    never polled, is not), else STALE; the last success is told when not OK.
    """
    both = layers.join(sources, "source_id", "left").withColumn("status", F.when(F.col("status").isin("OK", "STALE"), F.col("status")).otherwise("UNAVAILABLE"))
    by = both.groupBy("layer").agg(F.count_if(F.col("status") == "OK").alias("up"), F.count_if(F.col("status") == "UNAVAILABLE").alias("down"), F.count("*").alias("n"), F.max("last_success").alias("last"))
    status = F.when(F.col("up") == F.col("n"), "OK").when(F.col("down") == F.col("n"), "UNAVAILABLE").otherwise("STALE")
    return by.select("layer", status.alias("status"), F.when(F.col("up") < F.col("n"), F.col("last")).alias("last_update"))


def degraded(status: Column, has_events: Column) -> Column:
    """A layer whose sources are down but whose events are stored is STALE."""
    return F.when((status == "UNAVAILABLE") & has_events, "STALE").otherwise(status)


def attributions(layers: DataFrame, sources: DataFrame) -> DataFrame:
    """layer, attribution: the parts of its sources' lines (layer, position, source_id), each once, in order."""
    parts = layers.join(sources.select("source_id", "attribution"), "source_id")
    each = parts.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("position", "attribution"))).alias("p"))
    split = F.flatten(F.transform("p", lambda x: F.split(F.coalesce(x["attribution"], F.lit("")), " · ")))
    return each.select("layer", F.array_join(F.array_distinct(F.filter(F.transform(split, lambda s: F.trim(s)), lambda s: s != "")), " · ").alias("attribution"))


def shaped(events: DataFrame, form: str) -> DataFrame:
    """events with their geometry as BASE64 text, as an OBJECT (a variant), or without it (NONE: the box and its middle stay)."""
    lite = geo.with_box(events)
    lite = lite.withColumns(dict(zip(("lat", "lng"), geo.centre(tuple(F.col(n) for n in geo.BOX)), strict=True)))
    if form == "NONE":
        return lite.drop("geojson")
    return lite.withColumn("geojson", F.base64(F.col("geojson").cast("binary")) if form == "BASE64" else F.try_parse_json("geojson"))


def lean(events: DataFrame) -> DataFrame:
    """An event in few words: where its middle is, the places it is at by name, no geometry."""
    lat, lng = geo.centre(tuple(F.col(n) for n in geo.BOX))
    at = F.when(lat.isNotNull(), F.struct(F.round(lat, 5).alias("lat"), F.round(lng, 5).alias("lng")))
    places = F.transform(F.coalesce("place_ids", F.array().cast("array<string>")), lambda p: F.element_at(F.split(p, ":"), -1))
    return geo.with_box(events).select("id", "layer", classify.severity_name(F.col("severity")).alias("severity"), "status", "headline", at.alias("location"), places.alias("places"))
