"""What is happening at each place: counts, the gravest events, domains with their health, and the place's mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import classify
from tideway.operators import air, maps

#: The layers of each domain, live conditions among them.
DOMAINS = {
    "fire": ("WILDFIRE", "FIRE_WEATHER"), "evacuation": ("EVACUATION",), "weather": ("WEATHER_ALERT",), "roads": ("ROAD_INCIDENT", "CHAIN_CONTROL", "ROAD_SEGMENT"), "seismic": ("EARTHQUAKE",), "power": ("POWER",), "burn": ("BURN_STATUS",), "comms": ("MESH",),
}
CONDITIONS = ("FIRE_WEATHER", "CHAIN_CONTROL", "ROAD_SEGMENT", "MESSAGE_SIGN")
TOP_EVENTS, TOP_HEADLINES = 5, 3


def domain(layer: Column) -> Column:
    return classify.ladder(*((layer.isin(*names), d) for d, names in DOMAINS.items()), otherwise=F.lit(None).cast("string"))


def _first(rows: DataFrame, keys: list[str], order: list[Column], most: int, name: str) -> DataFrame:
    """keys and name: the ids of the first ``most`` rows of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    top = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"]).alias(name))


def domains(places: DataFrame, events: DataFrame, conditions: DataFrame, status: DataFrame) -> DataFrame:
    """place_id, domain, status (the worst of its layers'), active_count, highest, headlines (ids of the three gravest) for every place and every domain that has a layer in status.

    events and conditions: (place_id, id, layer, severity …); status: (layer,
    status). Conditions count above INFO; planned roadwork does not count.
    """
    items = events.where("NOT (layer = 'ROAD_INCIDENT' AND status = 'SCHEDULED')").select("place_id", "id", "layer", "severity").unionByName(conditions.where("severity > 0").select("place_id", "id", "layer", "severity")).withColumn("domain", domain(F.col("layer")))
    by = items.groupBy("place_id", "domain").agg(F.count("*").alias("active_count"), F.max("severity").alias("highest"))
    top = _first(items, ["place_id", "domain"], [F.desc("severity"), F.asc("id")], TOP_HEADLINES, "headlines")
    health = status.groupBy(domain(F.col("layer")).alias("domain")).agg(classify.worst_status(F.collect_set("status")).alias("status")).where("domain IS NOT NULL")
    every = places.select("place_id").crossJoin(F.broadcast(health))  # eight domains at most
    out = every.join(by, ["place_id", "domain"], "left").join(top, ["place_id", "domain"], "left")
    return out.select("place_id", "domain", "status", F.coalesce("active_count", F.lit(0)).alias("active_count"), F.coalesce("highest", F.lit(0)).alias("highest"), F.coalesce("headlines", F.array().cast("array<string>")).alias("headlines"))


def summaries(places: DataFrame, events: DataFrame, fire_weather: DataFrame, status: DataFrame) -> DataFrame:
    """A row for each place: mode, total_active, counts (severity name -> events), highest, top (ids of the five gravest), evacuations.

    events: those that stand at each place (place_id and EVENT's columns);
    fire_weather: (place_id, state); status: (layer, status) of the layers that
    can fail. Evacuations are told as 0 only when their source vouches for
    that; they are null when it is unavailable and nothing is stored.
    """
    c = F.col
    counted = air.rollup_events(events)
    by_severity = counted.groupBy("place_id", classify.severity_name(c("severity")).alias("name")).agg(F.count("*").alias("n")).groupBy("place_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("counts"))
    active = c("status") == "ACTIVE"
    by = counted.groupBy("place_id").agg(
        F.count("*").alias("total_active"), F.max("severity").alias("highest"), F.max(F.when(active, c("severity"))).alias("gravest"), F.max(F.when(active & (c("layer") == "WILDFIRE"), c("severity"))).alias("fire"), F.collect_set(F.when(active & (c("layer") == "EVACUATION"), c("evacuation.level"))).alias("levels"),
    )
    zones = events.where("layer = 'EVACUATION'").groupBy("place_id").agg(F.count("*").alias("stored"), F.count_if(active).alias("orders"))
    top = _first(counted, ["place_id"], [F.desc("severity"), F.desc("observed_at"), F.asc("id")], TOP_EVENTS, "top")
    evacuation = status.where("layer = 'EVACUATION'").agg(F.first("status").alias("evacuation_status"))  # one row
    down = status.agg(F.coalesce(F.bool_or(c("status") == "UNAVAILABLE"), F.lit(False)).alias("some_down"))  # one row
    rows = places.select("place_id").join(by, "place_id", "left").join(by_severity, "place_id", "left").join(zones, "place_id", "left").join(top, "place_id", "left").join(fire_weather, "place_id", "left").crossJoin(F.broadcast(evacuation)).crossJoin(F.broadcast(down))
    vouched = maps.degraded(F.coalesce("evacuation_status", F.lit("UNAVAILABLE")), F.coalesce(c("stored") > 0, F.lit(False)))
    none = F.array().cast("array<string>")
    mode = classify.place_mode(F.coalesce("levels", none), F.coalesce("gravest", F.lit(0)), F.coalesce("fire", F.lit(0)), F.coalesce("state", F.lit("normal")), vouched == "UNAVAILABLE", c("some_down"))
    return rows.select(
        "place_id", mode.alias("mode"), F.coalesce("total_active", F.lit(0)).alias("total_active"), F.coalesce("counts", F.create_map().cast("map<string,bigint>")).alias("counts"), F.coalesce("highest", F.lit(0)).alias("highest"), F.coalesce("top", none).alias("top"),
        F.when(vouched.isin("OK", "STALE"), F.coalesce("orders", F.lit(0))).alias("evacuations"), vouched.alias("evacuation_status"),
    )
