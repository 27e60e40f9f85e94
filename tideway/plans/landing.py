"""More feeds over bodies built from the star tables: perimeters, stamps, weather, pushed reports, the place directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.plans.adapters import Views
from tideway.plans.feeds import BODY_ROWS, bodies, obs_day, s
from tideway.plans.queries import DAY, T0
from tideway.plans.registry import query
from tideway.sources import feeds


@query("""SELECT seq AS object_id, 'fire' || user_id AS norm, value AS acres, observed_at AS current_at, round(lat, 6) AS min_lat, round(lng + 0.1, 6) AS max_lng FROM observed WHERE event_type = 'error' AND status = 'ACTIVE' AND lat <= 38 AND lat + 0.2 >= 36 AND lng <= -120 AND lng + 0.1 >= -123""")
def s2_perimeters(v: Views) -> DataFrame:
    lat, lng = F.col("lat"), F.col("lng")
    ring = F.array(*(F.array(lng + dx, lat + dy) for dx, dy in ((0, 0), (0.1, 0), (0.1, 0.2), (0, 0.2), (0, 0))))
    props = F.struct(F.col("seq").alias("OBJECTID"), F.concat(F.lit("FIRE "), "user_id", F.lit(" Fire")).alias("incident_name"), F.when(F.col("status") == "ACTIVE", "Active").otherwise("Inactive").alias("displayStatus"), F.col("value").alias("area_acres"), (F.col("observed_at") * 1000 + 7).alias("poly_DateCurrent"))
    item = F.struct(props.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    rows = feeds.perimeters(bodies(v.observed.where("event_type = 'error'"), obs_day(), item, "features"), (36.0, -123.0, 38.0, -120.0))
    return rows.select("object_id", "norm", "acres", "current_at", F.round("min_lat", 6).alias("min_lat"), F.round("max_lng", 6).alias("max_lng"))


@query("SELECT max(observed_at) AS newest FROM observed WHERE k % 3 > 0")
def s7_newest_stamp(v: Views) -> DataFrame:
    stamp = F.when(F.col("k") % 3 > 0, F.date_format(F.timestamp_seconds("observed_at"), "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return feeds.newest_stamp(bodies(v.observed, obs_day(), F.struct(F.struct(stamp.alias("LAST_UPDATE")).alias("attributes")), "features"))


@query(f"SELECT count(*) AS rows, max(observed_at) AS newest, {T0 + 31 * DAY} - max(observed_at) <= 86400 AS is_fresh FROM observed WHERE event_type = 'click'")
def s19_fresh(v: Views) -> DataFrame:
    return feeds.fresh(v.observed.where("event_type = 'click'"), "observed_at", F.lit(T0 + 31 * DAY), 86400)


@query("SELECT CAST(seq AS VARCHAR) AS id, observed_at AS at_seconds, CAST(trunc(value - 50) AS INT) AS celsius, CAST(trunc(k / 2 * 3.6) AS INT) AS wind_kmh, CAST(CASE WHEN k % 4 > 0 THEN seq % 12000 // 1000 ELSE 0 END AS INT) AS sight_km FROM observed WHERE event_type = 'view'")
def s22_weather_now(v: Views) -> DataFrame:
    body = F.to_json(F.struct(s("seq").alias("id"), F.col("observed_at").alias("dt"), F.struct((F.col("value") - 50).alias("temp")).alias("main"), F.struct((F.col("k") / 2).alias("speed")).alias("wind"), F.when(F.col("k") % 4 > 0, (F.col("seq") % 12000).cast("int")).alias("visibility")))
    return feeds.weather_now(v.observed.where("event_type = 'view'").select(body.alias("body"))).select("id", "at_seconds", "celsius", "wind_kmh", "sight_km")


@query(f"""SELECT 'r' || user_id % 3 AS reporter, 'ab' || lpad(CAST(user_id AS VARCHAR), 4, '0') AS node, least(arg_min(observed_at, seq), {T0 + 15 * DAY}) AS last_attempt, least(arg_min(CASE WHEN k % 2 = 0 THEN {{'v': observed_at}} ELSE {{'v': NULL}} END, seq).v, {T0 + 15 * DAY}) AS last_success FROM observed WHERE event_type = 'view' AND k % 5 > 0 GROUP BY 1, 2""")
def s26_repeater_reports(v: Views) -> DataFrame:
    """Bodies of bounded size for each reporter; ids that are no keys are left out, later duplicates too."""
    o = v.observed.where("event_type = 'view'")
    node = F.when(F.col("k") % 5 > 0, F.concat(F.lit(" AB"), F.lpad(s("user_id"), 4, "0"))).otherwise("not a key")
    row = F.struct(node.alias("id"), F.col("observed_at").alias("last_attempt"), F.when(F.col("k") % 2 == 0, F.col("observed_at")).alias("last_success"))
    by = o.groupBy((F.col("user_id") % 3).alias("g"), F.floor(F.col("seq") / BODY_ROWS).alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", row.alias("r")))), lambda x: x["r"]).alias("repeaters"))
    body = by.select("block", F.to_json(F.struct(F.concat(F.lit("r"), "g").alias("reporter"), "repeaters")).alias("body"))
    return feeds.repeater_reports(body, F.lit(T0 + 15 * DAY).cast("bigint")).select("reporter", "node", "last_attempt", "last_success")


@query(f"""SELECT 'line' || user_id % 4 AS line, CASE k % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'red' ELSE 'orange' END AS status, least(observed_at, {T0 + 15 * DAY}) AS observed_at FROM observed WHERE event_type = 'signup' AND user_id % 4 < 3 AND k % 4 < 3""")
def s27_burn_readings(v: Views) -> DataFrame:
    o = v.observed.where("event_type = 'signup'")
    said = F.element_at(F.array(*map(F.lit, ("Green", "RED", "orange", "blue"))), F.col("k") % 4 + 1)
    reading = F.struct(F.concat(F.lit("line"), F.col("user_id") % 4).alias("line_id"), said.alias("status"), F.col("k").alias("confidence"), F.date_format(F.timestamp_seconds("observed_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed_at"))
    body = o.select(F.to_json(F.struct(F.array(reading).alias("readings"))).alias("body"))
    return feeds.burn_readings(body, ["line0", "line1", "line2"], F.lit(T0 + 15 * DAY).cast("bigint"))


@query("""SELECT 'town:supplier-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS place_id, CASE WHEN s_nationkey < 20 THEN 'area:nation-' || s_nationkey END AS parent FROM supplier""")
def s28_place_seed(v: Views) -> DataFrame:
    """Towns of the directory and the area each is in; one row of cells has no area."""
    areas = v.places.where("CAST(substring(place_id, 8) AS INT) < 20").select("name", "min_lat", "min_lng", "max_lat", "max_lng")
    towns = v.table("supplier").select(F.replace("s_name", F.lit("#"), F.lit(" ")).alias("name"), (F.lit(35.5) + F.floor(F.col("s_nationkey") / 5)).cast("double").alias("lat"), (F.lit(-123.5) + F.col("s_nationkey") % 5).cast("double").alias("lng"))
    every, _ = feeds.place_seed(areas, towns)
    return every.where("kind = 'TOWN'").select("place_id", "parent")
