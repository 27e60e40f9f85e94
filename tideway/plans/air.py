"""Weather, cameras and live conditions about places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import geo
from tideway.operators import air, maps, spatial
from tideway.plans.adapters import Views
from tideway.plans.events import NOW, pick, ring, stamped
from tideway.plans.feeds import s
from tideway.plans.queries import DAY, T0
from tideway.plans.registry import query
from tideway.plans.roads import controls, routes
from tideway.plans.shapes import place_shapes
from tideway.sources import feeds


def forecast_bodies(v: Views) -> DataFrame:
    """A body for each place and day of observations, three variables in the order of arrival."""
    c = F.col
    when = F.concat(stamped("observed_at", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("/PT"), c("k") % 3, F.lit("H"))
    value = F.struct(when.alias("validTime"), c("value"))
    place = F.concat(c("user_id") % 25, F.lit(":"), F.floor(c("observed_at") / DAY))
    listed = lambda keep, uom: F.struct(F.lit(uom).alias("uom"), F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("seq", value.alias("v"))))), lambda x: x["v"]).alias("values"))
    body = F.struct(F.struct(listed(F.lit(True), "wmoUnit:m_s-1").alias("windSpeed"), listed(c("k") % 4 > 0, "wmoUnit:percent").alias("relativeHumidity"), listed(c("k") % 5 > 0, "wmoUnit:m_s-1").alias("windGust"), listed(c("k") % 2 == 0, "wmoUnit:mm").alias("quantitativePrecipitation")).alias("properties"))
    return v.observed.where("event_type = 'view'").groupBy(place.alias("place")).agg(F.to_json(body).alias("body"))


_HOURS = f"""v AS (SELECT user_id % 25 || ':' || observed_at // {DAY} AS place, seq, k, value, k % 3 AS n, unnest(range(observed_at - observed_at % 3600, observed_at - observed_at % 3600 + (k % 3) * 3600, 3600)) AS hour FROM observed WHERE event_type = 'view'),
    f AS (SELECT place, hour, arg_max(value, seq) * 3.6 AS wind, arg_max(value, seq) FILTER (k % 4 > 0) AS humidity, arg_max(value, seq) FILTER (k % 5 > 0) * 3.6 AS gust, arg_max(value / n, seq) FILTER (k % 2 = 0) AS rain FROM v GROUP BY place, hour)"""


@query(f"WITH {_HOURS} SELECT place, hour, round(wind, 3) AS wind, round(humidity, 3) AS humidity, round(gust, 3) AS gust, round(rain, 3) AS rain FROM f WHERE humidity IS NOT NULL")
def s11_forecasts(v: Views) -> DataFrame:
    """Several variables of a gridpoint forecast, hour by hour, in metric units, rain spread over its hours."""
    f = air.forecast(forecast_bodies(v))
    return f.select("place", "hour", *(F.round(n, 3).alias(a) for n, a in (("windSpeed", "wind"), ("relativeHumidity", "humidity"), ("windGust", "gust"), ("quantitativePrecipitation", "rain"))))


@query(f"WITH {_HOURS} SELECT place, round(max(gust), 3) AS peak_gust, arg_min(hour, (-gust, hour)) FILTER (gust IS NOT NULL) AS peak_at, round(min(humidity), 3) AS least_humidity FROM f WHERE humidity IS NOT NULL GROUP BY place")
def n9_forecast_peaks(v: Views) -> DataFrame:
    """The strongest gust and the first hour of it, and the driest hour."""
    p = air.peaks(air.forecast(forecast_bodies(v)))
    return p.select("place", F.round("peak_gust", 3).alias("peak_gust"), "peak_at", F.round("least_humidity", 3).alias("least_humidity"))


@query(f"""WITH a AS (SELECT seq, ['Red Flag Warning', 'Fire Weather Watch', 'Flood Watch', 'RED FLAG WARNING'][k % 4 + 1] AS event, CASE WHEN user_id % 30 < 25 THEN user_id % 30 END AS zone, observed_at AS starts, observed_at + 86400 AS expires FROM observed WHERE event_type = 'view' AND user_id % 30 <> 26),
    r AS (SELECT seq, zone, CASE WHEN event ILIKE 'red flag%' AND starts <= {T0 + 10 * DAY} AND expires > {T0 + 10 * DAY} THEN 0 WHEN event ILIKE 'red flag%' AND starts > {T0 + 10 * DAY} THEN 1 WHEN event = 'Fire Weather Watch' THEN 2 END AS rank FROM a)
    SELECT n_nationkey AS place, CASE min(rank) WHEN 0 THEN 'RED_FLAG' WHEN 1 THEN 'RED_FLAG_PENDING' WHEN 2 THEN 'WATCH' ELSE 'NORMAL' END AS state, 'a' || arg_min(seq, (rank, seq)) AS alert_id FROM nation LEFT JOIN r ON (zone = n_nationkey OR zone IS NULL OR n_nationkey = 3) AND rank IS NOT NULL GROUP BY n_nationkey""")
def a26_zone_fire_weather(v: Views) -> DataFrame:
    """Each place's fire weather by its zones; an alert or a place without zones is about everything."""
    c = F.col
    zone = F.when(c("user_id") % 30 < 25, F.array((c("user_id") % 30).cast("string"))).otherwise(F.array().cast("array<string>"))
    alerts = v.observed.where("event_type = 'view' AND user_id % 30 <> 26").select("seq", F.concat(F.lit("a"), "seq").alias("id"), pick("Red Flag Warning", "Fire Weather Watch", "Flood Watch", "RED FLAG WARNING").alias("event"), zone.alias("zones"), c("observed_at").alias("starts"), (c("observed_at") + 86400).alias("expires"))
    zones = v.table("nation").select(c("n_nationkey").alias("place"), F.when(c("n_nationkey") != 3, c("n_nationkey").cast("string")).alias("zone"))
    return air.fire_weather(alerts, zones, F.lit(T0 + 10 * DAY))


@query("""SELECT seq, k % 2 = 0 OR k % 3 = 0 OR k % 5 IN (1, 2) AS passes FROM observed""")
def p11_zone_matches(v: Views) -> DataFrame:
    """Alerts of other senders pass; the weather service's by a zone they share with the area, or for want of zones."""
    own = F.when(F.col("k") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Z"), F.col("k") % 5)))
    rows = v.observed.select("seq", F.when(F.col("k") % 2 == 0, "OTHER").otherwise("NWS").alias("source"), own.alias("zones"))
    kept = air.alerts_for(rows, F.array(F.lit("Z1"), F.lit("Z2"))).select("seq", F.lit(True).alias("passes"))
    return rows.select("seq").join(kept, "seq", "left").select("seq", F.coalesce("passes", F.lit(False)).alias("passes"))


@query("SELECT seq, CASE WHEN k % 2 = 0 THEN lat - 0.0001 ELSE lat END AS y0, CASE WHEN k % 2 = 0 THEN lat + 0.0001 ELSE lat + 1 END AS y1, lng - 0.0001 AS x0, lng + 0.0001 AS x1 FROM observed")
def p10_padded_boxes(v: Views) -> DataFrame:
    c = F.col
    y0, x0, y1, x1 = geo.padded((c("lat"), c("lng"), F.when(c("k") % 2 == 0, c("lat")).otherwise(c("lat") + 1), c("lng")))
    return v.observed.select("seq", y0.alias("y0"), y1.alias("y1"), x0.alias("x0"), x1.alias("x1"))


@query("SELECT min(min_lat) - 0.5 AS min_lat, min(min_lng) - 0.5 AS min_lng, max(max_lat) + 0.5 AS max_lat, max(max_lng) + 0.5 AS max_lng FROM places WHERE kind = 'AREA'")
def p13_area_bounds(v: Views) -> DataFrame:
    return air.union_bounds(v.places.where("kind = 'AREA'"), 0.5)


@query("SELECT id, layer FROM events_now WHERE NOT ((layer = 'POWER' AND severity = 0) OR (layer = 'ROAD_INCIDENT' AND status = 'SCHEDULED'))")
def p14_rollup_events(v: Views) -> DataFrame:
    return air.rollup_events(v.events_now).select("id", "layer")


@query("""SELECT seq AS id, CASE WHEN k % 5 < 3 THEN CASE WHEN k % 2 = 0 AND (k + 1) % 5 < 3 THEN 2 ELSE 1 END WHEN k % 2 = 0 AND (k + 1) % 5 < 3 THEN 1 END AS parts FROM observed WHERE event_type = 'view'""")
def s10_zone_shapes(v: Views) -> DataFrame:
    """An alert's area: the shapes of its zones that are known, as one."""
    c = F.col
    zone = lambda n: F.concat(F.lit("CAZ"), n % 5)
    alerts = v.observed.where("event_type = 'view'").select(c("seq").alias("id"), F.when(c("k") % 2 == 0, F.array(zone(c("k")), zone(c("k") + 1), zone(c("k")))).otherwise(F.array(zone(c("k")))).alias("zones"))
    square = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring(0.5, 0.5)).alias("coordinates")))
    zones = v.spark.range(3).select(F.concat(F.lit("CAZ"), "id").alias("zone"), c("id").cast("double").alias("lng"), F.lit(38.0).alias("lat")).select("zone", square.alias("geojson"))
    return air.zone_shapes(alerts, zones).select("id", F.size(geo.polygons(c("geojson"))).alias("parts"))


def weather(v: Views) -> tuple[DataFrame, DataFrame]:
    """The newest weather of each location (a user), and where those are."""
    body = F.to_json(F.struct(s("user_id").alias("id"), F.col("observed_at").alias("dt"), F.struct(F.col("value").alias("temp")).alias("main"), F.struct((F.col("k") / 4).alias("speed")).alias("wind")))
    w = Window.partitionBy("user_id").orderBy(F.desc("observed_at"), F.desc("seq"))
    last = v.observed.where("event_type = 'view'").withColumn("n", F.row_number().over(w)).where("n = 1")
    return feeds.weather_now(last.select(body.alias("body"))).withColumnRenamed("id", "location_id"), last.select(s("user_id").alias("location_id"), "lat", "lng")


_WEATHER = """w AS (SELECT CAST(user_id AS VARCHAR) AS location_id, lat, lng, observed_at AS at_seconds, CAST(trunc(value) AS INT) AS celsius, CAST(trunc(k / 4 * 3.6) AS INT) AS wind FROM observed WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY observed_at DESC, seq DESC) = 1)"""


@query(f"WITH {_WEATHER} SELECT place_id, location_id, celsius FROM w JOIN places ON lat BETWEEN min_lat AND max_lat AND lng BETWEEN min_lng AND max_lng")
def j17_weather_of_places(v: Views) -> DataFrame:
    return air.weather_at(*weather(v), v.places).select("place_id", "location_id", "celsius")


@query(f"""WITH {_WEATHER}, p AS (SELECT place_id, w.* FROM w JOIN places ON lat BETWEEN min_lat AND max_lat AND lng BETWEEN min_lng AND max_lng), a AS (SELECT place_id, count(DISTINCT id) AS alerts FROM event_places JOIN current_events USING (id) WHERE layer = 5 AND status = 'ACTIVE' GROUP BY place_id)
    SELECT place_id, CAST(count(*) AS BIGINT) AS readings, round(avg(celsius), 1) AS celsius, max(wind) AS wind, CASE WHEN {NOW} - min(at_seconds) <= {2 * DAY} THEN 'fresh' WHEN {NOW} - min(at_seconds) <= {4 * DAY} THEN 'stale' ELSE 'very stale' END AS staleness, CAST(coalesce(any_value(alerts), 0) AS BIGINT) AS alerts FROM p LEFT JOIN a USING (place_id) GROUP BY place_id""")
def q15_place_conditions(v: Views) -> DataFrame:
    """The weather about each place, how old it is, and the alerts that stand there."""
    alerts = v.placed.where("layer = 5 AND status = 'ACTIVE'").select("id", "place_id")
    return air.conditions(air.weather_at(*weather(v), v.places), alerts, F.lit(NOW), 2 * DAY)


@query(f"WITH {_WEATHER} SELECT location_id, celsius, wind AS wind_kmh, at_seconds FROM w ORDER BY location_id")
def q19_weather_list(v: Views) -> DataFrame:
    """The newest weather of every location."""
    return weather(v)[0].select("location_id", "celsius", "wind_kmh", "at_seconds").orderBy("location_id")


@query("SELECT CAST(seq AS VARCHAR) AS location_id, 'Wind' AS event, observed_at AS starts, observed_at + k AS expires, 2 AS tags FROM observed WHERE event_type = 'view' AND k % 3 > 0")
def s22_weather_alerts(v: Views) -> DataFrame:
    """Alerts in weather answers; an answer without any has none."""
    c = F.col
    alert = F.struct(F.lit("NWS").alias("sender_name"), F.lit("Wind").alias("event"), c("observed_at").alias("start"), (c("observed_at") + c("k")).alias("end"), F.lit("text").alias("description"), F.array(F.lit("Wind"), F.lit("Other")).alias("tags"))
    body = F.when(c("k") % 3 > 0, F.to_json(F.struct(F.array(alert).alias("alerts")))).otherwise('{"lat":1}')
    return air.one_call_alerts(v.observed.where("event_type = 'view'").select(s("seq").alias("location_id"), body.alias("body"))).select("location_id", "event", "starts", "expires", F.size("tags").alias("tags"))


@query("""WITH m AS (SELECT 'Town ' || user_id % 12 AS name, 0 AS tier, lat, lng FROM current_events WHERE layer = 1 UNION ALL SELECT 'TOWN ' || user_id % 20, 1, lat, lng FROM current_events WHERE layer = 2), p AS (SELECT seq AS point_id, lat, lng FROM current_events WHERE layer = 3),
    d AS (SELECT point_id, name, tier, 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) AS d FROM (SELECT point_id, name, tier, pow(sin(radians(m.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(m.lat)) * pow(sin(radians(m.lng - p.lng) / 2), 2) AS h FROM p, m)), b AS (SELECT point_id, lower(name) AS key, min(struct_pack(t := tier, d := d, n := name)) AS b FROM d WHERE d <= 40000 GROUP BY ALL),
    n AS (SELECT point_id, list(b.n ORDER BY b)[1:3] AS names FROM b GROUP BY point_id), a AS (SELECT point_id, min(name) AS area FROM p JOIN places ON lat BETWEEN min_lat AND max_lat AND lng BETWEEN min_lng AND max_lng GROUP BY point_id)
    SELECT point_id, coalesce(names, CASE WHEN area IS NOT NULL THEN [area] ELSE [] END) AS names FROM p LEFT JOIN n USING (point_id) LEFT JOIN a USING (point_id)""")
def j27_nearby_names(v: Views) -> DataFrame:
    """What lies near a point, measured places first, the nearest first, three at most; else the area it is in."""
    current = v.keep(v.current.where("layer IN (1, 2, 3)").select("layer", "seq", "user_id", "lat", "lng"))
    named = lambda layer, title, n: current.where(f"layer = {layer}").select(F.concat(F.lit(title), F.col("user_id") % n).alias("name"), "lat", "lng")
    points = current.where("layer = 3").select(F.col("seq").alias("point_id"), "lat", "lng")
    return air.nearby_names(points, named(1, "Town ", 12), named(2, "TOWN ", 20), v.places.select("name", "min_lat", "min_lng", "max_lat", "max_lng"), 40_000, 3, v.keep)


@query("""SELECT id, arg_min(s_suppkey, (district, s_suppkey)) AS first_key, 'STALE' AS status, 1000 AS last_update FROM (SELECT 'd-' || s_suppkey % 40 AS id, s_suppkey, s_nationkey % 5 AS district FROM supplier) WHERE district <> 2 GROUP BY id""")
def a27_camera_directory(v: Views) -> DataFrame:
    """The first camera of each id over the districts ever fetched; one district is missing, so the directory is STALE and tells its oldest fetch."""
    c = F.col
    cameras = v.table("supplier").select((c("s_nationkey") % 5).alias("district"), c("s_suppkey").alias("position"), F.concat(F.lit("d-"), c("s_suppkey") % 40).alias("id"))
    districts = v.spark.range(5).select(c("id").alias("district"), F.when(c("id") != 2, 1000 + 10 * c("id")).alias("fetched_at"), F.lit(False).alias("failed"))
    first, told = air.camera_directory(cameras, districts)
    return first.crossJoin(F.broadcast(told)).select("id", c("position").alias("first_key"), "status", c("last_update").cast("int").alias("last_update"))  # one row


@query("""WITH c AS (SELECT seq AS id, lat, lng FROM current_events WHERE layer = 1), d AS (SELECT c.id, p.place_id, p.kind, sqrt(pow(greatest(0, p.min_lat - lat, lat - p.max_lat) * 111320.0, 2) + pow(greatest(0, p.min_lng - lng, lng - p.max_lng) * 111320.0 * cos(radians((lat + (p.min_lat + p.max_lat) / 2) / 2)), 2)) AS m FROM c, places p),
    n AS (SELECT DISTINCT id FROM d WHERE kind = 'AREA' AND m <= 20000) SELECT place_id, id, row_number() OVER (PARTITION BY place_id ORDER BY m, id) AS position FROM d JOIN n USING (id) WHERE kind = 'TOWN' AND m <= 20000""")
def q16_cameras_of_places(v: Views) -> DataFrame:
    """Cameras near the covered areas and near a town, the nearest first."""
    shapes = place_shapes(v)
    found = air.cameras_near(v.current.where("layer = 1").select(F.col("seq").alias("id"), "lat", "lng"), shapes.where("kind = 'AREA'"), shapes.where("kind = 'TOWN'"), 20_000)
    return found.select("place_id", "id", "position")


_FEEDS = "(SELECT 'nation-' || (s_nationkey // 2) AS area, CAST(s_suppkey % 40 AS VARCHAR) AS feed_id, s_name AS label, s_suppkey AS ord FROM supplier)"


@query(f"""SELECT place_id, feed_id, label, 'https://www.broadcastify.com/listen/feed/' || feed_id AS url, row_number() OVER (PARTITION BY place_id ORDER BY ord, feed_id) AS position FROM (SELECT place_id, f.* EXCLUDE (area) FROM places JOIN {_FEEDS} f ON area = slug AND kind = 'AREA'
    UNION ALL SELECT place_id, f.* EXCLUDE (area) FROM places, (SELECT * FROM {_FEEDS} QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY ord) = 1) f WHERE kind <> 'AREA' OR slug NOT IN (SELECT area FROM {_FEEDS}))""")
def q16_scanners_of_places(v: Views) -> DataFrame:
    """The configured scanner feeds of each place: an area's own, else those of all areas, each once."""
    c = F.col
    feeds = v.table("supplier").select(F.concat(F.lit("nation-"), F.floor(c("s_nationkey") / 2)).alias("area"), (c("s_suppkey") % 40).cast("string").alias("feed_id"), c("s_name").alias("label"), F.lit("").alias("agency"), c("s_suppkey").alias("ord"))
    return air.scanners(v.places, feeds).select("place_id", "feed_id", "label", "url", "position")


@query("""SELECT 'CHAIN_CONTROL' AS layer, 'chain:' || seq AS id, CASE WHEN k % 7 = 0 THEN 3 ELSE k % 3 + 1 END AS severity, 'Point' AS kind FROM current_events WHERE layer IN (1, 2) UNION ALL SELECT 'ROAD_SEGMENT', 'road:' || n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END, 'LineString' FROM nation
    UNION ALL SELECT 'FIRE_WEATHER', 'fire-weather:' || n_nationkey, CASE n_nationkey % 3 WHEN 1 THEN 3 ELSE 2 END, NULL FROM nation WHERE n_nationkey % 3 > 0 UNION ALL SELECT 'MESSAGE_SIGN', 'sign:m' || seq, 0, 'Point' FROM current_events WHERE layer = 3 AND k % 4 IN (1, 2) AND k % 5 > 0""")
def q21_condition_layers(v: Views) -> DataFrame:
    """The four layers of live conditions."""
    c, n = F.col, F.col("route_id")
    chain = controls(v).join(v.current.select(c("seq").alias("sign_id"), F.concat(F.lit("R"), c("k") % 3 + 1).alias("level")), "sign_id")
    lines = routes(v).withColumns({"status": F.when(n % 3 == 0, "CLOSED").when(n % 3 == 1, "RESTRICTED").otherwise("OPEN"), "congestion": F.lit("CLEAR")})
    fire = v.table("nation").select(c("n_nationkey").alias("place"), F.element_at(F.array(*map(F.lit, ("NORMAL", "RED_FLAG", "WATCH"))), (c("n_nationkey") % 3 + 1).cast("int")).alias("state"))
    signs = v.current.where("layer = 3").select(F.concat(F.lit("m"), "seq").alias("id"), pick("BLANK", "ONE_PAGE", "TWO_PAGES", "UNKNOWN").alias("display"), (c("k") % 5 > 0).alias("in_service"), F.lit("SLOW / ICE").alias("lines"), "lat", "lng")
    return air.condition_features(chain, lines, fire, signs).select("layer", "id", "severity", F.get_json_object("geojson", "$.type").alias("kind"))
