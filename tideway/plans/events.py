"""The event model end to end: feed bodies become events, events become map features, stories and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.functions import geo
from tideway.operators import grouped, maps, placing, related, state, summary, timeline
from tideway.plans.adapters import Views
from tideway.plans.feeds import bodies, obs_day, point, s
from tideway.plans.queries import DAY, T0
from tideway.plans.registry import query
from tideway.plans.streams import keeper
from tideway.sources import feeds, normalize

NOW = T0 + 31 * DAY
SEVERITY = "['INFO', 'MINOR', 'MODERATE', 'SEVERE', 'EXTREME']"
STAMP = "strftime(make_timestamp({} * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


def stamped(at, pattern: str = "yyyy-MM-dd'T'HH:mm:ss'Z'"):
    return F.date_format(F.timestamp_seconds(at), pattern)


def ring(dx: float, dy: float, x: float = 0.0):
    """A closed ring of [lng, lat] points, its south-west corner at the row's place moved east by x."""
    lng, lat = F.col("lng") + x, F.col("lat")
    return F.array(*(F.array(F.round(lng + a * dx, 4), F.round(lat + b * dy, 4)) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))


def geometry(kind: str, coordinates):
    return F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))


def pick(*words: str):
    return F.element_at(F.array(*map(F.lit, words)), (F.col("k") % len(words) + 1).cast("int"))


def none(v: Views) -> DataFrame:
    """No events that stand so far."""
    return v.spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in normalize.EVENT.items()))


@query(f"""SELECT 'usgs:' || seq AS id, 'M' || format('{{:.1f}}', 2.5 + (k % 30) / 10) || ' — Place ' || user_id AS headline, CASE WHEN k % 30 >= 25 THEN 3 WHEN k % 30 >= 15 THEN 2 ELSE 1 END AS severity, CASE WHEN k % 2 = 0 THEN observed_at + 5 ELSE observed_at END AS observed_at, 'Point' AS shape FROM observed""")
def q23_earthquakes(v: Views) -> DataFrame:
    c = F.col
    props = F.struct(F.round(2.5 + (c("k") % 30) / 10, 1).alias("mag"), F.concat(F.lit("Place "), "user_id").alias("place"), (c("observed_at") * 1000).alias("time"), F.when(c("k") % 2 == 0, (c("observed_at") + 5) * 1000).otherwise(0).alias("updated"), F.lit("https://example.org").alias("url"))
    item = F.struct(s("seq").alias("id"), props.alias("properties"), point("lat", "lng", c("k").cast("double")).alias("geometry"))
    e = normalize.earthquakes(feeds.quakes(bodies(v.observed, obs_day(), item, "features")))
    return e.select("id", "headline", "severity", "observed_at", F.get_json_object("geojson", "$.type").alias("shape"))


def fire_bodies(v: Views) -> tuple[DataFrame, DataFrame]:
    """Incidents of click rows, and perimeters of purchase rows: of each name's one or two, every third over two polygons."""
    c = F.col
    fire = F.struct(s("seq").alias("UniqueId"), F.concat(F.lit("Fire "), c("seq") % 400).alias("Name"), F.lit("").alias("Location"), F.lit("Placer").alias("County"), c("value").alias("AcresBurned"), c("k").cast("double").alias("PercentContained"), c("lat").alias("Latitude"), c("lng").alias("Longitude"), stamped("observed_at").alias("Started"), stamped("observed_at").alias("Updated"), F.lit("https://example.org").alias("Url"), F.lit(True).alias("IsActive"))
    fires = bodies(v.observed.where("event_type = 'click'"), obs_day(), fire, None)
    props = F.struct(c("seq").alias("OBJECTID"), F.when(c("k") % 4 == 0, "").otherwise(F.concat(F.lit("FIRE "), c("seq") % 900, F.lit(" Fire"))).alias("incident_name"), F.concat(F.lit("CA-TNF-FIRE-"), c("seq") % 900, F.lit("-N42B")).alias("mission"), F.lit("Active").alias("displayStatus"), c("value").alias("area_acres"), (c("observed_at") * 1000).alias("poly_DateCurrent"))
    one, two = geometry("Polygon", F.array(ring(0.1, 0.2))), geometry("MultiPolygon", F.array(F.array(ring(0.1, 0.2)), F.array(ring(0.1, 0.1, 0.4))))
    parts = [bodies(v.observed.where(f"event_type = 'purchase' AND k % 3 {op} 0"), obs_day(), F.struct(props.alias("properties"), g.alias("geometry")), "features") for op, g in (("<>", one), ("=", two))]
    return fires, parts[0].unionByName(parts[1])


_FIRES = f"""f AS (SELECT seq, seq % 400 AS n, value, k, lat, lng, observed_at FROM observed WHERE event_type = 'click'), p AS (SELECT seq, seq % 900 AS n, k, value, observed_at FROM observed WHERE event_type = 'purchase'), one AS (SELECT n FROM p GROUP BY n HAVING count(*) = 1)"""


@query(f"""WITH {_FIRES}, i AS (SELECT 'calfire:' || f.seq AS id, f.n, one.n IS NOT NULL AS has_perimeter, 'ACTIVE' AS status, 'Fire ' || f.n || ' — ' || CAST(floor(value + 0.5) AS BIGINT) || ' ac, ' || k || '% contained' AS headline FROM f LEFT JOIN one USING (n)),
    a AS (SELECT n, seq, k, value, observed_at, row_number() OVER (PARTITION BY n ORDER BY seq) AS r FROM p WHERE n NOT IN (SELECT n FROM i WHERE has_perimeter))
    SELECT id, has_perimeter, status, headline FROM i UNION ALL SELECT 'firis:fire' || n || CASE WHEN r > 1 THEN '-' || r ELSE '' END, true, 'ACTIVE', CASE WHEN k % 4 = 0 THEN 'FIRE ' || n ELSE 'FIRE ' || n || ' Fire' END || ' — ' || CAST(floor(value + 0.5) AS BIGINT) || ' ac' FROM a WHERE {NOW} - observed_at <= {20 * DAY}""")
def q23_wildfires(v: Views) -> DataFrame:
    """Incidents adopt the perimeter of their name, MultiPolygons too; others stand alone, old ones left out."""
    fires, shapes = fire_bodies(v)
    e = normalize.wildfires(feeds.fires(fires), feeds.perimeters(shapes), none(v), (30.0, -130.0, 45.0, -110.0), NOW, 20 * DAY)
    return e.select("id", F.col("wildfire.has_perimeter").alias("has_perimeter"), "status", "headline")


@query("""SELECT seq AS object_id, k % 3 = 0 AS several, round(lat, 4) AS min_lat, round(lng + CASE WHEN k % 3 = 0 THEN 0.5 ELSE 0.1 END, 4) AS max_lng FROM observed WHERE event_type = 'purchase'""")
def s2_multi_perimeters(v: Views) -> DataFrame:
    """Perimeters over one polygon or two, with the box of all."""
    rows = feeds.perimeters(fire_bodies(v)[1])
    return rows.select("object_id", (F.get_json_object("geojson", "$.type") == "MultiPolygon").alias("several"), F.round("min_lat", 4).alias("min_lat"), F.round("max_lng", 4).alias("max_lng"))


@query(f"""WITH {_FIRES}, e AS (SELECT 'calfire:' || seq AS id, n, lat, lng FROM f WHERE k >= 90 AND observed_at >= {NOW - 30 * DAY}), q AS (SELECT o.seq, o.seq % 900 AS n, o.lat + 0.1 AS lat, o.lng + CASE WHEN k % 3 = 0 THEN 0.25 ELSE 0.05 END AS lng FROM observed o WHERE event_type = 'purchase')
    SELECT q.seq AS object_id, min(e.id) AS orphan FROM q LEFT JOIN e ON e.n = q.n AND sqrt(pow((q.lng - e.lng) * 111320.0 * cos(radians((q.lat + e.lat) / 2)), 2) + pow((q.lat - e.lat) * 111320.0, 2)) <= 200000 GROUP BY q.seq""")
def j24_orphan_perimeters(v: Views) -> DataFrame:
    """Perimeters of fires that ended, nearly contained, near by."""
    fires, shapes = fire_bodies(v)
    ended = normalize.wildfires(feeds.fires(fires), feeds.perimeters(shapes).limit(0), none(v), (30.0, -130.0, 45.0, -110.0), NOW, DAY, usable=False)
    return normalize.orphans(feeds.perimeters(shapes), ended, NOW, most_metres=200_000.0).select("object_id", "orphan")


@query("""SELECT object_id, name FROM (SELECT seq AS object_id, CASE k % 5 WHEN 0 THEN 'BEAR CREEK' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'ROSS' ELSE 'N 12' END AS name FROM observed)""")
def t8_mission_names(v: Views) -> DataFrame:
    from tideway.functions import text

    said = pick("CA-TNF-BEAR-CREEK-N42B", "CA-TNF-N42B", "US-TNF-ROSS", " ca-BTU-ROSS ", "CA-XX-N-12")
    return v.observed.select(F.col("seq").alias("object_id"), text.mission_fire(said).alias("name"))


@query("""WITH z AS (SELECT seq, 'caloes:Z' || user_id AS id, 'Zone ' || user_id % 3 || k % 2 AS name, CASE k % 5 WHEN 0 THEN 'ORDER' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'SHELTER_IN_PLACE' WHEN 3 THEN 'ADVISORY' ELSE 'WARNING' END AS level, CASE k % 5 WHEN 0 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 2 END AS r FROM observed WHERE event_type = 'error' AND k % 6 > 0),
    g AS (SELECT id, name, max(r) AS r, min(seq) AS f FROM z GROUP BY id, name) SELECT id || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id, CASE r WHEN 4 THEN 'ORDER' WHEN 3 THEN 'SHELTER_IN_PLACE' WHEN 2 THEN 'WARNING' ELSE 'ADVISORY' END AS level,
    'Evacuation ' || CASE r WHEN 4 THEN 'Order' WHEN 3 THEN 'Shelter In Place' WHEN 2 THEN 'Warning' ELSE 'Advisory' END || ' — ' || name || ' (' || id[8:] || ')' AS headline, 'MultiPolygon' AS shape FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f) AS n FROM g)""")
def q23_evacuations(v: Views) -> DataFrame:
    """Zones of one id and name are one event of the highest level; a blank status counts as a warning, a lifted zone not at all."""
    c = F.col
    said = F.when(c("k") % 6 == 0, "Evacuation Order Lifted").otherwise(pick("Evacuation Order", "Warning", "Shelter in Place", "Voluntary", " "))
    props = F.struct(F.concat(F.lit("Z"), "user_id").alias("ZONE_ID"), F.concat(F.lit("Zone "), (c("user_id") % 3), (c("k") % 2)).alias("ZONE_NAME"), F.lit("Placer").alias("COUNTY"), said.alias("STATUS"), (c("observed_at") * 1000).alias("STATEWIDE_LAST_UPDATED"), c("seq").alias("n"))
    shape = geometry("MultiPolygon", F.array(F.array(ring(0.1, 0.1)), F.array(ring(0.1, 0.1, 0.3))))
    rows = v.observed.where("event_type = 'error'")
    # One body in the order of arrival for each block, so that the order in the feed is the order of seq.
    body = rows.groupBy(F.floor(c("seq") / 10_000).alias("g")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(props.alias("properties"), shape.alias("geometry")).alias("f")))), lambda x: x["f"]).alias("features"))).alias("body")).orderBy("g").select("body")
    e = normalize.evacuations(feeds.evacuations(body))
    return e.select("id", F.col("evacuation.level").alias("level"), "headline", F.get_json_object("geojson", "$.type").alias("shape"))


@query(f"""WITH a AS (SELECT seq, k, user_id, observed_at FROM observed WHERE event_type = 'view') SELECT 'wx:a' || seq AS id, CASE WHEN observed_at > {T0 + 20 * DAY} THEN 'SCHEDULED' ELSE 'ACTIVE' END AS status, CASE k % 4 WHEN 0 THEN 'Wind Advisory — gusty winds near 45 MPH' WHEN 1 THEN 'Flood Watch' WHEN 2 THEN 'Red Flag Warning — low humidity and wind' ELSE 'High Wind Watch' END AS headline,
    CASE k % 3 WHEN 0 THEN ['area:all', 'area:north'] WHEN 1 THEN ['area:all'] ELSE ['area:all', 'area:north', 'area:south'] END AS place_ids FROM a WHERE k % 7 <> 0 AND seq NOT IN (SELECT seq - 5 FROM a WHERE k % 3 = 0)""")
def q23_weather_alerts(v: Views) -> DataFrame:
    """Alerts with a short headline, a status by when they begin, and the areas whose zones they share."""
    c = F.col
    zones = F.when(c("k") % 3 == 0, F.array(F.lit("CAZ1"))).when(c("k") % 3 == 1, F.array(F.lit("CAZ9"))).otherwise(F.array().cast("array<string>"))
    line = pick("WIND ADVISORY IN EFFECT FROM NOON TO 6 PM FOR GUSTY WINDS NEAR 45 MPH", "FLOOD WATCH IN EFFECT THROUGH FRIDAY", "...RED FLAG WARNING REMAINS IN EFFECT UNTIL 8 PM FOR LOW HUMIDITY AND WIND FOR FIRE ZONES 130,132...", "")
    refs = F.when(c("k") % 3 == 0, F.array(F.struct(F.concat(F.lit("a"), c("seq") - 5).alias("identifier"))))
    props = F.struct(
        F.concat(F.lit("a"), "seq").alias("id"), pick("Wind Advisory", "Flood Watch", "Red Flag Warning", "High Wind Watch").alias("event"), F.lit("Severe").alias("severity"), F.create_map(F.lit("NWSheadline"), F.array(line)).alias("parameters"), stamped("observed_at").alias("onset"),
        F.when(c("k") % 7 == 0, "Cancel").otherwise("Alert").alias("messageType"), F.struct(zones.alias("UGC")).alias("geocode"), refs.alias("references"),
    )
    areas = v.spark.createDataFrame([("north", ["CAZ1", "CAZ2"]), ("south", ["CAZ3"]), ("all", [])], "area_id string, zones array<string>")
    alerts = feeds.weather_alerts(bodies(v.observed.where("event_type = 'view'"), obs_day(), F.struct(props.alias("properties")), "features"))
    return normalize.weather_alerts(alerts, areas, F.lit(T0 + 20 * DAY)).select("id", "status", "headline", "place_ids")


@query("""SELECT CASE k % 3 WHEN 0 THEN 'caltrans:C' || user_id || '-' || log || '-' || substr(sha256(place), 1, 6) WHEN 1 THEN 'chp:' || log ELSE 'chp:sign-' || user_id END AS id, headline, severity FROM (SELECT *, row_number() OVER (PARTITION BY CASE k % 3 WHEN 0 THEN 'C' || user_id || log || place WHEN 1 THEN log ELSE 's' || user_id END ORDER BY lat, lng, 'sign ' || user_id) AS r FROM
    (SELECT k, user_id, lat, lng, '24' || lpad(CAST(seq % 10000 AS VARCHAR), 4, '0') || 'ST0001' AS log, CASE k % 4 WHEN 0 THEN 'Traffic Collision-1141 Enrt' WHEN 1 THEN 'Traffic Hazard' WHEN 2 THEN 'Assist with Construction' ELSE 'Car Fire' END AS headline, CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 3 END AS severity, 'x' AS place FROM observed WHERE event_type = 'error')) WHERE r = 1""")
def q23_road_incidents(v: Views) -> DataFrame:
    """Incidents by their ids, the south-west one of each; types in words and what they say of severity."""
    c = F.col
    kind = pick("1183-Trfc Collision-1141 Enrt", "1125-Traffic Hazard", "Assist with Construction", "CFIRE-Car Fire")
    log = F.concat(F.lit("24"), F.lpad((c("seq") % 10000).cast("string"), 4, "0"), F.lit("ST0001"))
    rows = v.observed.where("event_type = 'error'").select(
        F.when(c("k") % 3 < 2, log).alias("log_number"), F.when(c("k") % 3 == 0, F.concat(F.lit("C"), "user_id")).alias("closure_id"), F.concat(F.lit("Sign "), "user_id").alias("name"), F.lit("x").alias("text"), kind.alias("first_line"), F.lit("here").alias("second_line"), "lat", "lng", "seq",
        F.array().cast("array<struct<number:int,stamp:string,text:string>>").alias("log"),
    )
    return normalize.road_incidents(rows, "seq").select("id", "headline", "severity")


@query(f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY seq) AS r FROM observed WHERE event_type = 'signup' AND k % 8 <> 0 AND k % 3 <> 2 AND NOT (k % 5 > 0 AND {T0 + 15 * DAY} >= observed_at + 7200 + CASE WHEN k % 3 = 1 THEN 43200 ELSE 0 END))
    SELECT 'caltrans:C' || user_id || '-' || k AS id, CASE WHEN k % 3 = 1 THEN 'ACTIVE' ELSE 'SCHEDULED' END AS status, 'Hwy 4 eastbound ' || CASE k % 4 WHEN 0 THEN 'full closure' WHEN 1 THEN 'lane closure' WHEN 2 THEN 'shoulder closure' ELSE 'one-way traffic control' END || ' (Paving)' AS headline,
    'Hwy 4 from Arnold to Bear Valley, near Dorrington' AS area_label, CASE WHEN k % 4 = 1 THEN 'Closed: lane 1, right shoulder (of 2 lanes). Estimated delay: 10 min.' ELSE 'Closed: right shoulder (of 2 lanes). Estimated delay: 10 min.' END AS description, 'LineString' AS shape FROM c WHERE r = 1""")
def q23_lane_closures(v: Views) -> DataFrame:
    c, n, k3 = F.col, F.col("k") % 4, F.col("k") % 3
    stamp = F.struct(s("observed_at").alias("closureStartEpoch"), (c("observed_at") + 7200).cast("string").alias("closureEndEpoch"), F.when(c("k") % 5 > 0, "false").otherwise("true").alias("isClosureEndIndefinite"))
    flag = lambda n, on: F.struct(on.alias(f"isCode{n}")).alias(f"code{n}")
    closure = F.struct(
        F.concat(F.lit("C"), "user_id").alias("closureID"), s("k").alias("logNumber"), stamp.alias("closureTimestamp"), F.lit("Mainline").alias("facility"), F.when(n == 0, "Full").when(n == 3, "One-Way Traffic").otherwise("Lane").alias("typeOfClosure"), F.lit("Paving").alias("typeOfWork"), F.lit("10").alias("estimatedDelay"),
        F.when(n == 1, "1, RShoulder").otherwise("RShoulder").alias("lanesClosed"), F.lit("2").alias("totalExistingLanes"), flag(1097, F.when(k3 == 1, "true").otherwise("false")), flag(1098, F.when(c("k") % 8 == 0, "?").otherwise("false")), flag(1022, F.when(k3 == 2, "True").otherwise("false")),
    )
    at = lambda end, name, move, **more: F.create_map(F.lit(f"{end}Latitude"), s("lat"), F.lit(f"{end}Longitude"), (c("lng") + move).cast("string"), F.lit(f"{end}LocationName"), F.lit(name), F.lit(f"{end}Route"), F.lit("sr-4"), F.lit(f"{end}NearbyPlace"), F.lit("Dorrington"))
    place = F.struct(F.lit("East").alias("travelFlowDirection"), at("begin", "From  Arnold", 0.0).alias("begin"), at("end", "to Bear Valley", 0.1).alias("end"))
    rows = feeds.lane_closures(bodies(v.observed.where("event_type = 'signup'"), obs_day(), F.struct(F.struct(place.alias("location"), closure.alias("closure")).alias("lcs")), "data"))
    seq = v.observed.where("event_type = 'signup'").select(F.concat_ws("-", F.concat(F.lit("C"), "user_id"), "k").alias("id"), c("observed_at").alias("starts"), c("seq").alias("order"))
    rows = rows.join(seq, ["id", "starts"]).withColumn("seq", c("order"))
    return normalize.lane_closures(rows, F.lit(T0 + 15 * DAY)).select("id", "status", "headline", "area_label", "description", F.get_json_object("geojson", "$.type").alias("shape"))


@query(f"""SELECT 'pge:o' || seq AS id, CASE WHEN k % 3 = 0 THEN 'planned' ELSE 'unplanned' END AS category, CASE WHEN k % 3 = 0 THEN 'Planned outage' ELSE 'Power outage' END || ' — ' || CASE WHEN floor(value) <= 0 THEN 'customer count not reported' WHEN floor(value) = 1 THEN '1 customer' ELSE CAST(floor(value) AS BIGINT) || ' customers' END || CASE k % 3 WHEN 1 THEN ' (tree contact)' WHEN 2 THEN ' (odd code)' ELSE '' END AS headline, 'ACTIVE' AS status, CASE WHEN k % 2 = 0 THEN 'MultiPolygon' ELSE 'Point' END AS shape FROM observed WHERE event_type = 'click'
    UNION ALL SELECT 'psps:' || user_id || ':' || k % 3, 'psps', 'PSPS ' || CASE WHEN bool_or(k % 2 = 0) THEN 'PSPS Warning' ELSE 'PSPS Watch' END || ' — ' || CASE WHEN sum(k) <= 0 THEN 'customer count not reported' WHEN sum(k) = 1 THEN '1 customer' ELSE format('{{:,}}', CAST(sum(k) AS BIGINT)) || ' customers' END, CASE WHEN min(observed_at) > {T0 + 10 * DAY} THEN 'SCHEDULED' ELSE 'ACTIVE' END, 'MultiPolygon' FROM observed WHERE event_type = 'signup' GROUP BY user_id, k % 3""")
def q23_power(v: Views) -> DataFrame:
    """Outages with their areas, and shutoffs by event and period."""
    c = F.col
    cause = pick("PLNND SHUTDOWN", "TREE CONTACT", "ODD CODE")
    outage = F.struct(F.struct(F.concat(F.lit("o"), "seq").alias("OUTAGE_ID"), cause.alias("OUTAGE_CAUSE"), F.floor("value").cast("int").alias("EST_CUSTOMERS"), (c("observed_at") * 1000).alias("OUTAGE_START")).alias("properties"), point().alias("geometry"))
    area = F.struct(F.struct(F.concat(F.lit("o"), "seq").alias("OUTAGE_ID")).alias("properties"), geometry("MultiPolygon", F.array(F.array(ring(0.1, 0.1)), F.array(ring(0.1, 0.1, 0.3)))).alias("geometry"))
    clicks = v.observed.where("event_type = 'click'")
    out = normalize.outages(feeds.outages(bodies(clicks, obs_day(), outage, "features"), bodies(clicks.where("k % 2 = 0"), obs_day(), area, "features")), none(v))
    props = F.struct(s("user_id").alias("EventID"), (c("k") % 3).cast("string").alias("TimePeriod"), F.when(c("k") % 2 == 0, "PSPS Warning").otherwise("PSPS Watch").alias("Stage"), s("k").alias("TotCustAff"), stamped("observed_at").alias("DeEngStart"))
    off = feeds.shutoffs(bodies(v.observed.where("event_type = 'signup'"), obs_day(), F.struct(props.alias("properties"), geometry("Polygon", F.array(ring(0.1, 0.1))).alias("geometry")), "features"))
    return out.unionByName(normalize.shutoffs(off, F.lit(T0 + 10 * DAY))).select("id", "category", "headline", "status", F.get_json_object("geojson", "$.type").alias("shape"))


@query(f"""WITH r AS (SELECT user_id AS line, arg_max(CASE k % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'red' WHEN 2 THEN 'orange' ELSE 'green' END, (observed_at, seq)) AS status, max(observed_at) AS heard FROM observed WHERE event_type = 'signup' GROUP BY user_id), l AS (SELECT DISTINCT user_id AS line, user_id % 25 AS n FROM observed),
    d AS (SELECT n, CASE WHEN bool_or(s = 'red') THEN 'NO' WHEN bool_or(s = 'orange') THEN 'MARGINAL' WHEN bool_or(s = 'green') AND bool_and(s IS NOT NULL) THEN 'YES' ELSE 'UNKNOWN' END AS day FROM (SELECT n, CASE WHEN {NOW} - heard <= {20 * DAY} THEN status END AS s FROM l LEFT JOIN r USING (line)) GROUP BY n)
    SELECT 'burn:' || lower(n_name) AS id, coalesce(day, 'UNKNOWN') AS day, CASE WHEN coalesce(day, '') = 'NO' OR n_nationkey % 4 = 0 THEN 'PROHIBITED' WHEN day = 'YES' AND n_nationkey % 4 IN (1, 2) THEN 'ALLOWED' ELSE 'UNKNOWN' END AS permission,
    CASE WHEN n_nationkey % 4 = 0 THEN 'Burning suspended by CAL FIRE' WHEN day = 'NO' THEN 'No-burn day' WHEN day = 'YES' AND n_nationkey % 4 IN (1, 2) THEN 'Burn day' WHEN day = 'MARGINAL' AND n_nationkey % 4 IN (1, 2) THEN 'Burn day above 3,500 ft only' ELSE 'Burn status unknown' END AS headline FROM nation LEFT JOIN d ON n = n_nationkey""")
def q23_burn_status(v: Views) -> DataFrame:
    """A county's burn day by its lines, heard lately, and what the state permits: the stricter of both."""
    c = F.col
    nation = v.table("nation").select(F.lower("n_name").alias("county"), c("n_nationkey").alias("n"))
    counties = nation.select("county", F.element_at(F.array(*map(F.lit, ("SUSPENDED", "OPEN", "PERMIT", "UNKNOWN"))), (c("n") % 4 + 1).cast("int")).alias("status"))
    readings = state.last_write_wins(v.observed.where("event_type = 'signup'").select(c("user_id").alias("line"), pick("green", "RED", "orange", "green").alias("status"), "observed_at", "seq"), "line", "observed_at", "seq")
    lines = v.observed.select(c("user_id").alias("line"), (c("user_id") % 25).alias("n")).distinct().join(nation, "n").select("county", "line")
    e = normalize.burn_status(counties, readings.drop("seq"), lines, F.lit(NOW), 20 * DAY)
    return e.select("id", F.col("burn.day").alias("day"), F.col("burn.permission").alias("permission"), "headline")


@query(f"""SELECT id, CASE layer WHEN 'POWER' THEN CASE WHEN category = 'psps' THEN 'Public Safety Power Shutoff' ELSE 'Power outage' END WHEN 'WILDFIRE' THEN 'Wildfire' WHEN 'EVACUATION' THEN 'Evacuation' WHEN 'ROAD_INCIDENT' THEN 'Road incident' ELSE 'Weather alert' END AS kind, {SEVERITY}[severity + 1] AS severity, CASE layer WHEN 'EVACUATION' THEN level ELSE status END AS status,
    CASE WHEN layer <> 'EVACUATION' THEN {STAMP.format('effective')} END AS effective, CASE WHEN layer <> 'WEATHER_ALERT' THEN {STAMP.format('observed_at')} END AS updated_at, CASE layer WHEN 'WILDFIRE' THEN CASE WHEN k % 4 = 0 THEN 'firis' ELSE 'calfire' END WHEN 'EVACUATION' THEN 'caloes' WHEN 'POWER' THEN CASE WHEN category = 'psps' THEN 'psps' ELSE 'pge' END WHEN 'ROAD_INCIDENT' THEN 'chp' ELSE 'nws' END AS source,
    CASE WHEN k % 3 > 0 AND (layer IN ('EVACUATION', 'POWER') OR (layer = 'WILDFIRE' AND k % 4 > 0)) THEN 'https://example.org/e' END AS url, CASE layer WHEN 'WILDFIRE' THEN 'Polygon' WHEN 'WEATHER_ALERT' THEN 'MultiPolygon' ELSE 'Point' END AS shape, CASE layer WHEN 'WILDFIRE' THEN CAST(k AS VARCHAR) WHEN 'POWER' THEN CAST(customers AS VARCHAR) WHEN 'ROAD_INCIDENT' THEN 'L' || k WHEN 'WEATHER_ALERT' THEN category ELSE 'Z' || user_id END AS detail FROM events_now""")
def p15_map_properties(v: Views) -> DataFrame:
    """Each layer's features, read back from their JSON."""
    said = lambda path: F.get_json_object("body", f"$.properties.{path}")
    f = maps.features(v.events_now)
    detail = F.coalesce(said("wildfire.contained"), said("power.customers"), said("incident.log_number"), said("weather.event"), said("evacuation.zone_id"))
    return f.select("id", *(said(n).alias(n) for n in ("kind", "severity", "status", "effective", "updated_at")), said("source.id").alias("source"), said("source.url").alias("url"), F.get_json_object("body", "$.geometry.type").alias("shape"), detail.alias("detail"))


@query("""WITH x AS (SELECT p.place_id, e.* FROM events_now e JOIN event_places p USING (id) WHERE e.status = 'ACTIVE'), h AS (SELECT source_id, CASE WHEN ok THEN 'OK' WHEN sampled_at - last_ok <= 3 * poll_seconds THEN 'STALE' ELSE 'UNAVAILABLE' END AS status FROM (SELECT *, last_value(CASE WHEN ok THEN sampled_at END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY sampled_at, seq ROWS UNBOUNDED PRECEDING) AS last_ok FROM attempts) JOIN sources USING (source_id) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY sampled_at DESC, seq DESC) = 1),
    l AS (SELECT ['WILDFIRE', 'EVACUATION', 'POWER', 'ROAD_INCIDENT', 'WEATHER_ALERT'][s.layer] AS layer, CASE WHEN bool_and(coalesce(h.status, '') = 'OK') THEN 'OK' WHEN bool_and(coalesce(h.status, 'UNAVAILABLE') = 'UNAVAILABLE') THEN 'STALE' ELSE 'STALE' END AS status FROM sources s LEFT JOIN h USING (source_id) GROUP BY 1)
    SELECT place_id, layer, CAST(count(*) AS INT) AS features, min(id) AS first_id, any_value(l.status) AS source_status FROM x JOIN l USING (layer) GROUP BY place_id, layer""")
def q14_map_layers(v: Views) -> DataFrame:
    """A collection for each place and layer, with the health of the layer's sources: a layer whose sources are down but that has events is STALE."""
    layer = F.element_at(F.array(*map(F.lit, ("WILDFIRE", "EVACUATION", "POWER", "ROAD_INCIDENT", "WEATHER_ALERT"))), F.col("layer"))
    health = state.latest(state.source_health(v.attempts, v.sources), "source_id", ["sampled_at", "seq"]).select("source_id", "status", "last_success")
    status = maps.layer_status(health, v.sources.select(layer.alias("layer"), "source_id"))
    placed = maps.features(v.events_now.where("status = 'ACTIVE'")).join(v.event_places, "id").join(status, "layer")
    meta = F.struct(F.col("layer"), F.col("place_id").alias("area"), maps.degraded(F.col("status"), F.lit(True)).alias("source_status"), F.lit(1).alias("schema_version"))
    made = maps.collections(placed, ["place_id", "layer", "status"], meta)
    return made.select("place_id", "layer", F.json_array_length(F.get_json_object("body", "$.features")).alias("features"), F.get_json_object("body", "$.features[0].properties.id").alias("first_id"), F.get_json_object("body", "$.metadata.source_status").alias("source_status"))


@query("""SELECT id, 'eyJ' AS coded, CASE layer WHEN 'WILDFIRE' THEN 'Polygon' WHEN 'WEATHER_ALERT' THEN 'MultiPolygon' ELSE 'Point' END AS kind, round(lat, 3) AS lat, round(lng - half, 3) AS west FROM events_now""")
def p16_geometry_forms(v: Views) -> DataFrame:
    """One geometry in three forms: base64 text, an object, and none with its box and middle."""
    e = v.events_now
    coded = maps.shaped(e, "BASE64").select("id", F.substring("geojson", 1, 3).alias("coded"))
    thing = maps.shaped(e, "OBJECT").select("id", F.try_variant_get("geojson", "$.type", "string").alias("kind"))
    return coded.join(thing, "id").join(maps.shaped(e, "NONE").select("id", F.round("lat", 3).alias("lat"), F.round("min_lng", 3).alias("west")), "id")


@query(f"SELECT id, {SEVERITY}[severity + 1] AS severity, round(lat, 3) AS lat, round(lng, 3) AS lng FROM events_now WHERE layer <> 'MESH'")
def p17_lean_events(v: Views) -> DataFrame:
    return maps.lean(v.events_now).select("id", "severity", F.round("location.lat", 3).alias("lat"), F.round("location.lng", 3).alias("lng"))


@query("""SELECT layer, array_to_string(list_distinct(flatten(list(CASE source_id % 3 WHEN 0 THEN ['a.example', 'b.example'] WHEN 1 THEN ['b.example'] ELSE [] END ORDER BY source_id))).list_sort(), '+') AS parts FROM sources GROUP BY layer""")
def u5_attributions(v: Views) -> DataFrame:
    """The credits of each layer's sources, each part once; told here in one order."""
    layers = v.sources.select("layer", F.col("source_id").alias("position"), "source_id")
    credit = F.when(F.col("source_id") % 3 == 0, "a.example · b.example").when(F.col("source_id") % 3 == 1, " b.example ").otherwise("")
    told = maps.attributions(layers, v.sources.select("source_id", credit.alias("attribution")))
    return told.select("layer", F.array_join(F.array_sort(F.filter(F.split("attribution", " · "), lambda x: x != "")), "+").alias("parts"))


_SPANS = f"""s AS (SELECT *, coalesce(effective, least(observed_at, first_ingested)) AS began, CASE WHEN status IN ('RESOLVED', 'EXPIRED') THEN observed_at ELSE {NOW} END AS ends FROM events_now), t AS (SELECT *, greatest(began, CASE WHEN expires < ends AND expires > began THEN expires ELSE ends END) AS over FROM s),
    p AS (SELECT a.id AS a, b.id AS b, a.layer AS la, b.layer AS lb, a.category AS ca, b.category AS cb, a.user_id % 7 AS fa, b.user_id AS ub, b.k AS kb, b.cause, b.began - a.began AS lag, b.began AS tb, a.began AS ta, a.over AS oa, round(b.lat, 5) >= round(a.lat - a.half, 5) AND round(b.lat, 5) < round(a.lat + a.half, 5) AND round(b.lng, 5) >= round(a.lng - a.half, 5) AND round(b.lng, 5) < round(a.lng + a.half, 5) AS within,
    111.32 * sqrt(pow(greatest(0, a.lat - a.half - b.lat, b.lat - a.lat - a.half), 2) + pow(greatest(0, a.lng - a.half - b.lng, b.lng - a.lng - a.half) * cos(radians((2 * a.lat + 2 * b.lat) / 4)), 2)) AS gap FROM t a JOIN t b ON a.layer IN ('WILDFIRE', 'WEATHER_ALERT') AND b.layer IN ('EVACUATION', 'POWER', 'ROAD_INCIDENT')),
    named AS (SELECT * FROM p WHERE la = 'WILDFIRE' AND lb = 'EVACUATION' AND gap <= 50 AND tb >= ta - 86400 AND tb <= oa + 604800 AND kb % 5 = 0 AND ub % 7 = fa),
    near AS (SELECT * FROM p WHERE la = 'WILDFIRE' AND lb = 'EVACUATION' AND gap <= 8 AND tb >= ta - 3600 AND tb <= oa AND lag <= 259200 AND b NOT IN (SELECT b FROM named) QUALIFY row_number() OVER (PARTITION BY b ORDER BY gap, a) = 1),
    r AS (SELECT a, b, 'fire-evacuation-named' AS rule, 4 AS c, 0 AS k FROM named UNION ALL SELECT a, b, 'fire-evacuation-near', 3, 1 FROM near UNION ALL SELECT a, b, 'fire-outage-cause', 3, 2 FROM p WHERE la = 'WILDFIRE' AND lb = 'POWER' AND cb <> 'psps' AND gap <= 10 AND tb >= ta - 3600 AND tb <= oa + 172800 AND upper(cause) LIKE '%FIRE%'
    UNION ALL SELECT a, b, 'fire-shutoff-near', 2, 3 FROM p WHERE la = 'WILDFIRE' AND lb = 'POWER' AND cb = 'psps' AND gap <= 25 AND tb >= ta - 86400 AND tb <= oa UNION ALL SELECT a, b, 'fire-road-named', 4, 4 FROM p WHERE la = 'WILDFIRE' AND lb = 'ROAD_INCIDENT' AND gap <= 30 AND tb >= ta - 21600 AND tb <= oa + 259200 AND kb % 4 > 0 AND ub % 5 = fa
    UNION ALL SELECT a, b, 'weather-shutoff', 2, 5 FROM p WHERE la = 'WEATHER_ALERT' AND ca IN ('Red Flag Warning', 'High Wind Warning') AND cb = 'psps' AND within AND tb >= ta - 43200 AND tb <= oa UNION ALL SELECT a, b, 'weather-outage', 1, 6 FROM p WHERE la = 'WEATHER_ALERT' AND ca <> 'Red Flag Warning' AND cb = 'unplanned' AND within AND tb >= ta AND tb <= oa
    UNION ALL SELECT a, b, 'weather-road', 1, 7 FROM p WHERE la = 'WEATHER_ALERT' AND ca <> 'Red Flag Warning' AND lb = 'ROAD_INCIDENT' AND within AND tb >= ta AND tb <= oa)"""


def related_pairs(v: Views) -> DataFrame:
    """The related pairs of the newest events, distances between the places as they were observed."""
    return related.pairs(v.newest("lat", "lng"), NOW, keep=keeper(v.spark), tree=v.tree(related.CELL))


@query(f"WITH {_SPANS} SELECT a, b, rule, CAST(c AS INT) AS confidence FROM r QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY c DESC, k) = 1")
def j25_related_rules(v: Views) -> DataFrame:
    """Every related pair of events under the strongest of eight rules."""
    return related_pairs(v).select("a", "b", "rule", "confidence")


@query(f"WITH {_SPANS}, q AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY c DESC, k) = 1) SELECT a AS subject, b AS event, rule FROM q UNION ALL SELECT b, a, rule FROM q")
def q6_related_events(v: Views) -> DataFrame:
    """What is related to each event, seen from either side."""
    side = lambda mine, other: F.struct(F.col(mine).alias("subject"), F.col(other).alias("event"), "rule")
    return related_pairs(v).select(F.inline(F.array(side("a", "b"), side("b", "a"))))


@query("""SELECT id, category IN ('psps') AS shutoff, category IN ('planned', 'unplanned') AS outage, category = 'unplanned' AS unplanned, category IN ('Red Flag Warning') AS fire_weather, category IN ('High Wind Warning') AS wind, category IN ('Winter Storm Watch') AS winter, category = 'Flood Advisory' AS storm FROM events_now""")
def p18_rule_sides(v: Views) -> DataFrame:
    """Which events each side of a rule keeps."""
    sides = {"shutoff": related.category("psps"), "outage": related.category("planned", "unplanned"), "unplanned": related.category("unplanned"), "fire_weather": related.about(*related.FIRE_WEATHER), "wind": related.about(*related.WIND), "winter": related.about(*related.WINTER), "storm": related.about(*related.STORM)}
    return v.events_now.select("id", *(keep().alias(n) for n, keep in sides.items()))


_TENTH = "CASE WHEN {0} > 0 THEN CASE WHEN floor({0} * 10 + 0.5) / 10 = floor(floor({0} * 10 + 0.5) / 10) THEN CAST(CAST(floor(floor({0} * 10 + 0.5) / 10) AS BIGINT) AS VARCHAR) ELSE CAST(floor({0} * 10 + 0.5) / 10 AS VARCHAR) END || ' acres' ELSE '' END"


@query(f"""WITH w AS (SELECT *, lag(severity) OVER o AS s0, lag(status) OVER o AS t0, lag(value) OVER o AS v0, lag(k) OVER o AS k0, lag(level) OVER o AS l0, lag(customers) OVER o AS c0 FROM event_log WINDOW o AS (PARTITION BY id ORDER BY revision)), n AS (SELECT * FROM events_now),
    e AS (SELECT id AS event_id, effective AS "at", 'SOURCE' AS clock, 'BEGINS' AS kind, '' AS field, CASE layer WHEN 'ROAD_INCIDENT' THEN 'Reported' WHEN 'WILDFIRE' THEN 'Started' WHEN 'POWER' THEN 'Outage began' ELSE 'In effect' END AS label, '' AS before, '' AS after FROM n UNION ALL SELECT id, expires, 'SOURCE', 'ENDS', '', 'Ends', '', '' FROM n
    UNION ALL SELECT id, observed_at + 1800, 'SOURCE', 'ESTIMATE', '', 'Estimated restoration', '', '' FROM n WHERE layer = 'POWER' AND k % 7 = 0 UNION ALL SELECT id, observed_at - observed_at % 60, 'SOURCE', 'LOG', '', 'Units on scene', '', '' FROM n WHERE layer = 'ROAD_INCIDENT'
    UNION ALL SELECT id, ingested_at, 'OWN', 'FIRST_RECORDED', '', 'First recorded', '', '' FROM event_log WHERE revision = 1 UNION ALL SELECT id, ingested_at, 'OWN', 'STATUS', 'status', CASE status WHEN 'ACTIVE' THEN 'Active again' ELSE 'Resolved' END, upper(t0[1]) || lower(t0[2:]), upper(status[1]) || lower(status[2:]) FROM w WHERE revision > 1 AND status <> t0
    UNION ALL SELECT id, ingested_at, 'OWN', 'CHANGED', 'severity', 'Severity ' || b, a, b FROM (SELECT *, {SEVERITY}[s0 + 1][1] || lower({SEVERITY}[s0 + 1][2:]) AS a, {SEVERITY}[severity + 1][1] || lower({SEVERITY}[severity + 1][2:]) AS b FROM w) WHERE revision > 1 AND a <> b
    UNION ALL SELECT id, ingested_at, 'OWN', 'CHANGED', 'acres', 'Size ' || b, a, b FROM (SELECT *, {_TENTH.format('v0')} AS a, {_TENTH.format('value')} AS b FROM w WHERE layer = 'WILDFIRE') WHERE revision > 1 AND a <> b UNION ALL SELECT id, ingested_at, 'OWN', 'CHANGED', 'containment', 'Containment ' || k || '%', k0 || '%', k || '%' FROM w WHERE layer = 'WILDFIRE' AND revision > 1 AND k <> k0
    UNION ALL SELECT id, ingested_at, 'OWN', 'CHANGED', 'level', 'Level ' || b, a, b FROM (SELECT *, upper(l0[1]) || lower(replace(l0[2:], '_', ' ')) AS a, upper(level[1]) || lower(replace(level[2:], '_', ' ')) AS b FROM w WHERE layer = 'EVACUATION') WHERE revision > 1 AND a <> b
    UNION ALL SELECT id, ingested_at, 'OWN', 'CHANGED', 'customersAffected', b || ' customers out', a, b FROM (SELECT *, CASE WHEN c0 > 0 THEN CAST(c0 AS VARCHAR) ELSE '' END AS a, CASE WHEN customers > 0 THEN CAST(customers AS VARCHAR) ELSE '' END AS b FROM w WHERE layer = 'POWER') WHERE revision > 1 AND a <> b)
    SELECT * FROM e WHERE "at" > 0""")
def q5_event_timelines(v: Views) -> DataFrame:
    """The story of every event on two clocks."""
    t = timeline.timeline(v.events_now, v.event_log)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return t.select("event_id", "at", "clock", "kind", blank("field"), "label", blank("before"), blank("after"))


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC) AS n FROM event_log) SELECT id AS event_id, count(*) FILTER (n <= 3) > 0 AS told, bool_or(n > 3) AS truncated, min(ingested_at) AS first_at FROM w GROUP BY id""")
def n4_truncated_timelines(v: Views) -> DataFrame:
    """With room for three revisions the first is told all the same, and the rest is said to be left out."""
    t = timeline.timeline(v.events_now, v.event_log, cap=3)
    return t.groupBy("event_id").agg(F.bool_or(F.col("clock") == "OWN").alias("told"), F.first("truncated").alias("truncated"), F.min(F.when(F.col("kind") == "FIRST_RECORDED", F.col("at"))).alias("first_at"))


@query("""SELECT norm, seq FROM (SELECT user_id % 40 AS norm, seq, row_number() OVER (PARTITION BY user_id % 40 ORDER BY observed_at DESC, CASE WHEN status = 'ACTIVE' THEN 0 ELSE 1 END, k, value DESC, seq) AS r FROM observed WHERE event_type = 'error') WHERE r = 1""")
def a14_freshest_perimeters(v: Views) -> DataFrame:
    """One perimeter of each fire, whose rows share an incident number: the latest, then active, then lowest rank, then largest."""
    rows = v.observed.where("event_type = 'error'").select("seq", (F.col("user_id") % 40).alias("norm"), F.lit("i").alias("incident"), "lat", "lng", F.col("observed_at").alias("at"), (F.col("status") == "ACTIVE").alias("active"), F.col("k").alias("rank"), F.col("value").alias("acres"))
    return grouped.perimeters_deduped(rows).select("norm", "seq")


@query("""SELECT c.id, e.n FROM (SELECT 'calfire:' || user_id AS id, user_id FROM events_now WHERE layer = 'WILDFIRE') c JOIN (SELECT user_id, count(*) AS n FROM events_now WHERE layer <> 'WILDFIRE' GROUP BY user_id) e USING (user_id)""")
def j3_lite_events(v: Views) -> DataFrame:
    """The lite copy of an event where there is one, else the event itself without its shape: which columns are read is the plan's business."""
    lite = v.events_now.where("layer = 'WILDFIRE'").select(F.element_at(F.split("id", ":"), 2).cast("bigint").alias("user_id"))
    whole = maps.shaped(v.events_now.where("layer <> 'WILDFIRE'"), "NONE").select(F.element_at(F.split("id", ":"), 2).cast("bigint").alias("user_id"))
    return lite.join(whole.groupBy("user_id").agg(F.count("*").alias("n")), "user_id").select(F.concat(F.lit("calfire:"), "user_id").alias("id"), "n")


@query("""SELECT id, round(lat, 3) AS lat, round(lng, 3) AS lng, true AS lite FROM events_now""")
def w21_lite_copies(v: Views) -> DataFrame:
    e = maps.shaped(v.events_now, "NONE")
    return e.select("id", F.round("lat", 3).alias("lat"), F.round("lng", 3).alias("lng"), F.lit("geojson" not in e.columns).alias("lite"))


@query("""SELECT seq, CASE k % 7 WHEN 0 THEN 'Point' WHEN 1 THEN 'MultiPoint' WHEN 2 THEN 'LineString' WHEN 3 THEN 'MultiLineString' WHEN 4 THEN 'Polygon' WHEN 5 THEN 'MultiPolygon' END AS kind, CASE WHEN k % 7 < 6 THEN round(lat, 4) END AS min_lat, CASE k % 7 WHEN 6 THEN NULL WHEN 0 THEN round(lng, 4) WHEN 5 THEN round(lng + 0.7, 4) ELSE round(lng + 0.2, 4) END AS max_lng,
    CASE k % 7 WHEN 6 THEN NULL WHEN 0 THEN round(lat, 4) ELSE round(lat + 0.05, 4) END AS middle FROM observed""")
def g1_geometries(v: Views) -> DataFrame:
    """Boxes and middles of every kind of geometry; heights are dropped, an empty one has none."""
    c, kind = F.col, F.col("k") % 7
    p = lambda dx, dy: F.array(F.round(c("lng") + dx, 4), F.round(c("lat") + dy, 4), F.lit(9.0))
    ring_ = F.array(p(0, 0), p(0.2, 0), p(0.2, 0.1), p(0, 0.1), p(0, 0))
    far = F.array(p(0.5, 0), p(0.7, 0), p(0.7, 0.1), p(0.5, 0))
    forms = {"Point": p(0, 0), "MultiPoint": F.array(p(0, 0), p(0.2, 0.1)), "LineString": F.array(p(0, 0), p(0.2, 0.1)), "MultiLineString": F.array(F.array(p(0, 0), p(0.2, 0.1))), "Polygon": F.array(ring_), "MultiPolygon": F.array(F.array(ring_), F.array(far))}
    said = F.coalesce(*(F.when(kind == i, F.to_json(F.struct(F.lit(n).alias("type"), x.alias("coordinates")))) for i, (n, x) in enumerate(forms.items())), F.lit('{"type":"MultiPoint","coordinates":[]}'))
    rows = v.observed.select("seq", said.alias("g"))
    b = geo.box(c("g"))
    return rows.select("seq", F.when(b[0].isNotNull(), F.get_json_object("g", "$.type")).alias("kind"), F.round(b[0], 4).alias("min_lat"), F.round(b[3], 4).alias("max_lng"), F.round(geo.centre(b)[0], 4).alias("middle"))


def placed(v: Views) -> DataFrame:
    return v.events_now.where("status = 'ACTIVE'").join(v.event_places, "id")


def conditions(v: Views) -> DataFrame:
    """Live conditions of each place: fire weather and a road."""
    n = F.substring("place_id", 8, 9).cast("int")
    one = lambda layer, severity: v.places.select("place_id", F.concat(F.lit(f"{layer.lower()}:"), n).alias("id"), F.lit(layer).alias("layer"), severity.cast("int").alias("severity"))
    return one("FIRE_WEATHER", F.when(n % 5 == 0, 3).when(n % 5 == 1, 2).otherwise(0)).unionByName(one("ROAD_SEGMENT", n % 3))


def layer_states(v: Views) -> DataFrame:
    states = [("WILDFIRE", "OK"), ("FIRE_WEATHER", "STALE"), ("EVACUATION", "UNAVAILABLE"), ("WEATHER_ALERT", "OK"), ("ROAD_INCIDENT", "OK"), ("CHAIN_CONTROL", "OK"), ("ROAD_SEGMENT", "UNAVAILABLE"), ("POWER", "STALE")]
    return v.spark.createDataFrame(states, "layer string, status string")


_PLACED = """x AS (SELECT p.place_id, e.* FROM events_now e JOIN event_places p USING (id) WHERE e.status = 'ACTIVE'), c AS (SELECT place_id, 'fire_weather:' || n AS id, 'FIRE_WEATHER' AS layer, CASE n % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS severity, n FROM (SELECT place_id, CAST(substr(place_id, 8) AS INT) AS n FROM places) UNION ALL SELECT place_id, 'road_segment:' || n, 'ROAD_SEGMENT', n % 3, n FROM (SELECT place_id, CAST(substr(place_id, 8) AS INT) AS n FROM places))"""


@query(f"""WITH {_PLACED}, i AS (SELECT place_id, id, severity, CASE layer WHEN 'WILDFIRE' THEN 'fire' WHEN 'FIRE_WEATHER' THEN 'fire' WHEN 'EVACUATION' THEN 'evacuation' WHEN 'WEATHER_ALERT' THEN 'weather' WHEN 'POWER' THEN 'power' ELSE 'roads' END AS domain FROM (SELECT place_id, id, severity, layer FROM x UNION ALL SELECT place_id, id, severity, layer FROM c WHERE severity > 0)),
    d AS (SELECT place_id, domain, CAST(count(*) AS BIGINT) AS n, max(severity) AS h, list(id ORDER BY severity DESC, id)[1:3] AS ids FROM i GROUP BY ALL) SELECT place_id, domain, status, coalesce(n, 0) AS active_count, coalesce(h, 0) AS highest, coalesce(ids, []) AS headlines FROM (SELECT place_id, domain, status FROM places, (VALUES ('fire', 'STALE'), ('evacuation', 'UNAVAILABLE'), ('weather', 'OK'), ('roads', 'UNAVAILABLE'), ('power', 'STALE')) s(domain, status)) LEFT JOIN d USING (place_id, domain)""")
def a9_place_domains(v: Views) -> DataFrame:
    """Every place's domains: the worst state of their layers, what is active, the three gravest."""
    return summary.domains(v.places, placed(v), conditions(v), layer_states(v))


@query(f"""WITH {_PLACED}, r AS (SELECT * FROM x WHERE NOT (layer = 'POWER' AND severity = 0)), a AS (SELECT place_id, CAST(count(*) AS BIGINT) AS n, max(severity) AS h, max(CASE WHEN layer = 'WILDFIRE' THEN severity END) AS f, bool_or(layer = 'EVACUATION' AND level <> 'ADVISORY') AS e1, list(id ORDER BY severity DESC, observed_at DESC, id)[1:5] AS top, CAST(count(*) FILTER (severity = 2) AS BIGINT) AS moderate FROM r GROUP BY place_id),
    z AS (SELECT place_id, CAST(count(*) AS BIGINT) AS orders FROM x WHERE layer = 'EVACUATION' GROUP BY place_id), w AS (SELECT place_id, severity >= 2 AS windy FROM c WHERE layer = 'FIRE_WEATHER')
    SELECT place_id, CASE WHEN e1 OR h >= 4 OR f >= 3 THEN 'ACTIVE' WHEN h >= 3 OR orders > 0 OR windy OR orders IS NULL OR h >= 2 THEN 'WATCH' ELSE 'QUIET' END AS mode, coalesce(n, 0) AS total_active, moderate, coalesce(h, 0) AS highest, coalesce(top, []) AS top, orders AS evacuations, CASE WHEN orders > 0 THEN 'STALE' ELSE 'UNAVAILABLE' END AS evacuation_status FROM places LEFT JOIN a USING (place_id) LEFT JOIN z USING (place_id) LEFT JOIN w USING (place_id)""")
def q8_place_summaries(v: Views) -> DataFrame:
    """A summary of every place. The evacuation source is down: what is stored is told as stale, and where nothing is stored the number is unknown."""
    n = F.substring("place_id", 8, 9).cast("int")
    windy = v.places.select("place_id", F.when(n % 5 == 0, "red-flag").when(n % 5 == 1, "elevated").otherwise("normal").alias("state"))
    s_ = summary.summaries(v.places, placed(v), windy, layer_states(v))
    return s_.select("place_id", "mode", "total_active", F.coalesce(F.col("counts")["MODERATE"], F.when(F.col("total_active") > 0, 0)).alias("moderate"), "highest", "top", "evacuations", "evacuation_status")


def place_directory(v: Views) -> DataFrame:
    """Counties and areas as squares, towns as the middle of theirs, and one corridor along a degree of latitude."""
    c = F.col
    b = tuple(c(n) for n in ("min_lat", "min_lng", "max_lat", "max_lng"))
    shape = F.when(c("kind") == "TOWN", geo.point_json(*geo.centre(b))).otherwise(geo.box_json(b))
    line = geo.line_json(F.array(F.array(F.lit(-124.0), F.lit(37.0)), F.array(F.lit(-119.0), F.lit(37.0))))
    corridor = v.spark.range(1).select(F.lit("corridor:1").alias("place_id"), F.lit("CORRIDOR").alias("kind"), F.lit("Corridor").alias("name"), line.alias("geojson"))
    return v.places.select("place_id", "kind", "name", shape.alias("geojson")).unionByName(corridor)


_HELD = """h AS (SELECT seq, place_id, kind, name, CASE WHEN kind = 'TOWN' THEN 2 * 6371000.0 * atan2(sqrt(x), sqrt(1 - x)) ELSE 0 END AS metres FROM (SELECT e.seq, e.lat, e.lng, p.*, pow(sin(radians(p.min_lat + 0.5 - e.lat) / 2), 2) + cos(radians(e.lat)) * cos(radians(p.min_lat + 0.5)) * pow(sin(radians(p.min_lng + 0.5 - e.lng) / 2), 2) AS x FROM current_events e, places p) q
    WHERE CASE WHEN kind = 'TOWN' THEN 2 * 6371000.0 * atan2(sqrt(x), sqrt(1 - x)) <= 30000 ELSE lat >= min_lat AND lat < max_lat AND lng >= min_lng AND lng < max_lng END UNION ALL SELECT seq, 'corridor:1', 'CORRIDOR', 'Corridor', 0 FROM current_events WHERE abs(lat - 37) * 111320.0 <= 1500)"""


@query(f"WITH {_HELD} SELECT seq AS point_id, place_id, row_number() OVER (PARTITION BY seq ORDER BY CASE kind WHEN 'TOWN' THEN 0 WHEN 'AREA' THEN 1 WHEN 'CORRIDOR' THEN 2 ELSE 3 END, metres, name) AS position FROM h")
def j10_resolved_points(v: Views) -> DataFrame:
    """The places of each point: counties and areas that hold it, a corridor near it, towns about it; the most specific first."""
    points = v.current.select(F.col("seq").alias("point_id"), "lat", "lng")
    return placing.resolved(points, place_directory(v), 30_000.0, v.tree(placing.CELL)).select("point_id", "place_id", "position")


@query("""WITH e AS (SELECT id, layer, lat, lng, half FROM events_now), r AS (SELECT e.*, p.place_id, p.min_lat, p.min_lng, p.max_lat, p.max_lng, greatest(0, least(lat + half, max_lat) - greatest(lat - half, min_lat)) * greatest(0, least(lng + half, max_lng) - greatest(lng - half, min_lng)) AS shared, kind FROM e, places p WHERE kind <> 'TOWN'),
    m AS (SELECT id, place_id FROM r WHERE CASE WHEN layer = 'WEATHER_ALERT' THEN shared / least(4 * half * half, 1) >= 0.02 WHEN layer = 'WILDFIRE' THEN shared > 1e-9 OR (kind = 'AREA' AND sqrt(pow(greatest(0, min_lat - lat - half, lat - half - max_lat) * 111320.0, 2) + pow(greatest(0, min_lng - lng - half, lng - half - max_lng) * 111320.0 * cos(radians((2 * lat + min_lat + max_lat) / 4)), 2)) <= 20000) ELSE lat >= min_lat AND lat < max_lat AND lng >= min_lng AND lng < max_lng END
    UNION SELECT id, place_id FROM (SELECT e.*, p.place_id, p.min_lat + 0.5 AS y, p.min_lng + 0.5 AS x FROM e, places p WHERE kind = 'TOWN') WHERE CASE WHEN layer = 'WILDFIRE' THEN sqrt(pow(greatest(0, y - lat - half, lat - half - y) * 111320.0, 2) + pow(greatest(0, x - lng - half, lng - half - x) * 111320.0 * cos(radians((y + lat) / 2)), 2)) <= 20000 WHEN layer = 'WEATHER_ALERT' THEN false
    ELSE 2 * 6371000.0 * asin(sqrt(pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x - lng) / 2), 2))) <= 3000 END UNION SELECT id, 'corridor:1' FROM e WHERE layer NOT IN ('WILDFIRE', 'WEATHER_ALERT') AND abs(lat - 37) * 111320.0 <= 1500 UNION SELECT id, 'corridor:1' FROM e WHERE layer = 'WILDFIRE' AND 37 BETWEEN lat - half AND lat + half AND -121.5 BETWEEN lng - half AND lng + half UNION SELECT id, 'preset' FROM e WHERE layer = 'POWER')
    SELECT id, coalesce(list_sort(list(place_id) FILTER (place_id IS NOT NULL)), []) AS place_ids FROM e LEFT JOIN m USING (id) GROUP BY id""")
def j9_matched_places(v: Views) -> DataFrame:
    """The places of each event by the rules of its shape: points, areas, alerts and fires."""
    preset = F.when(F.col("layer") == "POWER", F.array(F.lit("preset"), F.lit("")))
    return placing.matched(v.events_now.select("id", "layer", "geojson", preset.alias("place_ids")), place_directory(v), keep=keeper(v.spark), tree=v.tree(placing.CELL))


@query("""WITH w AS (SELECT user_id, k % 2 AS county, lat, lng FROM observed WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq) = 1), p AS (SELECT user_id, seq, k % 2 AS county, lat, lng FROM observed WHERE event_type = 'view')
    SELECT 'f' || w.user_id AS base, coalesce(arg_min('p' || p.seq, pow(p.lat - w.lat, 2) + pow(p.lng - w.lng, 2)), 'f' || w.user_id) AS id FROM w LEFT JOIN p ON p.user_id = w.user_id AND p.county = w.county GROUP BY w.user_id""")
def j23_continued_ids(v: Views) -> DataFrame:
    """Each fire goes on under the nearest id it had in its county, else under its own."""
    c = F.col
    base, county = F.concat(F.lit("f"), "user_id").alias("base"), (c("k") % 2).cast("string").alias("county")
    winners = state.first_of(v.observed.where("event_type = 'click'"), ["user_id"], ["seq"]).select(base, c("seq").alias("n"), county, "lat", "lng")
    prior = v.observed.where("event_type = 'view'").select(base, F.concat(F.lit("p"), "seq").alias("id"), county, "lat", "lng", "seq")
    return grouped.continued_ids(winners, prior, "seq").select("base", "id")
