"""Feed parsers over bodies built from the star tables: one body for each day of observations, or each group of suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import classify, geo, text, times
from tideway.operators import state
from tideway.plans.adapters import Views
from tideway.plans.registry import query
from tideway.sources import feeds

DAY = 86400


#: Rows in one body at most, where a whole table is told in bodies.
BODY_ROWS = 10_000


def bodies(rows: DataFrame, by: Column, item: Column, name: str | None, number: str = "seq", **extra: Column) -> DataFrame:
    """JSON bodies for each group, {name: [items]} or the bare list: one for each run of BODY_ROWS numbers, so that none grows with the table."""
    items = F.collect_list(item)
    body = F.to_json(F.struct(items.alias(name), *(v.alias(k) for k, v in extra.items()))) if name else F.to_json(items)
    return rows.groupBy(by.alias("_by"), F.floor(F.col(number) / BODY_ROWS).alias("_block")).agg(body.alias("body")).select("body")


def s(c: str) -> Column:
    return F.col(c).cast("string")


def point(lat: str = "lat", lng: str = "lng", *more: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.col(lng), F.col(lat), *more).alias("coordinates"))


def obs_day() -> Column:
    return F.floor(F.col("observed_at") / DAY)


STAMP_SQL = "strftime(make_timestamp(observed_at * 1000000), '%Y-%m-%dT%H:%M:%S')"


@query("""SELECT 'calfire:' || seq AS id, coalesce(CASE WHEN k % 7 > 0 THEN value END, 0) AS acres, CAST(CASE WHEN k % 5 > 0 THEN k ELSE 0 END AS INT) AS contained,
    CAST(epoch(timezone('America/Los_Angeles', make_timestamp(observed_at * 1000000))) AS BIGINT) AS started, observed_at AS updated, status = 'ACTIVE' AS active FROM observed WHERE event_type = 'error'""")
def s1_fires(v: Views) -> DataFrame:
    """Fire incidents: absent numbers are 0, naive stamps are local, stamps with an offset are not."""
    o = v.observed.where("event_type = 'error'")
    at = F.timestamp_seconds("observed_at")
    item = F.struct(s("seq").alias("UniqueId"), F.col("id").alias("Name"), F.when(F.col("k") % 7 > 0, F.col("value")).alias("AcresBurned"), F.when(F.col("k") % 5 > 0, F.col("k").cast("double")).alias("PercentContained"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss").alias("Started"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Updated"), (F.col("status") == "ACTIVE").alias("IsActive"))
    return feeds.fires(bodies(o, obs_day(), item, None)).select("id", "acres", "contained", "started", "updated", "active")


@query("""SELECT 'usgs:' || seq AS id, value / 40 AS mag, observed_at AS at_seconds, lat, lng, CAST(k AS DOUBLE) AS depth_km, CASE WHEN value / 40 >= 5 THEN 3 WHEN value / 40 >= 4 THEN 2 ELSE 1 END AS severity FROM observed WHERE value / 40 >= 2.5""")
def s12_quakes(v: Views) -> DataFrame:
    props = F.struct((F.col("value") / 40).alias("mag"), F.col("id").alias("place"), (F.col("observed_at") * 1000).alias("time"))
    item = F.struct(s("seq").alias("id"), props.alias("properties"), point("lat", "lng", F.col("k").cast("double")).alias("geometry"))
    return feeds.quakes(bodies(v.observed, obs_day(), item, "features")).select("id", "mag", "at_seconds", "lat", "lng", "depth_km", "severity")


@query("""SELECT 'caloes:' || seq AS id, CASE k % 6 WHEN 0 THEN 'ORDER' WHEN 2 THEN 'WARNING' WHEN 3 THEN 'SHELTER_IN_PLACE' WHEN 4 THEN 'ADVISORY' ELSE 'WARNING' END AS level, CASE k % 6 WHEN 0 THEN 4 WHEN 4 THEN 2 ELSE 3 END AS severity, observed_at AS updated FROM observed WHERE k % 6 <> 1""")
def s4_evacuations(v: Views) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("Evacuation Order", "Evacuation Order Lifted", "evacuation WARNING", "Shelter in Place", "Voluntary", "Be ready"))), F.col("k") % 6 + 1)
    item = F.struct(F.struct(s("seq").alias("ZONE_ID"), F.col("id").alias("ZONE_NAME"), said.alias("STATUS"), (F.col("observed_at") * 1000).alias("STATEWIDE_LAST_UPDATED")).alias("properties"))
    return feeds.evacuations(bodies(v.observed, obs_day(), item, "features")).select("id", "level", "severity", "updated")


@query("""WITH p AS (SELECT user_id % 40 AS g, min_by(seq, seq) AS seq FROM observed WHERE event_type = 'click' GROUP BY 1), x AS (SELECT p.g, CAST(floor(o.value) AS INT) AS customers, o.lat, o.lng FROM p JOIN observed o USING (seq)),
    q AS (SELECT (user_id + 20) % 60 AS g, count(*) AS areas FROM observed WHERE event_type = 'signup' GROUP BY 1)
    SELECT 'o' || g AS id, coalesce(customers, 0) AS customers, lat, lng, CAST(coalesce(areas, 0) AS INT) AS areas, CASE WHEN coalesce(customers, 0) <= 0 THEN 1 WHEN customers >= 1000 THEN 3 WHEN customers >= 100 THEN 2 WHEN customers >= 10 THEN 1 ELSE 0 END AS severity FROM x FULL JOIN q USING (g)""")
def s5_outages(v: Views) -> DataFrame:
    """Points and areas of outages merged on their id."""
    o = v.observed
    one = F.struct(F.concat(F.lit("o"), F.col("user_id") % 40).alias("OUTAGE_ID"), F.floor("value").cast("int").alias("EST_CUSTOMERS"))
    points = o.where("event_type = 'click'").groupBy(F.floor(F.col("seq") / BODY_ROWS).alias("block")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("properties"), point().alias("geometry")))), lambda x: F.struct(x["properties"].alias("properties"), x["geometry"].alias("geometry"))).alias("features"))).alias("body"))
    ring = F.array(F.array(*(F.array(F.col("lng") + dx, F.col("lat") + dy) for dx, dy in ((0, 0), (0.1, 0), (0.1, 0.1)))))
    item = F.struct(F.struct(F.concat(F.lit("o"), (F.col("user_id") + 20) % 60).alias("OUTAGE_ID")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"))
    areas = bodies(o.where("event_type = 'signup'"), obs_day(), item, "features")
    return feeds.outages(points, areas).select("id", "customers", "lat", "lng", "areas", "severity")


@query("""SELECT 'psps:' || user_id || ':' || k % 3 AS id, CAST(sum(CASE WHEN k % 4 > 0 THEN k ELSE 0 END) AS BIGINT) AS customers, min(observed_at) AS starts, max(CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END) AS severity FROM observed WHERE event_type = 'signup' GROUP BY 1""")
def s6_shutoffs(v: Views) -> DataFrame:
    o = v.observed.where("event_type = 'signup'")
    props = F.struct(s("user_id").alias("EventID"), (F.col("k") % 3).cast("string").alias("TimePeriod"), F.when(F.col("k") % 2 == 0, "PSPS Warning").otherwise("PSPS Watch").alias("Stage"), F.when(F.col("k") % 4 > 0, F.concat(F.lit(" "), s("k"))).otherwise("n/a").alias("TotCustAff"), F.date_format(F.timestamp_seconds("observed_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("DeEngStart"))
    return feeds.shutoffs(bodies(o, obs_day(), F.struct(props.alias("properties")), "features")).select("id", "customers", "starts", "severity")


@query("""WITH a AS (SELECT seq, k, observed_at FROM observed WHERE event_type = 'view'), kept AS (SELECT * FROM a WHERE k % 4 IN (0, 1))
    SELECT 'a' || seq AS id, CASE k % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS severity, observed_at AS starts FROM kept WHERE k % 7 <> 0 AND seq NOT IN (SELECT seq - 5 FROM kept WHERE k % 3 = 0)""")
def s9_alerts(v: Views) -> DataFrame:
    """Alerts of two zones (or none named) that no other listed one replaces."""
    o = v.observed.where("event_type = 'view'")
    zones = F.when(F.col("k") % 4 == 0, F.array(F.lit("CAZ137"), F.lit("CAZ001"))).when(F.col("k") % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("CAZ999")))
    refs = F.when(F.col("k") % 3 == 0, F.array(F.struct(F.concat(F.lit("a"), F.col("seq") - 5).alias("identifier"))))
    said = F.element_at(F.array(*map(F.lit, ("Extreme", "Severe", "Moderate", "Minor", "Unknown"))), F.col("k") % 5 + 1)
    props = F.struct(F.concat(F.lit("a"), "seq").alias("id"), said.alias("severity"), F.date_format(F.timestamp_seconds("observed_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("effective"), F.when(F.col("k") % 7 == 0, "Cancel").otherwise("Alert").alias("messageType"), F.struct(zones.alias("UGC")).alias("geocode"), refs.alias("references"))
    alerts = feeds.weather_alerts(bodies(o, obs_day(), F.struct(props.alias("properties")), "features"), "caz137, CAZ138")
    return feeds.standing_alerts(alerts).select("id", "severity", "starts")


@query(f"""SELECT 'c' || seq AS id, CAST(epoch(timezone('America/Los_Angeles', make_timestamp(observed_at * 1000000))) AS BIGINT) AS recorded_at, k % 2 = 0 AS in_service, CASE WHEN k % 6 < 4 THEN 'R' || k % 6 ELSE 'UNKNOWN' END AS level, lat FROM observed WHERE event_type = 'click'""")
def s16_chain_controls(v: Views) -> DataFrame:
    at = F.timestamp_seconds("observed_at")
    stamp = F.struct(F.date_format(at, "yyyy-MM-dd").alias("recordDate"), F.date_format(at, "HH:mm:ss").alias("recordTime"))
    status = F.when(F.col("k") % 6 < 4, F.concat(F.when(F.col("k") % 2 == 0, "R-").otherwise("R"), F.col("k") % 6)).otherwise("-120.55")
    cc = F.struct(F.concat(F.lit("c"), "seq").alias("index"), stamp.alias("recordTimestamp"), F.struct(s("lat").alias("latitude"), s("lng").alias("longitude")).alias("location"), F.when(F.col("k") % 2 == 0, "True").otherwise("").alias("inService"), F.struct(status.alias("status")).alias("statusData"))
    return feeds.chain_controls(bodies(v.observed.where("event_type = 'click'"), obs_day(), F.struct(cc.alias("cc")), "data")).select("id", "recorded_at", "in_service", "level", "lat")


@query("""SELECT 'm' || seq AS id, CASE k % 4 WHEN 0 THEN 'BLANK' WHEN 1 THEN 'ONE_PAGE' WHEN 2 THEN 'TWO_PAGES' ELSE 'UNKNOWN' END AS display, CASE k % 4 WHEN 1 THEN id WHEN 2 THEN id || ' / ' || status ELSE '' END AS lines FROM observed WHERE event_type = 'purchase'""")
def s17_message_signs(v: Views) -> DataFrame:
    n = F.col("k") % 4
    one = F.struct(F.when(n.isin(1, 2), F.concat(F.lit(" "), "id")).otherwise("Not Reported").alias("phase1Line1"))
    two = F.struct(F.when(n == 2, F.col("status")).otherwise("").alias("phase2Line1"))
    cms = F.struct(F.concat(F.lit("m"), "seq").alias("index"), F.struct(F.when(n == 0, "Blank").otherwise("1 Page").alias("display"), one.alias("phase1"), two.alias("phase2")).alias("message"))
    return feeds.message_signs(bodies(v.observed.where("event_type = 'purchase'"), obs_day(), F.struct(cms.alias("cms")), "data")).select("id", "display", "lines")


@query("""SELECT 'd3-' || s_suppkey AS id, s_name AS name, CAST(greatest(s_nationkey - 3, 0) AS INT) AS minutes, 'https://img.example/' || s_suppkey AS image FROM supplier WHERE s_nationkey % 3 > 0 AND s_suppkey % 4 > 0""")
def s18_cameras(v: Views) -> DataFrame:
    """Cameras in service with a position and a safe image address."""
    c = v.table("supplier")
    url = F.concat(F.when(F.col("s_nationkey") % 3 > 0, "https").otherwise("http"), F.lit("://img.example/"), "s_suppkey")
    row = F.struct(s("s_suppkey").alias("index"), F.struct(F.col("s_name").alias("locationName"), F.lit("38.1").alias("latitude"), F.lit("-120.5").alias("longitude")).alias("location"), F.when(F.col("s_suppkey") % 4 > 0, "true").otherwise("false").alias("inService"), F.struct(F.struct(url.alias("currentImageURL"), (F.col("s_nationkey") - 3).cast("string").alias("currentImageUpdateFrequency")).alias("static")).alias("imageData"))
    return feeds.cameras(bodies(c, F.col("s_nationkey"), F.struct(row.alias("cctv")), "data", "s_suppkey"), 3).select("id", "name", "minutes", "image")


@query(f"""SELECT 'C' || user_id || '-' || seq AS id, observed_at AS starts, CASE WHEN k % 5 > 0 THEN observed_at + 7200 END AS ends, CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 2 END AS severity, CASE WHEN k % 8 = 0 THEN 'flag' END AS unrecognized,
    CASE WHEN k % 3 = 2 THEN 'CANCELLED' WHEN k % 5 > 0 AND 1705000000 >= observed_at + 7200 + CASE WHEN k % 3 = 1 THEN 43200 ELSE 0 END THEN 'COMPLETED' WHEN k % 3 = 1 THEN 'ACTIVE' ELSE 'SCHEDULED' END AS phase FROM observed WHERE event_type = 'signup'""")
def s15_lane_closures(v: Views) -> DataFrame:
    """Closures with their window, severity and phase at a moment."""
    n, k3 = F.col("k") % 4, F.col("k") % 3
    at = F.timestamp_seconds("observed_at")
    local = F.from_utc_timestamp(at, "America/Los_Angeles")
    stamp = F.struct(F.lit("").alias("closureStartEpoch"), F.date_format(local, "yyyy-MM-dd").alias("closureStartDate"), F.date_format(local, "HH:mm:ss").alias("closureStartTime"), (F.col("observed_at") + 7200).cast("string").alias("closureEndEpoch"), F.when(F.col("k") % 5 > 0, "false").otherwise("true").alias("isClosureEndIndefinite"))
    flag = lambda n, on: F.struct(on.alias(f"isCode{n}")).alias(f"code{n}")
    closure = F.struct(
        F.concat(F.lit("C"), "user_id").alias("closureID"), s("seq").alias("logNumber"), stamp.alias("closureTimestamp"), F.lit("Mainline").alias("facility"), F.when(n == 0, "Full").when(n == 3, "One-Way Traffic").otherwise("Lane").alias("typeOfClosure"), F.when(n == 1, "1, RShoulder").otherwise("RShoulder").alias("lanesClosed"), F.lit("2").alias("totalExistingLanes"),
        flag(1097, F.when(k3 == 1, "true").otherwise("false")), flag(1098, F.when(F.col("k") % 8 == 0, "?").otherwise("false")), flag(1022, F.when(k3 == 2, "True").otherwise("false")),
    )
    place = F.struct(F.create_map(F.lit("beginLatitude"), s("lat"), F.lit("beginLongitude"), s("lng"), F.lit("beginRoute"), F.lit("sr-4")).alias("begin"))
    rows = feeds.lane_closures(bodies(v.observed.where("event_type = 'signup'"), obs_day(), F.struct(F.struct(place.alias("location"), closure.alias("closure")).alias("lcs")), "data"))
    return feeds.closure_phase(rows, F.lit(1705000000)).select("id", "starts", "ends", "severity", "unrecognized", "phase")


@query("""SELECT CASE WHEN user_id % 2 = 0 THEN id ELSE 'Sign ' || id END AS name, round(lat, 6) AS lat, round(lng, 6) AS lng, regexp_extract('24' || lpad(CAST(seq % 10000 AS VARCHAR), 4, '0') || 'ST0001', '([0-9]{6}[A-Z]{2}[0-9]{4})', 1) AS log_number, id AS second_line, CAST(2 AS INT) AS lines FROM observed WHERE event_type = 'error' AND k % 3 > 0""")
def s13_placemarks(v: Views) -> DataFrame:
    """KML placemarks and what their markup says; those without a place are left out."""
    o = v.observed.where("event_type = 'error'")
    log = F.lit("Jul 4 2026 12:32PM [2] second<br>Jul 4 2026 12:30PM [1] first<br>noise")
    html = F.format_string('<h2 class="iw-title">Sign %s</h2><p class="iw-text">Jan 5 2024 1:00PM <br> %s </p><p class="iw-text">%s</p> 24%sST0001', F.col("id"), F.col("id"), log, F.lpad((F.col("seq") % 10000).cast("string"), 4, "0"))
    where = F.when(F.col("k") % 3 > 0, F.concat(F.lit("<Point><coordinates>"), F.round("lng", 6).cast("string"), F.lit(","), F.round("lat", 6).cast("string"), F.lit(",0</coordinates></Point>"))).otherwise("")
    mark = F.concat(F.lit("<Placemark><name>"), F.when(F.col("user_id") % 2 == 0, F.col("id")).otherwise(""), F.lit("</name><description><![CDATA["), html, F.lit("]]></description>"), where, F.lit("</Placemark>"))
    kml = o.groupBy(obs_day().alias("d"), F.floor(F.col("seq") / BODY_ROWS).alias("block")).agg(F.concat(F.lit("<kml><Document>"), F.array_join(F.collect_list(mark), "\n"), F.lit("</Document></kml>")).alias("body")).select("body")
    rows = feeds.incident_details(feeds.placemarks(kml))
    return rows.select("name", "lat", "lng", "log_number", "second_line", F.size("log").alias("lines"))


@query("""SELECT n_name AS area, CASE n_nationkey % 5 WHEN 0 THEN 'CLOSURE' WHEN 1 THEN 'CHAIN_CONTROL' WHEN 2 THEN 'CHAIN_INFO' WHEN 3 THEN 'RESTRICTION' ELSE 'INFO' END AS kind FROM nation""")
def s20_road_conditions(v: Views) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("is closed from A to B", "Chains are required today", "No chains required; carry chains", "1-way: ONE-WAY controlled traffic", "No traffic restrictions are reported"))), F.col("n_nationkey") % 5 + 1)
    page = v.table("nation").agg(F.concat(F.lit("<h3> SR 4 </h3>"), F.array_join(F.collect_list(F.concat(F.lit("<p><strong>["), "n_name", F.lit("]</strong> "), said, F.lit("</p>"))), ""), F.lit("<hr><h3>SR 5</h3><p>other</p>")).alias("body"))
    return feeds.road_conditions(page, "4").select("area", "kind")


@query("""SELECT lower(n_name) AS county, CASE n_nationkey % 4 WHEN 0 THEN 'SUSPENDED' WHEN 1 THEN 'OPEN' WHEN 2 THEN 'PERMIT' ELSE 'UNKNOWN' END AS status FROM nation""")
def s21_burn_table(v: Views) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("Burn permits suspended", "No permit required", "Permit required", "Call"))), F.col("n_nationkey") % 4 + 1)
    n = v.table("nation")
    row = lambda c: F.concat(F.lit("<tr><td>"), "n_name", F.lit(" County</td><td>"), c, F.lit("</td></tr>"))
    page = n.agg(F.concat(F.lit("<table><tr><th>County</th></tr>"), F.array_join(F.collect_list(row(F.lit("Permit required"))), ""), F.array_join(F.collect_list(row(said)), ""), F.lit("</table>")).alias("body"))
    return feeds.burn_table(page)


@query("""SELECT hour, value, share FROM (SELECT h AS hour, arg_max(value, seq) AS value, arg_max(value / n, seq) AS share FROM (SELECT seq, value, k % 5 + 1 AS n, unnest(range(observed_at - observed_at % 3600, observed_at - observed_at % 3600 + (k % 5 + 1) * 3600, 3600)) AS h FROM observed WHERE event_type = 'view') GROUP BY h)""")
def n8_forecast_hours(v: Views) -> DataFrame:
    """Interval-coded values as hours; amounts are spread over their hours."""
    o = v.observed.where("event_type = 'view'").select("seq", F.struct(F.concat(F.date_format(F.timestamp_seconds("observed_at"), "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("/PT"), F.col("k") % 5 + 1, F.lit("H")).alias("validTime"), "value").alias("v"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("seq", "v"))), lambda x: x["v"])
    body = o.groupBy(F.floor(F.col("seq") / BODY_ROWS).alias("block")).agg(F.to_json(F.struct(F.struct(F.struct(values.alias("values")).alias("amount")).alias("properties"))).alias("body"))
    return feeds.forecast_hours(body, "amount").select("hour", "value", "share")


@query("""SELECT lower('AB' || user_id) AS origin, CAST(k % 9 AS INT) AS packet_type, CASE WHEN k % 3 > 0 THEN value END AS snr, CASE WHEN k % 11 > 0 THEN CAST(k % 16 AS INT) END AS payload_type, CASE WHEN k % 11 > 0 THEN CAST(k % 4 AS INT) END AS route_type, CASE WHEN k % 11 > 0 THEN 'OK' ELSE 'MALFORMED' END AS outcome, seq AS hash FROM observed""")
def s25_packets(v: Views) -> DataFrame:
    """Radio envelopes: quoted numbers, header bits, malformed ones told."""
    header = F.lpad(F.hex((F.col("k") % 16) * 4 + F.col("k") % 4), 2, "0")
    raw = F.when(F.col("k") % 11 > 0, F.concat(header, F.lit("00ff"))).otherwise("zz")
    body = F.to_json(F.struct(F.concat(F.lit("AB"), "user_id").alias("origin_id"), (F.col("k") % 9).cast("string").alias("packet_type"), F.when(F.col("k") % 3 > 0, F.col("value")).alias("SNR"), s("seq").alias("hash"), raw.alias("raw")))
    return feeds.packets(v.observed.select(body.alias("body"))).select("origin", "packet_type", "snr", "payload_type", "route_type", "outcome", F.col("hash").cast("bigint").alias("hash"))


@query("""SELECT seq, CASE k % 6 WHEN 0 THEN 'ORDER' WHEN 1 THEN NULL WHEN 2 THEN 'WARNING' WHEN 3 THEN 'ADVISORY' WHEN 4 THEN 'SHELTER_IN_PLACE' ELSE 'WARNING' END AS evacuation, CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS impact, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS fire_weather,
    CASE WHEN observed_at % 7200 <= 1800 THEN 'fresh' WHEN observed_at % 7200 <= 3600 THEN 'stale' ELSE 'very stale' END AS cache FROM observed""")
def c6_ladders(v: Views) -> DataFrame:
    pick = lambda n, *words: F.element_at(F.array(*map(F.lit, words)), F.col("k") % n + 1)
    return v.observed.select(
        "seq", classify.evacuation_level(pick(6, " Mandatory order ", "Evacuation Order Lifted", "WARNING", "advisory", "Shelter", "Set")).alias("evacuation"), classify.from_road_impact(pick(4, "Severe", " moderate", "LIGHT", "?")).alias("impact"),
        classify.from_fire_weather(pick(3, "red-flag", "ELEVATED", "normal")).alias("fire_weather"), times.freshness(F.col("observed_at") % 7200, 1800).alias("cache"),
    )


@query("""SELECT seq, CASE WHEN k % 3 = 0 THEN 'Planned outage' ELSE 'Power outage' END || CASE WHEN floor(value * 10) > 0 THEN ' — ' || format('{:,}', CAST(floor(value * 10) AS BIGINT)) || CASE WHEN floor(value * 10) = 1 THEN ' customer' ELSE ' customers' END ELSE '' END || ' in ' || event_type AS headline,
    CASE WHEN value < 10 THEN 'within the fire''s extent' ELSE format('{:.1f} km from the fire', floor(value) / 4) END AS near, CASE WHEN k * 600 < 3600 THEN k * 10 || ' min' WHEN k * 600 < 172800 THEN k // 6 || ' h' ELSE k // 144 || ' days' END AS lasted, k % 4 > 1 AS named FROM observed""")
def t11_headlines(v: Views) -> DataFrame:
    near = F.when(F.col("value") < 10, F.lit(0.0)).otherwise(F.floor("value") / F.lit(4.0))
    said = F.element_at(F.array(*map(F.lit, ("Bear Creek Fire Station is open", "the bear creek road", "BEAR CREEK  FIRE grows", "Fire crews at bear creek fire."))), F.col("k") % 4 + 1)
    return v.observed.select("seq", text.outage_headline(F.floor(F.col("value") * 10), F.col("k") % 3 == 0, F.col("event_type")).alias("headline"), text.near_fire(near).alias("near"), text.rough_duration(F.col("k") * 600).alias("lasted"), text.names_fire(said, F.lit("Bear Creek")).alias("named"))


@query("""SELECT name, min(acres) AS n FROM (SELECT 'fire ' || user_id % 30 AS name, CAST(count(*) AS BIGINT) AS acres FROM observed WHERE event_type = 'error' GROUP BY user_id % 30, event_type) WHERE name IN (SELECT 'fire ' || user_id % 45 FROM observed WHERE event_type = 'purchase' GROUP BY user_id % 45 HAVING count(DISTINCT user_id) <= 3) GROUP BY name""")
def j12_fire_perimeters(v: Views) -> DataFrame:
    """Incidents joined to perimeters on the fire's plain name, where few perimeters have it."""
    a = v.observed.where("event_type = 'error'").select(F.concat(F.lit("Fire "), F.col("user_id") % 30).alias("name"))
    b = v.observed.where("event_type = 'purchase'").select(F.concat(F.lit("FIRE "), F.col("user_id") % 45, F.lit(" Fire")).alias("name"), "user_id")
    one = b.groupBy(text.fire_key(F.col("name")).alias("k")).agg(F.countDistinct("user_id").alias("u")).where("u <= 3").select("k")
    rows = a.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n")).withColumn("k", text.fire_key(F.col("name")))
    return rows.join(one, "k", "left_semi").select("name", "n")


@query("""SELECT source_id, name, poll_seconds, first_at FROM (SELECT source_id, name || '!' AS name, poll_seconds, CAST(NULL AS BIGINT) AS first_at FROM sources WHERE source_id % 2 = 0 AND source_id NOT IN (SELECT source_id FROM attempts WHERE source_id % 3 = 0)
    UNION ALL SELECT source_id, CASE WHEN source_id % 2 = 0 THEN any_value(name) || '!' ELSE any_value(name) END, any_value(poll_seconds), min(sampled_at) FROM attempts JOIN sources USING (source_id) WHERE source_id % 3 = 0 GROUP BY source_id)""")
def w18_seeded_sources(v: Views) -> DataFrame:
    """Configured columns from the seed, runtime columns from the store, rows of either side."""
    stored = v.attempts.where("source_id % 3 = 0").groupBy("source_id").agg(F.min("sampled_at").alias("first_at")).join(v.sources, "source_id")
    seeds = v.sources.where("source_id % 2 = 0").withColumn("name", F.concat("name", F.lit("!")))
    return state.seeded(seeds, stored, ["name", "poll_seconds"], ["first_at"])


@query("""SELECT count(*) AS n, CAST(sum(CASE WHEN why = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error, CAST(sum(CASE WHEN why = 'truncated' THEN 1 ELSE 0 END) AS BIGINT) AS truncated, CAST(sum(CASE WHEN why = 'empty' THEN 1 ELSE 0 END) AS BIGINT) AS "empty" FROM (SELECT CASE k % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'truncated' WHEN 2 THEN 'truncated' WHEN 3 THEN 'empty' WHEN 4 THEN 'unreadable' END AS why FROM observed)""")
def s8_envelopes(v: Views) -> DataFrame:
    """Bodies that must not be used, and why."""
    body = F.element_at(F.array(*map(F.lit, ('{"error":{"code":400}}', '{"features":[1],"exceededTransferLimit":true}', '{"features":[1],"properties":{"exceededTransferLimit":true}}', '{"features":[]}', "<html>", '{"features":[1]}', '{"features":[1],"exceededTransferLimit":false}'))), F.col("k") % 7 + 1)
    r = feeds.envelope(v.observed.select(body.alias("body")))
    return r.agg(F.count("*").alias("n"), *(F.count_if(F.col("rejected") == w).alias(w) for w in ("error", "truncated", "empty")))


@query("""SELECT l.a, l.b, CAST(count(*) AS BIGINT) AS n FROM (SELECT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT unnest([pubkey] || path_nodes[:-2]) AS x, unnest(path_nodes) AS y FROM mesh_observations) WHERE x <> '' AND y <> '' AND x <> y) l
    JOIN (SELECT 's' || s_suppkey AS node, s_nationkey FROM supplier) p ON l.a = p.node JOIN (SELECT 's' || s_suppkey AS node, s_nationkey FROM supplier) q ON l.b = q.node WHERE p.s_nationkey < 5 OR q.s_nationkey < 5 GROUP BY ALL""")
def j14_region_links(v: Views) -> DataFrame:
    """Links whose two ends have a place, one of them in the region."""
    from tideway.operators import mesh

    node = v.table("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), "s_nationkey")
    l = mesh.edges(v.mesh_observations).groupBy("a", "b").agg(F.count("*").alias("n"))
    rows = l.join(node.select(F.col("node").alias("a"), F.col("s_nationkey").alias("pa")), "a").join(node.select(F.col("node").alias("b"), F.col("s_nationkey").alias("pb")), "b")
    return rows.where("pa < 5 OR pb < 5").select("a", "b", "n")


@query("""SELECT id, seq, CASE WHEN best AND d > 10 THEN NULL ELSE CASE WHEN d <= 10 THEN 'ON_ROUTE' ELSE 'NEARBY' END END AS class FROM (SELECT id, seq, k AS d, bool_or(k <= 10) OVER (PARTITION BY id) AS best FROM observed WHERE k <= 50) WHERE NOT (best AND d > 10)""")
def j19_nearby_suppressed(v: Views) -> DataFrame:
    """An alert that is on a route somewhere is told as nearby nowhere."""
    r = v.observed.where("k <= 50").select("id", "seq", F.when(F.col("k") <= 10, "ON_ROUTE").otherwise("NEARBY").alias("class"))
    on = F.bool_or(F.col("class") == "ON_ROUTE").over(Window.partitionBy("id"))
    return r.withColumn("on", on).where("class = 'ON_ROUTE' OR NOT on").drop("on")


@query("""SELECT seq, round(metres, 2) AS metres FROM (SELECT seq, sqrt(pow((lng - -122) * 111320.0 * cos(radians(lat)), 2) + pow((lat - least(38.0, greatest(36.0, lat))) * 111320.0, 2)) AS metres FROM observed)""")
def g12_line_distance(v: Views) -> DataFrame:
    """Metres to a line that runs north."""
    line = F.array(F.array(F.lit(-122.0), F.lit(36.0)), F.array(F.lit(-122.0), F.lit(37.0)), F.array(F.lit(-122.0), F.lit(38.0)))
    return v.observed.select("seq", F.round(geo.line_metres(F.col("lat"), F.col("lng"), line), 2).alias("metres"))
