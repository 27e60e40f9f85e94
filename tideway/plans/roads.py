"""Roads: alerts by their distance to routes, chain controls, conditions and what they make of a road."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import classify, geo, kernel, text
from tideway.operators import roads, spatial, state
from tideway.plans.adapters import Views
from tideway.plans.events import pick
from tideway.plans.queries import DAY, T0
from tideway.plans.registry import query
from tideway.plans.streams import keeper
from tideway.sources import normalize

HAVERSINE = "2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h))"


def routes(v: Views) -> DataFrame:
    """25 routes that run north, one for each nation, with a corner at each degree."""
    n = F.col("n_nationkey")
    line = F.transform(F.sequence(F.lit(35), F.lit(40)), lambda y: F.array(F.round(-124 + n * 0.2, 1), y.cast("double")))
    return v.table("nation").select(n.alias("route_id"), F.concat(F.lit("Hwy "), n % 5).alias("name"), line.alias("line"))


def alerts(v: Views) -> DataFrame:
    """Current road and weather events as alerts; every other one is a line to the east."""
    c = F.col
    line = F.array(F.array("lng", "lat"), F.array(F.round(c("lng") + 0.01, 4), "lat"))
    shape = F.when(c("k") % 2 == 0, geo.point_json(c("lat"), c("lng"))).otherwise(geo.line_json(line))
    return v.current.where("layer IN (1, 4, 5)").select(c("seq").alias("alert_id"), shape.alias("geojson"), "severity", "k", "user_id")


_CLASSES = """r AS (SELECT n_nationkey AS route_id, round(-124 + n_nationkey * 0.2, 1) AS x FROM nation), v AS (SELECT seq AS alert_id, lat, lng, severity, k, user_id FROM current_events WHERE layer IN (1, 4, 5) UNION ALL SELECT seq, lat, round(lng + 0.01, 4), severity, k, user_id FROM current_events WHERE layer IN (1, 4, 5) AND k % 2 = 1),
    m AS (SELECT alert_id, route_id, any_value(severity) AS severity, any_value(k) AS k, min(abs(lng - x) * 111320.0 * cos(radians(lat))) AS metres FROM v, r GROUP BY ALL), c AS (SELECT *, CASE WHEN metres <= 100 THEN 'ON_ROUTE' ELSE 'NEARBY' END AS class FROM m WHERE metres <= 5000)"""


@query(f"WITH {_CLASSES} SELECT alert_id, route_id, round(metres, 1) AS metres, class FROM c")
def j18_route_alerts(v: Views) -> DataFrame:
    """Alerts on a route or near it, lines by their nearest corner."""
    return roads.classified(alerts(v), routes(v), v.tree(roads.CELL)).withColumn("metres", F.round("metres", 1))


@query(f"WITH {_CLASSES} SELECT alert_id, route_id, class FROM (SELECT *, bool_or(class = 'ON_ROUTE') OVER (PARTITION BY alert_id) AS here FROM c) WHERE class = 'ON_ROUTE' OR NOT here")
def j19_suppressed_alerts(v: Views) -> DataFrame:
    return roads.nearby_suppressed(roads.classified(alerts(v), routes(v), v.tree(roads.CELL))).select("alert_id", "route_id", "class")


@query("""WITH r AS (SELECT round(-124 + n_nationkey * 0.2, 1) AS x, y FROM nation, (SELECT unnest(range(35, 41)) AS y)), p AS (SELECT seq AS point_id, lat, lng FROM current_events WHERE layer = 2)
    SELECT DISTINCT point_id FROM (SELECT point_id, pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x - lng) / 2), 2) AS h FROM p, r) WHERE 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) <= 20000""")
def j30_points_near_routes(v: Views) -> DataFrame:
    return roads.near_routes(v.current.where("layer = 2").select(F.col("seq").alias("point_id"), "lat", "lng"), routes(v), 20_000, v.tree(roads.CELL)).select("point_id")


@query(f"""WITH {_CLASSES}, s AS (SELECT *, bool_or(class = 'ON_ROUTE') OVER (PARTITION BY alert_id) AS here FROM c), o AS (SELECT route_id, alert_id, CASE WHEN severity >= 3 THEN 'closed' WHEN severity = 2 THEN 'restricted' ELSE 'open' END AS status, CASE WHEN k % 3 > 0 THEN 'Detail ' || alert_id ELSE '' END AS details, CASE k % 10 WHEN 0 THEN 'r2' WHEN 1 THEN 'active_unspecified' ELSE 'none' END AS chain FROM s WHERE class = 'NEARBY' OR here),
    b AS (SELECT route_id, bool_or(status = 'closed') AS shut, bool_or(status = 'restricted') AS slow, arg_max(details, alert_id) FILTER (status = 'closed' AND details <> '') AS w1, arg_min(details, alert_id) FILTER (status = 'restricted' AND details <> '') AS w2, bool_or(chain = 'r2') AS req, bool_or(chain = 'active_unspecified') AS adv, count(*) FILTER (status <> 'open') AS n FROM o GROUP BY route_id),
    t AS (SELECT n_nationkey AS route_id, n_nationkey AS delay FROM nation) SELECT route_id, CASE WHEN shut THEN 'CLOSED' WHEN slow THEN 'RESTRICTED' ELSE 'OPEN' END AS status, CASE WHEN shut THEN coalesce(w1, w2, '') WHEN slow THEN coalesce(w2, '') ELSE '' END AS explanation, CASE WHEN req THEN 'REQUIRED' WHEN adv THEN 'ADVISED' ELSE 'NONE' END AS chain,
    CAST(CASE WHEN shut OR slow THEN n ELSE 0 END AS BIGINT) AS causes, CASE WHEN delay >= 20 THEN 'SEVERE' WHEN delay >= 10 THEN 'HEAVY' WHEN delay >= 5 THEN 'MODERATE' WHEN delay >= 2 THEN 'LIGHT' ELSE 'CLEAR' END AS congestion, CASE WHEN shut THEN 3 WHEN slow THEN 2 WHEN delay >= 10 THEN 2 WHEN delay >= 5 THEN 1 ELSE 0 END AS severity FROM t LEFT JOIN b USING (route_id)""")
def q17_roads(v: Views) -> DataFrame:
    """Every road: its alerts placed, those near it suppressed where they are on another, folded into a status with its explanation, beside its traffic."""
    c = F.col
    placed = roads.nearby_suppressed(roads.classified(alerts(v), routes(v), v.tree(roads.CELL))).join(alerts(v).drop("geojson"), "alert_id")
    causes = placed.select("route_id", c("alert_id").alias("ord"), F.when(c("severity") >= 3, "closed").when(c("severity") == 2, "restricted").otherwise("open").alias("status"), F.when(c("k") % 3 > 0, F.concat(F.lit("Detail "), "alert_id")).otherwise("").alias("details"), F.when(c("k") % 10 == 0, "r2").when(c("k") % 10 == 1, "active_unspecified").otherwise("none").alias("chain"))
    nothing = v.spark.createDataFrame([], "route_id bigint, sign_id bigint")
    body = F.to_json(F.struct(F.array(F.struct(F.lit(12_345).alias("distanceMeters"), F.concat(60 * (c("route_id") + 30), F.lit("s")).alias("duration"), F.lit("1800s").alias("staticDuration"))).alias("routes")))
    told = roads.traffic(routes(v).select(c("route_id").alias("road_id"), body.alias("body"))).select(c("road_id").alias("route_id"), "congestion")
    out = roads.folded(routes(v), causes, nothing).join(told, "route_id")
    return out.withColumn("severity", classify.from_road(c("status"), c("congestion")))


@query("""SELECT n_nationkey AS road_id, CAST((60 * n_nationkey + 1800) // 60 AS INT) AS minutes, 30 AS usual_minutes, CAST(n_nationkey AS INT) AS delay, CAST((n_nationkey * 1500 + 400) // 1000 AS INT) AS kilometres, '_p~iF~ps|U_ulLnnqC_mqNvxq`@' AS polyline FROM nation""")
def s23_routes(v: Views) -> DataFrame:
    n = F.col("n_nationkey")
    route = F.struct((n * 1500 + 400).alias("distanceMeters"), F.concat(60 * n + 1800, F.lit(".5s")).alias("duration"), F.lit("1800s").alias("staticDuration"), F.struct(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@").alias("encodedPolyline")).alias("polyline"))
    body = F.to_json(F.struct(F.array(route, route).alias("routes")))
    return roads.traffic(v.table("nation").select(n.alias("road_id"), body.alias("body"))).select("road_id", "minutes", "usual_minutes", "delay", "kilometres", "polyline")


def controls(v: Views) -> DataFrame:
    c = F.col
    return v.current.where("layer IN (1, 2)").select(c("seq").alias("sign_id"), F.concat(F.lit("SR-"), c("k") % 5).alias("highway"), "lat", "lng", (c("k") % 4 == 0).alias("unrecognized"), (c("k") % 7 == 0).alias("closed"))


@query("""WITH r AS (SELECT n_nationkey AS route_id, n_nationkey % 5 AS hw, round(-124 + n_nationkey * 0.2, 1) AS x, y FROM nation, (SELECT unnest(range(35, 41)) AS y)), s AS (SELECT seq AS sign_id, k % 5 AS hw, lat, lng FROM current_events WHERE layer IN (1, 2) AND k % 4 > 0 AND k % 7 > 0),
    d AS (SELECT route_id, sign_id, 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) AS m FROM (SELECT route_id, sign_id, pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x - lng) / 2), 2) AS h FROM r JOIN s USING (hw))) SELECT route_id, arg_min(sign_id, (m, sign_id)) AS sign_id, round(min(m), 0) AS metres FROM d WHERE m < 40000 GROUP BY route_id""")
def j20_route_controls(v: Views) -> DataFrame:
    """The nearest control of a route's own highway."""
    return roads.nearest_control(routes(v), controls(v), 40_000).withColumn("metres", F.round("metres", 0))


def sign_rows(v: Views, kind: str) -> DataFrame:
    """Signs close to each other, about one town."""
    c = F.col
    return v.observed.where(f"event_type = '{kind}'").select(c("seq").alias("sign_id"), pick("Eastbound", "", "westbound").alias("direction"), (F.lit(38.0) + (c("lat") - 35) / 50).alias("lat"), (F.lit(-120.0) + (c("lng") + 124) / 50).alias("lng"), (c("k") % 4 == 0).alias("unrecognized"), (c("k") % 7 == 0).alias("supplement"))


@query("""WITH s AS (SELECT event_type AS t, seq, ['eastbound', '', 'westbound'][k % 3 + 1] AS d, 38.0 + (lat - 35) / 50 AS lat, -120.0 + (lng + 124) / 50 AS lng, k % 4 = 0 AS unr, k % 7 = 0 AS sup FROM observed),
    near AS (SELECT a.seq AS a, b.seq AS b, a.t AS ta, b.t AS tb, a.unr AS ua, b.unr AS ub, a.sup AS sa, b.sup AS sb FROM s a JOIN s b ON abs(a.lat - b.lat) < 0.01 AND abs(a.lng - b.lng) < 0.01 AND (a.d = '' OR b.d = '' OR a.d = b.d) AND a.t IN ('view', 'click') AND b.t IN ('click', 'error', 'view')
    AND 2 * 6371000.0 * atan2(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)), sqrt(1 - (pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 200),
    gone AS (SELECT DISTINCT a FROM near WHERE ta = 'view' AND NOT sa AND tb = 'click' AND NOT ub), stays AS (SELECT seq, sup FROM s WHERE t = 'view' AND seq NOT IN (SELECT a FROM gone)), explained AS (SELECT DISTINCT a FROM near WHERE ta = 'click' AND ua AND tb = 'view' AND b IN (SELECT seq FROM stays)),
    quiet AS (SELECT DISTINCT a FROM near WHERE ta = 'view' AND NOT sa AND tb = 'error') SELECT seq AS sign_id, false AS uncorroborated FROM s WHERE t = 'click' AND seq NOT IN (SELECT a FROM explained) UNION ALL SELECT seq, NOT sup AND seq IN (SELECT a FROM quiet) FROM stays""")
def j21_merged_controls(v: Views) -> DataFrame:
    """Chain controls of checkpoints and of told signs: what both say counts once, what neither can vouch for is marked."""
    return roads.merged_controls(sign_rows(v, "click"), sign_rows(v, "error"), sign_rows(v, "view")).select("sign_id", "uncorroborated")


_SIGNS = """SELECT seq AS sign_id, user_id % 4 AS road, k % 3 + 1 AS level, ['eastbound', 'westbound', '', 'northbound'][k % 4 + 1] AS d, CASE WHEN k % 3 > 0 THEN CAST(k AS DOUBLE) END AS mp, lat, lng FROM current_events WHERE layer = """


@query(f"""WITH RECURSIVE a AS ({_SIGNS}2), m AS (SELECT sign_id, road, mp, d <> 'westbound' AS up FROM a WHERE mp IS NOT NULL AND d <> '' UNION ALL SELECT NULL, road, mp, d <> 'westbound' FROM ({_SIGNS}5) WHERE mp IS NOT NULL AND d <> ''),
    w AS (SELECT *, lag(mp) OVER o AS before, lead(mp) OVER o AS after, min(mp) OVER (PARTITION BY road) AS low, max(mp) OVER (PARTITION BY road) AS high FROM m WINDOW o AS (PARTITION BY road, up ORDER BY mp, sign_id NULLS LAST)), s AS (SELECT sign_id, CASE WHEN up THEN mp ELSE coalesce(before, low) END AS lo, CASE WHEN up THEN coalesce(after, high) ELSE mp END AS hi FROM w WHERE sign_id IS NOT NULL),
    x AS (SELECT a.*, lo, hi FROM a LEFT JOIN s USING (sign_id)), e AS (SELECT p.sign_id AS a, q.sign_id AS b FROM x p JOIN x q ON p.road = q.road AND p.level = q.level AND p.sign_id <> q.sign_id AND CASE WHEN p.lo IS NOT NULL AND q.lo IS NOT NULL THEN p.lo <= q.hi + 1.5 AND q.lo <= p.hi + 1.5
    ELSE 2 * 6371000.0 * asin(sqrt(pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lng - p.lng) / 2), 2))) <= 15000 END), g AS (SELECT sign_id AS node, sign_id AS root FROM a UNION SELECT e.b, g.root FROM g JOIN e ON e.a = g.node) SELECT node AS sign_id, min(root) AS stretch FROM g GROUP BY node""")
def a18_chain_stretches(v: Views) -> DataFrame:
    """Chain signs of one highway and level whose extents touch are one stretch."""
    c = F.col
    rows = lambda layer: v.current.where(f"layer = {layer}").select(c("seq").alias("sign_id"), F.concat(F.lit("Highway "), c("user_id") % 4).alias("highway"), F.concat(F.lit("R"), c("k") % 3 + 1).alias("level"), pick("Eastbound", "Westbound", "", "Northbound").alias("direction"), F.when(c("k") % 3 > 0, c("k").cast("double")).alias("milepost"), "lat", "lng")
    return roads.stretches(rows(2), rows(5), keeper(v.spark))


@query("""SELECT seq AS sign_id, ['Eastbound', 'Westbound', ''][k % 3 + 1] AS direction, 'Highway ' || user_id AS highway, CASE WHEN k % 4 < 3 THEN 'R' || k % 4 + 1 END AS level, k % 4 = 3 AS closed, 'At mile ' || k AS place, CAST(epoch(timezone('America/Los_Angeles', date_trunc('minute', make_timestamp(observed_at * 1000000)))) AS BIGINT) AS effective, '10' AS district, CAST(k AS VARCHAR) AS message_id FROM observed WHERE event_type = 'click'""")
def s14_chain_signs(v: Views) -> DataFrame:
    """What chain-control placemarks say in their names and markup."""
    c, n = F.col, F.col("k") % 4
    facing = pick("Eastbound ", "Westbound ", "")
    name = F.concat(facing, F.lit("Highway "), "user_id", F.when(n == 3, " Road Closed").when(n == 2, " Chain Control").otherwise(F.concat(F.lit(" Chain Control R-"), n + 1)))
    when = F.date_format(F.timestamp_seconds("observed_at"), "M/d/yyyy HH:mm")
    html = F.concat(F.lit('<p class="iw-text"><strong> Location: </strong> At mile '), "k", F.lit("</p>"), F.when(n == 2, '<p class="iw-text">Chain Control level R-3 </p>').otherwise(""), F.lit("<p>Effective from: "), when, F.lit("</p><p>District: 10 Message ID: "), "k", F.lit("</p>"))
    rows = v.observed.where("event_type = 'click'").select("seq", name.alias("name"), html.alias("description"), text.html_text(html).alias("text"), F.lit("#x").alias("styleUrl"), c("seq").cast("double").alias("lat"), "lng")
    return roads.signs(rows).select(c("lat").cast("bigint").alias("sign_id"), "direction", "highway", "level", "closed", "place", "effective", "district", "message_id")


@query("""SELECT o.seq AS condition_id, n_nationkey AS section_id FROM observed o JOIN nation ON o.user_id % 3 = n_nationkey % 3 AND (contains(['is closed near arnold', 'chains required at bear valley', 'one-way traffic in murphys', 'nothing of note'][k % 4 + 1], ['arnold', 'murphys'][n_nationkey % 2 + 1]) OR contains(['is closed near arnold', 'chains required at bear valley', 'one-way traffic in murphys', 'nothing of note'][k % 4 + 1], ['bear valley', 'angels camp'][n_nationkey % 2 + 1]) OR (n_nationkey = 7 AND contains(['is closed near arnold', 'chains required at bear valley', 'one-way traffic in murphys', 'nothing of note'][k % 4 + 1], 'note'))) WHERE event_type = 'error'""")
def j26_condition_sections(v: Views) -> DataFrame:
    """Conditions and the road sections whose places or keywords they name."""
    c = F.col
    conditions = v.observed.where("event_type = 'error'").select(c("seq").alias("condition_id"), (c("user_id") % 3).alias("highway"), pick("Is closed near ARNOLD", "Chains required at Bear Valley", "One-way traffic in Murphys", "Nothing of note").alias("text"))
    n = c("n_nationkey")
    sections = v.table("nation").select(n.alias("section_id"), (n % 3).alias("highway"), F.when(n % 2 == 0, "Arnold to Bear Valley").otherwise("Murphys - Angels Camp").alias("section"), F.when(n == 7, F.array(F.lit("Note"))).alias("keywords"))
    return roads.matched_conditions(conditions, sections)


@query(f"""SELECT road, sampled_at, status, minutes FROM (SELECT road, sampled_at, status, minutes FROM road_samples QUALIFY row_number() OVER (PARTITION BY road, sampled_at ORDER BY seq) = 1) UNION ALL SELECT n_nationkey, {T0 + 60 * DAY}, CASE n_nationkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END, CAST(n_nationkey AS INT) FROM nation""")
def m9_road_sampling(v: Views) -> DataFrame:
    """A new sample of every road after those that are stored."""
    n = F.col("n_nationkey")
    stored = state.first_of(v.road_samples, ["road", "sampled_at"], ["seq"]).select("road", "sampled_at", "status", "minutes")
    now = v.table("nation").select(n.cast("bigint").alias("road"), F.element_at(F.array(*map(F.lit, ("OPEN", "RESTRICTED", "CLOSED"))), (n % 3 + 1).cast("int")).alias("status"), n.cast("int").alias("minutes"))
    return state.insert_or_ignore(stored, roads.samples(now, T0 + 60 * DAY), ["road", "sampled_at"], ["minutes"])


@query("""SELECT 'chp:24' || lpad(CAST(k AS VARCHAR), 4, '0') || 'ST0001' AS id, round(arg_min(lat, (lat, lng)), 3) AS lat, CAST(count(*) AS BIGINT) AS reports FROM observed WHERE event_type = 'error' AND lat BETWEEN 36 AND 39 AND lng BETWEEN -123 AND -120 GROUP BY k""")
def q18_incidents(v: Views) -> DataFrame:
    """The incidents of an area: those in its box, the south-west report of each, and how many reports there were."""
    c = F.col
    rows = v.observed.where("event_type = 'error'").where(geo.boxes_meet((c("lat"), c("lng"), c("lat"), c("lng")), tuple(map(F.lit, (36.0, -123.0, 39.0, -120.0)))))
    rows = rows.select(F.concat(F.lit("24"), F.lpad(c("k").cast("string"), 4, "0"), F.lit("ST0001")).alias("log_number"), F.lit(None).cast("string").alias("closure_id"), F.lit("n").alias("name"), F.lit("t").alias("text"), F.lit("Traffic Hazard").alias("first_line"), F.lit("").alias("second_line"), "lat", "lng", F.array().cast("array<struct<number:int,stamp:string,text:string>>").alias("log"))
    n = rows.groupBy(F.concat(F.lit("chp:"), "log_number").alias("id")).agg(F.count("*").alias("reports"))
    return normalize.road_incidents(rows).join(n, "id").select("id", F.round(geo.box(c("geojson"))[0], 3).alias("lat"), "reports")


@query("""SELECT seq, ['CRITICAL', 'WARNING', 'INFO', 'WARNING'][k % 4 + 1] AS step, CASE k % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' WHEN 2 THEN 'INFO' WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 'CRITICAL' ELSE 'INFO' END ELSE 'INFO' END AS alert, CASE WHEN k >= 20 THEN 'SEVERE' WHEN k >= 10 THEN 'HEAVY' WHEN k >= 5 THEN 'MODERATE' WHEN k >= 2 THEN 'LIGHT' ELSE 'CLEAR' END AS congestion,
    CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE CASE WHEN k >= 10 THEN 2 WHEN k >= 5 THEN 1 ELSE 0 END END AS road, ['snow', 'winter_closure', ''][k % 3 + 1] AS reason FROM observed""")
def c9_road_severities(v: Views) -> DataFrame:
    c, n = F.col, F.col("k") % 5
    impact = F.when(n == 0, "severe").when(n == 1, "light").when(n == 2, "none")
    busy = classify.congestion(c("k"))
    return v.observed.select(
        "seq", classify.incident_step(pick("Car Fire", "Traffic Hazard", "Assist CT with Maintenance", "Other"), F.lit("")).alias("step"), classify.alert_step(impact, (n == 3) & (c("k") % 2 == 0), F.when(n == 3, "needs assistance").otherwise("debris"), n == 4).alias("alert"), busy.alias("congestion"),
        classify.from_road(pick("CLOSED", "RESTRICTED", "OPEN"), busy).alias("road"), classify.condition_reason(pick("Closed due to SNOW", "Winter closure in effect", "Closed")).alias("reason"),
    )


def decoded(polyline):
    """(lat, lng) points of an encoded polyline."""
    return F.pandas_udf(lambda p: p.map(lambda x: [list(y) for y in kernel.decoded(x or "")]), "array<array<double>>")(polyline)


@query("""SELECT seq, CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END AS points, CAST(CASE WHEN k % 2 = 0 THEN 43.252 ELSE 38.5 END AS DOUBLE) AS last_lat, CAST(CASE WHEN k % 2 = 0 THEN -126.453 ELSE -120.2 END AS DOUBLE) AS last_lng FROM observed WHERE event_type = 'view'""")
def g14_decoded_lines(v: Views) -> DataFrame:
    rows = v.observed.where("event_type = 'view'").select("seq", decoded(F.when(F.col("k") % 2 == 0, "_p~iF~ps|U_ulLnnqC_mqNvxq`@").otherwise("_p~iF~ps|U")).alias("p"))
    last = F.element_at("p", -1)
    return rows.select("seq", F.size("p").alias("points"), last[0].alias("last_lat"), last[1].alias("last_lng"))


@query("""SELECT seq, round(6371.0 * radians(lat - 35), 1) AS along_km, round(abs(lng + 122) * 111320.0 * cos(radians(lat)), 0) AS off FROM observed WHERE event_type = 'view'""")
def g15_along_paths(v: Views) -> DataFrame:
    """How far along a line that runs north a point lies, and how far off it."""
    line = np.array([[35.0, -122.0], [36.0, -122.0], [38.5, -122.0], [40.0, -122.0]])

    @F.pandas_udf("km double, off double")
    def along(lat: pd.Series, lng: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernel.along(line, a, b) for a, b in zip(lat, lng, strict=True)], columns=["km", "off"])

    rows = v.observed.where("event_type = 'view'").select("seq", along("lat", "lng").alias("a"))
    return rows.select("seq", F.col("a.km").alias("along_km"), F.round("a.off", 0).alias("off"))


@query("""SELECT seq, greatest(0, least(lat + 1, 40) - greatest(lat, 38)) > 0.5005 AS shared FROM observed WHERE event_type = 'signup'""")
def g13_shared_lines(v: Views) -> DataFrame:
    """Whether more than half of a line lies along another."""
    other = np.array([[38.0, -122.0], [40.0, -122.0]])

    @F.pandas_udf("double")
    def share(lat: pd.Series) -> pd.Series:
        return lat.map(lambda y: kernel.shared_part(np.array([[y, -122.0], [y + 1, -122.0]]), other, 50.0, 50.0))

    return v.observed.where("event_type = 'signup'").select("seq", (share("lat") > 0.5005).alias("shared"))


@query("""WITH e AS (SELECT id, lat, lng, 0.05 * (1 + k % 4) / 2 AS h FROM current_events WHERE layer IN (2, 3)), b AS (SELECT id, place_id, greatest(0, least(lat + h, max_lat) - greatest(lat - h, min_lat)) * greatest(0, least(lng + h, max_lng) - greatest(lng - h, min_lng)) / least(4 * h * h, 1) AS share FROM e, places) SELECT id, place_id FROM b WHERE share >= 0.0203""")
def g7_overlapping_shapes(v: Views) -> DataFrame:
    """Event shapes that cover, or are covered by, at least two per cent of a place's."""
    from tideway.plans.shapes import event_shapes, place_shapes

    return spatial.shapes_meet(event_shapes(v), place_shapes(v), 0.0203, v.tree(spatial.CELL)).select("a.id", "b.place_id")


@query("""SELECT seq, CASE WHEN k % 4 < 3 THEN 'MultiPolygon' END AS kind, CASE k % 4 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 4 END AS points FROM observed WHERE event_type = 'signup'""")
def g16_valid_shapes(v: Views) -> DataFrame:
    """Shapes made plain: superfluous points go, a ring that crosses itself from the start stays as it is, one of fewer than four points goes."""
    c = F.col
    p = lambda dx, dy: F.array(F.round(c("lng") + dx, 4), F.round(c("lat") + dy, 4))
    plain = F.array(p(0, 0), p(0.1, 0), p(0.2, 0), p(0.2, 0.2), p(0, 0.2), p(0, 0))
    bow = F.array(p(0, 0), p(0.2, 0.2), p(0.2, 0), p(0, 0.2), p(0, 0))
    thin = F.array(p(0, 0), p(0.1, 0.00001), p(0.2, 0), p(0, 0))
    rings = F.when(c("k") % 4 == 0, plain).when(c("k") % 4 == 1, bow).when(c("k") % 4 == 2, thin).otherwise(F.array(p(0, 0), p(0.1, 0), p(0, 0)))

    @F.pandas_udf("string")
    def valid(g: pd.Series) -> pd.Series:
        return g.map(lambda x: kernel.valid_shape(kernel.shape(x), 0.001))

    rows = v.observed.where("event_type = 'signup'").select("seq", valid(F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(rings).alias("coordinates")))).alias("g"))
    return rows.select("seq", F.get_json_object("g", "$.type").alias("kind"), F.when(c("g").isNotNull(), F.size(geo.vertices(c("g")))).alias("points"))


@query("""SELECT seq, round(sqrt(pow((lng + 122) * 111320.0 * cos(radians((lat + 37) / 2)), 2) + pow((lat - 37) * 111320.0, 2)), 1) AS metres, sqrt(pow((lng + 122) * 111320.0 * cos(radians(lat)), 2) + pow((lat - least(38.0, greatest(36.0, lat))) * 111320.0, 2)) <= 30000 AS near, 'LineString' AS line, 'Polygon' AS box FROM observed""")
def g9_distances_and_encoders(v: Views) -> DataFrame:
    """Flat metres between points, nearness to a line, and the encoders of lines and boxes."""
    c = F.col
    line = F.array(F.array(F.lit(-122.0), F.lit(36.0)), F.array(F.lit(-122.0), F.lit(38.0)))
    kind = lambda g: F.get_json_object(g, "$.type")
    return v.observed.select("seq", F.round(geo.metres_between(c("lat"), c("lng"), F.lit(37.0), F.lit(-122.0)), 1).alias("metres"), geo.near_line(c("lat"), c("lng"), line, 30_000).alias("near"), kind(geo.line_json(F.array(F.array("lng", "lat"), F.array("lng", "lat")))).alias("line"), kind(geo.box_json((c("lat"), c("lng"), c("lat"), c("lng")))).alias("box"))


@query("""WITH s AS (SELECT road, sampled_at, seq, status, first_value(status) OVER (PARTITION BY road ORDER BY sampled_at DESC, seq DESC) AS latest FROM road_samples) SELECT road, max(sampled_at) AS last_other FROM (SELECT * FROM s WHERE status < latest UNION ALL SELECT * FROM s WHERE status > latest) GROUP BY road""")
def u1_other_status(v: Views) -> DataFrame:
    """When a road last had another status than now: below it or above it, which is one range less than all."""
    w = Window.partitionBy("road")
    rows = v.road_samples.withColumn("latest", F.max_by("status", F.struct("sampled_at", "seq")).over(w))
    return rows.where("status < latest").unionByName(rows.where("status > latest")).groupBy("road").agg(F.max("sampled_at").alias("last_other"))
