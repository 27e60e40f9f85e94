"""Composites: place summaries, layer features, merges of sources, folds of alerts and nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import classify, geo, text, times
from tideway.operators import mesh, placing, serving, spatial, state
from tideway.plans.adapters import Views
from tideway.plans.queries import DAY, T0
from tideway.plans.registry import query
from tideway.plans.streams import keeper
from tideway.sources import normalize


@query("""SELECT seq, status FROM current_events WHERE id = 'error:3'""")
def q2_event(v: Views) -> DataFrame:
    return v.current.where("id = 'error:3'").select("seq", "status")


@query("""WITH x AS (SELECT place_id, c.* FROM event_places JOIN current_events c USING (id) WHERE status = 'ACTIVE'), t AS (SELECT place_id, list(id ORDER BY severity DESC, observed_at DESC, id)[1:5] AS top FROM x WHERE NOT (layer = 4 AND severity = 0) GROUP BY place_id),
    s AS (SELECT place_id, CAST(count(*) AS BIGINT) AS active, max(severity) AS highest, CAST(count(*) FILTER (layer = 3) AS BIGINT) AS orders FROM x GROUP BY place_id), h AS (SELECT s.layer, bool_and(a.ok) AS ok FROM (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY sampled_at DESC, seq DESC) = 1) a JOIN sources s USING (source_id) GROUP BY s.layer)
    SELECT p.place_id, coalesce(active, 0) AS active, coalesce(highest, 0) AS highest, CASE WHEN coalesce(orders, 0) > 0 THEN orders WHEN (SELECT ok FROM h WHERE layer = 3) THEN 0 END AS evacuations, coalesce(top, []) AS top FROM places p LEFT JOIN s USING (place_id) LEFT JOIN t USING (place_id)""")
def q8_place_summary(v: Views) -> DataFrame:
    """Each place's active events, its top five, and evacuations: null when the source is not known to be well, 0 when it is."""
    rows = v.placed.where("status = 'ACTIVE'").select("id", "layer", "severity", "observed_at", "place_id")
    counts = rows.groupBy("place_id").agg(F.count("*").alias("active"), F.max("severity").alias("highest"), F.count_if(F.col("layer") == 3).alias("orders"))
    w = Window.partitionBy("place_id").orderBy(F.desc("severity"), F.desc("observed_at"), "id")
    top = rows.where("NOT (layer = 4 AND severity = 0)").withColumn("n", F.row_number().over(w)).where("n <= 5")
    top = top.groupBy("place_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("top"))
    well = state.latest(v.attempts, "source_id", ["sampled_at", "seq"]).join(v.sources, "source_id").where("layer = 3").agg(F.bool_and("ok").alias("well"))  # one row
    out = v.places.select("place_id").join(counts, "place_id", "left").join(top, "place_id", "left").crossJoin(F.broadcast(well))
    known = F.when(F.coalesce("orders", F.lit(0)) > 0, F.col("orders")).when(F.col("well"), F.lit(0).cast("bigint"))
    return out.select("place_id", F.coalesce("active", F.lit(0)).alias("active"), F.coalesce("highest", F.lit(0)).alias("highest"), known.alias("evacuations"), F.coalesce("top", F.array().cast("array<string>")).alias("top"))


@query("""SELECT s.source_id, s.name, 3 * s.poll_seconds AS stale_after, max(CASE WHEN ok THEN sampled_at END) AS last_success, CAST(count(a.seq) AS BIGINT) AS attempts FROM sources s LEFT JOIN attempts a USING (source_id) GROUP BY ALL""")
def q10_sources(v: Views) -> DataFrame:
    by = v.attempts.groupBy("source_id").agg(F.max(F.when(F.col("ok"), F.col("sampled_at"))).alias("last_success"), F.count("*").alias("attempts"))
    return v.sources.join(by, "source_id", "left").select("source_id", "name", (3 * F.col("poll_seconds")).alias("stale_after"), "last_success", F.coalesce("attempts", F.lit(0)).alias("attempts"))


@query(f"SELECT road, sampled_at, status, minutes FROM road_samples WHERE road = 3 AND sampled_at >= {T0 + 2 * DAY} AND sampled_at < {T0 + 9 * DAY} ORDER BY sampled_at, seq")
def o8_road_history(v: Views) -> DataFrame:
    return v.road_samples.where((F.col("road") == 3) & (F.col("sampled_at") >= T0 + 2 * DAY) & (F.col("sampled_at") < T0 + 9 * DAY)).orderBy("sampled_at", "seq").select("road", "sampled_at", "status", "minutes")


@query(f"SELECT node, reported_at, battery, count(*) OVER () > 400 AS truncated FROM (SELECT * FROM telemetry WHERE reported_at >= {T0} AND reported_at < {T0 + 20 * DAY} ORDER BY reported_at, seq LIMIT 401) ORDER BY reported_at, seq LIMIT 400")
def o7_telemetry_series(v: Views) -> DataFrame:
    """A series up to a limit, and whether there was more."""
    rows = v.telemetry.where((F.col("reported_at") >= T0) & (F.col("reported_at") < T0 + 20 * DAY)).orderBy("reported_at", "seq").limit(401)
    more = rows.withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(1))) > 400)  # at most 401 rows
    return more.orderBy("reported_at", "seq").limit(400).select("node", "reported_at", "battery", "truncated")


@query("""SELECT place_id, layer, '{"type":"FeatureCollection","n":' || count(*) || '}' AS body, min(id) AS first_id FROM event_places JOIN current_events USING (id) GROUP BY place_id, layer""")
def w23_feature_collections(v: Views) -> DataFrame:
    """A collection for each place and layer, reduced to its size."""
    feature = F.struct(F.lit("Feature").alias("type"), F.col("id"), F.from_json(geo.point_json(F.col("lat"), F.col("lng")), "type string, coordinates array<double>").alias("geometry"))
    rows = v.placed.groupBy("place_id", "layer").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array_sort(F.collect_list(F.struct("id", feature.alias("f")))).alias("features"))).alias("body"))
    return rows.select("place_id", "layer", F.concat(F.lit('{"type":"'), F.get_json_object("body", "$.type"), F.lit('","n":'), F.json_array_length(F.get_json_object("body", "$.features")), F.lit("}")).alias("body"), F.get_json_object("body", "$.features[0].id").alias("first_id"))


@query("""SELECT id, seq, h1 = h0 AS same FROM (SELECT *, severity || status AS h1, lag(severity || status) OVER (PARTITION BY id ORDER BY observed_at, seq) AS h0 FROM observed)""")
def w1_content_hash(v: Views) -> DataFrame:
    """Whether an observation's content equals the one before it, by hash of what is not volatile."""
    h = state.content_hash("severity", "status")
    w = Window.partitionBy("id").orderBy("observed_at", "seq")
    return v.observed.withColumn("h", h).select("id", "seq", (F.col("h") == F.lag("h").over(w)).alias("same"))


@query("""SELECT o.id, o.seq, c.id IS NOT NULL AND c.severity = o.severity AND c.status = o.status AS unchanged FROM observed o LEFT JOIN current_events c USING (id)""")
def w2_hash_lookup(v: Views) -> DataFrame:
    return state.hash_lookup(v.observed, v.current, "id", "severity", "status").select("id", "seq", "unchanged")


@query("""SELECT obs_id, ord, node, row_number() OVER (ORDER BY obs_id, ord) AS n FROM (SELECT obs_id, unnest(range(1, len(path_nodes) + 1)) AS ord, unnest(path_nodes) AS node FROM mesh_observations)""")
def w10_ordered_append(v: Views) -> DataFrame:
    """Arrays as rows whose numbers ascend with the input."""
    rows = v.mesh_observations.select("obs_id", F.posexplode("path_nodes").alias("p", "node")).select("obs_id", (F.col("p") + 1).cast("bigint").alias("ord"), "node")
    return state.ordered_append(rows, ["obs_id", "ord"], "n", keeper(v.spark))


@query("""SELECT pubkey, heard_at, obs_id FROM (SELECT CASE WHEN pubkey = 'c1' THEN 'c2' ELSE pubkey END AS pubkey, heard_at, obs_id, pubkey <> 'c1' AS own FROM mesh_observations) QUALIFY row_number() OVER (PARTITION BY pubkey, heard_at ORDER BY own DESC, obs_id) = 1""")
def w15_renamed_key(v: Views) -> DataFrame:
    rows = state.first_of(v.mesh_observations.select("pubkey", "heard_at", "obs_id"), ["pubkey", "heard_at"], ["obs_id"])
    return state.rename_key(rows, "pubkey", "c1", "c2", ["heard_at"]).select("pubkey", "heard_at", "obs_id")


@query("""SELECT CAST(count(*) AS BIGINT) AS kept, min(heard_at) AS oldest FROM mesh_observations WHERE NOT (heard_at < 852076800 AND obs_id <= 1000)""")
def w17_prune(v: Views) -> DataFrame:
    """Receptions go when they are old and rolled up; those above the watermark stay."""
    return state.prune(v.mesh_observations, "heard_at", 852076800, "obs_id", 1000).agg(F.count("*").alias("kept"), F.min("heard_at").alias("oldest"))


@query("""SELECT layer, CAST(sum(CASE WHEN revision = 1 THEN 1 ELSE 0 END) AS BIGINT) AS created, CAST(sum(CASE WHEN revision > 1 THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM revisions GROUP BY layer""")
def w22_version_counters(v: Views) -> DataFrame:
    return state.version_counters(v.revisions)


@query("""SELECT seq, CASE WHEN k % 2 = 0 OR (k % 3 <> 0 AND k % 5 IN (1, 2)) OR k % 3 = 0 THEN true ELSE false END AS passes FROM observed""")
def p12_zone_filter(v: Views) -> DataFrame:
    """Alerts of other senders pass; those of the weather service need a common zone, or none on a side."""
    own = F.when(F.col("k") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Z"), F.col("k") % 5)))
    area = F.array(F.lit("Z1"), F.lit("Z2"))
    match = (F.size(own) == 0) | (F.size(area) == 0) | F.arrays_overlap(own, area)
    return v.observed.select("seq", ((F.col("k") % 2 == 0) | match).alias("passes"))


@query("""SELECT min(min_lat) - 0.5 AS min_lat, min(min_lng) - 0.5 AS min_lng, max(max_lat) + 0.5 AS max_lat, max(max_lng) + 0.5 AS max_lng FROM places WHERE kind = 'AREA'""")
def p13_union_bounds(v: Views) -> DataFrame:
    return v.places.where("kind = 'AREA'").agg((F.min("min_lat") - 0.5).alias("min_lat"), (F.min("min_lng") - 0.5).alias("min_lng"), (F.max("max_lat") + 0.5).alias("max_lat"), (F.max("max_lng") + 0.5).alias("max_lng"))


@query("""SELECT id, layer FROM current_events WHERE NOT (layer = 5 OR (layer = 4 AND severity = 0) OR (layer = 2 AND status = 'RESOLVED'))""")
def p14_carve_outs(v: Views) -> DataFrame:
    return v.current.where("NOT (layer = 5 OR (layer = 4 AND severity = 0) OR (layer = 2 AND status = 'RESOLVED'))").select("id", "layer")


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') AND page_id % 2 = 0 THEN url WHEN page_id % 2 = 1 THEN NULL END AS safe, CASE WHEN page_id % 3 = 0 THEN url ELSE 'none' END AS first FROM pages""")
def p19_safe_urls(v: Views) -> DataFrame:
    u = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("javascript:"), "url"))
    first = normalize.filled(F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(" "), F.lit("none"))
    return v.table("pages").select("page_id", normalize.safe_url(u).alias("safe"), first.alias("first"))


@query("""SELECT t.seq, EXISTS (SELECT 1 FROM telemetry s WHERE s.node = t.node AND s.reported_at = t.reported_at AND s.seq % 2 = 0) AS stored FROM telemetry t""")
def j6_exists_flag(v: Views) -> DataFrame:
    """Every sample, and whether the even half that is stored already has its node and time."""
    return state.exists_flag(v.telemetry, v.telemetry.where("seq % 2 = 0"), ["node", "reported_at"], "stored").select("seq", "stored")


@query("""SELECT c.id, count(*) AS others FROM current_events c JOIN current_events d ON c.user_id = d.user_id AND c.id <> d.id WHERE c.layer = 3 GROUP BY c.id""")
def j8_semi_and_pairs(v: Views) -> DataFrame:
    """Events of users that have others, and how many."""
    n = v.current.groupBy("user_id").agg((F.count("*") - 1).alias("others"))
    return v.current.where("layer = 3").join(n, "user_id").where("others > 0").select("id", "others")


@query("""WITH r AS (SELECT place_id, min_lat + 0.5 AS la, min_lng + 0.5 AS ln FROM places), d AS (SELECT c.id, r.place_id, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(c.lat - r.la) / 2), 2) + cos(radians(r.la)) * cos(radians(c.lat)) * pow(sin(radians(c.lng - r.ln) / 2), 2))) AS m FROM current_events c JOIN r ON CAST(c.user_id % 25 AS VARCHAR) = substr(r.place_id, 8) WHERE c.status = 'ACTIVE')
    SELECT place_id, arg_min(id, (m, id)) AS nearest, round(min(m), 0) AS metres FROM d GROUP BY place_id""")
def j20_nearest_control(v: Views) -> DataFrame:
    """The nearest event of each place's own number."""
    p = v.places.select("place_id", F.substring("place_id", 8, 9).cast("bigint").alias("n"), (F.col("min_lat") + 0.5).alias("la"), (F.col("min_lng") + 0.5).alias("ln"))
    rows = v.current.where("status = 'ACTIVE'").select("id", "lat", "lng", (F.col("user_id") % 25).alias("n")).join(p, "n")
    m = geo.haversine(F.col("la"), F.col("ln"), F.col("lat"), F.col("lng"))
    return rows.withColumn("m", m).groupBy("place_id").agg(F.min_by("id", F.struct("m", "id")).alias("nearest"), F.round(F.min("m"), 0).alias("metres"))


@query("""WITH a AS (SELECT seq AS a, user_id, lat, lng FROM observed WHERE event_type = 'click'), b AS (SELECT seq AS b, user_id, lat, lng FROM observed WHERE event_type = 'view'), p AS (SELECT a, b FROM a JOIN b USING (user_id) WHERE sqrt(pow(a.lat - b.lat, 2) + pow(a.lng - b.lng, 2)) < 0.2)
    SELECT a, b FROM (SELECT *, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM p) WHERE na = 1 AND nb = 1""")
def j22_mutual_match(v: Views) -> DataFrame:
    """Pairs in which either side has exactly one candidate."""
    side = lambda kind: v.observed.where(f"event_type = '{kind}'").select("seq", "user_id", "lat", "lng")
    return spatial.mutual_matches(side("click"), side("view"), ["user_id"], 0.2).select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b"))


@query("""SELECT user_id, coalesce(a.value, b.value) AS value, coalesce(a.at_m, 0) AS mqtt, coalesce(b.at_p, 0) AS push FROM (SELECT user_id, max(observed_at) AS at_m, arg_max(value, (observed_at, seq)) AS value FROM observed WHERE event_type = 'click' GROUP BY user_id) a FULL JOIN (SELECT user_id, max(observed_at) AS at_p, arg_max(value, (observed_at, seq)) AS value FROM observed WHERE event_type = 'view' GROUP BY user_id) b USING (user_id)""")
def j29_merged_nodes(v: Views) -> DataFrame:
    """Nodes of two reporters in one row, the first reporter's values preferred."""
    side = lambda kind, n: v.observed.where(f"event_type = '{kind}'").groupBy("user_id").agg(F.max("observed_at").alias(f"at_{n}"), F.max_by("value", F.struct("observed_at", "seq")).alias(f"value_{n}"))
    both = side("click", "m").join(side("view", "p"), "user_id", "full")
    return both.select("user_id", F.coalesce("value_m", "value_p").alias("value"), F.coalesce("at_m", F.lit(0)).alias("mqtt"), F.coalesce("at_p", F.lit(0)).alias("push"))


@query("""SELECT user_id % 40 AS zone, CASE max(CASE severity WHEN 4 THEN 4 WHEN 3 THEN 3 WHEN 2 THEN 2 ELSE 1 END) WHEN 4 THEN 'ORDER' WHEN 3 THEN 'SHELTER_IN_PLACE' WHEN 2 THEN 'WARNING' ELSE 'ADVISORY' END AS level, arg_max(seq, (CASE severity WHEN 4 THEN 4 WHEN 3 THEN 3 WHEN 2 THEN 2 ELSE 1 END, -seq)) AS winner FROM observed GROUP BY 1""")
def a15_highest_level(v: Views) -> DataFrame:
    """Of one zone's rows the highest level; of equals the first in feed order."""
    rank = F.greatest(F.col("severity"), F.lit(1))
    name = classify.ladder((F.col("r") == 4, "ORDER"), (F.col("r") == 3, "SHELTER_IN_PLACE"), (F.col("r") == 2, "WARNING"), otherwise="ADVISORY")
    by = v.observed.groupBy((F.col("user_id") % 40).alias("zone")).agg(F.max(rank).alias("r"), F.max_by("seq", F.struct(rank, -F.col("seq"))).alias("winner"))
    return by.select("zone", name.alias("level"), "winner")


@query("""SELECT user_id AS line_group, CASE WHEN bool_or(k % 10 = 0) THEN 'NO' WHEN bool_or(k % 10 = 1) THEN 'MARGINAL' WHEN count(*) >= 4 THEN 'YES' ELSE 'UNKNOWN' END AS day FROM observed WHERE event_type = 'signup' GROUP BY user_id""")
def a17_burn_day(v: Views) -> DataFrame:
    """Any line's no is a no; a yes needs all lines."""
    r = v.observed.where("event_type = 'signup'")
    any_of = lambda n: F.bool_or(F.col("k") % 10 == n)
    return r.groupBy(F.col("user_id").alias("line_group")).agg(F.when(any_of(0), "NO").when(any_of(1), "MARGINAL").when(F.count("*") >= 4, "YES").otherwise("UNKNOWN").alias("day"))


@query("""SELECT id, arg_min(seq, (lat, lng, seq)) AS seq FROM observed GROUP BY id""")
def a19_southwest_end(v: Views) -> DataFrame:
    return v.observed.groupBy("id").agg(F.min_by("seq", F.struct("lat", "lng", "seq")).alias("seq"))


@query(f"""SELECT node, CASE WHEN max(CASE WHEN battery IS NOT NULL THEN reported_at END) >= {T0 + 30 * DAY} THEN 'REACHABLE' WHEN max(reported_at) >= {T0 + 30 * DAY} THEN 'UNREACHABLE' ELSE 'UNKNOWN' END AS reachability FROM telemetry GROUP BY node""")
def a20_reachability(v: Views) -> DataFrame:
    """By the latest success, or the latest attempt, within a window."""
    ok = F.max(F.when(F.col("battery").isNotNull(), F.col("reported_at")))
    return v.telemetry.groupBy("node").agg(F.when(ok >= T0 + 30 * DAY, "REACHABLE").when(F.max("reported_at") >= T0 + 30 * DAY, "UNREACHABLE").otherwise("UNKNOWN").alias("reachability"))


@query("""SELECT node, arg_max(battery, (reported_at, seq)) FILTER (battery IS NOT NULL) AS battery, arg_min(reporter, (CASE reporter WHEN 'view' THEN 0 ELSE 1 END, reporter)) AS named_by FROM telemetry GROUP BY node""")
def a21_best_report(v: Views) -> DataFrame:
    has = F.when(F.col("battery").isNotNull(), F.struct("reported_at", "seq"))
    rank = F.struct(F.when(F.col("reporter") == "view", 0).otherwise(1), F.col("reporter"))
    return v.telemetry.groupBy("node").agg(F.max_by("battery", has).alias("battery"), F.min_by("reporter", rank).alias("named_by"))


@query(f"""SELECT reporter, node, CASE WHEN {T0 + 31 * DAY} - max(reported_at) <= 43200 THEN 'OK' WHEN {T0 + 31 * DAY} - max(reported_at) <= 172800 THEN 'STALE' ELSE 'DEAD' END AS health FROM telemetry GROUP BY reporter, node""")
def a22_reporter_health(v: Views) -> DataFrame:
    age = T0 + 31 * DAY - F.max("reported_at")
    return v.telemetry.groupBy("reporter", "node").agg(F.when(age <= 43200, "OK").when(age <= 172800, "STALE").otherwise("DEAD").alias("health"))


@query("""SELECT road, CASE WHEN bool_or(status = 3) THEN 'CLOSED' WHEN bool_or(status = 2) THEN 'RESTRICTED' ELSE 'OPEN' END AS status, arg_max(seq, (status, -seq)) AS cause FROM road_samples GROUP BY road""")
def a25_road_fold(v: Views) -> DataFrame:
    """A closure outweighs a restriction; of equals the first explains."""
    r = v.road_samples.groupBy("road")
    return r.agg(F.when(F.bool_or(F.col("status") == 3), "CLOSED").when(F.bool_or(F.col("status") == 2), "RESTRICTED").otherwise("OPEN").alias("status"), F.max_by("seq", F.struct("status", -F.col("seq"))).alias("cause"))


@query("""SELECT user_id AS zone, CASE min(CASE WHEN k < 5 THEN 0 WHEN k < 10 THEN 1 WHEN k < 20 THEN 2 ELSE 3 END) WHEN 0 THEN 'RED_FLAG' WHEN 1 THEN 'RED_FLAG_PENDING' WHEN 2 THEN 'WATCH' ELSE 'NORMAL' END AS state FROM observed WHERE event_type = 'view' GROUP BY user_id""")
def a26_fire_weather(v: Views) -> DataFrame:
    rank = classify.ladder((F.col("k") < 5, 0), (F.col("k") < 10, 1), (F.col("k") < 20, 2), otherwise=3)
    by = v.observed.where("event_type = 'view'").groupBy(F.col("user_id").alias("zone")).agg(F.min(rank).alias("r"))
    return by.select("zone", classify.ladder((F.col("r") == 0, "RED_FLAG"), (F.col("r") == 1, "RED_FLAG_PENDING"), (F.col("r") == 2, "WATCH"), otherwise="NORMAL").alias("state"))


@query("""SELECT coalesce(w.h, g.h) AS hour, g.gust, w.humidity FROM (SELECT observed_at // 3600 AS h, min(value) AS humidity FROM observed WHERE event_type = 'click' GROUP BY 1) w FULL JOIN (SELECT observed_at // 3600 AS h, max(value) AS gust FROM observed WHERE event_type = 'view' GROUP BY 1) g ON w.h = g.h""")
def n9_aligned_hours(v: Views) -> DataFrame:
    """Two hourly series beside each other."""
    side = lambda kind, f, n: v.observed.where(f"event_type = '{kind}'").groupBy(F.floor(F.col("observed_at") / 3600).alias("hour")).agg(f("value").alias(n))
    return side("click", F.min, "humidity").join(side("view", F.max, "gust"), "hour", "full").select("hour", "gust", "humidity")


@query("""SELECT node, seq, reported_at FROM (SELECT *, max(uptime) OVER w AS top, row_number() OVER (PARTITION BY node ORDER BY reported_at, seq) AS n FROM telemetry WINDOW w AS (PARTITION BY node ORDER BY reported_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE n = 1 OR uptime > top""")
def n14_advanced_clocks(v: Views) -> DataFrame:
    """Rows in which a node's clock went beyond all before."""
    w = Window.partitionBy("node").orderBy("reported_at", "seq")
    rows = v.telemetry.withColumns({"top": F.max("uptime").over(w.rowsBetween(Window.unboundedPreceding, -1)), "n": F.row_number().over(w)})
    return rows.where("n = 1 OR uptime > top").select("node", "seq", "reported_at")


@query(f"""SELECT id, CASE WHEN {T0 + 31 * DAY} - observed_at > {5 * DAY} THEN CASE WHEN revision > 3 THEN 'EXPIRED' END ELSE status END AS status FROM current_events WHERE {T0 + 31 * DAY} - observed_at <= {5 * DAY} OR revision > 3""")
def n12_aged_out(v: Views) -> DataFrame:
    """Rows beyond a grace: ended when they were known, left out when not."""
    old = T0 + 31 * DAY - F.col("observed_at") > 5 * DAY
    return v.current.where(~old | (F.col("revision") > 3)).select("id", F.when(old, "EXPIRED").otherwise(F.col("status")).alias("status"))


@query("""SELECT user_id, list_sort(list_distinct(list(event_type) || ['z', 'click'])) AS kinds FROM observed GROUP BY user_id""")
def u3_sorted_union(v: Views) -> DataFrame:
    by = v.observed.groupBy("user_id").agg(F.collect_set("event_type").alias("seen"))
    return by.select("user_id", placing.sorted_union(F.col("seen"), F.array(F.lit("z"), F.lit("click"), F.lit(" "))).alias("kinds"))


@query("""SELECT id, CASE WHEN a AND b THEN 'both' WHEN a THEN 'left' ELSE 'right' END AS side FROM (SELECT id, bool_or(k % 3 = 0) AS a, bool_or(k % 5 = 0) AS b FROM observed GROUP BY id) WHERE a OR b""")
def u4_set_sides(v: Views) -> DataFrame:
    """Difference and intersection of two id sets in one pass."""
    by = v.observed.groupBy("id").agg(F.bool_or(F.col("k") % 3 == 0).alias("a"), F.bool_or(F.col("k") % 5 == 0).alias("b")).where("a OR b")
    return by.select("id", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "left").otherwise("right").alias("side"))


@query("""SELECT seq, upper(status[1]) || lower(status[2:]) AS word, 'nation ' || user_id || ', CA' AS full_name, 'nation ' || user_id AS name, CASE WHEN k % 3 = 0 THEN CAST(k AS VARCHAR) END AS highway, round(round(lat * 100000) / 100000, 5) AS lat FROM observed""")
def t12_words(v: Views) -> DataFrame:
    full = F.concat(F.lit("nation "), "user_id", F.lit(", CA"))
    label = F.when(F.col("k") % 3 == 0, F.concat(F.lit("US-"), "k")).otherwise("Main street")
    return v.observed.select("seq", text.enum_word(F.col("status")).alias("word"), full.alias("full_name"), text.trim_state(full).alias("name"), text.highway_number(label).alias("highway"), times.trimmed_degree(F.col("lat")).alias("lat"))


@query("""SELECT seq, CASE k % 5 WHEN 0 THEN value * 3.6 WHEN 1 THEN (value - 32) * 5 / 9 WHEN 2 THEN value * 0.3048 WHEN 3 THEN value * 25.4 ELSE value END AS metric, least(CASE WHEN status = 'RESOLVED' THEN observed_at ELSE 1800000000 END, coalesce(CASE WHEN k % 2 = 0 THEN observed_at + 50 END, 1800000000)) AS ends FROM observed""")
def d7_units_and_spans(v: Views) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("wmoUnit:m_s-1", "wmoUnit:degF", "[ft_i]", "[in_i]", "percent"))), F.col("k") % 5 + 1)
    now = F.lit(1_800_000_000).cast("bigint")
    return v.observed.select("seq", times.converted(unit, F.col("value")).alias("metric"), F.least(times.span_end(F.col("status"), F.col("observed_at"), F.when(F.col("k") % 2 == 0, F.col("observed_at") + 50), now), now).alias("ends"))


@query("""SELECT a, b, CAST(count(*) AS BIGINT) AS n FROM (SELECT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT unnest([pubkey] || path_nodes[:-2]) AS x, unnest(path_nodes) AS y FROM mesh_observations) WHERE x <> '' AND y <> '' AND x <> y) GROUP BY a, b ORDER BY n DESC, a, b LIMIT 100""")
def q13_busiest_links(v: Views) -> DataFrame:
    return mesh.edges(v.mesh_observations).groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(100)


@query()
def m13_served_layers(v: Views) -> DataFrame:
    """What each layer's cache serves for a request at every observation: what a request finds depends on those before it, so a test holds it against a loop."""
    outcome = F.when(F.col("k") % 7 == 0, "error").when(F.col("k") % 5 == 0, "partial").otherwise("clean")
    return serving.served(v.observed.select(F.col("event_type").alias("key"), F.col("observed_at").alias("at"), "seq", outcome.alias("outcome"), (F.col("k") % 4).alias("n")), 900)
