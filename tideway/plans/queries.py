"""Reads: pages, history, places, totals, series, links, related events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import classify, geo, text, times
from tideway.operators import mesh, paging, series, state
from tideway.plans.adapters import Views
from tideway.plans.registry import query

EVENT_ORDER = [("severity", True), ("observed_at", True), ("id", False)]
EVENT = ["id", "layer", "severity", "status", "observed_at", "revision"]
SHOWN = "id, layer, severity, status, observed_at, revision"
T0 = 1704067200  # 2024-01-01
DAY = 86400


@query(f"SELECT {SHOWN} FROM current_events WHERE status IN ('ACTIVE', 'SCHEDULED') ORDER BY severity DESC, observed_at DESC, id LIMIT 51")
def q1_events_page(v: Views) -> DataFrame:
    """The first page of current events and the probe row; keys are chosen on narrow columns."""
    return paging.page(v.current.where(F.col("status").isin("ACTIVE", "SCHEDULED")).select(*EVENT), EVENT_ORDER)


@query(f"""SELECT {SHOWN} FROM current_events WHERE severity >= 1 AND layer IN (1, 2, 5) AND observed_at >= {T0 + 5 * DAY}
    AND (severity < 3 OR (severity = 3 AND observed_at < {T0 + 20 * DAY}) OR (severity = 3 AND observed_at = {T0 + 20 * DAY} AND id > 'm')) ORDER BY severity DESC, observed_at DESC, id LIMIT 26""")
def p6_next_page(v: Views) -> DataFrame:
    """A later page under filters of layer, severity and time."""
    rows = v.current.where((F.col("severity") >= 1) & F.col("layer").isin(1, 2, 5) & (F.col("observed_at") >= T0 + 5 * DAY))
    return paging.page(rows.select(*EVENT), EVENT_ORDER, 25, {"severity": 3, "observed_at": T0 + 20 * DAY, "id": "m"})


@query("SELECT id, revision, severity, status, observed_at FROM revisions WHERE user_id = 7 ORDER BY id, revision DESC")
def q3_event_history(v: Views) -> DataFrame:
    return v.revisions.where("user_id = 7").select("id", "revision", "severity", "status", "observed_at").orderBy("id", F.desc("revision"))


@query(f"""SELECT r.id, r.revision, r.observed_at, c.layer AS current_layer, r.severity FROM revisions r JOIN current_events c ON r.id = c.id JOIN event_places p ON p.id = r.id
    WHERE p.place_id = 'nation:7' AND r.observed_at >= {T0} AND r.observed_at < {T0 + 20 * DAY} ORDER BY r.observed_at DESC, r.id, r.revision DESC LIMIT 201""")
def q4_history_page(v: Views) -> DataFrame:
    """Revisions across events; layer and place are those of the current row."""
    now = F.max_by(F.struct("layer", "lat", "lng"), "revision").over(Window.partitionBy("id"))  # the gate has dealt and sorted them so
    r = v.revisions.select("id", "revision", "observed_at", "severity", now.alias("now")).where((F.col("observed_at") >= T0) & (F.col("observed_at") < T0 + 20 * DAY))
    rows = v.in_places(r, "now.lat", "now.lng", v.places.where("place_id = 'nation:7'")).withColumn("current_layer", F.col("now.layer"))
    return paging.page(rows.select("id", "revision", "observed_at", "current_layer", "severity"), [("observed_at", True), ("id", False), ("revision", True)], 200)


@query("SELECT id, layer, severity, place_id FROM current_events JOIN event_places USING (id) WHERE place_id IN ('nation:3', 'nation:12')")
def j1_events_of_places(v: Views) -> DataFrame:
    return v.placed.where(F.col("place_id").isin("nation:3", "nation:12")).select("id", "layer", "severity", "place_id")


@query("SELECT id, place_id FROM event_places")
def j9_point_places(v: Views) -> DataFrame:
    """Events attached to places, by cell and exact bounds."""
    return v.event_places


@query("""SELECT e.id, p.place_id FROM current_events e JOIN places p ON (e.lat >= p.min_lat AND e.lat < p.max_lat AND e.lng >= p.min_lng AND e.lng < p.max_lng) AND NOT
    (e.lat >= p.min_lat + 0.25 AND e.lat < p.max_lat - 0.25 AND e.lng >= p.min_lng + 0.25 AND e.lng < p.max_lng - 0.25)""")
def g5_polygon_with_hole(v: Views) -> DataFrame:
    """Point in polygon over rings with a hole, all in expressions."""
    ring = lambda d: F.array(*(F.array(F.col(x) + sx * d, F.col(y) + sy * d) for x, sx, y, sy in (("min_lng", 1, "min_lat", 1), ("max_lng", -1, "min_lat", 1), ("max_lng", -1, "max_lat", -1), ("min_lng", 1, "max_lat", -1))))
    p = v.places.withColumn("rings", F.array(ring(0.0), ring(0.25))).withColumns({"cell_lat": F.floor("min_lat"), "cell_lng": F.floor("min_lng")}).select("place_id", "rings", "cell_lat", "cell_lng")
    e = v.current.select("id", "lat", "lng", F.floor("lat").alias("cell_lat"), F.floor("lng").alias("cell_lng"))
    return e.join(p, ["cell_lat", "cell_lng"]).where(geo.in_polygon(F.col("rings"), F.col("lat"), F.col("lng"))).select("id", "place_id")


@query("SELECT place_id, slug, name, kind, parent FROM places WHERE instr(lower(name), 'tion_1') > 0")
def q7_places_by_name(v: Views) -> DataFrame:
    return v.places.where(F.instr(F.lower("name"), "tion_1") > 0).select("place_id", "slug", "name", "kind", "parent")


@query("""SELECT place_id, kind, row_number() OVER (ORDER BY CASE kind WHEN 'AREA' THEN 0 WHEN 'TOWN' THEN 1 ELSE 2 END, name) AS position FROM places
    WHERE 37.2 >= min_lat - 0.5 AND 37.2 <= max_lat + 0.5 AND -121.7 >= min_lng - 0.5 AND -121.7 <= max_lng + 0.5""")
def j10_resolve_point(v: Views) -> DataFrame:
    """Places about a point, most specific first."""
    near = v.places.where((F.lit(37.2) >= F.col("min_lat") - 0.5) & (F.lit(37.2) <= F.col("max_lat") + 0.5) & (F.lit(-121.7) >= F.col("min_lng") - 0.5) & (F.lit(-121.7) <= F.col("max_lng") + 0.5))
    rank = classify.ladder((F.col("kind") == "AREA", 0), (F.col("kind") == "TOWN", 1), otherwise=2)
    return near.select("place_id", "kind", F.row_number().over(Window.orderBy(rank, "name")).alias("position"))  # a handful of rows


@query("""SELECT layer, CAST(count(*) AS BIGINT) AS events, CAST(sum(revision) AS BIGINT) AS revisions, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds, min(observed_at) AS first_at FROM current_events GROUP BY layer""")
def q9_totals(v: Views) -> DataFrame:
    return v.current.groupBy("layer").agg(F.count("*").alias("events"), F.sum("revision").alias("revisions"), F.countDistinct("event_type").alias("kinds"), F.min("observed_at").alias("first_at"))


@query("""SELECT place_id, severity, CAST(count(*) AS BIGINT) AS n FROM event_places JOIN current_events USING (id) WHERE status = 'ACTIVE' GROUP BY ALL""")
def a8_severity_counts(v: Views) -> DataFrame:
    return v.placed.where("status = 'ACTIVE'").groupBy("place_id", "severity").agg(F.count("*").alias("n"))


@query("""SELECT place_id, CASE WHEN layer IN (1, 5) THEN 'traffic' WHEN layer = 2 THEN 'fault' ELSE 'trade' END AS domain, CAST(count(*) AS BIGINT) AS active_count, max(severity) AS highest,
    list(id ORDER BY severity DESC, observed_at DESC, id)[1:3] AS top FROM event_places JOIN current_events USING (id) WHERE status = 'ACTIVE' AND NOT (layer = 4 AND severity = 0) GROUP BY ALL""")
def a9_domain_rollup(v: Views) -> DataFrame:
    """Per place and domain: active events, the highest severity, the ids of the top three."""
    domain = F.when(F.col("layer").isin(1, 5), "traffic").when(F.col("layer") == 2, "fault").otherwise("trade")
    rows = v.placed.where("status = 'ACTIVE' AND NOT (layer = 4 AND severity = 0)").select("id", domain.alias("domain"), "severity", "observed_at", "place_id")
    w = Window.partitionBy("place_id", "domain").orderBy(F.desc("severity"), F.desc("observed_at"), "id")
    rows = rows.withColumn("n", F.row_number().over(w))
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= 3, F.struct("n", "id")))), lambda x: x["id"])
    return rows.groupBy("place_id", "domain").agg(F.count("*").alias("active_count"), F.max("severity").alias("highest"), top.alias("top"))


@query("""SELECT place_id, CASE WHEN bool_or(layer = 3 AND severity >= 2) OR max(severity) >= 4 OR max(CASE WHEN layer = 1 THEN severity ELSE 0 END) >= 3 THEN 'ACTIVE'
    WHEN max(severity) >= 3 OR bool_or(layer = 3 AND severity = 1) THEN 'WATCH' ELSE 'QUIET' END AS mode FROM event_places JOIN current_events USING (id) WHERE status = 'ACTIVE' GROUP BY place_id""")
def a12_place_mode(v: Views) -> DataFrame:
    rows = v.placed.where("status = 'ACTIVE'").select("id", "layer", "severity", "place_id")
    level = F.when((F.col("layer") == 3) & (F.col("severity") >= 2), "ORDER").when((F.col("layer") == 3) & (F.col("severity") == 1), "ADVISORY")
    by = rows.groupBy("place_id").agg(F.collect_set(level).alias("levels"), F.max("severity").alias("top"), F.max(F.when(F.col("layer") == 1, F.col("severity")).otherwise(0)).alias("fire"))
    return by.select("place_id", classify.place_mode(F.col("levels"), F.col("top"), F.col("fire"), F.lit("normal"), F.lit(False), F.lit(False)).alias("mode"))


@query("""SELECT id, severity, observed_at FROM current_events WHERE status = 'ACTIVE' ORDER BY severity DESC, observed_at DESC, id LIMIT 5""")
def o6_top_events(v: Views) -> DataFrame:
    return v.current.where("status = 'ACTIVE'").orderBy(F.desc("severity"), F.desc("observed_at"), "id").limit(5).select("id", "severity", "observed_at")


@query("""SELECT event_type, id FROM (SELECT event_type, id, sum(octet_length(encode(id)) * 100) OVER w AS used, row_number() OVER w AS n FROM current_events
    WINDOW w AS (PARTITION BY event_type ORDER BY severity DESC, observed_at DESC, id ROWS UNBOUNDED PRECEDING)) WHERE used <= 15000 OR n = 1""")
def o5_byte_budget(v: Views) -> DataFrame:
    rows = v.current.select("event_type", "id", "severity", "observed_at")
    return paging.within_budget(rows, EVENT_ORDER, F.octet_length("id") * 100, 15_000, ["event_type"]).select("event_type", "id")


@query("""SELECT name, row_number() OVER (ORDER BY regexp_extract(name, '^(\\D*)', 1), CAST(regexp_extract(name, '^\\D*(\\d+)', 1) AS BIGINT), name) AS position FROM places""")
def o9_natural_order(v: Views) -> DataFrame:
    return v.places.select("name", F.row_number().over(Window.orderBy(*paging.natural_key("name"))).alias("position"))  # 25 places


@query("SELECT id, revision, observed_at, severity, status FROM revisions")
def w3_revision_gate(v: Views) -> DataFrame:
    return v.revisions.select("id", "revision", "observed_at", "severity", "status")


@query("""SELECT id, seq, last_value(CASE WHEN k % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY id ORDER BY observed_at, seq ROWS UNBOUNDED PRECEDING) AS gauge FROM observed""")
def w4_carried_fields(v: Views) -> DataFrame:
    return state.refreshed(v.observed.select("id", "seq", "observed_at", F.when(F.col("k") % 3 == 0, F.col("value")).alias("gauge")), "id", ["observed_at", "seq"], ["gauge"]).select("id", "seq", "gauge")


@query(f"SELECT id, revision + 1 AS revision, 'RESOLVED' AS status, CAST({T0 + 40 * DAY} AS BIGINT) AS observed_at FROM current_events WHERE status <> 'RESOLVED' AND user_id % 7 = 0")
def w5_transition(v: Views) -> DataFrame:
    ids = v.current.where("user_id % 7 = 0").select("id")
    return state.transition(v.current, ids, "RESOLVED", F.lit(T0 + 40 * DAY).cast("bigint")).select("id", "revision", "status", "observed_at")


@query(f"""SELECT id, CASE event_type WHEN 'click' THEN 'RESOLVED' WHEN 'error' THEN CASE WHEN observed_at + {6 * DAY} <= {T0 + 31 * DAY} THEN 'EXPIRED' END ELSE CASE WHEN {T0 + 31 * DAY} - observed_at >= {3 * DAY} THEN 'RESOLVED' END END AS next_status
    FROM current_events c WHERE status = 'ACTIVE' AND NOT EXISTS (SELECT 1 FROM observed o WHERE o.id = c.id AND o.observed_at >= {T0 + 29 * DAY})""")
def w6_sweep(v: Views) -> DataFrame:
    """What no poll of the last days lists, by each source's policy."""
    polled = v.observed.where(F.col("observed_at") >= T0 + 29 * DAY).select("id")
    active = v.current.where("status = 'ACTIVE'").select("id", "event_type", "observed_at", (F.col("observed_at") + 6 * DAY).alias("expires"), F.lit(None).cast("bigint").alias("last_seen"))
    policy = F.when(F.col("event_type") == "click", "resolve").when(F.col("event_type") == "error", "expire").otherwise("grace")
    return state.sweep(active, polled, F.lit(T0 + 31 * DAY), F.lit(3 * DAY), policy).select("id", "next_status")


@query("""SELECT c.id, s.successor, 'RESOLVED' AS next_status FROM current_events c JOIN (SELECT 'click:' || user_id AS id, min('view:' || user_id) AS successor FROM observed WHERE event_type = 'view' AND k % 10 = 0 GROUP BY 1) s USING (id) WHERE c.status = 'ACTIVE'""")
def w7_supersede(v: Views) -> DataFrame:
    replaced = v.observed.where("event_type = 'view' AND k % 10 = 0").select(F.concat(F.lit("click:"), "user_id").alias("id"), F.concat(F.lit("view:"), "user_id").alias("successor"))
    return state.supersede(v.current.where("status = 'ACTIVE'").select("id"), replaced).select("id", "successor", "next_status")


@query(f"""SELECT id, CASE WHEN user_id % 2 = 0 AND observed_at < {T0 + 30 * DAY} THEN {T0 + 31 * DAY} ELSE observed_at END AS last_seen FROM current_events""")
def w8_touch(v: Views) -> DataFrame:
    rows = v.current.select("id", F.col("observed_at").alias("last_seen"))
    return state.touch(rows, v.current.where("user_id % 2 = 0").select("id"), F.lit(T0 + 31 * DAY).cast("bigint"), F.lit(T0 + 30 * DAY))


@query("""SELECT id, place_id, change FROM (SELECT p.id, p.place_id, 'delete' AS change FROM event_places p JOIN current_events c USING (id) WHERE c.severity = 0
    UNION ALL SELECT c.id, 'nation:0', 'insert' FROM current_events c WHERE c.severity = 0 AND NOT EXISTS (SELECT 1 FROM event_places p WHERE p.id = c.id AND p.place_id = 'nation:0'))
    WHERE NOT (change = 'delete' AND place_id = 'nation:0')""")
def w9_set_difference(v: Views) -> DataFrame:
    low = v.current.where("severity = 0").select("id")
    return state.replace_set(v.event_places.join(low, "id", "left_semi"), low.select("id", F.lit("nation:0").alias("place_id")), ["id", "place_id"])


@query(f"""SELECT 'c' || lower(pubkey[2:]) AS pubkey, max(heard) AS heard, max(relayed) AS relayed FROM (SELECT pubkey, heard_at AS heard, 0 AS relayed FROM mesh_observations WHERE obs_id % 2 = 0
    UNION ALL SELECT pubkey, 0, heard_at FROM mesh_observations WHERE obs_id % 2 = 1) GROUP BY 1""")
def w11_activity(v: Views) -> DataFrame:
    """Two clocks of each node; 0 is never."""
    o = v.mesh_observations
    stored = o.where("obs_id % 2 = 0").select("pubkey", F.col("heard_at").alias("heard"), F.lit(0).cast("bigint").alias("relayed"))
    batch = o.where("obs_id % 2 = 1").select(F.upper("pubkey").alias("pubkey"), F.lit(0).cast("bigint").alias("heard"), F.col("heard_at").alias("relayed"))
    return state.max_merge(stored, batch, "pubkey", ["heard", "relayed"])


@query("""SELECT road, sampled_at, status, minutes FROM road_samples QUALIFY row_number() OVER (PARTITION BY road, sampled_at ORDER BY seq) = 1""")
def w13_first_sample(v: Views) -> DataFrame:
    r = v.road_samples
    return state.insert_or_ignore(r.where("seq < 0"), r, ["road", "sampled_at"], ["seq"]).select("road", "sampled_at", "status", "minutes")


@query("SELECT node, reported_at, battery FROM telemetry QUALIFY row_number() OVER (PARTITION BY node ORDER BY reported_at DESC, seq DESC) = 1")
def w14_last_write(v: Views) -> DataFrame:
    return state.last_write_wins(v.telemetry, "node", "reported_at", "seq").select("node", "reported_at", "battery")


_EDGES = """(SELECT obs_id, heard_at, snr, least(x, y) AS a, greatest(x, y) AS b FROM (SELECT obs_id, heard_at, snr, unnest([pubkey] || path_nodes[:-2]) AS x, unnest(path_nodes) AS y FROM mesh_observations) WHERE x <> '' AND y <> '' AND x <> y)"""


@query(f"SELECT obs_id, heard_at, snr, a, b FROM {_EDGES}")
def d10_relay_edges(v: Views) -> DataFrame:
    return mesh.edges(v.mesh_observations)


def no_rollup(v: Views) -> DataFrame:
    """A link rollup before any reception."""
    return v.spark.createDataFrame([], "a string, b string, day bigint, n bigint, best_snr int, first_at bigint, last_at bigint")


@query(f"SELECT a, b, heard_at - heard_at % 86400 AS day, CAST(count(*) AS BIGINT) AS n, max(snr) AS best_snr, min(heard_at) AS first_at, max(heard_at) AS last_at FROM {_EDGES} GROUP BY 1, 2, 3")
def w16_link_rollup(v: Views) -> DataFrame:
    """The rollup after two chunks, the second added to the first."""
    e = v.keep(mesh.edges(v.mesh_observations))
    n = v.parts(e)
    return state.compact(state.compact(no_rollup(v), e.where("obs_id % 2 = 0"), n), e.where("obs_id % 2 = 1"), n)


@query(f"""SELECT a, b, CAST(count(*) AS BIGINT) AS observations, max(snr) AS best_snr, min(heard_at) AS first_at, max(heard_at) AS last_at, CAST(count(DISTINCT heard_at - heard_at % 86400) AS BIGINT) AS days FROM {_EDGES}
    WHERE (obs_id % 3 > 0 AND heard_at >= 852076800) OR (obs_id % 3 = 0 AND heard_at >= 852076800 + 3600) GROUP BY 1, 2""")
def a5_mesh_links(v: Views) -> DataFrame:
    """Rolled-up days and the raw tail in one aggregate; the window's first day counts whole in the rollup only."""
    e = v.keep(mesh.edges(v.mesh_observations))
    return mesh.links(state.compact(no_rollup(v), e.where("obs_id % 3 > 0"), v.parts(e)), e.where("obs_id % 3 = 0"), 852076800 + 3600)


@query("""SELECT source_id, seq, CASE WHEN ok THEN 'OK' WHEN sampled_at - last_ok <= 3 * poll_seconds THEN 'STALE' ELSE 'UNAVAILABLE' END AS status FROM
    (SELECT *, last_value(CASE WHEN ok THEN sampled_at END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY sampled_at, seq ROWS UNBOUNDED PRECEDING) AS last_ok FROM attempts) JOIN sources USING (source_id)""")
def w19_source_health(v: Views) -> DataFrame:
    return state.source_health(v.attempts, v.sources, v.keep).select("source_id", "seq", "status")


@query("""SELECT s.layer, CASE WHEN bool_and(x.ok) THEN 'OK' WHEN NOT bool_or(x.ok) THEN 'UNAVAILABLE' ELSE 'STALE' END AS status, max(CASE WHEN x.ok THEN x.sampled_at END) AS last_update FROM
    (SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY sampled_at DESC, seq DESC) = 1) x JOIN sources s USING (source_id) GROUP BY s.layer""")
def a11_layer_status(v: Views) -> DataFrame:
    last = state.latest(v.attempts, "source_id", ["sampled_at", "seq"]).join(v.sources, "source_id")
    status = F.when(F.bool_and("ok"), "OK").when(~F.bool_or("ok"), "UNAVAILABLE").otherwise("STALE")
    return last.groupBy("layer").agg(status.alias("status"), F.max(F.when(F.col("ok"), F.col("sampled_at"))).alias("last_update"))


@query("""SELECT road, any_value(latest) AS status, min(CASE WHEN d IS NULL OR sampled_at > d THEN sampled_at END) AS since, any_value(d) IS NULL AS at_start FROM (SELECT *, max(CASE WHEN status <> latest THEN sampled_at END) OVER (PARTITION BY road) AS d FROM
    (SELECT *, first_value(status) OVER (PARTITION BY road ORDER BY sampled_at DESC, seq DESC) AS latest FROM road_samples)) GROUP BY road""")
def n1_status_since(v: Views) -> DataFrame:
    return series.status_run(v.road_samples, "road")


@query(f"""WITH s AS (SELECT road, minutes, (dayofweek(l) * 24 + hour(l)) = (SELECT dayofweek(x) * 24 + hour(x) FROM (SELECT timezone('America/Los_Angeles', to_timestamp({T0 + 9 * DAY + 3600})) AS x)) AS same FROM
    (SELECT *, timezone('America/Los_Angeles', to_timestamp(sampled_at)) AS l FROM road_samples WHERE status = 1 AND minutes IS NOT NULL)),
    g AS (SELECT road, list(minutes ORDER BY minutes) FILTER (same) AS h, list(minutes ORDER BY minutes) AS a FROM s GROUP BY road),
    c AS (SELECT road, CASE WHEN coalesce(len(h), 0) >= 3 THEN h WHEN len(a) >= 3 THEN a END AS x, CASE WHEN coalesce(len(h), 0) >= 3 THEN 'HOUR_OF_WEEK' ELSE 'ALL_HOURS' END AS basis FROM g)
    SELECT road, CASE WHEN len(x) % 2 = 1 THEN x[len(x) // 2 + 1] ELSE (x[len(x) // 2] + x[len(x) // 2 + 1] + 1) // 2 END AS minutes, basis FROM c WHERE x IS NOT NULL""")
def a6_typical_minutes(v: Views) -> DataFrame:
    return series.typical_minutes(v.road_samples, "road", T0 + 9 * DAY + 3600)


@query("""SELECT node, list(gap ORDER BY gap)[count(*) // 2 + 1] AS cadence FROM (SELECT node, reported_at - lag(reported_at) OVER (PARTITION BY node ORDER BY reported_at) AS gap FROM telemetry) WHERE gap > 0 GROUP BY node""")
def a7_cadence(v: Views) -> DataFrame:
    return series.cadence(v.telemetry, "node", "reported_at", v.keep)


@query("""SELECT node, min(reported_at) AS first_at, max(reported_at) AS last_at, CAST(count(*) AS BIGINT) AS n FROM telemetry GROUP BY node""")
def a3_coverage(v: Views) -> DataFrame:
    return v.telemetry.groupBy("node").agg(F.min("reported_at").alias("first_at"), F.max("reported_at").alias("last_at"), F.count("*").alias("n"))


@query("""SELECT pubkey, list_slice(list(heard_at ORDER BY heard_at), -5, -1) AS times FROM mesh_observations GROUP BY pubkey""")
def a24_heard_times(v: Views) -> DataFrame:
    """The latest five times of each node, ascending."""
    return mesh.heard_times(v.mesh_observations, 5)


@query("""SELECT node, seq, reported_at FROM (SELECT *, lag(uptime) OVER (PARTITION BY node ORDER BY reported_at, seq) AS b FROM telemetry) WHERE uptime < b""")
def n2_reboots(v: Views) -> DataFrame:
    return series.reboots(v.telemetry, "node", ["reported_at", "seq"]).select("node", "seq", "reported_at")


@query("""SELECT id, revision, field, before, after FROM (SELECT id, revision, unnest(['severity', 'status']) AS field, unnest([CAST(lag(severity) OVER w AS VARCHAR), lag(status) OVER w]) AS before, unnest([CAST(severity AS VARCHAR), status]) AS after
    FROM revisions WINDOW w AS (PARTITION BY id ORDER BY revision)) WHERE revision > 1 AND before <> after""")
def n3_revision_changes(v: Views) -> DataFrame:
    w = Window.partitionBy("id").orderBy("revision")
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.lag(F.col(c).cast("string")).over(w).alias("before"), F.col(c).cast("string").alias("after")) for c in ("severity", "status")))
    rows = v.revisions.select("id", "revision", fields.alias("c")).select("id", "revision", F.inline("c"))
    return rows.where("revision > 1 AND before <> after")


@query("""SELECT id, sampled_at, clock, kind, row_number() OVER (PARTITION BY id ORDER BY sampled_at, clock DESC, kind, revision) AS position FROM (SELECT id, observed_at AS sampled_at, 'SOURCE' AS clock, 'REPORTED' AS kind, revision FROM revisions WHERE revision = 1
    UNION ALL SELECT id, observed_at, 'OWN', 'FIRST_RECORDED', revision FROM revisions WHERE revision = 1 UNION ALL SELECT id, observed_at, 'OWN', CASE WHEN status <> before THEN 'STATUS' ELSE 'SEVERITY' END, revision FROM
    (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY revision) AS before FROM revisions) WHERE revision > 1)""")
def n4_timeline(v: Views) -> DataFrame:
    """Source entries, the first record and changes of each event in one order."""
    r = v.revisions.select("id", F.col("observed_at").alias("sampled_at"), "revision", "status", F.lag("status").over(Window.partitionBy("id").orderBy("revision")).alias("before"))
    entry = lambda clock, kind: F.struct(F.lit(clock).alias("clock"), kind.alias("kind"))
    changed = F.when(F.col("status") != F.col("before"), "STATUS").otherwise("SEVERITY")
    told = F.when(F.col("revision") == 1, F.array(entry("SOURCE", F.lit("REPORTED")), entry("OWN", F.lit("FIRST_RECORDED")))).otherwise(F.array(entry("OWN", changed)))
    entries = r.select("id", "sampled_at", "revision", F.explode(told).alias("e")).select("id", "sampled_at", "revision", "e.clock", "e.kind")
    w = Window.partitionBy("id").orderBy("sampled_at", F.desc("clock"), "kind", "revision")
    return entries.select("id", "sampled_at", "clock", "kind", F.row_number().over(w).alias("position"))


@query("""SELECT l.id, l.seq, r.seq AS as_of_seq FROM observed l ASOF LEFT JOIN (SELECT user_id, observed_at, max(seq) AS seq FROM observed WHERE event_type = 'error' GROUP BY ALL) r ON l.user_id = r.user_id AND l.observed_at > r.observed_at WHERE l.event_type = 'purchase'""")
def j5_as_of(v: Views) -> DataFrame:
    """The last error of a user strictly before each purchase."""
    left = v.observed.where("event_type = 'purchase'").select("id", "seq", "user_id", "observed_at")
    right = v.observed.where("event_type = 'error'").groupBy("user_id", "observed_at").agg(F.max("seq").alias("seq"))
    return series.as_of(left, right, ["user_id"], "observed_at", "observed_at", ["seq"], v.keep).select("id", "seq", "as_of_seq")


@query("""SELECT id, status, heard FROM current_events LEFT JOIN (SELECT CAST(pubkey[2:] AS BIGINT) AS user_id, max(heard_at) AS heard FROM mesh_observations GROUP BY 1) USING (user_id)""")
def j16_overlay(v: Views) -> DataFrame:
    """Current rows with a node's clock laid over them where there is one."""
    heard = v.mesh_observations.groupBy(F.substring("pubkey", 2, 20).cast("bigint").alias("user_id")).agg(F.max("heard_at").alias("heard"))
    return v.current.select("id", "status", "user_id").join(heard, "user_id", "left").select("id", "status", "heard")


@query("""SELECT prefix, min(key) AS key FROM (SELECT DISTINCT 'c' || n AS prefix FROM range(10) t(n)) JOIN (SELECT DISTINCT pubkey AS key FROM mesh_observations) ON starts_with(key, prefix) GROUP BY prefix HAVING count(*) = 1""")
def j13_unique_prefix(v: Views) -> DataFrame:
    keys = v.mesh_observations.select(F.col("pubkey").alias("key")).distinct()
    return mesh.unique_prefix(v.spark.range(10).select(F.concat(F.lit("c"), "id").alias("prefix")), keys)


@query("""WITH d AS (SELECT e.id, p.place_id, 111.32 * sqrt(pow(greatest(0, p.min_lat - e.lat, e.lat - p.max_lat), 2) + pow(greatest(0, p.min_lng - e.lng, e.lng - p.max_lng) * cos(radians((2 * e.lat + p.min_lat + p.max_lat) / 4)), 2)) AS gap FROM current_events e, places p WHERE e.layer = 3)
    SELECT id, place_id, round(gap, 3) AS gap_km, CASE WHEN gap < 0.1 THEN 'ON' ELSE 'NEAR' END AS class FROM d WHERE gap <= 20""")
def j18_near_places(v: Views) -> DataFrame:
    """Places within 20 km of an event's box: candidates come from the neighbouring cells."""
    p = v.places.withColumns({"cell_lat": F.explode(F.sequence(F.floor("min_lat") - 1, F.floor("min_lat") + 1))}).withColumn("cell_lng", F.explode(F.sequence(F.floor("min_lng") - 1, F.floor("min_lng") + 1)))
    e = v.current.where("layer = 3").select("id", "lat", "lng", F.floor("lat").alias("cell_lat"), F.floor("lng").alias("cell_lng"))
    gap = geo.box_gap_km((F.col("lat"), F.col("lng"), F.col("lat"), F.col("lng")), (F.col("min_lat"), F.col("min_lng"), F.col("max_lat"), F.col("max_lng")))
    return e.join(p, ["cell_lat", "cell_lng"]).withColumn("gap", gap).where("gap <= 20").select("id", "place_id", F.round("gap", 3).alias("gap_km"), F.when(F.col("gap") < 0.1, "ON").otherwise("NEAR").alias("class"))


@query("""WITH p AS (SELECT a.id AS a, b.id AS b, b.observed_at - a.observed_at AS lag, 111.32 * sqrt(pow(a.lat - b.lat, 2) + pow((a.lng - b.lng) * cos(radians((a.lat + b.lat) / 2)), 2)) AS gap FROM current_events a JOIN current_events b
    ON a.layer = 1 AND b.layer = 2 AND b.observed_at >= a.observed_at - 3600 AND b.observed_at <= a.observed_at + 259200), m AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY gap, a) AS n FROM p WHERE gap <= 60)
    SELECT a, b, lag, round(gap, 3) AS gap_km, CASE WHEN gap <= 10 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM m WHERE n = 1 OR gap <= 10""")
def q6_related(v: Views) -> DataFrame:
    """Events related in time and place: a close rule for every pair, a wider one for the nearest only, the stronger told."""
    c = v.keep(v.current.where("layer IN (1, 2)").select("id", "layer", "observed_at", "lat", "lng"))
    day = DAY * 3
    a = c.where("layer = 1").select(F.col("id").alias("a"), F.col("observed_at").alias("ta"), F.col("lat").alias("la"), F.col("lng").alias("ga"))
    b = c.where("layer = 2").select(F.col("id").alias("b"), F.col("observed_at").alias("tb"), F.col("lat").alias("lb"), F.col("lng").alias("gb"))
    point = lambda lat, lng: (F.col(lat), F.col(lng), F.col(lat), F.col(lng))

    def within(b: DataFrame, km: int, cell: float) -> DataFrame:
        """Pairs in time and so near. A range in time and two in place become equal buckets; a side asks in its neighbours."""
        left = a.select("*", F.explode(F.sequence(F.floor((F.col("ta") - 3600) / day), F.floor((F.col("ta") + day) / day))).alias("t"), geo.cell(F.col("la"), cell).alias("x0"), geo.cell(F.col("ga"), cell).alias("y0"))
        left = left.select("*", F.explode(F.sequence(F.col("x0") - 1, F.col("x0") + 1)).alias("x")).select("*", F.explode(F.sequence(F.col("y0") - 1, F.col("y0") + 1)).alias("y"))
        right = b.withColumns({"t": F.floor(F.col("tb") / day), "x": geo.cell(F.col("lb"), cell), "y": geo.cell(F.col("gb"), cell)})
        pairs = left.join(right, ["t", "x", "y"]).where("tb >= ta - 3600 AND tb <= ta + 259200").withColumn("gap", geo.box_gap_km(point("la", "ga"), point("lb", "gb"))).where(F.col("gap") <= km)
        return pairs.select("a", "b", (F.col("tb") - F.col("ta")).alias("lag"), "gap")

    # Close pairs stay where they are found; a B without any looks farther for its nearest, step by step.
    kept = within(b, 10, 0.18)
    rest, found = b, kept
    for km, cell in ((20, 0.36), (60, 1.08)):
        rest = v.keep(rest.join(found.select("b").distinct(), "b", "left_anti"))
        nearest = within(rest, km, cell).groupBy("b").agg(F.min(F.struct("gap", "a", "lag")).alias("m")).select("m.a", "b", "m.lag", "m.gap")
        found = v.keep(nearest)
        kept = kept.unionByName(found)
    return kept.select("a", "b", "lag", F.round("gap", 3).alias("gap_km"), F.when(F.col("gap") <= 10, "HIGH").otherwise("MEDIUM").alias("confidence"))


@query("""SELECT id, hour, CAST(count(*) AS BIGINT) AS n FROM (SELECT id, unnest(range(observed_at - observed_at % 3600, observed_at + (k % 5) * 3600, 3600)) AS hour FROM observed WHERE event_type = 'signup' AND k % 5 > 0) GROUP BY ALL""")
def n7_hourly(v: Views) -> DataFrame:
    """Intervals as hours."""
    rows = v.observed.where("event_type = 'signup'").select("id", "observed_at", (F.col("observed_at") + (F.col("k") % 5) * 3600).alias("until"))
    return series.hourly(rows, "observed_at", "until", ["id"]).groupBy("id", "hour").agg(F.count("*").alias("n"))


@query("""SELECT node, seq, round(haversine, 1) AS metres FROM (SELECT user_id AS node, seq, 2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)) AS haversine FROM (SELECT user_id, seq, pow(sin(radians(37 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(37)) * pow(sin(radians(-121 - lng) / 2), 2) AS h FROM observed))""")
def g11_haversine(v: Views) -> DataFrame:
    d = geo.haversine(F.col("lat"), F.col("lng"), F.lit(37.0), F.lit(-121.0))
    return v.observed.select(F.col("user_id").alias("node"), "seq", F.round(d, 1).alias("metres"))


@query("""SELECT seq, (dayofweek(l) * 24 + hour(l)) AS hour_of_week, strftime(to_timestamp(observed_at) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS stamp, observed_at - observed_at % 86400 AS day FROM (SELECT *, timezone('America/Los_Angeles', to_timestamp(observed_at)) AS l FROM observed)""")
def d3_times(v: Views) -> DataFrame:
    t = F.col("observed_at")
    return v.observed.select("seq", times.hour_of_week(t).alias("hour_of_week"), times.rfc3339(t).alias("stamp"), times.day_of(t).alias("day"))


@query("""SELECT seq, CASE WHEN value / 30 >= 5 THEN 3 WHEN value / 30 >= 4 THEN 2 WHEN value / 30 >= 2.5 THEN 1 ELSE 0 END AS quake, greatest(CASE WHEN k >= 100 THEN 1 WHEN k < 50 THEN 3 ELSE 2 END, CASE WHEN k >= 100 THEN 0 WHEN value * 10 >= 1000 AND k < 50 THEN 4 WHEN value * 10 >= 100 THEN 3 ELSE 0 END) AS fire,
    CASE WHEN floor(value * 5) <= 0 THEN 1 ELSE greatest(0, CASE WHEN floor(value * 5) >= 1000 THEN 3 WHEN floor(value * 5) >= 100 THEN 2 WHEN floor(value * 5) >= 10 THEN 1 ELSE 0 END - CAST(k % 2 = 0 AS INT)) END AS outage FROM observed""")
def c2_severities(v: Views) -> DataFrame:
    n = F.floor(F.col("value") * 5)
    return v.observed.select("seq", classify.from_magnitude(F.col("value") / 30).alias("quake"), classify.from_wildfire(F.col("value") * 10, F.col("k")).alias("fire"), classify.from_power_outage(n, F.col("k") % 2 == 0).alias("outage"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM pages""")
def t2_html_text(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", text.html_text(F.col("html")).alias("text"))


@query("""SELECT conv_id, turn, length(t) AS n, sha256(t) AS hash FROM (SELECT conv_id, turn, trim(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), '[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}', '', 'g'),
    '\\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\\s+[0-9]{1,2}\\s+[0-9]{4}\\b', '', 'g'), '\\b[0-9]{1,2}:[0-9]{2}\\s*([ap]m)?\\b', '', 'g'), '[.,;:!?()-]', '', 'g'),
    'hwy', 'highway'), 'nb', 'northbound'), 'sb', 'southbound'), 'eb', 'eastbound'), 'wb', 'westbound'), 'incident', 'inc'), 'closure', 'closed')) AS t FROM conversations)""")
def t1_normalized_text(v: Views) -> DataFrame:
    """Turns made comparable and hashed: without dates, times and punctuation, in one spelling."""
    t = text.normalized(F.col("text"))
    return v.table("conversations").select("conv_id", "turn", F.length(t).cast("bigint").alias("n"), F.sha2(t, 256).alias("hash"))


@query("""WITH g AS (SELECT node, reported_at, reported_at - lag(reported_at) OVER (PARTITION BY node ORDER BY reported_at) AS gap FROM telemetry), l AS (SELECT node, list(CAST(gap AS DOUBLE) ORDER BY reported_at) FILTER (gap >= 30) AS gaps FROM g GROUP BY node)
    SELECT node, round(CASE WHEN len(gaps) > 0 THEN list_reduce(gaps, lambda s, x: s + 0.3 * (x - s)) END, 6) AS ewma, CAST(coalesce(len(gaps), 0) AS INT) AS n_gaps FROM l""")
def n5_ewma(v: Views) -> DataFrame:
    return series.ewma(v.telemetry, "node", "reported_at", keep=v.keep).withColumn("ewma", F.round("ewma", 6))


@query("""SELECT node, reporter, unnest(list_reduce(list_transform(list(reported_at ORDER BY reported_at), lambda x: [x]), lambda kept, x: CASE WHEN x[1] - kept[-1] >= 21600 THEN kept || x ELSE kept END)) AS reported_at FROM telemetry GROUP BY node, reporter""")
def n6_spam_floor(v: Views) -> DataFrame:
    return series.kept_apart(v.telemetry, ["node", "reporter"], "reported_at", 6 * 3600)
