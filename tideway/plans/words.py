"""Words, names, numbers and requests: what text and scalar functions make of the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.functions import classify, text, times
from tideway.operators import paging, state
from tideway.plans.adapters import Views
from tideway.plans.events import pick, stamped
from tideway.plans.queries import EVENT, EVENT_ORDER, T0
from tideway.plans.registry import query
from tideway.sources import feeds


def chosen(*words: str) -> str:
    """The same choice in SQL."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"][k % {len(words)} + 1]"


@query(f"SELECT seq, {chosen('hwy4', 'us50', 'i80', 'i5', 'donner-pass')} AS key, {chosen('Highway 4', 'US 50', 'I-80', 'Local Rd')} AS label, {chosen('Hwy 4', 'US 50', 'I-80', 'Local')} AS route, {chosen('eastbound', 'northbound', '')} AS direction, {chosen('4', '50', '80')} AS number FROM observed")
def t13_highways(v: Views) -> DataFrame:
    """One spelling, a label, a route's name and its number."""
    return v.observed.select(
        "seq", text.highway_key(pick("Highway 4", "US 50 ", "Interstate 80", "I-5", "Donner Pass")).alias("key"), text.highway_label(pick("sr-4", "US-50", "I-80", " Local Rd")).alias("label"), text.route_label(pick("SR-4", "US-50", "I-80", "Local")).alias("route"),
        text.direction_label(pick("East", " NORTH ", "up")).alias("direction"), text.highway_number(pick("Hwy 4", "us-50", "State Route 80")).alias("number"),
    )


@query(f"SELECT seq, {chosen('Arnold', 'Bear Valley', '', '3 mi east of Arnold')} AS begins, {chosen('Markleeville', '', '', 'Bear Valley')} AS ends FROM observed")
def t14_condition_spans(v: Views) -> DataFrame:
    """Where a condition begins and ends, as its text says."""
    kind = pick("CLOSURE", "CLOSURE", "CLOSURE", "RESTRICTION")
    said = pick("Is closed from Arnold (Calaveras Co) to Markleeville - due to snow", "Is closed at Bear Valley -for the winter", "Closed", "1-way traffic from 3 mi east of Arnold to Bear Valley (Alpine Co) from 0700 hrs to 1500 hrs")
    span = text.condition_span(said, kind)
    return v.observed.select("seq", span["from"].alias("begins"), span["to"].alias("ends"))


#: What conditions may say of one seasonal closure, and whether it is exactly that.
SEASONAL = {
    "Is closed from 0.5 mi east of the Jct of SR 207 /Mt Reba Turnoff/ to the Jct of SR 89 /Ebbetts Pass/ (Alpine Co) - Due to snow- Motorists are advised to use an alternate route": True,
    "IS  CLOSED FROM 2 MILES EAST OF THE MT REBA TURNOFF TO EBBETTS PASS.": True,
    "Is closed from 2.1 mi east of the Mt Reba Turnoff to Ebbetts Pass": False,
    "Is closed from 0.5 mi west of the Mt Reba Turnoff to Ebbetts Pass": False,
    "Is closed from the Mt Reba Turnoff to Ebbetts Pass Rd": False,
    "Is closed from the Mt Reba Turnoff to the Jct of SR 89 - Due to a rock slide": False,
    "Is closed at the Mt Reba Turnoff": False,
}
WINTER = {"start": ["Mt Reba Turnoff", "Jct of SR 207"], "end": ["Ebbetts Pass", "Jct of SR 89"], "direction": "East", "most_miles": 2.0}


@query(f"SELECT seq, {chosen(*(str(x) for x in SEASONAL.values()))} = 'True' AND k % 11 > 0 AS seasonal FROM observed")
def t14_seasonal_closures(v: Views) -> DataFrame:
    """Which conditions are a configured seasonal closure and nothing else; every eleventh is no closure."""
    kind = F.when(F.col("k") % 11 == 0, "CHAIN").otherwise("CLOSURE")
    return v.observed.select("seq", text.seasonal_closure(pick(*SEASONAL), kind, **WINTER).alias("seasonal"))


@query(f"SELECT seq, {chosen('Chance of light rain showers', 'Snow', 'Likely heavy snow', 'Slight chance of thunderstorms', 'Patchy fog')} AS phrase FROM observed")
def t16_weather_phrases(v: Views) -> DataFrame:
    said = text.weather_phrase(pick("chance", "definite", "likely", "slight_chance", "patchy"), pick("light", "none", "heavy", "", ""), pick("rain_showers", "snow", "snow", "thunderstorms", "fog"))
    return v.observed.select("seq", said.alias("phrase"))


@query(f"SELECT seq, CASE k % 3 WHEN 0 THEN ['hwy4'] WHEN 1 THEN ['i80', 'us50'] ELSE ['hwy99', 'i5'] END AS routes, {chosen('Bear Valley', 'McKinney', 'Arnold')} AS place FROM observed")
def t17_sign_routes(v: Views) -> DataFrame:
    routes = text.sign_routes(pick("SR-4", "US-50", "I-5"), pick("EB SR 4 at Arnold", "WB I-80 / US 50 split", "SB Hwy 99 at Main"))
    return v.observed.select("seq", routes.alias("routes"), text.place_case(pick("BEAR VALLEY", "McKinney", "Arnold")).alias("place"))


@query(f"SELECT seq, {chosen('closed', 'restrictions', 'construction', '')} AS state, CASE k % 3 WHEN 0 THEN ['12/25/2024', 'Dec 26, 2024'] WHEN 1 THEN ['1-2-2025'] ELSE [] END AS dates FROM observed")
def t19_states_and_dates(v: Views) -> DataFrame:
    return v.observed.select("seq", text.state_said(pick("Road CLOSED, an incident", "Incident; Restrictions apply", "under construction", "clear")).alias("state"), text.dates_said(pick("from 12/25/2024 to Dec 26, 2024, again 12/25/2024", "on 1-2-2025", "soon")).alias("dates"))


@query(f"SELECT seq, {chosen('Wind Advisory — gusty winds near 45 MPH', 'Flood Watch', 'Red Flag Warning — low humidity', 'a line', 'Heat Advisory — hot days')} AS headline FROM observed")
def t9_short_headlines(v: Views) -> DataFrame:
    event = pick("Wind Advisory", "Flood Watch", "Red Flag Warning", "", "Heat Advisory")
    line = pick("WIND ADVISORY IN EFFECT FROM NOON TO 6 PM FOR GUSTY WINDS NEAR 45 MPH", "FLOOD WATCH IN EFFECT THROUGH FRIDAY", "...RED FLAG WARNING REMAINS IN EFFECT UNTIL 8 PM FOR LOW HUMIDITY IN THE FIRE ZONES 130...", "a line", "HEAT ADVISORY FOR HOT DAYS.")
    return v.observed.select("seq", text.short_headline(event, line).alias("headline"))


@query(f"SELECT seq, {chosen('full closure', 'lane closure', 'shoulder closure', 'on-ramp lane closure', 'ramp work closure')} AS phrase, {chosen('SR-4 at Arnold', 'Hwy 4 from Arnold to Murphys', 'Hwy 4 from Arnold to Murphys, near Avery')} AS area, {chosen('Closed: all lanes.', 'Closed: lane 1, right shoulder (of 2 lanes). Estimated delay: 5 min.', 'Estimated delay: 9 min.', 'Closed: Ramp (of 1 lane).')} AS description FROM observed")
def t10_closure_words(v: Views) -> DataFrame:
    c = F.col
    area = text.closure_area(pick("ZZ-4", "SR-4", "SR-4"), pick("at Arnold", "From Arnold", "Arnold"), pick("ARNOLD", "to Murphys", "Murphys"), pick("", "Murphys", "Avery"))
    number = lambda *n: F.element_at(F.array(*map(F.lit, n)), (c("k") % len(n) + 1).cast("int"))
    return v.observed.select(
        "seq", text.closure_phrase(pick("Full", "Lane", "", "lane", "Ramp work"), pick("All", "1, RShoulder", "LShoulder, RShoulder", "2", "2"), pick("Mainline", "", "", "On Ramp", "")).alias("phrase"), F.regexp_replace(area, "^ZZ-4", "SR-4").alias("area"),
        text.closure_description(pick("All", "1, RShoulder", "", "Ramp"), number(0, 2, 0, 1), number(0, 5, 9, 0)).alias("description"),
    )


@query(f"SELECT seq, {chosen('Gann', 'Bear Creek', 'McKinney', '')} AS fire, {chosen('Traffic Collision', 'Unknown Injury', 'Car Fire', 'Vehicles')} AS kind, CASE k % 3 WHEN 0 THEN 'caltrans:C1-L2-' || substr(sha256('a b'), 1, 6) WHEN 1 THEN 'chp:L2' ELSE 'chp:some-name' END AS incident, {chosen('12.4 acres', '300 acres', '')} AS acres FROM observed")
def t7_names_and_ids(v: Views) -> DataFrame:
    """Fires as people write them, incident types in words, incident ids, sizes."""
    none = F.lit(None).cast("string")
    closure, log = F.when(F.col("k") % 3 == 0, "C1").otherwise(none), F.when(F.col("k") % 3 < 2, "L2").otherwise(none)
    size = F.element_at(F.array(F.lit(12.35), F.lit(300.0), F.lit(0.0)), (F.col("k") % 3 + 1).cast("int"))
    return v.observed.select("seq", text.fire_display(pick("Gann Fire — 10,339 ac", "BEAR CREEK — 6495 ac", "McKinney Fire", "Ab Fire")).alias("fire"), feeds.incident_type(pick("1183-Trfc Collision", "Unkn Inj", "CFIRE-Car Fire", "Vehs")).alias("kind"), text.incident_id(log, closure, F.lit(" Some Name! "), F.lit("a  b")).alias("incident"), text.acres(size).alias("acres"))


@query(f"SELECT seq, {chosen('Power outage — 1,234 customers (tree contact)', 'Planned outage — 1 customer', 'Power outage — customer count not reported (odd code)', 'Power outage — 2 customers')} AS headline, {chosen('YES', 'NO', 'MARGINAL', 'UNKNOWN')} AS colour, {chosen('ALLOWED', 'PROHIBITED', 'UNKNOWN', 'UNKNOWN')} AS permission FROM observed")
def t11_power_and_burn_words(v: Views) -> DataFrame:
    customers = F.element_at(F.array(*map(F.lit, (1234, 1, 0, 2))), (F.col("k") % 4 + 1).cast("int"))
    colour = classify.burn_colour(pick("Green", " red", "ORANGE", "blue"))
    return v.observed.select("seq", text.power_headline(customers, F.col("k") % 4 == 1, pick("TREE CONTACT", "PLNND SHUTDOWN", "Odd Code", "")).alias("headline"), colour.alias("colour"), classify.burn_permission(colour, F.lit("PERMIT")).alias("permission"))


@query("""SELECT seq, ['INFO', 'MINOR', 'MODERATE', 'SEVERE', 'EXTREME'][severity + 1] AS name, severity AS rank, greatest(0, severity - 1) AS demoted, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS alert, CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 0 END AS chain, CASE WHEN k % 2 = 0 AND observed_at > 1705000000 THEN 'SCHEDULED' ELSE 'ACTIVE' END AS state,
    CASE k % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'STALE' ELSE 'UNAVAILABLE' END AS worst, k % 3 = 0 AS inactive FROM observed""")
def c1_severity_scale(v: Views) -> DataFrame:
    """The scale by name and rank, steps down, alerts and chain levels on it; scheduled or active; the worst of several states."""
    c = F.col
    name = classify.severity_name(c("severity"))
    states = F.when(c("k") % 4 == 0, F.array(F.lit("OK"), F.lit("OK"))).when(c("k") % 4 == 1, F.array(F.lit("OK"), F.lit("STALE"))).when(c("k") % 4 == 2, F.array(F.lit("STALE"), F.lit("UNAVAILABLE"))).otherwise(F.array(F.lit("OK"), F.lit("?")))
    return v.observed.select(
        "seq", name.alias("name"), classify.severity_rank(name).alias("rank"), classify.demoted(c("severity")).alias("demoted"), classify.from_alert(pick("CRITICAL", "WARNING", "INFO")).alias("alert"), classify.from_chain_level(pick("R1", "R2", "R3", "CLOSED", "UNKNOWN")).alias("chain"),
        classify.scheduled_or_active(F.when(c("k") % 2 == 0, c("observed_at")), F.lit(1705000000)).alias("state"), classify.worst_status(states).alias("worst"), classify.evacuation_inactive(pick("Evacuation Order Lifted", "", "Order")).alias("inactive"),
    )


@query("""SELECT seq, CASE WHEN k % 3 > 0 THEN observed_at END AS seconds, CASE WHEN k % 3 > 0 THEN strftime(make_timestamp(observed_at * 1000000), '%Y-%m-%d %H:%M:%S') END AS stamp, CAST(floor(abs(value - 50) * 2 + 0.5) / 1 AS INT) * CASE WHEN value >= 50 THEN 1 ELSE -1 END AS whole, CASE k % 5 WHEN 0 THEN 5400 WHEN 1 THEN 86400 WHEN 2 THEN 400 * 86400 END AS span FROM observed""")
def d1_times_and_numbers(v: Views) -> DataFrame:
    """Seconds cut, zero as no time, halves rounded away from zero, spans of time."""
    c = F.col
    at = F.when(c("k") % 3 > 0, c("observed_at")).otherwise(0)
    return v.observed.select(
        "seq", times.seconds_or_null(F.timestamp_micros(at * 1_000_000 + F.when(at > 0, 999_999).otherwise(0))).alias("seconds"), F.date_format(times.stamp_or_null(at), "yyyy-MM-dd HH:mm:ss").alias("stamp"), times.whole((c("value") - 50) * 2).alias("whole"),
        times.window_seconds(pick("90m", "24h", "500d", "-1h", "soon")).cast("int").alias("span"),
    )


@query("""SELECT seq, round(floor(abs(value) * 10 + 0.5) / 10, 1) AS tenth FROM (SELECT seq, (k * 25 + 5) / 100 AS value FROM observed)""")
def d8_tenths(v: Views) -> DataFrame:
    return v.observed.select("seq", times.tenth((F.col("k") * 25 + 5) / F.lit(100)).alias("tenth"))


@query("""SELECT 'W/"' || k || '-' || substr(sha256('a' || chr(0) || k % 3), 1, 16) || '"' AS tag, CAST(count(*) AS BIGINT) AS n FROM observed GROUP BY 1""")
def d13_weak_tags(v: Views) -> DataFrame:
    """A list's tag is the same for the same version and parameters only."""
    tag = times.weak_tag(F.col("k").cast("string"), F.lit("a"), (F.col("k") % 3).cast("string"))
    return v.observed.groupBy(tag.alias("tag")).agg(F.count("*").alias("n"))


@query("""SELECT seq, CASE WHEN k % 2 = 0 THEN map {'route': '4'} ELSE map {} END AS shown FROM observed""")
def d11_public_maps(v: Views) -> DataFrame:
    m = F.create_map(F.lit("route"), F.when(F.col("k") % 2 == 0, "4").otherwise(" "), F.lit("internal"), F.lit("x"))
    return v.observed.select("seq", times.public_map(m, ["internal"]).alias("shown"))


@query("""SELECT seq, CASE k % 4 WHEN 0 THEN 'ab12' WHEN 3 THEN 'ff' END AS node, CAST(CASE k % 3 WHEN 0 THEN 38.5 END AS DOUBLE) AS lat, CASE k % 3 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN [] ELSE ['c'] END AS listed FROM observed""")
def t18_keys_and_lists(v: Views) -> DataFrame:
    place = text.lat_lng(pick("38.5, -120.1", "95,0", "38.5"))
    return v.observed.select("seq", text.hex_id(pick(" AB12 ", "xyz", "a", "ff")).alias("node"), place["lat"].alias("lat"), text.list_of(pick("a,b", "", "c")).alias("listed"))


@query(f"""SELECT id, layer, severity, status, observed_at, revision FROM current_events WHERE status IN ('ACTIVE') AND layer IN (2, 5) AND severity >= 2 AND observed_at >= {T0 + 5 * 86400} ORDER BY severity DESC, observed_at DESC, id LIMIT 11""")
def p3_parsed_request(v: Views) -> DataFrame:
    """A request's words read, then applied: statuses, layers, least severity, time and page size."""
    named = {"EVACUATION": 2, "MESH": 5}
    wanted = [named[n] for n in paging.layers(["evacuation,network"])]
    rows = v.current.where(F.col("status").isin(paging.statuses(["active"])) & F.col("layer").isin(wanted) & (F.col("severity") >= paging.severity("Moderate")) & (F.col("observed_at") >= paging.moment("2024-01-06T00:00:00Z")))
    return paging.page(rows.select(*EVENT), EVENT_ORDER, paging.page_size(10))


@query("SELECT place_id, slug, name FROM places WHERE place_id = 'nation:4' UNION ALL SELECT place_id, slug, name FROM places WHERE slug = 'nation-9'")
def p8_places_by_key(v: Views) -> DataFrame:
    """A place by its id or by its slug."""
    return paging.by_key(v.places, "nation:4").unionByName(paging.by_key(v.places, "nation-9")).select("place_id", "slug", "name")


@query("SELECT id, layer, severity, status, observed_at, revision, value, lat, lng FROM current_events WHERE status IN ('ACTIVE', 'SCHEDULED') ORDER BY severity DESC, observed_at DESC, id LIMIT 51")
def j2_late_page(v: Views) -> DataFrame:
    """A page of wide rows: keys are chosen on three columns, the rest is joined to them."""
    rows = v.current.where(F.col("status").isin("ACTIVE", "SCHEDULED")).select(*EVENT, "value", "lat", "lng")
    return paging.late_page(rows, EVENT_ORDER, "id")


@query("""WITH o AS (SELECT id, severity, observed_at, row_number() OVER (ORDER BY severity DESC, observed_at DESC, id) AS n FROM current_events) SELECT id FROM o WHERE n BETWEEN 8 AND 18""")
def o4_resumed_page(v: Views) -> DataFrame:
    """A page that goes on after the seventh row of the one before, by that row's token."""
    rows = v.current.select("id", "severity", "observed_at")
    seventh = paging.page(rows, EVENT_ORDER, 10).take(7)[-1]
    mark = paging.token({c: seventh[c] for c, _ in EVENT_ORDER})
    return paging.page(rows, EVENT_ORDER, 10, paging.read_token(mark)).select("id")


@query("""SELECT place_id, CAST(substr(place_id, 8) AS INT) % 3 = 0 OR CAST(substr(place_id, 8) AS INT) >= 20 AS written FROM places""")
def w20_place_upserts(v: Views) -> DataFrame:
    """Places that are new or differ from what is stored; equal ones are not written again."""
    n = F.substring("place_id", 8, 9).cast("int")
    stored = v.places.where(n < 20)
    batch = v.places.withColumn("name", F.when(n % 3 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    return state.upsert_places(stored, batch, "place_id", ["name", "kind", "min_lat"]).select("place_id", "written")


@query(f"SELECT max(observed_at) AS newest, max(observed_at) > {T0} AS changed FROM observed")
def s3_change_stamp(v: Views) -> DataFrame:
    """When a layer was last edited, and whether that is later than what was read before."""
    c = F.col
    body = v.observed.agg(F.to_json(F.struct(F.struct((F.max("observed_at") * 1000).alias("dataLastEditDate")).alias("editingInfo"))).alias("body"))
    return feeds.edited(body, T0).select("newest", "changed")


@query("SELECT CAST(count(DISTINCT event_type) AS BIGINT) AS sources, min(observed_at) AS first_at FROM revisions")
def a2_distinct_sources(v: Views) -> DataFrame:
    """Over all events: how many sources, and when the first was stored."""
    return v.revisions.agg(F.countDistinct("event_type").alias("sources"), F.min("observed_at").alias("first_at"))


@query("""SELECT seq, CASE k % 3 WHEN 0 THEN '2024-01-01T00:00:00Z' END AS written, strftime(make_timestamp(observed_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM observed""")
def d4_stamps(v: Views) -> DataFrame:
    c = F.col
    return v.observed.select("seq", F.nullif(times.rfc3339(F.when(c("k") % 3 == 0, T0).when(c("k") % 3 == 1, 0)), F.lit("")).alias("written"), stamped("observed_at").alias("stamp"))
