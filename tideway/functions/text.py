"""Text functions as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings that are made one before texts are compared, by plain substring.
SPELLINGS = (("hwy", "highway"), ("nb", "northbound"), ("sb", "southbound"), ("eb", "eastbound"), ("wb", "westbound"), ("incident", "inc"), ("closure", "closed"))
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Words that make "<name> fire" the name of something else.
NOT_A_FIRE = "station stn sta road rd dept department district protection house hall lookout camp academy trail safe council company co engine crew chief authority prevention lane ln way drive dr street st".split()


def swap(x: Column, *pairs: tuple[str, str]) -> Column:
    """Each regular expression replaced in turn."""
    return reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), pairs, x)


#: What two reports of one thing may differ in: a date by numbers or by month, a time of day, punctuation.
DATE, NAMED_DATE, TIME_OF_DAY, PUNCTUATION = r"\d{1,2}/\d{1,2}/\d{4}", r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\s+\d{1,2}\s+\d{4}\b", r"\b\d{1,2}:\d{2}\s*([ap]m)?\b", r"[.,;:!?()-]"


def normalized(text: Column) -> Column:
    """Lower case, one space, no dates, times or punctuation, one spelling."""
    t = swap(F.lower(text), (r"\s+", " "), *((p, "") for p in (DATE, NAMED_DATE, TIME_OF_DAY, PUNCTUATION)))
    return F.trim(reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), SPELLINGS, t))


def signature(*parts: Column) -> Column:
    """SHA-256 of normalized parts."""
    return F.sha2(F.concat_ws("|", *(normalized(p) for p in parts)), 256)


def html_text(html: Column) -> Column:
    """Tags become spaces, entities characters, white space one space."""
    t = F.regexp_replace(html, "<[^>]*>", " ")
    t = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), ENTITIES, t)
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def br_segments(html: Column) -> Column:
    """The non-blank parts between line breaks, without tags."""
    parts = F.split(html, r"(?i)<br\s*/?>")
    return F.filter(F.transform(parts, html_text), lambda s: s != "")


def slug(name: Column) -> Column:
    return swap(F.lower(name), ("[^a-z0-9]+", "-"), ("^-+|-+$", ""))


def fire_key(name: Column) -> Column:
    """A fire's name for joining: without a closing " fire", letters and digits only."""
    return swap(F.lower(F.trim(name)), (r"\s+fire$", ""), ("[^a-z0-9]", ""))


#: Letters of a fire's name at least.
SHORTEST = 3


def last_word(name: Column) -> Column:
    """The letters and digits that end a name, in lower case; blank where it ends otherwise."""
    return F.lower(F.regexp_extract(name, r"([A-Za-z0-9]+)\z", 1))


def words_before_fire(text: Column) -> Column:
    """What last_word may be of the names that names_fire finds in text: each word before "fire", and the blank."""
    words = F.regexp_extract_all(text, F.lit(r"(?i)([a-z0-9]+)(?=\s+fire)"), F.lit(1))
    return F.array_union(F.transform(words, F.lower), F.array(F.lit("")))


def names_fire(text: Column, name: Column) -> Column:
    """Whether text names "<name> fire" as such, not a station, road or district called so."""
    quoted = F.concat(F.lit(r"(?i)\b\Q"), name, F.lit(r"\E\s+fire\b(?!\s+(?:" + "|".join(NOT_A_FIRE) + r")(?![a-z]))"))
    return (F.length(name) >= SHORTEST) & F.rlike(text, quoted)


def highway_number(label: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(label), r"(?:us|i|sr|ca|hwy|highway|state route)[\s-]*(\d+)", 1), F.lit(""))


def trim_state(name: Column) -> Column:
    return F.regexp_replace(name, "(, CA|, California)$", "")


def enum_word(s: Column) -> Column:
    """RED_FLAG -> Red flag."""
    t = F.lower(F.replace(s, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 10_000))


def counted(n: Column, one: str, many: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" "), F.when(n == 1, one).otherwise(many))


def outage_headline(customers: Column, planned: Column, county: Column) -> Column:
    what = F.when(planned, "Planned outage").otherwise("Power outage")
    size = F.when(customers > 0, F.concat(F.lit(" — "), counted(customers, "customer", "customers"))).otherwise("")
    return F.concat(what, size, F.lit(" in "), county)


def near_fire(gap_km: Column) -> Column:
    return F.when(gap_km < 0.1, "within the fire's extent").otherwise(F.format_string("%.1f km from the fire", F.bround(gap_km, 1)))


def rough_duration(seconds: Column) -> Column:
    """Minutes below an hour, hours below two days, then days."""
    n = lambda unit: F.floor(seconds / unit).cast("string")
    return F.when(seconds < 3600, F.concat(n(60), F.lit(" min"))).when(seconds < 48 * 3600, F.concat(n(3600), F.lit(" h"))).otherwise(F.concat(n(86400), F.lit(" days")))


def lag_text(seconds: Column, what: str) -> Column:
    return F.when(seconds < -60, F.concat(rough_duration(-seconds), F.lit(f" before {what}"))).when(seconds < 60, F.lit(f"as {what}")).otherwise(F.concat(rough_duration(seconds), F.lit(f" after {what}")))


def list_of(csv: Column) -> Column:
    """A comma list; the empty string is the empty list."""
    return F.filter(F.split(F.coalesce(csv, F.lit("")), ","), lambda x: x != "")


def commas(number: Column) -> Column:
    """A whole number, half away from zero, with thousands separated."""
    return F.format_number(F.floor(number + 0.5), 0)


def capital(said: Column) -> Column:
    """said with its first letter in upper case."""
    return F.concat(F.upper(F.substring(said, 1, 1)), F.substring(said, 2, 2_147_483_647))


def customers(n: Column) -> Column:
    return F.when(n == 1, "1 customer").when(n > 1, F.concat(commas(n), F.lit(" customers"))).otherwise("customer count not reported")


#: What the utility's cause codes mean.
CAUSES = {
    "PLNND SHUTDOWN": "planned shutdown", "PATROLLING": "crew patrolling the line", "AWAITING INVESTIGATION": "cause under investigation", "REPLCE TXFMR": "transformer replacement", "EMERG REPAIRS": "emergency repairs", "THRD PARTY": "third-party damage",
    "LGHTNING": "lightning", "REPAIR WIRE DWN": "downed wire", "BRKN POLE": "broken pole", "BRKN POLE EQUIPMNT": "broken pole equipment", "BRKN UG EQUIPMNT": "broken underground equipment", "DAMGE UG CABLE": "damaged underground cable", "CAR POLE": "vehicle struck a pole",
    "FOREIGN OBJ": "foreign object on the line", "TREE CONTACT": "tree contact", "FIRE": "fire", "WEATHER": "weather", "ANIMAL": "animal contact", "VEHICLE": "vehicle accident", "EQUIPMENT": "equipment failure", "NO ACCESS": "crew unable to access",
}


def lookup(table: dict[str, str], key: Column) -> Column:
    """What a fixed table says of a key; null where it says nothing."""
    return F.element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), key)


def power_cause(code: Column) -> Column:
    """A cause in words, empty for none; codes that are not known stay, in lower case."""
    c = F.trim(F.coalesce(code, F.lit("")))
    return F.coalesce(lookup(CAUSES, F.upper(c)), F.lower(c))


def power_headline(n: Column, planned: Column, cause: Column) -> Column:
    what, why = F.when(planned, "Planned outage").otherwise("Power outage"), power_cause(cause)
    return F.concat(what, F.lit(" — "), customers(n), F.when((why != "") & ~planned, F.concat(F.lit(" ("), why, F.lit(")"))).otherwise(""))


def incident_id(log_number: Column, closure_id: Column, name: Column, place: Column) -> Column:
    """caltrans:<closure>[-<log>]-<six digits of the place's hash>, chp:<log>, or chp:<slug of the name>."""
    short = F.substring(F.sha2(F.trim(F.regexp_replace(place, r"\s+", " ")), 256), 1, 6)
    closure = F.concat(F.lit("caltrans:"), F.concat_ws("-", closure_id, log_number, short))
    return F.when(closure_id.isNotNull(), closure).when(log_number.isNotNull(), F.concat(F.lit("chp:"), log_number)).otherwise(F.concat(F.lit("chp:"), slug(F.coalesce(name, F.lit("")))))


def fire_display(headline: Column) -> Column:
    """A fire's name as people write it, from a headline: without " — …" and a closing "fire", capitals only made words; empty for names below three letters."""
    name = F.trim(F.split(headline, " — ")[0])
    name = F.trim(F.regexp_replace(name, "(?i)\\s+fire$", ""))
    shown = F.when(name == F.upper(name), F.initcap(F.lower(F.regexp_replace(name, r"\s+", " ")))).otherwise(name)
    return F.when(F.length(name) >= 3, shown).otherwise("")


def mission_fire(mission: Column) -> Column:
    """The fire named in CA-<unit>-<name…>[-<flight>]; a flight is N and letters or digits, one digit at least."""
    parts = F.split(F.trim(mission), "-")
    flight = lambda p: p.rlike("^[Nn](?=[A-Za-z]*[0-9])[A-Za-z0-9]+$")
    body = F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))
    last = F.element_at(body, -1)
    kept = F.when((F.size(body) > 1) & flight(last), F.slice(body, F.lit(1), F.size(body) - 1)).otherwise(body)
    named = (F.size(parts) >= 3) & (F.lower(parts[0]) == "ca")
    return F.when(named, F.when((F.size(body) == 1) & flight(body[0]), "").otherwise(F.trim(F.array_join(kept, " ")))).otherwise("")


#: Clauses of a product line that say when, and tokens that are upper case for good reason.
TIMING = ("REMAINS IN EFFECT", "NOW IN EFFECT", "IS IN EFFECT", "IN EFFECT", "HAS BEEN EXTENDED", "HAS BEEN CANCELLED", "HAS BEEN CANCELED", "HAS EXPIRED", "IS CANCELLED", "IS CANCELED", "CANCELLED", "CANCELED", "EXTENDED")
UPPER = ("MPH", "KT", "KTS", "RH", "AQI", "UV", "AM", "PM", "PST", "PDT", "MST", "MDT", "UTC", "NWS", "CWA", "F", "C")
ZONE_TAIL = r"(?i)\s+(FOR|IN)\s+((THE)\s+)?((FIRE|FORECAST|COASTAL|MARINE)\s+)?ZONES?\b.*$"
LONGEST_REASON = 96


def headline_reason(line: Column, event: Column) -> Column:
    """Why a product stands, from its upper-case line: without the product's name, the time it holds and the zones; empty where it says no more."""
    said = F.upper(F.trim(F.coalesce(line, F.lit(""))))
    said = F.trim(F.regexp_replace(said, r"^\.\.\.|\.\.\.$", ""))
    name = F.upper(F.trim(F.coalesce(event, F.lit(""))))
    said = F.when(F.startswith(said, name), F.trim(F.substr(said, F.length(name) + 1))).otherwise(said)
    timed = F.rlike(said, F.lit("^(" + "|".join(TIMING) + ")"))
    at = F.instr(said, " FOR ")
    said = F.when(timed, F.when(at > 0, F.trim(F.substr(said, at + 5))).otherwise("")).otherwise(said)
    said = F.trim(F.regexp_replace(F.regexp_replace(said, "^FOR ", ""), ZONE_TAIL, ""))
    said = F.regexp_replace(said, r"^[ .,;]+|[ .,;]+$", "")
    calm = lambda w: F.when(F.regexp_replace(w, r"^[.,;:()]+|[.,;:()]+$", "").isin(*UPPER) | w.rlike("[0-9]"), w).otherwise(F.lower(w))
    return F.when(F.length(said) > LONGEST_REASON, "").otherwise(F.array_join(F.transform(F.split(said, r"\s+"), calm), " "))


def short_headline(event: Column, line: Column) -> Column:
    """<event> — <reason>, or the event alone, or the line where there is no event."""
    name, why = F.trim(F.coalesce(event, F.lit(""))), headline_reason(line, event)
    return F.when(name == "", F.trim(line)).when(why == "", name).otherwise(F.concat(name, F.lit(" — "), why))


#: How closure types, facilities, lanes and directions are told.
CLOSURES = {"full": "full closure", "one-way traffic": "one-way traffic control", "alternating lanes": "alternating lane closure", "moving": "moving lane closure", "traffic break": "traffic break"}
LANES = {"all": "all lanes", "rshoulder": "right shoulder", "lshoulder": "left shoulder", "rt turn ln": "right-turn lane", "lt turn ln": "left-turn lane", "median": "median", "auxiliary": "auxiliary lane", "bike lane": "bike lane", "sidewalk": "sidewalk", "center turn": "center turn lane"}
DIRECTIONS = {"east": "eastbound", "west": "westbound", "north": "northbound", "south": "southbound"}


def _tokens(csv: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def closure_phrase(kind: Column, lanes: Column, facility: Column) -> Column:
    """What is closed: by the closure's type, a shoulder where no lane is listed, and the ramp it is on."""
    k, listed = F.lower(F.trim(F.coalesce(kind, F.lit("")))), _tokens(lanes)
    shoulder = (F.size(listed) > 0) & F.forall(listed, lambda t: F.lower(t).contains("shoulder"))
    phrase = F.when(k.isin("lane", ""), F.when(shoulder, "shoulder closure").otherwise("lane closure")).otherwise(F.coalesce(lookup(CLOSURES, k), F.concat(k, F.lit(" closure"))))
    ramp = F.lower(F.trim(F.coalesce(facility, F.lit(""))))
    return F.concat(F.when(ramp == "on ramp", "on-ramp ").when(ramp == "off ramp", "off-ramp ").otherwise(""), phrase)


def direction_label(flow: Column) -> Column:
    return F.coalesce(lookup(DIRECTIONS, F.lower(F.trim(flow))), F.lit(""))


def route_label(route: Column) -> Column:
    """SR-4 -> Hwy 4, US-50 -> US 50; others as they are."""
    return swap(route, ("^SR-", "Hwy "), ("^US-", "US "))


def place_name(name: Column) -> Column:
    """One space between words, none inside brackets, and no leading from, to or at."""
    return F.trim(swap(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " ")), (r"\( ", "("), (r" \)", ")"), ("(?i)^(from|to|at) ", "")))


def closure_area(route: Column, begin: Column, end: Column, near: Column) -> Column:
    a, b, by = place_name(begin), place_name(end), F.trim(F.coalesce(near, F.lit("")))
    one = (a == "") | (b == "") | (F.lower(a) == F.lower(b))
    where = F.when((a == "") & (b == ""), "").when(one, F.concat(F.lit("at "), F.when(a == "", b).otherwise(a))).otherwise(F.concat(F.lit("from "), a, F.lit(" to "), b))
    label = F.trim(F.concat_ws(" ", route_label(route), where))
    return F.when((by != "") & ~F.lower(label).contains(F.lower(by)), F.concat(label, F.lit(", near "), by)).otherwise(label)


def lanes_text(lanes: Column) -> Column:
    named = lambda t: F.when(t.rlike("^[0-9]+$"), F.concat(F.lit("lane "), t)).otherwise(F.coalesce(lookup(LANES, F.lower(t)), t))
    return F.array_join(F.transform(_tokens(lanes), named), ", ")


def closure_description(lanes: Column, total: Column, delay: Column) -> Column:
    told, n = lanes_text(lanes), F.coalesce(total, F.lit(0))
    of = F.when(n > 0, F.concat(F.lit(" (of "), n, F.when(n == 1, " lane)").otherwise(" lanes)"))).otherwise("")
    closed = F.when(told != "", F.concat(F.lit("Closed: "), told, of, F.lit(".")))
    late = F.when(delay > 0, F.concat(F.lit("Estimated delay: "), delay, F.lit(" min.")))
    return F.concat_ws(" ", closed, late)


def highway_key(highway: Column) -> Column:
    """One spelling of a highway: Highway 4 -> hwy4, US 50 -> us50, Interstate 80 and I-80 -> i80; without a number the slug of the name."""
    h = F.lower(F.trim(highway))
    number = F.regexp_extract(h, r"(\d+[a-z]?)\s*$", 1)
    kind = F.when(h.startswith("us"), "us").when(h.rlike("^(i-|i |interstate)"), "i").otherwise("hwy")
    return F.when(number == "", slug(h)).otherwise(F.concat(kind, number))


def highway_label(route: Column) -> Column:
    """SR-4 -> Highway 4, US-50 -> US 50, I-80 -> I-80; others as they are."""
    r = F.upper(F.trim(route))
    kind, number = (F.regexp_extract(r, r"^(SR|US|I)-?\s*(\d+[A-Z]?)$", k) for k in (1, 2))
    return F.when(kind == "SR", F.concat(F.lit("Highway "), number)).when(kind == "US", F.concat(F.lit("US "), number)).when(kind == "I", F.concat(F.lit("I-"), number)).otherwise(F.trim(route))


def section_places(section: Column) -> Column:
    """The places a road section's name lists: "Arnold to Bear Valley" is two."""
    return F.filter(F.transform(F.split(section, r"(?i)\s+to\s+|\s*[-–]\s*"), lambda p: F.trim(p)), lambda p: p != "")


#: How a road condition's text ends its clause, tells hours and counties, and begins a closure.
CLAUSE_END, HOURS, IN_COUNTY, CLOSED = r"(?i)\s+-\s+|\s*-\s*(?=(?:due to|for the|motorists)\b)", r"(?i)\s+(?:from\s+\d{3,4}\s+hrs|\d+\s+hrs\s+a\s+day)\b.*$", r"(?i)\s*\([^)]*\bCo\)", r"(?i)^(?:is|are)?\s*closed\b\s*(?:from\s+|at\s+)?"


def condition_span(said: Column, kind: Column) -> Column:
    """struct(from, to): where a road condition begins and ends; empty where it does not say."""
    clause = F.regexp_replace(F.split(F.trim(said), CLAUSE_END)[0], HOURS, "")
    clean = lambda p: F.trim(F.regexp_replace(F.trim(F.coalesce(p, F.lit(""))), IN_COUNTY, ""))
    shut = F.when(clause.rlike(CLOSED), F.split(F.regexp_replace(clause, CLOSED, ""), r"(?i)\s+to\s+", 2))
    others = [F.regexp_extract(clause, r"(?i)\bfrom\s+(.+?)\s+to\s+(.+)$", k) for k in (1, 2)]
    ends = [F.when(kind == "CLOSURE", clean(F.get(shut, k))).otherwise(clean(o)) for k, o in enumerate(others)]
    return F.struct(ends[0].alias("from"), ends[1].alias("to"))


#: How a seasonal closure with a span begins, tells an offset, and what may follow its end.
SEASONAL_HEAD, OFFSET = r"^(?:is |are )?closed from ", r"^(\d+(?:\.\d+)?)\s*(?:mi|mile|miles)\.?\s+(north|south|east|west)\s+of\s+"
SEASONAL_TAIL = (
    r"\s*(?:\([a-z ,/]*\bco\)\s*)?(?:24 hrs a day\s*)?"
    r"(?:-\s*(?:due to (?:snow and ice|ice and snow|snow|ice|winter conditions|winter weather|weather conditions|weather)|for the (?:winter|season)|motorists are advised to use an alternate route)\s*)*\.?\s*$"
)


def _run_of(names: list[str]) -> str | None:
    """A pattern of one or more of the names, at whole words, with "the", spaces and slashes between them; none where there are no names."""
    known = sorted({n.strip().lower() for n in names if n.strip()}, key=lambda n: (-len(n), n))
    return r"[ /]*(?:the [ /]*)*(?:(?:%s)(?![a-z0-9])[ /]*(?:the [ /]*)*)+" % "|".join(map(re.escape, known)) if known else None


def seasonal_closure(said: Column, kind: Column, start: list[str], end: list[str], direction: str = "", most_miles: float = 0.0) -> Column:
    """Whether a condition is exactly a configured seasonal closure and says nothing else.

    The whole text is read, case and spacing aside: closed from the start, with
    at most so many miles of offset in the one direction that is configured, to
    the end, then only a county, "24 hrs a day" and the usual reasons. Any other
    wording, place, offset or second sentence is not it.
    """
    opens, closes = _run_of(start), _run_of(end)
    if not opens or not closes:
        return F.lit(False)
    told = F.lower(F.trim(F.regexp_replace(said, r"\s+", " ")))
    span = F.split(F.regexp_replace(told, SEASONAL_HEAD, ""), " to ", 2)
    first, rest = F.get(span, 0), F.get(span, 1)
    miles, way = F.regexp_extract(first, OFFSET, 1), F.regexp_extract(first, OFFSET, 2)
    near = (miles == "") | ((way == direction.strip().lower()) & (miles.try_cast("double") <= most_miles))
    place = F.regexp_replace(first, OFFSET, "")
    match = told.rlike(SEASONAL_HEAD) & rest.isNotNull() & near & place.rlike(f"^{opens}$") & rest.rlike(f"^{closes}{SEASONAL_TAIL}")
    return F.coalesce((kind == "CLOSURE") & match, F.lit(False))


def weather_phrase(coverage: Column, intensity: Column, weather: Column) -> Column:
    """A grid condition in words: chance, light, rain_showers -> Chance of light rain showers."""
    words = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("_"), F.lit(" "))
    strong = F.when(F.coalesce(intensity, F.lit("none")).isin("", "none"), words(weather)).otherwise(F.concat(words(intensity), F.lit(" "), words(weather)))
    said = F.when(coverage.isin("slight_chance", "chance"), F.concat(words(coverage), F.lit(" of "), strong)).when(F.coalesce(coverage, F.lit("")).isin("", "definite"), strong).otherwise(F.concat(words(coverage), F.lit(" "), strong))
    return capital(said)


#: Words that tell a report's state, in the order in which they count.
STATES = (r"closed?", r"chain control in effect", r"restrictions?", r"incident", r"construction")


def state_said(said: Column) -> Column:
    """The first of the words of STATES that a report has, in lower case; empty for none."""
    found = [F.nullif(F.regexp_extract(said, f"(?i)({p})", 1), F.lit("")) for p in STATES]
    return F.lower(F.coalesce(*found, F.lit("")))


def dates_said(said: Column) -> Column:
    """The distinct dates a text names, by numbers or by month, in order."""
    return F.array_distinct(F.regexp_extract_all(said, F.lit(r"\d{1,2}[/\-]\d{1,2}[/\-]\d{4}|[A-Za-z]{3}\s+\d{1,2},\s+\d{4}"), 0))


def place_case(name: Column) -> Column:
    """A name in capitals as people write it; other names stay."""
    return F.when(name == F.upper(name), F.initcap(F.lower(name))).otherwise(name)


def sign_routes(filed: Column, name: Column) -> Column:
    """Routes a message sign stands for: the one it is filed under and those its name tells, in one spelling."""
    told = F.regexp_extract_all(F.upper(name), F.lit(r"\b(?:SR|US|I|HWY)[ -]?\d+[A-Z]?\b"), 0)
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.concat(F.array(filed), told), lambda r: F.trim(r) != ""), lambda r: highway_key(swap(F.lower(r), ("^sr[ -]?", "hwy "), ("^us[ -]?", "us "), ("^i[ -]?", "i-"))))))


def acres(v: Column) -> Column:
    """12.34 -> "12.3 acres", whole numbers without a point; empty for none."""
    tenth = F.floor(v * 10 + 0.5) / 10
    shown = F.when(tenth == F.floor(tenth), F.floor(tenth).cast("bigint").cast("string")).otherwise(tenth.cast("string"))
    return F.when(v > 0, F.concat(shown, F.lit(" acres"))).otherwise("")


def hex_id(text: Column) -> Column:
    """A node's id in lower case; null where it is none."""
    t = F.lower(F.trim(text))
    return F.when(t.rlike("^[0-9a-f]{2,64}$"), t)


def lat_lng(text: Column) -> Column:
    """struct(lat, lng) of "lat,lng"; null where it does not read or is out of range."""
    parts = F.split(text, ",")
    lat, lng = (F.trim(F.get(parts, k)).try_cast("double") for k in (0, 1))
    return F.when((F.size(parts) == 2) & lat.between(-90, 90) & lng.between(-180, 180), F.struct(lat.alias("lat"), lng.alias("lng")))
