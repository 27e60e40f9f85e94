"""Severity and status ladders as columns. Severity is a number from 0 (INFO) to 4 (EXTREME)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The scale, and in the ladders below the thresholds and words of the agencies that set them.
INFO, MINOR, MODERATE, SEVERE, EXTREME = range(5)
NAMES = ("INFO", "MINOR", "MODERATE", "SEVERE", "EXTREME")


def ladder(*steps: tuple[Column, object], otherwise: object) -> Column:
    """The value of the first condition that holds."""
    (first, value), *rest = steps
    out = F.when(first, value)
    for condition, v in rest:
        out = out.when(condition, v)
    return out.otherwise(otherwise)


def plain(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NAMES)), rank + 1)


def severity_rank(name: Column) -> Column:
    return ladder(*((name == n, i) for i, n in enumerate(NAMES)), otherwise=INFO)


def from_magnitude(m: Column) -> Column:
    return ladder((m >= 5, SEVERE), (m >= 4, MODERATE), (m >= 2.5, MINOR), otherwise=INFO)


def from_wildfire(acres: Column, contained: Column) -> Column:
    """The worse of what containment and size say."""
    by_containment = ladder((contained >= 100, MINOR), (contained < 50, SEVERE), otherwise=MODERATE)
    by_size = ladder((contained >= 100, INFO), ((acres >= 1000) & (contained < 50), EXTREME), (acres >= 100, SEVERE), otherwise=INFO)
    return F.greatest(by_containment, by_size)


def from_power_outage(customers: Column, planned: Column) -> Column:
    """An unknown count is MINOR and never demoted; a planned outage is one lower."""
    rank = ladder((customers >= 1000, SEVERE), (customers >= 100, MODERATE), (customers >= 10, MINOR), otherwise=INFO)
    return F.when(customers <= 0, MINOR).otherwise(F.greatest(F.lit(INFO), rank - planned.cast("int")))


def from_psps_stage(stage: Column) -> Column:
    return ladder((F.lower(stage).contains("warning"), SEVERE), (F.lower(stage).contains("watch"), MODERATE), otherwise=SEVERE)


def evacuation_level(status: Column) -> Column:
    """Null for an inactive status; what is not understood is a WARNING."""
    s = plain(status)
    has = lambda *words: F.greatest(*(s.contains(w).cast("int") for w in words), F.lit(0)) == 1
    return ladder(
        ((s == "") | has("lifted", "normal", "all clear", "all-clear", "repopulat", "no evac"), F.lit(None).cast("string")),
        (has("order", "mandatory"), "ORDER"), (has("shelter"), "SHELTER_IN_PLACE"), (has("warning"), "WARNING"), (has("advisory", "voluntary"), "ADVISORY"), otherwise="WARNING",
    )


def from_evacuation_level(level: Column) -> Column:
    return ladder((level == "ORDER", EXTREME), (level.isin("WARNING", "SHELTER_IN_PLACE"), SEVERE), (level == "ADVISORY", MODERATE), otherwise=INFO)


def from_lane_closure(facility: Column, kind: Column, lanes: Column, total: Column) -> Column:
    """The closure's type comes before its list of lanes; a ramp that closes is a detour."""
    closed = F.when(F.lower(F.coalesce(facility, F.lit(""))).contains("ramp"), MODERATE).otherwise(SEVERE)
    k = plain(kind)
    listed = F.filter(F.transform(F.split(F.coalesce(lanes, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    travel, every = F.size(F.filter(listed, lambda t: t.rlike("^[0-9]+$"))), F.exists(listed, lambda t: F.lower(t) == "all")
    other = F.size(F.filter(listed, lambda t: ~t.rlike("^[0-9]+$") & (F.lower(t) != "all")))
    return ladder(
        (k == "full", closed), (k.isin("one-way traffic", "alternating lanes"), MODERATE), (k == "traffic break", MINOR),
        (every | ((total > 0) & (travel >= total)), closed), (travel > 0, MODERATE), (other > 0, MINOR), otherwise=MODERATE,
    )


def from_nws_severity(s: Column) -> Column:
    return ladder((s == "Extreme", EXTREME), (s == "Severe", SEVERE), (s == "Moderate", MODERATE), (s == "Minor", MINOR), otherwise=INFO)


def from_road_impact(impact: Column) -> Column:
    """Null for an unknown impact, so that the caller falls back."""
    i = plain(impact)
    return ladder((i == "severe", SEVERE), (i == "moderate", MODERATE), (i == "light", MINOR), (i == "none", INFO), otherwise=F.lit(None).cast("int"))


def from_fire_weather(state: Column) -> Column:
    s = F.lower(state)
    return ladder((s.isin("red-flag", "red_flag"), SEVERE), (s == "elevated", MODERATE), otherwise=INFO)


def place_mode(evacuation_levels: Column, max_active: Column, max_wildfire: Column, fire_weather: Column, evacuation_unknown: Column, any_unknown: Column) -> Column:
    """ACTIVE, WATCH or QUIET. An unknown evacuation level counts as active."""
    return ladder(
        (F.exists(evacuation_levels, lambda x: x != "ADVISORY"), "ACTIVE"), (max_active >= EXTREME, "ACTIVE"), (max_wildfire >= SEVERE, "ACTIVE"),
        (max_active >= SEVERE, "WATCH"), (F.size(evacuation_levels) > 0, "WATCH"), (F.lower(fire_weather).isin("elevated", "red-flag"), "WATCH"),
        (evacuation_unknown, "WATCH"), (any_unknown & (max_active >= MODERATE), "WATCH"), otherwise="QUIET",
    )


def worst_status(statuses: Column) -> Column:
    """OK, STALE or UNAVAILABLE; a status it does not know is UNAVAILABLE."""
    rank = F.array_max(F.transform(statuses, lambda s: ladder((s == "OK", 0), (s == "STALE", 1), otherwise=2)))
    return ladder((rank == 0, "OK"), (rank == 1, "STALE"), otherwise="UNAVAILABLE")


#: Evacuation levels from the highest.
EVACUATION_RANK = {"ORDER": 4, "SHELTER_IN_PLACE": 3, "WARNING": 2, "ADVISORY": 1}


def demoted(rank: Column, by: int = 1) -> Column:
    """A severity so many steps lower, INFO at least."""
    return F.greatest(F.lit(INFO), rank - by)


def evacuation_inactive(status: Column) -> Column:
    """Whether a status says that a zone is no longer under an order; a blank one does not say so."""
    s = plain(status)
    return (s != "") & evacuation_level(status).isNull()


def from_alert(severity: Column) -> Column:
    """Severity of a road alert's own three steps."""
    return ladder((severity == "CRITICAL", SEVERE), (severity == "WARNING", MODERATE), otherwise=INFO)


def from_chain_level(level: Column) -> Column:
    """Chain levels R1 to R3 and closures."""
    return ladder((level.isin("R3", "CLOSED"), SEVERE), (level == "R2", MODERATE), (level == "R1", MINOR), otherwise=INFO)


def from_road(status: Column, congestion: Column) -> Column:
    """A road's status counts before its congestion."""
    return ladder((status == "CLOSED", SEVERE), (status.isin("RESTRICTED", "MAINTENANCE"), MODERATE), (congestion.isin("SEVERE", "HEAVY"), MODERATE), (congestion == "MODERATE", MINOR), otherwise=INFO)


def congestion(delay_minutes: Column) -> Column:
    return ladder((delay_minutes >= 20, "SEVERE"), (delay_minutes >= 10, "HEAVY"), (delay_minutes >= 5, "MODERATE"), (delay_minutes >= 2, "LIGHT"), otherwise="CLEAR")


def incident_step(kind: Column, said: Column, closure: Column = None) -> Column:
    """CRITICAL, WARNING or INFO by an incident's words, the worst first; what they do not tell is a WARNING."""
    t = F.lower(F.concat_ws(" ", kind, said))
    has = lambda *words: F.greatest(*(t.contains(w).cast("int") for w in words), F.lit(0)) == 1
    return ladder(
        (has("full-closure", "fatal", "injury", "fire", "overturn"), "CRITICAL"), ((closure if closure is not None else F.lit(False)) | has("collision", "hazard", "closure"), "WARNING"),
        (has("assist", "maintenance", "traffic advisory"), "INFO"), otherwise="WARNING",
    )


def from_incident(kind: Column, said: Column) -> Column:
    return from_alert(incident_step(kind, said))


def alert_step(impact: Column, closure: Column, said: Column, distant: Column) -> Column:
    """CRITICAL, WARNING or INFO of a road alert: its impact where that is told, else its type and words; INFO far from the route."""
    mild = F.lower(said).contains("assistance") | F.lower(said).contains("maintenance")
    told = ladder((impact == "severe", "CRITICAL"), (impact.isin("moderate", "light"), "WARNING"), (impact == "none", "INFO"), (closure, "CRITICAL"), (mild, "INFO"), otherwise="WARNING")
    return F.when(distant, "INFO").otherwise(told)


def scheduled_or_active(starts: Column, now: Column) -> Column:
    """SCHEDULED before a stated start, else ACTIVE."""
    return F.when(F.coalesce(starts > now, F.lit(False)), "SCHEDULED").otherwise("ACTIVE")


#: Reasons that a road condition gives, in the order in which they count.
REASONS = (
    ("due to snow", "snow"), ("due to ice", "ice"), ("due to construction", "construction"), ("due to rock slide", "rockslide"), ("due to mudslide", "mudslide"), ("due to fire", "fire"), ("due to flooding", "flooding"), ("due to accident", "accident"),
    ("for the winter", "winter_closure"), ("winter closure", "winter_closure"), ("for the season", "seasonal_closure"),
)


def condition_reason(said: Column) -> Column:
    return ladder(*((F.lower(said).contains(p), r) for p, r in REASONS), otherwise="")


def burn_colour(status: Column) -> Column:
    """What a burn line's colour allows."""
    s = plain(status)
    return ladder((s == "green", "YES"), (s == "red", "NO"), (s == "orange", "MARGINAL"), otherwise="UNKNOWN")


def burn_day(status: Column) -> Column:
    """An aggregate over a county's lines, each with its colour or null where it was not heard: any no is a no, then any marginal; a yes needs every line."""
    day = burn_colour(F.coalesce(status, F.lit("")))
    any_of = lambda d: F.bool_or(day == d)
    return F.when(any_of("NO"), "NO").when(any_of("MARGINAL"), "MARGINAL").when(any_of("YES") & ~any_of("UNKNOWN"), "YES").otherwise("UNKNOWN")


def burn_permission(day: Column, calfire: Column) -> Column:
    """The stricter of two authorities; permission needs both to be known."""
    return ladder(((day == "NO") | (calfire == "SUSPENDED"), "PROHIBITED"), ((day == "YES") & calfire.isin("PERMIT", "OPEN"), "ALLOWED"), otherwise="UNKNOWN")


def burn_headline(day: Column, calfire: Column) -> Column:
    allowed = burn_permission(day, calfire)
    return ladder(
        (allowed == "ALLOWED", "Burn day"), (calfire == "SUSPENDED", "Burning suspended by CAL FIRE"), (allowed == "PROHIBITED", "No-burn day"), ((day == "MARGINAL") & calfire.isin("PERMIT", "OPEN"), "Burn day above 3,500 ft only"), otherwise="Burn status unknown",
    )
