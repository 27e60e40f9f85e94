"""An event's story: what its source states about times, and what changed when, on two clocks that are never mixed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import classify, text

#: Revisions of an event that are read at most, the newest.
CAP = 500
ENTRY = ("event_id", "at", "clock", "kind", "field", "label", "before", "after", "detail", "revision")


def word(name: Column) -> Column:
    """An enum's name for display; nothing for an unspecified one."""
    return F.when(F.coalesce(name, F.lit("")).rlike("^$|UNSPECIFIED$"), "").otherwise(text.enum_word(name))


def _stated() -> list[tuple[Column, Column, str, str, Column]]:
    """(condition, time, kind, label, detail) of what each layer's source states."""
    c, who, layer = F.col, F.coalesce("source_name", F.lit("")), F.col("layer")
    closure, psps = c("road.closure").isNotNull(), c("power.starts").isNotNull() | c("power.ends").isNotNull()
    road, power, mesh = layer == "ROAD_INCIDENT", layer == "POWER", layer == "MESH"
    area = layer.isin("EVACUATION", "WEATHER_ALERT")
    plain = ~layer.isin("ROAD_INCIDENT", "WILDFIRE", "EARTHQUAKE", "EVACUATION", "WEATHER_ALERT", "POWER", "MESH")
    m = "mesh."
    return [
        (road & closure, c("road.closure.planned_start"), "PLANNED_START", "Planned start", who), (road & closure, c("road.closure.set_up_at"), "SET_UP", "Set up on the road", who), (road & closure, c("road.closure.planned_end"), "PLANNED_END", "Planned end", who),
        (road & ~closure, c("effective"), "BEGINS", "Reported", who), (layer == "WILDFIRE", c("effective"), "BEGINS", "Started", who), (layer == "EARTHQUAKE", c("effective"), "BEGINS", "Occurred", who),
        (area, c("effective"), "BEGINS", "In effect", who), (area, c("expires"), "ENDS", "Ends", who),
        (power & psps, c("power.starts"), "PLANNED_START", "De-energization starts", who), (power & psps, c("power.ends"), "PLANNED_END", "De-energization ends", who), (power & psps, c("power.all_clear"), "ALL_CLEAR", "All clear", who), (power & ~psps, c("effective"), "BEGINS", "Outage began", who),
        (power, c("power.restoration"), "ESTIMATE", "Estimated restoration", F.concat(who, F.lit(" estimate; often revised"))),
        (mesh, c(m + "last_advert_at"), "ACTIVITY", "Last advert", F.lit("")), (mesh, c(m + "last_heard_at"), "ACTIVITY", "Last heard", F.lit("")), (mesh, c(m + "last_relayed_at"), "ACTIVITY", "Last relayed", F.lit("")),
        (mesh, c(m + "last_success_at"), "ACTIVITY", "Monitor last reached it", F.coalesce(m + "reporter", F.lit(""))), (mesh & ~c(m + "last_attempt_at").eqNullSafe(c(m + "last_success_at")), c(m + "last_attempt_at"), "ACTIVITY", "Monitor last tried", F.coalesce(m + "reporter", F.lit(""))),
        (plain, c("effective"), "BEGINS", "In effect", who),
    ]


def _entries(rows: DataFrame, entries: Column) -> DataFrame:
    """Rows of ENTRY from a column of arrays of structs; those without a time are left out."""
    each = rows.select(F.col("id").alias("event_id"), F.explode(entries).alias("e")).select("event_id", "e.*").where("at > 0")
    missing = {c: F.lit(None).cast("int" if c == "revision" else "string") for c in ENTRY if c not in each.columns}
    return each.withColumns(missing).select(*ENTRY)


def stated(events: DataFrame) -> DataFrame:
    """Entries of the source's clock."""
    made = [F.when(when, F.struct(at.cast("bigint").alias("at"), F.lit("SOURCE").alias("clock"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), detail.alias("detail"))) for when, at, kind, label, detail in _stated()]
    log = F.transform("road.log", lambda l: F.struct(F.unix_timestamp(F.try_to_timestamp(F.upper(l["stamp"]), F.lit("MMM d yyyy h:mma"))).alias("at"), F.lit("SOURCE").alias("clock"), F.lit("LOG").alias("kind"), l["text"].alias("label"), F.concat(F.lit("Log line "), l["number"]).alias("detail")))
    lines = _entries(events.where("layer = 'ROAD_INCIDENT' AND road.log IS NOT NULL"), log)
    return _entries(events, F.array_compact(F.array(*made))).unionByName(lines)


def status_label(before: Column, after: Column) -> Column:
    back = F.when(before == "SCHEDULED", "Now in effect").otherwise("Active again")
    return F.when(after == "ACTIVE", back).otherwise(word(after))


def changes(revisions: DataFrame) -> DataFrame:
    """Entries of our own clock: tracked values that differ between a revision and the one directly before it."""
    w = Window.partitionBy("id").orderBy("revision")
    now = {"status": F.col("status"), "severity": classify.severity_name(F.col("severity")), "acres": F.col("wildfire.acres"), "contained": F.coalesce("wildfire.contained", F.lit(0)), "level": F.col("evacuation.level"), "customers": F.col("power.customers"), "revision": F.col("revision")}
    state = F.struct(*(v.alias(k) for k, v in now.items()))
    rows = revisions.select("id", "layer", "ingested_at", state.alias("b"), F.lag(state).over(w).alias("a")).where("b.revision = a.revision + 1")
    a, b = (lambda f: F.col(f"a.{f}")), (lambda f: F.col(f"b.{f}"))
    percent = lambda v: F.concat(v.cast("string"), F.lit("%"))
    counted = lambda v: F.when(v > 0, v.cast("string")).otherwise("")

    def change(when: Column, kind: str, field: str, label: Column, before: Column, after: Column) -> Column:
        detail = F.concat(F.lit("was "), F.when(before == "", "not given").otherwise(before))
        entry = F.struct(F.col("ingested_at").alias("at"), F.lit("OWN").alias("clock"), F.lit(kind).alias("kind"), F.lit(field).alias("field"), label.alias("label"), before.alias("before"), after.alias("after"), detail.alias("detail"), b("revision").alias("revision"))
        return F.when(F.coalesce(when & (before != after), F.lit(False)), entry)

    severity, layer, acres, level = (lambda s: word(s("severity"))), F.col("layer"), (lambda s: F.coalesce(text.acres(s("acres")), F.lit(""))), (lambda s: word(s("level")))
    found = F.array(
        change(F.lit(True), "STATUS", "status", status_label(a("status"), b("status")), word(a("status")), word(b("status"))), change(F.lit(True), "CHANGED", "severity", F.concat(F.lit("Severity "), severity(b)), severity(a), severity(b)),
        change(layer == "WILDFIRE", "CHANGED", "acres", F.concat(F.lit("Size "), acres(b)), acres(a), acres(b)), change(layer == "WILDFIRE", "CHANGED", "containment", F.concat(F.lit("Containment "), percent(b("contained"))), percent(a("contained")), percent(b("contained"))),
        change(layer == "EVACUATION", "CHANGED", "level", F.concat(F.lit("Level "), level(b)), level(a), level(b)), change(layer == "POWER", "CHANGED", "customersAffected", F.concat(counted(b("customers")), F.lit(" customers out")), counted(a("customers")), counted(b("customers"))),
    )
    return _entries(rows, F.array_compact(found))


def timeline(current: DataFrame, revisions: DataFrame, cap: int = CAP) -> DataFrame:
    """Rows of ENTRY with ``position`` in the event's story and ``truncated``, whether older revisions than the cap were left out.

    current and revisions are rows of EVENT with revision and, for revisions,
    ingested_at. The first revision is always told. Equal times: the source's
    clock first.
    """
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("revision")))
    read = revisions.withColumn("_n", newest).where(F.col("_n") <= cap).drop("_n")
    ends = revisions.groupBy("id").agg(F.min_by("ingested_at", "revision").alias("at"), F.max("revision").alias("last"), F.count("*").alias("held"))
    since = F.col("last") - 1
    detail = F.when(since <= 0, "No revisions since").when(since == 1, "1 revision since").otherwise(F.concat(since, F.lit(" revisions since")))
    first = F.struct("at", F.lit("OWN").alias("clock"), F.lit("FIRST_RECORDED").alias("kind"), F.lit("First recorded").alias("label"), detail.alias("detail"), F.lit(1).alias("revision"))
    every = reduce(DataFrame.unionByName, [stated(current), _entries(ends, F.array(first)), changes(read)])
    w = Window.partitionBy("event_id").orderBy("at", F.desc("clock"), "revision", "kind", "field", "label", "detail")
    return every.withColumn("position", F.row_number().over(w)).join(ends.select(F.col("id").alias("event_id"), (F.col("held") > cap).alias("truncated")), "event_id")
