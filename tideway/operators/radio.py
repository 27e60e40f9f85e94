"""The radio mesh: who is there, who is reached, what each node last told, and which nodes relay."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import geo
from tideway.operators import mesh, series


def presence(nodes: DataFrame, now: Column, k: float = 3.0, floor: int = 3_600, ceiling: int = 86_400, relay: int = 21_600) -> DataFrame:
    """nodes (node, heard_at, relayed_at, adverts, ewma) with window and present: heard within k times its own cadence, between floor and ceiling (the floor while it has told fewer than two adverts), or credited with a relay lately."""
    known = (F.col("adverts") >= 2) & (F.col("ewma") > 0)
    window = F.when(known, F.least(F.lit(float(ceiling)), F.greatest(F.lit(float(floor)), k * F.col("ewma")))).otherwise(float(floor))
    heard = now - F.col("heard_at") <= window
    passed = F.coalesce((F.col("relayed_at") > 0) & (now - F.col("relayed_at") <= relay), F.lit(False)) & F.lit(relay > 0)
    return nodes.withColumn("window", window).withColumn("present", F.coalesce(heard, F.lit(False)) | passed)


def reachability(reports: DataFrame, now: Column, window: int) -> DataFrame:
    """node, reachability over all reporters (node, last_success, last_attempt): by the latest success, else the latest attempt; UNKNOWN when neither is recent."""
    ok, tried = F.max("last_success"), F.max("last_attempt")
    return reports.groupBy("node").agg(F.when(now - ok <= window, "REACHABLE").when(now - tried <= window, "UNREACHABLE").otherwise("UNKNOWN").alias("reachability"))


def best_report(reports: DataFrame) -> DataFrame:
    """node, its telemetry (of the latest success), and its name (by priority, then reporter; the first that is not blank). reports: (node, reporter, priority, name, last_success, battery, uptime)."""
    named = F.when(F.trim(F.coalesce("name", F.lit(""))) != "", F.struct(-F.col("priority"), F.col("reporter")))
    told = F.when(F.col("last_success").isNotNull(), F.struct("last_success", "priority", "reporter"))
    return reports.groupBy("node").agg(F.max_by(F.struct("reporter", "last_success", "battery", "uptime"), told).alias("t"), F.min_by("name", named).alias("name")).select("node", "name", "t.*")


def reporter_health(accepted: DataFrame, now: Column, stale: int, dead: int = 4) -> DataFrame:
    """reporter, health by its latest accepted report: OK up to ``stale`` seconds, STALE up to ``dead`` times that, then DEAD; UNKNOWN for one never heard."""
    age = now - F.max("accepted_at")
    return accepted.groupBy("reporter").agg(F.when(age.isNull(), "UNKNOWN").when(age <= stale, "OK").when(age <= dead * stale, "STALE").otherwise("DEAD").alias("health"))


def broker_delivery(brokers: DataFrame) -> DataFrame:
    """One row: how many brokers (url, problem; a blank problem delivers) deliver, and what keeps the others from it."""
    deaf = F.when(F.coalesce("problem", F.lit("")) != "", F.concat_ws(" ", "url", "problem"))
    by = brokers.agg(F.count("*").alias("n"), F.count(deaf).alias("deaf"), F.array_join(F.array_sort(F.collect_list(deaf)), "; ").alias("why"))
    told = F.when(F.col("deaf") > 0, F.concat("deaf", F.lit(" of "), "n", F.lit(" MQTT brokers not delivering: "), "why")).otherwise("")
    return by.select((F.col("n") - F.col("deaf")).alias("delivering"), told.alias("problem"))


def merged(heard: DataFrame, reported: DataFrame, relayed: DataFrame, box: tuple[float, float, float, float], keep_relayed: int, now: Column) -> DataFrame:
    """Nodes of three sources in one row each: adverts heard (key, name, lat, lng, heard_at), monitors' reports (key, which may be short, name, last_success) and relay credits (key, relayed_at).

    A short reported key is promoted to the one full key it starts; where none
    or several do it stays. A node placed outside the box is left out unless a
    monitor holds it; a node only credited with a relay is kept for
    ``keep_relayed`` seconds.
    """
    full = heard.select("key").distinct()
    short = reported.select(F.lower("key").alias("prefix"))
    promoted = mesh.unique_prefix(short, full, lengths=(2, 4, 6, 8))
    r = reported.withColumn("prefix", F.lower("key")).join(promoted.withColumnRenamed("key", "whole"), "prefix", "left").groupBy(F.coalesce("whole", "prefix").alias("key")).agg(F.max_by("name", F.coalesce("last_success", F.lit(0))).alias("reported_name"), F.max("last_success").alias("last_success"))
    h = heard.groupBy("key").agg(F.max_by(F.struct("name", "lat", "lng"), "heard_at").alias("h"), F.max("heard_at").alias("heard_at"))
    c = relayed.groupBy("key").agg(F.max("relayed_at").alias("relayed_at"))
    rows = h.join(r.withColumn("held", F.lit(True)), "key", "full").join(c, "key", "full").select("key", F.coalesce("h.name", "reported_name").alias("name"), "h.lat", "h.lng", "heard_at", "last_success", "relayed_at", F.coalesce("held", F.lit(False)).alias("held"))
    inside = F.coalesce(F.col("lat").between(box[0], box[2]) & F.col("lng").between(box[1], box[3]), F.col("lat").isNull())
    recent = F.coalesce(now - F.col("relayed_at") <= keep_relayed, F.lit(False))
    return rows.where((inside | F.col("held")) & (F.col("held") | F.col("heard_at").isNotNull() | recent))


def advanced(clocks: DataFrame, prior: DataFrame, key: str, names: list[str]) -> DataFrame:
    """clocks of nodes one of whose clocks is beyond what is stored; 0 is never."""
    have = prior.select(key, *(F.col(n).alias(f"_{n}") for n in names))
    moved = reduce(Column.__or__, [F.coalesce(n, F.lit(0)) > F.coalesce(f"_{n}", F.lit(0)) for n in names])
    return clocks.join(have, key, "left").where(moved).select(clocks.columns)


def stable_positions(fixes: DataFrame, metres: float = 150.0, decimals: int = 4) -> DataFrame:
    """key, at, lat, lng: the position that stands after each fix (key, at, lat, lng): the one before while a fix lies within so many metres of it, else the fix, rounded.

    Each key's fixes come in order and are streamed; what is remembered is the
    position that stands.
    """
    schema = "key string, at long, lat double, lng double"

    def fold(batches):
        from math import cos, hypot, radians

        now, held = None, None
        for b in batches:
            out = []
            for key, _, lat, lng in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if key != now:
                    now, held = key, None
                if held is None or hypot((held[1] - lng) * geo.DEGREE_M * cos(radians((held[0] + lat) / 2)), (held[0] - lat) * geo.DEGREE_M) > metres:
                    held = round(lat, decimals), round(lng, decimals)
                out.append(held)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.float64())], names=["key", "at", "lat", "lng"])

    ordered = fixes.select(F.col("key").cast("string").alias("key"), F.col("at").cast("long").alias("at"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).repartition("key").sortWithinPartitions("key", "at")
    return ordered.mapInArrow(fold, schema)


def cadence(adverts: DataFrame, key: str, at: str) -> DataFrame:
    """key, ewma, adverts: each node's average gap and how often it told."""
    n = adverts.groupBy(key).agg(F.count("*").alias("adverts"), F.max(at).alias("heard_at"))
    return n.join(series.ewma(adverts, key, at).select(key, "ewma"), key, "left")


def overlay(events: DataFrame, activity: DataFrame, clocks: dict[str, str]) -> DataFrame:
    """events (node …) with their clocks replaced by those of the activity table (node …) where it has them; a clock of 0 is no clock."""
    have = activity.select(F.lower("node").alias("_node"), *(F.nullif(c, F.lit(0)).alias(f"_{c}") for c in clocks.values()))
    both = events.join(have, F.lower("node") == F.col("_node"), "left")
    return both.withColumns({e: F.coalesce(f"_{a}", e) for e, a in clocks.items()}).select(events.columns)


def archive(samples: DataFrame, key: str, at: str, since: int, until: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Samples in [since, until) by time, ``most`` at most for each key, with ``truncated``; and a row for each key: first and last sample, how many there are in all, cadence and reboots within the span."""
    rows = samples.where((F.col(at) >= since) & (F.col(at) < until))
    w = Window.partitionBy(key)
    numbered = rows.withColumns({"_n": F.row_number().over(w.orderBy(at, "seq")), "_all": F.count("*").over(w)})
    cover = samples.groupBy(key).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"))
    again = series.reboots(rows, key, [at, "seq"]).groupBy(key).agg(F.count("*").alias("reboots"))
    told = cover.join(series.cadence(rows, key, at), key, "left").join(again, key, "left").withColumn("reboots", F.coalesce("reboots", F.lit(0)))
    return numbered.where(F.col("_n") <= most).withColumn("truncated", F.col("_all") > most).drop("_n", "_all"), told


def drained(waiting: DataFrame, order: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Receptions that a bounded buffer still holds at a tick, the newest ``most`` in their order; and one row of how many were kept and dropped."""
    kept = waiting.orderBy(F.desc(order)).limit(most)
    told = waiting.agg(F.count("*").alias("n")).select(F.least("n", F.lit(most)).alias("kept"), F.greatest(F.col("n") - most, F.lit(0)).alias("dropped"))
    return kept.orderBy(order), told


def region_links(links: DataFrame, nodes: DataFrame, inside: Column) -> tuple[DataFrame, DataFrame]:
    """Links (a, b …) whose ends both have a place in nodes (node, lat, lng), one of them in the region, and the nodes to show: the region's and those links' ends."""
    at = lambda c: nodes.select(F.col("node").alias(c), inside.alias(f"in_{c}"))
    kept = links.join(at("a"), "a").join(at("b"), "b").where("in_a OR in_b").drop("in_a", "in_b")
    shown = nodes.where(inside).select("node").unionByName(kept.select(F.col("a").alias("node"))).unionByName(kept.select(F.col("b").alias("node"))).distinct()
    return kept, shown
