"""The poll tick: what one poll of the sources does to the event tables, as one change.

A poll is rows of three kinds. ``attempt``: a source was asked; ``ok``, else
``error``; ``suppressed`` says that its list proves nothing about absence.
``event``: what a source lists. ``superseded``: an id that the poller knows to be
replaced, and by what. The tick, in this order:

1. hash gate and upsert: a listed event that is new or whose content differs
   becomes its next revision; one that is equal is written only if ``force``
   says that what the hash leaves out has changed, without a revision;
2. touch: equal events of sources that answered are marked as seen, if their
   mark is older than a window;
3. supersede: active events of answering sources that a successor replaces are
   resolved at once;
4. sweep: active events that an answering, not suppressed source no longer lists
   are resolved, or expire by their own end or a grace since they were seen;
5. health: each source that was asked gets its status.

One outer join of the current rows with the poll decides all of it. The current
rows are a base and the rows that later ticks changed, folded together now and
then, so a tick writes what it changes and not what there is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideway.operators import state
from tideway.streaming.tables import Commit, Tables

#: Seconds for which a mark of being seen stands, and changes of a table that are read beside its base.
TOUCH_WINDOW, FOLD_AFTER = 3_600, 16
ACTIVE = ("ACTIVE", "SCHEDULED")
KEPT_BY_STORE = "revision int, content_hash string, first_ingested bigint, ingested_at bigint, last_seen bigint, replaced_by string, tick bigint"
HEALTH = "source_id string, policy string, expire_after bigint, poll_seconds bigint, stale_after bigint, last_attempt bigint, last_success bigint, last_error string, status string"


def event_schema(content: StructType) -> StructType:
    """Columns of an event as a poll lists it (id, source_id, status, observed_at, expires and any others), then those that the store keeps."""
    out = StructType(list(content.fields))
    for f in StructType.fromDDL(KEPT_BY_STORE).fields:
        out = out.add(f)
    return out


def moved(current: DataFrame, polled: DataFrame, attempts: DataFrame, superseded: DataFrame, health: DataFrame, now: Column, tick: Column, compared: Sequence[str], window: int = TOUCH_WINDOW) -> DataFrame:
    """(id, row, minted): the new current row of each event that the tick writes, and the revisions it makes, oldest first.

    current has the columns of event_schema; polled those of the content and
    ``force``, one row for each id; superseded (id, successor). The columns
    compared are the content that counts.
    """
    content = [c for c in polled.columns if c not in ("id", "force")]
    old = current.select("id", F.struct(*(c for c in current.columns if c != "id")).alias("old"))
    new = polled.select("id", F.struct(*content).alias("new"), state.content_hash(*compared).alias("hash"), F.coalesce("force", F.lit(False)).alias("force"))
    by = superseded.groupBy("id").agg(F.min("successor").alias("successor"))
    rows = old.join(new, "id", "full").join(by, "id", "left")
    known, listed = F.col("old").isNotNull(), F.col("new").isNotNull()
    rows = rows.withColumn("changed", listed & (~known | ~F.col("old.content_hash").eqNullSafe(F.col("hash")))).withColumn("forced", known & listed & ~F.col("changed") & F.col("force"))
    rows = rows.withColumn("source_id", F.when(F.col("changed"), F.col("new.source_id")).otherwise(F.col("old.source_id")))
    asked = attempts.select("source_id", "ok", F.coalesce("suppressed", F.lit(False)).alias("suppressed")).join(health.select("source_id", "policy", "expire_after"), "source_id", "left")
    rows = rows.join(asked, "source_id", "left").drop("source_id")
    ok = F.coalesce("ok", F.lit(False))
    touched = known & listed & ~F.col("changed") & ok & F.coalesce(F.col("old.last_seen") < now - window, F.lit(True))
    rows = rows.withColumn("touched", touched)

    changed, take = F.col("changed"), F.col("changed") | F.col("forced")
    mid = {c: F.when(take, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) for c in content}
    mid |= {
        "revision": (F.coalesce("old.revision", F.lit(0)) + changed.cast("int")).cast("int"), "content_hash": F.when(changed, F.col("hash")).otherwise(F.col("old.content_hash")),
        "first_ingested": F.coalesce("old.first_ingested", now), "ingested_at": F.when(changed, now).otherwise(F.col("old.ingested_at")), "last_seen": F.when(changed | F.col("touched"), now).otherwise(F.col("old.last_seen")),
        "replaced_by": F.when(~changed, F.col("old.replaced_by")), "tick": tick,
    }
    fields = [c for c in current.columns if c != "id"]
    rows = rows.withColumn("mid", F.struct(*(mid[c].alias(c) for c in fields)))

    judged = F.col("mid.status").isin(*ACTIVE) & ok & ~F.coalesce("suppressed", F.lit(False))
    replaced = judged & F.col("successor").isNotNull()
    seen, grace = F.coalesce("mid.last_seen", "mid.observed_at", "mid.ingested_at"), F.coalesce("expire_after", F.lit(0))
    over = F.coalesce(F.col("mid.expires") < now, F.lit(False)) | ((grace > 0) & (now - seen > grace))
    gone = judged & ~listed
    to = F.when(replaced | gone & (F.col("policy") == "resolve"), "RESOLVED").when(gone & (F.col("policy") == "expire") & over, "EXPIRED")
    rows = rows.withColumn("to", to).where(changed | F.col("forced") | F.col("touched") | F.col("to").isNotNull())

    end = {c: F.col(f"mid.{c}") for c in fields} | {"status": F.col("to"), "observed_at": now, "ingested_at": now, "revision": F.col("mid.revision") + 1}
    end["replaced_by"] = F.coalesce(F.when(F.col("successor").isNotNull(), F.col("successor")), F.col("mid.replaced_by"))
    end["content_hash"] = F.sha2(F.to_json(F.struct(*((F.col("id") if c == "id" else end[c]).alias(c) for c in sorted(compared))), {"ignoreNullFields": "false"}), 256)
    ended = F.when(F.col("to").isNotNull(), F.struct(*(end[c].alias(c) for c in fields)))
    rows = rows.withColumn("ended", ended)
    minted = F.filter(F.array(F.when(F.col("changed"), F.col("mid")), F.col("ended")), lambda x: x.isNotNull())
    return rows.select("id", F.coalesce("ended", "mid").alias("row"), minted.alias("minted"))


def attempted(health: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """health after the attempts: OK, else STALE while the last success is at most stale_after (3 polls) old, else UNAVAILABLE."""
    rows = health.join(attempts.select("source_id", "ok", "error"), "source_id", "left")
    asked, ok = F.col("ok").isNotNull(), F.coalesce("ok", F.lit(False))
    late = F.coalesce(now - F.col("last_success") <= F.coalesce("stale_after", 3 * F.col("poll_seconds")), F.lit(False))
    status = F.when(ok, "OK").when(late, "STALE").otherwise("UNAVAILABLE")
    return rows.select(
        "source_id", "policy", "expire_after", "poll_seconds", "stale_after", F.when(asked, now).otherwise(F.col("last_attempt")).alias("last_attempt"), F.when(ok, now).otherwise(F.col("last_success")).alias("last_success"),
        F.when(ok, "").when(asked, F.coalesce("error", F.lit(""))).otherwise(F.col("last_error")).alias("last_error"), F.when(asked, status).otherwise(F.col("status")).alias("status"),
    )


class Ticks:
    """The event tables and the batch function that ticks them.

    A batch of the stream has columns kind, poll, now, source_id, ok,
    suppressed, error, id, successor, force and those of the content. A poll is
    whole in its batch; the polls of a batch, few, are ticked one after the
    other and committed together. If a poll lists an id more than once, the row
    that is last by ``arrival`` counts.
    """

    def __init__(self, spark: SparkSession, path: str, content: StructType, compared: Sequence[str], arrival: Sequence[str], window: int = TOUCH_WINDOW):
        self.spark, self.tables, self.content, self.compared, self.arrival, self.window = spark, Tables(spark, path), content, list(compared), list(arrival), window
        self.schema = event_schema(content)
        self.health_schema = StructType.fromDDL(HEALTH)

    def seed(self, sources: DataFrame) -> None:
        """Sources (source_id, policy, expire_after, poll_seconds, stale_after) that the tables have not seen."""
        now = self.tables.newest()
        have = self.health(now)
        fresh = sources.join(have.select("source_id"), "source_id", "left_anti")
        rows = have.unionByName(fresh, allowMissingColumns=True)
        self.tables.commit(now, {"health": [self.tables.write(rows.select(*self.health_schema.names).coalesce(1), "health")]}, {})

    def health(self, at: Commit | None = None) -> DataFrame:
        return self.tables.read("health", self.health_schema, at)

    def current(self, at: Commit | None = None) -> DataFrame:
        """The current row of each event."""
        return self._latest((at or self.tables.newest()).tables.get("events", []))

    def _latest(self, folders: list[str]) -> DataFrame:
        return state.latest(self.tables.folders(folders, self.schema), "id", ["tick"])

    def revisions(self, at: Commit | None = None) -> DataFrame:
        return self.tables.read("revisions", self.schema, at)

    def __call__(self, batch: DataFrame, n: int) -> None:
        before = self.tables.newest()
        if before.marks.get("batch", -1) >= n:
            return  # committed already; the stream runs it again
        polls = sorted((r["poll"], r["now"]) for r in batch.select("poll", "now").distinct().collect())
        events, made, health = list(before.tables.get("events", [])), list(before.tables.get("revisions", [])), self.health(before)
        ticked = before.marks.get("tick", 0)
        for poll, now in polls:
            ticked += 1
            at, rows = F.lit(now).cast("long"), batch.where(F.col("poll") == poll)
            attempts = rows.where("kind = 'attempt'").groupBy("source_id").agg(F.bool_and("ok").alias("ok"), F.bool_or("suppressed").alias("suppressed"), F.max("error").alias("error"))
            listed = state.latest(rows.where("kind = 'event'").select(*self.content.names, "force", *(c for c in self.arrival if c not in self.content.names)), "id", self.arrival).select(*self.content.names, "force")
            gone = rows.where("kind = 'superseded'").select("id", "successor")
            change = moved(self._latest(events), listed, attempts, gone, health, at, F.lit(ticked).cast("long"), self.compared, self.window).persist()
            events.append(self.tables.write(change.select("id", "row.*").select(*self.schema.names), "events"))
            made.append(self.tables.write(change.select("id", F.explode("minted").alias("r")).select("id", "r.*").select(*self.schema.names), "revisions"))
            change.unpersist()
            name = self.tables.write(attempted(health, attempts, at).coalesce(1), "health")  # one row for each configured source
            health = self.tables.folders([name], self.health_schema)
        if not polls:
            return
        folded = before.marks.get("folded", 0)
        if len(events) > FOLD_AFTER:
            events = [self.tables.write(self._latest(events), "events")]
        if len(made) - folded >= FOLD_AFTER:
            made, folded = [*made[:folded], self.tables.write(self.tables.folders(made[folded:], self.schema), "revisions")], folded + 1
        self.tables.commit(before, {"events": events, "revisions": made, "health": [name]}, {"batch": n, "tick": ticked, "folded": folded})
        self.tables.clean()


def ingest(spark: SparkSession, path: str, sources: DataFrame, content: StructType, compared: Sequence[str], arrival: Sequence[str], window: int = TOUCH_WINDOW) -> tuple[Ticks, Callable[[DataFrame, int], None]]:
    """The tables at path, their sources seeded, and the function for foreachBatch."""
    ticks = Ticks(spark, path, content, compared, arrival, window)
    ticks.seed(sources)
    return ticks, ticks.__call__
