"""State functions: (state, batch) -> state. They hold for a batch and, inside foreachBatch, for a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideway.operators import scan


def content_hash(*columns: str) -> Column:
    """A hash of the columns that matter, in a fixed order; equality is its meaning."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def revision_gate(observed: DataFrame, key: str, order: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """Keeps an observation when it differs from the one before it of its key; ``revision`` counts the kept ones.

    Arrival order decides, not event time: ``order`` must end in the arrival number.
    """
    w = Window.partitionBy(key).orderBy(*order)
    now = F.struct(*compared)
    rows = observed.withColumn("_first", F.row_number().over(w) == 1).withColumn("_before", F.lag(now).over(w))
    kept = rows.where(F.col("_first") | ~now.eqNullSafe(F.col("_before"))).drop("_first", "_before")
    return kept.withColumn("revision", F.row_number().over(w))


def latest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key. Each task hands on one row of a key, so a hot key is combined before it is shuffled."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(*order)).alias("_r"))
    return last.select(*(key if c == key else F.col("_r")[c].alias(c) for c in rows.columns))


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key: later duplicates are ignored."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_or_ignore(stored: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """stored and those rows of batch whose key is new; within the batch the first wins."""
    fresh = first_of(batch, keys, order).join(stored.select(*keys), list(keys), "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def last_write_wins(rows: DataFrame, key: str, stamp: str, arrival: str) -> DataFrame:
    """A reading replaces the stored one when it is as new or newer; of equal stamps the later arrival stays."""
    return latest(rows, key, [stamp, arrival])


def refreshed(rows: DataFrame, key: str, order: Sequence[str], volatile: Sequence[str]) -> DataFrame:
    """Volatile fields carried forward: an incoming null never erases what is stored."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in volatile})


def hash_lookup(batch: DataFrame, stored: DataFrame, key: str, *columns: str) -> DataFrame:
    """batch with ``unchanged``: whether what is stored under its key has the same content hash."""
    have = stored.select(key, content_hash(*columns).alias("_stored"))
    return batch.join(have, key, "left").withColumn("unchanged", F.coalesce(content_hash(*columns) == F.col("_stored"), F.lit(False))).drop("_stored")


def ordered_append(rows: DataFrame, order: Sequence[str], name: str, keep, start: int = 1) -> DataFrame:
    """rows with gapless numbers that ascend in the given order: a range sort, and the rows before each partition.

    ``keep`` stores its argument and returns it, so that the numbers of a
    partition are the same whenever it is read; one count for each partition
    reaches the driver.
    """
    stored = keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    before, starts = start, []
    for r in sorted(stored.groupBy("_part").count().collect()):
        starts.append((r["_part"], before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(starts or [(0, start)], "_part int, _start long")
    return stored.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def prune(rows: DataFrame, at: str, cutoff: int, number: str | None = None, watermark: int | None = None) -> DataFrame:
    """rows without those older than the cutoff; where a watermark is given only rows up to it, which are rolled up, may go."""
    old = F.col(at) < cutoff
    if number is not None:
        old &= F.col(number) <= watermark
    return rows.where(~F.coalesce(old, F.lit(False)))


def version_counters(revisions: DataFrame, key: str = "layer") -> DataFrame:
    """For each key the events that were created and the revisions that changed one."""
    return revisions.groupBy(key).agg(F.count_if(F.col("revision") == 1).alias("created"), F.count_if(F.col("revision") > 1).alias("changed"))


def upsert_places(stored: DataFrame, batch: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """batch with ``written``: whether a place is new or differs from what is stored; an equal one is not written again."""
    have = stored.select(key, F.struct(*compared).alias("_have"), F.lit(True).alias("_known"))
    both = batch.join(have, key, "left")
    same = F.coalesce(F.col("_known"), F.lit(False)) & F.struct(*compared).eqNullSafe(F.col("_have"))
    return both.withColumn("written", ~same).drop("_have", "_known")


def exists_flag(rows: DataFrame, stored: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """rows with whether stored has one with the same keys."""
    have = stored.select(*keys).distinct().withColumn(name, F.lit(True))
    return rows.join(have, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def transition(current: DataFrame, ids: DataFrame, to: str, at: Column) -> DataFrame:
    """New revisions of the rows named in ids that are not already in the target status."""
    hit = current.join(ids.select("id").distinct(), "id", "left_semi").where(F.col("status") != to)
    return hit.withColumns({"status": F.lit(to), "observed_at": at, "revision": F.col("revision") + 1})


def sweep(active: DataFrame, polled: DataFrame, now: Column, grace: Column, policy: Column) -> DataFrame:
    """Rows that a successful poll no longer lists, with their next status (null: they stay for now).

    policy is resolve, expire (own ``expires``) or grace (``last_seen`` and a wait).
    """
    gone = active.join(polled.select("id").distinct(), "id", "left_anti")
    seen = F.coalesce("last_seen", "observed_at")
    to = F.when(policy == "resolve", "RESOLVED").when((policy == "expire") & (F.col("expires") <= now), "EXPIRED").when((policy == "grace") & (now - seen >= grace), "RESOLVED")
    return gone.withColumn("next_status", to)


def supersede(active: DataFrame, replaced: DataFrame) -> DataFrame:
    """Active rows that a listed row replaces, ended at once, with their successor; of several the smallest id."""
    by = replaced.groupBy("id").agg(F.min("successor").alias("successor"))
    return active.join(by, "id").withColumn("next_status", F.lit("RESOLVED"))


def touch(rows: DataFrame, seen: DataFrame, at: Column, stale_before: Column) -> DataFrame:
    """last_seen set for seen ids whose mark is older than stale_before, so that most ticks write nothing."""
    flag = seen.select("id").distinct().withColumn("_seen", F.lit(True))
    stale = F.coalesce(F.col("last_seen") < stale_before, F.lit(True))
    return rows.join(flag, "id", "left").withColumn("last_seen", F.when(F.col("_seen") & stale, at).otherwise(F.col("last_seen"))).drop("_seen")


def replace_set(stored: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The difference that turns stored into wanted: rows to delete and to insert."""
    gone = stored.join(wanted, list(keys), "left_anti").select(*keys, F.lit("delete").alias("change"))
    new = wanted.join(stored, list(keys), "left_anti").select(*keys, F.lit("insert").alias("change"))
    return gone.unionByName(new)


def max_merge(stored: DataFrame, batch: DataFrame, key: str, clocks: Sequence[str]) -> DataFrame:
    """Clocks only go forward; 0 means never. Keys are compared in lower case."""
    both = stored.select(key, *clocks).unionByName(batch.select(key, *clocks))
    return both.groupBy(F.lower(key).alias(key)).agg(*(F.max(F.coalesce(c, F.lit(0))).alias(c) for c in clocks))


def rename_key(rows: DataFrame, key: str, old: str, new: str, unique: Sequence[str]) -> DataFrame:
    """Rows of the old key under the new one; where both had a row, the new key's stays."""
    moved = rows.withColumns({"_own": (F.col(key) != old).cast("int"), key: F.when(F.col(key) == old, new).otherwise(F.col(key))})
    w = Window.partitionBy(key, *unique).orderBy(F.col("_own").desc())
    return moved.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_own")


def source_health(attempts: DataFrame, sources: DataFrame, keep=None, pieces: int | None = None) -> DataFrame:
    """Status after each attempt: OK on success, else STALE while the last success is at most stale_after old, else UNAVAILABLE. With ``keep`` a source's attempts are cut into pieces, each handing on its last success."""
    cut = scan.Pieces(attempts, ["source_id"], ["sampled_at", "seq"], keep, pieces)
    ok_at = F.when(F.col("ok"), F.col("sampled_at"))
    rows = cut.carried(_earlier=(F.max(ok_at), F.max))
    last_ok = F.coalesce(F.max(ok_at).over(cut.within.rowsBetween(Window.unboundedPreceding, 0)), F.col("_earlier"))
    rows = rows.withColumn("last_success", last_ok).drop("_piece", "_earlier").join(sources.select("source_id", (3 * F.col("poll_seconds")).alias("stale_after")), "source_id")
    status = F.when(F.col("ok"), "OK").when(F.col("sampled_at") - F.col("last_success") <= F.col("stale_after"), "STALE").otherwise("UNAVAILABLE")
    return rows.withColumn("status", status)


def compact(rollup: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds new edge observations to the (a, b, day) rollup, in so many partitions where they are given."""
    fresh = edges.select("a", "b", (F.col("heard_at") - F.col("heard_at") % 86400).alias("day"), F.lit(1).cast("bigint").alias("n"), F.col("snr").alias("best_snr"), F.col("heard_at").alias("first_at"), F.col("heard_at").alias("last_at"))
    both = rollup.unionByName(fresh)
    both = both.repartition(parts, "a", "b", "day") if parts else both
    return both.groupBy("a", "b", "day").agg(F.sum("n").alias("n"), F.max("best_snr").alias("best_snr"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def seeded(seeds: DataFrame, stored: DataFrame, owned: Sequence[str], runtime: Sequence[str]) -> DataFrame:
    """Configuration owns some columns, the runtime others; rows that only one side has stay."""
    s = seeds.select("source_id", *(F.col(c).alias(f"_{c}") for c in owned), F.lit(True).alias("_seed"))
    both = stored.join(s, "source_id", "full")
    return both.select("source_id", *(F.when(F.col("_seed"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in owned), *runtime)
