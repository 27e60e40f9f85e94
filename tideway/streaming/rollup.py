"""Compaction of receptions behind a watermark: raw rows become a rollup by day, chunk by chunk, then old rows go.

Both tables are kept by spans of time, a day or more, and a commit names the
folder of each span. A chunk takes the receptions above the mark up to a number
of ids, adds their edges to the rollup of the spans that they touch, and commits
those together with the new mark, which moves over every row that was read,
resolvable or not. No other span is read or written. Pruning drops rolled-up
days before a cutoff, and receptions before another, but only those up to the
mark, so that a stalled compaction loses nothing. A run that dies goes on from
the last commit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideway.operators import state
from tideway.streaming.tables import Commit, Tables

DAY = 86_400
#: Ids that one chunk takes at most, and the mark before any.
CHUNK, NONE = 50_000_000, -(1 << 62)
ROLLUP = "a string, b string, day bigint, n bigint, best_snr int, first_at bigint, last_at bigint"


def span_of(folder: str) -> int:
    return int(folder.rsplit("span=", 1)[1].split("/")[0])


class Rollup:
    """raw receptions (obs_id, heard_at, ...), obs_id ascending as they arrive, and their links by day; ``edges`` makes the links of receptions. Folders hold ``span`` seconds, whole days."""

    def __init__(self, spark: SparkSession, path: str, raw: StructType, edges: Callable[[DataFrame], DataFrame], chunk: int = CHUNK, span: int = DAY):
        self.spark, self.tables, self.edges, self.chunk, self.span = spark, Tables(spark, path), edges, chunk, span
        self.raw_schema, self.schema = raw, StructType.fromDDL(ROLLUP)

    def _by_span(self, rows: DataFrame, table: str, at: str) -> list[str]:
        """Writes rows by spans of the column ``at``, and names the folder of each; the files of one span are several where it is large."""
        rows = rows.withColumn("span", F.col(at) - F.pmod(F.col(at), F.lit(self.span))).persist()
        spans = sorted(r[0] for r in rows.select("span").distinct().collect())  # no more than the spans that are kept
        name = self.tables.write(rows, table, "span")
        rows.unpersist()
        return [f"{name}/span={d}" for d in spans]

    def receptions(self, at: Commit | None = None) -> DataFrame:
        return self.tables.read("raw", self.raw_schema, at)

    def links(self, at: Commit | None = None) -> DataFrame:
        return self.tables.read("links", self.schema, at)

    def add(self, batch: DataFrame, n: int) -> None:
        """Stores a batch of receptions, once."""
        before = self.tables.newest()
        if before.marks.get("batch", -1) < n:
            rows = batch.select(*self.raw_schema.names)
            self.tables.commit(before, {"raw": before.tables.get("raw", []) + self._by_span(rows, "raw", "heard_at")}, {"batch": n})

    def compact(self) -> int:
        """Rolls up all that is above the mark, and returns the number of chunks that it took."""
        took = 0
        while self.step():
            took += 1
        return took

    def step(self) -> bool:
        """One chunk and one commit; False where nothing is above the mark."""
        before = self.tables.newest()
        mark, raw = before.marks.get("mark", NONE), self.receptions(before)
        first = raw.where(F.col("obs_id") > mark).agg(F.min("obs_id")).first()[0]
        if first is None:
            return False
        rows = raw.where((F.col("obs_id") >= first) & (F.col("obs_id") < first + self.chunk))
        top = rows.agg(F.max("obs_id")).first()[0]
        fresh = state.compact(self.spark.createDataFrame([], self.schema), self.edges(rows)).persist()
        links = before.tables.get("links", [])
        touched = {r[0] - r[0] % self.span for r in fresh.select("day").distinct().collect()}
        old = {f for f in links if span_of(f) in touched}
        both = self.tables.folders(sorted(old), self.schema).unionByName(fresh)
        both = both.groupBy("a", "b", "day").agg(F.sum("n").alias("n"), F.max("best_snr").alias("best_snr"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
        new = self._by_span(both, "links", "day") if touched else []
        fresh.unpersist()
        self.tables.commit(before, {"links": [f for f in links if f not in old] + new}, {"mark": top})
        return True

    def prune(self, raw_before: int, links_before: int) -> None:
        """Drops receptions before raw_before that are rolled up, and the links of days before links_before. Only spans with such times are read."""
        before = self.tables.newest()
        raw, links, mark = before.tables.get("raw", []), before.tables.get("links", []), before.marks.get("mark", NONE)
        old = [f for f in raw if span_of(f) < raw_before]
        stay = state.prune(self.tables.folders(old, self.raw_schema), "heard_at", raw_before, "obs_id", mark)
        raw = [f for f in raw if span_of(f) >= raw_before] + (self._by_span(stay, "raw", "heard_at") if old else [])
        cut = [f for f in links if span_of(f) < links_before < span_of(f) + self.span]
        links = [f for f in links if span_of(f) >= links_before] + (self._by_span(self.tables.folders(cut, self.schema).where(F.col("day") >= links_before), "links", "day") if cut else [])
        if (raw, links) != (before.tables.get("raw", []), before.tables.get("links", [])):
            self.tables.commit(before, {"raw": raw, "links": links}, {})
        self.tables.clean()


def maintained(rollup: Rollup, raw_days: int, links_days: int) -> Callable[[DataFrame, int], None]:
    """A batch function: stores the batch, rolls up, then prunes by days before the newest reception."""

    def work(batch: DataFrame, n: int) -> None:
        rollup.add(batch, n)
        rollup.compact()
        newest = rollup.receptions().agg(F.max("heard_at")).first()[0]
        if newest is not None:
            rollup.prune(newest - raw_days * DAY, newest - newest % DAY - links_days * DAY)

    return work
