"""Micro-batch jobs that keep state in versioned tables: the state functions of the batch path, run in foreachBatch.

Each batch reads the newest version below its own number and writes its own,
so a batch that runs again after a failure gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideway.operators import state


class Versions:
    """A table with one folder for each batch: full snapshots, or appended parts."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def snapshot(self, before: int) -> DataFrame:
        """The version of the batch before, or an empty table."""
        if before <= 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={before - 1}")

    def all(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")


def revise(spark: SparkSession, path: str, schema, key: str, order: list[str], compared: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch function: kept revisions are appended, the current row of each key is a snapshot."""
    full = schema.add("revision", "integer") if "revision" not in schema.names else schema
    current, log = Versions(spark, f"{path}/current", full), Versions(spark, f"{path}/revisions", full)

    def work(batch: DataFrame, n: int) -> None:
        before = current.snapshot(n)
        # The stored row stands before all rows of the batch, so the gate starts from it.
        both = before.withColumn("_stored", F.lit(0)).unionByName(batch.select(*before.drop("revision").columns).withColumns({"revision": F.lit(None).cast("int"), "_stored": F.lit(1)}))
        kept = state.revision_gate(both.withColumnRenamed("revision", "_base"), key, ["_stored", *order], compared)
        base = F.coalesce(F.max("_base").over(_by(key)), F.lit(1))
        kept = kept.withColumn("revision", (F.col("revision") + base - 1).cast("int")).select(*before.columns, "_stored").cache()
        log.write(kept.where("_stored = 1").drop("_stored"), n)
        current.write(state.latest(kept.drop("_stored"), key, ["revision"]), n)
        kept.unpersist()

    return work


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


def roll_up(spark: SparkSession, path: str, schema, edges: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A batch function: the link rollup, each batch added to the version before."""
    rollup = Versions(spark, path, schema)

    def work(batch: DataFrame, n: int) -> None:
        rollup.write(state.compact(rollup.snapshot(n), edges(batch)), n)

    return work


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Runs a stream over all that is there, then stops."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: Rows of state that a registry's nodes share.
PARTS = 1024


def registry(stream: DataFrame, retention: int, alpha: float = 0.3, least_gap: int = 30, parts: int = PARTS) -> DataFrame:
    """What is known of each node of a stream of adverts (node, gateway, at, name): told anew with each batch.

    node, at and name of its latest advert, gateways heard within ``retention``
    seconds of it, ewma of its gaps and how often it told. A late advert adds
    its gateway and its count and moves no clock back. A node with no advert
    within retention of the newest of its own batch starts anew.

    Calls cost more than adverts, so nodes are dealt to ``parts`` rows of state:
    a batch has a call for each of them, not for each node.
    """

    def folded(adverts: list, last, named, mean, n, gates, heard) -> tuple:
        seen = dict(zip(gates, heard, strict=True))
        for t, gate, said in sorted(adverts):
            if last is not None and t - last > retention:
                last, named, mean, n, seen = None, None, None, 0, {}
            if last is not None and t - last >= least_gap:
                mean = float(t - last) if mean is None else mean + alpha * (t - last - mean)
            n += 1
            seen[gate] = max(t, seen.get(gate, t))
            if last is None or t >= last:
                last, named = t, said
        seen = {g: t for g, t in sorted(seen.items()) if t >= last - retention}
        return last, named, mean, n, list(seen), list(seen.values())

    def update(_: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        known = {node: rest for node, *rest in zip(*kept.get, strict=True)} if kept.exists else {}
        came: dict = {}
        for b in batches:
            for node, t, gate, said in zip(*(b[c].tolist() for c in ("node", "at", "gateway", "name")), strict=True):
                came.setdefault(None if node != node else node, []).append((int(t), gate, said))
        for node, adverts in came.items():
            known[node] = folded(adverts, *known.get(node, (None, None, None, 0, [], [])))
        kept.update(tuple(map(list, zip(*((node, *rest) for node, rest in known.items()), strict=True))))
        told = [(node, last, named, gates, mean, n) for node in came for last, named, mean, n, gates, _ in (known[node],)]
        yield pd.DataFrame(told, columns=["node", "at", "name", "gateways", "ewma", "adverts"])

    out = "node long, at long, name string, gateways array<string>, ewma double, adverts int"
    state_ = "node array<long>, at array<long>, name array<string>, ewma array<double>, adverts array<int>, gateways array<array<string>>, heard array<array<long>>"
    part = F.when(F.col("node").isNull(), -1).otherwise(F.pmod(F.xxhash64("node"), F.lit(parts)))  # adverts without a node by themselves, so that numbers stay whole
    return stream.select("node", "gateway", "at", "name", part.alias("part")).groupBy("part").applyInPandasWithState(update, out, state_, "update", GroupStateTimeout.NoTimeout)


def cadence(stream: DataFrame, key: str, at: str, alpha: float = 0.3, least_gap: int = 30) -> DataFrame:
    """The exponential average of each key's gaps, told anew with each batch; late rows do not move a clock back."""

    def update(name: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        last, mean, n = kept.get if kept.exists else (None, None, 0)
        for t in sorted(int(t) for b in batches for t in b[at]):
            if last is not None and t - last >= least_gap:
                mean, n = (float(t - last) if mean is None else mean + alpha * (t - last - mean)), n + 1
            last = t if last is None else max(last, t)
        kept.update((last, mean, n))
        yield pd.DataFrame({key: [name[0]], "ewma": [mean], "n_gaps": [n]})

    return stream.select(key, at).groupBy(key).applyInPandasWithState(update, f"{key} long, ewma double, n_gaps int", "last long, ewma double, n int", "update", GroupStateTimeout.NoTimeout)
