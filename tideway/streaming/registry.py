"""The registry of radio nodes as keyed state that ends: a node that stays silent is told as gone and leaves the state.

Event time decides. Each node has a timer at the end of its retention; when the
watermark passes it, no advert can still come that would have kept the node, so
it is told once with ``gone`` and forgotten, timers and gateways too. An advert
that comes after a longer silence tells the same, then starts the node anew. A
gateway leaves a node when it has not heard it within retention of its last
advert. State is what is live, not what was ever heard.

A batch's adverts of a node come as frames of bounded size and are taken in that
order, sorted within each; an advert older than the newest adds its gateway and
its count and moves no clock back.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TOLD = "node long, at long, name string, gateways array<string>, ewma double, adverts long, gone boolean"
#: The weight of a new gap in the average of gaps, and the least gap that counts.
ALPHA, LEAST_GAP = 0.3, 30


@contextmanager
def timed_state(spark: SparkSession):
    """The session with the state store that timers and maps need; what was set comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


STATE = "at long, name string, ewma double, adverts long, gateways array<string>, heard array<long>"
COLUMNS = ["node", "at", "name", "gateways", "ewma", "adverts", "gone"]


def registry(stream: DataFrame, retention: int, late: str = "10 minutes", alpha: float = ALPHA, least_gap: int = LEAST_GAP) -> DataFrame:
    """TOLD rows of a stream of adverts (node, gateway, at, name): each node's state after every batch that brings adverts, and once with ``gone`` when it ends.

    A node's state is one row, read and written once a batch, with one timer.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        at, name, mean, n, gates, times = kept.get if kept.exists else (None, None, None, 0, [], [])
        heard, out = dict(zip(gates, times, strict=True)), []

        def tell(gone: bool) -> None:
            out.append((key[0], at, name, sorted(g for g, t in heard.items() if t >= at - retention), mean, n, gone))

        for frame in frames:
            adverts = [(t, g if isinstance(g, str) else None, m if isinstance(m, str) else None) for t, g, m in zip(frame["at"].tolist(), frame["gateway"].tolist(), frame["name"].tolist(), strict=True)]
            for t, gate, said in sorted(adverts, key=lambda r: (r[0], r[1] is None, r[1] or "", r[2] is None, r[2] or "")):
                if at is not None and t - at > retention:
                    tell(True)
                    at, name, mean, n = None, None, None, 0
                    heard.clear()
                if at is not None and t - at >= least_gap:
                    mean = float(t - at) if mean is None else mean + alpha * (t - at - mean)
                n += 1
                if gate is not None:
                    heard[gate] = max(t, heard.get(gate, t))
                if at is None or t >= at:
                    at, name = t, said
        if not kept.hasTimedOut:
            tell(False)
        ends, passed = (at + retention + 1) * 1000, kept.getCurrentWatermarkMs()
        if kept.hasTimedOut or ends <= passed:
            tell(True)
            kept.remove()
        else:
            stay = {g: t for g, t in heard.items() if t >= at - retention}
            kept.update((at, name, mean, n, list(stay), list(stay.values())))
            kept.setTimeoutTimestamp(max(ends - 1, passed + 1))  # told when the watermark is later than this
        yield pd.DataFrame(out, columns=COLUMNS)

    rows = stream.select("node", "gateway", "at", "name").where("at IS NOT NULL").withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", late)
    return rows.groupBy("node").applyInPandasWithState(update, TOLD, STATE, "update", GroupStateTimeout.EventTimeTimeout)
