"""What a layer's cache serves, request by request: clean, partial and failed fetches, and how old what is served is."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SERVED = "key string, at long, seq long, status string, features long, dated long, fetched boolean"
_SERVED = pa.schema([("key", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("status", pa.string()), ("features", pa.int64()), ("dated", pa.int64()), ("fetched", pa.bool_())])


def _fold(ttl: int, keep_empty: bool):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, entry = object(), None  # entry: features, since, whether partial
        for b in batches:
            out = []
            for key, at, seq, outcome, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if key != now:
                    now, entry = key, None
                if entry and at < entry[1] + ttl:
                    out.append((key, at, seq, "STALE" if entry[2] else "OK", entry[0], entry[1] if entry[2] else None, False))
                elif outcome == "clean":
                    entry = (n, at, False) if n or keep_empty else entry
                    out.append((key, at, seq, "OK", n, None, True))
                elif outcome == "partial":
                    entry = (n, at, True) if n else entry
                    out.append((key, at, seq, "STALE", n, at, True))
                elif entry and entry[0]:
                    out.append((key, at, seq, "STALE", entry[0], entry[1], True))
                else:
                    out.append((key, at, seq, "UNAVAILABLE", 0, None, True))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SERVED, strict=True)], schema=_SERVED)

    return work


def served(requests: DataFrame, ttl: int, keep_empty: bool = True) -> DataFrame:
    """SERVED rows for requests (key, at, seq, outcome, n): outcome (clean, partial, error) and n are what a fetch at that time would bring.

    What was fetched less than ``ttl`` seconds ago is served again: as OK, or,
    where it was partial, as STALE of its time, never promoted. A clean fetch is
    OK and kept, an empty one too if ``keep_empty``; a partial one is STALE and
    kept if it has anything; a failed one serves what is kept and not empty as
    STALE, else UNAVAILABLE: an error never becomes a zero. Each key's requests
    come in order and are streamed; one entry is remembered.
    """
    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("at").cast("long").alias("at"), F.col("seq").cast("long").alias("seq"), "outcome", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))
    return rows.repartition("key").sortWithinPartitions("key", "at", "seq").mapInArrow(_fold(ttl, keep_empty), SERVED)
