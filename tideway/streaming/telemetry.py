"""Telemetry worth storing, kept as state: the ordered tail of each series, and nothing of its history.

A sample is judged against the kept sample before it in time of its reporter,
and against the times that its node has. Samples come late, so what is kept
within ``tail`` seconds of a node's newest stays in state, and of each reporter
the one sample before that: it is all that a sample of the tail can need. One
that is older than the tail when it comes is not stored. Batches may split the
samples in any way.

Nodes share PARTS rows of state, so a batch has a call for each part and not for
each node. A part's tails are one packed value, of which only the nodes that a
batch has samples of are taken apart.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COLUMNS = ["seq", "pubkey", "reporter", "reported_at", "last_success", "uptime", "sent", "recv"]
KEPT = "seq long, pubkey string, reporter string, reported_at long, last_success double, uptime long, sent long, recv long"

#: Rows of state that the nodes share.
PARTS = 1024
#: A part's nodes with their newest times, and the kept samples of their tails, column by column.
STATE = "tails binary"
TYPES = (np.int32, np.int64, np.float64, np.int64, np.int64, np.int64)

#: Kept samples of a node: by reporter, by time, (last_success, uptime, sent, recv).
Series = dict[str, dict[int, tuple]]


def _unpacked(tails: bytes | None) -> tuple[dict[str, tuple[int, list[np.ndarray]]], list[str]]:
    """By node its newest time and its samples' columns, the first of which numbers the reporters; and those."""
    if tails is None:
        return {}, []
    nodes, newest, sizes, reporters, columns = pickle.loads(tails)  # what _packed wrote into this stream's own checkpoint
    ends = np.cumsum(sizes).tolist()
    return {n: (t, [c[end - size : end] for c in columns]) for n, t, size, end in zip(nodes, newest, sizes, ends, strict=True)}, reporters


def _packed(nodes: dict[str, tuple[int, list[np.ndarray]]], reporters: list[str]) -> bytes:
    columns = [np.concatenate([c[i] for _, c in nodes.values()]) for i in range(len(TYPES))]
    return pickle.dumps((list(nodes), [t for t, _ in nodes.values()], [len(c[0]) for _, c in nodes.values()], reporters, columns), protocol=5)


def _taken(series: Series, order: dict[str, list[int]], newest: int | None, rows: Iterator[tuple], tail: int) -> tuple[list[int], int | None]:
    """The numbers of a node's rows (number, reporter, time, what) that are worth storing, which join its series, and its newest time."""
    out = []
    for i, reporter, t, what in rows:
        if newest is not None and t < newest - tail:
            continue
        times, own = order.setdefault(reporter, []), series.setdefault(reporter, {})
        at = bisect_left(times, t)
        before = own[times[at - 1]] if at else None
        if before is not None and (what[0] is not None and what[0] == before[0] or what[1] > 0 and what[1:] == before[1:]):
            continue
        if any(t in s for s in series.values()):
            continue
        insort(times, t)
        own[t] = what
        newest = t if newest is None else max(newest, t)
        out.append(i)
    return out, newest


def kept(stream: DataFrame, tail: int, parts: int = PARTS) -> DataFrame:
    """The samples (COLUMNS) of a stream that are worth storing, each once."""
    said = lambda column: [None if v != v else v for v in column.tolist()]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nodes, reporters = _unpacked(state.get[0] if state.exists else None)
        number = {r: i for i, r in enumerate(reporters)}
        batch = pd.concat(list(frames)).sort_values(["pubkey", "seq"], kind="stable").reset_index(drop=True)[COLUMNS]
        names = batch["pubkey"].tolist()
        rows = list(zip(range(len(batch)), batch["reporter"].tolist(), batch["reported_at"].tolist(), zip(said(batch["last_success"]), *(batch[c].tolist() for c in ("uptime", "sent", "recv")), strict=True), strict=True))
        starts = [i for i, n in enumerate(names) if not i or n != names[i - 1]]
        out = []
        for a, b in zip(starts, [*starts[1:], len(names)], strict=True):
            newest, columns = nodes.get(names[a], (None, None))
            series: Series = {}
            if columns is not None:
                who, at, last, *counts = columns
                for r, t, *what in zip(who.tolist(), at.tolist(), said(last), *(c.tolist() for c in counts), strict=True):
                    series.setdefault(reporters[r], {})[t] = tuple(what)
            order = {r: sorted(s) for r, s in series.items()}
            taken, newest = _taken(series, order, newest, rows[a:b], tail)
            out += taken
            if taken:
                for r in order:
                    if r not in number:
                        number[r] = len(reporters)
                        reporters.append(r)
                stay = [(number[r], t, *series[r][t]) for r, times in order.items() for t in times[max(0, bisect_left(times, newest - tail) - 1) :]]
                columns = zip(*stay, strict=True)
                nodes[names[a]] = newest, [np.array([np.nan if v is None else v for v in c] if kind is np.float64 else c, kind) for c, kind in zip(columns, TYPES, strict=True)]
        if out:
            state.update((_packed(nodes, reporters),))
            yield batch.iloc[out]

    rows = stream.where("pubkey <> '' AND reported_at > 0").select(*COLUMNS, F.pmod(F.xxhash64("pubkey"), F.lit(parts)).alias("_part"))
    return rows.groupBy("_part").applyInPandasWithState(update, KEPT, STATE, "append", GroupStateTimeout.NoTimeout)
