"""Presence of radio nodes as a stream: spans of time that a node was there, each with the gap that its own rhythm allows.

A node is there for a window after it was last heard: some multiple of the
average gap of its adverts, between a floor and a ceiling, and the floor while
it has told fewer than two. So the gap that ends a span is the node's own, and
changes with every advert, which no session window of a fixed gap can say.

Adverts wait in state until the watermark has passed them, and are then taken in
the order of time, whatever the order in which they came: spans are those of a
batch over the same rows, and an advert is lost only if it is later than the
watermark allows. A node that has not been heard for ``retention`` leaves the
state with its rhythm. What waits is what came within the allowed lateness.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SPANS = "node string, began long, heard long, ended double, adverts long"
#: The multiple of the rhythm, the least and the longest window, and the least gap that is one, in seconds.
TIMES, FLOOR, CEILING, LEAST_GAP, ALPHA = 3.0, 3_600, 86_400, 30, 0.3


class Rhythm:
    """What is kept of a node: the span at hand (began is None between spans) and the average gap of its adverts."""

    def __init__(self, began=None, heard=None, adverts=0, counted=None, gaps=0, mean=None):
        self.began, self.heard, self.adverts, self.counted, self.gaps, self.mean = began, heard, adverts, counted, gaps, mean

    def row(self) -> tuple:
        return self.began, self.heard, self.adverts, self.counted, self.gaps, self.mean

    @property
    def window(self) -> float:
        return float(FLOOR) if not self.gaps else min(float(CEILING), max(float(FLOOR), TIMES * self.mean))

    @property
    def ends(self) -> float:
        return self.heard + self.window

    def close(self) -> tuple:
        span = (self.began, self.heard, self.ends, self.adverts)
        self.began, self.adverts = None, 0
        return span

    def hear(self, t: int, n: int) -> Iterator[tuple]:
        """Takes n adverts of one time, later than any before; a span that ended before it is given back."""
        if self.began is not None and t > self.ends:
            yield self.close()
        if self.began is None:
            self.began = t
        self.heard, self.adverts = t, self.adverts + n
        if self.counted is None:
            self.counted = t
        elif t - self.counted >= LEAST_GAP:
            gap = t - self.counted
            self.mean = float(gap) if self.mean is None else ALPHA * gap + (1 - ALPHA) * self.mean
            self.counted, self.gaps = t, self.gaps + 1


STATE = "began long, heard long, adverts long, counted long, gaps long, mean double, waiting array<long>, counts array<long>"


def spans(stream: DataFrame, late: str, retention: int = 30 * CEILING) -> DataFrame:
    """SPANS rows of a stream of adverts (node, at), each once, when the watermark has passed its end.

    A node's state is one row, read and written once a batch, with one timer:
    the next of its waiting adverts, the end of its span, or of its retention.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        *row, at, n = kept.get if kept.exists else (None, None, 0, None, 0, None, [], [])
        node, waiting, told, passed = Rhythm(*row), Counter(dict(zip(at, n, strict=True))), [], kept.getCurrentWatermarkMs()
        for frame in frames:
            waiting.update(frame["at"].tolist())
        for t in sorted(t for t in waiting if t * 1000 < passed):
            told += node.hear(t, waiting.pop(t))
        if node.began is not None and node.ends * 1000 < passed:  # what still waits came after the watermark
            told.append(node.close())
        if node.began is None and not waiting and (node.heard + retention) * 1000 < passed:
            kept.remove()
        else:
            turns = [min(waiting)] if waiting else []
            turns += [node.ends] if node.began is not None else [] if waiting else [node.heard + retention]
            kept.update((*node.row(), list(waiting), list(waiting.values())))
            kept.setTimeoutTimestamp(max(math.floor(min(turns) * 1000), passed + 1))
        if told:
            yield pd.DataFrame([(key[0], *span) for span in told], columns=["node", "began", "heard", "ended", "adverts"])

    rows = stream.select(F.col("node").cast("string").alias("node"), F.col("at").cast("long").alias("at")).where("at IS NOT NULL").withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", late)
    return rows.groupBy("node").applyInPandasWithState(update, SPANS, STATE, "append", GroupStateTimeout.EventTimeTimeout)
