"""Cells for joins in the plane that stay small where points crowd: a grid whose dense cells are split, and split again.

A tree is made from a bounded sample of points: a cell that holds more than its
share is cut into four, down to LEVELS halvings; one that is still too dense
then (many points at one place) is given salts, over which one side of a join is
dealt and the other repeated. The tree goes to the tasks: it has a few nodes for
each MOST rows at the most, and no more than the sample allows. Every row gets
the leaves that its box meets, and two boxes that meet share a leaf, the one of
the lower corner that they have in common.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a cell may hold, points of a sample, and halvings of a cell.
MOST, SAMPLE, LEVELS = 2_000_000, 50_000, 16

Node = tuple[int, int, int]


class Tree:
    """Leaves over a grid of ``size`` degrees. ``split``: nodes (level, y, x) that have children; ``salts``: leaves of several parts."""

    def __init__(self, size: float, split: frozenset[Node] = frozenset(), salts: dict[Node, int] | None = None):
        self.size, self.split, self.salts = size, split, salts or {}

    @classmethod
    def of(cls, lat: np.ndarray, lng: np.ndarray, size: float, limit: int) -> Tree:
        """The tree of sampled points, with at most ``limit`` of them in a leaf or one part of it."""
        y, x, split, salts = lat / size, lng / size, set(), {}
        for level in range(LEVELS + 1):
            by, bx = np.floor(y * 2**level).astype(np.int64), np.floor(x * 2**level).astype(np.int64)
            dense = {(level, *k): n for k, n in Counter(zip(by.tolist(), bx.tolist(), strict=True)).items() if n > limit}
            if not dense:
                break
            if level == LEVELS:
                salts = {k: -(-n // limit) for k, n in dense.items()}
                break
            split |= set(dense)
            stay = np.fromiter(((level, a, b) in dense for a, b in zip(by.tolist(), bx.tolist(), strict=True)), bool, len(y))
            y, x = y[stay], x[stay]
        return cls(size, frozenset(split), salts)

    def finer(self, halvings: int) -> Tree:
        """The tree over a grid of cells halved so often; what was split less is split so, too."""
        deep = lambda node: (node[0] - halvings, *node[1:])
        return Tree(self.size / 2**halvings, frozenset(deep(n) for n in self.split if n[0] >= halvings), {deep(n): k for n, k in self.salts.items() if n[0] >= halvings})

    def leaves(self, lat0: float, lat1: float, lng0: float, lng1: float) -> list[tuple[int, int, int, int]]:
        """(level, y, x, parts) of each leaf that a box meets."""
        box = np.array([lat0, lat1, lng0, lng1]) / self.size
        if not np.isfinite(box).all():
            return []
        out, todo = [], []

        def under(level: int, ys: range, xs: range) -> None:
            for a in ys:
                for b in xs:
                    node = (level, a, b)
                    (todo if node in self.split else out).append(node)

        y0, y1, x0, x1 = np.floor(box).astype(np.int64).tolist()
        under(0, range(y0, y1 + 1), range(x0, x1 + 1))
        while todo:
            level, a, b = todo.pop()
            y0, y1, x0, x1 = np.floor(box * 2 ** (level + 1)).astype(np.int64).tolist()
            under(level + 1, range(max(2 * a, y0), min(2 * a + 1, y1) + 1), range(max(2 * b, x0), min(2 * b + 1, x1) + 1))
        return [(*n, self.salts.get(n, 1)) for n in out]

    def keyed(self, rows: DataFrame, lat0: Column, lat1: Column, lng0: Column, lng1: Column, dealt: bool) -> DataFrame:
        """rows once for each leaf of their box, ``_cell``: of a leaf with parts in one of them (dealt) or in all."""
        if not self.split:
            span = lambda lo, hi: F.sequence(F.floor(lo / self.size), F.floor(hi / self.size))
            rows = rows.withColumn("_y", F.explode(span(lat0, lat1))).withColumn("_x", F.explode(span(lng0, lng1)))
            return rows.withColumn("_cell", F.struct(F.lit(0).alias("level"), F.col("_y").alias("y"), F.col("_x").alias("x"), F.lit(0).cast("long").alias("part"))).drop("_y", "_x")
        tree = self

        @F.pandas_udf("array<struct<level:int,y:bigint,x:bigint,parts:int>>")
        def found(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            return pd.Series([[dict(zip(("level", "y", "x", "parts"), n, strict=True)) for n in tree.leaves(*box)] for box in zip(a, b, c, d, strict=True)], dtype=object)

        rows = rows.withColumn("_leaf", F.explode(found(lat0, lat1, lng0, lng1)))
        parts = F.col("_leaf.parts").cast("long")
        part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts) if dealt else F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
        rows = rows.withColumn("_part", part)
        return rows.withColumn("_cell", F.struct("_leaf.level", "_leaf.y", "_leaf.x", F.col("_part").alias("part"))).drop("_leaf", "_part")

    def holds(self, lat: Column, lng: Column) -> Column:
        """Whether a row's ``_cell`` is the one of a point: a pair is told once, where the lower corner that it shares lies."""
        scale = F.pow(F.lit(2.0), F.col("_cell.level"))
        return (F.floor(lat / self.size * scale) == F.col("_cell.y")) & (F.floor(lng / self.size * scale) == F.col("_cell.x"))


def tree(points: DataFrame, size: float, most: int = MOST, sample: int = SAMPLE) -> Tree:
    """The tree for points (lat, lng), of a sample where there are more than ``most``; fewer can crowd no cell."""
    rows = points.select(F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    n = rows.count()
    if n <= most:
        return Tree(size)
    taken = rows.where("lat IS NOT NULL AND lng IS NOT NULL").sample(False, min(1.0, sample / n), 17).limit(2 * sample).toPandas()
    return Tree.of(taken["lat"].to_numpy(), taken["lng"].to_numpy(), size, max(32, most * len(taken) // n))
