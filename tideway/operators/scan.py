"""Folds over ordered rows of any key, however many rows it has: a prefix scan over pieces.

Rows are sorted by (keys, order) into pieces, ranges of bounded size that cut a
hot key's time line wherever its rows are many. Each piece is folded to a
summary for each of its keys; the summaries of a key, one for each piece, are
combined in order; and what came before a piece is handed to its rows. Only the
first key of a piece can have come before, so that is one row for each piece at
most, which bounds its broadcast. Inside a piece plain windows do the rest.

That is one sort and one store more than a window over whole keys, so it is done
where some key has more than MOST rows; else a key's rows are one piece. Either
way no task has an unbounded number of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a key that one task may have.
MOST = 4_000_000
#: Values whose counts are summed as one in the first step of a search for ranks.
WIDTH = 4_096


def largest(rows: DataFrame, keys: Sequence[str]) -> int:
    """The rows of the key that has most; counted before they are moved."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


class Pieces:
    """rows with the number of their piece, ``_piece``; ``keep`` stores a frame and returns it, so that a piece stays what it is. Without it all is one piece."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Callable[[DataFrame], DataFrame] | None, pieces: int | None = None):
        self.keys, self.order = list(keys), list(order)
        self.one = keep is None or pieces is None and largest(rows, keys) <= MOST
        if self.one:
            self.rows = rows.withColumn("_piece", F.lit(0))
        else:
            by = [*self.keys, *self.order]
            dealt = rows.repartitionByRange(*([pieces] if pieces else []), *by)
            self.rows = keep(dealt.sortWithinPartitions(*by).withColumn("_piece", F.spark_partition_id()))

    @property
    def within(self) -> WindowSpec:
        """A key's rows of one piece, in order."""
        return Window.partitionBy("_piece", *self.keys).orderBy(*self.order)

    def carried(self, **summaries: tuple[Column, Callable[[Column], Column]]) -> DataFrame:
        """rows with a column for each summary, an aggregate of a key's rows in a piece and how such aggregates are combined: its value over all earlier pieces, or null."""
        if self.one:
            types = self.rows.groupBy(*self.keys).agg(*(a.alias(n) for n, (a, _) in summaries.items())).schema
            return self.rows.withColumns({n: F.lit(None).cast(types[n].dataType) for n in summaries})
        each = self.rows.groupBy("_piece", *self.keys).agg(*(a.alias(n) for n, (a, _) in summaries.items()))
        w = Window.partitionBy(*self.keys).orderBy("_piece")
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        before = each.select("_piece", F.struct(*self.keys).alias("_of"), F.struct(*(f(F.col(n)).over(earlier).alias(n) for n, (_, f) in summaries.items())).alias("_carried"), F.row_number().over(w).alias("_nth")).where("_nth > 1").drop("_nth")
        mine = F.col("_of").eqNullSafe(F.struct(*self.keys))
        return self.rows.join(F.broadcast(before), "_piece", "left").select(*self.rows.columns, *(F.when(mine, F.col("_carried")[n]).alias(n) for n in summaries))

    def with_before(self, column: str, name: str) -> DataFrame:
        """rows with the value of ``column``, the first of the order, in the row before, of any piece."""
        rows = self.carried(_last=(F.max(column), F.max))
        first = F.row_number().over(self.within) == 1
        return rows.withColumn(name, F.when(first, F.col("_last")).otherwise(F.lag(column).over(self.within))).drop("_last")


def last(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def middles(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, n, low, high: how many values a key has, and the one or two in the middle of their order. Values are whole numbers; nulls do not count.

    Equal values are counted before they are moved. Ranks are looked up in
    cumulative counts, first over runs of WIDTH values, then over the values of
    the runs that hold the middle.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias("_k"), F.col(value).cast("long").alias("_v")).agg(F.count("*").alias("_c"))
    run = F.floor(F.col("_v") / WIDTH)
    runs = counts.groupBy("_k", run.alias("_b")).agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy("_k").orderBy("_b")
    runs = runs.withColumns({"n": F.sum("_c").over(Window.partitionBy("_k")), "_before": F.sum("_c").over(w) - F.col("_c")})
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    holds = lambda r: (F.col("_before") < r) & (r <= F.col("_before") + F.col("_c"))
    picked = runs.where(holds(low) | holds(high)).select("_k", "_b", "n", "_before")
    near = counts.withColumn("_b", run).join(picked, ["_k", "_b"])
    near = near.withColumn("_before", F.col("_before") + F.sum("_c").over(Window.partitionBy("_k", "_b").orderBy("_v")) - F.col("_c"))
    return near.groupBy("_k").agg(F.max("n").alias("n"), F.min(F.when(holds(low), F.col("_v"))).alias("low"), F.min(F.when(holds(high), F.col("_v"))).alias("high")).select("_k.*", "n", "low", "high")
