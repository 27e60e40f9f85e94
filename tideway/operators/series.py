"""Sequences in time: runs, gaps, medians, folds over ordered rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideway.functions import times
from tideway.operators import scan

#: Stores a frame and returns it: with it a key's rows are cut into pieces of bounded size.
Keep = Callable[[DataFrame], DataFrame] | None


def status_run(samples: DataFrame, key: str) -> DataFrame:
    """Since when the latest status holds: the first sample after the last one that differed.

    Two rounds of partial sums: the last time of each status of a key, few
    rows, then the first sample after the last time that another one had.
    """
    ends = samples.groupBy(F.col(key).alias("_k"), "status").agg(F.max(F.struct("sampled_at", "seq")).alias("_end"))
    latest = ends.groupBy(F.col("_k").alias("_of")).agg(F.max_by(F.struct("status"), "_end").alias("_latest"))
    known = ends.join(latest, F.col("_k").eqNullSafe(F.col("_of"))).select("_k", "_end", "_latest", (~F.struct("status").eqNullSafe(F.col("_latest"))).alias("_other"))
    known = known.groupBy("_k").agg(F.max("_latest.status").alias("status"), F.max(F.when(F.col("_other") & F.col("_latest.status").isNotNull(), F.col("_end.sampled_at"))).alias("_differed"))
    rows = samples.select(key, "sampled_at").join(known, F.col(key).eqNullSafe(F.col("_k")))
    return rows.groupBy(key).agg(
        F.max("status").alias("status"), F.min(F.when(F.col("_differed").isNull() | (F.col("sampled_at") > F.col("_differed")), F.col("sampled_at"))).alias("since"), F.max("_differed").isNull().alias("at_start"),
    )


def typical_minutes(samples: DataFrame, key: str, at: int, open_status: int = 1, least: int = 3) -> DataFrame:
    """The median of open samples of the same hour of the week, or of all where there are too few; even counts round up. Counts by value are searched, so no key's samples are held or sorted together."""
    rows = samples.where((F.col("status") == open_status) & F.col("minutes").isNotNull())
    same = times.hour_of_week(F.col("sampled_at")) == times.hour_of_week(F.lit(at))
    both = rows.select(key, "minutes", F.explode(F.when(same, F.array(F.lit("HOUR_OF_WEEK"), F.lit("ALL_HOURS"))).otherwise(F.array(F.lit("ALL_HOURS")))).alias("basis"))
    by = scan.middles(both, [key, "basis"], "minutes").where(F.col("n") >= least)
    by = by.withColumn("minutes", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.floor((F.col("low") + F.col("high") + 1) / 2)).cast("int"))
    return by.groupBy(key).agg(F.max_by("minutes", "basis").alias("minutes"), F.max("basis").alias("basis"))


def cadence(rows: DataFrame, key: str, at: str, keep: Keep = None, pieces: int | None = None) -> DataFrame:
    """The upper median of the positive gaps between consecutive rows."""
    gaps = scan.Pieces(rows.select(key, at), [key], [at], keep, pieces).with_before(at, "_before").select(key, (F.col(at) - F.col("_before")).alias("gap")).where("gap > 0")
    return scan.middles(gaps, [key], "gap").select(key, F.col("high").alias("cadence"))


def reboots(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows whose uptime is below the one before."""
    return rows.withColumn("before", F.lag("uptime").over(Window.partitionBy(key).orderBy(*order))).where("uptime < before").drop("before")


def ewma(rows: DataFrame, key: str, at: str, alpha: float = 0.3, least_gap: int = 30, keep: Keep = None, pieces: int | None = None) -> DataFrame:
    """The exponential average of gaps of at least least_gap seconds, seeded by the first.

    Of n gaps the first weighs (1 - alpha)^(n - 1), the i-th alpha (1 -
    alpha)^(n - i): a weighted sum over numbered gaps. Each piece of a key sums
    its own, which those behind it then scale down.
    """
    cut = scan.Pieces(rows.select(key, at), [key], [at], keep, pieces)
    gaps = cut.with_before(at, "_before").withColumn("gap", (F.col(at) - F.col("_before")).cast("double")).where(F.col("gap") >= least_gap)
    rest, of = F.lit(1 - alpha), Window.partitionBy("_piece", key)
    gaps = gaps.select("_piece", key, "gap", F.row_number().over(of.orderBy(at)).alias("i"), F.count("*").over(of).alias("n"))
    each = gaps.groupBy("_piece", key).agg(F.sum(alpha * F.pow(rest, F.col("n") - F.col("i")) * F.col("gap")).alias("s"), F.max("n").alias("n"), F.max(F.when(F.col("i") == 1, F.col("gap"))).alias("seed"))
    w = Window.partitionBy(key).orderBy("_piece")  # a row for each piece
    each = each.withColumns({"behind": F.coalesce(F.sum("n").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)), "nth": F.row_number().over(w)})
    own = F.col("s") + F.when(F.col("nth") == 1, F.pow(rest, F.col("n")) * F.col("seed")).otherwise(0.0)
    by = each.groupBy(key).agg(F.sum(F.pow(rest, F.col("behind")) * own).alias("ewma"), F.sum("n").cast("int").alias("n_gaps"))
    return rows.select(key).distinct().join(by, key, "left").select(key, "ewma", F.coalesce("n_gaps", F.lit(0)).alias("n_gaps"))


def kept_apart(rows: DataFrame, keys: list[str], at: str, floor: int) -> DataFrame:
    """Times kept when at least floor after the last kept one of their key, which a plain lag cannot tell.

    Each key's times come in order and are streamed: what is remembered is the
    last kept time of the key at hand.
    """
    schema = rows.select(*keys, at).schema

    def keep(batches):
        now, last = None, None
        for b in batches:
            names, found = list(zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True)), []
            for i, (k, t) in enumerate(zip(names, b.column(len(keys)).to_pylist(), strict=True)):
                if k != now or t - last >= floor:
                    now, last = k, t
                    found.append(i)
            yield b.take(pa.array(found, pa.int64()))

    ordered = rows.select(*keys, at).where(F.col(at).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, at)
    return ordered.mapInArrow(keep, schema)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, columns: list[str], keep: Keep = None, pieces: int | None = None) -> DataFrame:
    """Each left row with the last right row strictly before it, of equal times the largest: one sort of both sides, no pairs. A key's time line is cut into pieces; each hands on its last right row."""
    r = right.select(*keys, F.col(right_at).alias("_at"), F.struct(F.col(right_at), *columns).alias("_r"), F.lit(1).alias("_side"))
    l = left.select(*keys, F.col(left_at).alias("_at"), F.struct(*left.columns).alias("_l"), F.lit(0).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    cut = scan.Pieces(both, keys, ["_at", "_side", "_r"], keep, pieces)
    rows = cut.carried(_earlier=(F.max("_r"), F.max))
    here = F.max("_r").over(cut.within.rowsBetween(Window.unboundedPreceding, -1))  # _r begins with its time
    found = rows.withColumn("_before", F.coalesce(here, F.col("_earlier"))).where("_side = 0")
    return found.select("_l.*", F.col("_before")[right_at].alias(f"as_of_{right_at}"), *(F.col("_before")[c].alias(f"as_of_{c}") for c in columns))


def hourly(intervals: DataFrame, start: str, end: str, columns: list[str]) -> DataFrame:
    """A row for each whole hour in [start, end), in seconds; the first hour is start's own."""
    first, last = F.col(start) - F.col(start) % 3600, F.col(end) - 1
    return intervals.where(F.col(end) > F.col(start)).select(*columns, F.explode(F.sequence(first, last - last % 3600, F.lit(3600).cast("bigint"))).alias("hour"))
