"""Radio links: edges of relay paths, their rollup and window aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(observations: DataFrame) -> DataFrame:
    """A row for each pair of consecutive nodes of sender and relays, smaller name first. A blank relay breaks the chain on both sides."""
    chain = F.concat(F.array("pubkey"), F.col("path_nodes"))
    pairs = F.zip_with(F.slice("chain", F.lit(1), F.size("chain") - 1), F.slice("chain", F.lit(2), F.size("chain") - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    rows = observations.withColumn("chain", chain).select("obs_id", "heard_at", "snr", F.explode(pairs).alias("p"))
    real = (F.col("p.x") != "") & (F.col("p.y") != "") & (F.col("p.x") != F.col("p.y"))
    return rows.where(real).select("obs_id", "heard_at", "snr", F.least("p.x", "p.y").alias("a"), F.greatest("p.x", "p.y").alias("b"))


def links(rollup: DataFrame, tail: DataFrame, since: int) -> DataFrame:
    """Links heard since a time: rollup days from that time's UTC day on, and single receptions not yet rolled up."""
    days = rollup.where(F.col("day") >= since - since % 86400)
    fresh = tail.where(F.col("heard_at") >= since).select("a", "b", (F.col("heard_at") - F.col("heard_at") % 86400).alias("day"), F.lit(1).cast("bigint").alias("n"), F.col("snr").alias("best_snr"), F.col("heard_at").alias("first_at"), F.col("heard_at").alias("last_at"))
    ends = [F.max("best_snr").alias("best_snr"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")]
    each = days.unionByName(fresh).groupBy("a", "b", "day").agg(F.sum("n").alias("n"), *ends)
    return each.groupBy("a", "b").agg(F.sum("n").alias("observations"), *ends, F.count("*").alias("days"))


def heard_times(observations: DataFrame, most: int) -> DataFrame:
    """(pubkey, times): the latest ``most`` times of each node, ascending; only they are collected."""
    w = Window.partitionBy("pubkey").orderBy(F.desc("heard_at"))
    last = observations.select("pubkey", "heard_at", F.row_number().over(w).alias("n")).where(F.col("n") <= most)
    return last.groupBy("pubkey").agg(F.array_sort(F.collect_list("heard_at")).alias("times"))


def unique_prefix(prefixes: DataFrame, keys: DataFrame, lengths: tuple[int, ...] = (2, 4, 6)) -> DataFrame:
    """(prefix, key) where exactly one key starts with the prefix, by equality on the keys' own prefixes."""
    own = keys.select("key", F.explode(F.array(*(F.substring("key", 1, n) for n in lengths))).alias("prefix")).distinct()
    one = own.groupBy("prefix").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").drop("n")
    return prefixes.select("prefix").distinct().join(one, "prefix")
