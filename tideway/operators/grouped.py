"""Folds whose next step depends on what was kept, over one key's rows of a batch in arrival order."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def telemetry_kept(samples: DataFrame, order: str = "seq") -> DataFrame:
    """Samples worth storing, of (pubkey, reporter, reported_at, last_success, uptime, sent, recv) in arrival order.

    Dropped: a blank key or time; a read told again (the last success of the
    kept sample before it, of its reporter); a counter set that did not move;
    and a second sample of a node and time. A micro-batch with the stored tail
    of each series before it bounds a group.
    """

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        series, taken, kept = {}, set(), []
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        for i, r in enumerate(rows.itertuples(index=False)):
            times = series.setdefault(r.reporter, ([], {}))
            at = bisect_left(times[0], r.reported_at)
            before = times[1][times[0][at - 1]] if at else None
            if before is not None:
                if pd.notna(r.last_success) and pd.notna(before.last_success) and r.last_success == before.last_success:
                    continue
                if r.uptime > 0 and (r.uptime, r.sent, r.recv) == (before.uptime, before.sent, before.recv):
                    continue
            if r.reported_at in taken:
                continue
            taken.add(r.reported_at)
            insort(times[0], r.reported_at)
            times[1][r.reported_at] = r
            kept.append(i)
        return rows.iloc[kept]

    valid = samples.where("pubkey <> '' AND reported_at > 0")
    return valid.groupBy("pubkey").applyInPandas(keep, valid.schema)


def numbered_groups(rows: DataFrame, keys: list[str], order: list[str], base: str, separator: str = ":") -> DataFrame:
    """Ids of rows that share a base: the first has the base itself, the others a suffix from 2 on."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).withColumn("numbered", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat_ws(separator, base, F.col("_n").cast("string")))).drop("_n")


def perimeters_deduped(perimeters: DataFrame, degrees: float = 0.15) -> DataFrame:
    """The freshest perimeter of each cluster of one fire name, of (seq, norm, incident, lat, lng, at, active, rank, acres).

    In feed order a row joins the first cluster whose first row has its
    incident number, or lies within ``degrees``; a cluster keeps its latest,
    then active, then lowest rank of source, then largest row.
    """

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq", kind="stable").reset_index(drop=True)
        incident, lat, lng = rows["incident"].fillna("").to_numpy(str), rows["lat"].to_numpy(float), rows["lng"].to_numpy(float)
        heads, of = np.zeros(0, int), np.empty(len(rows), int)  # the first row of each cluster, and each row's cluster
        for i in range(len(rows)):
            joins = (incident[i] != "") & (incident[heads] == incident[i]) | (np.hypot(lat[heads] - lat[i], lng[heads] - lng[i]) < degrees)
            of[i] = joins.argmax() if joins.any() else len(heads)
            if not joins.any():
                heads = np.append(heads, i)
        order = np.lexsort((-rows.index, rows["acres"], -rows["rank"], rows["active"], rows["at"], of))
        last = np.flatnonzero(np.diff(of[order], append=-1))
        return rows.iloc[order[last]]

    return perimeters.groupBy("norm").applyInPandas(keep, perimeters.schema)


def continued_ids(winners: DataFrame, prior: DataFrame, order: str = "id") -> DataFrame:
    """winners (base, n, county, lat, lng) with the id each goes on under.

    In order, a winner takes the nearest unused prior id of its base and
    county, of equally near ones the first by ``order``; the others take the base, or the next free suffix ``base-2`` on.
    A winner alone in its base, for whom no id is used yet, finds its id in a join; only bases of several go to Python.
    """
    c = F.col
    winners, prior = (d.toDF(*d.columns) for d in (winners, prior))  # two sides of one table have columns of their own
    winners = winners.withColumn("_many", F.count("*").over(Window.partitionBy("base")) > 1)
    alone, several = winners.where(~c("_many")).drop("_many"), winners.where("_many").drop("_many")
    p = prior.select(c("base").alias("_base"), c("id").alias("_id"), c("county").alias("_county"), c("lat").alias("_lat"), c("lng").alias("_lng"), c(order).alias("_order"))
    fits = c("county") == c("_county")
    y, x = c("_lat") - c("lat"), c("_lng") - c("lng")
    far = y * y + x * x
    # The suffix that an id of the base bears, 1 for none.
    k = F.when(c("_id") == c("base"), 1).otherwise(F.regexp_extract("_id", r"-([2-9]|[1-9][0-9]{1,8})\z", 1).try_cast("int"))
    k = F.when(F.concat(c("base"), F.when(k > 1, F.concat(F.lit("-"), k)).otherwise("")) == c("_id"), k)
    met = alone.join(p, c("base") == c("_base"), "left").groupBy("base", "n").agg(F.min_by(F.when(fits, c("_id")), F.when(fits, F.struct(far, "_order"))).alias("id"), F.collect_set(k).alias("_used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("_used") + 1), c("_used")))
    suffixed = F.concat(c("base"), F.when(free > 1, F.concat(F.lit("-"), free)).otherwise(""))
    met = met.select("base", "n", F.coalesce("id", suffixed).alias("id"))

    def assign(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        new, ids = new.sort_values("n", kind="stable").reset_index(drop=True), {}
        old = old.sort_values(order, kind="stable").reset_index(drop=True)
        free, lat, lng, county = np.ones(len(old), bool), old["lat"].to_numpy(float), old["lng"].to_numpy(float), old["county"].to_numpy()
        for i, (y, x, c) in enumerate(zip(new["lat"], new["lng"], new["county"], strict=True)):
            fits = np.flatnonzero(free & (county == c) & pd.notna(c))
            if len(fits):
                best = fits[np.argmin((lat[fits] - y) ** 2 + (lng[fits] - x) ** 2)]
                ids[i], free[best] = old["id"][best], False
        taken, k = set(old["id"]), 1
        for i in new.index:
            if i not in ids:
                while (name := key[0] if k == 1 else f"{key[0]}-{k}") in taken:
                    k += 1
                ids[i] = name
                taken.add(name)
        return new.assign(id=[ids[i] for i in new.index])[["base", "n", "id"]]

    old = prior.join(several.select("base").distinct(), "base", "left_semi")
    return met.unionByName(several.groupBy("base").cogroup(old.groupBy("base")).applyInPandas(assign, "base string, n long, id string"))
