"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be taken target / source size times: a whole
part that all share, and a fraction. The fractions are rounded in pairs. A
pair moves words from one member to the other, up or down at random so that
the expected copies of both stay as they were, until one of them is integral;
the other goes on to the next pair. The words a source takes change in no
move, so only the very last document of a source, which is rounded alone to the
nearer integer, parts the source from its target, by at most half its size.

Groups of a source are rounded side by side; each hands on at most one
fractional document, and these residuals meet in a tree of fixed fan-in. A hot
source is many groups. All draws come from the ids and a seed: reruns agree.

Rows alike in all columns are one item with a count n: of its n fractions whole
copies are dealt to its rows at once, and one fraction is left to be rounded.
So no draw depends on the order in which rows arrive, and no id, however often
it repeats, fills a group.

Edge cases: a null text has size 0; a document of size 0 is taken the shared
whole number of times and counts 0 words; a null source is a source of its
own, last in order; repeated rows are each taken zero, one or two times; rows
alike in doc_id but not in all columns are documents of their own; an empty
table gives no rows; ``mixed`` keeps other columns whatever their names, ``mix``
replaces those named source_size, target or copies.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from tideway.llm.common import WORD, cut, indexed, one_of_alike, row_key

FAN_IN = 64
#: Rows of a source that one group rounds.
GROUP_ROWS = 4_096
EPS = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the words of each document."""
    return docs.select("doc_id", "source", _size())


def _size():
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source_no, source, source_size, groups, target, ratio. Weights repeat over the sources in order.

    share of all words is dealt by weight; a source gets at most ``most`` times
    its size, and what it leaves is dealt again among the rest by weight.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / GROUP_ROWS).cast("long").alias("groups"))
    by = indexed(by, [F.col("source").asc_nulls_last()], "source_no")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    by = by.select("source_no", "source", "source_size", "groups", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("top"))
    by = cut(by)
    total = share * float(by.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        capped = F.col("top") < F.col("w") * level if full >= 0 else F.lit(False)
        r = by.agg(F.sum(F.when(capped, F.col("top")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("w"))), F.sum(capped.cast("int"))).first()
        if r[2] == full or not r[1]:
            break
        full, level = r[2] or 0, (total - (r[0] or 0.0)) / r[1]
    target = F.least(F.col("top"), F.col("w") * F.lit(level))
    ratio = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(min(share, most)))
    return by.select("source_no", "source", "source_size", "groups", target.alias("target"), ratio.alias("ratio"))


def pivot(size: np.ndarray, part: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Rounded fractions, and the place of the one that is still fractional (-1: none)."""
    out, draw = part.astype(float).copy(), np.random.default_rng(seed).random(len(part))
    held = -1
    for j in range(len(out)):
        if not EPS < out[j] < 1 - EPS:
            out[j] = round(out[j])
            continue
        if held < 0:
            held = j
            continue
        i, si, sj = held, size[held], size[j]
        up, down = min((1 - out[i]) * si, out[j] * sj), min(out[i] * si, (1 - out[j]) * sj)
        move = up if draw[j] * (up + down) < down else -down
        out[i] += move / si
        out[j] -= move / sj
        left = [k for k in (i, j) if EPS < out[k] < 1 - EPS]
        for k in (i, j):
            if k not in left:
                out[k] = round(out[k])
        held = left[0] if left else -1
    return out, held


def _rounded(seed: int, level: int):
    def work(rows: pa.Table) -> pa.Table:
        size, part, key = (rows[c].to_numpy() for c in ("size", "part", "key"))
        # Large documents settle first, so the one left over at the end is rarely large.
        order = np.lexsort((part, key, -size))
        group, groups = rows["grp"][0].as_py(), rows["groups"][0].as_py()
        draws = zlib.crc32(f"{seed}:{rows['source_no'][0].as_py()}:{group}:{level}".encode())
        out, held = pivot(size[order].astype(float), np.where(size[order] > 0, part[order], 0.0), draws)
        if held >= 0 and groups == 1:
            out[held] = round(out[held])
            held = -1
        rows = rows.take(pa.array(order))
        n = rows.num_rows
        new = {"part": out, "open": np.arange(n) == held, "grp": np.full(n, group // FAN_IN), "groups": np.full(n, -(-groups // FAN_IN))}
        return pa.table({f: pa.array(new[f]) if f in new else rows[f] for f in [*rows.column_names, "open"]})

    return work


def items(sized: DataFrame, weights: tuple[float, ...], share: float, most: float, seed: int) -> DataFrame:
    """c0, c1 … (the columns of sized in order), n, source_size, target, copies (of one row) and extra (so many of the n rows have one copy more)."""
    alike = sized.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sized.columns)))
    columns = alike.columns
    source, size = (f"c{sized.columns.index(c)}" for c in ("source", "size"))
    alike = cut(alike.groupBy(*columns).agg(F.count("*").alias("n")))
    to = targets(alike.select(F.col(source).alias("source"), (F.col(size) * F.col("n")).alias("size")), weights, share, most)
    base, part = F.floor(F.col("ratio") + EPS).cast("long"), F.greatest(F.lit(0.0), F.col("ratio") - F.floor(F.col("ratio") + EPS))
    sure = F.floor(F.col("n") * part + EPS).cast("long")
    rows = alike.join(to, F.col(source).eqNullSafe(to["source"])).drop("source")
    nulls = F.array(*(F.col(c).isNull() for c in columns))
    rows = rows.withColumns({"base": base, "sure": sure, "part": F.greatest(F.lit(0.0), F.col("n") * part - sure), "size": F.col(size), "key": F.xxhash64(nulls, *columns)}).drop("ratio")
    rows = rows.withColumn("grp", F.pmod("key", "groups"))
    kept = rows.columns
    schema = StructType([*rows.schema.fields, StructField("open", BooleanType())])
    out, level = [], 0
    while True:
        rows = cut(rows.select(*kept).groupBy("source_no", "grp").applyInArrow(_rounded(seed, level), schema))
        out.append(rows.where("not open"))
        if not rows.where("open").limit(1).count():
            break
        rows, level = rows.where("open"), level + 1
    done = out[0]
    for x in out[1:]:
        done = done.unionByName(x)
    return done.select(*columns, "n", "source_size", "target", F.col("base").alias("copies"), (F.col("sure") + F.col("part").cast("long")).alias("extra"))


def mix(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """Rows of sized (doc_id, source, size and any others) with source_size, target and copies."""
    sized = sized.drop("source_size", "target", "copies")
    done = items(sized, weights, share, most, seed)
    each = done.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    copies = F.col("copies") + (F.col("nth") <= F.col("extra")).cast("long")
    return each.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(sized.columns)), "source_size", "target", copies.alias("copies"))


def taken(docs: DataFrame) -> DataFrame:
    """The digest of a mix: doc_id, size, source_size, target, taken (words), source, copies."""
    return mix(sizes(docs)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """docs with each row as often as the mix takes it: zero, one or two times. Rows alike in all columns share their copies."""
    sized = docs.select("source", _size(), row_key(docs).alias("row"))
    plan = items(sized, weights, share, most, seed).select(F.col("c2").alias("key"), (F.col("n") * F.col("copies") + F.col("extra")).alias("times")).where("times > 0")
    rows = one_of_alike(docs.select(row_key(docs).alias("key"), F.struct("*").alias("row")), "key").join(plan, "key")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
