"""Document fingerprints by spot signatures.

Anchors are common function words and the start of the text. An anchor and the
CHAIN content words that follow it, anchors between them skipped, are a spot
signature; the last chains of a text may be shorter. A text of function words
alone has itself as its only signature. A text's fingerprint is the sorted set
of its signatures, each 8 hexadecimal digits of an XXH32. It depends on nothing
but the text.

Two fingerprints are as alike as the Jaccard index of their sets. ``near_pairs``
finds all pairs at or above a threshold between distinct fingerprints: a set
of n signatures can only match sets of n * threshold to n / threshold, so sets
are partitioned by length into bands of that ratio and meet only their own and
the next band; there they are joined on the rarest signatures that any match
must share, and the exact index is cut short once it cannot reach the
threshold.

Edge cases: null and empty texts, and texts without words, have the empty
fingerprint; two empty sets are alike (1), an empty and another are not (0);
the text after the last document is the first document's; rows with one doc_id
follow each other by text, a null doc_id comes last; a class without any doc_id
has a null class_id; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideway.llm.common import batch, cut, range_bounds, small_batches

CHAIN = 2
WORDS = re.compile(r"\w+")
#: Anchors: common function words of English, German, French and Spanish.
ANCHORS = frozenset(
    "a an the is are was were be been of to in that it for on with as at by this from or and have has not but they his her "
    "der die das den dem des ein eine und ist war von zu mit auf für nicht als auch es im sich "
    "le la les un une du et est que qui dans pour sur au aux ce il elle par pas plus avec "
    "el los las una y en con por para del se su lo como al esta".split()
)
SEED = 1
BAND_ROWS = 1_024


def spots(text: str) -> set[str]:
    """The spot signatures of a text, as text: anchor (empty for the start) and chain."""
    words = WORDS.findall(text.lower())
    anchors = ANCHORS
    content = [w for w in words if w not in anchors]
    if not content:
        return {" ".join(words)} if words else set()
    chains = [" ".join(content[i : i + CHAIN]) for i in range(len(content))]
    out, at = {":" + chains[0]}, 0
    for w in words:
        if w not in anchors:
            at += 1
        elif at < len(chains):
            out.add(f"{w}:{chains[at]}")
    return out


def signatures(text: str) -> np.ndarray:
    """The sorted distinct signatures of a text, as unsigned 32-bit numbers."""
    from xxhash import xxh32_intdigest

    return np.unique(np.array([xxh32_intdigest(s, SEED) for s in spots(text)], np.uint32))


def shown(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """The Jaccard index of two sorted sets; 0 without a merge where their sizes rule out ``least``."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, after: str) -> str:
    """text whose last third is replaced by as much of the start of ``after``."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order, each band followed by the row that comes after it (guest)."""
    held = None  # (doc_id, text, signatures, band) whose next row is still to come

    for b in batches:
        rows = []
        for band, guest, doc, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            sigs = signatures(text)
            if held and held[3] == band:
                before_id, before, own, _ = held
                new = edited(before, text)
                new_sigs = signatures(new)
                rows.append((before_id, len(before), hashlib.sha256(new.encode()).hexdigest(), shown(own), shown(new_sigs), jaccard(own, new_sigs), jaccard(own, sigs)))
            held = None if guest else (doc, text, sigs, band)
        if rows:
            yield batch(_OUT, *zip(*rows, strict=True))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to both that and the next document's.

    The order is descending doc_id. Documents are dealt to bands by ranges of
    doc_id, MOST_RANGES at most; the first of each band also goes to the band
    before, so the texts move once. Bands come from the ids alone. A worker
    streams through its band and holds one document before the present one, so
    a band may have any number of rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc_id", max(1, rows.count() // BAND_ROWS))
    # Band 0 holds the largest ids. Ids equal to a bound are above it.
    top = len(bounds)
    band = F.when(F.col("doc_id").isNull(), top).otherwise(F.lit(top) - _above(F.col("doc_id"), bounds)) if bounds else F.lit(0)
    rows = rows.select("doc_id", "text", band.cast("int").alias("band"))
    # The first row of each band: by doc_id descending, then text.
    firsts = rows.groupBy("band").agg(F.max("doc_id").alias("doc_id")).collect()
    used = sorted(r["band"] for r in firsts)
    if not used:
        return spark.createDataFrame([], _DDL)
    before = {b: used[i - 1] for i, b in enumerate(used)}  # the first band's first row goes after the last band
    first_of = {r["band"]: r["doc_id"] for r in firsts}
    heads = spark.createDataFrame([(b, first_of[b], before[b]) for b in used], "band int, head long, goes int")
    guests = rows.join(F.broadcast(heads), "band").where(F.col("doc_id").eqNullSafe(F.col("head")))
    guests = guests.groupBy("band", "doc_id", "goes").agg(F.min("text").alias("text")).select(F.col("goes").alias("band"), F.lit(1).alias("guest"), "doc_id", "text")
    dealt = rows.select("band", F.lit(0).alias("guest"), "doc_id", "text").unionByName(guests).repartitionById(used[-1] + 1, F.col("band"))
    ordered = dealt.sortWithinPartitions("band", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_compared, _DDL)


def _above(doc_id, bounds: list[int]):
    """How many bounds are at or below doc_id."""
    edges = np.array(bounds, np.int64)

    def count(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.fillna(0).astype("int64").to_numpy(), "right"))

    return F.pandas_udf(count, "int")(doc_id)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, sigs (the signatures, in order as unsigned numbers) and key (the SHA-256 of them) of each document."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("sigs array<int>, key binary")
    def own(texts: pd.Series) -> pd.DataFrame:
        found = [signatures(t or "") for t in texts]
        return pd.DataFrame({"sigs": [s.view(np.int32) for s in found], "key": [hashlib.sha256(s.tobytes()).digest() for s in found]})

    return docs.select("doc_id", own("text").alias("own")).select("doc_id", "own.*")


def near_classes(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal fingerprints (cls, class_id, key, sigs), their documents (doc_id, key), and pairs (a, b, likeness) of cls at or above the threshold.

    class_id is the smallest doc_id of a class. All counts of signatures are of
    all classes, so the rarest come first in each set. A signature of one class
    only is in no pair; such signatures are counted, not moved.
    """
    prints = cut(fingerprints(docs))
    classes = cut(prints.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs"))).select(F.monotonically_increasing_id().alias("cls"), "class_id", "key", "sigs")
    sets = classes.select("cls", F.size("sigs").alias("n"), "sigs").where("n > 0")
    each = sets.select("cls", "n", F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count("*").alias("often")).where("often > 1")
    ranked = each.join(often, "sig").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("often", "sig"))).alias("shared"))
    # A match shares ceil(threshold n) signatures, so one of those that have no more than that less one behind them, rarest first.
    first = F.size("shared") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")
    prefix = ranked.withColumn("first", first).where("first > 0").select("cls", "n", band.alias("band"), F.size("shared").alias("many"), F.posexplode(F.slice("shared", F.lit(1), F.col("first"))).alias("i", "s"))
    keyed = cut(prefix.select("cls", "n", "band", "s.sig", (F.col("many") - F.col("i")).alias("left")))
    a = keyed.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"), "sig", F.col("band").alias("at"))
    # A set asks in its own band and the next one up.
    b = keyed.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"), "sig", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("at"), "band")
    size_ok = (F.least("na", "nb") >= F.lit(threshold - 1e-12) * F.greatest("na", "nb")) & ((F.col("band") > F.col("at")) | (F.col("a") < F.col("b")))
    # From the first signature that two sets share on, each must have as many left as a match has in common.
    enough = F.least("la", "lb") >= F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-6
    candidates = a.join(b, ["sig", "at"]).where(size_ok & enough).select("a", "b").distinct()

    @F.pandas_udf("double")
    def likeness(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaccard(p, q, threshold) for p, q in zip(x, y, strict=True)], dtype="float64")

    of = sets.select("cls", "sigs")
    both = candidates.join(of.select(F.col("cls").alias("a"), F.col("sigs").alias("sa")), "a").join(of.select(F.col("cls").alias("b"), F.col("sigs").alias("sb")), "b")
    return classes, prints.select("doc_id", "key"), both.select("a", "b", likeness("sa", "sb").alias("likeness")).where(F.col("likeness") >= threshold)


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, class_id), and pairs (a, b, likeness) of class ids at or above the threshold, a below b."""
    classes, prints, pairs = near_classes(docs, threshold)
    name = lambda c: classes.select(F.col("cls").alias(c), F.col("class_id").alias(f"{c}_id"))
    named = pairs.join(name("a"), "a").join(name("b"), "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "likeness")
    return prints.join(classes.select("key", "class_id"), "key").select("doc_id", "class_id"), named


def near_documents(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_near (other classes at or above the threshold), likest (the highest likeness among them, else null)."""
    classes, prints, pairs = near_classes(docs, threshold)
    both = pairs.select(F.col("a").alias("cls"), "likeness").unionByName(pairs.select(F.col("b").alias("cls"), "likeness"))
    told = classes.select("cls", "class_id", "key").join(both.groupBy("cls").agg(F.count("*").alias("n_near"), F.max("likeness").alias("likest")), "cls", "left")
    return prints.join(told, "key").select("doc_id", "class_id", F.coalesce("n_near", F.lit(0)).alias("n_near"), "likest")
