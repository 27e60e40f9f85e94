"""What the operators of this subpackage share: shared storage, lineage cuts, ordering and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of every contract: runs without ASCII white space. ``bytes.split()`` cuts at the same characters, \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tideway-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that no later job computes it anew."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds the bytes that a Python worker is handed at once: long texts come in batches of few rows, at least one.

    A frame is planned when it is run, so the setting stays in the session; a
    smaller one that the user chose is kept, and the bound on rows is the user's.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.sub(r"\D", "", spark.conf.get(name)))
    if now > most or now <= 0:
        spark.conf.set(name, str(most))


def batch(schema: pa.Schema, *columns: Sequence | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def binary(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def row_key(df: DataFrame) -> Column:
    """A struct of two hashes, 96 bits, of a row's every column: rows alike in all columns share it. Nulls count by their place, maps by their text."""
    cols = [(F.col(f"`{f.name}`"), f.dataType.simpleString()) for f in df.schema]
    plain = [F.to_json(F.struct(c)) if "map<" in t or "variant" in t else c for c, t in cols]
    nulls = F.array(*(c.isNull() for c, _ in cols))
    return F.struct(F.xxhash64(nulls, *plain).alias("h1"), F.hash(nulls, *plain).alias("h2"))


def one_of_alike(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, of rows that are alike where their keys are: all but one of a task go before the shuffle."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(key))).where("nth = 1").drop("nth")


#: Rows alike are counted, not moved one by one, when they are more than both COPIES and one MOST_HOT-th of all rows; a chunk of them has COPIES at most.
COPIES, MOST_HOT = 10_000, 10_000


def collapsed(rows: DataFrame) -> DataFrame:
    """rows with copies and chunk: rows alike in all columns stay apart (1 and 0), or, where they are very many, are one row for each chunk of them.

    At most MOST_HOT kinds of rows can be that many, which bounds the broadcast.
    """
    most, alike = max(COPIES, rows.count() // MOST_HOT), row_key(rows)
    hot = cut(rows.groupBy(alike.alias("alike")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("alike"))
    one = {"copies": F.lit(1).cast("long"), "chunk": F.lit(0).cast("long")}
    if hot.isEmpty():
        return rows.withColumns(one)
    tagged = rows.withColumn("alike", alike)
    rest = tagged.join(F.broadcast(hot), "alike", "left_anti").drop("alike").withColumns(one)
    many = tagged.join(F.broadcast(hot), "alike", "left_semi").groupBy(*rows.columns).agg(F.count("*").alias("n"))
    many = many.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    return rest.unionByName(many.withColumn("copies", F.least(F.lit(COPIES), F.col("n") - F.col("chunk") * COPIES)).drop("n"))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may learn: crc32 of the id as text, modulo 3, is 1 (a null id is the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


#: Ranges of a key at most: what they cost the driver does not grow with the table.
MOST_RANGES = 4_096


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 increasing values of an integer key that cut the rows into runs of about equal counts; parts is held at MOST_RANGES."""
    parts = min(parts, MOST_RANGES)
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = df.select(F.percentile_approx(key, F.array(*map(F.lit, at)), max(10_000, 20 * parts))).first()[0]
    return sorted(set(got or []))


def indexed(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with a gapless number from 0 in the given order. Only a count for each partition reaches the driver."""
    rows = cut(df.sort(*order).select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("_at")))
    before, starts = 0, []
    for part, n in sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        starts.append((part, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), of any type that has an order: root is the smallest node reachable.

    Alternating large and small stars: each round moves every edge towards the
    smallest neighbour, in a number of rounds that grows as the logarithm of
    the longest path. A hub's minimum is combined before the shuffle, and the
    join back is one that AQE splits.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    state = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        edges = cut(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == now:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
