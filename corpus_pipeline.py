"""A corpus made ready for training: toxic documents go, one of each near-duplicate group stays, secrets are masked, sources are mixed, sequences packed.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
is written as Parquet in the shared folder before the next one reads it.

Edge cases: null and empty texts are near duplicates of each other, so one of
them stays; it has no secret, is mixed as often as its source's share says, and
is packed as its end id. Very long texts are scanned and packed whole, cut only
into sequences. Of rows alike one stays; rows without a doc_id are never near
duplicates and all stay. Ties go to the smaller doc_id. An empty table gives no
rows. Other columns, whatever their names, stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideway.llm import mixing, packing, secrets, simhash, toxicity
from tideway.llm.common import new_folder, read


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, read(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.kept(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("toxicity", without_toxic), ("near_duplicates", one_of_each_group), ("secrets", without_secrets), ("mixing", mixed), ("packing", packed)]

#: Trained scores and random rounding have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
