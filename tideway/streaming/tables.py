"""Tables that change together: Parquet folders, and one commit file that names those that count.

A commit is a small JSON file under ``_commits``: for each table the folders
that make it up, and marks (the last batch, watermarks). Writers put rows into
folders of names of their own first, then the commit, under a temporary name,
which is renamed; the driver is the one writer. So a batch that fails between
two tables, or runs twice, is never seen in part: its folders are in no commit,
and are removed later. Files are reached through Hadoop's file systems, as
Spark reaches them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Commits whose folders stay, for readers that planned before the newest one.
KEPT = 4


@dataclass
class Commit:
    number: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    marks: dict[str, int] = field(default_factory=dict)


class Tables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._Path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_commits") if n.endswith(".json") and n[0].isdigit())

    def _file(self, number: int) -> str:
        return f"{self.path}/_commits/{number:012d}.json"

    def _read(self, number: int) -> Commit:
        stream = self._fs.open(self._Path(self._file(number)))
        try:
            return Commit(number, **json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def newest(self) -> Commit:
        """What counts now; before the first commit, nothing."""
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else Commit()

    def write(self, rows: DataFrame, table: str, *by: str) -> str:
        """A new folder with the rows, in no commit yet."""
        name = f"{table}/{uuid.uuid4().hex}"
        (rows.write.partitionBy(*by) if by else rows.write).parquet(f"{self.path}/{name}")
        return name

    def read(self, table: str, schema: StructType, at: Commit | None = None) -> DataFrame:
        folders = (at or self.newest()).tables.get(table, [])
        return self.folders(folders, schema)

    def folders(self, names: list[str], schema: StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}" for n in names))

    def commit(self, after: Commit, tables: dict[str, list[str]], marks: dict[str, int]) -> Commit:
        """Makes tables and marks count; those not named stay as they are in ``after``, which must be the newest."""
        new = Commit(after.number + 1, after.tables | tables, after.marks | marks)
        final, draft = self._Path(self._file(new.number)), self._Path(f"{self.path}/_commits/.{uuid.uuid4().hex}")
        if self._fs.exists(final):
            raise RuntimeError(f"another writer has made commit {new.number}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"tables": new.tables, "marks": new.marks}).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"commit {new.number} could not be written")
        return new

    def clean(self) -> None:
        """Removes commits before the KEPT newest, and folders that no commit left names: old versions, and what failed batches wrote."""
        numbers = self._numbers()
        for n in numbers[:-KEPT]:
            self._fs.delete(self._Path(self._file(n)), False)
        named = [f.split("/") for n in numbers[-KEPT:] for fs in self._read(n).tables.values() for f in fs]
        used = {tuple(f[:2]) for f in named}
        for table in {f[0] for f in named}:
            for name in self._names(table):
                if (table, name) not in used:
                    self._fs.delete(self._Path(f"{self.path}/{table}/{name}"), True)
