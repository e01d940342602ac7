"""Operator state as versioned Parquet tables.

A relation is a list of folders, each the changes of one batch, in buckets of the operator's keys; a
read takes only the buckets that a batch's keys fall into. When a relation has many folders they are
rewritten as one. A version is a manifest that is created whole or not at all; it names the folders
of each relation. What a failed batch has written is named by no manifest and removed by the next.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.changes import consolidated, data, q, with_diff
from ..functions.storage import Folder, Work
from ..functions.types import DIFF, ORD

BUCKETS, FOLDERS = 64, 8


class StateError(RuntimeError):
    """The state is of another program, or another writer has it."""


class FileState:
    """State under a path of any file system that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, owner: str, buckets: int = BUCKETS):
        self.spark, self.path, self.owner = spark, path.rstrip("/"), owner
        self.folder = Folder(spark, self.path)
        versions = [int(n[1:-5]) for n in self.folder.names("manifest") if n.startswith("v")]
        self.version = max(versions, default=0)
        if self.version:
            got = json.loads(self.folder.read(f"manifest/v{self.version}.json"))
            if got["owner"] != owner:
                raise StateError("the state belongs to another program")
            self.buckets, self.relations, self.numbers = got["buckets"], got["relations"], got["numbers"]
        else:
            self.buckets, self.relations, self.numbers = buckets, {}, {}
        self._new: dict[str, tuple[DataFrame, list[str]]] = {}
        self._numbers: dict[str, int] = {}
        self.folder.delete("work")  # of a batch that failed
        self.once = Work(spark, f"{self.path}/work")

    def _bucket(self, keys: list[str]):
        return F.pmod(F.xxhash64(*(F.col(k) for k in keys)), F.lit(self.buckets)).cast("int") if keys else F.lit(0)

    def _schema(self, like: DataFrame) -> T.StructType:
        return T.StructType([*(like.schema[c] for c in data(like)), T.StructField(DIFF, T.LongType()), T.StructField("__bucket", T.IntegerType())])

    def _read(self, name: str, like: DataFrame) -> DataFrame | None:
        parts = [self.spark.read.schema(self._schema(like)).parquet(f"{self.path}/{p}") for p in self.relations.get(name, [])]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def old(self, name: str, like: DataFrame, keys: DataFrame | None) -> DataFrame:
        df = self._read(name, like)
        if df is None:
            return with_diff(like).drop(ORD).limit(0)
        if keys is not None:
            hit = [r[0] for r in keys.select(self._bucket(keys.columns).alias("b")).distinct().collect()]  # at most `buckets`
            df = df.filter(F.col("__bucket").isin(hit))
        return df.select(*(F.col(q(c)) for c in data(like)), DIFF)

    def add(self, name: str, change: DataFrame, keys: list[str]) -> None:
        self._new[name] = (change, keys)

    def number(self, name: str) -> int:
        return self.numbers.get(name, 0)

    def put_number(self, name: str, value: int) -> None:
        self._numbers[name] = value

    def write(self) -> dict[str, list[str]]:
        """Write the batch's changes; the folders of each relation as they will be."""
        v, out = self.version + 1, dict(self.relations)
        for name, (df, keys) in self._new.items():
            own = [c for c in data(df) if c not in keys]
            slim = df.select(*(F.col(q(c)) for c in own), DIFF, self._bucket(keys).alias("__bucket"))
            folders = list(self.relations.get(name, []))
            at = f"relations/{name}/v{v}"
            if len(folders) + 1 > FOLDERS:
                before = self._read(name, df.select(*(F.col(q(c)) for c in own), DIFF))
                both = before.unionByName(slim)
                slim = consolidated(both.withColumnRenamed("__bucket", "b"), name).withColumnRenamed("b", "__bucket")
                folders = []
            slim.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/{at}")
            if any(n.startswith("__bucket") for n in self.folder.names(at)):
                folders.append(at)
            out[name] = folders
        return out

    def commit(self, relations: dict[str, list[str]]) -> None:
        """Make what write() returned the next version."""
        v = self.version + 1
        numbers = self.numbers | self._numbers
        body = {"version": v, "owner": self.owner, "buckets": self.buckets, "relations": relations, "numbers": numbers}
        if not self.folder.create(f"manifest/v{v}.json", json.dumps(body)):
            raise StateError(f"version {v} was committed by another writer")
        gone = {p for ps in self.relations.values() for p in ps} - {p for ps in relations.values() for p in ps}
        self.version, self.relations, self.numbers = v, relations, numbers
        self._new, self._numbers = {}, {}
        self.once.close()
        for p in gone:
            self.folder.delete(p)
        for n in self.folder.names("manifest"):
            if n.startswith("v") and int(n[1:-5]) < v - 1:
                self.folder.delete(f"manifest/{n}")

    def abandon(self) -> None:
        self.once.close()
        self._new, self._numbers = {}, {}
