"""Sharding (operator 6): a store of immutable Parquet shards under size-tiered compaction.

Arrivals are appended as small shards. Shards of about the same size form a tier (a power of FANOUT
of the small size); when a tier has FANOUT shards, they are merged into files of up to the target
size, which are final from half of it on. Each change writes new files first and then commits a new
version of the manifest by an atomic rename that fails if the version exists; readers see a version
or the next, never a mixture, and a writer that lost the race tries again on the new version. A
merge reads each group of shards into one file without a shuffle.

Files are deleted by vacuum() alone, which a store's owner calls: those that none of the last versions
names and that are older than a grace period. Appends, merges and reads that take less than that
never lose a file, whatever else goes on; what a crashed writer leaves behind is removed as well.

Nulls, empty and very long texts, ties and repeated rows are stored as they are, and any columns
kept, whatever their names; the store asks for the same columns each time. An empty arrival, and an
empty file of one, adds no shard.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Conflict, Versions, bytes_of, fresh, kept, remove, scratch

FANOUT = 4
SMALL, TARGET = 4 << 20, 128 << 20
#: Merged files that one job writes.
GROUPS = 128
#: Seconds that files no version names are kept for.
GRACE = 24 * 3600


@dataclass(frozen=True)
class Shard:
    """A file of the store: its name, bytes and rows, and the version that added it."""

    name: str
    size: int
    rows: int
    since: int


class ShardStore:
    """Shards of a table under a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, small: int = SMALL, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.path, self.small, self.target, self.fanout = spark, path.rstrip("/"), small, target, fanout
        self.versions = Versions(spark, path)
        self._fs, self._path = self.versions.fs, self.versions.at

    # -- manifest

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return self.versions.newest()

    def manifest(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        if not v:
            return {"version": 0, "schema": None, "shards": []}
        got = self.versions.read(v)
        return got | {"shards": [Shard(**s) for s in got["shards"]]}

    def commit(self, base: int, schema: str | None, shards: list[Shard]) -> int:
        """Make `shards` version base + 1. Conflict if that version exists already."""
        return self.versions.commit(base, {"schema": schema, "shards": [asdict(s) for s in shards]})

    def _rows(self, at) -> int:
        """The rows of a Parquet file, from its footer."""
        parquet = self.spark._jvm.org.apache.parquet.hadoop
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(at, self.versions.conf))
        try:
            return reader.getRecordCount()
        finally:
            reader.close()

    def _moved(self, tmp: str) -> list[tuple[str, int, int]]:
        """The Parquet files with rows that Spark wrote to tmp, moved among the shards: names, bytes
        and rows, in the order written."""
        out = []
        self._fs.mkdirs(self._path("shards"))
        for f in sorted(self._fs.listStatus(self._path(tmp)), key=lambda f: f.getPath().getName()):
            if f.getPath().getName().startswith("part-") and f.getLen() and (rows := self._rows(f.getPath())):
                name = f"{len(out):06d}-{uuid.uuid4().hex}.parquet"
                if not self._fs.rename(f.getPath(), self._path(f"shards/{name}")):
                    raise OSError(f"{name} can't be moved")
                out.append((name, f.getLen(), rows))
        self._fs.delete(self._path(tmp), True)
        return out

    # -- writing

    def append(self, arrivals: DataFrame, size: int | None = None) -> int:
        """Add rows as small shards, about size / small of them (size: bytes, Catalyst's estimate if
        not given); returns the new version."""
        schema = arrivals.schema.json()
        tmp = f"tmp-{uuid.uuid4().hex}"
        arrivals.coalesce(max(1, math.ceil((size or bytes_of(arrivals)) / self.small))).write.parquet(f"{self.path}/{tmp}")
        new = self._moved(tmp)
        while True:
            now = self.manifest()
            if not new and now["schema"]:
                return now["version"]
            if now["schema"] not in (None, schema) and [(f["name"], f["type"]) for f in json.loads(now["schema"])["fields"]] != [(f["name"], f["type"]) for f in json.loads(schema)["fields"]]:
                raise ValueError("the arrivals have other columns than the store")
            try:
                return self.commit(now["version"], now["schema"] or schema, [*now["shards"], *(Shard(*x, now["version"] + 1) for x in new)])
            except Conflict:
                continue

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.small, self.fanout)) + 1)

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups to merge, each into one file: of every tier that has enough runs, in the order of
        their arrival, up to the target size."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.size < self.target:
                tiers.setdefault(self.tier(s.size), []).append(s)
        groups = []
        for _, runs in sorted(tiers.items()):
            if len(runs) < self.fanout:
                continue
            group: list[Shard] = []
            for s in sorted(runs, key=lambda s: (s.since, s.name)):
                if group and sum(x.size for x in group) + s.size > self.target:
                    groups.append(group)
                    group = []
                group.append(s)
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> int:
        """Merge until no tier is full; returns the version then."""
        while True:
            now = self.manifest()
            groups = self.plan(now["shards"])[:GROUPS]
            if not groups:
                return now["version"]
            schema = T.StructType.fromJson(json.loads(now["schema"]))
            read = self.spark.read.schema(schema)
            merged = [read.parquet(*(f"{self.path}/shards/{s.name}" for s in g)).coalesce(1) for g in groups]
            tmp = f"tmp-{uuid.uuid4().hex}"
            reduce(DataFrame.union, merged).write.parquet(f"{self.path}/{tmp}")
            new = self._moved(tmp)
            gone = {s.name for g in groups for s in g}
            while True:
                now = self.manifest()
                if not gone <= {s.name for s in now["shards"]}:  # merged by another writer meanwhile
                    for name, *_ in new:
                        self._fs.delete(self._path(f"shards/{name}"), False)
                    break
                try:
                    self.commit(now["version"], now["schema"], [*(s for s in now["shards"] if s.name not in gone), *(Shard(*x, now["version"] + 1) for x in new)])
                    break
                except Conflict:
                    continue

    def vacuum(self, keep: int = 2, grace: float = GRACE) -> None:
        """Delete files that none of the last `keep` versions names, and what writers left behind, if
        last written more than `grace` seconds ago. Older versions can't be read any more."""
        v = self.version()
        named = {s.name for k in range(max(1, v - keep + 1), v + 1) for s in self.manifest(k)["shards"]}
        self.versions.sweep(("", "shards"), lambda name: name.startswith("tmp-") or name.endswith(".parquet") and name not in named, grace)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with their shard's name in __shard (with underscores after it, if the
        rows have such a column)."""
        now = self.manifest(version)
        if not now["schema"]:
            raise ValueError("the store is empty")
        schema = T.StructType.fromJson(json.loads(now["schema"]))
        if not now["shards"]:
            none = self.spark.createDataFrame([], schema)
            return none.withColumn(fresh(none, "__shard"), F.lit(""))
        df = self.spark.read.schema(schema).parquet(*(f"{self.path}/shards/{s.name}" for s in now["shards"]))
        return df.withColumn(fresh(df, "__shard"), F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))


ARRIVALS = 6


def shard_report(docs: DataFrame, small: int = SMALL, target: int = TARGET) -> DataFrame:
    """docs in ARRIVALS arrivals (by a digest of the doc_id) through a store of its own. Per row of the
    compacted store: doc_id, arrival, text_sha256, and merges_due, how many merges its tiers still
    call for: 0, unless compaction left a full tier."""
    spark = docs.sparkSession
    path = scratch(spark, "shards")
    store = ShardStore(spark, path, small, target)
    digest = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    arrival = fresh(docs, "__shard_arrival")
    dealt = docs.withColumn(arrival, F.pmod(digest, F.lit(ARRIVALS)))
    size = bytes_of(docs) // ARRIVALS + 1
    for k in range(ARRIVALS):
        store.append(dealt.filter(F.col(arrival) == k), size)
        store.compact()
        store.vacuum(keep=1, grace=0)  # no one else knows this store
    out = store.read().select("doc_id", F.col(arrival).alias("arrival"), F.sha2("text", 256).alias("text_sha256"))
    out = kept(out.withColumn("merges_due", F.lit(len(store.plan(store.manifest()["shards"]))).cast("long")))
    remove(spark, path)
    return out


#: The same in SQL.
SQL = f"""
SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {ARRIVALS} AS arrival, sha256(text) AS text_sha256, 0::BIGINT AS merges_due
FROM documents
"""
