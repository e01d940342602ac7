"""Pipelines: a plan over sources that change, its state and its sink, advanced in micro-batches.

File sources are read by Structured Streaming, whose offset log says which files belong to a batch;
foreachBatch evaluates the plan's change, writes state, delivers to the sink and commits the state's
manifest, in this order. A batch that failed anywhere is redone from the old state, and the sink
ignores it if it had taken it already: each change arrives exactly once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.changes import with_diff
from ..functions.types import DIFF, ORD, UINT64
from ..plans.delta import step
from ..plans.nodes import Node, identity, scans
from ..sinks.relational import Sink
from ..sources.cdc import decoded, sealed
from ..sources.sequence import sequence
from .state import FileState

#: Numbers the rows of a batch as they are read: in order within one block of one file.
AT = "__at"


@dataclass
class CdcFiles:
    """Files of Debezium envelopes, one in a line, in the order of their names."""

    path: str
    schema: T.StructType
    per_batch: int | None = None
    bytes_per_batch: int | None = None
    tombstones: bool = True

    def stream(self, spark: SparkSession) -> DataFrame:
        r = spark.readStream.format("text").option("recursiveFileLookup", "true")
        if self.per_batch:
            r = r.option("maxFilesPerTrigger", self.per_batch)
        elif self.bytes_per_batch:
            r = r.option("maxBytesPerTrigger", self.bytes_per_batch)
        place = (F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
        return r.load(self.path).select(F.to_json(F.struct(*place, F.col("value").alias("v"))).alias("value"))

    def _lines(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.from_json("value", "f string, b long, v string").alias("x"), AT).select("x.f", "x.b", AT, F.col("x.v").alias("value"))

    def sealed(self, rows: DataFrame, before: bool) -> bool:
        return sealed(self._lines(rows), ["f", "b", AT], before)

    def change(self, rows: DataFrame) -> DataFrame:
        return decoded(self._lines(rows), self.schema, order=["f", "b", AT], tombstones=self.tombstones)


@dataclass
class ChangeFiles:
    """Parquet files of rows; __diff is 1 where it is missing."""

    path: str
    schema: T.StructType
    per_batch: int | None = None

    def stream(self, spark: SparkSession) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(DIFF, T.LongType()), T.StructField(ORD, T.LongType())])
        r = spark.readStream.format("parquet").schema(full)
        if self.per_batch:
            r = r.option("maxFilesPerTrigger", self.per_batch)
        return r.load(self.path).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))

    def change(self, rows: DataFrame) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField(DIFF, T.LongType()), T.StructField(ORD, T.LongType())])
        df = rows.select(F.from_json("value", full).alias("x"), AT).select("x.*", AT)
        return df.withColumn(DIFF, F.coalesce(DIFF, F.lit(1).cast("long"))).withColumn(ORD, F.coalesce(ORD, AT)).drop(AT)


@dataclass
class Sequence:
    """Numbers from start on, some for each batch."""

    start: int = 0
    per_batch: int = 1

    schema = T.StructType([T.StructField("value", UINT64)])


class Pipeline:
    """One program: its plan, sources by name, a sink and a state folder."""

    def __init__(self, spark: SparkSession, plan: Node, sources: dict, sink: Sink, state: str, owner: str | None = None, between: Callable[[str], None] = lambda point: None):
        missing = [s.source for s in scans(plan) if s.source not in sources]
        if missing:
            raise ValueError(f"source {missing[0]} is missing")
        if unread := [n for n in sources if n not in {s.source for s in scans(plan)}]:
            raise ValueError(f"source {unread[0]} is not read")
        self.spark, self.plan, self.sources, self.sink, self.path, self.between = spark, plan, sources, sink, state.rstrip("/"), between
        self.state = FileState(spark, f"{self.path}/state", owner or identity(plan))
        self._streams = {n: s for n, s in sources.items() if not isinstance(s, Sequence)}

    def _empty(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([], self.sources[name].schema)

    def _batch(self, rows: DataFrame | None, batch: int) -> None:
        if batch < self.state.version:
            return  # committed before the query's own log was written
        changes: dict[str, DataFrame] = {}
        try:
            if rows is not None:
                rows = self.state.once(rows.withColumn(AT, F.monotonically_increasing_id()))
                for name, s in self._streams.items():
                    own = rows.filter(F.col("source") == name)
                    if isinstance(s, CdcFiles):
                        self.state.put_number(f"sealed-{name}", int(s.sealed(own, bool(self.state.number(f"sealed-{name}")))))
                    changes[name] = s.change(own)
            for name, s in self.sources.items():
                if isinstance(s, Sequence):
                    at = self.state.numbers.get(f"sequence-{name}", s.start)
                    changes[name] = with_diff(sequence(self.spark, at, s.per_batch)).withColumn(ORD, F.monotonically_increasing_id())
                    self.state.put_number(f"sequence-{name}", at + s.per_batch)
            out = self.state.once(step(self.plan, changes, self.state, self._empty).drop(ORD))
            relations = self.state.write()
            self.between("state")
            self.sink.deliver(out, batch)
            self.between("sink")
            self.state.commit(relations)
        except BaseException:
            self.state.abandon()
            raise

    def advance(self) -> bool:
        """Process what has arrived; whether there was anything."""
        before = self.state.version
        if not self._streams:
            self._batch(None, before)
            return True
        all_rows = None
        for name, s in self._streams.items():
            one = s.stream(self.spark).select(F.lit(name).alias("source"), "value")
            all_rows = one if all_rows is None else all_rows.union(one)
        query = all_rows.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.path}/offsets").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.state.version > before

    def status(self) -> dict:
        return {"version": self.state.version, "relations": {k: len(v) for k, v in self.state.relations.items()}}
