"""Targets: a table through a DB-API connection, versioned files, and nowhere.

Each delivery has the number of its batch, and a target remembers the last one in the same
transaction (or the same rename) as the rows: delivering a batch again changes nothing.

Positive events take the next ids; a retraction takes away the oldest live copies of its exact row.
"""

from __future__ import annotations

import importlib
import json
import sqlite3
from collections.abc import Callable
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.changes import consolidated, data, q
from ..functions.storage import Folder, checkpointed
from ..functions.types import DIFF, SQLITE


class SinkError(RuntimeError):
    """A target can't take a change."""


class Sink(Protocol):
    def deliver(self, change: DataFrame, batch: int) -> None: ...


class Discard:
    """Accepts changes and drops them."""

    def deliver(self, change: DataFrame, batch: int) -> None:
        change.write.format("noop").mode("overwrite").save()


def _plain(v: Any) -> Any:
    if v is None or isinstance(v, (int, float, str, bytes)):
        return int(v) if isinstance(v, bool) else v
    if isinstance(v, bytearray):
        return bytes(v)
    return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat() if hasattr(v, "isoformat") else json.dumps(v.asDict(True), default=str) if hasattr(v, "asDict") else json.dumps(v, default=str) if isinstance(v, (list, tuple, dict)) else str(v)


class TableSink:
    """A table through any DB-API connection, with technical columns __id and __row. Rows pass through
    the driver as a stream: one connection, one transaction for each batch, statements of many rows."""

    MAX_COLUMNS = 1598
    ROWS = 10_000  # of one statement

    def __init__(self, connect: Callable[[], Any], table: str, mark: str = "?", column_type: Callable[[T.DataType], str] = lambda t: "TEXT", big: str = "BIGINT"):
        self.connect, self.table, self.mark, self.column_type, self.big = connect, table, mark, column_type, big
        self.name = ".".join('"' + x.replace('"', '""') + '"' for x in table.split("."))
        self.frontier = ".".join('"' + x.replace('"', '""') + '"' for x in f"{table}__frontier".split("."))

    def _exists(self, c: Any, name: str) -> bool:
        try:
            c.execute(f"SELECT 1 FROM {name} LIMIT 1")
            return True
        except Exception:  # noqa: BLE001  each driver has its own error for a missing table
            return False

    def deliver(self, change: DataFrame, batch: int) -> None:
        cols = data(change)
        if len(cols) > self.MAX_COLUMNS:
            raise SinkError(f"{self.table}: {len(cols)} columns are too many")
        con = self.connect()
        try:
            cur, m = con.cursor(), self.mark
            if not self._exists(cur, self.frontier):
                con.rollback()
                if self._exists(cur, self.name):
                    raise SinkError(f"{self.table} exists and is not this program's")
                con.rollback()
                body = ", ".join('"' + c.replace('"', '""') + '" ' + self.column_type(change.schema[c].dataType) for c in cols)
                cur.execute(f"CREATE TABLE {self.name} (__id {self.big} PRIMARY KEY, __row TEXT NOT NULL{', ' if body else ''}{body})")
                cur.execute(f"CREATE INDEX {self.name.split('.')[-1][:-1]}__rows\" ON {self.name} (__row, __id)")
                cur.execute(f"CREATE TABLE {self.frontier} (batch {self.big} NOT NULL, last_id {self.big} NOT NULL)")
                cur.execute(f"INSERT INTO {self.frontier} VALUES (-1, 0)")
            cur.execute(f"SELECT batch, last_id FROM {self.frontier}")
            done, at = cur.fetchone()
            if batch <= done:
                con.rollback()
                return
            net = consolidated(change, self.table, signed=True).orderBy(DIFF)
            net = net.withColumn("__row", F.sha2(F.to_json(F.struct(*(F.col(q(c)) for c in cols)), {"ignoreNullFields": "false"}), 256)) if cols else net.withColumn("__row", F.lit(""))
            marks = ", ".join([m] * (len(cols) + 2))
            gone, new = [], []

            def flush() -> None:
                if gone:  # the oldest copies go first
                    cur.executemany(f"DELETE FROM {self.name} WHERE __id IN (SELECT __id FROM {self.name} WHERE __row = {m} ORDER BY __id LIMIT {m})", gone)
                    if cur.rowcount != sum(n for _, n in gone):
                        raise SinkError(f"{self.table}: a row was retracted more often than it was there")
                if new:
                    cur.executemany(f"INSERT INTO {self.name} VALUES ({marks})", new)
                gone.clear()
                new.clear()

            for r in net.toLocalIterator():  # retractions come first
                n = r[DIFF]
                if n < 0:
                    gone.append((r["__row"], -n))
                for _ in range(max(n, 0)):
                    at += 1
                    new.append((at, r["__row"], *(_plain(r[c]) for c in cols)))
                    if len(new) == self.ROWS:
                        flush()
                if len(gone) == self.ROWS:
                    flush()
            flush()
            cur.execute(f"UPDATE {self.frontier} SET batch = {m}, last_id = {m}", (batch, at))
            con.commit()
        except BaseException:
            con.rollback()
            raise
        finally:
            con.close()


class SqliteSink(TableSink):
    """A table of a SQLite file on the driver."""

    MAX_COLUMNS = 1998

    def __init__(self, path: str, table: str):
        super().__init__(lambda: sqlite3.connect(path), table, "?", lambda t: SQLITE.get(type(t), "TEXT"), "INTEGER")


class PostgresSink(TableSink):
    """A PostgreSQL table; needs psycopg."""

    def __init__(self, connection: str, table: str):
        kinds = {T.BooleanType: "boolean", T.ByteType: "smallint", T.ShortType: "smallint", T.IntegerType: "integer", T.LongType: "bigint", T.FloatType: "real", T.DoubleType: "double precision", T.DateType: "date", T.TimestampType: "timestamptz", T.TimestampNTZType: "timestamp", T.BinaryType: "bytea", T.DecimalType: "numeric"}
        super().__init__(lambda: importlib.import_module("psycopg").connect(connection), table, "%s", lambda t: kinds.get(type(t), "text"))


class VersionedSink:
    """Append-only files of (__id, __version, row), as a replacing warehouse table keeps them: the last
    version of an id wins, and a row is live if its version is its id. Everything is distributed."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)

    def _manifest(self) -> dict:
        names = [n for n in self.folder.names("manifest") if n.startswith("v")]
        return json.loads(self.folder.read("manifest/" + max(names, key=lambda n: int(n[1:-5])))) if names else {"n": 0, "batch": -1, "last_id": 0, "parts": []}

    def versions(self, like: T.StructType | None = None) -> DataFrame | None:
        m = self._manifest()
        return self.spark.read.schema(T.StructType.fromJson(json.loads(m["schema"]))).parquet(*(f"{self.path}/{p}" for p in m["parts"])) if m["parts"] else None

    def current(self) -> DataFrame | None:
        """The view: live rows with their __id."""
        df = self.versions()
        if df is None:
            return None
        cols = [c for c in df.columns if c not in ("__id", "__version")]
        last = df.groupBy("__id").agg(F.max(F.struct("__version", *(F.col(q(c)) for c in cols))).alias("x"))
        return last.filter(F.col("x.__version") == F.col("__id")).select("__id", *(F.col(f"x.{q(c)}").alias(c) for c in cols))

    def deliver(self, change: DataFrame, batch: int) -> None:
        m = self._manifest()
        if batch <= m["batch"]:
            return
        cols = data(change)
        net = checkpointed(consolidated(change, self.path, signed=True))
        key = F.sha2(F.to_json(F.struct(*(F.col(q(c)) for c in cols)), {"ignoreNullFields": "false"}), 256)
        live, parts = self.current(), []
        minus = net.filter(F.col(DIFF) < 0)
        gone = None
        if not minus.isEmpty():
            if live is None:
                raise SinkError(f"{self.path}: a row was retracted that was never there")
            ranked = live.withColumn("__k", key).join(minus.select(key.alias("__k"), (-F.col(DIFF)).alias("__n")), "__k")
            ranked = ranked.withColumn("__i", F.row_number().over(Window.partitionBy("__k").orderBy("__id")))
            gone = ranked.filter(F.col("__i") <= F.col("__n")).select("__id", *(F.col(q(c)) for c in cols))
            want, got = minus.agg(F.sum(-F.col(DIFF))).first()[0], gone.count()
            if want != got:
                raise SinkError(f"{self.path}: a row was retracted more often than it was there")
        plus = net.filter(F.col(DIFF) > 0).select(*(F.col(q(c)) for c in cols), F.explode(F.sequence(F.lit(1), F.col(DIFF).cast("int"))).alias("__c")).drop("__c")
        plus = checkpointed(plus.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id() % F.lit(1 << 33)))
        sizes = plus.groupBy("__p").agg(F.count("*").alias("__n"))
        before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
        added = plus.join(before, "__p").withColumn("__id", (F.lit(m["last_id"]) + F.col("__b") + F.col("__i") + 1).cast("long"))
        n = plus.count()
        top = m["last_id"] + n
        rows = added.select("__id", F.col("__id").alias("__version"), *(F.col(q(c)) for c in cols))
        if gone is not None:  # a tombstone's version is larger than any id so far
            rows = rows.unionByName(gone.select("__id", F.lit(top + 1).cast("long").alias("__version"), *(F.col(q(c)) for c in cols)))
            top += 1
        part = f"data/batch-{batch}"
        rows.write.mode("overwrite").parquet(f"{self.path}/{part}")
        body = {"n": m["n"] + 1, "batch": batch, "last_id": top, "parts": [*m["parts"], part], "schema": rows.schema.json()}
        if not self.folder.create(f"manifest/v{m['n'] + 1}.json", json.dumps(body)):
            raise SinkError(f"{self.path}: another writer has delivered")
