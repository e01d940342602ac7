"""Tables in the folder that the driver and all executors share, and sizes of inputs."""

from __future__ import annotations

import gc
import json
import math
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset on one machine, as in tests, a
    temporary folder is set for the session; on a cluster that is an error."""
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(at)
        return at.rstrip("/")
    if (own := sc._jsc.sc().getCheckpointDir()).isDefined():
        return own.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tidemill-")
    sc.setCheckpointDir(path)
    return path


def free(spark: SparkSession, settle: float = 0) -> None:
    """Let Spark remove the shuffle files of tables that are gone: it does when the driver's heap is
    collected, which a loop of many small jobs may not cause for long. Python lets go of the JVM's
    tables in a thread that looks about once a second: `settle` waits for those just dropped."""
    gc.collect()
    for pause in (settle, settle) if settle else ():  # the second collection gets what hung on the first's
        spark._jvm.System.gc()
        time.sleep(pause)
    spark._jvm.System.gc()


#: Seconds after which a table that was just dropped is gone in the JVM too.
SETTLE = 1.5


#: Rows that a Python worker gets at a time. Spark's own 10,000 are hundreds of MB of long texts.
BATCH_ROWS = 500


def lean(df: DataFrame) -> DataFrame:
    """df, after bounding its session's Arrow batches to BATCH_ROWS rows."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A name like this that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder: computed once, and a lost executor costs no more than
    a read. Spark's cleaner removes the files when no plan refers to them any more."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Written:
    """A table written to the shared folder, for the length of one call: use it in a `with`."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch(self.spark, name)
        self.schema = df.schema
        df.write.parquet(self.path)

    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def __enter__(self) -> DataFrame:
        return self.df()

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)


class Steps:
    """Tables of one call, written to the shared folder and read again, so that plans stay short and
    sizes are known (a checkpoint keeps its plan's estimate, which multiplies over a loop's joins).
    Leaving the `with` removes them all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, scratch(spark, name), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        free(self.spark)  # the shuffles of the steps before
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)


#: Estimates above this come from plans that Catalyst knows nothing about.
UNKNOWN = 1 << 54


def bytes_of(df: DataFrame) -> int:
    """Catalyst's estimate of df's size; for files it comes from their sizes, without a job. Where it
    has none, the bytes are summed."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n < UNKNOWN:
        return n
    each = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes), F.lit(0))
    return df.agg(F.sum(each.cast("long"))).first()[0] or 0


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """The bytes of all texts, by a job: files say little of that, as they are compressed and have other
    columns."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def parts(df: DataFrame, each: int, least: int = 6, most: int = 200_000) -> int:
    """How many partitions of about `each` bytes hold df."""
    return max(least, min(most, math.ceil(bytes_of(df) / each)))


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Versions:
    """Manifests of a table under a path that driver and executors share: JSON objects by version, each
    created whole or not at all, by one writer only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._jvm = spark, path.rstrip("/"), spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def newest(self) -> int:
        """The newest committed version; 0 before the first."""
        if not self.fs.exists(self.at("manifest")):
            return 0
        names = [f.getPath().getName() for f in self.fs.listStatus(self.at("manifest"))]
        return max([0, *(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))])

    def read(self, version: int) -> dict:
        stream = self.fs.open(self.at(f"manifest/v{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, body: dict) -> int:
        """Make body version base + 1, by a rename that fails if it exists: Conflict then."""
        tmp, final = self.at(f"manifest/.{uuid.uuid4().hex}"), self.at(f"manifest/v{base + 1}.json")
        out = self.fs.create(tmp, False)
        out.write(bytearray(json.dumps({"version": base + 1, **body}).encode()))
        out.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(tmp.toUri() if tmp.toUri().getScheme() else self.fs.getUri(), self.conf)
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.NONE
        try:
            context.rename(tmp, final, options)
        except Py4JJavaError as e:
            self.fs.delete(tmp, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"version {base + 1} exists") from None
            raise
        return base + 1

    def sweep(self, folders: tuple[str, ...], unnamed, grace: float) -> None:
        """Delete what unnamed(name) says of the entries in these folders, if last written more than
        `grace` seconds ago."""
        before = (time.time() - grace) * 1000
        for at in (f for d in folders if self.fs.exists(self.at(d)) for f in self.fs.listStatus(self.at(d))):
            if unnamed(at.getPath().getName()) and self._written(at) <= before:
                self.fs.delete(at.getPath(), True)

    def _written(self, at) -> int:
        """When a file, or any file in a folder, was last written, in milliseconds."""
        if not at.isDirectory():
            return at.getModificationTime()
        return max([at.getModificationTime(), *(self._written(f) for f in self.fs.listStatus(at.getPath()))])
