"""Files that the driver and all executors share, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where it is unset on one machine, as in
    tests. On a cluster it has to be set."""
    sc = spark.sparkContext
    set_to = sc._jsc.sc().getCheckpointDir()
    if set_to.isDefined():
        return set_to.get()
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemill-")
    sc.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


class Folder:
    """Small files and folders under a path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file whole, or leave it alone and return False if it exists."""
        tmp = self._at(f".{uuid.uuid4().hex}")
        out = self._fs.create(tmp, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(self._at(name).getParent())
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(tmp, self._at(name), options)
        except Py4JJavaError as e:
            self._fs.delete(tmp, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def delete_at_exit(self) -> None:
        self._fs.deleteOnExit(self._at(""))


class Work:
    """Tables written for one piece of work and read again: computed once, with short plans and known
    sizes. close() removes them."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path, self.n = spark, path or f"{checkpoint_dir(spark)}/work-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        at = f"{self.path}/{self.n}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def close(self) -> None:
        Folder(self.spark, self.path).delete()

    def close_at_exit(self) -> None:
        """The tables stay until the driver ends, for what is read from them later."""
        Folder(self.spark, self.path).delete_at_exit()
