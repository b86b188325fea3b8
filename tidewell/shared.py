"""Intermediate tables in the folder all executors share.

Iterative operators cut their lineage here: the table is written once, and a lost executor costs a
task that reads it again, never the whole history of the plan.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset on a local master (tests) one of our own.

    On a cluster a folder of one machine would lose what other executors write, so there the setting is required."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _OWN:
        own = tempfile.TemporaryDirectory(prefix="tidewell-", ignore_cleanup_errors=True)
        atexit.register(own.cleanup)
        _OWN["keep"], _OWN["dir"] = own, "file://" + own.name  # type: ignore[assignment]
    return _OWN["dir"]


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what a folder holds, sorted; a missing folder holds nothing."""
    fs, at = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not be there yet; it appears whole or not at all, so it can commit a larger write."""
    fs, at = _file_system(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    _, part = _file_system(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    stream = fs.create(part, False)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    if not fs.rename(part, at):
        fs.delete(part, False)
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder where it is there."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table of ``schema`` (a DDL string) without rows, made without any Python worker."""
    fields = T.StructType.fromDDL(schema).fields
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


class Scratch:
    """Written tables of one run of an operator, below the shared folder."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tidewell/{label}-{uuid.uuid4().hex}"
        atexit.register(self._drop_all)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as Parquet and read again with its own schema."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a written table that no later plan reads."""
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _drop_all(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self.drop("")
