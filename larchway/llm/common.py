"""Reading tables, shared scratch tables and small helpers for the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (local tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="larchway-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder. They cut lineage, survive lost executors and are read more than once."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.spark._jvm.System.gc()  # shuffle files go when the driver collects what refers to them
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more; without names, all of them."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            p = hadoop(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches for Python hold about `size` bytes at most in what runs in here."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


class Memo(dict):
    """A mapping filled by a function and emptied when it holds more than `limit` entries: memory, not results, is bounded."""

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()


_per_process: dict = {}


def once(key, make):
    """One instance for each Python worker, kept between tasks (vocabularies, compiled tables)."""
    if key not in _per_process:
        _per_process[key] = make()
    return _per_process[key]


def forget(key) -> None:
    """Lets go of what `once` keeps, in this worker."""
    _per_process.pop(key, None)
