"""Intermediate tables in the folder that the whole cluster shares.

Iterative operators cut their lineage by writing a Parquet table below ``spark.checkpoint.dir``.  Such a table survives
the loss of any executor, unlike a local checkpoint, and costs one columnar, compressed copy.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="stratalake-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh(name: str, df: DataFrame) -> str:
    """``name``, made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


BATCH_ROWS = 512


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Send documents to Python in small Arrow batches: Spark's default of 10,000 whole texts may be a GB on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


@contextmanager
def byte_batches(spark: SparkSession, most: int = 8 << 20):
    """Arrow batches that end at ``most`` bytes too, for tables whose rows may be whole blocks; what is run inside has to be eager."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """The intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return the written table; the plan behind it is cut off."""
        path = self.path(name)
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = (kept, path)
        return kept

    def discard(self, *tables: DataFrame) -> None:
        """Delete kept tables that nothing will read again."""
        for t in tables:
            _, path = self._paths.pop(id(t))
            self.drop(path)

    def exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def drop(self, path: str) -> None:
        """Delete one of the written tables."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that nobody holds any more (its cleaner waits for a collection)."""
        gc.collect()
        self.spark._jvm.System.gc()
