"""Tables written once to the folder in spark.checkpoint.dir, so that iterative plans keep a short lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
#: Spark's setting, read at each write, by which the shuffle files of a query are removed at its end.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own, if driver and executors are one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="quarry-"))
    return _own_dir[0]


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """The rows in as many partitions as there are cores, where a small input comes in fewer: for long work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Scratch:
    """A folder of intermediate tables; a lost executor costs no earlier step."""

    def __init__(self, spark: SparkSession, name: str, frees: bool = False):
        """frees: the shuffle files that a table is made from go once it is written, rather than when the driver next collects garbage."""
        self.frees = frees
        self.spark, self.base = spark, f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0

    def path(self, name: str = "t") -> str:
        self.count += 1
        return f"{self.base}/{self.count:03d}-{name}"

    def table(self, df: DataFrame, name: str = "t", compression: str = "snappy") -> DataFrame:
        path = self.path(name)
        with self._freeing():
            df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    @contextmanager
    def _freeing(self) -> Iterator[None]:
        before = self.spark.conf.get(FREED, None)
        if self.frees:
            self.spark.conf.set(FREED, "true")
        try:
            yield
        finally:
            if self.frees:
                self.spark.conf.unset(FREED) if before is None else self.spark.conf.set(FREED, before)

    def keep(self, *tables: DataFrame) -> None:
        """Drops all others; as for drop(), nothing that is still to be written may read them."""
        kept = {id(t) for t in tables}
        for k in [k for k in self.paths if k not in kept]:
            remove(self.spark, self.paths.pop(k))

    def drop(self, *tables: DataFrame) -> None:
        """Only for tables from which everything that reads them has been written."""
        for t in tables:
            if path := self.paths.pop(id(t), None):
                remove(self.spark, path)
