"""Tables between stages, kept in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructField, StructType

_LOCAL: list[str] = []
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; in local mode, where one machine runs all, a temporary folder if it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _LOCAL:
        folder = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL.append("file://" + folder)
    return _LOCAL[0]


@contextmanager
def bounded_jobs(spark: SparkSession) -> Iterator[None]:
    """For the queries that run inside: shuffle files go when each one ends, and batches for Python are small however long texts are."""
    before = {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """A private folder of written tables.

    Writing a table cuts the lineage: a lost executor re-reads files instead of
    recomputing, and the shuffle files behind the table go at once.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/docloom-{label}-{uuid.uuid4().hex[:12]}"
        self._schemas: dict[str, StructType] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = (), codec: str = "zstd") -> DataFrame:
        writer = df.write.mode("overwrite").option("compression", codec)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with bounded_jobs(self.spark):
            writer.parquet(self.path(name))
        self._schemas[name] = df.schema
        return self.read(name)

    def write_turns(self, make: Callable[[int], DataFrame], name: str, turns: int, partition_by: tuple[str, ...] = (), codec: str = "zstd", done: Callable[[int], None] = lambda t: None) -> DataFrame:
        """One table written in several turns, so that the shuffle files of one turn are there at a time; ``done`` is called after each.

        The table has its turn as a column, ``turn``, if there are several, and partitions ``turn=0`` and so on that can be dropped.
        """
        for t in range(turns):
            out = self.write(make(t), name if turns == 1 else f"{name}/turn={t}", partition_by, codec)
            done(t)
        if turns > 1:
            self._schemas[name] = StructType([*out.schema.fields, StructField("turn", IntegerType())])
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        """A table written here; its schema is known, so an empty one reads as well."""
        return self.spark.read.schema(self._schemas[name]).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, name: str) -> None:
        """Delete a table, or one partition of it, that nothing reads any more."""
        self._delete(self.path(name))
        self._schemas.pop(name, None)

    def keep(self, *names: str) -> None:
        """Delete all tables but those that a result still reads."""
        for name in [n for n in self._schemas if n not in names]:
            self.drop(name)
