"""Shared session helpers: tables that cut lineage, and their removal."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Held only while this package writes a table of its own, then put back. Shuffle files go when
#: the write is done, not when the driver happens to collect its garbage; an Arrow batch, which
#: a task's JVM and Python side hold several times over, stays small.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}

_OWN_DIR: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session in one process (master ``local`` or ``local[n]``, as in tests) may leave it
    unset; a temporary folder stands in. Elsewhere executors would each write to their own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN_DIR:
        _OWN_DIR[context.applicationId] = tempfile.mkdtemp(prefix="loomvec-checkpoint-")
    return f"file://{_OWN_DIR[context.applicationId]}"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; those that the session names itself stay as they are."""
    mine = {k: v for k, v in values.items() if not _is_named(spark, k)}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in mine:
            spark.conf.unset(k)


def _is_named(spark: SparkSession, key: str) -> bool:
    return key in spark.conf.getAll


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table that ``drop_tables`` deletes."""
    path = f"{shared_dir(spark)}/loomvec/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_drop_all)
    _WRITTEN.append((spark, path))
    return path


def write(df: DataFrame, path: str, partition_by: str | None = None, **options: str) -> None:
    """Write a table as Parquet under ``WHILE_WRITING``."""
    with _settings(df.sparkSession, WHILE_WRITING):
        df.write.options(**options).parquet(path, partitionBy=partition_by)


def tables(spark: SparkSession) -> list[str]:
    """Paths of the tables that operators wrote in this session and nobody dropped yet."""
    return [path for owner, path in _WRITTEN if owner is spark]


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that operators wrote; call it once no result that reads them is used any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        _WRITTEN.remove((spark, path))


def _drop_all() -> None:
    for spark, path in list(_WRITTEN):
        try:
            drop_tables(spark, [path])
        except Exception:  # noqa: BLE001, PERF203  the session has ended: its folder is the cluster's to clean
            return


class Scratch:
    """Tables of one run of an operator, in the shared folder: lineage is cut, lost executors do not matter.

    ``drop`` deletes those that no later step reads. What the operator's (lazy) result reads
    stays until ``drop_tables`` or the end of the process.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table called ``name``; one of that name from before is deleted afterwards."""
        path = new_table_path(self.spark, name)
        write(df, path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        drop_tables(self.spark, [self.paths.pop(n) for n in names if n in self.paths])


def crc32_of_id(col: Column) -> Column:
    """crc32 of the decimal text of an integer id; null for a null id."""
    return F.crc32(col.cast("string").cast("binary"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
