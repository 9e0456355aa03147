"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (tests) gets a temporary folder; on a cluster, where
    executors wouldn't see that, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme under which Spark itself would find it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


#: Folder of the intermediate tables of the work at hand, below the shared one.
_folder: ContextVar[str] = ContextVar("folder", default="kept")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gatewise/{_folder.get()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """Intermediate tables of the block go to a folder of their own; the function it gives deletes them, once what reads them is written."""
    own = f"work-{uuid.uuid4().hex}"
    before = _folder.set(own)
    try:
        yield lambda: _delete(spark, own)
    finally:
        _folder.reset(before)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gatewise/{folder}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The same, dealt into sorted buckets by the columns ``by``: joins on them read it without another shuffle.

    Buckets need a name in the catalog, which is dropped at once: the table is external, so its files stay, and the result's plan has the buckets already.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"gatewise_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.repartition(parts, *by).write.bucketBy(parts, *by).sortBy(*by)
    writer.option("compression", "zstd").option("path", fresh_path(spark, name)).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return found
