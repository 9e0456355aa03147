"""A folder that the driver and all executors see."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place below the session's ``spark.checkpoint.dir``; where that is unset, a session on one machine gets a temporary folder and one on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/gatewise/{name}-{uuid.uuid4().hex}"


LOGS = "spark.sql.streaming.checkpointFileManagerClass"
LOCAL = {LOGS: "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


@contextmanager
def local_logs(spark: SparkSession, folder: str) -> Iterator[None]:
    """Streams that start herein with checkpoints in a local folder write their logs through Hadoop's FileSystem without checksum files, elsewhere as Spark chooses.

    Spark's choice for local files runs chmod and readlink as processes, some 20 for each batch where Hadoop's native library isn't there; so it's one for each log, and one for a checksum's file
    where that is written. A rename is atomic on local disks.
    """
    before = {name: spark.conf.get(name, None) for name in LOCAL}
    ours = LOCAL if before[LOGS] is None and re.match(r"file:|/", folder) else {}
    for name, value in ours.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in ours:
            spark.conf.unset(name) if before[name] is None else spark.conf.set(name, before[name])


@cache
def settled(step: str) -> None:
    """Once for each step in a Python worker: leave what it holds by now, above all modules, out of later searches for garbage.

    Spark's workers search all objects after every task. With numpy, pandas, pyarrow and pyspark loaded that took some 66 ms, more than a small task.
    """
    gc.collect()
    gc.freeze()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read again: computed once, safe from lost executors, and of a size that Spark knows when it picks a join."""
    place = shared_folder(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
