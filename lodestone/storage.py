"""Tables that operators put down on their way, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder if all
    run in this one process; on a cluster that would lose data, so ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables that this process has made in the shared folder.
_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """Where a new table can be; it stays until clear(), until its owner deletes it or until this process ends."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many tables this process has made and not deleted."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete the tables of this process, or those of a slice of them in the order they were made. Call it once results
    are written, as they read from them."""
    for path in _made[since:until]:
        delete_path(spark, path)


@atexit.register
def _clear_at_exit() -> None:
    context = SparkContext._active_spark_context
    if _made and context is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone
            clear(SparkSession(context))


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder, read it again. Survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a table of ours from the shared folder, with the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _made:
        _made.remove(path)
