"""Tables in the folder that all executors share: they cut lineage, and go when nobody reads them any more."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: The setting by which a written query's shuffle files go with it: the table holds all that they held.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What was written and not deleted yet: by path, the function that deletes it.
_written: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, or the checkpoint folder of its context.

    Where neither is set, a temporary folder serves a local master, whose tasks all
    run on this machine; on a cluster there is no such folder, and this is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which is deleted with this process at the latest."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    _written[path] = lambda: files.delete(target, True)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lost executors cost no rework, and rows stay in the partitions they were dealt to.

    The shuffle files behind ``df`` go when the table is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._tessera_path = path
    return found


def drop_path(path: str) -> None:
    """Deletes what ``new_path`` gave; nothing where it has gone."""
    delete = _written.pop(path, None)
    if delete is not None:
        delete()


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that ``materialize`` writes inside are deleted at the end, but for those put into the list."""
    before, kept = set(_written), []
    yield kept
    for path in set(_written) - before - {df._tessera_path for df in kept}:
        drop_path(path)


@atexit.register
def _drop_all() -> None:
    for path in list(_written):
        with contextlib.suppress(Exception):  # the JVM may have ended before
            drop_path(path)
