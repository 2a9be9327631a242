"""Tables written to the folder that driver and executors share.

A table cuts the lineage of a frame: a lost executor costs only the stages
after it, and a number that a second run would draw differently is drawn once.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where it is unset and everything runs on one machine (tests, a
    laptop) a local folder stands in; on a cluster that is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not sc.getCheckpointDir():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="twinfold-"))
    return sc.getCheckpointDir().rstrip("/")


#: Folders that nobody has deleted yet, each with what deletes it.
_staged: dict[str, Callable[[], None]] = {}


def track(spark: SparkSession, path: str) -> None:
    """Delete a folder when the program ends, wherever it is stored."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    _staged[path] = lambda: system.delete(target, True)


def forget(path: str) -> None:
    """No longer delete a folder when the program ends."""
    _staged.pop(path, None)


def new_path(spark: SparkSession) -> str:
    """A folder of its own in the shared one, deleted when the program ends."""
    path = f"{shared_dir(spark)}/twinfold/{uuid.uuid4().hex}"
    track(spark, path)
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._twinfold_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that no later stage reads."""
    for frame in frames:
        if delete := _staged.pop(getattr(frame, "_twinfold_path", None), None):
            delete()


@contextmanager
def scope():
    """Delete on leaving whatever was staged inside, but for what is kept.

    ``with scope() as keep: ... return keep(stage(result))``. For callers that
    have a result written down before they leave; a result that is still to
    be read needs the tables it reads.
    """
    before, kept = set(_staged), set()

    def keep(frame: DataFrame) -> DataFrame:
        kept.add(getattr(frame, "_twinfold_path", None))
        return frame

    try:
        yield keep
    finally:
        for path in [p for p in _staged if p not in before and p not in kept]:
            _staged.pop(path)()


@atexit.register
def _clear() -> None:
    for path, delete in list(_staged.items()):
        try:
            delete()
        except Exception:  # noqa: BLE001  the JVM has gone; only a local folder can still be reached
            if path.startswith(("/", "file:")):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
