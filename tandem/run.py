"""What a run leaves behind, and its end.

Persisted frames, laid-out tables and scratch folders belong to a ``Run`` and
go when it is closed. Flows open one of their own::

    with Run(spark) as run:
        ...

Frames made outside of such a block belong to the session's run, which lasts
until ``release(spark)`` or the end of the process: a query returns a lazy
frame, and what that reads must outlive the call.
"""

from __future__ import annotations

import atexit
import contextlib
import threading
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_ACTIVE: ContextVar[tuple] = ContextVar("tandem_runs", default=())
_SESSIONS: dict[str, "Run"] = {}
_LOCK = threading.Lock()


class Run:
    """Owner of persisted frames, tables and folders."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.frames: list[DataFrame] = []
        self.tables: list[str] = []
        self.folders: list[str] = []
        self.bound: dict[tuple, DataFrame] = {}
        self._token = None

    def keep(self, df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
        """Persist a frame that feeds several branches or actions; lineage
        stays, so lost blocks are computed again."""
        kept = df.persist(level)
        with _LOCK:
            self.frames.append(kept)
        return kept

    def own_table(self, name: str) -> None:
        with _LOCK:
            self.tables.append(name)

    def own_folder(self, path: str) -> None:
        with _LOCK:
            self.folders.append(path)

    def close(self) -> None:
        """Unpersist, drop and delete all that the run owns. Frames that only
        read persisted ones still work; they compute those again."""
        with _LOCK:
            frames, tables, folders = self.frames, self.tables, self.folders
            self.frames, self.tables, self.folders, self.bound = [], [], [], {}
        for df in frames:
            df.unpersist()
        for name in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in folders:
            delete(self.spark, path)

    def __enter__(self) -> "Run":
        self._token = _ACTIVE.set((*_ACTIVE.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _ACTIVE.reset(self._token)
        self.close()


def current(spark: SparkSession) -> Run:
    """The innermost open run of this thread, else the session's."""
    active = _ACTIVE.get()
    if active and active[-1].spark.sparkContext.applicationId == spark.sparkContext.applicationId:
        return active[-1]
    with _LOCK:
        return _SESSIONS.setdefault(spark.sparkContext.applicationId, Run(spark))


def release(spark: SparkSession) -> None:
    """Close the session's run; results built on it must have been read."""
    with _LOCK:
        run = _SESSIONS.pop(spark.sparkContext.applicationId, None)
    if run:
        run.close()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can write."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _at_exit() -> None:
    for run in list(_SESSIONS.values()):
        if run.spark.sparkContext._jsc is not None:  # the session hasn't been stopped
            with contextlib.suppress(Exception):  # nobody is left to tell
                run.close()
