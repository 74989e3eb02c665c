"""The folder that driver and executors share, and what this process wrote there for itself."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession

#: Folders of intermediate results that this process made and nobody has discarded.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is, a temporary one, but only if all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="ledgerlake-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A name for an intermediate result. It is deleted by ``discard``, or when the process ends."""
    if not _MADE:
        atexit.register(_at_exit)
    _MADE.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def made() -> list[str]:
    return list(_MADE)


def discard(spark: SparkSession, folders: Iterable[str]) -> None:
    """Deletes intermediate results that no DataFrame in use reads any more."""
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if folder in _MADE:
            _MADE.remove(folder)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _MADE:
        try:
            discard(spark, made())
        except Exception:  # the session has ended: the folder's owner cleans up
            pass
