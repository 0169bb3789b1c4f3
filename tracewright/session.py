"""Session helpers: broadcast by measured size, and Python workers that find the package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
#: Rows that one task sorts, where the number of tasks follows the rows.
TASK_ROWS = 250_000
#: Folders of sessions without a shared one.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent a session of this machine alone takes a new
    local folder; on a cluster that is an error, as executors would write
    where the driver can't read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="checkpoints-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        folder = _LOCAL[app]
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage, its rows in the shared folder; Spark drops them with the last reference if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` has at most ``limit`` rows (counted here if not given); else the join shuffles."""
    n = df.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def tasks(rows: int, each: int = TASK_ROWS) -> int:
    """Partitions for so many rows, given to ``repartition``: Spark merges small ones by their compressed bytes, which does not bound what a task sorts. At least two, as a join deals a single one anew."""
    return max(2, -(-rows // each))


def importable(spark: SparkSession) -> None:
    """Let this machine's Python workers find the package; on a cluster it is shipped with --py-files."""
    root = str(Path(__file__).parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
