"""Cutting a plan at a written table, and the size check that decides how a
run is folded.

Ordered work is done per *block* of at most ``BLOCK_LINES`` lines of one run.
A run that fits one block is folded in one bounded group; a longer run is cut
into blocks whose effects are combined in order, so no task ever holds a whole
run of unbounded size.
"""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testlog.session import configure

BLOCK_LINES = 4096

_FOLDERS: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Folder that the driver and every executor share.

    ``spark.checkpoint.dir`` names it.  Where that is unset, a session on one machine
    uses its warehouse; on a cluster no folder is sure to be shared, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder shared by the whole cluster ({master})")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return root.rstrip("/")


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM has gone first; the folder stays behind
        pass


def session_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one, removed at its end."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{checkpoint_root(spark)}/testlog-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, _FOLDERS[app])
    return _FOLDERS[app]


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later branches read the table instead of recomputing their input, and a
    lost executor costs only the tasks it ran.
    """
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """``store`` under the session settings that the log operators rely on."""
    configure(df.sparkSession)
    return store(df)


def any_row(df: DataFrame) -> bool:
    return len(df.limit(1).take(1)) > 0


def exceeds(df: DataFrame, col: str | Column, limit: int) -> bool:
    """Does any row go past ``limit``?  Reads only that column and stops at a hit."""
    value = F.col(col) if isinstance(col, str) else col
    return any_row(df.select(value.alias("v")).filter(F.col("v") > limit))
