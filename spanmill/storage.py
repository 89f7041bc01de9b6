"""Written intermediate tables.

Iterative operators cut their lineage by writing a parquet table into the
folder that all executors share (``spark.checkpoint.dir`` of the session).  A
lost executor then costs a re-read and never a recomputation of the loop.  The
folder is set here only where the session names none, as in local tests.

A result reads such tables until it is used, so operators can't delete them all;
:func:`release` deletes what is left of a session, and so does the end of the
Python process while the session lives.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_used: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spanmill-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def session_dir(spark: SparkSession) -> str:
    """The session's own folder within the shared one."""
    path = f"{shared_dir(spark)}/spanmill/{spark.sparkContext.applicationId}"
    if path not in _used:
        if not _used:
            atexit.register(lambda: [release(s) for s in list(_used.values())])
        _used[path] = spark
    return path


def release(spark: SparkSession) -> None:
    """Deletes all written tables of the session; results that still read them can't be used any more."""
    path = session_dir(spark)
    _used.pop(path, None)
    if spark.sparkContext._jsc is not None:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_table(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Writes ``df`` into the shared folder and returns a scan of what was written."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    w = df.write
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanmill_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Deletes a table of :func:`write_table`; anything else is left alone."""
    path = getattr(df, "_spanmill_path", None)
    if path is None:
        return
    _delete(df.sparkSession, path)
