"""Tables that cut lineage, kept in the folder the cluster shares.

``spark.checkpoint.dir`` names that folder.  Where it is unset and the master
is local (tests, a single machine) a folder below the system's temporary folder
is used; elsewhere that would not be shared, so it is an error.
Written tables are removed when the session's Python process ends, or sooner
through ``drop``; a lost executor never takes one with it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="roadkrige-"))
    return _LOCAL[0]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def drop(*tables: DataFrame) -> None:
    """Remove tables made by ``table`` that nothing reads any more; other data is never touched."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            remove(df.sparkSession, path)
            _WRITTEN[:] = [w for w in _WRITTEN if w[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            if spark._jsc is not None and not spark._jsc.sc().isStopped():
                remove(spark, path)
        except Exception:  # the JVM may be gone already
            return
