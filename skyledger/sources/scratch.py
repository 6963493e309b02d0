"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_PATHS: dict[str, SparkSession] = {}
_PATH_OF: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset a local session (tests) gets a temporary
    folder; on a cluster that raises, since executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; removed when the driver ends at the latest."""
    path = f"{shared_folder(spark)}/skyledger-{uuid.uuid4().hex}/{name}"
    _PATHS[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here, and later steps
    neither plan nor compute it anew."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATH_OF[out] = path
    return out


def discard(*tables: DataFrame | str) -> None:
    """Removes tables that ``written`` made, or paths of ``new_path``, that nothing reads any more."""
    for table in tables:
        if path := table if isinstance(table, str) else _PATH_OF.pop(table, None):
            _remove(path, _PATHS.pop(path))


def _remove(path: str, spark: SparkSession) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in _PATHS.items():
        try:
            _remove(path, spark)
        except Exception:  # noqa: BLE001  the session is gone already
            return
