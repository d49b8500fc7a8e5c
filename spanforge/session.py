"""Session settings and the shared scratch folder.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir``, the folder all
executors share, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.shuffle.partitions": "8",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "spanforge", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a local master may run without that setting; it then gets a temporary folder that
    is removed at exit. On a cluster a missing setting is an error, as a folder of one
    machine would not survive the loss of that machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="spanforge-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", "file://" + path)
    return "file://" + path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; other faults of the file system are raised."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


class Scratch:
    """Named intermediate tables of one run in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/spanforge/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self._at_exit)

    def write(self, df: DataFrame, label: str, **options: str) -> DataFrame:
        """Write ``df`` and return it as read again, without its lineage."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}-{label}"
        df.write.options(**options).mode("errorifexists").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that ``write`` gave and nothing reads any more."""
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path:
                self._delete(path)

    def drop_all(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _at_exit(self) -> None:
        local = self.root.removeprefix("file://")
        if os.path.isdir(local):
            shutil.rmtree(local, ignore_errors=True)
        elif self.spark.sparkContext._jsc is not None and not self.spark.sparkContext._jsc.sc().isStopped():
            self._delete(self.root)
