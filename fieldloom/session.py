"""Session settings every entry point of the library shares."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str | None = None, name: str = "fieldloom", **conf: str) -> SparkSession:
    """A session for one machine; a cluster passes its own and skips this."""
    n = str(cpus or os.cpu_count() or 4)
    settings = {
        "spark.sql.shuffle.partitions": n,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    } | conf
    builder = SparkSession.builder.master(f"local[{n}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str | Path, name: str) -> DataFrame:
    """One of the input tables, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see, from spark.checkpoint.dir; a local one only where that is unset."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if root is None and current.isDefined():
        root = current.get()
    if root is None and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if root is None:
        root = "file://" + tempfile.mkdtemp(prefix="fieldloom-")
    if not current.isDefined():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


class Rounds:
    """The tables of an iteration: each is written to the shared folder and read again, and takes the place of the one of its name before.

    So lineage ends at each round, a lost executor costs no more than its tasks, and a long iteration holds as much space as
    its last round. What stands at the end stays until the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.at, self.number = spark, f"{shared_root(spark)}/fieldloom-{uuid.uuid4().hex}", {}, 0
        atexit.register(self._remove, self.root)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """df as a table; what was kept under this name before may no longer be read."""
        self.number += 1
        path = f"{self.root}/{name}-{self.number}"
        df.write.parquet(path)
        if name in self.at:
            self._remove(self.at[name])
        self.at[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(self.at.pop(name))

    def _remove(self, path: str) -> None:
        try:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may have gone first; the folder is then the cluster's to clean
            pass
