"""What executors share: fresh folders that go with the application, and tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, also made the checkpoint folder of the session.

    Where it is unset, a session on one machine gets a folder there; a cluster's session is refused,
    as its executors would not see each other's files.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="gridmill-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; all paths of an application are deleted when it ends."""
    home = f"{shared_folder(spark)}/gridmill/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a frame that a plan reads many times as a table in the shared folder, and reads it back."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
