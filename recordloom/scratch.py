"""Where intermediate files go: the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from .errors import ConfigError


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and every executor reach: spark.checkpoint.dir.

    Only a session on one machine (as in tests) that has none gets a temporary
    folder; on a cluster it must be set.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.partition("[")[0] == "local":
            raise ConfigError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-recordloom-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
