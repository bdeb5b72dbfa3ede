"""Where tables that outlive a job are kept: the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path in spark.checkpoint.dir; where that is unset, under a local master, in one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="merchloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/merchloom-{uuid.uuid4().hex}"


def has_shared_folder(spark: SparkSession) -> bool:
    """Whether shared_folder has a place to give."""
    return bool(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()) or spark.sparkContext.master.startswith("local[")
