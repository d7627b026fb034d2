"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; local sessions without it get a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        # the executors of local-cluster[...] are other processes
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="sablecloth-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where}/{name}-{uuid.uuid4().hex}"
