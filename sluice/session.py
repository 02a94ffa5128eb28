"""A session with the settings the plans expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "sluice", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, ANSI and adaptive execution; everything else is the cluster's own."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, x in {**defaults, **{k.replace("__", "."): str(x) for k, x in conf.items()}}.items():
        b = b.config(k, x)
    return b.getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path where driver and executors both reach it: under ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where neither is set, a session on one machine takes a temporary folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sluice-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
