"""Session defaults and the few settings the operators read from the session."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "ledgerlark", master: str | None = None, **conf: object) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def slice_count(spark: SparkSession) -> int:
    """How many ordered slices an order-dependent operator cuts a key into (4 per shuffle partition)."""
    configured = spark.conf.get("spark.ledgerlark.slices", None)
    return int(configured) if configured else 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_rows(spark: SparkSession) -> int:
    """Rows a key may put into one task of an ordered operator before it is cut into slices."""
    return int(spark.conf.get("spark.ledgerlark.hotRows", "1000000"))


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder of the session, ``spark.checkpoint.dir``.

    In local mode a session without that setting gets a temporary folder, removed when the driver ends. On a cluster there is no
    such substitute: every executor would write to its own disk, so a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set: {master} needs a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="ledgerlark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/ledgerlark-{uuid.uuid4().hex}"
