"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "feedline", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for.

    ``master`` is left to ``spark-submit`` when omitted.  Shuffle partitions
    are not pinned: AQE coalesces small ones, and a cluster should set
    ``spark.sql.shuffle.partitions`` (or the AQE initial number) to a small
    multiple of its cores.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    A local session that names none gets a fresh folder of its own; a cluster
    session that names none is refused, since a machine-local folder would be
    lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="feedline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_scratch(spark: SparkSession, label: str) -> str:
    """A path not used before, below the shared folder."""
    return f"{shared_folder(spark)}/feedline/{label}-{uuid.uuid4().hex}"
