"""Session helpers: a local session for tests/bench and the checkpoint folder rule.

Library code never creates a session; it receives one. Only tests, the bench and the
smoke entry call :func:`local_session`.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "prepline") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", os.environ.get("PREPLINE_SESSION_TZ", "UTC"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PREPLINE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The setting is read from the session. Only a local-mode session (tests, bench) may get
    a folder of our own when the setting is absent; on a cluster a missing setting is an
    error, because a machine-local folder does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="prepline-ckpt-", dir="/tmp")
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path
    raise RuntimeError("spark.checkpoint.dir is not set; iterative operators need a shared checkpoint folder")


def cut_lineage(df):
    """Reliable checkpoint (never a local one): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_round(df):
    """:func:`cut_lineage` for a table that meets itself again in the next round. A checkpoint keeps the size
    the planner estimated, for a join the product of both sides, so the digits of that number multiply from
    round to round until the driver's memory cannot hold it. Files under the checkpoint folder have the
    size they have; they stay there, so this is for narrow tables."""
    base = checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/prepline-rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut_in_place(df):
    """:func:`cut_round` for a table whose partitions count (MLlib draws a forest's bags by partition): each
    row stays in its place. The table is made anew from its rows, so the checkpoint keeps the fixed estimate of
    a table of unknown size and its digits do not multiply."""
    spark = df.sparkSession
    rows = spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema())
    return cut_lineage(DataFrame(rows, spark))
