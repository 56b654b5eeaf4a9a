"""Session helpers: building a session for tests/bench and locating the
shared working folder (spark.checkpoint.dir) for written intermediates."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app: str = "dsengine") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is. Only when it is unset (local tests) a folder is created.
    """
    sc = spark.sparkContext
    # Python workers on this machine find the package where the driver found it
    sc.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    current = sc.getCheckpointDir()
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="dsengine-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables.

    The folder is a URI (``file:/...``, ``hdfs://...``, ``s3a://...``) or an
    absolute path; a bare relative path is resolved against the working
    directory only as a last resort."""
    base = ensure_checkpoint_dir(spark)
    if not _SCHEME.match(base) and not os.path.isabs(base):
        base = os.path.abspath(base)
    return f"{base.rstrip('/')}/dsengine-{name}-{uuid.uuid4().hex[:12]}"
