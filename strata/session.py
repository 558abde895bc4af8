"""Session builder and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# Keeps the state of streams on disk instead of in the executors' heaps.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "strata", master: str | None = None, **conf: object) -> SparkSession:
    """Session with UTC time and adaptive execution; extra settings use ``_`` for ``.`` or a full key."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key if "." in key else key.replace("_", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder; a cluster without it is an
    error, because a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="strata-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; never reused, so a retry cannot read old data."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
