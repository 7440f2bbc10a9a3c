"""Spark session and shared-storage helpers.

The library never creates its own session inside an operator: every function
takes DataFrames (or a session) from the caller.  ``local_session`` is only for
tests, the bench and the driver entry point.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at any scale: AQE re-plans joins and partition counts at
# runtime from real shuffle sizes, splits skewed join partitions, and the
# session zone is pinned so NTZ timestamps and interval arithmetic agree with
# the oracle.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "slotbook", extra: dict | None = None) -> SparkSession:
    """A local-mode session for tests and the bench (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("SLOTBOOK_DRIVER_MEMORY", "16g")
    # Generated code is cached per JVM (100 entries by default).  A service
    # that runs ~50 distinct jobs in turn thrashes that cache and recompiles
    # every stage (measured: 38.6 s -> 28.0 s for one round of all keys).
    conf.setdefault("spark.sql.codegen.cache.maxEntries",
                    os.environ.get("SLOTBOOK_CODEGEN_CACHE", "2000"))
    # keep table metadata of local runs out of the working directory
    conf["spark.sql.warehouse.dir"] = tempfile.mkdtemp(prefix="slotbook-wh-")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is always used as is.
    Only when it is unset and the master is local (tests, local runs) do we set
    a private folder; elsewhere a machine-local folder would lose data, so an
    unset folder is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: the server owns the setting)
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "") if sc is None else sc.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to storage that all executors share")
        configured = tempfile.mkdtemp(prefix="slotbook-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint location.

    Used for streaming checkpoints and landing folders: everything a job writes
    must live on storage every executor (and a restarted driver) can reach.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Materialise ``df`` as a reliable checkpoint under ``spark.checkpoint.dir``.

    An eager checkpoint runs the plan once to materialise and once more to
    write the files; persisting first makes the second pass read the cached
    blocks instead of recomputing.  The returned DataFrame reads the
    checkpoint files only (no lineage back to ``df``), so losing an executor
    later costs a re-read, not a recomputation.
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return cached.checkpoint(eager=True)
    finally:
        cached.unpersist(blocking=False)


def scale_conf(largest_shuffle_bytes: int, partition_bytes: int = 256 << 20,
               max_partitions: int = 200_000) -> dict[str, str]:
    """Settings that size partitions for a given data volume.

    ``largest_shuffle_bytes`` is the expected size of the biggest shuffle (for
    the booking jobs: the booking or event table after column pruning).  The
    shuffle gets enough partitions for ``partition_bytes`` each, and AQE
    coalesces the ones that turn out small; scans split at the same size.
    """
    parts = max(1, min(max_partitions, -(-largest_shuffle_bytes // partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }
