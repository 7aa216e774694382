"""Session helpers: one place for the settings every job relies on."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the engine needs whatever the cluster: UTC wall clock, and the CSV
# parser must see every column so that short/long rows are reported in `_raw`.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.csv.parser.columnPruning.enabled": "false",
}

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "8g",
}


# Starting points for a large cluster (set by the job submitter, not by the library):
# ~128-256 MB per task on input and after shuffles, AQE to coalesce / split at run time.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}


def local_session(cores: str = "*", app: str = "feedyard", extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**LOCAL_CONF, **REQUIRED_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


_SHIPPED: set = set()
_ZIP: str | None = None


def ship_package(spark: SparkSession) -> None:
    """Make `feedyard` importable in the Python workers (pandas UDFs, stateful
    functions), as --py-files would: zip the package once per process and add it
    once per SparkContext."""
    global _ZIP
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    if _ZIP is None:
        import zipfile

        import feedyard
        root = os.path.dirname(os.path.abspath(feedyard.__file__))
        out = os.path.join(tempfile.mkdtemp(prefix="feedyard-pyfiles-"), "feedyard.zip")
        with zipfile.ZipFile(out, "w") as z:
            for dirpath, _, files in os.walk(root):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(dirpath, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        _ZIP = out
    sc.addPyFile(_ZIP)
    _SHIPPED.add(key)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the engine depends on to an existing session and ship the
    package to the Python workers."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    # stateful streams start a Python process on the driver, which has no added files
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ship_package(spark)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for staged tables and checkpoints.

    Uses the cluster's ``spark.checkpoint.dir``.  A local session without one (tests) gets
    a fresh local folder; on a cluster a missing setting is an error, since executors
    would write to disks of their own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="feedyard-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return str(d).rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    return "/".join([scratch_root(spark), *parts])


def fresh_scratch_path(spark: SparkSession, kind: str) -> str:
    return scratch_path(spark, f"{kind}-{uuid.uuid4().hex}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when `path` exists in its filesystem (the default one when it names no scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
