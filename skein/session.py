"""Session construction and the shared work folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "skein") -> SparkSession:
    """A session configured the way the library expects (AQE on, UI off, UTC).

    On a cluster the caller's own builder settings win; this is for local runs,
    tests and the benchmark.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SKEIN_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and written tables.

    Uses ``spark.checkpoint.dir`` as configured on the cluster. Only a local
    session without that setting (tests, the benchmark) gets a fresh private
    folder, which is then recorded in the session so that every caller agrees.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _LOCAL_WORK:
        return _LOCAL_WORK[key]
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        try:
            path = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset
            path = None
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="skein-work-", dir="/tmp")
    _LOCAL_WORK[key] = path
    return path


_LOCAL_WORK: dict[str, str] = {}


def unique_subdir(spark: SparkSession, name: str) -> str:
    """A new, never reused folder under the shared work folder."""
    base = work_dir(spark)
    import uuid

    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
