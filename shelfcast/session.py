"""Session helpers: a tuned builder for local runs and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "shelfcast",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session for scripts, tests and the bench. On a cluster, pass master=None
    and let spark-submit decide; the settings below are all size-independent."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # Joins may reuse a hash partitioning on a subset of their keys (the
         # zero-fill grid is partitioned by item only and balanced by design).
         .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
         # one BLAS thread per Python worker: tasks already use every core
         .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
         .config("spark.executorEnv.OMP_NUM_THREADS", "1")
         .config("spark.driver.memory", os.environ.get("SHELFCAST_DRIVER_MEMORY", "8g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    It is read from the session. Only a local-mode session without the setting
    (tests) gets a fresh folder of its own; a cluster without it is an error,
    because a machine-local folder does not survive executor loss.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) on a cluster")
        d = tempfile.mkdtemp(prefix="shelfcast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_SHIPPING = threading.Lock()     # fits run side by side, and Spark refuses a second archive of the same name


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Tasks import their kernels by name, so an application that was not started
    with ``--py-files`` still runs on a cluster. The archive is built in a
    driver-local temporary folder and travels through Spark's own file service.
    """
    sc = spark.sparkContext
    with _SHIPPING:
        if getattr(sc, "_shelfcast_shipped", None):
            return
        root = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="shelfcast-ship-"), "shelfcast_pkg.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        sc.addPyFile(path)
        sc._shelfcast_shipped = path
