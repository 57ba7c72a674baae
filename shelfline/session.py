"""SparkSession helpers.

The library never hard-codes cluster settings.  ``get_session`` is what
tests and ``bench.py`` use locally; on a cluster the caller's session is
used as is.  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the
session and only falls back to a scratch folder when it is unset (local
tests), as a shared folder is required on a real cluster.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "shelfline") -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests) gets a temporary folder; on a
    cluster that would put each executor's files on its own disk, so it raises.
    """
    conf = spark.sparkContext.getConf()
    current = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc = spark.sparkContext
        sc._shelfline_checkpoints = current = getattr(sc, "_shelfline_checkpoints", None) or tempfile.mkdtemp(prefix="shelfline-ckpt-")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(current)
    return current


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers (once a context, on any master), so that
    queries run whatever their working folder."""
    sc = spark.sparkContext
    if getattr(sc, "_shelfline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="shelfline-"), "shelfline"), "zip",
                                 os.path.dirname(root), os.path.basename(root))
    sc.addPyFile(target)
    sc._shelfline_shipped = True
