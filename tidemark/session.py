"""Session set-up shared by the bench, the tests and interactive use."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


#: the folder that holds the package
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> str:
    """Send the package to the executors of a cluster that has it not installed; returns the archive's path on the driver."""
    here = os.path.join(ROOT, "tidemark")
    archive = os.path.join(tempfile.mkdtemp(prefix="run-tidemark-ship-"), "tidemark.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, ROOT))
    spark.sparkContext.addPyFile(archive)
    return archive


def local_session(cores: int = 8, app: str = "tidemark", shuffle: int | None = None) -> SparkSession:
    """A local session with the settings the library expects from a cluster."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # window stages are CPU-bound: let small exchanges keep one partition per core
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.executorEnv.PYTHONPATH", os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")])))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(master: str, configured: str | None) -> str:
    """The folder for checkpoints and intermediate tables: the configured one; a scratch one of this machine on a local master only."""
    if configured:
        return configured
    if master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="run-tidemark-")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; see ``scratch_root``."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    sc.setCheckpointDir(scratch_root(sc.master, spark.conf.get("spark.checkpoint.dir", None)))
    return sc.getCheckpointDir()
