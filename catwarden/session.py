"""Session helpers.

On a cluster the session is created by the platform; these helpers only
fill in settings that are unset (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # windows-1252 decoding of script bytes (F07) needs the JVM charsets
    "spark.sql.legacy.javaCharsets": "true",
}


def local_session(cpus: int | str = "*", app: str = "catwarden") -> SparkSession:
    """A local[N] session for tests and the bench; never used on a cluster."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", os.environ.get("CATWARDEN_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the cluster names in
    ``spark.checkpoint.dir``. Only a local session (tests, bench) gets a
    scratch folder where it is unset; elsewhere that is an error, as executors
    would not see each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="catwarden-ckpt-", dir="/tmp")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def ship_package(spark: SparkSession) -> None:
    """Make ``catwarden`` importable in Python workers (mapInPandas and
    pandas UDF bodies live in this package): zip it once per SparkContext and
    ``addPyFile`` it, which is how Python code reaches executors."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_catwarden_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="catwarden-pkg-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._catwarden_shipped = True
