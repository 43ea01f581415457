"""Session helpers: one place for the SQL settings every operator relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings whose value changes results, not only speed.
_RESULT_CONFS = {
    "spark.sql.session.timeZone": "UTC",
    # from_json / map_from_entries keep the last duplicate key, like a JSON
    # object decoded into a map.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Settings for scale: runtime re-planning, skew splitting, partition sizing.
_SCALE_CONFS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # a top-n per key is cut in each task before the shuffle up to this n (a forest's pool is 25,600)
    "spark.sql.optimizer.windowGroupLimitThreshold": "32768",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the result-relevant and scale settings to a live session and make
    the package importable by the Python workers."""
    for k, v in {**_SCALE_CONFS, **_RESULT_CONFS}.items():
        spark.conf.set(k, v)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Distribute this package to the executors once per SparkContext.

    Pandas UDFs and kernels are pickled by reference, so every Python worker
    must be able to import ``signalspark``; ``addPyFile`` ships a zip of it
    through Spark's own file distribution (works the same on a cluster).
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="signalspark-pkg-"), "signalspark.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def get_spark(app: str = "signalspark", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    ``master`` defaults to ``local[$SIGNALSPARK_CPUS or *]`` only when no
    master is configured, so cluster submissions keep their own.
    """
    b = SparkSession.builder.appName(app)
    if master is None and not os.environ.get("SPARK_MASTER") and not _has_master():
        master = f"local[{os.environ.get('SIGNALSPARK_CPUS', '*')}]"
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.driver.memory", os.environ.get("SIGNALSPARK_DRIVER_MEM", "8g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def _has_master() -> bool:
    active = SparkSession.getActiveSession()
    return active is not None


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting one only for local runs.

    On a cluster ``spark.checkpoint.dir`` must name a shared, reliable folder
    (HDFS/S3/ABFS); a machine-local temporary folder would not survive the
    loss of an executor, so it is refused there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on the cluster")
    d = tempfile.mkdtemp(prefix="signalspark-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()
