"""Session settings shared by tests, bench and the entry module."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators are designed around.  AQE re-plans joins from measured
# sizes (runtime broadcast only below the threshold) and splits skewed join
# partitions; partial aggregation is Spark's default for every groupBy used here.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def get_session(master: str | None = None, app: str = "linkloom",
                shuffle_partitions: int | None = None, extra: dict | None = None
                ) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for sessions
    whose workers don't have it on their path."""
    import shutil
    import tempfile

    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="linkloom-"), "linkloom"), "zip",
                                   os.path.dirname(package), os.path.basename(package))
        sc.addPyFile(made)  # the driver serves the file, so its folder need not be shared
        _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and lineage-cutting tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system).  Only a session whose master is local, as in tests, may leave
    it unset: a fresh temporary folder is then taken and registered.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="linkloom-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def reliable_checkpoint(df):
    """``df.checkpoint()`` into the shared checkpoint folder (set first when
    the session has none, as in tests): the data is written to storage that
    survives executor loss and the lineage is cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for a written table."""
    base = checkpoint_dir(spark)
    import uuid
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
