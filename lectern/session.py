"""Session and checkpoint helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(cpus: int = 8, app: str = "lectern", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in
    ``spark.checkpoint.dir``. Only where neither that setting nor a checkpoint
    folder exists (tests, a laptop) and the master is local, one is made."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir")
    if not at and sc._jsc.sc().getCheckpointDir().isDefined():
        at = sc._jsc.sc().getCheckpointDir().get()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lectern-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of an explicit repartition, as the session sets them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table_bytes(path: str, spark: SparkSession) -> int:
    """Size of the files under a path, by the session's own file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def env_dir(name: str, default: str) -> str:
    return os.environ.get(name, default)
