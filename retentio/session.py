"""Session set-up and scratch locations.

Every public query calls :func:`prepare_session` so results do not depend on
how the caller built the session: UTC session time, AQE with skew-join
splitting, and a checkpoint directory (kept when the cluster names one).
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession

_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "retentio") -> SparkSession:
    """Session for tests, the bench and local runs (Spark UI off)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.showConsoleProgress", "false"))
    for k, v in _CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


def prepare_session(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the operators rely on."""
    for k, v in _CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Only when the session names none and the master is local (tests) is a
    fresh local folder created and registered; on a cluster that folder would
    not reach the executors, so the call fails.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all "
                               "executors share: the intermediate tables are written there")
        path = tempfile.mkdtemp(prefix="retentio-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", path)
        except Exception:  # noqa: BLE001 - a core setting may be read-only at runtime
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the checkpoint directory for written tables."""
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/retentio-scratch/{spark.sparkContext.applicationId}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete everything this application wrote with :func:`scratch_path`:
    call it when no DataFrame made so far is read any more, at the latest
    before ``spark.stop()``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_once(df, name: str, codec: str | None = None):
    """Write ``df`` under the checkpoint folder and read it back: what reads
    it next neither recomputes it nor depends on the executors that made it.
    ``codec`` replaces the session's compression, for wide tables."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df) -> None:
    """Delete the folder behind a table that :func:`write_once` made."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/retentio-scratch/" in f}:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(conf).delete(p, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver find what no plan holds any more: Spark then drops the
    broadcasts and shuffle files of finished steps, which otherwise stay until
    the driver's heap happens to fill up."""
    gc.collect()  # Python's handles of the plans
    spark.sparkContext._jvm.System.gc()


def small_side(df, most: int = 500_000):
    """A join side marked for broadcast if it has at most ``most`` rows
    (written once and counted), else left to a shuffled join."""
    from pyspark.sql import functions as F
    df = write_once(df, "side")
    return F.broadcast(df) if df.count() <= most else df


def local_path(path: str) -> str:
    """Strip a file: scheme for local existence checks."""
    return path[len("file:"):] if path.startswith("file:") else path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(conf).exists(p))


__all__ = ["build_session", "prepare_session", "checkpoint_dir", "scratch_path",
           "path_exists", "local_path", "write_once", "drop_written", "small_side", "collect_garbage",
           "clean_scratch"]

