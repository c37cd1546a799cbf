"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in this library assumes. The time zone matters: dates are
# stored as TIMESTAMP_NTZ in UTC wall-clock, and zoned text is converted with
# the session zone.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files of frames no longer referenced are deleted, so a
    # long-running intake does not grow the shared folder without bound.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Checkpoints serialize rows with this; Kryo is faster and smaller than Java.
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ledgerloom", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; locally pass
    ``local[N]``. ``shuffle_partitions`` should be sized so one shuffle
    partition holds roughly 128-256 MB at the target data volume; AQE then
    coalesces small ones at run time.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staging tables.

    Read from ``spark.checkpoint.dir`` (what the cluster names). Only a local
    session (tests, a laptop) with the setting unset gets a fresh folder
    under the system temp directory; on a cluster an unset setting is an
    error, because a machine-local folder is invisible to other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a folder every "
                           "executor can reach (for example on HDFS or object storage)")
    local = tempfile.mkdtemp(prefix="ledgerloom-ckpt-")
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return sc.getCheckpointDir() or local


def staging_path(spark: SparkSession, name: str) -> str:
    """A path for a written intermediate table inside the checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/staging/{name}"


def staged(df: DataFrame, observe=None) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    For whole tables read several times: later reads prune columns, the
    planner knows true sizes, and a lost executor re-reads files. Columns go by
    position, so any header can be stored. ``observe=(observation, *metrics)``
    rides along with the write.
    """
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    if observe:
        plain = plain.observe(*observe)
    path = staging_path(df.sparkSession, uuid.uuid4().hex)
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*names)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialize ``df`` into the shared checkpoint folder and cut its lineage.

    For small intermediates read by several later steps (a per-column profile,
    say): they are computed once, and a lost executor re-reads the files
    instead of recomputing the whole upstream plan.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
