"""Session settings and staging: intermediate tables written once below a shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the plans in this package are written for. Everything else (executor
# sizes, shuffle partition count) belongs to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the Python call site of every expression slows wide plans down.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "dayloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session carrying :data:`SETTINGS` plus ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_STAGED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read; the caller's configuration is left as it is.

    ``spark.checkpoint.dir`` of the session or the checkpoint folder of its context; where
    neither is set, a folder below the warehouse, which executors share by definition.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (
        configured
        or spark.sparkContext.getCheckpointDir()
        or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    )


def staged_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`, removed by :func:`clear_staged` or at exit."""
    path = f"{shared_dir(spark).rstrip('/')}/dayloom-{name}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _STAGED:
        _STAGED[app] = []
        atexit.register(_clear_at_exit, spark)
    _STAGED[app].append(path)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Ends the lineage with a table that outlives any executor and can be read column by column.
    """
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove what was staged: all of it, or only the files that ``frames`` read."""
    kept = _STAGED.get(spark.sparkContext.applicationId, [])
    files = [f for frame in frames for f in frame.inputFiles()]
    jvm = spark.sparkContext._jvm
    for path in list(kept):
        mark = path.rsplit("/", 1)[1]
        if frames and not any(f"/{mark}/" in f for f in files):
            continue
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        kept.remove(path)


def _clear_at_exit(spark: SparkSession) -> None:
    try:
        clear_staged(spark)
    except Exception:  # noqa: BLE001  the session is gone, and with it the way to the folder
        pass
