"""Session construction for tests and benches, and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN_DIRS: dict[str, str] = {}


def local_session(app: str = "valuwatch", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """Single-JVM session used by tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("VALUWATCH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """One folder per application below `spark.checkpoint.dir`, which a cluster points at shared storage.

    Where the setting is absent the folder given to `setCheckpointDir` is used.  A single-JVM session
    (tests, bench) may fall back to a temporary folder; any other master without a shared folder is an
    error, since executors elsewhere could not read what one of them wrote.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _RUN_DIRS:
        base = (spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
                or sc.getCheckpointDir())
        if not base:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="valuwatch-")
        _RUN_DIRS[sc.applicationId] = f"{base.rstrip('/')}/valuwatch-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
    return _RUN_DIRS[sc.applicationId]


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write `df` to the shared scratch folder, partitioned by column `by`, and read it back.

    Cuts the lineage on durable storage, so a lost executor costs a re-read and not a re-run.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Remove the folders of `written` tables that nothing reads any more, such as superseded rounds."""
    for df in frames:
        path = getattr(df, "_written_to", None)
        if path and path.startswith(scratch_dir(df.sparkSession) + "/"):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
