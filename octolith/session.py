"""Session helpers: where intermediate tables live and how a session for local runs is made."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, app: str = "octolith") -> SparkSession:
    """A session for tests and local runs; clusters bring their own configuration."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, with its file system's scheme.

    Only where the session has no such setting and runs on this machine alone (tests, a laptop) a local folder is made,
    which then serves checkpoint() as well. On a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return qualified(spark, configured)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="octolith-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir("file://" + own)
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) as Hadoop knows them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """A path with scheme: one without is on Spark's default file system."""
    fs, p = _hadoop(spark, path)
    return fs.makeQualified(p).toString().rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file of the shared folder, if it is there."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the shared folder."""
    return f"{shared_dir(spark)}/octolith/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Delete all that this application has written with work_path(); results that still read it are lost."""
    remove(spark, f"{shared_dir(spark)}/octolith/{spark.sparkContext.applicationId}")


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and a lost executor costs nothing."""
    path = work_path(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete tables that materialize() returned, once nothing reads them any more."""
    for df in tables:
        if df is not None and "written_to" in vars(df):
            remove(df.sparkSession, df.written_to)
