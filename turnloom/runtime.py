"""Session settings and scratch tables.

Iterative operators cut their lineage by writing a table below the folder that the cluster names in
``spark.checkpoint.dir``; every executor can read it again, so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: list[str] = []
_tables: dict[str, SparkSession] = {}


def build_session(app: str = "turnloom", cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library assumes: UTC, ANSI, adaptive execution."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in a local session without the setting (tests).

    On a cluster a folder of one machine would be lost to all others, so a missing setting is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder (master {master})")
        if not _own_folders:
            _own_folders.append(tempfile.mkdtemp(prefix="turnloom-"))
        folder = "file://" + _own_folders[0]
    return folder.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path for scratch data in the shared folder; it is deleted at exit, whatever the file system."""
    path = f"{shared_folder(spark)}/turnloom/{name}-{uuid.uuid4().hex}"
    _tables[path] = spark
    return path


def spill(df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, fixes the rows, survives lost executors."""
    spark = df.sparkSession
    path = place(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._turnloom_path = path
    return back


def drop(df: DataFrame | None) -> None:
    """Delete a spilled table that no later plan reads."""
    path = getattr(df, "_turnloom_path", None)
    if path and path in _tables:
        _delete(path, _tables.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    try:
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        conf = jsc.hadoopConfiguration() if jsc is not None else jvm.org.apache.hadoop.conf.Configuration()  # after stop()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # the JVM may be gone; a leftover scratch table is harmless
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


@atexit.register
def _clean() -> None:
    for path in list(_tables):
        _delete(path, _tables.pop(path))
    for folder in _own_folders:
        shutil.rmtree(folder, ignore_errors=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
