"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_local_dirs: list[str] = []
_shipped: set[str] = set()


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("kollate")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where the setting is missing (tests, the local bench) a temporary folder of this machine is used,
    and only under a local master: on a cluster a machine-local folder would lose data, so that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _local_dirs:
        _local_dirs.append(tempfile.mkdtemp(prefix="kollate-"))
        atexit.register(shutil.rmtree, _local_dirs[0], ignore_errors=True)
    return f"file://{_local_dirs[0]}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a cluster, once per application, so that they need no copy of their own.

    The archive lies in the shared folder; where that is no file system of the driver, executors must have the package.
    """
    context = spark.sparkContext
    if context.master.startswith("local[") or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    folder = shared_dir(spark).removeprefix("file://")
    if folder.startswith("/"):
        home = os.path.dirname(os.path.abspath(__file__))
        os.makedirs(f"{folder}/kollate", exist_ok=True)
        context.addPyFile(shutil.make_archive(f"{folder}/kollate/package-{context.applicationId}", "zip", os.path.dirname(home), os.path.basename(home)))


def cut(df: DataFrame, name: str = "cut", *done: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage so that lost executors cost nothing but the running stage, and gives the planner
    the real size of the intermediate table. ``done`` are earlier results of this function that nothing reads any more once
    ``df`` is written; their files are removed. What is left goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kollate/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    where = _path(spark, path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    release(*done)
    return out


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def release(*tables: DataFrame) -> None:
    """Removes the files of tables that ``cut`` wrote. Only for those that no query reads any more."""
    for df in tables:
        path = getattr(df, "_cut", None)
        if path:
            where = _path(df.sparkSession, path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
