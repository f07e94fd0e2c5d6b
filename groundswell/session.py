"""Session helpers shared by the package: a local session for tests, the shared work folder, worker imports."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: str | int = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("groundswell")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    session = builder.config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed but its folder is reachable."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and the master is local (tests), one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="groundswell-")
        atexit.register(shutil.rmtree, folder, True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str = "table", codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    The table stays as long as a result may need it: until ``forget``, or the end of the program.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(forget)
    _WRITTEN.append(path)
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN.remove(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``written`` has made and that nothing still to be run reads."""
    for table in tables:
        _remove(table.sparkSession, table.written_to)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that have ended: Spark removes them when the driver holds no reference to them any more.

    The first collection comes before the last events of a job have been told to its listeners, which hold on to it.
    """
    for _ in range(2):
        time.sleep(0.7)
        spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)


def tables() -> set[str]:
    """Where the tables are that ``written`` has made."""
    return set(_WRITTEN)


def forget(spark: SparkSession | None = None, but: set[str] | frozenset[str] = frozenset()) -> None:
    """Remove all tables that ``written`` has made, ``but`` some; DataFrames that were built on them can't be run any more."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in list(_WRITTEN):
        if path not in but:
            _remove(spark, path)
