"""Files shared by driver and executors, and code shipped to Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_folders: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers that have no copy of it (``--py-files`` does the same)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    if not (top / "fringework").is_dir():  # already running from a shipped archive
        return
    out = os.path.join(tempfile.mkdtemp(prefix="fringework-"), "fringework.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((top / "fringework").rglob("*.py")):
            z.write(p, p.relative_to(top))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; an own one only where it is unset and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jsc.isDefined():
        return jsc.get().rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="fringework-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    atexit.register(shutil.rmtree, own, True)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/fringework-{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        atexit.register(_delete, spark.sparkContext, path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, sweep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there and a lost executor costs nothing.

    With ``sweep`` the files of its shuffles go as soon as it is written, not with some later garbage collection.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    try:
        spark.conf.set(key, "true" if sweep else before)
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def result(df: DataFrame, name: str, *used: DataFrame, sweep: bool = False) -> DataFrame:
    """``df`` written and read back, after which the tables it was made from are deleted."""
    out = materialise(df, name, sweep)
    for t in used:
        drop_table(df.sparkSession, t)
    return out


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a DataFrame that ``materialise`` returned, once nothing reads them."""
    _delete(spark.sparkContext, df._table)


def _delete(sc, path: str) -> None:
    if sc._jvm is None:  # the JVM has ended
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    try:
        p.getFileSystem(sc._jvm.org.apache.hadoop.conf.Configuration() if sc._jsc is None else sc._jsc.hadoopConfiguration()).delete(p, True)
    except (OSError, Py4JError):  # left behind rather than failing a finished job
        pass
