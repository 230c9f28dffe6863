"""Session plumbing shared by all operators: tables, shipping, lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (tests only) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            folder = current
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        else:
            folder = "file://" + tempfile.mkdtemp(prefix="tesserine-")
            spark.sparkContext.setCheckpointDir(folder)
            atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
    return folder.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    fs, where = _filesystem(spark, path)
    return bool(fs.exists(where))


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a table yet to be written in the shared folder; dropped when the Python driver exits."""
    path = f"{shared_folder(spark)}/tesserine-{label}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            fs, where = _filesystem(spark, path)
            fs.delete(where, True)
        except Exception:
            pass  # the session is gone; the folder belongs to its owner

    atexit.register(drop)
    return path


def materialise(df: DataFrame, label: str = "cut") -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    Unlike a local checkpoint the files outlive any executor; unlike an RDD
    checkpoint they are compressed and columnar.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors (once per application)."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = shared_folder(spark)
    local = folder.removeprefix("file://") if "://" not in folder or folder.startswith("file://") else tempfile.mkdtemp()
    os.makedirs(local, exist_ok=True)
    archive = os.path.join(local, f"tesserine-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, f"{root.name}/{source.relative_to(root)}")
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
