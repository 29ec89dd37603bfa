"""Session set-up and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster pass the cluster's own."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")  # for workers: tasks fill the cores already
    builder = (
        SparkSession.builder.master(master)
        .appName("scanloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, also made ready for ``checkpoint()``.

    ``spark.checkpoint.dir`` names it. Only a local session without that
    setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="scanloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; nothing is created there yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Let workers import this package although it is not installed there; done once per application."""
    context = spark.sparkContext
    if getattr(context, "_scanloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="scanloom-")) / f"{root.name}.zip"  # the driver hands it to the executors
    with zipfile.ZipFile(archive, "w") as target:
        for path in sorted(root.rglob("*.py")):
            target.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._scanloom_shipped = True


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any file or folder matches ``path`` (globs allowed)."""
    return bool(_matches(spark, path))


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder this library wrote earlier."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    _system(spark, target).delete(target, True)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    return [status.getPath().getName() for status in _matches(spark, f"{folder}/*")]


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return _system(spark, target).getContentSummary(target).getLength()


def create_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file; raises ``FileExistsError`` if there is one, which then stays as it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        stream = _system(spark, target).create(target, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in str(error.java_exception) or path_exists(spark, path):
            raise FileExistsError(path) from error
        raise
    stream.write(bytearray(text.encode()))
    stream.close()


def read_file(spark: SparkSession, path: str) -> str:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = _system(spark, target).open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _system(spark: SparkSession, target):
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _matches(spark: SparkSession, path: str) -> list:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return list(_system(spark, target).globStatus(target) or [])
