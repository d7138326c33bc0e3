"""Makes this package importable on every executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_folders: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; where that is unset (a local session), a temporary one that
    goes when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        folder = tempfile.mkdtemp(prefix="netquarry-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()  # with the default store's scheme
    return full.replace("file:/", "file:///", 1).replace("file://///", "file:///", 1).rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder in :func:`scratch_root`; it goes when the driver's process ends in order."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{scratch_root(spark)}/netquarry-{app}"
        atexit.register(_forget_at_exit, spark, _folders[app])
    return _folders[app]


def forget(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _forget_at_exit(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # not stopped yet
        forget(spark, folder)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in :func:`scratch_dir`."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
