"""Sessions, and the package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "quarryline") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    settings = {"spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package importable in Python workers, wherever the driver was started; once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="quarryline-package-")  # the driver serves the file for as long as it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "quarryline.zip")
        with zipfile.ZipFile(path, "w") as out:
            for source in sorted(top.rglob("*.py")):
                out.write(source, source.relative_to(top.parent))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark


_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share (``spark.checkpoint.dir``).

    Where none is set, a local session gets one of the driver's own; on a cluster that is an error, as
    executors would write to their own disks.  ``release`` deletes the folders.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quarryline-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        context.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/quarryline/{name}-{uuid.uuid4().hex}"
    _written.setdefault(context.applicationId, []).append(folder)
    return folder


def release(spark: SparkSession) -> int:
    """Deletes what this application has written to shared folders, once results that read it are stored; gives their number."""
    context, gone = spark.sparkContext, 0
    for folder in _written.pop(context.applicationId, []):
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        gone += path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return gone
