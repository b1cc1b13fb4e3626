"""What every query needs of a session."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

#: The folder that holds this package.
HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Applications whose executors have been sent this package.
_sent: set[str] = set()


def local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package: by the driver's own path, and where executors are elsewhere by a copy that Spark sends them."""
    context = spark.sparkContext
    known = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in known:
        context.environment["PYTHONPATH"] = os.pathsep.join([*filter(None, known), HOME])
    if not local(spark) and context.applicationId not in _sent:
        _sent.add(context.applicationId)
        path = os.path.join(tempfile.mkdtemp(), "seastate_package.zip")  # the driver serves it from here
        package = os.path.join(HOME, "seastate")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), HOME))
        context.addPyFile(path)
    return spark


_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir; a local one only if driver and executors are one process), removed when this Python process ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file:///tmp/checkpoints/seastate"
    folder = f"{shared.rstrip('/')}/seastate-{uuid.uuid4().hex}"
    _made.append((spark, folder))
    return f"{folder}/{tag}"


def _clean() -> None:
    while _made:
        spark, folder = _made.pop()
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # this session has ended; its folder's owner cleans up
            continue


atexit.register(_clean)
