"""What a cluster needs: this package on the executors, so that functions pickled by reference are found there, and shared folders."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; one of our own where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="gristmill-"))
        base = sc._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the session ends."""
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return out


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application, so that they need no path to it of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="gristmill-"), f"{top.name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(archive)
