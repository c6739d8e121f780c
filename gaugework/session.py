"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new name in the folder that driver and executors share: the session's spark.checkpoint.dir, else the context's. Where neither is set, local mode takes a
    new local folder, as in tests; a cluster raises, as executors cannot see a folder of the driver's machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        place = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = place.get() if place.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="gaugework-")
        spark.conf.set("spark.checkpoint.dir", root)
    root = root if "://" in root or root.startswith("file:") else "file://" + root
    return f"{root.rstrip('/')}/gaugework/{uuid.uuid4().hex[:12]}-{name}"


_SCRATCH: list[list[str]] = []


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: its lineage is cut, and a lost executor loses nothing.

    The innermost ``scratch`` drops the table; without one it stays for the folder's owner.
    """
    path = shared_folder(df.sparkSession, name)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that ``settled`` makes inside when it is left: write the results of the operators before. Not for several threads at once."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_gaugework_shipped", False):
        return
    root = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="gaugework-"), "gaugework_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, f"{root.name}/{p.relative_to(root)}")
    context.addPyFile(path)
    context._gaugework_shipped = True
