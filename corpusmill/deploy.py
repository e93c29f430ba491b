"""Sends this package to the executors, which need not have it installed, and names the folder that all share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_scratch: list[tuple[str, str]] = []


def ship(spark: SparkSession) -> SparkSession:
    """Once an application: the package's modules as a zip file that Spark hands to every Python worker."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        home = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="corpusmill-")) / "corpusmill.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only on a local master where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corpusmill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    root = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, until ``sweep_scratch``."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark.sparkContext.applicationId, path))
    return path


def sweep_scratch(spark: SparkSession) -> int:
    """Delete what this application wrote by ``scratch`` and ``kept``, and the bucketed tables in it.  To be called when no
    result is open that still reads it.  Returns how many paths went."""
    own, path = spark.sparkContext.applicationId, spark._jvm.org.apache.hadoop.fs.Path
    gone = [x for x in _scratch if x[0] == own]
    for x in gone:
        path(x[1]).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(x[1]), True)
        _scratch.remove(x)
    for t in spark.catalog.listTables():
        if t.name.startswith("bucketed_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    return len(gone)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: what is read again is not computed again, and lineage ends."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
