"""What an application shares: code for its Python workers and a folder for tables that cut a plan in two.

Workers get this package from the driver, so they need no shared code path. Tables go to the folder that
spark.checkpoint.dir names, so that what reads them survives a lost executor; they are removed when the driver ends.
"""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_local: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send the package's source to the Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = os.path.join(tempfile.mkdtemp(prefix="factorloom-code-"), f"factorloom-{uuid.uuid4().hex[:8]}.zip")
    Path(path).write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset on a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="factorloom-shared-"))
    return "file://" + _local[0]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/factorloom/{label}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(clean)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no returned plan reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean() -> None:
    """Remove all tables of applications that still run; those of a driver that was killed stay for the folder's owner."""
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    _made.clear()


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of a plan, written to the shared folder once and read back as often as needed."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
