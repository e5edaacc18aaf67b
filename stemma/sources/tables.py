"""Parquet tables by path: loading with a schema, safe overwriting, removal, scratch space."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Where the table that is being replaced waits until its successor is in place.
PREVIOUS = ".previous"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at ``path``; one that a crash left aside between two steps of :func:`overwrite` is put back first."""
    fs, at = _fs(spark, path)
    if fs.exists(at):
        return True
    aside = _fs(spark, path + PREVIOUS)[1]
    return fs.exists(aside) and fs.rename(aside, at)


def remove(spark: SparkSession, path: str) -> None:
    for name in (path, path + PREVIOUS):
        fs, at = _fs(spark, name)
        fs.delete(at, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, sorted; none if it is absent."""
    fs, at = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()) if fs.exists(at) else []


def load(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The table at ``path``; without one, an empty table of ``schema``."""
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    if schema is None:
        raise FileNotFoundError(path)
    return spark.createDataFrame([], schema)


def overwrite(df: DataFrame, path: str) -> None:
    """Write ``df`` in place of the table at ``path``, which ``df`` may itself read.

    It is written beside the old table, the old one is moved aside and the new one to its place; only then the old one goes. After a crash
    at any step one of the two is whole, and :func:`exists` and :func:`load` find it. If the last move fails the old table is put back.
    """
    spark = df.sparkSession
    side = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(side)
    fs, at = _fs(spark, path)
    aside, new = _fs(spark, path + PREVIOUS)[1], _fs(spark, side)[1]
    if exists(spark, path):
        fs.delete(aside, True)
        if not fs.rename(at, aside):
            raise OSError(f"could not move {path} aside")
    if not fs.rename(new, at):
        if fs.exists(aside):
            fs.rename(aside, at)
        raise OSError(f"could not move {side} to {path}")
    fs.delete(aside, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, under ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process, as in local tests, a temporary folder is made for it.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="stemma-")
        atexit.register(shutil.rmtree, root, True)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to scratch space and read back, so that what reads it several times computes it once.

    It also cuts the lineage. The files go when the Python process ends, as results that are still lazy may read them until then.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    atexit.register(_forget, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        remove(spark, path)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of the table at ``path``."""
    fs, at = _fs(spark, path)
    return fs.getContentSummary(at).getLength()


def readable(spark: SparkSession, path: str) -> bool:
    """Whether the table at ``path`` can be read: its schema and all row counts."""
    try:
        spark.read.parquet(path).count()
    except Exception:  # whatever is wrong with it
        return False
    return True
