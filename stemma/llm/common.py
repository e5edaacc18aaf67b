"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every contract of this subpackage has it: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the setting is absent and all runs in one process, as in local tests, a temporary folder is made and named.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="stemma-")
        atexit.register(shutil.rmtree, named, True)
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that it ran, not the steps before. The files
    go when the Python process ends, as results that are still lazy may read them until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stemma/{uuid.uuid4().hex}/{name}"
    df.write.options(**options).parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may be gone
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path).getParent()
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of a text; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def held_out(doc_id: Column) -> Column:
    """True for the third of the ids that nothing is learnt from: crc32(id as text) mod 3 = 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
