"""Getting work to where it runs: this package's modules to Python workers, rows of small inputs to all cores."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    root = Path(__file__).resolve().parent.parent
    if not root.is_dir():  # it runs from an archive, which was sent by whoever set that up
        return
    fd, name = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(name)
    _sent.add(app)


#: Bytes per core below which an input counts as small: Spark's own price of opening a file.
SMALL = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is so small that a scan would give most of it to one of them; else as it is.

    For work that costs much more than moving the rows. The size is the plan's estimate; nothing runs for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < cores * SMALL else df


def map_in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` by a function that may use this package's modules."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
