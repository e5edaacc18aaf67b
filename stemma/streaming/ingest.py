"""Incremental ingestion by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stemma.operators import upsert
from stemma.sources import tables


def files(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", glob: str | None = None, per_trigger: int = 100) -> DataFrame:
    """A stream of the files that come to a folder; each is read once, however often the job restarts."""
    reader = spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def upsert_into(stream: DataFrame, path: str, keys: list[str], seq: str, checkpoint: str):
    """Keep at ``path`` the row of the highest ``seq`` of each key; returns the running query.

    Each micro-batch is folded to one row a key before it meets the table, and a batch that is run again after a failure changes
    nothing, as equal rows replace each other.
    """
    schema = stream.schema

    def fold(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        old = tables.load(spark, path, schema)
        tables.overwrite(upsert.keep_last(old.unionByName(batch), keys, seq), path)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, width: str = "1 day", late: str = "1 hour", by: list[str] | None = None, slide: str | None = None) -> DataFrame:
    """Counts per window of event time.

    Written by :func:`append_to_table`, rows later than ``late`` behind the newest are dropped, and a window is written and forgotten when it
    closes. :func:`run_to_table` has every window and every row, and its state grows with the windows.
    """
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(window, *(by or [])).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Counts per run of events of a key without a break of ``gap``."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str):
    """Run what is there now and write the whole result at ``path``, replacing it with each batch: for results of bounded size.

    No row is late and no group forgotten, as every batch gives the whole result.
    """

    def put(batch: DataFrame, _: int) -> None:
        tables.overwrite(batch, path)

    return stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to_table(stream: DataFrame, path: str, checkpoint: str):
    """Run what is there now and add what is final, such as closed windows, to the table at ``path``.

    State holds open groups alone. Each batch has a folder of its own, written anew if the batch is run again, so nothing comes twice.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending_days(ledger: DataFrame, first: str, last: str) -> DataFrame:
    """Days from ``first`` to ``last`` to be fetched: those not done, and those that gave nothing. ``ledger`` is (day date, total)."""
    spark = ledger.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    done = ledger.groupBy("day").agg(F.max("total").alias("total")).where("total > 0").select("day")
    return days.join(done, "day", "left_anti")
