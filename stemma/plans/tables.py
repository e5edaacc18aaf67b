"""Reading the tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: dict = {}


def session(spark: SparkSession, key: tuple, make):
    """What ``make`` gives, made once a session for each key: stored tables that several queries read."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _MADE:
        _MADE[key] = make()
    return _MADE[key]
