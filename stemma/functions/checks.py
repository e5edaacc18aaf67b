"""Checks that fail a job with a clear message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_unique(df: DataFrame, *keys: str) -> None:
    """Raise if a combination of ``keys`` occurs twice. The counts are pre-aggregated; one row comes back."""
    worst = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if worst:
        raise ValueError(f"not unique: {worst[0].asDict()}")


def require_none(df: DataFrame, what: str) -> None:
    """Raise with an example if ``df`` has a row."""
    row = df.limit(1).collect()
    if row:
        raise ValueError(f"{what}: {row[0].asDict()}")


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def align(df: DataFrame, schema) -> DataFrame:
    """``df`` with exactly the columns of ``schema``, in its order: absent ones null, others cast."""
    have = set(df.columns)
    # as text: one call of the JVM for all columns
    return df.selectExpr(*[f"cast({f'`{f.name}`' if f.name in have else 'null'} as {f.dataType.simpleString()}) as `{f.name}`" for f in schema])
