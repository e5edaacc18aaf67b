"""An embedding index on disk: a main table sharded by year, appended delta batches, a manifest."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import ids
from stemma.functions.schemas import schema
from stemma.operators import embeddings
from stemma.sources import tables

MAIN = schema("ref_id string, abstract string, vec array<float>")
DELTA = schema("ref_id string, abstract string, vec array<float>, seq long, batch string")
MANIFEST = schema("collection_id string, field string, model string, provider string, dimension int, records long, updated_at timestamp")


class EmbeddingStore:
    """Main is partitioned by the year of the ids, so a search over ids of some years reads these alone."""

    def __init__(self, spark: SparkSession, root: str, collection_id: str, field: str = "abstract", model: str = "", provider: str = ""):
        self.spark, self.root, self.names = spark, root.rstrip("/"), (collection_id, field, model, provider)

    def main(self) -> DataFrame:
        path = f"{self.root}/main"
        if not tables.exists(self.spark, path):
            return self.spark.createDataFrame([], schema("ref_id string, abstract string, vec array<float>, shard_year string"))
        return self.spark.read.schema(schema("ref_id string, abstract string, vec array<float>, shard_year string")).parquet(path)

    def batches(self) -> list[str]:
        """Names of the appended batches, in order; each is a folder of the delta."""
        return [n.removeprefix("batch=") for n in tables.folders(self.spark, f"{self.root}/delta") if n.startswith("batch=")]

    def delta(self, batches: list[str] | None = None) -> DataFrame:
        """Rows of all batches, or of those named."""
        names = self.batches() if batches is None else batches
        if not names:
            return self.spark.createDataFrame([], DELTA)
        reader = self.spark.read.schema(DELTA).option("basePath", f"{self.root}/delta")
        return reader.parquet(*[f"{self.root}/delta/batch={n}" for n in names])

    def manifest(self) -> DataFrame:
        return tables.load(self.spark, f"{self.root}/manifest", MANIFEST)

    def append(self, records: DataFrame, embed_fun: Callable, overwrite: bool = False, limit: int | None = None, batch_size: int = embeddings.BATCH) -> str:
        """Embed what no part has yet (all, if ``overwrite``) and append it as one batch; returns the batch's name."""
        known = [] if overwrite else [self.main(), self.delta()]
        todo = embeddings.targets(records, known, self.names[1], limit=limit)
        new = embeddings.embed(todo, embed_fun, batch_size=batch_size)  # the texts come along, so nothing is read or joined again
        batch = f"batch_{datetime.now(UTC):%Y%m%d%H%M%S}_{uuid.uuid4().hex[:8]}"
        last = self.delta().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        rows = new.select("ref_id", F.col("text").alias("abstract"), "vec", F.lit(last + 1).cast("long").alias("seq"))
        rows.write.parquet(f"{self.root}/delta/batch={batch}")
        return batch

    def compact(self) -> None:
        """Fold the batches that are there now into main; only the years that they touch are written again. Batches appended meanwhile stay."""
        folded = self.batches()
        delta, main = self.delta(folded), self.main()
        year = ids.shard_year(F.col("ref_id"))
        touched = delta.select(year.alias("shard_year")).distinct()
        old = main.join(F.broadcast(touched), "shard_year", "left_semi").drop("shard_year")  # a row a year
        both = embeddings.compact(old, delta.drop("batch"))
        width = both.agg(F.min(F.size("vec")), F.max(F.size("vec"))).first()
        if width[0] != width[1]:
            raise ValueError(f"vectors of {width[0]} and {width[1]} dimensions")
        side = f"{self.root}/side-{uuid.uuid4().hex}"
        both.withColumn("shard_year", year).write.parquet(side)  # main is read for it, so it can't be written meanwhile
        fresh = self.spark.read.parquet(side)
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard_year").parquet(f"{self.root}/main")
        tables.remove(self.spark, side)
        for name in folded:
            tables.remove(self.spark, f"{self.root}/delta/batch={name}")
        one = self.main().agg(F.count("*").alias("records"), F.max(F.size("vec")).cast("int").alias("dimension"))
        names = [F.lit(v).alias(n) for n, v in zip(("collection_id", "field", "model", "provider"), self.names, strict=True)]
        tables.overwrite(one.select(*names, "dimension", "records", F.current_timestamp().alias("updated_at")), f"{self.root}/manifest")

    def build(self, records: DataFrame, embed_fun: Callable, **options) -> None:
        self.append(records, embed_fun, **options)
        self.compact()

    def search(self, query: list[float] | str, embed_fun: Callable | None = None, top_n: int = embeddings.TOP_N, years: list[str] | None = None) -> DataFrame:
        """Best rows by cosine; the manifest's model has to be this store's."""
        held = self.manifest().first()
        if held and self.names[2] and held["model"] != self.names[2]:
            raise ValueError(f"the index is of model {held['model']}")
        vec = query if not isinstance(query, str) else np.asarray(embed_fun([query]))[0].tolist()
        index = self.main() if years is None else self.main().where(F.col("shard_year").isin(years))
        embeddings.assert_unit(index)
        return embeddings.search(index, vec, top_n)

    def diagnose(self, records: DataFrame) -> DataFrame:
        return embeddings.state(records, self.main(), self.delta())

    def reset(self, preserve_delta: bool = True) -> None:
        tables.remove(self.spark, f"{self.root}/main")
        tables.remove(self.spark, f"{self.root}/manifest")
        if not preserve_delta:
            tables.remove(self.spark, f"{self.root}/delta")


def read_float32_matrix(data: bytes, rows: int, columns: int) -> np.ndarray:
    """A raw little-endian float32 matrix, column after column."""
    if len(data) != 4 * rows * columns:
        raise ValueError(f"{len(data)} bytes for {rows} x {columns} numbers")
    return np.frombuffer(data, "<f4").reshape(columns, rows).T


def write_float32_matrix(matrix: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.asarray(matrix, "<f4").T).tobytes()


def import_matrix(spark: SparkSession, path: str, names: DataFrame, columns: int, id_col: str = "ref_id", seq: str = "seq") -> DataFrame:
    """(id, vec) of a raw matrix file and its row names in order; read a column-stripe at a time by Spark's binary source.

    The source holds a file in one row, so one of 2 GiB or more is refused; such a matrix comes in several files.
    """
    rows = names.count()
    if 4 * rows * columns >= 1 << 31:
        raise ValueError("the matrix has 2 GiB or more; split it by rows")
    data = spark.read.format("binaryFile").load(path).select("content")
    width = F.lit(4 * rows)
    stripes = data.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda c: F.substring("content", (c * width + 1).cast("int"), width.cast("int")))).alias("c", "stripe"))

    def unpack(batches):
        import pyarrow as pa

        for b in batches:
            for c, stripe in zip(*(x.to_pylist() for x in b.columns), strict=True):
                v = read_float32_matrix(stripe, rows, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), pa.array(np.full(rows, c, np.int32)), pa.array(v)], names=["row", "c", "v"])

    from stemma.functions.shipping import map_in_arrow

    cells = stripes.transform(map_in_arrow, unpack, "row long, c int, v float")
    vecs = cells.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("vec"))
    return names.select(id_col, F.col(seq).cast("long").alias("row")).join(vecs, "row").select(id_col, "vec")
