"""Stored vectors of label queries, and the job that scores a collection by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions.schemas import schema
from stemma.operators import embeddings
from stemma.sources import tables

SCHEMA = schema("category_id string, query_id string, query_order int, query_text string, vec array<float>, model string")
AGGREGATIONS = ("max", "mean", "top_k_mean")


class LabelIndex:
    """Queries of one label set by one model: a row a query, so small."""

    def __init__(self, spark: SparkSession, path: str, model: str = ""):
        self.spark, self.path, self.model = spark, path, model

    def read(self) -> DataFrame:
        held = tables.load(self.spark, self.path, SCHEMA)
        other = held.where(F.col("model") != self.model).first()
        if other:
            raise ValueError(f"the index is of model {other['model']}")
        return held

    def build(self, query_set: dict[str, list[str]], embed_fun: Callable, batch_size: int = embeddings.BATCH, overwrite: bool = False) -> int:
        """Embed the queries that the index lacks, or has with another text; queries that are no longer in the set go. Returns how many were embedded."""
        rows = self.spark.createDataFrame(embeddings.query_rows(query_set), "category_id string, query_id string, query_order int, query_text string")
        old = tables.load(self.spark, self.path, SCHEMA).where(F.lit(not overwrite) & (F.col("model") == self.model))
        same = old.select("query_id", "query_text", "vec")
        joined = tables.once(rows.join(same, ["query_id", "query_text"], "left"), "queries")
        todo = joined.where("vec is null").select("query_id", F.col("query_text").alias("text"))
        n = todo.count()
        new = embeddings.embed(todo, embed_fun, "query_id", batch_size).select("query_id", F.col("vec").alias("fresh"))
        out = joined.join(new, "query_id", "left").withColumn("vec", F.coalesce("vec", "fresh")).withColumn("model", F.lit(self.model))
        out = tables.once(out.select(*SCHEMA.names), "label-index")
        embeddings.assert_unit(out)
        tables.overwrite(out, self.path)
        return n

    def score(
        self, index: DataFrame, aggregations: tuple[str, ...] = AGGREGATIONS, top_k: int = 2, records: DataFrame | None = None,
        ref_ids: list[str] | None = None, date_from=None, date_to=None, include_query_scores: bool = False, id_col: str = "ref_id",
    ) -> DataFrame | tuple[DataFrame, DataFrame]:
        """(id, category_id, query_n, score_...) of the rows of an embedding index, or of its delta.

        Rows are chosen by ids, or else by the days of ``records``; ids make days moot. ``aggregations`` names the scores; ``top_k`` 0 drops
        the mean of the best. With ``include_query_scores`` the score of each query comes as a second table.
        """
        unknown = sorted(set(aggregations) - set(AGGREGATIONS))
        if unknown or not aggregations:
            raise ValueError(f"unknown aggregations: {unknown}" if unknown else "no aggregation")
        if top_k < 0:
            raise ValueError("top_k is below 0")
        if ref_ids is not None:
            index = embeddings.select_ids(index, ref_ids, id_col=id_col)
        elif date_from is not None or date_to is not None:
            if records is None:
                raise ValueError("days need the records")
            index = index.join(embeddings.select_ids(records, date_from=date_from, date_to=date_to, id_col=id_col).select(id_col).distinct(), id_col, "left_semi")
        queries = self.read()
        scores = embeddings.category_scores(index, queries, top_k, id_col)
        names = [f"score_{a}" for a in AGGREGATIONS if a in aggregations and f"score_{a}" in scores.columns]
        scores = scores.select(id_col, "category_id", "query_n", *names)
        return (scores, embeddings.pair_scores(index, queries, id_col)) if include_query_scores else scores
