"""Embedding search, category scores, and the delta life cycle of an embedding index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.functions import checks, vectors
from stemma.functions.shipping import map_in_arrow

TOP_N, TOLERANCE, BATCH = 20, 1e-3, 64


def assert_unit(index: DataFrame, vec: str = "vec", tolerance: float = TOLERANCE) -> None:
    """Raise unless all vectors have unit length and one dimension; one aggregate over all rows."""
    row = index.agg(
        F.max(F.abs(vectors.norm(F.col(vec)) - 1)).alias("off"), F.min(F.size(vec)).alias("least"), F.max(F.size(vec)).alias("most")
    ).first()
    if row["off"] is not None and row["off"] > tolerance:
        raise ValueError(f"vectors are not of unit length: off by {row['off']:.4g}")
    if row["least"] != row["most"]:
        raise ValueError(f"vectors of {row['least']} and {row['most']} dimensions")


def search(index: DataFrame, query_vec: list[float], top_n: int = TOP_N, id_col: str = "ref_id", vec: str = "vec") -> DataFrame:
    """(id, score) of the best ``top_n`` by cosine (vectors are of unit length); ties by id.

    The query is a literal. Repeated ids keep their best score; null scores drop out. A limit over an order keeps
    ``top_n`` rows a task, so next to nothing is shuffled.
    """
    q = F.array(*[F.lit(float(x)) for x in query_vec])
    scored = index.select(F.col(id_col), vectors.dot(F.col(vec), q).alias("score")).where("score is not null")
    return scored.groupBy(id_col).agg(F.max("score").alias("score")).orderBy(F.desc("score"), id_col).limit(top_n)


def search_delta(delta: DataFrame, query_vec: list[float], date: str | None = None, shard: str | None = None, top_n: int = TOP_N, **cols) -> DataFrame:
    """Search over appended batches only: all, those of a day (``YYYYMMDD``), or one batch."""
    if date is not None:
        delta = delta.where(F.col("batch").startswith(f"batch_{date}"))
    if shard is not None:
        delta = delta.where(F.col("batch") == shard)
    return search(delta, query_vec, top_n, **cols)


def query_rows(query_set: dict[str, list[str]]) -> list[tuple[str, str, int, str]]:
    """(category_id, query_id, query_order, query_text) of a label query set."""
    return [(c, f"{c}__{i:03d}", i, t) for c, texts in query_set.items() for i, t in enumerate((t for t in texts if t and t.strip()), 1)]


def pair_scores(index: DataFrame, queries: DataFrame, id_col: str = "ref_id", vec: str = "vec") -> DataFrame:
    """(id, category_id, query_id, score) of every vector with every query.

    ``queries`` (category_id, query_id, vec) is a label set, so few rows; the matrix products run in Arrow
    batches against it, and no corpus row is shuffled.
    """
    held = queries.select("category_id", "query_id", "vec").orderBy("category_id", "query_id").collect()
    if not held:
        raise ValueError("the query set is empty")
    matrix = np.array([r["vec"] for r in held], dtype=np.float64)
    names = [(r["category_id"], r["query_id"]) for r in held]
    id_type = index.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                s = x @ matrix.T
                at = np.repeat(np.arange(len(x)), len(names))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(at)),
                        pa.array([c for c, _ in names] * len(x), pa.string()),
                        pa.array([q for _, q in names] * len(x), pa.string()),
                        pa.array(s.ravel()),
                    ],
                    names=["id", "category_id", "query_id", "score"],
                )

    rows = index.where(F.col(vec).isNotNull()).select(F.col(id_col), F.col(vec))
    return rows.transform(map_in_arrow, run, f"id {id_type}, category_id string, query_id string, score double").withColumnRenamed("id", id_col)


def category_scores(index: DataFrame, queries: DataFrame, top_k: int = 2, id_col: str = "ref_id", vec: str = "vec") -> DataFrame:
    """(id, category_id, query_n, score_max, score_mean, score_top_k_mean), scored and folded inside each row."""
    held = queries.select("category_id", "query_id", "vec").orderBy("category_id", "query_id").collect()
    by: dict[str, list] = {}
    for r in held:
        by.setdefault(r["category_id"], []).append(r["vec"])
    if not by:
        raise ValueError("the query set is empty")
    matrix = lambda vecs: F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in vecs])
    sets = F.array(*[F.struct(F.lit(c).alias("category_id"), matrix(vecs).alias("vecs")) for c, vecs in by.items()])  # folds to one literal
    rows = index.where(F.col(vec).isNotNull()).select(id_col, vec, F.explode(sets).alias("q"))
    scores = F.sort_array(F.transform("q.vecs", lambda v: vectors.dot(F.col(vec), v)), asc=False)
    rows = rows.select(id_col, F.struct(F.col("q.category_id").alias("category_id"), scores.alias("s")).alias("c"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / F.size(a)
    out = rows.select(
        id_col, "c.category_id", F.size("c.s").alias("query_n"), F.col("c.s")[0].alias("score_max"), mean(F.col("c.s")).alias("score_mean"),
        *([mean(F.slice("c.s", 1, top_k)).alias("score_top_k_mean")] if top_k > 0 else []),
    )
    return out


def select_ids(rows: DataFrame, ref_ids: list[str] | None = None, date_from=None, date_to=None, date_col: str = "pub_date", id_col: str = "ref_id") -> DataFrame:
    """Rows by ids, or else by an inclusive range of days; ids given make the range moot."""
    if ref_ids is not None:
        return rows.where(F.col(id_col).isin(ref_ids))
    if date_from is not None and date_to is not None and str(date_from) > str(date_to):
        raise ValueError("date_from is after date_to")
    day = F.to_date(date_col)
    if date_from is not None:
        rows = rows.where(day >= F.to_date(F.lit(str(date_from))))
    if date_to is not None:
        rows = rows.where(day <= F.to_date(F.lit(str(date_to))))
    return rows


def label(scores: DataFrame, threshold: float | dict[str, float] = 0.5) -> DataFrame:
    """Rows whose best score reaches the threshold, one for all or by category (absent: 0)."""
    if isinstance(threshold, dict):
        pairs = [F.lit(x) for kv in threshold.items() for x in kv]
        limit = F.coalesce(F.element_at(F.create_map(*pairs), F.col("category_id")), F.lit(0.0)) if pairs else F.lit(0.0)
    else:
        limit = F.lit(float(threshold))
    return scores.where(F.col("score_max") >= limit)


def best_category(scores: DataFrame, id_col: str = "ref_id") -> DataFrame:
    """The category of the largest best score of each id; ties by name."""
    best = F.min_by(F.struct("category_id", "score_max"), F.struct(-F.col("score_max"), F.col("category_id")))
    return scores.groupBy(id_col).agg(best.alias("b")).select(id_col, "b.category_id", "b.score_max")


def targets(records: DataFrame, known: list[DataFrame], field: str = "abstract", id_col: str = "ref_id", limit: int | None = None) -> DataFrame:
    """(id, text) of the records with a non-blank field that no part of the index has yet, a row an id: of several texts the least."""
    rows = records.select(id_col, F.trim(field).alias("text")).where(F.length("text") > 0).groupBy(id_col).agg(F.min("text").alias("text"))
    for part in known:
        rows = rows.join(part.select(id_col), id_col, "left_anti")
    return rows.orderBy(id_col).limit(limit) if limit is not None else rows


def embed(rows: DataFrame, embed_fun: Callable[[list[str]], np.ndarray], id_col: str = "ref_id", batch_size: int = BATCH) -> DataFrame:
    """(id, text, vec) of (id, text) by a user's function, ``batch_size`` texts at a time; checks counts and dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = None
        for whole in batches:
            for i in range(0, whole.num_rows, batch_size):
                b = whole.slice(i, batch_size)
                got = np.asarray(embed_fun(b.column(1).to_pylist()), dtype=np.float32)
                if got.ndim != 2 or len(got) != b.num_rows or width not in (None, got.shape[1]):
                    raise ValueError(f"the embedding function gave {got.shape} for {b.num_rows} texts")
                width = got.shape[1]
                vecs = pa.array(list(got), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vecs], names=["id", "text", "vec"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "text").transform(map_in_arrow, run, f"id {kind}, text string, vec array<float>").withColumnRenamed("id", id_col)


def compact(main: DataFrame, delta: DataFrame, id_col: str = "ref_id", seq: str = "seq") -> DataFrame:
    """Main and delta as one: of each id the last appended vector counts."""
    both = main.select("*", F.lit(-1).cast("long").alias("__seq")).drop(*([seq] if seq in main.columns else []))
    new = delta.withColumn("__seq", F.col(seq).cast("long")).drop(seq)
    every = both.unionByName(new, allowMissingColumns=True)
    last = F.max_by(F.struct(*[c for c in every.columns if c not in (id_col, "__seq")]), F.col("__seq"))
    return every.groupBy(id_col).agg(last.alias("r")).select(id_col, "r.*")


def state(records: DataFrame, main: DataFrame, delta: DataFrame, id_col: str = "ref_id") -> DataFrame:
    """One row: totals of records, main, delta, both, missing, coverage (0 to 1), recommended action."""
    flag = lambda df, n: df.select(id_col, F.lit(1).alias(n)).distinct()
    joined = flag(records, "r").join(flag(main, "m"), id_col, "full").join(flag(delta, "d"), id_col, "full")
    some = F.col("m").isNotNull() | F.col("d").isNotNull()
    out = joined.agg(
        F.count("r").alias("total_records"), F.count("m").alias("main_records"), F.count("d").alias("delta_records"),
        F.sum(some.cast("long")).alias("unique_embedded"),
        F.sum((F.col("r").isNotNull() & ~some).cast("long")).alias("missing_records"),
        F.sum((F.col("r").isNotNull() & some).cast("long")).alias("covered"),
    )
    out = out.withColumn("coverage_pct", F.when(F.col("total_records") > 0, F.col("covered") / F.col("total_records")).otherwise(0.0)).drop("covered")
    action = F.when(F.col("delta_records") > 0, "compact_delta").when(F.col("main_records") == 0, "rebuild").otherwise("none")
    return out.withColumn("recommended_action", action)


def repair_raw(raw: DataFrame, records: DataFrame, id_col: str = "ref_id", field: str = "abstract") -> DataFrame:
    """Raw metadata with the ids added that records have and it lacks; unknown ids and blank fields are errors."""
    checks.require_none(raw.join(records, id_col, "left_anti"), "raw rows without a record")
    new = records.join(raw, id_col, "left_anti").select(id_col, field)
    checks.require_none(new.where(F.coalesce(F.length(F.trim(field)), F.lit(0)) == 0), "records without text")
    return raw.select(id_col, field).unionByName(new)


def shard_scores_top(scores: DataFrame, top_n: int, id_col: str = "ref_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("category_id").orderBy(F.desc("score_max"), id_col))
    return scores.withColumn("rank", rank).where(F.col("rank") <= top_n)


def date_stats(records: DataFrame, parts: list[DataFrame], by: str = "month", at: str = "pub_date", id_col: str = "ref_id") -> DataFrame:
    """(bucket, total, embedded, missing, coverage as a share) of records by day, month or year; ``parts`` hold what is embedded."""
    done = parts[0].select(id_col)
    for part in parts[1:]:
        done = done.unionByName(part.select(id_col))
    rows = records.where(F.col(at).isNotNull()).select(id_col, F.to_date(F.date_trunc(by, at)).alias("bucket"))
    flagged = rows.join(done.distinct().withColumn("__d", F.lit(1)), id_col, "left")
    out = flagged.groupBy("bucket").agg(F.count("*").alias("total"), F.count("__d").alias("embedded"))
    return out.withColumn("missing", F.col("total") - F.col("embedded")).withColumn("coverage", F.col("embedded") / F.col("total"))


def migrated(metadata: DataFrame, id_col: str = "ref_id", fields: tuple[str, ...] = ("abstract", "text", "summary")) -> DataFrame:
    """(ref_id, abstract) of metadata of any older layout: the first usual text column that holds something, a row an id."""
    have = [F.when(F.trim(f) != "", F.col(f)) for f in fields if f in metadata.columns]
    if not have:
        raise ValueError(f"none of {', '.join(fields)}")
    return metadata.select(F.col(id_col).alias("ref_id"), F.coalesce(*have).alias("abstract")).where("ref_id is not null").groupBy("ref_id").agg(F.max("abstract").alias("abstract"))
