"""Embedding queries over ``embeddings``: categories are labels, queries the first vectors of each label."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.functions import vectors
from stemma.operators import embeddings as op
from stemma.plans.tables import read

PER_LABEL = 3


def _index(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")


def _queries(spark, d):
    rows = _index(spark, d).where("vec is not null and label is not null")
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))  # Spark keeps PER_LABEL rows a task before it shuffles
    name = F.format_string("cat_%d", F.col("label"))
    return rows.withColumn("place", place).where(F.col("place") <= PER_LABEL).select(name.alias("category_id"), F.format_string("q_%d", F.col("vec_id")).alias("query_id"), "vec")


def _query_vec(spark, d):
    return _index(spark, d).where("vec is not null").orderBy("vec_id").limit(1).collect()[0]["vec"]


def vector_search(spark, d):
    return op.search(_index(spark, d), _query_vec(spark, d), 20, id_col="vec_id").withColumn("score", F.round("score", 6))


def vector_norms(spark, d):
    return _index(spark, d).select("vec_id", F.round(vectors.norm(F.col("vec")), 6).alias("norm"), F.size("vec").alias("dimension"))


def _scores(spark, d):
    return op.category_scores(_index(spark, d), _queries(spark, d), 2, id_col="vec_id")


def category_scores(spark, d):
    r = lambda c: (F.round(c, 6) + F.lit(0.0)).alias(c)  # noqa: E731  minus zero as zero
    return _scores(spark, d).select("vec_id", "category_id", "query_n", r("score_max"), r("score_mean"), r("score_top_k_mean"))


def query_scores(spark, d):
    return op.pair_scores(_index(spark, d), _queries(spark, d), id_col="vec_id").withColumn("score", F.round("score", 6) + F.lit(0.0))


def label_threshold(spark, d):
    return op.label(_scores(spark, d), 0.5).select("vec_id", "category_id", F.round("score_max", 6).alias("score_max"))


def best_category(spark, d):
    return op.best_category(_scores(spark, d), id_col="vec_id").withColumn("score_max", F.round("score_max", 6))


def category_top(spark, d):
    top = op.shard_scores_top(_scores(spark, d), 5, id_col="vec_id")
    return top.select("vec_id", "category_id", F.round("score_max", 6).alias("score_max"), "rank")


def _main(spark, d):
    return _index(spark, d).where("label < 6").select(F.col("vec_id").alias("ref_id"), "vec", "label")


def _delta(spark, d):
    day = F.format_string("batch_202401%02d_1_x", F.col("label") + 1)
    return _index(spark, d).where("label between 5 and 7").select(F.col("vec_id").alias("ref_id"), F.reverse("vec").alias("vec"), "label", day.alias("batch"), F.col("vec_id").alias("seq"))


def state(spark, d):
    records = _index(spark, d).select(F.col("vec_id").alias("ref_id"))
    return op.state(records, _main(spark, d), _delta(spark, d)).withColumn("coverage_pct", F.round("coverage_pct", 6))


def compact(spark, d):
    out = op.compact(_main(spark, d), _delta(spark, d).drop("batch"))
    return out.select("ref_id", "label", F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


def search_delta(spark, d):
    out = op.search_delta(_delta(spark, d), _query_vec(spark, d), date="20240107", top_n=10)
    return out.withColumn("score", F.round("score", 6))


def targets(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("ref_id"), "text")
    known = read(spark, d, "labels").select(F.col("doc_id").alias("ref_id"))
    return op.targets(docs, [known], field="text").select("ref_id", F.length("text").alias("n"))


QUERIES = {
    f.__name__ if f.__name__.startswith("vector") else f"embedding_{f.__name__}": f
    for f in (
        vector_search, vector_norms, category_scores, query_scores, label_threshold, best_category, category_top, state, compact, search_delta, targets,
    )
}

_Q = f"""
i as (select vec_id, label, embedding::double[] as vec from embeddings),
q as (
  select 'cat_' || label as category_id, 'q_' || vec_id as query_id, vec
  from (select *, row_number() over (partition by label order by vec_id) as n from i where vec is not null and label is not null) where n <= {PER_LABEL}),
x as (select i.vec_id, category_id, query_id, list_dot_product(i.vec, q.vec) as s from i, q where i.vec is not null),
o as (select *, row_number() over (partition by vec_id, category_id order by s desc) as n from x),
c as (
  select vec_id, category_id, count(*)::int as query_n, max(s) as score_max, avg(s) as score_mean, avg(s) filter (n <= 2) as score_top_k_mean
  from o group by vec_id, category_id)"""
_D = """
m as (select vec_id as ref_id, embedding::double[] as vec, label from embeddings where label < 6),
d as (select vec_id as ref_id, list_reverse(embedding::double[]) as vec, label from embeddings where label between 5 and 7),
q0 as (select embedding::double[] as q from embeddings where embedding is not null order by vec_id limit 1)"""

ORACLE_SQL = {
    "vector_search": f"with {_Q}, {_D} select vec_id, round(list_dot_product(vec, q), 6) as score from i, q0 order by list_dot_product(vec, q) desc, vec_id limit 20",
    "vector_norms": "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, len(embedding)::int as dimension from embeddings",
    "embedding_category_scores": f"with {_Q} select vec_id, category_id, query_n, round(score_max, 6) + 0.0 as score_max, round(score_mean, 6) + 0.0 as score_mean, round(score_top_k_mean, 6) + 0.0 as score_top_k_mean from c",
    "embedding_query_scores": f"with {_Q} select vec_id, category_id, query_id, round(s, 6) + 0.0 as score from x",
    "embedding_label_threshold": f"with {_Q} select vec_id, category_id, round(score_max, 6) as score_max from c where score_max >= 0.5",
    "embedding_best_category": f"with {_Q}, b as (select *, row_number() over (partition by vec_id order by score_max desc, category_id) as n from c) select vec_id, category_id, round(score_max, 6) as score_max from b where n = 1",
    "embedding_category_top": f"with {_Q}, b as (select *, row_number() over (partition by category_id order by score_max desc, vec_id)::int as rank from c) select vec_id, category_id, round(score_max, 6) as score_max, rank from b where rank <= 5",
    "embedding_state": f"""with {_D}, r as (select vec_id as ref_id from embeddings),
j as (
  select r.ref_id, r.ref_id in (select ref_id from m) as im, r.ref_id in (select ref_id from d) as id from r)
select count(*) as total_records, (select count(*) from m) as main_records, (select count(*) from d) as delta_records,
  count(*) filter (im or id) as unique_embedded, count(*) filter (not im and not id) as missing_records,
  round(count(*) filter (im or id) / count(*), 6) as coverage_pct, 'compact_delta' as recommended_action from j""",
    "embedding_compact": f"with {_D}, a as (select * from m where ref_id not in (select ref_id from d) union all select * from d) select ref_id, label, round(vec[1], 6) as first from a",
    "embedding_search_delta": f"with {_D} select ref_id, round(list_dot_product(vec, q), 6) as score from d, q0 where label = 6 order by list_dot_product(vec, q) desc, ref_id limit 10",
    "embedding_targets": "select doc_id as ref_id, length(trim(text))::int as n from documents where length(trim(text)) > 0 and doc_id not in (select doc_id from labels)",
}
