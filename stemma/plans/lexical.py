"""Lexical queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import text
from stemma.operators import lexical
from stemma.plans.tables import read

QUERY = "the of tion with"
SETS = {
    "english": {"articles": ["the", "a"], "joining": ["and", "of the", "with"]},
    "german": {"articles": ["der", "die", "das"], "joining": ["und", "mit"]},
    "romance": {"articles": ["la", "le", "les", "el"], "joining": ["de la", "que"]},
}
PHRASES = {"english": ["of the", "the and", "with to"], "german": ["der die", "und der"], "romance": ["de la", "que la", "le de"]}


def bm25_search(spark, d):
    return lexical.search(read(spark, d, "documents"), QUERY, top_k=10).withColumn("score", F.round("score", 6))


def bm25_search_restricted(spark, d):
    labelled = read(spark, d, "labels").where("quality = 1").select("doc_id")
    return lexical.search(read(spark, d, "documents"), QUERY, top_k=10, restrict_ids=labelled).withColumn("score", F.round("score", 6))


def bm25_vocabulary(spark, d):
    return lexical.build_index(read(spark, d, "documents")).vocab.withColumn("idf", F.round("idf", 6))


def bm25_pruned_vocabulary(spark, d):
    return lexical.build_index(read(spark, d, "documents"), min_df=3, max_df_prop=0.5).vocab.withColumn("idf", F.round("idf", 6))


def bm25_postings(spark, d):
    return lexical.build_index(read(spark, d, "documents")).postings


def bm25_documents(spark, d):
    return lexical.build_index(read(spark, d, "documents")).docs


def bm25_index_search(spark, d):
    return lexical.search_index(lexical.build_index(read(spark, d, "documents")), QUERY, top_k=10).withColumn("score", F.round("score", 6))


def bm25_query_set(spark, d):
    index = lexical.build_index(read(spark, d, "documents"))
    return lexical.search_query_set(index, SETS, "english", "joining", top_k=10).withColumn("score", F.round("score", 6))


def bm25_by_category(spark, d):
    index = lexical.build_index(read(spark, d, "documents"))
    return lexical.bm25_by_category(index, SETS["german"], top_n=5, threshold=0.1).withColumn("score", F.round("score", 6))


def lexical_normalize(spark, d):
    return read(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("norm"))


def lexical_tokens(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.size(text.tokens(t)).alias("n_hyphen"), F.size(text.tokens(t, True)).alias("n_collapsed"))


def keyword_hits(spark, d):
    return lexical.keyword_hits(read(spark, d, "documents"), SETS)


def category_scores(spark, d):
    return lexical.label(read(spark, d, "documents"), SETS, 2)["category_scores"]


def set_scores(spark, d):
    return lexical.label(read(spark, d, "documents"), SETS, 2, 2)["set_scores"]


def set_matches(spark, d):
    return lexical.label(read(spark, d, "documents"), SETS, 2, 2)["set_matches"]


def phrase_scores(spark, d):
    return lexical.phrase_scores(read(spark, d, "documents"), PHRASES)


def phrase_top(spark, d):
    return lexical.top_per_category(lexical.phrase_scores(read(spark, d, "documents"), PHRASES, min_keywords=1), 10, score="score_max")


QUERIES = {
    f.__name__ if f.__name__.startswith(("bm25", "lexical")) else f"lexical_{f.__name__}": f
    for f in (
        bm25_search, bm25_search_restricted, bm25_vocabulary, bm25_pruned_vocabulary, bm25_postings, bm25_documents, bm25_index_search, bm25_query_set,
        bm25_by_category, lexical_normalize, lexical_tokens, keyword_hits, category_scores, set_scores, set_matches, phrase_scores, phrase_top,
    )
}


def norm_sql(x: str, collapse: bool = True) -> str:
    c = f"lower(coalesce({x}, ''))"
    if collapse:
        c = f"regexp_replace({c}, '[-/_]+', ' ', 'g')"
    keep = "+#." if collapse else "+#.\\-"
    return f"trim(regexp_replace(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\s{keep}]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _toks(collapse: bool = False) -> str:
    return f"list_filter(string_split({norm_sql('text', collapse)}, ' '), lambda x: x <> '')"


_BASE = f"""
t as (select doc_id::varchar as doc_id, {_toks()} as toks from documents),
dl as (select doc_id, len(toks)::int as dl from t),
meta as (select count(*) as n, avg(dl) as avgdl from dl),
post as (select term, doc_id, count(*)::int as tf from (select doc_id, unnest(toks) as term from t) group by all),
vocab as (select term, count(*) as df, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)) as idf from post, meta group by term),
part as (
  select term, doc_id, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) as part
  from post join vocab using (term) join dl using (doc_id), meta)"""


def _search_sql(query: str, where: str = "true", top: int = 10) -> str:
    terms = ", ".join(f"'{t}'" for t in text.query_terms(query))
    return f"""with {_BASE}
select doc_id, round(sum(part), 6) as score, count(*) as n_terms, string_agg(term, ' | ' order by term) as matched_terms
from part where term in ({terms}) and {where} group by doc_id order by sum(part) desc, doc_id limit {top}"""


_FLAT = lexical.flatten_query_sets(SETS)
_HITS = "(" + " union all ".join(
    f"select doc_id::varchar as doc_id, '{s}' as query_set, '{c}' as category, '{k}' as keyword from n "
    f"where regexp_matches(norm, '(^|[^\\p{{L}}\\p{{N}}])' || replace('{k}', ' ', '\\s+') || '($|[^\\p{{L}}\\p{{N}}])')"
    for s, c, k in _FLAT
) + ")"
_LABEL = f"""with n as (select doc_id, {norm_sql('text')} as norm from documents),
hits as {_HITS},
cat as (
  select doc_id, query_set, category, count(distinct keyword) as n_keywords, string_agg(distinct keyword, ' | ' order by keyword) as matched_keywords,
    count(distinct keyword) >= 2 as category_pass
  from hits group by doc_id, query_set, category),
sets as (
  select doc_id, query_set, count(*) as n_categories, sum(n_keywords)::bigint as total_distinct_keywords,
    string_agg(category, ' | ' order by category) as matched_categories, count(*) >= 2 as set_pass
  from cat where category_pass group by doc_id, query_set)
"""
_PHRASE = f"""with t as (select doc_id::varchar as doc_id, {_toks(True)} as toks from documents),
p(category, terms) as (values {", ".join(f"('{c}', {text.query_terms(k, True)})" for c, ks in PHRASES.items() for k in ks)}),
s as (select doc_id, category, count(*)::int as score_max from t, p where list_has_all(toks, terms) group by all)
"""
_CATS = ", ".join(f"('{c}', '{t}')" for c, t in sorted({(c, t) for c, ks in SETS["german"].items() for k in ks for t in text.query_terms(k)}))

ORACLE_SQL = {
    "bm25_search": _search_sql(QUERY),
    "bm25_index_search": _search_sql(QUERY),
    "bm25_query_set": _search_sql("and of the with"),
    "bm25_search_restricted": _search_sql(QUERY, "doc_id in (select doc_id::varchar from labels where quality = 1)"),
    "bm25_vocabulary": f"with {_BASE} select term, df, round(idf, 6) as idf from vocab",
    "bm25_pruned_vocabulary": f"with {_BASE} select term, df, round(idf, 6) as idf from vocab, meta where df >= 3 and df <= 0.5 * n",
    "bm25_postings": f"with {_BASE} select term, doc_id, tf from post",
    "bm25_documents": f"with {_BASE} select doc_id, dl from dl",
    "bm25_by_category": f"""with {_BASE},
c(category, term) as (values {_CATS}),
s as (select category, doc_id, sum(part) as score from part join c using (term) group by all having sum(part) >= 0.1),
r as (select *, row_number() over (partition by category order by score desc, doc_id)::int as rank from s)
select category, doc_id, round(score, 6) as score, rank from r where rank <= 5""",
    "lexical_normalize": f"select doc_id, {norm_sql('text')} as norm from documents",
    "lexical_tokens": f"select doc_id, len({_toks()})::int as n_hyphen, len({_toks(True)})::int as n_collapsed from documents",
    "lexical_keyword_hits": _LABEL + "select * from hits",
    "lexical_category_scores": _LABEL + "select * from cat",
    "lexical_set_scores": _LABEL + "select * from sets",
    "lexical_set_matches": _LABEL + "select * from sets where set_pass",
    "lexical_phrase_scores": _PHRASE + "select doc_id, category, score_max from s where score_max >= 2",
    "lexical_phrase_top": _PHRASE
    + """, r as (select *, row_number() over (partition by category order by score_max desc, doc_id)::int as rank from s)
select * from r where rank <= 10""",
}
