"""Lexical search: BM25 index and search, keyword labels, phrase scores, per-category ranking."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.functions import checks, shipping, text
from stemma.sources import tables

K1, B, TOP_K = 1.5, 0.75, 50


@dataclass
class Index:
    """BM25 index: docs (doc_id, dl), postings (term, doc_id, tf), vocab (term, df, idf), meta (n, avgdl)."""

    docs: DataFrame
    postings: DataFrame
    vocab: DataFrame
    meta: DataFrame

    def write(self, path: str) -> None:
        for name in ("docs", "postings", "vocab", "meta"):
            df = getattr(self, name)
            if name == "postings":  # a search reads the row groups of its terms alone
                df = df.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("docs", "postings", "vocab", "meta")))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def normalized(docs: DataFrame, id_col: str, text_col: str, collapse_hyphen: bool = False) -> DataFrame:
    """(doc_id string, norm); tokens are the norm's words. Use norm once, or within :func:`text.let`, as plans repeat it otherwise."""
    norm = text.normalize(F.col(text_col)) if collapse_hyphen else text.normalize(F.col(text_col), False, "+#.-")
    return shipping.spread(docs.select(id_col, text_col)).select(F.col(id_col).cast("string").alias("doc_id"), norm.alias("norm"))


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", collapse_hyphen: bool = False,
    min_df: int = 1, max_df_prop: float = 1.0, check: bool = True,
) -> Index:
    """Postings of a whole corpus. Pruned terms leave document lengths and counts as they are.

    The corpus is read and tokenised once, into a row of term counts per document in the shared folder, which all four frames read.
    """
    if check:
        checks.require_unique(docs.select(id_col), id_col)
    norm = normalized(docs, id_col, text_col, collapse_hyphen)
    # one row holds all of a document's tokens, so its counts need no shuffle
    toks = norm.select("doc_id", F.array_remove(F.split("norm", " "), "").alias("toks"))
    counted = toks.select("doc_id", text.let(F.array_sort("toks"), lambda t: F.struct(F.size(t).alias("dl"), _counts(t).alias("terms"))).alias("c"))
    forward = tables.once(counted.select("doc_id", "c.dl", "c.terms"), "forward")
    lengths = forward.select("doc_id", "dl")
    meta = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    runs = forward.select("doc_id", F.explode("terms").alias("p"))
    postings = runs.select(F.col("p.term").alias("term"), "doc_id", F.col("p.tf").alias("tf"))
    vocab = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(meta))
    vocab = vocab.where((F.col("df") >= min_df) & (F.col("df") <= max_df_prop * F.col("n")))
    vocab = vocab.select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))
    if min_df > 1 or max_df_prop < 1:
        postings = postings.join(vocab.select("term"), "term", "left_semi")
    return Index(lengths, postings, vocab, meta)


def _counts(ordered: Column) -> Column:
    """Array of (term, tf) of a sorted array of tokens, cut where the term changes; none of an empty one."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (t[i] != t[F.greatest(i - 1, F.lit(0))]))
        return F.element_at(
            F.transform(
                F.array(starts),
                lambda s: F.transform(
                    s,
                    lambda i, k: F.struct(
                        t[i].alias("term"), (F.coalesce(F.get(s, k + 1), F.size(t)) - i).cast("int").alias("tf")
                    ),
                ),
            ),
            1,
        )

    return F.when(F.size(ordered) > 0, runs(ordered))


def _terms(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "category string, term string")


def search(
    docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", top_k: int = TOP_K, k1: float = K1, b: float = B,
    restrict_ids: DataFrame | None = None, collapse_hyphen: bool = False,
) -> DataFrame:
    """BM25 over a corpus as it is: doc_id, score, n_terms, matched_terms; best ``top_k``, ties by id.

    Only the query's terms are counted, inside each row, by byte searches; the counts are written once, and statistics and scores both
    read them. No token is shuffled, only a row per document that has a term.
    """
    terms = text.query_terms(query, collapse_hyphen)
    if not terms:
        raise ValueError("the query has no usable term")
    hits = lambda wide: F.array(*[F.struct(F.lit(t).alias("term"), text.times(wide, t).alias("tf")) for t in terms])
    counted = text.let(F.col("norm"), lambda n: F.struct(text.n_tokens(n).alias("dl"), text.let(text.spaced(n), hits).alias("hits")))
    slim = normalized(docs, id_col, text_col, collapse_hyphen).select("doc_id", counted.alias("c"))
    slim = tables.once(slim.select("doc_id", "c.dl", F.filter("c.hits", lambda h: h["tf"] > 0).alias("hits")), "counts")
    stats = slim.agg(
        F.count("*").alias("n"), F.avg("dl").alias("avgdl"),
        *[F.sum(F.array_contains(F.col("hits.term"), t).cast("long")).alias(f"df{i}") for i, t in enumerate(terms)],
    )
    found = slim.where(F.size("hits") > 0)
    if restrict_ids is not None:
        found = found.join(restrict_ids.select(F.col(restrict_ids.columns[0]).cast("string").alias("doc_id")), "doc_id", "left_semi")
    scored = found.crossJoin(F.broadcast(stats))
    weight = F.element_at(F.create_map(*[x for i, t in enumerate(terms) for x in (F.lit(t), idf(F.col("n"), F.col(f"df{i}")))]), F.col("h.term"))
    part = weight * F.col("h.tf") * (k1 + 1) / (F.col("h.tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    rows = scored.withColumn("h", F.explode("hits")).select("doc_id", F.col("h.term").alias("term"), part.alias("part"))
    return ranked(rows.groupBy("doc_id"), top_k)


def ranked(groups, top_k: int) -> DataFrame:
    out = groups.agg(
        F.sum("part").alias("score"), F.count("*").alias("n_terms"), F.array_join(F.array_sort(F.collect_set("term")), " | ").alias("matched_terms")
    )
    return out.orderBy(F.desc("score"), "doc_id").limit(top_k)


def scores(index: Index, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(category, doc_id, term, part) of an index; ``terms`` (category, term) is a query, so small."""
    vocab = index.vocab.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    hits = index.postings.join(F.broadcast(vocab), "term").join(index.docs, "doc_id").crossJoin(F.broadcast(index.meta))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.join(F.broadcast(terms), "term").select("category", "doc_id", "term", part.alias("part"))


def search_index(index: Index, query: str, top_k: int = TOP_K, k1: float = K1, b: float = B, restrict_ids: DataFrame | None = None) -> DataFrame:
    terms = text.query_terms(query)
    if not terms:
        raise ValueError("the query has no usable term")
    rows = scores(index, _terms(index.docs.sparkSession, [("", t) for t in terms]), k1, b)
    if restrict_ids is not None:
        rows = rows.join(restrict_ids.select(F.col(restrict_ids.columns[0]).cast("string").alias("doc_id")), "doc_id", "left_semi")
    return ranked(rows.groupBy("doc_id"), top_k)


def flatten_query_sets(query_sets: dict[str, dict[str, list[str]]]) -> list[tuple[str, str, str]]:
    """Distinct sorted (set, category, keyword) rows of nested query sets; unnamed and empty ones drop out."""
    rows = {
        (s, c, k.strip())
        for s, categories in query_sets.items() if s
        for c, keywords in (categories or {}).items() if c
        for k in keywords or () if k and k.strip()
    }
    return sorted(rows)


def search_query_set(index: Index, query_sets: dict, query_set: str, category: str, **options) -> DataFrame:
    words = [k for s, c, k in flatten_query_sets(query_sets) if s == query_set and c == category]
    return search_index(index, " ".join(words), **options)


def keyword_hits(docs: DataFrame, query_sets: dict, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, query_set, category, keyword) where a keyword occurs as a whole term in the normalised text.

    The text is normalised once a row and tested against each keyword in that row: no join at all. A keyword of letters
    and digits is looked up as bytes, with the marks that words may hold set apart; others by a pattern.
    """
    flat = sorted({(s, c, text.normalize_py(k)) for s, c, k in flatten_query_sets(query_sets) if text.normalize_py(k)})
    if not flat:
        raise ValueError("no keyword")

    def found(both: Column, k: str) -> Column:
        if not how and not set(k) & set("+#."):
            return F.contains(both["apart"], F.lit(f" {k} "))
        whole = F.contains(both["norm"], F.lit(k)) if how.get("case_insensitive", True) else F.lit(True)
        return whole & both["norm"].rlike(text.keyword_pattern(k, **how))

    def tests(both: Column) -> Column:
        named = lambda s, c, k: F.struct(F.lit(s).alias("query_set"), F.lit(c).alias("category"), F.lit(k).alias("keyword"))
        return F.array_compact(F.array(*[F.when(found(both, k), named(s, c, k)) for s, c, k in flat]))

    def apart(norm: Column) -> Column:
        for mark in "+#.":
            norm = F.replace(norm, F.lit(mark), F.lit(f" {mark} "))
        return F.concat(F.lit(" "), norm, F.lit(" "))

    rows = normalized(docs, id_col, text_col, True)
    both = text.let(F.col("norm"), lambda n: F.struct(n.alias("norm"), apart(n).alias("apart")))
    hits = rows.select("doc_id", F.explode(text.let(both, tests)).alias("h"))
    return hits.select("doc_id", "h.query_set", "h.category", "h.keyword")


def category_scores(hits: DataFrame, min_keywords: int = 1) -> DataFrame:
    return hits.groupBy("doc_id", "query_set", "category").agg(
        F.countDistinct("keyword").alias("n_keywords"),
        F.array_join(F.array_sort(F.collect_set("keyword")), " | ").alias("matched_keywords"),
        (F.countDistinct("keyword") >= min_keywords).alias("category_pass"),
    )


def set_scores(categories: DataFrame, min_categories: int = 1) -> DataFrame:
    passed = categories.where("category_pass")
    return passed.groupBy("doc_id", "query_set").agg(
        F.count("*").alias("n_categories"),
        F.sum("n_keywords").alias("total_distinct_keywords"),
        F.array_join(F.array_sort(F.collect_set("category")), " | ").alias("matched_categories"),
        (F.count("*") >= min_categories).alias("set_pass"),
    )


def label(docs: DataFrame, query_sets: dict, min_keywords: int = 1, min_categories: int = 1, **options) -> dict[str, DataFrame]:
    hits = keyword_hits(docs, query_sets, **options)
    categories = category_scores(hits, min_keywords)
    sets = set_scores(categories, min_categories)
    return {"keyword_hits": hits, "category_scores": categories, "set_scores": sets, "set_matches": sets.where("set_pass")}


def phrase_scores(docs: DataFrame, categories: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text", min_keywords: int = 2) -> DataFrame:
    """(doc_id, category, score_max): phrases of which all tokens occur, in any order.

    The division runs inside the row: a phrase matches if no token of it is missing from the text's.
    """
    phrases = sorted({(c, tuple(text.query_terms(k, True))) for c, keywords in categories.items() for k in keywords if text.query_terms(k, True)})

    def counts(wide: Column) -> Column:
        has = {t: F.contains(wide, F.lit(f" {t} ")) for t in sorted({t for _, p in phrases for t in p})}
        per = []
        for c in sorted({c for c, _ in phrases}):
            n = sum(reduce(lambda x, y: x & y, [has[t] for t in p]).cast("int") for k, p in phrases if k == c)
            per.append(F.struct(F.lit(c).alias("category"), n.alias("score_max")))
        return F.array(*per)

    norm = normalized(docs, id_col, text_col, True)
    rows = norm.select("doc_id", F.explode(text.let(F.concat(F.lit(" "), "norm", F.lit(" ")), counts)).alias("c"))
    return rows.select("doc_id", "c.category", "c.score_max").where(F.col("score_max") >= min_keywords)


def top_per_category(scored: DataFrame, top_n: int, score: str = "score", id_col: str = "doc_id", threshold: float | None = None) -> DataFrame:
    """Best ``top_n`` of each category with rank; ties by id."""
    if threshold is not None:
        scored = scored.where(F.col(score) >= threshold)
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc(score), id_col))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_n)


def bm25_by_category(index: Index, categories: dict[str, list[str]], top_n: int = 20, threshold: float = 0.0, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 summed over each category's distinct terms, ranked inside categories."""
    rows = sorted({(c, t) for c, keywords in categories.items() for k in keywords for t in text.query_terms(k)})
    parts = scores(index, _terms(index.docs.sparkSession, rows), k1, b)
    return top_per_category(parts.groupBy("category", "doc_id").agg(F.sum("part").alias("score")), top_n, threshold=threshold)
