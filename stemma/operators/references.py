"""Finding records, identity map, entities, coverage, status rollups and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stemma.functions import checks, ids, text

WIDE_LIMIT = 300
SEARCHED = ("title", "authors", "journal", "container_title", "url")


def find(
    records: DataFrame, query: str | None = None, columns: tuple[str, ...] = SEARCHED, substrings: dict[str, str] | None = None,
    links: DataFrame | None = None, collection_id: str | None = None, **members,
) -> DataFrame:
    """Conjunctive filter: each keyword names a column and its allowed values; ``query`` and ``substrings`` are literal, any case."""
    out = records
    for name, values in members.items():
        if values is not None:
            out = out.where(F.col(name).isin(list(values) if isinstance(values, list | tuple | set) else [values]))
    for name, value in (substrings or {}).items():
        out = out.where(text.contains_ci(value, F.col(name)))
    if query:
        out = out.where(text.contains_ci(query, *[F.col(c) for c in columns if c in out.columns]))
    if collection_id is not None and links is not None:
        out = out.join(links.where(F.col("collection_id") == collection_id).select("ref_id").distinct(), "ref_id", "left_semi")
    return out


def guard(df: DataFrame, limit: int = WIDE_LIMIT) -> DataFrame:
    """``df``, or an error if it has more rows than a wide projection should; reads ``limit + 1`` rows at most."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows; narrow the search first")
    return df


def by_keys(records: DataFrame, keys: DataFrame) -> DataFrame:
    """Records that a key names by DOI, id or source id, with which of them did (``matched_by``)."""
    wanted = keys.select(F.explode(ids.expand_keys(F.col(keys.columns[0]))).alias("key")).distinct()
    # a key of each kind meets a record once at most, so its rows stay as many as they are
    out, found = records, []
    for name in ("doi", "ref_id", "source_id"):
        side = wanted.select(F.col("key").alias(f"__{name}"))
        out = out.join(side, F.col(name) == F.col(f"__{name}"), "left")
        found.append(F.when(F.col(f"__{name}").isNotNull(), name))
    out = out.withColumn("matched_by", F.coalesce(*found)).where("matched_by is not null")
    return out.drop("__doi", "__ref_id", "__source_id")


def identity_map(pairs: DataFrame) -> DataFrame:
    """(arxiv_id, doi, ref_id, entity_id) of arXiv-DOI pairs."""
    ref = F.coalesce(F.concat(F.lit("arxiv:"), ids.null_if_blank(F.col("arxiv_id"))), F.concat(F.lit("doi:"), ids.null_if_blank(F.col("doi"))))
    return pairs.select("arxiv_id", "doi", ref.alias("ref_id"), ref.alias("entity_id"))


def ambiguous(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(side, id, n): ids that pair with more than one id of the other side."""
    out = []
    for one, other in ((left, right), (right, left)):
        n = pairs.where(F.col(one).isNotNull() & F.col(other).isNotNull()).groupBy(F.col(one).cast("string").alias("id")).agg(F.countDistinct(other).alias("n"))
        out.append(n.where("n > 1").select(F.lit(one).alias("side"), "id", "n"))
    return out[0].unionByName(out[1])


def add_pair(pairs: DataFrame, arxiv_id: str, doi: str) -> DataFrame:
    """``pairs`` with one more; an error if either side is paired already."""
    checks.require_none(pairs.where((F.col("arxiv_id") == arxiv_id) | (F.lower("doi") == doi.lower())), "already paired")
    return pairs.unionByName(pairs.sparkSession.createDataFrame([(arxiv_id, doi)], "arxiv_id string, doi string"))


def entities(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ref_id, entity_id): every record has an entity, a paired one that of the pair's preferred id."""
    linked = identity_map(pairs)
    both = linked.select(F.explode(F.array(F.concat(F.lit("arxiv:"), "arxiv_id"), F.concat(F.lit("doi:"), "doi"))).alias("ref_id"), "entity_id")
    best = both.groupBy("ref_id").agg(F.min_by("entity_id", F.struct(ids.ref_priority(F.col("entity_id")), F.col("entity_id"))).alias("linked"))
    out = records.select("ref_id").distinct().join(best, "ref_id", "left")
    return out.select("ref_id", F.coalesce("linked", "ref_id").alias("entity_id"))


def entity_collections(links: DataFrame, entity: DataFrame) -> DataFrame:
    """(entity_id, collection_id, recorded_at): the latest record of each."""
    return links.join(entity, "ref_id").groupBy("entity_id", "collection_id").agg(F.max("recorded_at").alias("recorded_at"))


def entity_rows(records: DataFrame, entity: DataFrame) -> DataFrame:
    """One citation row an entity: fields of its preferred record, first author, et al."""
    order = F.struct(ids.ref_priority(F.col("ref_id")), F.col("ref_id"))
    joined = records.join(entity, "ref_id")
    pick = lambda c: F.min_by(F.col(c), F.when(ids.null_if_blank(F.col(c).cast("string")).isNotNull(), order))
    out = joined.groupBy("entity_id").agg(
        F.min_by("ref_id", order).alias("primary_ref_id"), F.count("*").alias("n_refs"), *[pick(c).alias(c) for c in ("title", "authors", "year", "journal")]
    )
    names = F.split("authors", r";\s*")
    return out.withColumns({"first_author": F.get(names, F.lit(0)), "et_al": F.coalesce(F.size(names) > 1, F.lit(False))})


def status(entity: DataFrame, stores: dict[str, DataFrame], key: str = "entity_id") -> DataFrame:
    """``has_<store>`` and ``n_<store>`` of every entity; each store is counted before it is joined."""
    out = entity.select(key).distinct()
    for name, rows in stores.items():
        out = out.join(rows.groupBy(key).agg(F.count("*").alias(f"n_{name}")), key, "left")
        out = out.withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long"))).withColumn(f"has_{name}", F.col(f"n_{name}") > 0)
    return out


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row that comes first in ``order`` of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def missing(status_rows: DataFrame, store: str) -> DataFrame:
    return status_rows.where(~F.col(f"has_{store}"))


def enrichment_candidates(status_rows: DataFrame, include_ready: bool = True) -> DataFrame:
    """Entities with their eligibility for a digest: eligible = has a text and no digest yet."""
    reason = F.when(~F.col("has_md"), "missing_md").when(F.col("has_digest"), "digest_exists").otherwise("ready")
    out = status_rows.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "ready")
    return out if include_ready else out.where(~F.col("eligible"))


def orphans(artifacts: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Artifacts without a record."""
    return artifacts.join(records.select(key), key, "left_anti")


def compare_status(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, issue): ``missing``, ``orphan`` or ``stale`` of a stored rollup against a fresh one."""
    e, a = expected.alias("e"), actual.alias("a")
    joined = e.join(a, F.col(f"e.{key}") == F.col(f"a.{key}"), "full")
    differs = F.lit(False)
    for c in expected.columns:
        if c != key:
            differs = differs | ~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}"))
    issue = F.when(F.col(f"a.{key}").isNull(), "missing").when(F.col(f"e.{key}").isNull(), "orphan").when(differs, "stale")
    return joined.select(F.coalesce(f"e.{key}", f"a.{key}").alias(key), issue.alias("issue")).where("issue is not null")


def index_health(rows: list[tuple[str, int | None, bool]], spark, oversized_mb: float = 25.0) -> DataFrame:
    """(name, bytes, health) of (name, bytes or None, readable): missing, damaged, oversized or ok."""
    df = spark.createDataFrame(rows, "name string, bytes long, readable boolean")
    health = F.when(F.col("bytes").isNull(), "missing").when(~F.col("readable"), "damaged").when(F.col("bytes") > oversized_mb * 1e6, "oversized").otherwise("ok")
    return df.select("name", "bytes", health.alias("health"))


def diagnostics(**audits: DataFrame) -> DataFrame:
    """One row with the number of findings of each audit."""
    out = None
    for name, rows in audits.items():
        one = rows.agg(F.count("*").alias(f"n_{name}"))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def date_stats(rows: DataFrame, at: str, by: str = "month") -> DataFrame:
    """(bucket, n) by day, month or year."""
    return rows.where(F.col(at).isNotNull()).groupBy(F.to_date(F.date_trunc(by, at)).alias("bucket")).agg(F.count("*").alias("n"))


def missing_days(rows: DataFrame, at: str) -> DataFrame:
    """Days between the first and the last that have no row."""
    days = rows.where(F.col(at).isNotNull()).select(F.to_date(at).alias("day")).distinct()
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b")).alias("day")).join(days, "day", "left_anti")


def coverage(rows: DataFrame, done: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(by, total, done, missing, coverage as a share) of rows whose key ``done`` has."""
    flagged = rows.join(done.select(key).distinct().withColumn("__d", F.lit(1)), key, "left")
    out = flagged.groupBy(*by).agg(F.count("*").alias("total"), F.count("__d").alias("done"))
    return out.withColumn("missing", F.col("total") - F.col("done")).withColumn("coverage", F.col("done") / F.col("total"))


def assign_collections(records: DataFrame, collections: DataFrame, default: str = "unclassified_doi") -> DataFrame:
    """(ref_id, collection_id): the first collection whose title equals, or one of whose ISSNs is, the record's.

    Two equi-joins in place of a condition that only a nested loop could evaluate. ``collections`` is (collection_id,
    title, issns array, seq).
    """
    names = collections.select(F.lower(F.trim("title")).alias("k"), "collection_id", "seq").where("k is not null")
    codes = collections.select(F.explode("issns").alias("k"), "collection_id", "seq")
    wanted = names.withColumn("k", F.concat(F.lit("t:"), "k")).unionByName(codes.withColumn("k", F.concat(F.lit("i:"), "k")))
    keys = F.array_compact(F.concat(F.array(F.concat(F.lit("t:"), F.lower(F.trim("journal")))), F.transform(F.split(F.coalesce("issn", F.lit("")), r";\s*"), lambda x: F.concat(F.lit("i:"), x))))
    hits = records.select("ref_id", F.explode(keys).alias("k")).join(wanted, "k").groupBy("ref_id").agg(F.min_by("collection_id", "seq").alias("collection_id"))
    return records.select("ref_id").join(hits, "ref_id", "left").select("ref_id", F.coalesce("collection_id", F.lit(default)).alias("collection_id"))


def valid_title(title: Column) -> Column:
    """False for blank titles, titles of two characters or fewer, and mere numbers."""
    t = F.trim(title)
    return F.coalesce((F.length(t) > 2) & ~t.rlike(r"^\d+[A-Za-z]*$"), F.lit(False))
