"""Thin stores of a record collection, and the jobs that add records to it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import checks, ids
from stemma.operators import references, upsert
from stemma.sources import providers, records, tables


@dataclass
class Thin:
    """Stores by kind of id, and the arXiv-DOI pairs that the records name."""

    arxiv: DataFrame
    doi: DataFrame
    isbn: DataFrame
    pairs: DataFrame
    collections: DataFrame


def thin(rows: DataFrame, manual_pairs: DataFrame | None = None) -> Thin:
    """Thin stores of records: per collection and then over all, the highest version of an arXiv id, of equal ones the record with the
    shortest and then first file name, so the lower number; a DOI or ISBN of two records is an error."""
    file = ids.record_slug(F.col("doi"), F.col("ref_id")).alias("json_filename")
    a = F.when(F.col("source") == "arxiv", ids.bare_arxiv(F.col("arxiv_id_base"), F.col("source_id"), F.col("ref_id")))
    version = F.coalesce("arxiv_version", ids.arxiv_version(F.col("arxiv_id_versioned")))
    doi = ids.bare_doi(F.col("doi"))
    rows = rows.select("ref_id", "collection_id", a.alias("arxiv_id"), version.alias("arxiv_version"), doi.alias("doi"), ids.isbn_ref_id(F.split("isbn", ";")[0]).alias("isbn"), file)
    best = F.min_by(F.struct("arxiv_version", "json_filename", "doi", "collection_id"), F.struct(-F.col("arxiv_version"), F.length("json_filename"), "json_filename"))
    per = rows.where("arxiv_id is not null").groupBy("arxiv_id", "collection_id").agg(best.alias("b")).select("arxiv_id", "b.arxiv_version", "b.json_filename", "b.doi", "collection_id")
    arxiv = per.groupBy("arxiv_id").agg(best.alias("b")).select("arxiv_id", "b.arxiv_version", "b.json_filename", "b.doi")
    others = rows.where("arxiv_id is null")
    by_doi = others.where("doi is not null").select("doi", "json_filename").distinct()
    by_isbn = others.where("doi is null and isbn is not null").select("isbn", "json_filename").distinct()
    checks.require_unique(by_doi, "doi")
    checks.require_unique(by_isbn, "isbn")
    pairs = arxiv.where("doi is not null").select("arxiv_id", "doi")
    if manual_pairs is not None:
        pairs = pairs.unionByName(manual_pairs.select("arxiv_id", F.lower("doi").alias("doi"))).distinct()
    checks.require_none(references.ambiguous(pairs, "arxiv_id", "doi"), "ambiguous pairs")
    return Thin(arxiv, by_doi, by_isbn, pairs, per.select("collection_id", "arxiv_id", "json_filename"))


def locations(keys: DataFrame, stores: Thin) -> DataFrame:
    """(key, json_filename) of reference keys by the store that they belong to."""
    k = F.col(keys.columns[0])
    named = keys.select(k.alias("key"), F.coalesce(ids.bare_arxiv(k), F.when(ids.strip_doi(k).rlike(ids.DOI), ids.bare_doi(k)), ids.isbn_ref_id(k)).alias("id"))
    stored = (
        stores.arxiv.select(F.col("arxiv_id").alias("id"), "json_filename")
        .unionByName(stores.doi.select(F.col("doi").alias("id"), "json_filename"))
        .unionByName(stores.isbn.select(F.col("isbn").alias("id"), "json_filename"))
    )
    return named.join(stored, "id", "left").select("key", "json_filename")


def published_form(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` without the arXiv record of a work whose DOI record is there too."""
    both = pairs.select(F.concat(F.lit("arxiv:"), "arxiv_id").alias("a"), F.concat(F.lit("doi:"), F.lower("doi")).alias("d"))
    present = both.join(rows.select(F.lower("ref_id").alias("d")), "d", "left_semi")
    return rows.join(present.select(F.col("a").alias("ref_id")), "ref_id", "left_anti")


def add(spark: SparkSession, path: str, incoming: DataFrame, log: str | None = None) -> None:
    """Merge records into the table at ``path``: intra-batch dedup, version-aware merge by upsert key, conflicts to ``log``."""
    incoming = upsert.normalize_identity(checks.align(incoming, records.SCHEMA))
    key = ids.upsert_key(F.col("doi"), F.col("source"), F.col("source_id"), F.col("ref_id")).alias("__key")
    # written, as the merge repeats each column's expression many times
    new = tables.once(upsert.prefer_complete(incoming.select("*", key), ["__key"], "arxiv_version", ["ref_id"]), "incoming")
    old = tables.load(spark, path, records.SCHEMA).select("*", key)
    merged, conflicts = upsert.merge(old, new, "__key", "arxiv_version", once=log is not None)
    if log:
        conflicts.withColumn("recorded_at", F.current_timestamp()).write.mode("append").json(log)
    tables.overwrite(merged.drop("__key"), path)


def add_manual(spark: SparkSession, path: str, rows: DataFrame, collection_id: str) -> None:
    add(spark, path, records.manual(rows).withColumn("collection_id", F.lit(collection_id)))


def add_messages(spark: SparkSession, path: str, messages: DataFrame, collections: DataFrame) -> DataFrame:
    """Parse Crossref messages, route each record to its collection, merge; returns (ref_id, collection_id)."""
    parsed = providers.crossref_messages(messages).drop("collection_id")
    routed = references.assign_collections(parsed, collections)
    add(spark, path, parsed.join(routed, "ref_id"))
    return routed


def new_journals(rows: DataFrame, collections: DataFrame) -> DataFrame:
    """(collection_id, title, issns): collections to register for records that no known one takes; the title must be one."""
    taken = references.assign_collections(rows, collections, default="").where("collection_id = ''").select("ref_id")
    free = rows.join(taken, "ref_id", "left_semi").where(references.valid_title(F.col("journal")))
    name = F.regexp_replace(F.lower(F.trim("journal")), "[^a-z0-9]+", "_")
    codes = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.filter(F.split(F.coalesce("issn", F.lit("")), r";\s*"), lambda x: x != "")))))
    return free.groupBy(name.alias("collection_id")).agg(F.min("journal").alias("title"), codes.alias("issns"))


def research_status(refs: DataFrame, digests: DataFrame, research: dict[str, DataFrame]) -> DataFrame:
    """Coverage of each reference: has_llm_digest, schema version, revision, updated_at, and has_ and n_ of each research table."""
    d = digests.select("ref_id", F.lit(True).alias("has_llm_digest"), "schema_version", F.col("digest_revision").alias("revision"), "updated_at")
    out = references.status(refs, research, "ref_id").join(d, "ref_id", "left")
    return out.withColumn("has_llm_digest", F.coalesce("has_llm_digest", F.lit(False)))


def task_ref(rows: DataFrame, pairs: DataFrame, task: str) -> DataFrame:
    """(ref_id, task_ref_id): citations go to the DOI of a pair, digests and full texts to its arXiv record."""
    if task not in ("citation", "digest", "fulltext"):
        raise ValueError(f"unknown task {task}")
    a, d = F.concat(F.lit("arxiv:"), "arxiv_id"), F.concat(F.lit("doi:"), "doi")
    to = pairs.select((a if task == "citation" else d).alias("ref_id"), (d if task == "citation" else a).alias("__to")).dropDuplicates(["ref_id"])
    return rows.select("ref_id").join(to, "ref_id", "left").select("ref_id", F.coalesce("__to", "ref_id").alias("task_ref_id"))
