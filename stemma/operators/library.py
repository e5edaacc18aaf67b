"""A library of records on disk: jobs that sync collections, add references, rebuild what is derived, and audit it.

Records are one keyed table; which collections hold a record is a table of links. Thin stores, entities and their status are derived
and can always be built again. Fetching is a function by channel: (collection, first day or None, last day or None) -> records.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import checks, ids
from stemma.functions.schemas import schema
from stemma.operators import references, stores, upsert
from stemma.sources import config as configs
from stemma.sources import records, tables

LINKS = schema("ref_id string, collection_id string, recorded_at timestamp")
PAIRS = schema("arxiv_id string, doi string")
LOG = schema("collection_id string, job string, at timestamp, first_day string, last_day string, n_records long")
#: Key of each thin store.
THIN = {"arxiv": ["arxiv_id"], "doi": ["doi"], "isbn": ["isbn"], "pairs": ["arxiv_id", "doi"], "collections": ["collection_id", "arxiv_id"]}
Fetch = Callable[[dict, str | None, str | None], DataFrame]


class Library:
    def __init__(self, spark: SparkSession, root: str, config: dict, fetchers: dict[str, Fetch] | None = None):
        self.spark, self.root, self.config, self.fetchers = spark, root.rstrip("/"), config, fetchers or {}

    def _at(self, name: str) -> str:
        return f"{self.root}/{name}"

    # reading

    def references(self) -> DataFrame:
        """All records, once each."""
        return tables.load(self.spark, self._at("records"), records.SCHEMA)

    def reference_collections(self) -> DataFrame:
        """(ref_id, collection_id, recorded_at): one row a record and collection."""
        return tables.load(self.spark, self._at("links"), LINKS)

    def pairs(self) -> DataFrame:
        return tables.load(self.spark, self._at("pairs"), PAIRS)

    def read(self, collection_id: str) -> DataFrame:
        """Records of one collection."""
        self.collection(collection_id)
        return references.find(self.references(), links=self.reference_collections(), collection_id=collection_id)

    def collection(self, collection_id: str) -> dict:
        for row in self.config["collections"]:
            if row["collection_id"] == collection_id:
                return row
        raise ValueError(f"unknown collection {collection_id}")

    # adding

    def add(self, rows: DataFrame, collection_id: str | None = None) -> DataFrame:
        """Merge records into the table and link them to a collection, or to the one that each row names; returns the links."""
        rows = tables.once(upsert.normalize_identity(checks.align(rows, records.SCHEMA)), "records")
        stores.add(self.spark, self._at("records"), rows, self._at("conflicts"))
        name = F.lit(collection_id) if collection_id else F.col("collection_id")
        links = rows.select("ref_id", name.alias("collection_id"), F.current_timestamp().alias("recorded_at")).where("ref_id is not null and collection_id is not null")
        links = tables.once(links.dropDuplicates(["ref_id", "collection_id"]), "links")
        tables.overwrite(upsert.upsert(self.reference_collections(), links, ["ref_id", "collection_id"]), self._at("links"))
        return links

    def _fetched(self, job: str, collection_id: str, first: str | None, last: str | None) -> int:
        row = self.collection(collection_id)
        fetch = self.fetchers.get(row["remote_channel"])
        if fetch is None:
            raise ValueError(f"no fetcher for channel {row['remote_channel']}")
        got = tables.once(checks.align(fetch(row, first, last), records.SCHEMA), "fetched")
        n = got.count()
        if n:
            self.add(got, collection_id)
        line = [(collection_id, job, datetime.now(UTC).replace(tzinfo=None), first, last, n)]
        self.spark.createDataFrame(line, LOG).coalesce(1).write.mode("append").parquet(self._at("sync_log"))
        return n

    def sync(self, collection_id: str, first: str | None = None, last: str | None = None) -> int:
        """Fetch what came since the last sync (or from ``first`` on) and merge it; returns how many records came."""
        if first is None:
            done = self.last_sync().where(F.col("collection_id") == collection_id).first()
            first = done["last_sync"].date().isoformat() if done else None
        return self._fetched("sync", collection_id, first, last)

    def sync_all(self) -> dict[str, int]:
        """All collections, one after another."""
        return {row["collection_id"]: self.sync(row["collection_id"]) for row in self.config["collections"]}

    def repair(self, collection_id: str, first: str | None = None, last: str | None = None) -> int:
        """Fetch a range of days again, all if none is named, and merge it."""
        if first and last and first > last:
            raise ValueError("first is after last")
        return self._fetched("repair", collection_id, first, last)

    # the same under the older name of a collection
    sync_journal, read_journal, repair_journal = sync, read, repair

    def log(self) -> DataFrame:
        return tables.load(self.spark, self._at("sync_log"), LOG)

    def last_sync(self) -> DataFrame:
        """(collection_id, last_sync, n_records) of the latest run of each collection."""
        best = F.max_by("n_records", "at").alias("n_records")
        return self.log().groupBy("collection_id").agg(F.max("at").alias("last_sync"), best)

    def add_dois(self, dois: DataFrame, fetch: Callable[[DataFrame], DataFrame], auto_register: bool = False) -> DataFrame:
        """Fetch records of DOIs, route each to its collection, merge; returns the DOIs that no service knows.

        ``fetch`` gives records of (doi). With ``auto_register`` journals that no collection takes become collections of their own
        before the records are routed.
        """
        wanted = dois.select(ids.bare_doi(F.col(dois.columns[0])).alias("doi")).where("doi is not null").distinct()
        got = tables.once(checks.align(fetch(wanted), records.SCHEMA), "dois")
        known = self.collections()
        if auto_register:
            new = stores.new_journals(got, known)
            for r in new.orderBy("collection_id").collect():  # a row a journal
                self.config["collections"].append(
                    dict(zip(configs.REQUIRED, (r["collection_id"], "journal", r["title"], "crossref", r["collection_id"]), strict=True)) | {"metadata": {"issns": list(r["issns"])}}
                )
            known = self.collections()
        routed = references.assign_collections(got, known)
        self.add(got.drop("collection_id").join(routed.dropDuplicates(["ref_id"]), "ref_id"))
        return wanted.join(got.select(F.lower("doi").alias("doi")).distinct(), "doi", "left_anti")

    def collections(self) -> DataFrame:
        """(collection_id, title, issns, seq) of the configuration."""
        rows = [(c["collection_id"], c["title"], list((c.get("metadata") or {}).get("issns") or []), k) for k, c in enumerate(self.config["collections"])]
        return self.spark.createDataFrame(rows, "collection_id string, title string, issns array<string>, seq int")

    def add_pair(self, arxiv_id: str, doi: str) -> None:
        """Pair an arXiv record with its DOI; an error if either has a pair."""
        tables.overwrite(references.add_pair(self.pairs(), arxiv_id, doi.lower()), self._at("pairs"))

    def enrich(self, arxiv_id: str, doi: str, fetch: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Pair an arXiv record with its DOI and, if ``fetch`` is given, add the DOI's record."""
        self.add_pair(arxiv_id, doi)
        if fetch is not None:
            self.add_dois(self.spark.createDataFrame([(doi,)], "doi string"), fetch)

    # derived tables

    def thin(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(f"thin/{name}"))

    def sync_thin(self, changed: DataFrame | None = None) -> DataFrame:
        """Build the thin stores of all records, or fold those of ``changed`` records in; (store, key, change) of what came and went.

        A full build takes the hand-made pairs in. Folding in removes nothing.
        """
        rows = self.references().drop("collection_id") if changed is None else checks.align(changed, records.SCHEMA).drop("collection_id")
        linked = rows.join(self.reference_collections().select("ref_id", "collection_id"), "ref_id", "left")
        made = stores.thin(checks.align(linked, records.SCHEMA), self.pairs() if changed is None else None)
        out = None
        for name, keys in THIN.items():
            fresh = tables.once(getattr(made, name).dropDuplicates(keys), name)
            stored = tables.load(self.spark, self._at(f"thin/{name}"), fresh.schema)
            table, changes = upsert.upsert_scaffold(stored, fresh, keys, remove_missing=changed is None)
            changes = tables.once(changes.select(F.lit(name).alias("store"), F.col(keys[0]).alias("key"), "change"), "changes")
            tables.overwrite(table, self._at(f"thin/{name}"))
            out = changes if out is None else out.unionByName(changes)
        return out

    def all_pairs(self) -> DataFrame:
        """Pairs that records name and pairs made by hand."""
        rows = stores.thin(self.references(), self.pairs())
        return rows.pairs

    def build_entities(self, stores_: dict[str, DataFrame] | None = None) -> dict[str, int]:
        """Write entities, their collections, citation rows and status; returns the number of rows of each."""
        rows = self.references()
        pairs = tables.once(self.all_pairs(), "pairs")
        entity = tables.once(references.entities(rows.select("ref_id"), pairs), "entities")
        by_entity = {n: df.join(entity, "ref_id") for n, df in (stores_ or {}).items()}
        made = {
            "entities": entity,
            "entity_collections": references.entity_collections(self.reference_collections(), entity),
            "entity_rows": references.entity_rows(rows, entity),
            "entity_status": references.status(entity, by_entity),
        }
        for name, df in made.items():
            tables.overwrite(df, self._at(f"derived/{name}"))
        return {name: self.derived(name).count() for name in made}

    def derived(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._at(f"derived/{name}"))

    # audits

    def audit_reference_cache(self) -> DataFrame:
        """(scope, n_missing, n_extra): keys that the thin stores lack, and that they have in vain, by store."""
        linked = self.references().drop("collection_id").join(self.reference_collections().select("ref_id", "collection_id"), "ref_id", "left")
        made = stores.thin(checks.align(linked, records.SCHEMA), self.pairs())
        out = None
        for name, keys in THIN.items():
            fresh, stored = (df.select(*keys).distinct() for df in (getattr(made, name), tables.load(self.spark, self._at(f"thin/{name}"), getattr(made, name).schema)))
            one = references.diagnostics(missing=fresh.join(stored, keys, "left_anti"), extra=stored.join(fresh, keys, "left_anti"))
            one = one.select(F.lit(name).alias("scope"), "n_missing", "n_extra")
            out = one if out is None else out.unionByName(one)
        return out

    def audit_authoritative(self) -> DataFrame:
        """One row: ids paired twice, thin rows without a record, records whose ISBN is none."""
        rows = self.references()
        pairs = rows.where("source = 'arxiv' and doi is not null").select(F.col("source_id").alias("arxiv_id"), F.lower("doi").alias("doi")).unionByName(self.pairs()).distinct()
        slugs = rows.select(ids.record_slug(F.col("doi"), F.col("ref_id")).alias("json_filename")).distinct()
        thin = None
        for name in ("arxiv", "doi", "isbn"):
            path = self._at(f"thin/{name}")
            if tables.exists(self.spark, path):
                one = self.spark.read.parquet(path).select("json_filename")
                thin = one if thin is None else thin.unionByName(one)
        orphan = slugs.limit(0) if thin is None else thin.join(slugs, "json_filename", "left_anti")
        unresolved = rows.where(ids.null_if_blank(F.col("isbn")).isNotNull() & ids.isbn_ref_id(F.split("isbn", ";")[0]).isNull())
        return references.diagnostics(ambiguous=references.ambiguous(pairs, "arxiv_id", "doi"), orphan_payloads=orphan, unresolved_isbn=unresolved)

    def audit_entities(self, artifacts: dict[str, DataFrame], oversized_mb: float = 25.0) -> dict[str, DataFrame]:
        """``ambiguous`` pairs, ``orphans`` (artifact, ref_id) without a record, ``health`` of the derived tables, ``status`` differences."""
        rows = self.references()
        orphans = None
        for name, df in artifacts.items():
            one = references.orphans(df.select("ref_id").distinct(), rows, "ref_id").select(F.lit(name).alias("artifact"), "ref_id")
            orphans = one if orphans is None else orphans.unionByName(one)
        health = []
        for name in ("entities", "entity_collections", "entity_rows", "entity_status"):
            path = self._at(f"derived/{name}")
            there = tables.exists(self.spark, path)
            health.append((name, tables.size(self.spark, path) if there else None, there and tables.readable(self.spark, path)))
        pairs = rows.where("source = 'arxiv' and doi is not null").select(F.col("source_id").alias("arxiv_id"), F.lower("doi").alias("doi")).unionByName(self.pairs()).distinct()
        return {"ambiguous": references.ambiguous(pairs, "arxiv_id", "doi"), "orphans": orphans, "health": references.index_health(health, self.spark, oversized_mb)}


def read_log(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A log of tab-separated values with a header, such as identity pairs, edges or histories kept by hand."""
    return spark.read.schema(columns).option("sep", "\t").option("header", True).csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").option("sep", "\t").option("header", True).csv(path)
