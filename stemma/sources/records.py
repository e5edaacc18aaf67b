"""Reference records: schema, JSON payloads, projections, hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.functions import checks, ids
from stemma.functions.schemas import schema
from stemma.operators import upsert

_TEXT = (
    "ref_id source source_id entry_type title abstract authors journal container_title publisher volume issue pages doi isbn issn url note subject_primary "
    "subject_all url_landing url_pdf arxiv_id_versioned arxiv_id_base arxiv_version arxiv_primary_category arxiv_categories_raw arxiv_comment "
    "arxiv_journal_ref linked_doi_ref_id linked_arxiv_ref_id collection_id collection_title"
).split()
_KINDS = {"arxiv_version": "int"}
SCHEMA = schema(
    ", ".join(f"{n} {_KINDS.get(n, 'string')}" for n in _TEXT)
    + ", year int, month int, day int, pub_date timestamp, authors_list array<string>, raw_entry string"
)
#: Columns of listings, without abstracts and payloads.
NARROW = [n for n in SCHEMA.names if n not in ("abstract", "raw_entry", "authors_list", "note", "arxiv_comment", "arxiv_journal_ref")]
LOOKUP = [n for n in NARROW if n not in ("publisher", "volume", "issue", "pages", "subject_all", "url_pdf")]


def read_json(spark: SparkSession, path: str, modified_after: str | None = None, multi_line: bool = True) -> DataFrame:
    """Records of JSON documents, one a file, or one a line if not ``multi_line``; of a key the newest and fullest stays."""
    reader = spark.read.schema(SCHEMA).option("multiLine", multi_line).option("recursiveFileLookup", True)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    rows = reader.json(path)
    key = ids.upsert_key(F.col("doi"), F.col("source"), F.col("source_id"), F.col("ref_id"))
    return upsert.prefer_complete(rows.withColumn("__key", key), ["__key"], "arxiv_version", ["ref_id"]).drop("__key")


def payloads(records: DataFrame, collection: dict | None = None) -> DataFrame:
    """(file, payload): the JSON document of each record and the stem of its file."""
    rows = checks.align(records, SCHEMA)
    fields = [F.col(c) for c in SCHEMA.names]
    if collection is not None:
        fields.append(F.struct(*[F.lit(v).alias(k) for k, v in collection.items()]).alias("journal_config"))
    return rows.select(ids.record_slug(F.col("doi"), F.col("ref_id")).alias("file"), F.to_json(F.struct(*fields)).alias("payload"))


def write_json(records: DataFrame, path: str, partition_by: str | None = None) -> None:
    rows = checks.align(records, SCHEMA)
    writer = rows.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)


def hydrate(rows: DataFrame, records: DataFrame, fields: list[str], key: str = "ref_id") -> DataFrame:
    """``rows`` with empty fields taken from the record of the same key."""
    side = records.select(F.col(key).alias("__k"), *[F.col(f).alias(f"__{f}") for f in fields])
    out = rows.join(side.dropDuplicates(["__k"]), F.col(key) == F.col("__k"), "left")
    for f in fields:
        own = upsert.filled(rows, f) if f in rows.columns else F.lit(False)
        out = out.withColumn(f, F.when(own, F.col(f) if f in rows.columns else F.lit(None)).otherwise(F.col(f"__{f}")))
    return out.drop("__k", *[f"__{f}" for f in fields])


def manual(rows: DataFrame) -> DataFrame:
    """Hand-entered rows as records: ids by DOI, ISBN, URL or source, aligned to the schema."""
    out = checks.align(rows, SCHEMA)
    source = F.coalesce(ids.null_if_blank(F.col("source")), F.lit("manual"))
    made = ids.manual_ref_id(F.col("doi"), F.col("isbn"), F.col("url"), source, F.col("source_id"))
    out = out.withColumns({"source": source, "ref_id": F.coalesce(ids.null_if_blank(F.col("ref_id")), made)})
    checks.require_none(out.where(F.col("ref_id").isNull()).select("title"), "rows without any identifier")
    return out


def shard_paths(spark: SparkSession, root: str, years: list[int], name: str = "docs.parquet", must_exist: bool = True) -> list[str]:
    """Paths of year shards; an error names those that are absent."""
    from stemma.sources import tables

    found = [f"{root}/{y}/{name}" for y in years]
    absent = [p for p in found if not tables.exists(spark, p)]
    if absent and must_exist:
        raise FileNotFoundError(", ".join(absent))
    return [p for p in found if p not in absent]


def detect_columns(df: DataFrame, id_col: str | None = None, text_col: str | None = None) -> tuple[str, str]:
    """The id and text columns of a shard: those named, or the first usual names that are there."""
    pick = lambda given, usual: given or next((c for c in usual if c in df.columns), None)
    found = pick(id_col, ("doc_id", "arxiv_id", "ref_id", "id")), pick(text_col, ("abstract_norm", "abstract", "text"))
    checks.require_columns(df, *[f or "an id and a text column" for f in found])
    return found


def read_shard(spark: SparkSession, path: str, year: int | None = None, id_col: str | None = None, text_col: str | None = None) -> DataFrame:
    """(doc_id, year, text) of one shard; no other column is read."""
    df = spark.read.parquet(path)
    i, t = detect_columns(df, id_col, text_col)
    return df.select(F.col(i).cast("string").alias("doc_id"), F.lit(year).cast("int").alias("year"), F.col(t).alias("text"))
