"""Command line: JSON lines on standard output.

    python -m stemma.cli bm25 --docs PATH --query "..." [--top-k 50] [--id doc_id] [--text text]
    python -m stemma.cli keyword-report --docs PATH --queries FILE [--min-keywords 2] [--top-n 20] [--skip FILE]
    python -m stemma.cli bm25-report --docs PATH --queries FILE [--top-n 20] [--threshold 0] [--skip FILE]
    python -m stemma.cli build-index --docs PATH --out PATH [--min-df 1]
    python -m stemma.cli thin-stores --records PATH --out PATH
    python -m stemma.cli graph --edges PATH --roots ID [ID ...] [--max-depth 2] [--max-nodes 100]
    python -m stemma.cli read-bibtex --path FILE
    python -m stemma.cli write-bibtex --records PATH --out PATH --ids ID [ID ...]
    python -m stemma.cli digest-fields --digests PATH --fields NAME [NAME ...] --ids ID [ID ...]
    python -m stemma.cli replace-bibtex --path FILE --records PATH --pairs PATH --out PATH
    python -m stemma.cli add-records --library ROOT --payloads PATH --kind atom|crossref|doi|json --collection ID
    python -m stemma.cli add-pair --library ROOT --arxiv ID --doi DOI
    python -m stemma.cli sync-thin --library ROOT
    python -m stemma.cli build-entities --library ROOT
    python -m stemma.cli audit --library ROOT
    python -m stemma.cli ref-summary --library ROOT --ids ID [ID ...]
    python -m stemma.cli compact-embeddings --store ROOT --collection ID
    python -m stemma.cli embedding-report --index PATH --labels PATH [--model NAME] [--top-n 20] [--threshold 0] [--skip FILE]
    python -m stemma.cli cache-embedding-report --index PATH --labels PATH --out PATH [--model NAME]
    python -m stemma.cli ingest-digests --json PATH --store ROOT
    python -m stemma.cli digest-prompt --fragments FILE --values FILE --mode create|revise --store ROOT --ids ID
    python -m stemma.cli sync-anchor-edges --store ROOT --out PATH [--library ROOT]
    python -m stemma.cli add-edge --log PATH --source ID --target ID --relationship NAME
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.operators import digest, graph, lexical, stores
from stemma.operators.library import Library, append_log
from stemma.sources import bibtex, config, embedding_store, fetch, label_index, providers, records, tables


def show(df: DataFrame) -> None:
    """Rows as JSON lines, a partition at a time."""
    for row in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).toLocalIterator():
        print(row[0])


def without(df: DataFrame, skip: str | None, id_col: str) -> DataFrame:
    """``df`` without the ids that a log of reports lists, one or several a line, parted by commas."""
    if not skip:
        return df
    seen = df.sparkSession.read.text(skip).select(F.explode(F.split("value", r"\s*,\s*")).alias(id_col)).where(f"{id_col} <> ''").distinct()
    return df.join(seen, id_col, "left_anti")


NO_COLLECTIONS = {"collections": []}


def on_library(spark: SparkSession, a: argparse.Namespace) -> None:
    """The commands that work on a library of records."""
    library = Library(spark, a.library, NO_COLLECTIONS)
    if a.command == "add-records":
        if a.kind == "json":
            rows = records.read_json(spark, a.payloads)
        elif a.kind == "atom":
            whole = spark.read.text(a.payloads, wholetext=True)
            rows = providers.atom_entries(whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<entry\b.*?</entry>"), F.lit(0))).alias("xml")))
        elif a.kind == "crossref":
            rows = providers.crossref_messages(spark.read.text(a.payloads).withColumnRenamed("value", "json"))
        else:
            rows = fetch.parse_payloads(spark.read.parquet(a.payloads))
        show(library.add(rows, a.collection).select("ref_id", "collection_id"))
    elif a.command == "add-pair":
        library.add_pair(a.arxiv, a.doi)
    elif a.command == "sync-thin":
        show(library.sync_thin())
    elif a.command == "build-entities":
        print(json.dumps(library.build_entities()))
    elif a.command == "audit":
        show(library.audit_reference_cache())
        show(library.audit_authoritative())
        show(library.audit_entities({})["health"])
    else:
        show(library.references().where(F.col("ref_id").isin(a.ids)).select(*records.NARROW, "abstract"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="stemma", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *required: str, **optional) -> None:
        p = commands.add_parser(name)
        for r in required:
            p.add_argument(f"--{r}", required=True, **({"nargs": "+"} if r in ("roots", "ids", "fields") else {}))
        for o, default in optional.items():
            p.add_argument(f"--{o.replace('_', '-')}", default=default, type=type(default) if default is not None else str)

    command("bm25", "docs", "query", top_k=50, id="doc_id", text="text")
    command("keyword-report", "docs", "queries", min_keywords=2, top_n=20, id="doc_id", text="text", skip=None)
    command("bm25-report", "docs", "queries", top_n=20, threshold=0.0, id="doc_id", text="text", skip=None)
    command("build-index", "docs", "out", min_df=1, id="doc_id", text="text")
    command("thin-stores", "records", "out")
    command("graph", "edges", "roots", max_depth=2, max_nodes=100)
    command("read-bibtex", "path")
    command("write-bibtex", "records", "out", "ids")
    command("digest-fields", "digests", "fields", "ids")
    command("replace-bibtex", "path", "records", "pairs", "out")
    command("add-records", "library", "payloads", "kind", "collection")
    command("add-pair", "library", "arxiv", "doi")
    for name in ("sync-thin", "build-entities", "audit"):
        command(name, "library")
    command("ref-summary", "library", "ids")
    command("compact-embeddings", "store", "collection")
    command("embedding-report", "index", "labels", model="", top_n=20, threshold=0.0, skip=None)
    command("cache-embedding-report", "index", "labels", "out", model="")
    command("ingest-digests", "json", "store")
    command("digest-prompt", "fragments", "values", "mode", "store", "ids")
    command("sync-anchor-edges", "store", "out", library=None)
    command("add-edge", "log", "source", "target", "relationship")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("stemma").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "bm25":
        show(lexical.search(spark.read.parquet(a.docs), a.query, a.id, a.text, a.top_k))
    elif a.command == "keyword-report":
        scores = lexical.phrase_scores(spark.read.parquet(a.docs), config.query_set(a.queries), a.id, a.text, a.min_keywords)
        show(without(lexical.top_per_category(scores, a.top_n, score="score_max"), a.skip, "doc_id").orderBy("category", "rank"))
    elif a.command == "bm25-report":
        index = lexical.build_index(spark.read.parquet(a.docs), a.id, a.text)
        show(without(lexical.bm25_by_category(index, config.query_set(a.queries), a.top_n, a.threshold), a.skip, "doc_id").orderBy("category", "rank"))
    elif a.command == "build-index":
        lexical.build_index(spark.read.parquet(a.docs), a.id, a.text, min_df=a.min_df).write(a.out)
    elif a.command == "thin-stores":
        made = stores.thin(spark.read.parquet(a.records))
        for name in ("arxiv", "doi", "isbn", "pairs", "collections"):
            tables.overwrite(getattr(made, name), f"{a.out}/{name}")
    elif a.command == "graph":
        nodes, edges, meta = graph.build(spark.read.parquet(a.edges), a.roots, max_depth=a.max_depth, max_nodes=a.max_nodes)
        show(nodes)
        show(edges)
        show(spark.createDataFrame([tuple(meta.values())], list(meta)))
    elif a.command == "read-bibtex":
        show(bibtex.read(spark, a.path).orderBy("file", "seq"))
    elif a.command == "write-bibtex":
        for missing in bibtex.write(spark.read.parquet(a.records), a.ids, a.out):
            print(f"no record: {missing}", file=sys.stderr)
    elif a.command == "replace-bibtex":
        found = bibtex.prefer_linked_doi(bibtex.entries(spark, a.path), spark.read.parquet(a.pairs), spark.read.parquet(a.records))
        found.orderBy("seq").select("entry").coalesce(1).write.mode("overwrite").text(a.out, lineSep="\n\n")
        show(found.where("outcome <> 'kept'").select("key", "outcome").orderBy("key"))
    elif a.command in ("add-records", "add-pair", "sync-thin", "build-entities", "audit", "ref-summary"):
        on_library(spark, a)
    elif a.command == "compact-embeddings":
        embedding_store.EmbeddingStore(spark, a.store, a.collection).compact()
    elif a.command in ("embedding-report", "cache-embedding-report"):
        scores = label_index.LabelIndex(spark, a.labels, a.model).score(spark.read.parquet(a.index))
        if a.command == "cache-embedding-report":
            tables.overwrite(scores, a.out)
        else:
            named = scores.withColumnRenamed("category_id", "category")
            top = lexical.top_per_category(named, a.top_n, score="score_max", id_col="ref_id", threshold=a.threshold)
            show(without(top, a.skip, "ref_id").orderBy("category", "rank"))
    elif a.command == "ingest-digests":
        digest.Store(spark, a.store).write(digest.parse(spark.read.text(a.json, wholetext=True).withColumnRenamed("value", "json")))
    elif a.command == "digest-prompt":
        has = digest.Store(spark, a.store).read(a.ids[:1]).limit(1).count() > 0
        print(digest.prompt(json.loads(Path(a.fragments).read_text()), json.loads(Path(a.values).read_text()), a.mode, has))
    elif a.command == "sync-anchor-edges":
        pairs = Library(spark, a.library, NO_COLLECTIONS).all_pairs() if a.library else None
        edges = graph.from_digests(digest.Store(spark, a.store).read(), pairs)
        old = tables.load(spark, a.out, edges.schema)
        tables.overwrite(graph.replace_sources(old, edges), a.out)
    elif a.command == "add-edge":
        line = [(a.source, a.target, a.relationship, datetime.now(UTC).isoformat())]
        append_log(spark.createDataFrame(line, "source_ref_id string, target_ref_id string, relationship string, recorded_at string"), a.log)
    else:
        show(spark.read.parquet(a.digests).where(F.col("ref_id").isin(a.ids)).select("ref_id", *a.fields))


if __name__ == "__main__":
    main()
